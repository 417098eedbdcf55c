"""Catalog patterns are written in RE2's dialect. They are translated for Java and for Python.

Both get RE2's meaning of word boundaries, white space, digits, ends and case folding.
What RE2 refuses (look-around, back-references, possessive and atomic groups) is refused
here as well.
"""

from __future__ import annotations

import re

try:  # classes by property (such as letters of any script) need it
    import regex as engine
except ImportError:
    engine = re

ASCII = {"d": "0-9", "w": "0-9A-Za-z_", "s": r"\t\n\f\r "}
BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
NOT_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
REPEAT = re.compile(r"\{\d+(?:,\d*)?\}$")
FLAGS = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])")


class PatternError(ValueError):
    """A pattern that RE2 would not take. Its text is not repeated in the message."""


def translate(pattern: str, target: str = "java", fold: bool = False) -> str:
    """The pattern for 'java' or 'python'; fold ignores case throughout."""
    out, i, n, in_class, multi = [], 0, len(pattern), False, False
    lead = "i" if fold else ""
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                raise PatternError("a pattern ends in a backslash")
            e = pattern[i + 1]
            if e in "123456789" and not in_class:
                raise PatternError("back-references are not supported")
            if e in "GKZRXk":
                raise PatternError("an escape is not supported")
            if e.lower() in ASCII:
                own = ASCII[e.lower()]
                if in_class and e.isupper():
                    out.append(f"[^{own}]" if target == "java" else _outside(own))
                else:
                    out.append(own if in_class else f"[{'^' if e.isupper() else ''}{own}]")
            elif e in "bB" and not in_class:
                out.append(BOUNDARY if e == "b" else NOT_BOUNDARY)
            elif e == "z":
                out.append(r"\z" if target == "java" else r"\Z")
            elif e == "A":
                out.append(r"\A")
            elif e == "Q":
                end = pattern.find("\\E", i + 2)
                text = pattern[i + 2 : end if end >= 0 else n]
                out.append("".join(re.escape(x) for x in text))
                i = end + 2 if end >= 0 else n
                continue
            elif e in "pP" and target == "python" and engine is re:
                raise PatternError("character classes by property have no Python form")
            elif e == "x" and pattern[i + 2 : i + 3] == "{":
                end = pattern.index("}", i)
                out.append(re.escape(chr(int(pattern[i + 3 : end], 16))))
                i = end + 1
                continue
            else:
                out.append(c + e)
            i += 2
            continue
        if in_class:
            if c == "[" and pattern[i + 1 : i + 2] == ":":
                end = pattern.index(":]", i)
                out.append(_posix(pattern[i + 2 : end]))
                i = end + 2
                continue
            in_class = c != "]" or pattern[i - 1] == "[" or pattern[i - 2 : i] == "[^"
            out.append("\\" + c if c in "[&" and in_class else c)
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
        elif c == "(" and pattern[i + 1 : i + 2] == "?":
            if m := FLAGS.match(pattern, i):
                if "U" in (m[1] or "") + (m[2] or ""):
                    raise PatternError("the flag U is not supported")
                multi |= "m" in m[1]
                if m[3] == ")" and not m[2] and i == 0:
                    lead += m[1]
                else:
                    out.append(_flags(m, target))
                i = m.end()
                continue
            if pattern.startswith("(?P<", i):
                out.append("(?<" if target == "java" else "(?P<")
                i += 4
                continue
            if pattern.startswith("(?<", i) and pattern[i + 3 : i + 4] not in ("=", "!"):
                out.append("(?<" if target == "java" else "(?P<")
                i += 3
                continue
            raise PatternError("look-around and atomic groups are not supported")
        elif (c in "*+?" or c == "}" and REPEAT.search(pattern, 0, i + 1)) and pattern[i + 1 : i + 2] == "+":
            raise PatternError("possessive repetition is not supported")
        elif c == "}" and not REPEAT.search(pattern, 0, i + 1):
            out.append(r"\}")
        elif c == "$" and not multi:
            out.append(r"\z" if target == "java" else r"\Z")
            i += 1
            continue
        else:
            out.append(c)
        i += 1
    flags = "".join(dict.fromkeys(lead))
    if target == "java":
        flags = flags.replace("i", "iu") + "d"
    made = (f"(?{flags})" if flags else "") + "".join(out)
    if target == "python":
        try:
            engine.compile(made)
        except engine.error:
            raise PatternError("a pattern does not compile") from None
    return made


def _flags(m: re.Match, target: str) -> str:
    on = m[1].replace("i", "iu") if target == "java" else m[1]
    if target == "python" and m[3] == ")":
        raise PatternError("flags within a pattern need a group")
    return f"(?{on}{'-' + m[2] if m[2] else ''}{m[3]}"


def _posix(name: str) -> str:
    # Classes of POSIX names.
    known = {"alpha": "A-Za-z", "digit": "0-9", "alnum": "0-9A-Za-z", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0b\f\r ", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f", "punct": r"!-/:-@\[-`{-~", "blank": r"\t "}
    if name not in known:
        raise PatternError("an unknown class")
    return known[name]


def _outside(own: str) -> str:
    """All characters that are not in own, as ranges for a class."""
    inside = {ord(x) for x in map(chr, range(128)) if re.match(f"[{own}]", x)}
    out, at = "", 0
    for b in [*sorted(inside), 0x110000]:
        if at < b:
            out += f"\\U{at:08x}-\\U{b - 1:08x}"
        at = b + 1
    return out
