"""Globs as anchored regular expressions."""

from __future__ import annotations

import posixpath
import re


def path_glob(glob: str) -> str:
    """A glob over paths: ** crosses folders, * and ? don't; [..] and {a,b} as usual. For Java and Python alike."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "(?:/.*)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            own = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + "[" + ("^" + own[1:] if own[0] in "!^" else own) + "]", end + 1
            continue
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^(?:{out})$"


def name_glob(glob: str) -> str:
    """A glob over ref names: only * is special, and it crosses slashes."""
    return "^" + ".*".join(re.escape(p) for p in glob.split("*")) + "$"


def clean_path(path: str) -> str:
    path = posixpath.normpath(path.replace("\\", "/"))
    return "" if path == "." else path.removeprefix("./")
