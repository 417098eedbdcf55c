"""Token ids of whole texts, each distinct word encoded once a worker.

Valid for tokenizers whose pre-tokenizer never joins characters across white
space and drops the white space itself: then the ids of a text are the ids of its
words, one after the other. ``Encoder`` checks that on probe texts when it opens
the file, and encodes whole texts where it doesn't hold. Texts that hold an added
token (``<|endoftext|>``), in any case of its letters, are always encoded whole by the tokenizer itself.

Where the tokenizer folds case, words are folded before they are looked up, and
final punctuation is a word of its own. Both only where no mark can follow that
would compose with the letter: before ASCII and before the letters U+00C0 to U+00FF.
"""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hushgrid.llm.words import BLANK, KEPT, slices, spans, split_words, tidy

#: Distinct words that a worker keeps the ids of (about 170 bytes each), in two halves: when the younger is full, the older is given up, but for words met again.
KEPT_WORDS = 500_000
#: Bytes of text encoded at once, and bytes after which free memory goes back to the machine.
SLICE, TIDY = 4 << 20, 32 << 20
#: Words given to the tokenizer as one text.
JOINED = 2000
PROBES = ("Two  words,\tÉté déjà vu: it's 42%!\n\nthe end…  áb ́c ﬁn x\u0085y ΑΣ ", " a\x1fb \x1f  c'd 'S ' \r\n.. \x1f. 日本 语\x0bé", "J̌ İ. i̇ K. ß ẞ! ‍  x ﷺ 🙂🙂 ﻿")
FOLD_PROBES = ("word, WoRd.", "É. é! àÇ:", "x9?! Ab9.,;", "ÀÉß: ÞÿÖ, B.Ü!", "it's. IT'S; 'S: ab' x'' 9$$$ é<|> A*** z\\")
SEPARATOR = "\x1f"
TAIL = np.isin(np.arange(256), [b for b in range(33, 127) if not chr(b).isalnum()])
ALNUM = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
#: Second bytes, after C3, of the small letters from U+00DF to U+00FF, and of the capitals from U+00C0 to U+00DE.
SMALL, CAPITAL = (np.isin(np.arange(256), [x for x in r if x not in (0x97, 0xB7)]) for r in (range(0x9F, 0xC0), range(0x80, 0x9F)))

_OPEN: dict[str, Encoder] = {}
#: When it was used last, and after how many seconds it goes.
_USED, IDLE = [0.0], 4
KEPT.append(_OPEN)


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, one a worker."""
    _USED[0] = time.monotonic()
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = Encoder(path)
        threading.Thread(target=_watch, daemon=True).start()
    return _OPEN[path]


def _watch() -> None:
    """Give the encoder up when no task of this worker has used it for a while: idle workers live on."""
    while _OPEN and time.monotonic() - _USED[0] < IDLE:
        time.sleep(0.5)
    _OPEN.clear()
    tidy()


def folded(texts: pa.Array) -> pa.Array:
    """texts with A-Z and the capitals from U+00C0 to U+00DE as small letters, and a space before ASCII punctuation that ends a word after a letter or digit; neither where a mark might follow."""
    data, offsets = spans(texts)
    if not len(data):
        return texts
    after = np.append(data[1:], np.uint8(32))
    after[offsets[1:][np.diff(offsets) > 0] - 1] = 32
    safe = (after < 128) | (after == 0xC3)
    upper = data - np.uint8(65) < 26
    lead = np.flatnonzero(data[:-1] == 0xC3)
    upper[lead[CAPITAL[data[lead + 1]]] + 1] = True
    upper &= safe
    data = data + (upper.view(np.uint8) << 5)
    tail = TAIL[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[offsets] = True
    fresh = fresh[:-1]
    first = tail.copy()
    first[1:] &= ~tail[:-1] | fresh[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(tail & ~TAIL[after])
    whole = BLANK[after[last]] & (first > 0) & ~fresh[first]
    at = first[whole]
    before = data[at - 1]
    at = at[ALNUM[before] | SMALL[before] & (data[np.maximum(at - 2, 0)] == 0xC3)]
    data = np.insert(data, at, np.uint8(32))
    offsets = offsets + np.searchsorted(at, offsets)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = sorted({t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.seen = 0
        self.by_word = not any(BLANK[list(t)].any() for t in self.added) and all(self._same(p, _words(p)) for p in PROBES)
        self.folds = self.by_word and all(self._same(p, _words(folded(pa.array([p]))[0].as_py())) for p in FOLD_PROBES + PROBES)
        mark = self.plain([SEPARATOR])[0]
        #: The id that parts words encoded as one text, if the tokenizer has one for that.
        self.mark = mark[0] if self.by_word and len(mark) == 1 else None

    def _same(self, whole: str, words: list[str]) -> bool:
        return self.plain([whole])[0] == [i for ids in self.plain(words) for i in ids]

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, 4 bytes each."""
        if len(self.kept) > KEPT_WORDS // 2:
            self.older, self.kept = self.kept, {}
        out = list(map(self.kept.get, words))
        missed = [w for w, x in zip(words, out, strict=True) if x is None]
        if missed:
            self.learn(missed)
            out = list(map(self.kept.__getitem__, words))
        return out

    def learn(self, words: list[str]) -> None:
        if self.older:
            known = {w: x for w in words if (x := self.older.get(w)) is not None}
            self.kept.update(known)
            words = [w for w in words if w not in known]
        apart = words if self.mark is None else [w for w in words if SEPARATOR in w]
        for at in range(0, len(apart), JOINED):
            some = apart[at : at + JOINED]
            self.kept.update((w, np.array(ids, dtype="<u4").tobytes()) for w, ids in zip(some, self.plain(some), strict=True))
        if self.mark is None:
            return
        words = [w for w in words if SEPARATOR not in w] if apart else words
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = np.array(self.plain([f" {SEPARATOR} ".join(some)])[0], dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
            data = ids.tobytes()
            self.kept.update(zip(some, (data[4 * s : 4 * e] for s, e in zip([0, *(e + 1 for e in ends)], ends, strict=False)), strict=True))

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """batch() for some texts at a time, with the number of the first; what is held stays bounded by the longest text."""
        for at, to in slices(texts, SLICE):
            yield at, *self.batch(texts.slice(at, to - at))
            self.seen += SLICE
            _USED[0] = time.monotonic()
            if self.seen > TIDY:
                self.seen = 0
                tidy(_OPEN)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other as uint32, and where each text's ids start (one more entry than texts)."""
        if not self.by_word:
            return self._whole(texts.to_pylist())
        marked = self._marked(texts)
        if not marked:
            return self._by_words(texts)
        parts, at = [], 0
        for i in marked:
            parts += [self._by_words(texts.slice(at, i - at)), self._whole([texts[i].as_py()])]
            at = i + 1
        parts.append(self._by_words(texts.slice(at)))
        sizes = np.concatenate([np.diff(starts) for _, starts in parts])
        return np.concatenate([ids for ids, _ in parts]), np.concatenate(([0], np.cumsum(sizes)))

    def _marked(self, texts: pa.Array) -> list[int]:
        """The numbers of the texts that hold an added token, in any case."""
        found: set[int] = set()
        for token in self.added:
            held = pc.match_substring(texts, token.decode(), ignore_case=True)
            found.update(np.flatnonzero(held.to_numpy(zero_copy_only=False)).tolist())
        return sorted(found)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.plain(texts)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        return np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(starts[-1])), starts

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded, starts = split_words(folded(texts) if self.folds else texts)
        index = coded.indices.to_numpy(zero_copy_only=False)
        if not len(index):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(starts), dtype=np.int64)
        ids = self.words(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        first = np.cumsum(sizes) - sizes
        each = sizes[index]
        ends = np.concatenate(([0], np.cumsum(each)))
        at = np.repeat(first[index] - ends[:-1], each)
        at += np.arange(int(ends[-1]))
        return flat[at], ends[starts]


def _words(text: str) -> list[str]:
    return [w.decode() for w in text.encode().split()]
