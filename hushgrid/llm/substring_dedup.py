"""Removal of passages that repeat across documents, by level-wise doubling.

A window of many words can repeat only if each shorter window in it repeats. So
windows of FIRST words are looked at first; those that repeat (in documents of different id) are
extended to twice that length, and so on (4, 8, 13 for the contract's 13 words): a level
looks at no window whose shorter ones did not survive, and a chunk without survivors sends nothing more.
Of the shorter windows in a full one, a level below the last looks at its anchor alone, the one of smallest
hash, so that equal full windows have equal anchors and a fifth of all places is looked at.
The last level brings back the smallest doc_id of each full window that is left.
``longest`` goes on doubling (13, 26, 52, ...) until no window survives.

Windows are compared by 64-bit hashes of the words, at the last level by 96 bits.
Counts are made over all documents, chunk by chunk (see exchange.py); texts are shuffled once.

Defined cases: a null or empty text has no words; doc_ids are whole numbers, a null one comes after all others;
rows of one doc_id don't remove each other's words; a window repeated within a
document alone stays; documents shorter than the window stay whole;
kept words are joined by one space; extra columns stay, whatever their names.
"""

from __future__ import annotations

import re
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushgrid.llm.exchange import SENT, answers, dealt_by, reduced, send, width
from hushgrid.llm.runtime import chunk_count, cut, ready, unused
from hushgrid.llm.words import as_strings, docs_of, grouped, mix, tidy, window_starts, windows, word_hashes

WINDOW = 13
#: Words of the shortest windows looked at: nearly all shorter ones repeat.
FIRST = 4
LAST = np.iinfo(np.int64).max
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def levels(window: int) -> list[int]:
    """The lengths that are looked at, each twice the one before; the last is the window."""
    out = [min(FIRST, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


class Chunk:
    """The windows of the documents of one chunk. alive: those that no level has ruled out."""

    def __init__(self, table: pa.Table, window: int):
        self.window = window
        ids = table["doc_id"].cast(pa.int64())
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        self.ids = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
        self.hashes, self.starts = word_hashes(as_strings(table["text"]))
        self.alive = np.flatnonzero(window_starts(self.starts, window))
        self.doc = docs_of(self.starts)[self.alive]

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors of this length of the windows alive, sorted, and whether documents of different id in this chunk have it."""
        low, size, span = windows(self.hashes, length), 1, self.window - length + 1
        while size * 2 <= span:
            low, size = np.minimum(low[:-size], low[size:]), size * 2
        if size < span:
            low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
        own = low[self.alive]
        # neighbouring windows mostly share an anchor: runs of one document and anchor
        new = np.ones(len(own), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.run = np.cumsum(new) - 1
        keys, self.group, _ = grouped(own[new])
        ids = self.ids[self.doc[new]]
        least, most = np.full(len(keys), LAST), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(least, self.group, ids)
        np.maximum.at(most, self.group, ids)
        return keys, (least != most).astype(np.uint8)

    def survive(self, repeated: np.ndarray) -> None:
        """Leave those alive whose anchor repeats. repeated: for each of anchors()."""
        if len(self.alive):
            left = repeated[self.group].astype(bool)[self.run]
            self.alive, self.doc = self.alive[left], self.doc[left]

    def full(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct windows alive in order, as two hashes, and the smallest doc_id of each."""
        keys = windows(self.hashes, self.window)[self.alive]
        check = (windows(mix(self.hashes + np.uint64(1)), self.window)[self.alive] >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(keys)
        if ((keys[order][1:] == keys[order][:-1]) & (check[order][1:] != check[order][:-1])).any():
            order = np.lexsort((check, keys))
        keys, check = keys[order], check[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (check[1:] != check[:-1])
        self.group = np.empty(len(keys), dtype=np.int64)
        self.group[order] = np.cumsum(new) - 1
        low = np.full(int(new.sum()), LAST)
        np.minimum.at(low, self.group, self.ids[self.doc])
        return keys[new], check[new], low


def _repeated(group, n, columns):
    count = np.bincount(group, minlength=n) > 1
    count |= np.bincount(group, weights=columns[0], minlength=n) > 0
    return count[group].astype(np.uint8)


def _lowest(group, n, columns):
    low = np.full(n, LAST)
    np.minimum.at(low, group, columns[1])
    return low[group]


def _among(got: pa.Table, level: int) -> pa.Table:
    return got.filter(pa.array(np.array(got["level"].to_pylist(), dtype=np.int64) == level))


def _cut_text(text: str | None, gone: np.ndarray) -> str:
    """text without the words marked; the white space around what stays is as it was, but for that after a removed passage."""
    data = (text or "").encode("utf-8", "surrogatepass")
    starts = [m.start() for m in WORD.finditer(data)] + [len(data)]
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
    out, at = [], 0
    for s, e in zip(edges[::2], edges[1::2], strict=True):
        out.append(data[at : starts[s]])
        at = starts[e]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, window: int = WINDOW, rejoin: bool = True) -> DataFrame:
    """docs with text cut to the kept words, n_words and n_removed (columns of these names are replaced). Without rejoin, white space stays: that of a text that loses no word, and around passages that stay."""
    ready(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed")
    n, (chunk, task) = chunk_count(docs), unused(docs, "_chunk", "_task")
    wide, lengths = width(n), levels(window)
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(n)).cast("int")
    dealt = dealt_by(docs.withColumn(chunk, key), chunk, n, task).groupBy(task, chunk)

    def reached(table: pa.Table, got: pa.Table | None, level: int) -> Chunk:
        """The chunk after the levels before this one."""
        c = Chunk(table, window)
        for i, length in enumerate(lengths[:level]):
            c.anchors(length)
            c.survive(answers(_among(got, i), np.uint8))
        return c

    def ask(level: int):
        def first(table: pa.Table) -> pa.Table:
            return second(table, None)

        def second(table: pa.Table, got: pa.Table | None) -> pa.Table:
            if not table.num_rows:
                return send(0, wide, np.zeros(0, dtype=np.uint64))
            c = reached(table, got, level)
            return send(table[chunk][0].as_py(), wide, *(c.full() if level == len(lengths) - 1 else c.anchors(lengths[level])))

        return second if level else first

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    names = docs.columns

    def finish(table: pa.Table, got: pa.Table) -> pa.Table:
        c = reached(table, got, len(lengths) - 1)
        c.full()
        low = answers(_among(got, len(lengths) - 1), np.int64)
        hit = c.alive[low[c.group] < c.ids[c.doc]] if len(c.alive) else c.alive
        edge = np.zeros(len(c.hashes) + 1, dtype=np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        before = np.concatenate(([0], np.cumsum(gone)))
        removed = before[c.starts[1:]] - before[c.starts[:-1]]
        kept = []
        for i, text in enumerate(table["text"].to_pylist()):
            own = gone[c.starts[i] : c.starts[i + 1]]
            if not rejoin:
                kept.append(_cut_text(text, own) if removed[i] else text)
                continue
            w = (text or "").encode("utf-8", "surrogatepass").split()
            kept.append(b" ".join(compress(w, (~own).tolist()) if removed[i] else w).decode("utf-8", "surrogatepass"))
        tidy()
        columns = [pa.array(kept, pa.string()) if x == "text" else table[x] for x in names]
        return pa.Table.from_arrays([*columns, pa.array(np.diff(c.starts), pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    known = None
    for i in range(len(lengths)):
        sent = (dealt.applyInArrow(ask(i), SENT) if known is None else dealt.cogroup(known.groupBy("task", "chunk")).applyInArrow(ask(i), SENT))
        last = i == len(lengths) - 1
        got = reduced(sent, n, *((["u8", "u4", "i8"], _lowest, "i8") if last else (["u8", "u1"], _repeated, "u1")), checked=last)
        got = dealt_by(got.withColumn("level", F.lit(i)), "chunk", n, "task")
        known = got if known is None else dealt_by(known.unionByName(got), "chunk", n, "task")
    return dealt.cogroup(known.groupBy("task", "chunk")).applyInArrow(finish, schema)


def longest(docs: DataFrame, first: int = WINDOW) -> DataFrame:
    """(doc_id, words) of the documents that share a window of ``first`` words with one of other id: the longest length out of first, 2 x first, 4 x first, ... at which they still do.

    Each level looks only at windows both halves of which survived the one before, and writes what survives (a bit a place) to the shared folder; it ends when nothing does.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = chunk_count(docs)
    wide = width(n)
    placed = cut(docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")))
    dealt = dealt_by(placed, "chunk", n, "task").groupBy("task", "chunk")
    mark = "chunk int, level int, bucket int, data binary, doc_ids array<long>"
    marks, found, length = None, None, first

    def chunk_at(table: pa.Table, got: pa.Table | None, length: int) -> Chunk:
        c = Chunk(table.sort_by([("doc_id", "ascending"), ("text", "ascending")]), length)  # marks go by place
        if got is not None:
            own = [d for d in _among(got, -1)["data"].to_pylist() if d]
            half = np.unpackbits(np.frombuffer(b"".join(own), dtype=np.uint8)).astype(bool)
            half = np.concatenate((half, np.zeros(len(c.hashes) + length, dtype=bool)))[: len(c.hashes) + length]
            left = half[c.alive] & half[c.alive + length // 2]
            c.alive, c.doc = c.alive[left], c.doc[left]
        return c

    while True:

        def ask(table: pa.Table, got: pa.Table | None = None, length=length) -> pa.Table:
            if not table.num_rows:
                return send(0, wide, np.zeros(0, dtype=np.uint64))
            return send(table["chunk"][0].as_py(), wide, *chunk_at(table, got, length).anchors(length))

        def survivors(table: pa.Table, got: pa.Table, length=length, later=marks is not None) -> pa.Table:
            c = chunk_at(table, got if later else None, length) if table.num_rows else None
            if c is not None:
                c.anchors(length)
                c.survive(answers(_among(got, 0), np.uint8))
            if c is None or not len(c.alive):
                return pa.table({"chunk": pa.array([], pa.int32()), "level": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "data": pa.array([], pa.binary()), "doc_ids": pa.array([], pa.list_(pa.int64()))})
            bits = np.zeros(len(c.hashes), dtype=bool)
            bits[c.alive] = True
            ids = [None if x == LAST else x for x in np.unique(c.ids[c.doc]).tolist()]
            return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "level": pa.array([-1], pa.int32()), "bucket": pa.array([0], pa.int32()), "data": pa.array([np.packbits(bits).tobytes()], pa.binary()), "doc_ids": pa.array([ids], pa.list_(pa.int64()))})

        sent = dealt.applyInArrow(lambda t: ask(t), SENT) if marks is None else dealt.cogroup(dealt_by(marks, "chunk", n, "task").groupBy("task", "chunk")).applyInArrow(lambda t, g: ask(t, g), SENT)
        got = reduced(sent, n, ["u8", "u1"], _repeated, "u1").select("chunk", F.lit(0).alias("level"), "bucket", "data", F.lit(None).cast("array<long>").alias("doc_ids"))
        got = got if marks is None else got.unionByName(marks)
        now = cut(dealt.cogroup(dealt_by(got, "chunk", n, "task").groupBy("task", "chunk")).applyInArrow(lambda t, g: survivors(t, g), mark))
        if now.isEmpty():
            break
        own = now.select(F.explode("doc_ids").alias("doc_id"), F.lit(length).cast("long").alias("words"))
        found = own if found is None else found.unionByName(own)
        marks, length = now, 2 * length
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, words long")
    return found.groupBy("doc_id").agg(F.max("words").alias("words"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
