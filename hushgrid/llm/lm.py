"""Language-model scores by stupid backoff, each document against all others.

Count tables of n-grams of 1 to ``order`` words are partitioned by the hash of the n-gram (see
exchange.py): a chunk of documents sends each n-gram it has once, with its count there,
and gets back the count in the whole corpus. The document's n-grams, exploded in place, are
joined to these counts, its own occurrences taken off, so that a text is never scored by
itself. Scores are summed per document. ``count_table`` gives the tables themselves, a row an n-gram: the
join of such rows would shuffle a row a word and order, so scores() carries the same tables packed.

S(w after h) = c(h w) / c(h) if c(h w) > 0, else B S(w after h without its first word); S(w) = c(w) / N if
c(w) > 0, else B / (N + 1). Scores are logarithms. h is the order - 1 words before, or as many as there are.
Counts c and the number N of words are those of all other documents; B is the backoff factor.

Defined cases: a null or empty text has 0 words, score 0 and a null mean; N is at least 1;
repeated rows are documents of their own and count for each other, as do rows of one
doc_id; doc_ids are whole numbers; of extra columns none stays. What the tables gather grows with the corpus: nothing is
sampled or cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrid.llm.exchange import SENT, answers, dealt_by, reduced, send, unpack, unsqueeze, width
from hushgrid.llm.runtime import chunk_count, ready
from hushgrid.llm.words import as_strings, docs_of, grouped, mix, tidy, window_starts, windows, word_hashes

BACKOFF = 0.4
#: Words of the longest n-grams of the query (README has the figures of more).
ORDER = 2
#: The key under which chunks count their words.
ALL = np.uint64(0)


class Chunk:
    def __init__(self, table: pa.Table, order: int):
        hashes, self.starts = word_hashes(as_strings(table["text"]))
        self.doc = docs_of(self.starts)
        self.at = [np.arange(len(hashes)), *(np.flatnonzero(window_starts(self.starts, o)) for o in range(2, order + 1))]
        found = np.concatenate([[ALL], mix(hashes + np.uint64(1)), *(windows(hashes, o)[at] for o, at in enumerate(self.at[1:], 2))])
        del hashes
        self.keys, group, self.counts = grouped(found)
        del found
        self.counts[group[0]] += len(self.doc) - 1
        ends = np.cumsum([1, *map(len, self.at)])
        #: For each order the number of the key at each place of at.
        self.groups = [group[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]

    def elsewhere(self, total: np.ndarray, o: int) -> np.ndarray:
        """How often each n-gram of an order occurs in other documents, by place."""
        group, doc = self.groups[o], self.doc[self.at[o]]
        _, at, n = grouped(doc * len(self.keys) + group)
        return total[group] - n[at]

    def scores(self, total: np.ndarray, backoff: float) -> tuple[np.ndarray, np.ndarray]:
        """Per document the summed score, and the number of words whose longest n-gram was not met elsewhere."""
        n_docs, size = len(self.starts) - 1, np.diff(self.starts)
        others = np.maximum(total[np.searchsorted(self.keys, ALL)] - size, 1)[self.doc].astype(float)
        met = self.elsewhere(total, 0)
        missed = np.zeros(len(met), dtype=bool)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(met > 0, np.log(met / others), np.log(backoff / (others + 1)))
            for o in range(1, len(self.at)):
                at = self.at[o]
                before = np.zeros(len(self.doc), dtype=np.int64)
                before[self.at[o - 1]] = met
                met = self.elsewhere(total, o)
                known = met > 0
                score[at + o] = np.where(known, np.log(met / before[at]), score[at + o] + np.log(backoff))
                missed[at + o] = ~known
        return np.bincount(self.doc, weights=score, minlength=n_docs).astype(float), np.bincount(self.doc[missed], minlength=n_docs)


def _total(group, n, columns):
    return np.bincount(group, weights=columns[0], minlength=n).astype(np.int64)[group]


def _dealt(docs: DataFrame) -> tuple:
    """docs by chunk, and the number of chunks. Dealt by text too: rows of one doc_id may be many."""
    n = chunk_count(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return dealt_by(own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), "chunk", n, "task").groupBy("task", "chunk"), n


def _counted(dealt, n: int, order: int) -> DataFrame:
    wide = width(n)

    def count(table: pa.Table) -> pa.Table:
        c = Chunk(table, order)
        return send(table["chunk"][0].as_py(), wide, c.keys, c.counts.astype(np.uint32))

    return dealt.applyInArrow(count, SENT)


def count_table(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n): how often each n-gram of 1 to order words, named by its hash, occurs in the corpus; gram 0 stands for all words. Partitioned by gram."""
    ready(docs.sparkSession)
    dealt, n = _dealt(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["data"].to_pylist():
                keys, counts = unpack(data, ["u8", "u4"])
                yield pa.RecordBatch.from_arrays([pa.array(unsqueeze(keys.tobytes()).view(np.int64)), pa.array(counts.astype(np.int64))], names=["gram", "n"])

    return _counted(dealt, n, order).mapInArrow(rows, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def scores(docs: DataFrame, backoff: float = BACKOFF, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, score, mean_score and n_backed_off for each row of docs."""
    ready(docs.sparkSession)
    dealt, n = _dealt(docs)

    def judge(table: pa.Table, got: pa.Table) -> pa.Table:
        c = Chunk(table, order)
        score, missed = c.scores(answers(got, np.int64), backoff)
        n_words = np.diff(c.starts)
        del c
        tidy()
        return pa.Table.from_arrays([table["doc_id"], pa.array(n_words), pa.array(score), pa.array(missed)], names=["doc_id", "n_words", "score", "n_backed_off"])

    back = dealt_by(reduced(_counted(dealt, n, order), n, ["u8", "u4"], _total, "i8"), "chunk", n, "task")
    found = dealt.cogroup(back.groupBy("task", "chunk")).applyInArrow(judge, "doc_id long, n_words long, score double, n_backed_off long")
    return found.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_backed_off", F.round("score", 4).alias("score"))


def sql(order: int = ORDER, backoff: float = BACKOFF) -> str:
    """The query at any order in DuckDB's SQL."""
    orders = range(1, order + 1)
    gram = {o: " || ' ' || ".join(["w", *(f"v{k}" for k in range(1, o))][::-1]) for o in orders}
    head = {o: " || ' ' || ".join([f"v{k}" for k in range(1, o)][::-1]) or "''" for o in orders}
    parts = [
        "words AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM documents)",
        "placed AS (SELECT doc_id, i, w" + "".join(f", lag(w, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS v{k}" for k in range(1, order)) + " FROM words)",
        "sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id)",
    ]
    for o in orders:
        parts.append(f"g{o} AS (SELECT doc_id, i, {gram[o]} AS g, {head[o]} AS h FROM placed WHERE i >= {o})")
        parts.append(f"c{o} AS (SELECT doc_id, g, sum(count(*)) OVER (PARTITION BY g) - count(*) AS c FROM g{o} GROUP BY doc_id, g)")
    levels = [f"s1 AS (SELECT g.doc_id, g.i, CASE WHEN c.c > 0 THEN ln(c.c / greatest((SELECT count(*) FROM words) - z.n, 1)) ELSE ln({backoff} / (greatest((SELECT count(*) FROM words) - z.n, 1) + 1)) END AS s, 0 AS missed FROM g1 g JOIN c1 c USING (doc_id, g) JOIN sizes z USING (doc_id))"]
    for o in orders[1:]:
        levels.append(f"s{o} AS (SELECT s.doc_id, s.i, CASE WHEN c.c IS NULL THEN s.s WHEN c.c > 0 THEN ln(c.c / b.c) ELSE s.s + ln({backoff}) END AS s, CASE WHEN c.c IS NULL THEN s.missed WHEN c.c > 0 THEN 0 ELSE 1 END AS missed FROM s{o - 1} s LEFT JOIN g{o} g ON g.doc_id = s.doc_id AND g.i = s.i LEFT JOIN c{o} c ON c.doc_id = g.doc_id AND c.g = g.g LEFT JOIN c{o - 1} b ON b.doc_id = g.doc_id AND b.g = g.h)")
    return "WITH " + ",\n".join(parts + levels) + f"\nSELECT d.doc_id, CAST(count(s) AS BIGINT) AS n_words, CAST(coalesce(sum(missed), 0) AS BIGINT) AS n_backed_off, round(coalesce(sum(s), 0), 4) AS score FROM documents d LEFT JOIN s{order} USING (doc_id) GROUP BY d.doc_id"


OP10_SQL = sql()
