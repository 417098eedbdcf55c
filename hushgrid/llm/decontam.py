"""Benchmark decontamination by Wu-Manber search over words.

Every 13 consecutive words of a benchmark item (all its words, if it has fewer)
are a pattern. Patterns of one length share a table of shifts: for the block of
words that ends at the place looked at, how far the search may skip, since no
pattern ends sooner. Where the shift is 0 the block selects a bucket of patterns,
and these are compared word by word.

Defined cases: a null or empty text has no words and is clean; an item without
words is no pattern; items that share a window are all reported; an item without an
id is searched for and its hits count, but it has no name to be listed or counted under; item ids are whole numbers; repeated rows
are reported each; ``report`` drops extra columns, ``clean`` keeps them, whatever their names. Texts are searched whole.

A benchmark of up to WORDS_A_PASS words is broadcast. A larger one is searched for block by block: one block is broadcast
at a time, and the texts with what was found so far are written to the shared folder between two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrid.llm.runtime import cut, ready
from hushgrid.llm.words import tidy

WINDOW = 13
#: Words in a block of the shift table.
BLOCK = 2
#: Words of benchmark items that are broadcast and searched for at once (about 200 bytes each with the tables).
WORDS_A_PASS = 1_000_000
#: Words are runs of 0-9, a-z and all beyond ASCII, after A-Z are lower-cased.
TABLE = bytes(b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


class Searcher:
    """Wu-Manber tables, one set for each length of pattern."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        patterns: dict[int, dict[tuple, set]] = {}
        for item, w in items:
            m = min(window, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                patterns.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(item)
        self.tables = []
        for m, found in sorted(patterns.items()):
            b = min(BLOCK, m)
            shift: dict = {}
            bucket: dict = {}
            for p in found:
                for end in range(b, m + 1):
                    block = p[end - b : end]
                    shift[block] = min(shift.get(block, m), m - end)
                bucket.setdefault(p[m - b :], []).append(p)
            self.tables.append((m, b, shift, bucket, found))

    def search(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of words that lie in an occurrence, and the items that occur."""
        places, items, n = [], set(), len(w)
        for m, b, shift, bucket, found in self.tables:
            far = m - b + 1
            end = m
            while end <= n:
                block = tuple(w[end - b : end])
                skip = shift.get(block, far)
                if skip:
                    end += skip
                    continue
                own = tuple(w[end - m : end])
                for p in bucket[block]:
                    if p == own:
                        places.append((end - m, end))
                        items |= found[p]
                        break
                end += 1
        return _merged(places), items


def _merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for s, e in sorted(places):
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
        else:
            spans.append((s, e))
    return spans


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items in blocks of a bounded number of words."""
    block, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator()
    for item, text in rows:
        w = words(text)
        if block and held + len(w) > WORDS_A_PASS:
            yield block
            block, held = [], 0
        block.append((item, w))
        held += len(w)
    if block:
        yield block


def found_in(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, found): each row of docs, and a struct of n_words, spans of hit words, and items found in its text; no shuffle."""
    spark = ready(docs.sparkSession)
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.int64()))])

    def searched(block: list) -> Callable:
        held = spark.sparkContext.broadcast(block)

        @F.arrow_udf("n_words long, spans array<struct<start:int,end:int>>, items array<long>")
        def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tidy()
            searcher = Searcher(held.value, window)
            for batch in batches:
                counts, spans, items = [], [], []
                for text in batch.to_pylist():
                    w = words(text)
                    s, found = searcher.search(w)
                    counts.append(len(w))
                    spans.append([{"start": a, "end": z} for a, z in s])
                    items.append(sorted(found - {None}))
                yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, kind[1].type), pa.array(items, kind[2].type)], fields=list(kind))

        return search

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def joined(one: pa.Array, two: pa.Array) -> pa.Array:
        both = [_merged([(x["start"], x["end"]) for x in a + b]) for a, b in zip(one.to_pylist(), two.to_pylist(), strict=True)]
        return pa.array([[{"start": a, "end": z} for a, z in spans] for spans in both], kind[1].type)

    own = docs.select(F.struct("*").alias("row"))
    text = F.col("row.text").cast("string")
    found = None
    for block in _blocks(benchmark):
        if found is None:
            found = own.withColumn("found", searched(block)(text))
            continue
        more = cut(found).withColumn("more", searched(block)(text))
        spans = joined(F.col("found.spans"), F.col("more.spans"))
        found = more.select("row", F.struct("found.n_words", spans.alias("spans"), F.array_sort(F.array_union("found.items", "more.items")).alias("items")).alias("found"))
    return own.withColumn("found", searched([])(text)) if found is None else found


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """found_in() with n_hit and the verdict in found: contaminated if at least a twentieth of the words is hit."""
    found = found_in(docs, benchmark, window)
    n_hit = F.expr("aggregate(found.spans, 0L, (a, s) -> a + (s.end - s.start))")
    found = found.withColumn("found", F.col("found").withField("n_hit", n_hit))
    return found.withColumn("found", F.col("found").withField("contaminated", (F.col("found.n_hit") > 0) & (20 * F.col("found.n_hit") >= F.col("found.n_words"))))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans, items, n_hit, contaminated and n_items for each row of docs."""
    return find(docs.select("doc_id", "text"), benchmark, window).select("row.doc_id", "found.*").withColumn("n_items", F.size("items").cast("long"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones; all columns stay."""
    return find(docs, benchmark, window).where("not found.contaminated").select("row.*")


def digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    joined = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(joined, 256).alias("items_sha256"), "contaminated")
