"""Best-fit packing by minimum bin slack.

Only the histogram of piece lengths (at most one entry a length up to the
capacity, however many documents there are) comes to the driver. There each
bin is planned: the longest length left opens it, a bitset subset-sum over the
lengths left finds the fullest feasible combination, and that combination is
taken as often as the counts allow. A plan is thus a short list of patterns.
Pieces find their place by their rank among the pieces of their length, which is
counted in salted groups of about GROUP pieces at most, so that a length that a third of all pieces share is
no task's burden.

Defined cases: a null or empty text makes one piece, of the end id alone; a null doc_id is kept;
doc_ids are whole numbers (others fail under ANSI mode); pieces of equal length are
interchangeable, so ties may fall either way; repeated rows are separate
pieces; a length of 0 or over the capacity is refused; extra columns of ``pack`` stay, whatever their names.
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushgrid.llm.runtime import cut, ready
from hushgrid.llm.tokens import encoder
from hushgrid.llm.words import as_strings

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are counted in one group, about: the number of groups grows with the pieces of that length.
GROUP = 2000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids (with end_id after them) into pieces of at most capacity. One row a piece; its ids too with with_ids."""
    ready(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_ids = batch["doc_id"].to_pylist()
            for first, ids, starts in code.batches(as_strings(batch["text"])):
                rows, kept = [], []
                for i, (s, e) in enumerate(zip(starts[:-1], starts[1:], strict=True), first):
                    own = np.append(ids[s:e], np.uint32(end_id)).astype("<u4")
                    for n, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        rows.append((doc_ids[i], n, at, len(part), binascii.crc32(part.tobytes())))
                        if with_ids:
                            kept.append(part.astype(np.int32))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=False)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def fullest(counts: list[int], lengths: list[int], room: int) -> list[int]:
    """The combination of lengths (descending; counts by length) that fills room most: a bitset holds the reachable sums."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for x in lengths:
        if x > room:
            continue
        copies, size = min(counts[x], room // x), 1
        while copies > 0:
            size = min(size, copies)
            steps.append((x, size, reach))
            reach |= (reach << (x * size)) & mask
            copies -= size
            size *= 2
            if reach >> room & 1:
                copies = 0
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, []
    for x, size, before in reversed(steps):
        if not before >> at & 1:
            taken += [x] * size
            at -= x * size
    return taken


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths in a bin, number of such bins), for all pieces of the histogram."""
    counts = [0] * (capacity + 1)
    for x, n in histogram.items():
        if not 0 < x <= capacity:
            raise ValueError(f"a piece of {x} does not fit a sequence of {capacity}")
        counts[x] = n
    left, bins = [x for x in range(capacity, 0, -1) if counts[x]], []
    while left:
        first = left[0]
        counts[first] -= 1
        taken = [first, *fullest(counts, left, capacity - first)]
        counts[first] += 1
        need: dict[int, int] = {}
        for x in taken:
            need[x] = need.get(x, 0) + 1
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
        if any(not counts[x] for x in need):
            left = [x for x in left if counts[x]]
        bins.append((taken, times))
    return bins


def slots(bins: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, pieces of this length a sequence, offset of the first) for each length of each pattern."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for taken, times in bins:
        offset = 0
        for x in dict.fromkeys(taken):
            n = taken.count(x)
            rank = used.get(x, 0)
            used[x] = rank + n * times
            out.append((x, rank, rank + n * times, sequence, n, offset))
            offset += n * x
        sequence += times
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (any columns, and length) with sequence_id and offset. parts is computed once, into the shared folder: rows keep their numbers there.

    Columns of parts called sequence_id or offset are replaced. Of the counts, those by length alone come to the driver: capacity rows at most.
    """
    spark = ready(parts.sparkSession)
    held = cut(parts.drop("sequence_id", "offset").select(F.struct("*").alias("row"), F.col("length").cast("int").alias("length")))
    histogram = {r[0]: r[1] for r in held.groupBy("length").count().collect()}
    groups = spark.createDataFrame([(x, -(-n // GROUP)) for x, n in histogram.items()] or [(0, 1)], "g int, groups long")
    salted = held.withColumn("nth", F.monotonically_increasing_id()).join(F.broadcast(groups), F.col("length") == F.col("g")).withColumn("salt", F.pmod("nth", "groups"))
    sums = cut(salted.groupBy("length", "salt").count())
    by_length: dict[int, list] = {}
    for x, *rest in slots(plan(histogram, capacity)):
        by_length.setdefault(x, []).append(tuple(rest))
    # bounded by the capacity, not by the input: fewer than 9 x capacity patterns
    places = spark.createDataFrame(list(by_length.items()) or [(0, [])], "x int, slots array<struct<a:long,z:long,sequence:long,n:long,offset:long>>")
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sums.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    own = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("nth")) - 1)
    ranked = own.join(ranks, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("own") + F.col("before"))
    found = ranked.join(F.broadcast(places), F.col("length") == F.col("x")).withColumn("slot", F.expr("filter(slots, y -> y.a <= rank and rank < y.z)[0]"))
    nth = F.col("rank") - F.col("slot.a")
    return found.select("row.*", (F.col("slot.sequence") + F.floor(nth / F.col("slot.n")).cast("long")).alias("sequence_id"), (F.col("slot.offset") + nth % F.col("slot.n") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, doc_ids and ids in order. packed holds ids (pieces(..., with_ids=True))."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("_r")).select("sequence_id", F.col("_r.doc_id").alias("doc_ids"), F.flatten(F.col("_r.ids")).alias("ids"))


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of docs with their place. Encoding is the dear part: pack() does it once and keeps its narrow result in the shared folder."""
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
