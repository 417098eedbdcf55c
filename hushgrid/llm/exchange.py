"""Aggregates of hashed keys over the whole corpus, carried in packed arrays.

Documents are dealt into chunks. A chunk sends each of its distinct 64-bit keys
once, to the bucket that owns the key; the bucket answers each chunk in the
order in which that chunk's keys came, so that an answer needs no key. A row of
the shuffle holds the packed keys of one chunk for one bucket. Tasks hold one
chunk or one bucket at a time, and there are as many of either as the input is large
(tasks: up to runtime.MOST_TASKS). A key that a third of all documents share is sent once a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgrid.llm.runtime import tasks
from hushgrid.llm.words import tidy

#: Chunks that send straight to the buckets, two for each chunk.
DIRECT = 4096
SENT = "chunk int, bucket int, data binary"
SENT_ARROW = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each key: ranges of keys, so that sorted keys give sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, all bytes of one rank side by side: the upper ones are zeros, which the shuffle's compression takes away."""
    apart = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return apart.view(np.uint8).reshape(-1, 8).T.tobytes()


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def send(chunk: int, n: int, keys: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Sorted distinct keys and what goes with each, cut up by bucket."""
    edges = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
    at = np.flatnonzero(np.diff(edges))
    data = [squeeze(keys[edges[b] : edges[b + 1]]) + b"".join(np.ascontiguousarray(c[edges[b] : edges[b + 1]]).tobytes() for c in columns) for b in at]
    return pa.Table.from_arrays([pa.array(np.full(len(at), chunk, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(data, pa.binary())], schema=SENT_ARROW)


def unpack(data: bytes, dtypes: list) -> list[np.ndarray]:
    n, out, at = len(data) // sum(np.dtype(d).itemsize for d in dtypes), [], 0
    for d in dtypes:
        out.append(np.frombuffer(data, dtype=d, count=n, offset=at))
        at += n * np.dtype(d).itemsize
    return out


def dealt_by(df: DataFrame, column: str, n: int, task: str) -> DataFrame:
    """df with each of the n values (0, 1, ...) of a column in one task, tasks evenly filled; task is the name of a column for its number."""
    k = tasks(n)
    return df.withColumn(task, F.pmod(F.col(column), F.lit(k)).cast("int")).repartitionById(k, F.col(task))


def width(n: int) -> int:
    """The number of buckets, or ranges of buckets, that each of n chunks sends to."""
    return 2 * n if n <= DIRECT else math.isqrt(2 * n - 1) + 1


def reduced(sent: DataFrame, n: int, dtypes: list, f: Callable, answer: str, checked: bool = False) -> DataFrame:
    """What the buckets answer to what n chunks made with send(chunk, width(n), ...): rows of the same form (chunk, bucket, data). answer: the dtype of what f gives."""
    wide = width(n)
    if wide == 2 * n:
        return _answered(sent, wide, dtypes, f, checked)
    blocks, buckets = -(-n // wide), wide * -(-2 * n // wide)
    number = (F.col("bucket") * blocks + F.floor(F.col("chunk") / wide)).cast("int")
    relays = dealt_by(sent.withColumn("relay", number), "relay", wide * blocks, "task").groupBy("task", "relay")

    def gather(table: pa.Table) -> pa.Table:
        columns, group, count, _ = merged(table["data"].to_pylist(), dtypes, checked)
        one = np.empty(count, dtype=np.int64)
        one[group] = np.arange(len(group))
        return send(table["relay"][0].as_py(), buckets, *(c[one] for c in columns[:-1]), f(group, count, columns[1:])[one])

    def give(table: pa.Table, got: pa.Table) -> pa.Table:
        _, group, _, cuts = merged(table["data"].to_pylist(), dtypes, checked)
        found = answers(got, answer)[group]
        data = [found[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.Table.from_arrays([table["chunk"], table["bucket"], pa.array(data, pa.binary())], schema=SENT_ARROW)

    back = _answered(relays.applyInArrow(gather, SENT), buckets, [*dtypes[:-1], answer], f, checked)
    back = dealt_by(back.withColumnRenamed("chunk", "relay"), "relay", wide * blocks, "task").groupBy("task", "relay")
    return relays.cogroup(back).applyInArrow(lambda table, got: give(table, got), SENT)


def _answered(sent: DataFrame, n: int, dtypes: list, f: Callable, checked: bool) -> DataFrame:
    return dealt_by(sent, "bucket", n, "task").sortWithinPartitions("bucket", "chunk").select("chunk", "bucket", "data").mapInArrow(reducer(dtypes, f, checked), SENT)


def merged(rows: list[bytes], dtypes: list, checked: bool) -> tuple[list[np.ndarray], np.ndarray, int, np.ndarray]:
    """The columns of all rows, the number of each entry's key among the distinct sorted ones, how many these are, and where each row's entries begin and end. checked: the second column is a part of the key."""
    parts = [unpack(d, dtypes) for d in rows]
    for p in parts:
        p[0] = unsqueeze(p[0].tobytes())
    cuts = np.cumsum([0, *(len(p[0]) for p in parts)])
    columns = [np.concatenate([p[i] for p in parts]) for i in range(len(dtypes))]
    keys = columns[0]
    order = np.lexsort((columns[1], keys)) if checked else np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    if checked:
        ordered = columns[1][order]
        new[1:] |= ordered[1:] != ordered[:-1]
    group = np.empty(len(keys), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return columns, group, int(new.sum()), cuts


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The data of one bucket after the other, of rows sorted by bucket."""
    at, held = None, []
    for batch in batches:
        for b, d in zip(batch["bucket"].to_pylist(), batch["data"].to_pylist(), strict=True):
            if b != at and held:
                yield at, held
                held = []
            at = b
            held.append(d)
    if held:
        yield at, held


def reducer(dtypes: list, f: Callable, checked: bool = False) -> Callable:
    """For mapInArrow on what send() made, dealt and sorted by bucket: one bucket is held at a time. f(number of each entry's key, number of keys, columns) gives one array, a value for each entry; relays take its values as the last column of merged entries."""

    def one(b: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        rows.sort(key=lambda x: x[0])
        columns, group, count, cuts = merged([d for _, d in rows], dtypes, checked)
        answer = f(group, count, columns[1:])
        data = [answer[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([b] * len(rows), pa.int32()), pa.array(data, pa.binary())], schema=SENT_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for c, b, d in zip(batch["chunk"].to_pylist(), batch["bucket"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if b != at and held:
                    yield one(at, held)
                    held = []
                at = b
                held.append((c, d))
        if held:
            yield one(at, held)
        tidy()

    return run


def answers(table: pa.Table, dtype) -> np.ndarray:
    """A chunk's answers, in the order of its sorted keys."""
    got = sorted(zip(table["bucket"].to_pylist(), table["data"].to_pylist(), strict=True))
    return np.concatenate([np.frombuffer(d, dtype=dtype) for _, d in got]) if got else np.zeros(0, dtype=dtype)
