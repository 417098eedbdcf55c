"""SimHash near-duplicates, found by the generalised pigeonhole principle.

Fingerprints within k bits are linked. The 64 bits are grouped into m parts, bits
that go together in one part. If part i is allowed t_i differing bits and the
t_i add up to k - m + 1, two fingerprints within k bits agree in some part but for at
most t_i bits. Dynamic programming picks the t_i (-1: the part is not probed)
and m with the fewest expected probes and candidates, from counts of equal part
values over all fingerprints. Each fingerprint is sent under its value of each
probed part, once for each choice of t_i bits left out; those that meet are verified.

Equal fingerprints are one node, whatever their number. Large groups of
fingerprints that meet are searched from one to the next: linked ones leave the
group at once, so that near copies, which nearly all link, cost a few passes; no
pair is left out and pairs are never listed. A very large group is first grouped again by k + 1 bands of the bits
in which it varies, one of which any linked pair has in common. What a task found is sent on as a forest.

Defined cases: a null or empty text has fingerprint 0 and links as any other; doc_ids are whole numbers, a null one is
never a component's name unless all its documents have none; repeated rows and ties
share a component; extra columns stay, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrid.llm.components import components
from hushgrid.llm.exchange import SENT, SENT_ARROW, bucket_of, by_bucket, dealt_by, unpack
from hushgrid.llm.runtime import cut, partitions, ready
from hushgrid.llm.words import BASE, LOWER_AZ, mix, tidy

BITS = 64
SEED = 42
#: Fingerprints that meet in larger groups are searched instead of compared pair by pair, and in groups over LARGE grouped once more.
SMALL, LARGE = 48, 2048
#: Keys that one bucket holds, about.
BUCKET = 400_000
#: Most parts tried.
PARTS = 4
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text as an unsigned integer."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    if not w:
        return 0
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    joined = b" ".join(w)
    sizes = np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: len(w) - shingle + 1].tolist()
    f = xxhash.xxh64_intdigest
    h = np.fromiter((f(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), dtype="<u8", count=len(starts))
    ones = sum(np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(h), BLOCK))
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def text_hash(text: Column) -> Column:
    """128 bits that stand for a text; a null one counts as empty."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def row_key(doc_id: Column, hashed: Column) -> Column:
    """What tells rows of different doc_id or text apart."""
    return F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.lit(":"), hashed)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint as a signed long."""
    ready(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.string()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(fps, pa.int64())], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", text_hash(F.col("text")))
    return own.mapInArrow(run, "doc_id long, text_hash string, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and in how many of them each two bits are both set (64 x 64, whatever the input)."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for batch in batches:
            b = _bits(batch["fp"].to_numpy(zero_copy_only=False)).astype(np.float32)
            total += np.rint(b.T @ b).astype(np.int64)
            n += len(b)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(j, -1).astype(np.int32)), pa.array(np.append(total[i, j], n))], schema=schema)

    out, n = np.zeros((BITS, BITS)), 0
    for i, j, c in fps.select("fp").mapInArrow(run, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c")).collect():
        if i < 0:
            n = c
        else:
            out[i, j] = out[j, i] = c
    return n, out


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each is grown by the bit that goes best with those in it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    together = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(together, 0)
    left, groups = set(range(BITS)), []
    for g in range(m):
        size = len(left) // (m - g)
        own = [max(sorted(left), key=lambda b: together[b, sorted(left)].sum())]
        left.discard(own[0])
        while len(own) < size:
            best = max(sorted(left), key=lambda b: together[b, own].mean())
            own.append(best)
            left.discard(best)
        groups.append(sorted(own))
    return groups


def thresholds(k: int, widths: list[int], cost: list[dict[int, float]]) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 that add up to k - m + 1, of least cost; by dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (c, chosen) in best.items():
            for t, more in own.items():
                if total + t not in step or c + more < step[total + t][0]:
                    step[total + t] = (c + more, [*chosen, t])
        best = step
    return best[k - len(widths) + 1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ways(n: int, both: np.ndarray, k: int, parts: int = PARTS) -> dict[int, list[list[int]]]:
    """The bits grouped into 2, 3, ... parts."""
    return {m: group_bits(n, both, m) for m in range(2 if k else 1, min(k + 1, parts) + 1)}


def choose(fps: DataFrame, k: int, parts: int = PARTS) -> list[tuple[int, list[int]]]:
    """(mask of the part, masks to probe) of each probed part."""
    n, both = bit_counts(fps)
    layouts = ways(n, both, k, parts)
    masks = {(m, i): sum(1 << b for b in bits) for m, groups in layouts.items() for i, bits in enumerate(groups)}
    pairs = {key: 0.0 for key in masks}
    keyed = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("v")) for (m, i), x in masks.items()]))
    counted = fps.select(keyed.alias("x")).groupBy("x.m", "x.i", "x.v").count().groupBy("m", "i").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"))
    for m, i, x in counted.collect():
        pairs[m, i] = x
    return cheapest(n, both, layouts, pairs, k)


def cheapest(n: int, both: np.ndarray, layouts: dict[int, list[list[int]]], pairs: dict[tuple[int, int], float], k: int, dear: float = 1.0) -> list[tuple[int, list[int]]]:
    """choose() from counts: of n fingerprints, in ``both`` those that have two bits, and in ``pairs`` the pairs that agree in part i of layout m. dear: the cost of a probe in compared pairs."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    found = None
    for m, groups in layouts.items():
        cost = []
        for i, bits in enumerate(groups):
            own, odds = {-1: 0.0}, [1.0]  # chance of 0, 1, ... differing bits, to that of none
            for b in bits:
                r = differ[b] / max(1 - differ[b], 1e-9)
                odds = [(odds[x] if x < len(odds) else 0) + (odds[x - 1] * r if x else 0) for x in range(min(len(odds) + 1, k + 2))]
            for t in range(min(k, len(bits)) + 1):
                probes = math.comb(len(bits), t)
                if probes > 5000:
                    break
                own[t] = dear * probes * n + (pairs[m, i] + n * n / 2 * 2.0 ** -len(bits)) * sum(odds[: t + 1])
            cost.append(own)
        try:
            total, ts = thresholds(k, [len(g) for g in groups], cost)
        except KeyError:
            continue
        if found is None or total < found[0]:
            found = (total, [(sum(1 << b for b in g), g, t) for g, t in zip(groups, ts, strict=True) if t >= 0])
    if found is None:
        raise ValueError(f"{max(layouts)} parts are too few for a distance of {k}: a part would need over 5000 probes")
    return [(whole, [whole & ~sum(1 << b for b in out) for out in itertools.combinations(g, t)]) for whole, g, t in found[1]]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with edges (a, b): the smallest node of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _search(fps: np.ndarray, node: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (of nodes) that connect what is within k bits in one group of different fingerprints."""
    if len(fps) > LARGE:
        varies = int(np.bitwise_or.reduce(fps) & ~np.bitwise_and.reduce(fps))
        bits = [b for b in range(BITS) if varies >> b & 1]
        shares = [(b, float((fps >> np.uint64(b) & np.uint64(1)).mean())) for b in bits]
        bits = [b for b, p in sorted(shares, key=lambda x: abs(x[1] - 0.5))]
        if len(bits) > 2 * (k + 1):
            a, b = [np.zeros(0, int)], [np.zeros(0, int)]
            for band in range(k + 1):
                own = fps & np.uint64(sum(1 << x for x in bits[band :: k + 1]))
                order = np.argsort(own, kind="stable")
                edges = np.flatnonzero(np.diff(own[order])) + 1
                for some in np.split(order, edges):
                    if 1 < len(some) < len(fps):
                        x, y = _search(fps[some], node[some], k) if len(some) < len(fps) // 2 else _outward(fps[some], node[some], k)
                        a.append(x)
                        b.append(y)
                    elif len(some) == len(fps):
                        return _outward(fps, node, k)
            return np.concatenate(a), np.concatenate(b)
    return _outward(fps, node, k)


def _outward(fps: np.ndarray, node: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """From one fingerprint to the next: those within k bits leave the group at once."""
    left, a, b = np.arange(len(fps)), [np.zeros(0, int)], [np.zeros(0, int)]
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= k
            if near.any():
                got, left = left[near], left[~near]
                a.append(np.full(len(got), node[x]))
                b.append(node[got])
                queue += got.tolist()
    return np.concatenate(a), np.concatenate(b)


def linked(keys: np.ndarray, fps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that share a key, verified: (fingerprint, smallest one it was linked with here) as a forest."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])))
    keys, fps = keys[fresh], fps[fresh]
    names, node = np.unique(fps, return_inverse=True)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    big = size > SMALL
    ends = np.repeat(first + size, size)
    at = np.flatnonzero(~np.repeat(big, size))
    a, b = [], []
    for d in range(1, SMALL):
        at = at[at + d < ends[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= k]
        a.append(node[near])
        b.append(node[near + d])
    for s, n in zip(first[big], size[big], strict=True):
        x, y = _search(fps[s : s + n], node[s : s + n], k)
        a.append(x)
        b.append(y)
    label = forest(len(names), np.concatenate(a or [np.zeros(0, int)]), np.concatenate(b or [np.zeros(0, int)]))
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def links(fps: DataFrame, k: int, parts: int = PARTS) -> DataFrame:
    """(a, b): edges whose components are those of all fingerprints (distinct, column fp) within k bits."""
    spark = ready(fps.sparkSession)
    probes = [mask for _, masks in choose(fps, k, parts) for mask in masks] if k else []
    n = max(4 * partitions(spark), len(probes) * fps.count() // BUCKET)
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(probes), 16):
                some = probes[at : at + 16]
                keys = np.concatenate([mix((own & np.uint64(mask)) + np.uint64((i + 1) * BASE % (1 << 64))) for i, mask in enumerate(some, at)])
                fps_ = np.tile(own, len(some))
                order = np.argsort(keys)
                keys, fps_ = keys[order], fps_[order]
                edges = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
                full = np.flatnonzero(np.diff(edges))
                data = [keys[edges[b] : edges[b + 1]].tobytes() + fps_[edges[b] : edges[b + 1]].tobytes() for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(full), dtype=np.int32)), pa.array(full.astype(np.int32)), pa.array(data, pa.binary())], schema=SENT_ARROW)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches):
            rows = [unpack(d, ["u8", "u8"]) for d in rows]
            x, y = linked(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), k)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], schema=edge)
        tidy()

    sent = dealt_by(fps.select("fp").mapInArrow(spread, SENT), "bucket", n, "task")
    return sent.sortWithinPartitions("bucket").select("chunk", "bucket", "data").mapInArrow(meet, "a long, b long")


def grouped(found: DataFrame, reps: DataFrame, edges: DataFrame) -> DataFrame:
    """found with component_id, the smallest doc_id of its component, and the text_hash that goes with it. reps (computed): fp and its first row; edges of fps."""
    roots = components(edges).select(F.col("node").alias("_n"), "root")
    named = cut(reps.join(roots, F.col("fp") == F.col("_n"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    lowest = named.groupBy("root").agg(F.min("first").alias("low"), F.count("*").alias("_c")).where("_c > 1").select(F.col("root").alias("_root"), "low")
    whole = named.join(lowest, F.col("root") == F.col("_root"), "left").select(F.col("fp").alias("_fp"), F.coalesce("low", "first").alias("low"))
    joined = found.join(whole, F.col("fp") == F.col("_fp"))
    return joined.select("doc_id", "text_hash", "fp", F.col("low.doc_id").alias("component_id"), F.col("low.text_hash").alias("kept_hash"))


def classes(found: DataFrame, k: int, parts: int = PARTS) -> DataFrame:
    """found (fingerprints(), computed) with component_id, the smallest doc_id of its component, and the text_hash that goes with it."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    reps = cut(found.groupBy("fp").agg(first.alias("first")))
    return grouped(found, reps, links(reps, k, parts))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, parts: int = PARTS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for each row of docs."""
    found = classes(cut(fingerprints(docs, shingle)), distance, parts)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that found (see grouped()) names as those of their components; of rows with one doc_id and text one stays."""
    ids = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("kept_hash"))).select(row_key(F.col("doc_id"), F.col("text_hash")).alias("id")).distinct()
    # one key of its own, so that repeated rows go without another shuffle of the texts
    keyed = docs.select(F.struct("*").alias("row"), row_key(F.col("doc_id"), text_hash(F.col("text"))).alias("key"))
    return keyed.join(ids, F.col("key") == F.col("id"), "left_semi").dropDuplicates(["key"]).select("row.*")


def keep_one(docs: DataFrame, shingle: int = 5, distance: int = 5, parts: int = PARTS) -> DataFrame:
    """One row of docs of each component, all columns kept: that of the smallest doc_id (then of the smallest hash of its text)."""
    return kept(docs, classes(cut(fingerprints(docs, shingle)), distance, parts))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
