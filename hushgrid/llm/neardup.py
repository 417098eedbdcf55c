"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least 0.8.

SimHash proposes, by simhash's generalised pigeonhole, and the sets decide. Each distinct set of shingles is one node,
however many documents have it. A node has WORDS fingerprints of 64 bits, each of hashes of its own: a bit is 1 if
over half of what the set's shingles hash to has it. A shingle has two hashes in each, so that few shingles vote in
finer steps. Each fingerprint's bits are grouped, those that go together in one part, and the parts' thresholds for a
distance of NEAR bits are found by dynamic programming, from counts over a sample of about SAMPLE nodes (they steer
cost; two nodes within NEAR bits in any fingerprint meet, whatever they are). All nodes are probed; those that agree in
some part but for its threshold are candidates if the first MARK bits of all they have differ in at most DIFFER
places. A bit differs for two sets of similarity 0.8 with a chance of 0.15, so with parts of 16 bits they become
candidates with a chance of over 0.999, more similar ones sooner. The first FIRST fingerprints are probed before the
others, and a node goes by the lowest name that it was linked with from then on, so that a large group doesn't send its
links again and again. Candidates that hang together are a heap; the shingles of a heap's nodes are brought together and each
link is made by the exact similarity, hashes of 64 bits standing for shingles. A heap of more shingles than HEAP is
dealt into pieces, and any two pieces meet in a task of their own, so that no task holds more than two pieces and no
pair of a heap is left out.

Defined cases: null texts and those without words are copies of each other; a text of fewer words
than a shingle is one shingle; case is that of A-Z; the rest is as in simhash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushgrid.llm import simhash
from hushgrid.llm.components import components
from hushgrid.llm.exchange import SENT, SENT_ARROW, by_bucket, dealt_by, unpack
from hushgrid.llm.runtime import cut, partitions, ready
from hushgrid.llm.simhash import BITS, BUCKET, PARTS, forest, grouped, kept, row_key, text_hash
from hushgrid.llm.words import BASE, as_strings, lowered, mix, slices, tidy, windows, word_hashes

#: Fingerprints of a node, and the distance for which each is probed.
WORDS, NEAR = 32, 3
#: Keys of a node where each fingerprint is probed by four equal parts.
BANDS = WORDS * (NEAR + 1)
#: Of the first MARK bits so many may differ: at a similarity of 0.8 they differ in 24 on average, with a deviation of 4.5, unrelated ones in 80 with 6.3.
MARK, DIFFER = 160, 43
#: Fingerprints that are probed before the others.
FIRST = 4
#: Nodes whose bits are counted to group them, about.
SAMPLE = 8_000
#: What a key that is sent costs, in pairs that are compared.
DEAR = 64
#: Nodes that meet in larger groups are searched instead of compared pair by pair.
SMALL = 512
#: Shingles of a heap that a task holds at once, about.
HEAP = 2_000_000
#: Shingles whose bits are counted at once: as many as a byte can count.
BLOCK = 255
_RNG = np.random.default_rng(42)
_FLIP, _TIMES = _RNG.integers(0, 1 << 64, (2, WORDS), dtype=np.uint64)
_TIMES = _TIMES | np.uint64(1)
_LOWEST = np.uint64(0x0101010101010101)
#: (number of the fingerprint, mask) of four equal parts.
EVEN = [(w, 0xFFFF << 16 * i) for w in range(WORDS) for i in range(NEAR + 1)]


def shingle_sets(texts: pa.Array, shingle: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, as hashes."""
    texts = as_strings(texts)
    for s, e in slices(texts):
        words, starts = word_hashes(lowered(texts.slice(s, e - s)))
        whole = windows(words, shingle)
        for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            n = z - a
            yield np.unique(whole[a : z - shingle + 1] if n >= shingle else windows(words[a:z], n) if n else words[:0])
    tidy()


def fingerprints(own: np.ndarray) -> np.ndarray:
    """A set's fingerprints: a bit is 1 if over half the shingles' hashes have it, two hashes a shingle."""
    own = np.concatenate((own, mix(own)))
    ones = np.zeros((WORDS, BITS), dtype=np.int64)
    for at in range(0, len(own), BLOCK):
        h = (own[at : at + BLOCK, None] ^ _FLIP) * _TIMES
        h ^= h >> np.uint64(32)
        h *= np.uint64(BASE)
        h ^= h >> np.uint64(29)
        for bit in range(8):  # each byte of a sum counts one bit
            ones[:, bit::8] += ((h >> np.uint64(bit)) & _LOWEST).sum(axis=0).astype("<u8").view(np.uint8).reshape(WORDS, 8)
    return np.packbits(2 * ones > len(own), axis=1, bitorder="little").view("<u8").ravel()


def keys_of(words: np.ndarray, probes: list[tuple[int, int]], at: int = 0) -> np.ndarray:
    """The keys of nodes (rows of fingerprints) by probes of which the first is number ``at``: a row a probe, 32 bits a key."""
    return np.stack([(mix((words[:, w] & np.uint64(mask)) + np.uint64((i + 1) * BASE % (1 << 64))) >> np.uint64(32)).astype(np.uint32) for i, (w, mask) in enumerate(probes, at)])


def marks_of(words: np.ndarray) -> np.ndarray:
    """The first MARK bits of each node, in words."""
    out = words[..., : -(-MARK // BITS)].copy()
    out[..., -1] &= np.uint64((1 << (MARK - 1) % BITS + 1) - 1)
    return out


def sketch(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's keys by four equal parts of each fingerprint, and its marks."""
    words = fingerprints(own)
    return keys_of(words[None], EVEN)[:, 0], marks_of(words)


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, a hash of the text, its node (fp), the number of its shingles and its fingerprints."""
    ready(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.string()), ("fp", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, data = [], [], []
            for own in shingle_sets(batch["text"], shingle):
                fps.append(int(mix(mix(own).sum(dtype=np.uint64, keepdims=True))[0]) if len(own) else 0)
                sizes.append(len(own))
                data.append(fingerprints(own).tobytes() if len(own) else b"")
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", text_hash(F.col("text")))
    return own.mapInArrow(run, "doc_id long, text_hash string, fp long, n long, data binary")


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places the marks (a row each) differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def met(keys: np.ndarray, nodes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that share a key and are near by their marks: (node, smallest one it hangs together with here) as a forest."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    keys, nodes, marks = keys[order], nodes[order], marks[order]
    names, node = np.unique(nodes, return_inverse=True)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    size = np.diff(np.append(first, len(keys)))
    big = size > SMALL
    ends = np.repeat(first + size, size)
    at = np.flatnonzero(~np.repeat(big, size))
    a, b = [np.zeros(0, int)], [np.zeros(0, int)]
    for d in range(1, SMALL):
        at = at[at + d < ends[at]]
        if not len(at):
            break
        near = at[_far(marks[at], marks[at + d]) <= DIFFER]
        a.append(node[near])
        b.append(node[near + d])
    for s, n in zip(first[big], size[big], strict=True):
        left = np.arange(s, s + n)
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = _far(marks[left], marks[x]) <= DIFFER
                got, left = left[near], left[~near]
                a.append(np.full(len(got), node[x]))
                b.append(node[got])
                queue += got.tolist()
    label = forest(len(names), np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def choose(words: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(number of the fingerprint, mask to probe): all probes of n nodes, of which words (a row each) are a sample."""
    out = []
    for w in range(words.shape[1]):
        own = np.ascontiguousarray(words[:, w])
        bits = simhash._bits(own).astype(np.float32)
        scale = n / max(len(own), 1)
        both = (bits.T @ bits).astype(np.float64) * scale
        layouts, pairs = simhash.ways(n, both, NEAR, PARTS), {}
        for m, groups in layouts.items():
            for i, group in enumerate(groups):
                count = np.unique(own & np.uint64(sum(1 << b for b in group)), return_counts=True)[1].astype(np.float64)
                pairs[m, i] = float((count * (count - 1) / 2).sum()) * scale * scale
        out += [(w, mask) for _, masks in simhash.cheapest(n, both, layouts, pairs, NEAR, DEAR) for mask in masks]
    return out


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): edges whose components are the heaps of candidates. nodes: fp, data."""
    total = nodes.count()
    some = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, total // SAMPLE))) == 0).select("data").collect()
    probes = choose(np.frombuffer(b"".join(bytes(r.data) for r in some), dtype="<u8").reshape(-1, WORDS), total)
    early, late = [p for p in probes if p[0] < FIRST], [p for p in probes if p[0] >= FIRST]
    found = cut(meetings(nodes, early, total))
    lower = found.groupBy("a").agg(F.min("b").alias("low"))
    named = nodes.join(lower, F.col("fp") == F.col("a"), "left").select(F.coalesce("low", "fp").alias("fp"), "data")
    return found.unionByName(meetings(named, late, total))


def meetings(nodes: DataFrame, probes: list[tuple[int, int]], total: int) -> DataFrame:
    """(a, b): edges that connect the names (fp) of those of the total nodes that agree in a probe and are near by their marks."""
    spark = ready(nodes.sparkSession)
    n = max(2 * partitions(spark), len(probes) * total // BUCKET)
    kinds = ["u4", "u8", "u8", "u8", "u4"]
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.frombuffer(b"".join(batch["data"].to_pylist()), dtype="<u8").reshape(-1, WORDS)
            fps, marks = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64), marks_of(words)
            for at in range(0, len(probes), BANDS):
                keys = keys_of(words, probes[at : at + BANDS], at)
                order = np.argsort(keys, axis=None)
                keys, node = keys.ravel()[order], order % len(words)
                edges = np.searchsorted(keys.astype(np.uint64) * np.uint64(n) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(edges))
                columns = [c.astype(t, copy=False) for c, t in zip((keys, fps[node], *marks[node].T), kinds, strict=True)]
                data = [b"".join(c[edges[b] : edges[b + 1]].tobytes() for c in columns) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(full), dtype=np.int32)), pa.array(full.astype(np.int32)), pa.array(data, pa.binary())], schema=SENT_ARROW)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches):
            keys, own, *marks = (np.concatenate(c) for c in zip(*(unpack(d, kinds) for d in rows), strict=True))
            x, y = met(keys, own, np.stack([m.astype(np.uint64) for m in marks], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], schema=edge)
        tidy()

    sent = dealt_by(nodes.select("fp", "data").mapInArrow(spread, SENT), "bucket", n, "task")
    return sent.sortWithinPartitions("bucket").select("chunk", "bucket", "data").mapInArrow(meet, "a long, b long")


def alike(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For each set (none empty) the smallest number of one that it is linked with, through others or at once, by a similarity of at least ``least``."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    own = [ids[e - n : e] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    mark = np.zeros(int(ids.max()) + 1, dtype=bool)
    alive = np.ones(len(sets), dtype=bool)
    label = np.arange(len(sets))
    for seed in range(len(sets)):
        if not alive[seed]:
            continue
        alive[seed], queue, group = False, [seed], [seed]
        while queue:
            x = queue.pop()
            lo, hi = np.searchsorted(sizes, [int(sizes[x] * least), int(sizes[x] / least) + 2])
            left = lo + np.flatnonzero(alive[lo:hi])
            if not len(left):
                continue
            mark[own[x]] = True
            n = sizes[left]
            common = np.add.reduceat(mark[np.concatenate([own[i] for i in left.tolist()])], np.cumsum(n) - n, dtype=np.int64)
            mark[own[x]] = False
            got = left[common / (sizes[x] + n - common) >= least]
            alive[got] = False
            queue += got.tolist()
            group += got.tolist()
        label[order[group]] = order[group].min()
    return label


def links(docs: DataFrame, nodes: DataFrame, shingle: int, least: float, heap: int = HEAP) -> DataFrame:
    """(a, b): edges whose components are those of all nodes (fp, first, n, data) of a similarity of at least ``least``."""
    roots = components(candidates(nodes.where("n > 0"))).select(F.col("node").alias("_n"), F.col("root").alias("heap"))
    heaped = cut(nodes.join(roots, F.col("fp") == F.col("_n")).select("fp", "heap", "n", row_key(F.col("first.doc_id"), F.col("first.text_hash")).alias("_rep")))
    pieces = heaped.groupBy(F.col("heap").alias("_heap")).agg(F.ceil(F.sum("n") / heap).cast("int").alias("pieces"))
    placed = heaped.join(pieces, F.col("heap") == F.col("_heap")).withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    keyed = docs.select(F.col("text").cast("string").alias("text"), row_key(F.col("doc_id"), text_hash(F.col("text"))).alias("_row"))
    texts = keyed.join(placed, F.col("_row") == F.col("_rep")).select("fp", "heap", "piece", "pieces", "text")
    found = pa.schema([("fp", pa.int64()), ("heap", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("data", pa.binary())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [s.tobytes() for s in shingle_sets(batch["text"], shingle)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("fp", "heap", "piece", "pieces")), pa.array(data, pa.binary())], schema=found)

    def verify(table: pa.Table) -> pa.Table:
        rows = dict(zip(table["fp"].to_pylist(), table["data"].to_pylist(), strict=True))  # repeated rows come once
        names = np.array(sorted(rows), dtype=np.int64)
        label = alike([np.frombuffer(rows[x], dtype=np.uint64) for x in names.tolist()], least)
        moved = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"a": names[moved], "b": names[label[moved]]})

    other = F.explode(F.when(F.col("pieces") < 2, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("pieces") - 1), F.array("piece"))))
    sent = texts.mapInArrow(hashed, "fp long, heap long, piece int, pieces int, data binary").withColumn("other", other)
    return sent.groupBy("heap", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j")).applyInArrow(lambda t: verify(t), "a long, b long")


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, heap: int = HEAP) -> DataFrame:
    """One row of docs of each component, all columns kept: that of the smallest doc_id (then of the smallest hash of its text)."""
    found = cut(sketches(docs, shingle))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n", "data"))
    nodes = cut(found.groupBy("fp").agg(best.alias("x")).select("fp", F.struct("x.none", "x.doc_id", "x.text_hash").alias("first"), "x.n", "x.data"))
    return kept(docs, grouped(found, nodes.select("fp", "first"), links(docs, nodes, shingle, least, heap)))
