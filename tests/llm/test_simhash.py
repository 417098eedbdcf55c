import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from hushgrid.llm import simhash
from hushgrid.llm.components import components


def brute_fingerprint(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, k):
    names = [p[0] for p in pairs]
    label = list(range(len(pairs)))
    for i, j in itertools.combinations(range(len(pairs)), 2):
        if (pairs[i][1] ^ pairs[j][1]).bit_count() <= k:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    low = {}
    for x, n in zip(label, names, strict=True):
        low[x] = min(n if n is not None else 1 << 62, low.get(x, 1 << 62))
    return Counter((n, f"{p[1]:016x}", low[x] if low[x] < 1 << 62 else None) for x, n, p in zip(label, names, pairs, strict=True))


@pytest.mark.parametrize(("shingle", "k"), [(3, 2), (5, 5), (3, 0)])
def test_against_brute_force(docs, rows, shingle, k):
    pairs = [(r[0], brute_fingerprint(r[1], shingle)) for r in rows]
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, shingle, k).collect())
    assert got == brute_components(pairs, k)


def test_large_groups_are_searched_by_bands(monkeypatch):
    """Grouped by bands or not, the same fingerprints hang together: dense clusters, chains, and many that don't link."""
    rng = random.Random(4)
    for k in (1, 2, 5):
        fps = {rng.getrandbits(64) & ~0xFFFFF for _ in range(150)}
        for _ in range(4):
            centre = rng.getrandbits(64) & ~0xFFFFF
            fps |= {centre ^ sum(1 << b for b in rng.sample(range(20, 64), rng.randrange(1, 4))) for _ in range(80)}
        fps = np.array(sorted(fps), dtype=np.uint64)
        keys = np.zeros(len(fps), dtype=np.uint64)
        i, j = np.where(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= k)
        want = simhash.forest(len(fps), i, j)
        for large in (2048, 60, 5):
            monkeypatch.setattr(simhash, "LARGE", large)
            a, b = simhash.linked(keys, fps, k)
            got = simhash.forest(len(fps), np.searchsorted(fps, a), np.searchsorted(fps, b))
            assert np.array_equal(got, want)


def test_too_few_parts_are_said_so(spark):
    df = spark.createDataFrame([(i * 977,) for i in range(50)], "fp long")
    with pytest.raises(ValueError, match="parts"):
        simhash.choose(df, 30, 2)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_links_of_made_up_fingerprints(spark, k):
    """Clusters, chains and a dense group larger than the groups compared pair by pair."""
    rng = random.Random(k)
    fps = {rng.getrandbits(64) for _ in range(300)}
    centre = rng.getrandbits(64)
    for _ in range(400):
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    x = rng.getrandbits(64)
    for _ in range(40):
        x ^= sum(1 << b for b in rng.sample(range(64), k))
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long").repartition(3)
    a = np.array(fps, dtype=np.uint64)
    i, j = np.where(np.bitwise_count(a[:, None] ^ a[None, :]) <= k)
    want = simhash.forest(len(fps), i, j)
    roots = {r.node: r.root for r in components(simhash.links(df, k)).collect()}
    signed = [simhash._signed(f) for f in fps]
    groups = {}
    for f, label in zip(signed, want, strict=True):
        groups.setdefault(label, set()).add(f)
    got = {}
    for f in signed:
        got.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_thresholds_are_the_cheapest_that_suffice():
    rng = random.Random(0)
    for _ in range(100):
        m, k = rng.randrange(2, 5), rng.randrange(1, 6)
        cost = [{t: 0.0 if t < 0 else rng.random() for t in range(-1, k + 1)} for _ in range(m)]
        best = min(sum(c[t] for c, t in zip(cost, ts, strict=True)) for ts in itertools.product(range(-1, k + 1), repeat=m) if sum(ts) == k - m + 1)
        total, ts = simhash.thresholds(k, [1] * m, cost)
        assert abs(total - best) < 1e-9 and sum(ts) == k - m + 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(50))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(docs, clashing, empty, rows):
    kept = simhash.keep_one(docs).collect()
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept)
    assert sum(r.source == "hot" and r.doc_id < 300 for r in kept) == 0 and sum(r.doc_id == 5 for r in kept) == 1
    assert simhash.keep_one(clashing).count() == len(kept) and simhash.keep_one(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
