import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
from hushgrid.llm import neardup, simhash
from tests.llm.conftest import DOCS


def brute_set(text, k=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_kept(rows, least=0.8):
    """Smallest doc_id of each component by all pairs of exact similarities."""
    sets = [brute_set(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or len(a & b) / len(a | b) >= least:
            x, y = label[i], label[j]
            label = [x if z == y else z for z in label]
    groups = {}
    for r, x in zip(rows, label, strict=True):
        groups.setdefault(x, []).append(r[0])
    return sorted(min(g) for g in groups.values())


def planted():
    """Texts of 60 to 1000 words with copies in which 0 to 8 % of the words are others."""
    rng = random.Random(11)
    out = []
    for _ in range(60):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([60, 104, 250, 1000]))]
        for share in (0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.08):
            copy = [f"x{rng.randrange(3000)}" if rng.random() < share else w for w in base]
            out.append((len(out), " ".join(copy), "aa", "s", 1))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("heap", [neardup.HEAP, 300])
def test_planted_edits_against_brute_force(spark, heap):
    rows = planted()
    table = spark.createDataFrame(rows, DOCS).repartition(3)
    want = brute_kept(rows)
    assert 60 < len(want) < 240
    if heap == neardup.HEAP:
        assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, table, "").collect()) == want
    assert sorted(r.doc_id for r in neardup.keep_one(table, heap=heap).collect()) == want


def test_odd_rows_against_brute_force(docs, rows, clashing, empty):
    own = [r for r in rows if r[0] is not None]
    kept = neardup.keep_one(docs.where("doc_id is not null")).collect()
    assert sorted(r.doc_id for r in kept) == brute_kept(own)
    assert neardup.keep_one(clashing).count() == neardup.keep_one(docs).count() and neardup.keep_one(empty).count() == 0


def test_large_groups_that_meet(monkeypatch):
    """The search of large groups links what comparing all pairs links."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(200) > 0.05], rng.integers(0, 1 << 63, 8, dtype=np.uint64)])) for _ in range(150)]
    sets += [np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64)) for _ in range(20)]
    made = [neardup.sketch(s) for s in sets]
    keys = np.concatenate([k for k, _ in made])
    nodes, marks = np.repeat(np.arange(len(sets), dtype=np.uint64), neardup.BANDS), np.repeat(np.array([m for _, m in made]), neardup.BANDS, axis=0)
    got = sorted(zip(*(x.tolist() for x in neardup.met(keys, nodes, marks)), strict=True))
    monkeypatch.setattr(neardup, "SMALL", 1000)
    assert got == sorted(zip(*(x.tolist() for x in neardup.met(keys, nodes, marks)), strict=True)) and len(got) >= 140
    label = neardup.alike(sets, 0.8)
    want = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        c = len(np.intersect1d(sets[i], sets[j]))
        if c / (len(sets[i]) + len(sets[j]) - c) >= 0.8 and want[i] != want[j]:
            want = [min(want[i], want[j]) if z in (want[i], want[j]) else z for z in want]
    assert label.tolist() == want


def some_set(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))


def test_stage_goes_by_the_pigeonhole_of_fingerprints(spark, monkeypatch):
    """The stage groups bits, finds thresholds by dynamic programming and probes every fingerprint of every node."""
    seen = {"group_bits": 0, "thresholds": 0, "probes": []}
    for name in ("group_bits", "thresholds"):
        monkeypatch.setattr(simhash, name, lambda *a, f=getattr(simhash, name), name=name: (seen.update({name: seen[name] + 1}), f(*a))[1])
    choose = neardup.choose
    monkeypatch.setattr(neardup, "choose", lambda *a: (seen["probes"].extend(choose(*a)), seen["probes"])[1])
    rows = planted()[:100]
    table = spark.createDataFrame(rows, DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, table, "").collect()) == brute_kept(rows)
    assert seen["group_bits"] >= neardup.WORDS and seen["thresholds"] >= neardup.WORDS
    assert {w for w, _ in seen["probes"]} == set(range(neardup.WORDS))


def test_fingerprints_against_a_plain_version():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 127, 128, 300):
        own = some_set(rng, n)
        h = np.concatenate((own, neardup.mix(own)))
        for w, got in enumerate(neardup.fingerprints(own).tolist()):
            x = (h ^ neardup._FLIP[w]) * neardup._TIMES[w]
            x = (x ^ x >> np.uint64(32)) * np.uint64(neardup.BASE)
            x = (x ^ x >> np.uint64(29)).tolist()
            assert got == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in x) > len(x))


@pytest.mark.parametrize("n", [500, 200_000_000])
def test_near_fingerprints_share_a_key(n):
    """Whatever the thresholds: two nodes within NEAR bits in one fingerprint meet, though all others differ."""
    rng = np.random.default_rng(n)
    words = rng.integers(0, 1 << 63, (500, neardup.WORDS), dtype=np.uint64)
    words[:, 0] |= words[:, 0] << np.uint64(1)  # bits that go together
    probes = neardup.choose(words, n)
    other = rng.integers(0, 1 << 63, words.shape, dtype=np.uint64)
    for i in range(len(words)):
        flips = rng.permutation(64)[: rng.integers(0, neardup.NEAR + 1)].tolist()
        w = i % neardup.WORDS
        other[i, w] = words[i, w] ^ np.uint64(sum(1 << b for b in flips))
    assert (neardup.keys_of(words, probes) == neardup.keys_of(other, probes)).any(axis=0).all()


@pytest.mark.parametrize("n", [5, 10, 40, 300])
def test_similar_sets_become_candidates(n):
    """At a similarity of 0.8, the least that links, sets of any size."""
    rng, found = np.random.default_rng(n), 0
    for _ in range(400):
        own = some_set(rng, n)
        (a, x), (b, y) = neardup.sketch(own), neardup.sketch(own[rng.permutation(len(own))[: -(-4 * n // 5)]])
        found += bool((a == b).any()) and neardup._far(x, y) <= neardup.DIFFER
    assert found >= 398


def test_a_large_group_sends_few_links(spark):
    """Near copies that the first fingerprints link go by few names in the others."""
    rng = np.random.default_rng(9)
    base = some_set(rng, 300)
    sets = [np.unique(np.concatenate((base[rng.random(300) > 0.03], some_set(rng, 9)))) for _ in range(300)]
    rows = [(i, neardup.fingerprints(s).tobytes()) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "fp long, data binary").repartition(3)
    edges = neardup.candidates(table).collect()
    assert len(edges) < 16 * len(sets)
    at = np.array([[e.a, e.b] for e in edges])
    assert (simhash.forest(len(sets), at[:, 0], at[:, 1]) == 0).all()
