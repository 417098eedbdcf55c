import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushgrid.llm import substring_dedup
from hushgrid.llm.words import windows


def brute(rows, window):
    last = float("inf")
    texts = [(last if d is None else d, (t or "").encode().split()) for d, t, *_ in rows]
    first = {}
    for d, w in texts:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(d, first.get(g, last))
    out = Counter()
    for (d, w), row in zip(texts, rows, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        out[row[0], len(w), sum(gone), sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect())


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_against_brute_force(docs, rows, window):
    assert got(substring_dedup.remove_repeats(docs, window)) == brute(rows, window)


def test_on_the_documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    found = Counter(tuple(r) for r in substring_dedup.op3(spark, sf_dir).collect())
    assert found == brute(rows, 13)


def test_few_words_many_repeats(spark):
    rng = random.Random(3)
    rows = [(i % 30, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substring_dedup.remove_repeats(df, 13)) == brute(rows, 13)


def test_few_tasks_for_many_chunks(docs, rows, monkeypatch):
    from hushgrid.llm import runtime

    monkeypatch.setattr(runtime, "MOST_TASKS", 2)
    assert got(substring_dedup.remove_repeats(docs, 13)) == brute(rows, 13)


def test_by_way_of_relays(spark, docs, rows, monkeypatch):
    """The result is the same where keys go by way of relays, for any number of chunks."""
    from hushgrid.llm import exchange

    want = {r.doc_id: r.words for r in substring_dedup.longest(docs).collect()}
    monkeypatch.setattr(exchange, "DIRECT", 1)
    for n in (2, 7, 23):
        monkeypatch.setattr(substring_dedup, "chunk_count", lambda df, n=n: n)
        assert got(substring_dedup.remove_repeats(docs, 13)) == brute(rows, 13)
    monkeypatch.setattr(substring_dedup, "chunk_count", lambda df: 5)
    assert {r.doc_id: r.words for r in substring_dedup.longest(docs).collect()} == want


def test_relays_make_few_rows():
    """At 100 TB (8 million chunks) a chunk sends to thousands of places, and a relay holds about as many keys as a chunk."""
    from hushgrid.llm import exchange

    n = 8_000_000
    wide = exchange.width(n)
    assert wide == 4000 and exchange.width(exchange.DIRECT) == 2 * exchange.DIRECT
    keys = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    fine = exchange.bucket_of(keys, wide * -(-2 * n // wide))
    assert (fine // -(-2 * n // wide) == exchange.bucket_of(keys, wide)).all()


def test_levels_double():
    assert [substring_dedup.levels(w) for w in (1, 4, 5, 13, 16, 26)] == [[1], [4], [4, 5], [4, 8, 13], [4, 8, 16], [4, 8, 16, 26]]


def test_longest_doubles_until_nothing_survives(spark, docs, rows, empty):
    def brute_longest(first):
        out, length = {}, first
        while True:
            seen = {}
            for d, t, *_ in rows:
                w = (t or "").split()
                for k in range(len(w) - length + 1):
                    seen.setdefault(tuple(w[k : k + length]), set()).add(d)
            now = {d for ids in seen.values() if len(ids) > 1 for d in ids}
            if not now:
                return out
            out |= dict.fromkeys(now, length)
            length *= 2

    for first in (3, 13):
        assert {r.doc_id: r.words for r in substring_dedup.longest(docs, first).collect()} == brute_longest(first)
    assert substring_dedup.longest(empty).count() == 0


def test_white_space_around_what_stays(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    rows = [(1, passage), (2, f"one\n two\t\n{passage}\n\nthree  four\n"), (3, f"{passage} x"), (4, f"x\n{passage}\n")]
    out = {r.doc_id: r.text for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), rejoin=False).collect()}
    assert out == {1: passage, 2: "one\n two\t\nthree  four\n", 3: "x", 4: "x\n"}


def test_empty_clashing_and_untouched(empty, clashing, rows):
    assert substring_dedup.remove_repeats(empty).count() == 0
    out = substring_dedup.remove_repeats(clashing)
    assert out.count() == len(rows) and out.columns.count("n_words") == 1 and out.where("score = 'x'").count() == len(rows)
    kept = {r.text for r in substring_dedup.remove_repeats(clashing, rejoin=False).where("n_removed = 0").collect()}
    assert {None, " \t\n", "same " * 50} <= kept


def test_window_hashes_do_not_depend_on_place():
    h = np.random.default_rng(0).integers(0, 2**63, 50, dtype=np.uint64)
    for k in (1, 2, 7, 13, 50):
        assert windows(h, k)[-1] == windows(h[-k:], k)[0] and len(windows(h, k)) == 51 - k
    assert len(windows(h[:3], 4)) == 0


def test_word_hashes_tell_words_apart(monkeypatch):
    """Equal words have equal hashes wherever they stand, others have others; words of texts that touch are parted."""
    import pyarrow as pa

    from hushgrid.llm import words as W

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n\té日") for _ in range(rng.randrange(60))) for _ in range(400)] + ["", " ", "a", "b" * 3000, "x " * 2000, "ab"]
    for hashed in (W.HASHED, 500):
        monkeypatch.setattr(W, "HASHED", hashed)
        for kind in (pa.string(), pa.large_string()):
            h, starts = W.word_hashes(pa.array(["zz", *texts], kind).slice(1))
            split = [t.encode().split() for t in texts]
            assert starts.tolist() == [0, *np.cumsum([len(w) for w in split]).tolist()]
            named = {}
            for w, x in zip([w for own in split for w in own], h.tolist(), strict=True):
                assert named.setdefault(w, x) == x
            assert len(set(named.values())) == len(named)
