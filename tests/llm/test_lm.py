import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from hushgrid.llm import lm


def brute(rows, b=lm.BACKOFF, order=lm.ORDER):
    texts = [(t or "").encode().split() for _, t, *_ in rows]

    def grams(w):
        return Counter(tuple(w[i : i + o]) for o in range(1, order + 1) for i in range(len(w) - o + 1))

    all_ = sum((grams(w) for w in texts), Counter())
    total = sum(map(len, texts))
    out = Counter()
    for w, row in zip(texts, rows, strict=True):
        own, n, score, missed = grams(w), max(total - len(w), 1), 0.0, 0
        met = lambda g, own=own: all_[g] - own[g]
        for i in range(len(w)):
            longest = min(order, i + 1)
            for o in range(longest, 0, -1):
                g = tuple(w[i - o + 1 : i + 1])
                if o == 1:
                    score += math.log(met(g) / n) if met(g) else math.log(b / (n + 1))
                elif met(g):
                    score += math.log(met(g) / met(g[:-1]))
                    break
                else:
                    score += math.log(b)
                    missed += o == longest
        out[row[0], len(w), missed, round(score, 5)] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_backed_off, round(r.score, 5)) for r in df.collect())


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute_force(docs, rows, order):
    assert got(lm.scores(docs, order=order)) == brute(rows, order=order)


@pytest.mark.parametrize("order", [2, 3])
def test_against_sql(spark, sf_dir, order):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(f"select doc_id, n_words, n_backed_off, score from ({lm.sql(order)})").fetchall())
    found = lm.scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=order)
    assert sorted(tuple(r) for r in found.select("doc_id", "n_words", "n_backed_off", F.round("score", 4)).collect()) == want
    assert lm.sql() == lm.OP10_SQL and "op10" in lm.op10.__name__


def test_by_way_of_relays(docs, rows, monkeypatch):
    from hushgrid.llm import exchange

    monkeypatch.setattr(exchange, "DIRECT", 1)
    for n in (1, 2, 7, 4096):
        monkeypatch.setattr(lm, "chunk_count", lambda df, n=n: n)
        assert exchange.width(n) < 2 * n or n == 1
        if n < 10:
            assert got(lm.scores(docs, order=3)) == brute(rows, order=3)


def test_count_table(docs, rows):
    want = Counter()
    for _, t, *_ in rows:
        w = (t or "").split()
        want.update(tuple(w[i : i + o]) for o in (1, 2, 3) for i in range(len(w) - o + 1))
    table = lm.count_table(docs, 3).collect()
    assert sorted(r.n for r in table if r.gram) == sorted(want.values()) and [r.n for r in table if not r.gram] == [sum(n for g, n in want.items() if len(g) == 1)]


def test_edge_cases(spark, empty, clashing, rows):
    assert lm.scores(empty).count() == 0
    assert got(lm.scores(clashing)) == brute(rows)
    one = lm.scores(spark.createDataFrame([(1, "a b a")], "doc_id long, text string")).collect()[0]
    assert one.n_words == 3 and one.n_backed_off == 2 and one.score < 0
    none = lm.scores(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0]
    assert (none.n_words, none.score, none.mean_score) == (0, 0.0, None)
