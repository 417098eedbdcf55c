import re
from collections import Counter

import duckdb
import pytest

from hushgrid.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(wins)
    covered = {j for i, g in enumerate(wins) if count[g] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_against_brute_force(docs, rows):
    got = Counter((r.doc_id, *(r[s] for s in quality.STATS)) for r in quality.stats(docs).collect())
    assert got == Counter((r[0], *brute(r[1])) for r in rows)


@pytest.mark.parametrize("text", ["a b c d e f g h a b c d e f g h", "x " * 30, "a\nb\na\n\n \na", "# $$ a|b <c>", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 0 2 3 4 5 6 7 8 9", "a b 　 c"])
def test_small_texts(spark, text):
    r = quality.stats(spark.createDataFrame([(text,)], "text string")).collect()[0]
    assert tuple(r[s] for s in quality.STATS) == brute(text)


def test_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(quality.OP6_SQL).fetchall())
    assert sorted(tuple(r) for r in quality.op6(spark, sf_dir).collect()) == want


def test_labels_are_met(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.op6(spark, sf_dir).join(labels, "doc_id").toPandas()
    assert got[(got.quality == 1) & ~got.base_failed].kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.1


def test_no_python_in_the_plan(docs):
    plan = quality.stats(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edge_cases(empty, clashing, rows):
    assert quality.judge(empty).count() == 0
    got = quality.judge(clashing)
    assert got.count() == len(rows) and got.where("doc_id = 100 and kept").count() == 0


def test_estimation_finds_who_is_right():
    n = len(quality.RULES)
    good, bad = (1,) * n, (0,) * n
    share, right = quality.estimate([(good, 900), (bad, 60), ((0, *good[1:]), 40)])
    assert 0.9 < share < 0.96 and right[1][0] > 0.99 and right[0][0] < right[1][0]
    assert quality.posterior(good, share, right) > 0.99 > 0.01 > quality.posterior(bad, share, right)
