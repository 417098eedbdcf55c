import random
import re
from collections import Counter

from hushgrid.llm import decontam
from tests.llm.conftest import words

ITEMS = "item_id long, text string"


def brute(docs, items, window=13):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    patterns = {}
    for i, t in items:
        w = split(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[k : k + m]), set()).add(i)
    sizes = {len(p) for p in patterns}
    out = Counter()
    for d, t, *_ in docs:
        w, hit, found = split(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if own := patterns.get(tuple(w[k : k + m])):
                    found |= own
                    hit |= set(range(k, k + m))
        out[d, len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in df.collect())


def make(rng, rows):
    items = [(i, words(rng, rng.randrange(1, 40), 60)) for i in range(25)]
    items += [(50, None), (51, ""), (52, "..."), (53, items[0][1]), (54, "Same SAME same"), (55, " ".join((rows[5][1] or "").split()[:20]))]
    return items


def test_against_brute_force(spark, docs, rows, monkeypatch):
    rng = random.Random(5)
    items = make(rng, rows)
    extra = [(500 + i, f"{words(rng, 20)} {rng.choice(items)[1]} {words(rng, 3)}", "aa", "s", 1) for i in range(30)]
    table = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    bench = spark.createDataFrame(items, ITEMS)
    want = brute(rows + extra, items)
    assert got(decontam.report(table, bench)) == want
    monkeypatch.setattr(decontam, "WORDS_A_PASS", 50)
    assert len(list(decontam._blocks(bench))) > 3
    assert got(decontam.report(table, bench)) == want
    kept = decontam.clean(table, bench)
    assert kept.count() == sum(n for k, n in want.items() if not k[4]) and kept.columns == table.columns


def test_on_the_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.op9(spark, sf_dir).collect())
    assert found == Counter({(d, n, h, len(i), decontam.digest(i), c): x for (d, n, h, i, c), x in brute(docs, items).items()})


def test_empty_and_clashing(spark, docs, empty, clashing, rows):
    none = spark.createDataFrame([], ITEMS)
    assert got(decontam.report(docs, none)) == brute(rows, [])
    bench = spark.createDataFrame([(1, "a b c", "x")], ITEMS + ", spans string")
    assert decontam.report(empty, bench).count() == 0
    assert decontam.clean(clashing, bench).count() == len(rows)


def test_skips_are_safe_for_all_short_texts():
    rng = random.Random(9)
    for _ in range(300):
        items = [(i, [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(1, 7))]) for i in range(3)]
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(25))]
        spans, found = decontam.Searcher(items, 4).search(text)
        want = {i for i, p in items for m in [min(4, len(p))] for s in range(len(p) - m + 1) if any(text[k : k + m] == p[s : s + m] for k in range(len(text) - m + 1))}
        assert found == want and (not want) == (not spans)


def test_items_without_an_id_count(spark, rows):
    rng = random.Random(13)
    known, unnamed = words(rng, 20), words(rng, 20)
    table = spark.createDataFrame([(1, known, "aa", "s", 1), (2, unnamed, "aa", "s", 1), (3, f"{known} {unnamed}", "aa", "s", 1), (4, words(rng, 40), "aa", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(7, known), (None, unnamed), (None, None)], ITEMS)
    found = {r.doc_id: (r.n_hit, r["items"], r.n_items, r.contaminated) for r in decontam.report(table, bench).collect()}
    assert found == {1: (20, [7], 1, True), 2: (20, [], 0, True), 3: (40, [7], 1, True), 4: (0, [], 0, False)}
    assert [r.doc_id for r in decontam.clean(table, bench).collect()] == [4]
