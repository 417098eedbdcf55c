import re
from collections import Counter

import corpus_pipeline
from hushgrid.llm import langid, queries
from hushgrid.llm.simhash import fingerprint
from tests.llm import test_decontam, test_neardup, test_packing


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[1] >= 0.98 * sizes[0] and sizes[1] > sizes[2] >= sizes[3] > sizes[4] > 0.85 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, sf_dir).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[key].values)) == sorted(map(tuple, packed[key].values))


def plain_cut(rows, window=13):
    """Each word of a window that starts in a document of smaller id goes, with the white space after it."""
    first = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(d, first.get(g, d))
    out = []
    for d, t in rows:
        pieces = re.findall(r"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)", t or "")
        w, gone = [p[0] for p in pieces], set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                gone |= set(range(k, k + window))
        lead = re.match(r"[\x20\x09-\x0D]*", t or "")[0]
        out.append((d, lead + "".join(a + b for i, (a, b) in enumerate(pieces) if i not in gone) if gone else t))
    return out


def test_against_a_plain_version(spark):
    """All stages, one after the other, by all pairs and all windows."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r, (lang, _, ambiguous) in zip(rows, model.predict([t for _, t in rows]), strict=True) if lang != langid.UND and not ambiguous]
    left = set(test_neardup.brute_kept(rows))
    rows = plain_cut([r for r in rows if r[0] in left])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {d for d, *_, contaminated in test_decontam.brute(rows, items) if contaminated}
    rows = [r for r in rows if r[0] not in bad]
    assert 0 < len(rows) < docs.count()
    found = corpus_pipeline.run(spark, sf_dir).collect()
    test_packing.check(found, rows, 4096)
    assert Counter(r.doc_id for r in found if r.piece == 0) == Counter(d for d, _ in rows)


def test_exact_copies_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    seen = [fingerprint(r.text, 5) for r in left]
    assert len(seen) == len(set(seen))


def test_odd_rows_pass(spark, docs, empty, sf_dir):
    for table in (docs, empty):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, sf_dir)
        assert table.count() >= 0


def test_columns_of_any_name_stay(spark, clashing, rows, sf_dir):
    """Every stage but the last keeps all columns, with their values, whatever the stage calls its own."""
    table = clashing.drop("text_hash")
    own = [c for c in table.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, sf_dir)
        assert out.columns == table.columns, name
        got = out.select(*own).distinct().collect()
        assert [tuple(r) for r in got] == [("x",) * len(own)], name
    assert corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).count() >= len(rows)


def test_one_query_an_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
