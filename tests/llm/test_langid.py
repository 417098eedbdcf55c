import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from hushgrid.llm import langid


@pytest.mark.parametrize("k", [2, 3, 4, 7, 8, 20])
def test_codewords_are_far_apart(k):
    code = langid.codewords(k)
    assert code.shape[0] == k and set(np.unique(code)) <= {-1.0, 1.0}
    apart = [int((code[i] != code[j]).sum()) for i in range(k) for j in range(i)]
    assert min(apart) >= (2 ** (k - 2) if k <= 7 else code.shape[1] // 5)
    assert all(abs(code[:, b].sum()) < k for b in range(code.shape[1]))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = langid.op2(spark, sf_dir).join(docs, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def brute_margins(text, code, log_odds):
    data = b" " + text.encode().translate(langid.LETTERS) + b"  "
    out = [0.0] * code.shape[1]
    for n, odds in log_odds.items():
        for i in range(len(data) - n + 1):
            for b, x in enumerate(odds[brute_place(data[i : i + n])]):
                out[b] += x
    return [x / max(len(data) / 4, len(data) ** 0.5) for x in out]


def brute_place(gram):
    return (int.from_bytes(gram, "little") * (0x9E3779B1 if len(gram) == 3 else 0x85EBCA6B) & 0xFFFFFFFF) >> 16


def test_against_a_plain_version(spark, sf_dir):
    """Counts, log odds, trust and loss-weighted decoding, one n-gram at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    rows = docs.collect()
    learned = [r for r in rows if not r.held_out and r.lang is not None and r.text is not None]
    langs = sorted({r.lang for r in learned})
    code = langid.codewords(len(langs))
    counts = {n: {x: Counter() for x in langs} for n in langid.ORDERS}
    for r in learned:
        data = b" " + r.text.encode().translate(langid.LETTERS) + b"  "
        for n in langid.ORDERS:
            counts[n][r.lang].update(data[i : i + n] for i in range(len(data) - n + 1))
    log_odds = {}
    for n, by_lang in counts.items():
        table = np.full((len(langs), langid.TABLE), langid.SMOOTH)
        for k, x in enumerate(langs):
            for g, c in by_lang[x].items():
                table[k, brute_place(g)] += c
        table /= table.sum(axis=1, keepdims=True)
        log_odds[n] = np.array([np.log(table[code[:, b] > 0].mean(axis=0)) - np.log(table[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])]).T
    model = langid.fit(docs.where("not held_out"))
    assert model.langs == langs
    for n, w in zip(langid.ORDERS, model.weights, strict=True):
        assert np.allclose(w.T, log_odds[n], atol=1e-4)
    own = model.margins([r.text for r in learned])
    right = (own * code[[langs.index(r.lang) for r in learned]] > 0).sum(axis=0)
    wrong = (len(learned) - right + 1) / (len(learned) + 2)
    assert np.allclose(model.trust, np.maximum(np.log((1 - wrong) / wrong), 0.1))
    some = [r for r in rows if r.text][:60]
    for r, (lang, score, ambiguous) in zip(some, model.predict([r.text for r in some]), strict=True):
        m = brute_margins(r.text, code, log_odds)
        loss = [sum(t * np.logaddexp(0, -x * c) for t, x, c in zip(model.trust, m, row, strict=True)) / sum(model.trust) for row in code]
        order = sorted(range(len(langs)), key=lambda k: (loss[k], k))
        assert lang in ("und", langs[order[0]]) and (lang == "und") == (not any(c.isalpha() for c in r.text))
        if lang != "und":
            assert abs(score - 1 / sum(np.exp(-(x - loss[order[0]]) * code.shape[1]) for x in loss)) < 1e-4
            assert ambiguous == (loss[order[1]] - loss[order[0]] < langid.NEAR * loss[order[1]])


def test_many_languages_are_all_learned(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 5, f"l{i % 230:03d}") for i in range(460)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 230 and model.code.shape[0] == 230


def test_edge_cases(spark, docs, empty, clashing):
    model = langid.fit(docs)
    assert model.langs == ["aa", "bb"]
    got = {(r.doc_id, r.text): r for r in langid.predict(clashing, model).collect()}
    for key in ((100, None), (101, ""), (102, " \t\n"), (103, "...!")):
        assert (got[key].lang_pred, got[key].score) == ("und", 0.0)
    assert got[104, "Ünïcode ß WORD wörd, it's 42%!"].lang_pred in ("aa", "bb")
    assert got[100, None].source is None and len(got) == docs.select("doc_id", "text").distinct().count()
    assert langid.predict(empty, model).count() == 0
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'aa'"))
    assert {r.lang_pred for r in langid.predict(docs, one).collect()} == {"und", "aa"}


def test_an_even_mixture_is_ambiguous():
    code = langid.codewords(4)
    model = langid.Model(["a", "b", "c", "d"], code, [np.zeros((7, langid.TABLE), dtype=np.float32) for _ in langid.ORDERS], np.ones(7))
    assert model.predict(["anything"])[0][2]


def test_the_sample_is_bounded(docs):
    assert langid.sample(docs, per_lang=3)[1].count() <= 6


@pytest.mark.parametrize("k", [20, 60])
def test_doubt_does_not_grow_with_the_number_of_languages(spark, k):
    """Clean texts of many languages stay; of two codewords only nearly equal ones are ambiguous."""
    rng = random.Random(k)
    syllables = [[rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "n", "s", "r"]) for _ in range(40)] for _ in range(k)]
    words = [["".join(rng.choice(own) for _ in range(rng.randrange(1, 4))) for _ in range(200)] for own in syllables]
    rows = [(i * 100 + j, " ".join(rng.choice(own) for _ in range(rng.randrange(20, 80))), f"l{i:02d}") for i, own in enumerate(words) for j in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert corpus_pipeline.identify(spark, docs, "").count() >= 0.98 * len(rows)
    zeros = langid.Model([str(i) for i in range(k)], langid.codewords(k), [np.zeros((langid.codewords(k).shape[1], langid.TABLE), dtype=np.float32) for _ in langid.ORDERS], np.ones(langid.codewords(k).shape[1]))
    assert zeros.predict(["anything"])[0][2]
