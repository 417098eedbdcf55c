"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit a binary classifier over
hashed byte 3- and 4-grams (log odds of naive Bayes, all languages of a side with equal
weight) says how strongly a text speaks for +1. Decoding adds up, for each language, the
logistic losses of the bits against its codeword, each weighted by how well the bit's
classifier did on the sample; the least loss names the language. A text is flagged ambiguous if
the two best codewords are nearly as near.

The model is fitted on a bounded sample: at most ``per_lang`` labelled texts of each
language. It holds a table for each bit of the codewords, about 10 log2 of the number of languages, and is broadcast.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and not ambiguous;
without labelled texts all are ``und``; with one language all others are it, with score 1; ties go
to the first language in order; repeated rows are predicted each; columns called
lang_pred, score or ambiguous are replaced, others stay, whatever their names. A null doc_id counts as
held out in the query: its label is never learned from.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushgrid.llm.runtime import ready
from hushgrid.llm.words import as_strings, slices, tidy

#: Labelled texts of each language in the sample, at most.
PER_LANG = 2000
#: Bytes of text looked at at once: what is held for each byte is many times as large.
SLICE = 1 << 19
#: Entries of the table of each order of n-grams.
TABLE = 1 << 16
ORDERS = (3, 4)
#: Added to the count of each n-gram.
SMOOTH = 0.05
#: Two codewords whose losses differ by less than this share of the larger one are as near as each other, however many languages there are.
NEAR = 0.2
UND = "und"
#: A-Z lower-cased, other ASCII but a-z a space.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
ASCII_LETTER = re.compile(r"[A-Za-z]")


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1, far from each other: all splits of the languages for few, chosen from random ones for many."""
    if k < 2:
        return np.ones((k, 0))
    if k <= 7:
        return np.array([(1.0, *(1.0 if x >> i & 1 else -1.0 for i in range(k - 1))) for x in range(2 ** (k - 1) - 1)]).T
    rng, best = np.random.default_rng(k), None
    for _ in range(50):
        code = rng.choice((-1.0, 1.0), size=(k, math.ceil(10 * math.log2(k))))
        code = code[:, np.abs(code.sum(axis=0)) < k]
        alike = code @ code.T
        np.fill_diagonal(alike, -np.inf)
        apart = (code.shape[1] - alike.max()) / 2
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Table places of the n-grams that start at each byte, for each order."""
    if len(data) < max(ORDERS):
        return [np.zeros(0, dtype=np.int64) for _ in ORDERS]
    wide = data.astype(np.uint32)
    three = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
    four = three[:-1] | wide[3:] << 24
    return [(x * np.uint32(m) >> np.uint32(16)).astype(np.int64) for x, m in ((three, 0x9E3779B1), (four, 0x85EBCA6B))]


def framed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, each between spaces, and where each starts (one more entry than texts)."""
    parts = [b" " + t.encode("utf-8", "surrogatepass").translate(LETTERS) + b" " * 2 for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), starts


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: list[np.ndarray]  # for each order, a row for each bit
    trust: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, texts: list[str]) -> np.ndarray:
        """For each text and bit how strongly the text speaks for +1."""
        data, starts = framed(texts)
        out = np.zeros((len(texts), self.code.shape[1]))
        for table, at, n in zip(self.weights, grams(data), ORDERS, strict=True):
            ends = np.maximum(starts[1:] - n + 1, starts[:-1])
            for bit in range(out.shape[1]):
                total = np.concatenate(([0.0], np.cumsum(table[bit][at], dtype=np.float64)))
                out[:, bit] += total[np.minimum(ends, len(at))] - total[np.minimum(starts[:-1], len(at))]
        n = np.maximum(np.diff(starts), 1)
        return out / np.maximum(n / 4, np.sqrt(n))[:, None]  # past a few letters it is the mean that counts: long texts would drown all doubt

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """For each text and language the weighted loss of its codeword, as a share of all weight."""
        return np.stack([(np.logaddexp(0, -margins * row) * self.trust).sum(axis=1) for row in self.code], axis=1) / max(self.trust.sum(), 1e-9)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UND, 0.0, False)] * len(texts)
        at = [i for i, t in enumerate(texts) if t and (ASCII_LETTER.search(t) or any(c.isalpha() for c in t))]
        if not self.langs or not at:
            return out
        if len(self.langs) == 1:
            for i in at:
                out[i] = (self.langs[0], 1.0, False)
            return out
        loss = self.losses(self.margins([texts[i] for i in at]))
        best = loss.argmin(axis=1)
        two = np.sort(loss, axis=1)[:, :2]
        near = two[:, 1] - two[:, 0] < NEAR * two[:, 1]
        odds = np.exp(-(loss - two[:, :1]) * self.code.shape[1])
        score = 1 / odds.sum(axis=1)
        for i, b, s, a in zip(at, best, score, near, strict=True):
            out[i] = (self.langs[b], float(s), bool(a))
        return out


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], DataFrame | None]:
    """The languages, and at most per_lang labelled texts of each, chosen by a hash of doc_id. docs: doc_id, text, lang."""
    labelled = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return [], None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    shares = docs.sparkSession.createDataFrame([(lang, math.ceil(min(1.0, 1.3 * per_lang / n) * 1_000_000)) for lang, n in counts.items()], "l string, share long")
    some = labelled.join(F.broadcast(shares), F.col("lang") == F.col("l")).where(draw < F.col("share")).select("doc_id", "text", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id"))
    return sorted(counts), some.withColumn("_rank", rank).where(F.col("_rank") <= per_lang).drop("_rank")


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """docs: doc_id, text and lang of the texts to learn from."""
    ready(docs.sparkSession)
    langs, some = sample(docs, per_lang)
    code = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, code, [np.zeros((0, TABLE), dtype=np.float32) for _ in ORDERS])
    some = some.select("lang", "text").repartition(4, "lang").persist()  # the sample is small whatever the input
    counted = pa.schema([("lang", pa.string()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch["lang"].to_pylist())
            for lang in sorted(set(names)):
                own = batch.filter(pa.array(names == lang))["text"]
                for s, e in slices(as_strings(own), SLICE):
                    data, starts = framed(own.slice(s, e - s).to_pylist())
                    total = held.setdefault(lang, np.zeros((len(ORDERS), TABLE), dtype=np.int64))
                    for i, (at, n) in enumerate(zip(grams(data), ORDERS, strict=True)):
                        across = (starts[1:-1, None] - np.arange(1, n)).ravel()  # from one text into the next
                        total[i] += np.bincount(np.delete(at, across[across < len(at)]), minlength=TABLE)
        for lang, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.astype("<i8").tobytes()], pa.binary())], schema=counted)

    # a language's texts are in one task: its counts come in one piece, and are added up by side of each bit at once
    sides = np.zeros((2, code.shape[1], len(ORDERS), TABLE))
    for lang, data in some.mapInArrow(count, "lang string, counts binary").toLocalIterator():
        own = np.frombuffer(data, dtype="<i8").reshape(len(ORDERS), TABLE) + SMOOTH
        own = own / own.sum(axis=1, keepdims=True)
        for side, sign in enumerate((1, -1)):
            sides[side, code[langs.index(lang)] == sign] += own
    sizes = [(code == sign).sum(axis=0)[:, None] for sign in (1, -1)]
    weights = [(np.log(sides[0, :, o] / sizes[0]) - np.log(sides[1, :, o] / sizes[1])).astype(np.float32) for o in range(len(ORDERS))]
    del sides
    model = Model(langs, code, weights, np.ones(code.shape[1]))
    held = some.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, n = np.zeros(code.shape[1], dtype=np.int64), 0
        for batch in batches:
            for s, e in slices(as_strings(batch["text"]), SLICE):
                m = held.value.margins(batch["text"].slice(s, e - s).to_pylist())
                right += (m * code[[langs.index(x) for x in batch["lang"].slice(s, e - s).to_pylist()]] > 0).sum(axis=0)
                n += len(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(right))), pa.array(right), pa.array([n] * len(right))], names=["bit", "right", "n"])

    right, n = np.zeros(code.shape[1]), np.zeros(code.shape[1])
    for b, r, c in some.mapInArrow(judge, "bit long, right long, n long").groupBy("bit").agg(F.sum("right"), F.sum("n")).collect():
        right[b], n[b] = r, c
    wrong = (n - right + 1) / (n + 2)
    model.trust = np.maximum(np.log((1 - wrong) / wrong), 0.1)
    some.unpersist()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and ambiguous; only texts go to Python."""
    ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def spoken(texts: pa.Array) -> pa.Array:
        own = held.value
        out = [x for s, e in slices(as_strings(texts), SLICE) for x in own.predict(texts.slice(s, e - s).to_pylist())]
        tidy()
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), [f.type for f in kind], strict=True)], fields=list(kind))

    own = docs.drop("lang_pred", "score", "ambiguous")
    found = own.select(F.struct("*").alias("row"), spoken(F.col("text").cast("string")).alias("said"))
    return found.select("row.*", "said.lang_pred", "said.score", "said.ambiguous")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where("not held_out"))
    return predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
