import binascii
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushgrid.llm import packing
from hushgrid.llm.tokens import encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("text", ["Hello, World... it's 42%! don't.", "a.b,c;; d", "ÉTÉ été, é ﬁn x\u0085y  z q", "'s 's, WORD's.", "<|endoftext|> <|startoftext|>x", "日本語。テスト, ok!", "", "!!! ?? .,"])
def test_word_by_word_ids_are_those_of_the_whole_text(text):
    import pyarrow as pa

    ids, starts = encoder(PATH).batch(pa.array([text, "x", text]))
    one = whole([text])[0]
    assert ids.tolist() == one + whole(["x"])[0] + one and starts.tolist()[-1] == len(ids)


def test_ids_are_those_of_the_plain_call_for_every_character():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = [t for c in range(1, 1 << 16) if not 0xD800 <= c < 0xE000 for t in (f"x{chr(c)}. y", f"{chr(c)}? {chr(c)}É{chr(c)}, J{chr(c)}! é{chr(c)};{chr(c)} {chr(c)}J")]
    texts += ["hello <|endoftext|> world", "a<|startoftext|>b <|ENDOFTEXT|>. B<|endoftext|>.", "<|EndOfText|> X.", "\x1f", "x.\x1f \x1f", "a$$$ it's' '' <| |>"]
    rng, letters = random.Random(1), "aAéÉçßÀ.,;:!?'sS9 \t\n\r\x0b\x1f\u0301\u030c\u0307JjİΣς \u0085日ﬁ-_<|>$"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(20_000)]
    found = [ids[s:e].tolist() for _, ids, starts in encoder(PATH).batches(pa.array(texts)) for s, e in zip(starts[:-1], starts[1:], strict=True)]
    wanted = [x.ids for x in Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for t, f, w in zip(texts, found, wanted, strict=True) if f != w] == []


def test_words_forgotten_are_learned_again(monkeypatch):
    import pyarrow as pa

    from hushgrid.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_WORDS", 10)
    e = tokens.Encoder(PATH)
    texts = [f"w{i} word{i % 7}, W{i - 3}." for i in range(60)]
    got = [e.batch(pa.array([t]))[0].tolist() for t in texts]
    assert got == whole(texts) and len(e.kept) < 40


def test_an_idle_worker_gives_its_encoder_up(monkeypatch):
    import time

    from hushgrid.llm import tokens

    tokens._OPEN.clear()
    monkeypatch.setattr(tokens, "IDLE", 0.2)
    e = tokens.encoder(PATH)
    assert tokens.encoder(PATH) is e
    for _ in range(50):
        time.sleep(0.1)
        if not tokens._OPEN:
            break
    assert not tokens._OPEN and e.plain(["x"]) == whole(["x"])


def check(found, rows, capacity, end_id=1):
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append(whole([r[1]])[0] + [end_id])
    expected = Counter((d, n, at, len(x[at : at + capacity]), binascii.crc32(np.array(x[at : at + capacity], dtype="<u4").tobytes())) for d, texts in ids.items() for x in texts for n, at in enumerate(range(0, len(x), capacity)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_are_right_and_bins_gapless(spark, docs, rows):
    found = packing.pack_documents(spark, docs, PATH, capacity=64).collect()
    n = check(found, rows, 64)
    total = sum(r.length for r in found)
    assert n <= total / 64 * 1.03 + 1


def test_fullest_agrees_with_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        room = rng.randrange(1, 60)
        counts = [0] * 61
        for _ in range(rng.randrange(6)):
            counts[rng.randrange(1, 40)] += rng.randrange(1, 4)
        reach = {0}
        for x, c in enumerate(counts):
            for _ in range(c):
                reach |= {s + x for s in reach if s + x <= room}
        taken = packing.fullest(counts, [x for x in range(60, 0, -1) if counts[x]], room)
        assert sum(taken) == max(reach) and all(n <= counts[x] for x, n in Counter(taken).items())


def test_plan_uses_each_piece_once():
    rng = random.Random(2)
    histogram = {rng.randrange(1, 4097): rng.randrange(1, 500) for _ in range(300)}
    bins = packing.plan(histogram)
    used = Counter()
    for taken, times in bins:
        assert sum(taken) <= 4096
        for x in taken:
            used[x] += times
    assert used == histogram
    assert sum(t for _, t in bins) <= sum(x * n for x, n in histogram.items()) / 4096 * 1.1 + 1
    with pytest.raises(ValueError):
        packing.plan({5000: 1})


def test_empty_and_clashing(spark, empty, clashing, rows):
    assert packing.pack_documents(spark, empty, PATH).count() == 0
    assert packing.pack_documents(spark, clashing, PATH).count() >= len(rows)
    names = ["row", "nth", "salt", "l", "s", "before", "own", "rank", "x", "slots", "slot", "_x", "_s", "_before", "_slots", "_salt", "_own", "_rank", "_slot", "_chunk"]
    parts = spark.range(500).select((F.col("id") % 7 + 1).alias("length"), F.lit(None).cast("long").alias("doc_id"), *[F.concat(F.lit(n), F.col("id")).alias(n) for n in names])
    packed = packing.pack(parts, 20)
    assert packed.columns == [*parts.columns, "sequence_id", "offset"]
    assert packed.select(*parts.columns).exceptAll(parts).count() == 0 and packed.count() == 500


def test_a_length_that_all_share_is_counted_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    parts = spark.range(1003).select(F.lit(5).alias("length"), "id")
    got = packing.pack(parts, 17).collect()
    assert len(got) == 1003 and len({(r.sequence_id, r.offset) for r in got}) == 1003
    assert Counter(r.offset for r in got).keys() == {0, 5, 10} and len({r.sequence_id for r in got}) == 335


def test_sequences_hold_the_ids(spark, docs, rows):
    packed = packing.pack(packing.pieces(docs, PATH, 64, with_ids=True), 64)
    got = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in got) == sum(len(x) + 1 for x in whole([r[1] for r in rows]))
