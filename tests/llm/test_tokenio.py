import binascii
import uuid
from collections import Counter

import numpy as np
import pytest
import zstandard

from hushgrid.llm import tokenio
from hushgrid.llm.runtime import cut

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_exact_round_trip(spark, docs, rows, tmp_path):
    path = f"file://{tmp_path}/t"
    tokenio.write(docs, path, PATH)
    found = tokenio.with_global_starts(cut(tokenio.read(spark, path, with_ids=True))).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == Counter((r[0], tuple(ids_of(r[1]) + [2])) for r in rows)
    at, last = 0, None
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at and r.ids_crc32 == binascii.crc32(np.array(r.ids, dtype="<u4").tobytes()) and r.n_tokens == len(r.ids)
        assert last is None or r.doc_id >= last
        last = r.doc_id if r.doc_id is not None else last
        at += r.n_tokens
    some = tokenio.read(spark, path, [104, 400]).collect()
    assert {r.doc_id for r in some} == {104, 400}


def test_files_are_zstandard_streams_and_checked(spark, docs, tmp_path):
    tokenio.write(docs, f"file://{tmp_path}/t", PATH)
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "t").glob("part-*")) if f.stat().st_size)
    assert len(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()) > 0
    one = next(f.read_bytes() for f in sorted((tmp_path / "t").glob("part-*")) if f.stat().st_size)
    r = tokenio.Reader(one)
    bad = bytearray(one)
    bad[int(r.starts[0]) + int(r.frames[0][0]) // 2] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenio.Reader(bytes(bad)).frame(0)
    with pytest.raises(ValueError):
        tokenio.Reader(b"nothing")


def test_only_the_frames_asked_for_are_decompressed():
    w = tokenio.Writer(4)
    out = []
    for i in range(50):
        if piece := w.add(i, np.full(20_000, i, dtype=np.uint32)):
            out.append(piece)
    if piece := w.close_frame():
        out.append(piece)
    data = b"".join(x + tokenio.GAP for x in [*out, w.table()])
    broken = bytearray(data)
    r = tokenio.Reader(data)
    assert len(r.frames) > 5
    broken[int(r.starts[0]) + 8] ^= 255
    r = tokenio.Reader(bytes(broken))
    assert r.ids(r.find({49})[0]).tolist() == [49] * 20_000


def test_empty_and_clashing(spark, empty, clashing, rows, tmp_path):
    tokenio.write(empty, f"file://{tmp_path}/e", PATH)
    assert tokenio.with_global_starts(cut(tokenio.read(spark, f"file://{tmp_path}/e"))).count() == 0
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    tokenio.write(clashing, path, PATH)
    assert tokenio.read(spark, path).count() == len(rows)


def test_files_count_by_their_numbers(spark):
    found = spark.createDataFrame([("part-100000-x.txt", 3, 0, 5), ("part-99999-x.txt", 2, 0, 7), ("part-00001-x.txt", 1, 0, 11)], "file string, doc_id long, start long, n_tokens long")
    assert {r.doc_id: r.start for r in tokenio.with_global_starts(found).collect()} == {1: 0, 2: 11, 3: 18}
