"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a valid zstandard stream: data frames, each of the ids of some whole
documents (or of one long one) and readable alone, then a skippable frame with the seek
table. The table lists for each frame its compressed and plain size and a
checksum of its plain bytes, and for each document its id, frame, place and number of ids.
The last 8 bytes before the separator give the table's size. Records are parted by an
empty skippable frame, which any zstandard reader passes over; it lets Spark's own
writer and reader move the files, so that they may lie in any store that Spark opens.

Documents lie in ascending doc_id order: within a file, and from file to file in
the order of the numbers in their names. Ids are little-endian, of 2 bytes if the vocabulary allows, else 4.

Defined cases: a null or empty text has the end id alone; a null doc_id comes
first; equal doc_ids are ordered by a hash of their text, and rows repeated
in full are written each; doc_ids are whole numbers; an empty table gives no documents; extra columns are dropped.
"""

from __future__ import annotations

import binascii
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushgrid.llm.runtime import chunk_count, cut, ready, shared_dir
from hushgrid.llm.tokens import encoder
from hushgrid.llm.words import as_strings

END_ID = 2
#: Plain bytes after which a frame is closed at the next document's end.
FRAME_BYTES = 1 << 18
LEVEL = 3
#: Magic numbers of zstandard's skippable frames: the separator's and the table's.
GAP = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
TABLE_MAGIC = 0x184D2A5E
MAGIC = b"SEEK"


class Writer:
    """Makes a file's bytes, piece by piece."""

    def __init__(self, width: int):
        self.width, self.frames, self.docs = width, [], []
        self.open: list[bytes] = []
        self.held = 0
        self.z = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)

    def add(self, doc_id: int | None, ids: np.ndarray) -> bytes:
        data = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.docs.append((doc_id, len(self.frames), self.held, len(ids)))
        self.open.append(data)
        self.held += len(data)
        return self.close_frame() if self.held >= FRAME_BYTES else b""

    def close_frame(self) -> bytes:
        if not self.open:
            return b""
        plain = b"".join(self.open)
        packed = self.z.compress(plain)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain)))
        self.open, self.held = [], 0
        return packed

    def table(self) -> bytes:
        """The seek table as a skippable frame."""
        body = struct.pack("<BII", self.width, len(self.frames), len(self.docs)) + np.array(self.frames, dtype="<u8").tobytes()
        known = np.array([d[0] is not None for d in self.docs], dtype=np.uint8)
        docs = np.array([(d[0] or 0, *d[1:]) for d in self.docs], dtype="<i8").reshape(-1, 4)
        body += known.tobytes() + np.ascontiguousarray(docs.T).tobytes()
        body = self.z.compress(body)
        size = len(body) + 8
        return struct.pack("<II", TABLE_MAGIC, size) + body + struct.pack("<I", size) + MAGIC


class Reader:
    """Reads documents of a file's bytes; only the frames asked for are decompressed."""

    def __init__(self, data: bytes):
        self.data = data
        while data.endswith(GAP, 0, len(data)) and not data.endswith(MAGIC):
            data = data[: -len(GAP)]
        if not data.endswith(MAGIC):
            raise ValueError("no seek table")
        (size,) = struct.unpack_from("<I", data, len(data) - 8)
        self.z = zstandard.ZstdDecompressor()
        body = self.z.decompress(data[len(data) - size : len(data) - 8])
        self.width, n, m = struct.unpack_from("<BII", body)
        at = 9
        self.frames = np.frombuffer(body, "<u8", 3 * n, at).reshape(-1, 3)
        at += 24 * n
        known = np.frombuffer(body, np.uint8, m, at).astype(bool)
        docs = np.frombuffer(body, "<i8", 4 * m, at + m).reshape(4, m)
        self.doc_ids = [int(d) if k else None for d, k in zip(docs[0], known, strict=True)]
        self.frame_of, self.place, self.n_ids = docs[1], docs[2], docs[3]
        # frames are parted by separators only between records, which hold one frame each
        self.starts = np.concatenate(([0], np.cumsum(self.frames[:, 0].astype(np.int64) + len(GAP))))[:-1]
        self.last: tuple[int, bytes] | None = None

    def frame(self, k: int) -> bytes:
        if self.last is None or self.last[0] != k:
            size, plain, check = (int(x) for x in self.frames[k])
            got = self.z.decompress(self.data[self.starts[k] : self.starts[k] + size], max_output_size=plain)
            if len(got) != plain or xxhash.xxh64_intdigest(got) != check:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, got)
        return self.last[1]

    def ids(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document."""
        return np.frombuffer(self.frame(int(self.frame_of[i])), f"<u{self.width}", int(self.n_ids[i]), int(self.place[i])).astype("<u4")

    def find(self, doc_ids: set) -> list[int]:
        return [i for i, d in enumerate(self.doc_ids) if d in doc_ids]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode docs and write one file a range of doc_ids under path."""
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        out = Writer(2 if max(code.size - 1, end_id) < 1 << 16 else 4)
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_ids = batch["doc_id"].to_pylist()
            for at, ids, starts in code.batches(as_strings(batch["text"])):
                for i, (s, e) in enumerate(zip(starts[:-1], starts[1:], strict=True), at):
                    if piece := out.add(doc_ids[i], np.append(ids[s:e], np.uint32(end_id))):
                        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.binary())], names=["data"])
        if piece := out.close_frame():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.binary())], names=["data"])
        if out.docs:
            yield pa.RecordBatch.from_arrays([pa.array([out.table()], pa.binary())], names=["data"])

    dealt = rows.repartitionByRange(chunk_count(docs), *order).sortWithinPartitions(*order)
    data = dealt.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value"))
    data.write.option("lineSep", GAP.decode("latin-1")).option("compression", "none").mode("errorifexists").text(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """file, doc_id, nth, start (within the file), n_tokens, ids_crc32 (and ids) of the documents asked for, all if None."""
    wanted = None if doc_ids is None else set(doc_ids)
    schema = pa.schema([("file", pa.string()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch["file"].to_pylist(), batch["content"], strict=True):
                if not len(data.as_py()):
                    continue
                r = Reader(data.as_py())
                starts = np.concatenate(([0], np.cumsum(r.n_ids)))
                at = range(len(r.doc_ids)) if wanted is None else r.find(wanted)
                for some in (at[i : i + 2000] for i in range(0, len(at), 2000)):
                    own = [r.ids(i) for i in some]
                    columns = [[file] * len(own), list(some), [r.doc_ids[i] for i in some], [int(starts[i]) for i in some], [int(r.n_ids[i]) for i in some], [binascii.crc32(x.tobytes()) for x in own]]
                    arrays = [pa.array(c, t) for c, t in zip(columns, schema.types, strict=False)]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))] * with_ids, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, "file string, nth long, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def with_global_starts(found: DataFrame) -> DataFrame:
    """start counted from the first file on. found: all documents of all files, computed already."""
    # Spark numbers files part-00000, part-00001, ..., and with more digits from 100000 on: the number decides, not the text
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    files = found.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = files.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("file").alias("_file"), "_before")
    return found.join(before, F.col("file") == F.col("_file")).withColumn("start", F.col("start") + F.col("_before")).drop("_file", "_before")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ready(spark)
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return with_global_starts(cut(read(spark, path))).select("doc_id", "start", "n_tokens", "ids_crc32")
