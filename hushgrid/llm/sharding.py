"""Sharding by extendible hashing, in DataFrame operations only.

The first bits of a row's hash select a directory entry; entries share a bucket while
it fits. Only a bucket over the byte limit splits, on one more bit, until every shard fits. A
bucket's depth is thus the least number of bits at which the bytes of all rows with
its prefix fit the limit. Sizes are summed for some bits at once: the rows are summed under
their prefix of STEP more bits, and the tree above is read off these sums. Only what
is in buckets still too large goes on to the next bits.

The hash is that of the key; rows of one key are told apart by more bits, from a
hash of a number that each row is given once, so that a key that a third of all rows
share splits as well. Sums are pre-aggregated and narrow: no text is shuffled.

Defined cases: a null or empty text has 0 bytes; a null key is a key; repeated rows are
rows of their own; a row over the limit alone is a shard of its own, marked oversized; an empty
table has no shards; extra columns are left out by ``shards`` and kept by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushgrid.llm.runtime import cut, ready

#: Bytes that a shard may hold, and what the query allows.
LIMIT = 256 << 20
QUERY_LIMIT = 1 << 20
#: Bits looked at in one pass.
STEP = 12
#: Bits of the key's hash, and with those of the row's number.
KEY_BITS, BITS = 60, 120


def bit_string(text: Column) -> Column:
    """60 bits of a string's MD5 as text of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 2), KEY_BITS, "0")


def prefixes(sizes: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """(prefix, depth, bytes, rows) of each shard. sizes: bits (text of 0 and 1), size."""
    ready(sizes.sparkSession)
    done, base, left = None, 0, sizes.select("bits", "size")
    while True:
        # sums under each prefix of up to step more bits; the rows themselves are summed once
        deep = min(base + step, BITS)
        leaves = cut(left.groupBy(F.substring("bits", 1, deep).alias("leaf")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
        level = F.explode(F.sequence(F.lit(base), F.lit(deep))).alias("depth")
        nodes = leaves.select("leaf", "bytes", "rows", level).groupBy(F.expr("substring(leaf, 1, depth)").alias("prefix"), "depth").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        fits = (F.col("bytes") <= limit) | (F.col("rows") == 1) | (F.col("depth") == BITS)
        nodes = cut(nodes.withColumn("fits", fits))
        # a bucket is final where it fits and the one above did not
        above = nodes.where(~F.col("fits")).select(F.col("prefix").alias("_p"), F.col("depth").alias("_d"))
        up = (F.expr("substring(prefix, 1, depth - 1)") == F.col("_p")) & (F.col("depth") - 1 == F.col("_d"))
        final = nodes.where("fits").join(above, up, "left").where((F.col("depth") == base) | F.col("_p").isNotNull()).select("prefix", "depth", "bytes", "rows")
        final = final if base == 0 else final.where(F.col("depth") > base)
        done = final if done is None else done.unionByName(final)
        over = nodes.where(~F.col("fits") & (F.col("depth") == deep)).select(F.col("prefix").alias("_over"))
        if deep >= BITS or over.isEmpty():
            return done
        left = left.join(over, F.substring("bits", 1, deep) == F.col("_over"), "left_semi")
        base = deep


def shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """For each row of docs its _key, size, bits and _nth (its number), and shard (its prefix of bits; the one shard of a small table has none), shard_depth, shard_bytes, shard_rows and oversized. Narrow: texts and other columns stay behind.

    The row numbers that tell rows of one key apart are written down with the sizes, so
    that a lost executor does not renumber rows.
    """
    ready(docs.sparkSession)
    return _placed(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("_nth")), limit)


def _placed(numbered: DataFrame, limit: int) -> DataFrame:
    """shards() of (key, text, _nth)."""
    key_bits = bit_string(F.coalesce(F.col("key").cast("string"), F.lit("null")))
    sizes = cut(numbered.select(F.col("key").alias("_key"), F.concat(key_bits, bit_string(F.col("_nth").cast("string"))).alias("bits"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "_nth"))
    return locate(sizes, cut(prefixes(sizes, limit)), limit)


def locate(sizes: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """Each row of sizes with its shard: a look-up under the directory's first bits, then among the few prefixes there."""
    widths = [r[0] for r in found.select("depth").distinct().collect()]  # at most BITS + 1
    prefix = F.array(*[F.substring("bits", 1, w) for w in sorted(widths)]) if widths else F.array(F.lit(""))
    named = found.select(F.col("prefix").alias("shard"), F.col("depth").alias("shard_depth"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))
    tried = sizes.withColumn("_shard", F.explode(prefix))
    return tried.join(named, F.col("_shard") == F.col("shard")).drop("_shard").withColumn("oversized", F.col("shard_bytes") > limit)


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """docs as Parquet under path, one folder a shard (a column called shard is replaced); each shard fits one task.

    The rows are numbered once and written to the shared folder with their numbers, which shards and rows are then joined by: wherever docs comes from and whatever is redone, a row keeps its number.
    """
    ready(docs.sparkSession)
    names = [c for c in docs.columns if c != "shard"]
    held = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("_nth")))
    placed = _placed(held.select("key", "text", "_nth"), limit).select(F.col("_nth").alias("n"), "shard")
    held.join(placed, F.col("_nth") == F.col("n")).repartition("shard").select("row.*", "shard").write.partitionBy("shard").parquet(path)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shards(docs, limit=QUERY_LIMIT).select(F.col("_key").alias("doc_id"), F.col("size").alias("bytes"), "shard", F.col("shard_depth").cast("long").alias("shard_depth"), "shard_bytes", "shard_rows", "oversized")


OP8_SQL = f"""
WITH hashed AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS bytes, lpad(bin(CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:15] AS BIGINT)), 60, '0') AS bits FROM documents),
sums AS (SELECT bits[1:depth] AS prefix, depth, sum(bytes) AS total, count(*) AS n FROM hashed, range(0, 40) AS d(depth) GROUP BY ALL),
fit AS (SELECT h.doc_id, min(s.depth) AS depth FROM hashed h JOIN sums s ON h.bits[1:s.depth] = s.prefix WHERE s.total <= {QUERY_LIMIT} OR s.n = 1 GROUP BY h.doc_id)
SELECT h.doc_id, h.bytes, h.bits[1:f.depth] AS shard, f.depth AS shard_depth, CAST(s.total AS BIGINT) AS shard_bytes, s.n AS shard_rows, s.total > {QUERY_LIMIT} AS oversized
FROM hashed h JOIN fit f USING (doc_id) JOIN sums s ON s.prefix = h.bits[1:f.depth] AND s.depth = f.depth
"""
