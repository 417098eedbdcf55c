import re
from collections import defaultdict

import duckdb
import pytest

from hushgrid.llm import sharding


def test_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(sharding.OP8_SQL).fetchall())
    assert sorted(tuple(r) for r in sharding.op8(spark, sf_dir).collect()) == want


@pytest.mark.parametrize("limit", [200, 3000, 1 << 20])
def test_every_shard_fits_and_no_split_is_idle(spark, docs, rows, limit):
    hot = docs.unionByName(spark.createDataFrame([(7, "hot key text", "aa", "s", 1)] * 150, docs.schema))
    got = sharding.shards(hot, limit=limit).collect()
    assert len(got) == len(rows) + 150
    shard = defaultdict(list)
    for r in got:
        assert r.bits.startswith(r.shard) and len(r.shard) == r.shard_depth
        shard[r.shard].append(r)
    for prefix, own in shard.items():
        assert sum(r.size for r in own) == own[0].shard_bytes and len(own) == own[0].shard_rows
        assert own[0].shard_bytes <= limit or len(own) == 1
        assert own[0].oversized == (own[0].shard_bytes > limit)
        if prefix:
            above = [r for r in got if r.bits.startswith(prefix[:-1])]
            assert sum(r.size for r in above) > limit and len(above) > 1


def test_no_python_in_the_plan(docs):
    plan = sharding.shards(docs, limit=3000)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_clashing_and_written(spark, empty, clashing, rows, tmp_path):
    assert sharding.shards(empty).count() == 0
    assert sharding.shards(clashing, limit=3000).count() == len(rows)
    sharding.write_shards(clashing.drop("shard"), f"file://{tmp_path}/s", limit=3000)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == len(rows)


def test_rows_of_a_shuffle_keep_their_shards(spark, docs, rows, tmp_path):
    """The rows' numbers are written once: rows that come out in another order when they are read again are neither lost nor moved."""
    from pyspark.sql import functions as F

    mixed = docs.withColumn("shard", F.lit("own")).repartition(5, F.rand()).withColumn("_nth", F.lit("x"))
    sharding.write_shards(mixed, f"file://{tmp_path}/m", limit=3000)
    got = spark.read.parquet(f"file://{tmp_path}/m")
    assert got.drop("shard").exceptAll(mixed.drop("shard")).count() == 0 and got.count() == len(rows)
    sizes = got.groupBy("shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"), F.count("*").alias("n"))
    assert sizes.where("bytes > 3000 and n > 1").count() == 0


def test_a_shared_folder_is_needed_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from hushgrid.llm import runtime

    none = SimpleNamespace(get=lambda *_: None)
    session = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: none, master=master), conf=none)
    assert runtime.shared_dir(session("local[4]")).startswith("file:") and runtime.shared_dir(session("local"))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            runtime.shared_dir(session(master))
