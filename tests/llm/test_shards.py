import zlib

from pyspark.sql import functions as F

from keyfacet.llm import shards


def placed(spark, docs, n=4, slots=64):
    rows = shards.sized(docs, n_slots=slots)
    n_bytes, n_rows = shards.slot_totals(rows, slots)
    return shards.place(rows, shards.SlotMap.build(n_bytes, n), n_rows), n_bytes


def test_layout(spark, edge_docs):
    out, _ = placed(spark, edge_docs.withColumn("shard", F.lit("x")).withColumn("copies", F.lit(9)).withColumn("size", F.lit(1)))
    rows = out.collect()
    wanted = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in edge_docs.collect())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == wanted
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_bytes_are_even_and_copies_spread(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.repeat(F.lit("x"), (F.col("id") % 97).cast("int"))).alias("text"))
    out, _ = placed(spark, docs, 8, 512)
    loads = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 8 and max(loads) - min(loads) < 0.01 * sum(loads) / 8


def test_repeated_rows_are_numbered(spark):
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    out, _ = placed(spark, docs)
    assert out.count() == 5000 and out.select("slot").distinct().count() == 5000 and out.agg(F.max("slot")).first()[0] == 4999


def test_map_versions(spark, tmp_path):
    sizes = [(i * 37) % 101 for i in range(256)]
    first = shards.SlotMap.build(sizes, 4)
    first.save(spark, f"file://{tmp_path}/map")
    grown = first.rebalance(sizes, 5)
    grown.save(spark, f"file://{tmp_path}/map")
    assert shards.SlotMap.load(spark, f"file://{tmp_path}/map") == grown
    assert shards.SlotMap.load(spark, f"file://{tmp_path}/map", 1) == first
    moved = sum(a != b for a, b in zip(first.shard_of, grown.shard_of))
    assert grown.version == 2 and all(b == 4 for a, b in zip(first.shard_of, grown.shard_of) if a != b) and moved < 80
    loads = grown.loads()
    assert max(loads) < 1.06 * sum(loads) / 5
    fewer = grown.rebalance(sizes, 3)
    assert set(fewer.shard_of) == {0, 1, 2} and max(fewer.loads()) < 1.06 * sum(sizes) / 3


def test_empty(spark, empty_docs):
    out, n_bytes = placed(spark, empty_docs)
    assert out.count() == 0 and sum(n_bytes) == 0
