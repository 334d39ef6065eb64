from lodestone.operators import graph
from lodestone.streaming import continuous


def test_upserts_keep_the_latest_and_may_run_again(spark, tmp_path):
    sink = continuous.upserting(str(tmp_path / "t"), ["k"], "at")
    first = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, at int")
    later = spark.createDataFrame([(2, "d", 5), (3, "e", 1)], "k int, v string, at int")
    for n, df in ((0, first), (1, later), (1, later)):
        sink(df, n)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t" / "v1")).collect()) == [(1, "b"), (2, "d"), (3, "e")]


def test_first_deliveries_of_a_stream(spark, tmp_path):
    rows = [("x", "2090-01-01 00:00:00", 1), ("x", "2090-01-01 01:00:00", 2), ("y", "2090-01-01 02:00:00", 3), (None, "2090-01-01 02:00:00", 4)]
    spark.createDataFrame(rows, "finding_id string, at string, seq int").selectExpr("finding_id", "cast(at as timestamp) as loaded_at", "seq").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = continuous.landing(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = continuous.first_deliveries(stream).writeStream.format("memory").queryName("first_deliveries").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.finding_id for r in spark.table("first_deliveries").collect()) == ["x", "y"]


def test_walks_are_counted_as_they_are_listed(spark):
    import random

    r = random.Random(2)
    edges = spark.createDataFrame([(r.randrange(12), r.randrange(12)) for _ in range(30)] + [(3, 3), (None, 1)], "src_id long, dst_id long")
    f = spark.createDataFrame([(i, f"f{i}.py", i % 4 == 0, i % 5 == 1, False) for i in range(12)], "func_id long, file string, is_sink boolean, is_source boolean, has_sanitizer boolean")
    listed = {}
    for x in graph.described_chains(graph.chains_to_sinks(edges, f), f).collect():
        listed[x.length, x.has_source] = listed.get((x.length, x.has_source), 0) + x.times
    assert {(x.length, x.has_source): x.times for x in graph.walk_counts(edges, f).collect() if x.times} == listed and len(listed) > 3
    assert graph.walk_counts(edges, f.limit(0)).agg({"times": "sum"}).first()[0] is None
