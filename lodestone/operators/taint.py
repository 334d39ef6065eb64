"""Taint: flows from functions with sources to functions with sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .graph import FORWARD_DEPTH, chains_to_sinks, clean_edges
from .symbols import details


def forward_paths(edges: DataFrame, functions: DataFrame, depth: int = FORWARD_DEPTH) -> DataFrame:
    """src_id, sink_id, path of every simple path of up to depth + 1 nodes from a source function to another function with a sink.

    Paths go on through sinks. Only nodes that reach a sink in the steps left are entered.
    """
    e = clean_edges(edges)
    sinks = functions.where("is_sink").select(F.col("func_id").alias("node"))
    # near: nodes with the least number of steps to a sink. A level is made of the one before only, and cut, so plans stay short.
    frontier = cut(sinks.distinct())
    near = frontier.withColumn("steps", F.lit(0))
    for k in range(1, depth):
        frontier = cut(e.join(frontier.withColumnRenamed("node", "dst_id"), "dst_id", "left_semi").select(F.col("src_id").alias("node")).distinct())
        near = near.unionByName(frontier.withColumn("steps", F.lit(k)))
    near = cut(near.groupBy("node").agg(F.min("steps").alias("steps")))
    paths = functions.where("is_source").select(F.col("func_id").alias("src_id"), F.array("func_id").alias("path"))
    out = None
    for step in range(depth):
        useful = e.join(near.where(F.col("steps") <= depth - 1 - step).select(F.col("node").alias("dst_id")), "dst_id", "left_semi").select(F.col("src_id").alias("at"), F.col("dst_id").alias("to"))
        paths = paths.withColumn("at", F.element_at("path", -1)).join(useful, "at").where(~F.array_contains("path", F.col("to"))).select("src_id", F.concat("path", F.array("to")).alias("path"))
        paths = cut(paths)
        ended = paths.withColumn("node", F.element_at("path", -1)).join(sinks, "node", "left_semi").select("src_id", F.col("node").alias("sink_id"), "path")
        out = ended if out is None else out.unionByName(ended)
    return out


def _sanitizer_on(paths: DataFrame, what: DataFrame, key: list[str]) -> DataFrame:
    """paths with the first sanitizer of the first function on the path that has one; what: details() of the functions."""
    what = what.where("sanitizer is not null").select("func_id", "sanitizer")
    nodes = paths.select(*key, "path").distinct().select(*key, "path", F.posexplode("path").alias("pos", "func_id"))
    first = nodes.join(what, "func_id").groupBy(*key, "path").agg(F.min_by("sanitizer", "pos").alias("sanitizer"))
    return paths.join(first, [*key, "path"], "left")


def risk_level() -> Column:
    return F.when(F.col("sanitizer").isNotNull(), "safe").when(F.size("path") <= 2, "critical").otherwise("high")


def flows(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """source, src_id, sink, sink_id, path, sanitizer, risk_level, deduplicated.

    Three kinds: source and sink in one body; forward paths; the first source on a backward chain. Of flows with the same source and
    sink (name, file and line each) the one that was found first stays: by source function, source name, then kind, path order and sink
    order; chains come last. Order among equal kinds is by the ids on the path.
    """
    f = functions.dropDuplicates(["func_id"])
    d = cut(details(f))
    order = f.select("func_id", "file", "line", "ordinal")
    sources = d.where("size(sources) > 0").select(F.col("func_id").alias("src_id"), F.posexplode("sources").alias("source_no", "source"))
    sinks = d.where("size(sinks) > 0").select(F.col("func_id").alias("sink_id"), F.posexplode("sinks").alias("sink_no", "sink"))
    own = sources.join(sinks, F.col("src_id") == F.col("sink_id")).withColumn("path", F.array("src_id")).withColumn("kind", F.lit(0))
    ahead = forward_paths(edges, f).join(sources, "src_id").join(sinks, "sink_id").withColumn("kind", F.lit(1))
    chains = cut(chains_to_sinks(edges, f).distinct())
    on = chains.select("sink_id", "path", F.posexplode("path").alias("pos", "func_id")).join(f.where("is_source").select("func_id"), "func_id", "left_semi").groupBy("sink_id", "path").agg(F.min_by("func_id", "pos").alias("src_id"))
    back = on.join(sources.where("source_no = 0"), "src_id").join(sinks, "sink_id").withColumn("kind", F.lit(2))
    columns = ["kind", "src_id", "source_no", "source", "sink_id", "sink_no", "sink", "path"]
    every = own.select(columns).unionByName(ahead.select(columns)).unionByName(back.select(columns))
    placed = every.join(order.select(F.col("func_id").alias("src_id"), F.col("file").alias("src_file"), F.col("line").alias("src_line"), "ordinal"), "src_id").join(order.select(F.col("func_id").alias("sink_id"), F.col("file").alias("sink_file"), F.col("line").alias("sink_line")), "sink_id")
    rank = F.struct(F.when(F.col("kind") == 2, 1).otherwise(0).alias("late"), F.when(F.col("kind") < 2, F.col("ordinal")).alias("o"), "source_no", "kind", "path", "sink_no", "src_id", "sink_id")
    kept = placed.groupBy("source", "src_file", "src_line", "sink", "sink_file", "sink_line").agg(F.min(rank).alias("r"))
    chosen = kept.select("source", F.col("r.src_id").alias("src_id"), "sink", F.col("r.sink_id").alias("sink_id"), F.col("r.path").alias("path"))
    return _sanitizer_on(cut(chosen), d, ["sink_id"]).select("source", "src_id", "sink", "sink_id", "path", "sanitizer", risk_level().alias("risk_level"))


def flow_stats(found: DataFrame) -> DataFrame:
    r = F.col("risk_level")
    return found.agg(F.count("*").alias("total_chains"), F.count_if(r != "safe").alias("vulnerable_chains"), F.count_if(r == "safe").alias("safe_chains"), F.count_if(r == "critical").alias("critical_chains"), F.count_if(r == "high").alias("high_chains"))
