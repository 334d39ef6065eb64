"""Call graph: import map, resolution of calls, adjacency, chains to sinks, entry points.

Chains are enumerated level by level with equality joins on the edges, paths carried as arrays. Before a level is expanded, nothing
outside the direction of travel is kept, and each level is cut through the checkpoint folder: backward walks start at sinks only, forward walks keep a node only if it reaches a sink in
the steps that remain (a semi join per level), so the frontier follows the answer and not the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import ENTRY_WORDS
from ..functions.text import contains_any
from ..session import cut
from .symbols import base_name

#: Nodes after which a backward chain ends, so a chain has up to one more.
BACKWARD_DEPTH = 5
#: Steps of a forward trace, so a path has up to one more node.
FORWARD_DEPTH = 4


def imports_of(functions: DataFrame) -> DataFrame:
    """file, text of the import lines in function bodies."""
    lines = functions.select("file", F.explode(F.split(F.coalesce("body", F.lit("")), "\n")).alias("text"))
    return lines.where(F.trim("text").startswith("import") | F.trim("text").startswith("from")).select("file", F.trim("text").alias("text"))


def import_map(imports: DataFrame) -> DataFrame:
    """file, name, module of imports(file, text): every `from` is removed and every `import` read as a blank; the first token is the
    module, the others without trailing commas are names, `as` excepted. One row for each file and name (largest module on conflict)."""
    words = F.filter(F.split(F.replace(F.replace("text", F.lit("from"), F.lit("")), F.lit("import"), F.lit(" ")), r"\s+"), lambda w: w != "")
    both = imports.where(F.contains("text", F.lit("from")) & F.contains("text", F.lit("import"))).select("file", words.alias("w")).where("size(w) >= 2")
    names = both.select("file", F.col("w")[0].alias("module"), F.explode(F.slice("w", 2, F.size("w"))).alias("name")).withColumn("name", F.regexp_replace("name", ",+$", ""))
    return names.where("name not in ('', 'as')").groupBy("file", "name").agg(F.max("module").alias("module"))


def call_edges(functions: DataFrame, imported: DataFrame) -> DataFrame:
    """Distinct src_id, dst_id. A call means, in this order: the first other function of that name in the same file; the first of that name
    anywhere, if the file imports the name; the only function of that name."""
    calls = functions.select("func_id", "file", F.explode("calls").alias("call")).select("func_id", "file", base_name(F.col("call")).alias("name")).where("name is not null").distinct()
    first = F.struct("ordinal", "func_id")
    # Two smallest of a name in a file: the second is for the function that calls its own name.
    here = functions.groupBy("file", F.col("func_name").alias("name")).agg(F.slice(F.array_sort(F.array_agg(first)), 1, 2).alias("own"))
    anywhere = functions.groupBy(F.col("func_name").alias("name")).agg(F.min(first).alias("any_first"), F.count("*").alias("n"))
    known = imported.select("file", "name", F.lit(True).alias("is_imported"))
    found = calls.join(here, ["file", "name"], "left").join(anywhere, "name", "left").join(known, ["file", "name"], "left")
    local = F.get(F.filter(F.transform("own", lambda x: x["func_id"]), lambda x: x != F.col("func_id")), F.lit(0))
    other = F.when(F.coalesce("is_imported", F.lit(False)) | (F.col("n") == 1), F.col("any_first.func_id"))
    return found.select(F.col("func_id").alias("src_id"), F.coalesce(local, other).alias("dst_id")).where("dst_id is not null").distinct()


def clean_edges(edges: DataFrame) -> DataFrame:
    return edges.where("src_id is not null and dst_id is not null").select("src_id", "dst_id").distinct()


def neighbours(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """func_id with number of callers and callees (0 where none)."""
    e = clean_edges(edges)
    callers, callees = e.groupBy(F.col("dst_id").alias("func_id")).agg(F.count("*").alias("callers")), e.groupBy(F.col("src_id").alias("func_id")).agg(F.count("*").alias("callees"))
    joined = functions.select("func_id").join(callers, "func_id", "left").join(callees, "func_id", "left")
    return joined.select("func_id", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


def sink_callers(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """func_id, sink_id, level (1 or 2) of the callers of sinks and their callers."""
    e = clean_edges(edges)
    one = e.join(functions.where("is_sink").select(F.col("func_id").alias("dst_id")), "dst_id", "left_semi").select(F.col("src_id").alias("func_id"), F.col("dst_id").alias("sink_id"))
    two = e.join(one.withColumnRenamed("func_id", "dst_id"), "dst_id").select(F.col("src_id").alias("func_id"), "sink_id")
    return one.withColumn("level", F.lit(1)).unionByName(two.withColumn("level", F.lit(2))).distinct()


def chains_to_sinks(edges: DataFrame, functions: DataFrame, depth: int = BACKWARD_DEPTH) -> DataFrame:
    """sink_id, path (entry first): every backward walk from a sink that ends, as a multiset.

    A walk ends where nothing calls the function, where it has more than `depth` nodes, or, once for each caller already on it, where
    it would close a cycle. The sink itself is not counted as visited, so it may occur once more.
    """
    e = clean_edges(edges).select(F.col("dst_id").alias("at"), F.col("src_id").alias("caller"))
    walks = functions.where("is_sink").select(F.col("func_id").alias("sink_id"), F.array("func_id").alias("path"))
    out = None
    for n in range(1, depth + 2):
        if n > depth:
            ended = walks
        else:
            met = cut(walks.withColumn("at", F.element_at("path", -1)).join(e, "at", "left"))
            closes = F.array_contains(F.slice("path", 2, depth + 1), F.col("caller"))
            ended = met.where(F.col("caller").isNull() | closes).select("sink_id", "path")
            walks = met.where(F.col("caller").isNotNull() & ~closes).select("sink_id", F.concat("path", F.array("caller")).alias("path"))
        out = ended if out is None else out.unionByName(ended)
    return out.select("sink_id", F.reverse("path").alias("path"))


def _flags(chains: DataFrame, functions: DataFrame) -> DataFrame:
    """Chains with a key and, from the functions on them, has_source, has_sanitizer, files."""
    keyed = chains.withColumn("chain_id", F.xxhash64("sink_id", "path"))
    nodes = keyed.select("chain_id", "sink_id", "path").distinct().select("chain_id", "sink_id", "path", F.explode("path").alias("func_id"))
    info = functions.select("func_id", "file", "is_source", "has_sanitizer")
    return nodes.join(info, "func_id").groupBy("chain_id", "sink_id", "path").agg(F.bool_or("is_source").alias("has_source"), F.bool_or("has_sanitizer").alias("has_sanitizer"), F.array_sort(F.collect_set("file")).alias("files"))


def described_chains(chains: DataFrame, functions: DataFrame) -> DataFrame:
    """sink_id, path, length, has_source, has_sanitizer, files, times (how often the walk ended so)."""
    times = chains.groupBy("sink_id", "path").agg(F.count("*").alias("times"))
    return _flags(times, functions).join(times, ["sink_id", "path"]).select("sink_id", "path", F.size("path").alias("length"), "has_source", "has_sanitizer", "files", "times")


def is_entry_name(name: Column) -> Column:
    return contains_any(F.lower(name), ENTRY_WORDS)


def entry_points(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """func_id of functions that nothing calls, that are exported, or that have an entry word in their name."""
    called = clean_edges(edges).select(F.col("dst_id").alias("func_id")).distinct().withColumn("called", F.lit(True))
    return functions.join(called, "func_id", "left").where(F.col("called").isNull() | F.coalesce("is_exported", F.lit(False)) | is_entry_name(F.col("func_name"))).select("func_id")


def walk_counts(edges: DataFrame, functions: DataFrame, depth: int = BACKWARD_DEPTH) -> DataFrame:
    """length, has_source, times: how many of the walks of chains_to_sinks() have which length and a source on them.

    Walks that stand at one function with the same functions behind them go on alike, whichever sink they began at and in whichever order
    they came, so each level is an aggregate over (function, functions behind it, source met) with a count: a hub multiplies counts, not rows.
    """
    e = clean_edges(edges).select(F.col("dst_id").alias("at"), F.col("src_id").alias("caller"))
    sources = functions.where("is_source").select(F.col("func_id").alias("caller"), F.lit(True).alias("s")).distinct()
    state = ["at", "behind", "has_source"]
    walks = functions.where("is_sink").select(F.col("func_id").alias("at"), F.array().cast("array<bigint>").alias("behind"), F.coalesce("is_source", F.lit(False)).alias("has_source")).groupBy(*state).agg(F.count("*").alias("times"))
    out = None
    for n in range(1, depth + 2):
        if n > depth:
            ended = walks
        else:
            met = walks.join(e, "at", "left").join(sources, "caller", "left")
            closes = F.array_contains("behind", F.col("caller"))
            ended = met.where(F.col("caller").isNull() | closes)
            on = met.where(F.col("caller").isNotNull() & ~closes).select(F.col("caller").alias("at"), F.array_sort(F.concat("behind", F.array("caller"))).alias("behind"), (F.col("has_source") | F.coalesce("s", F.lit(False))).alias("has_source"), "times")
        part = ended.groupBy("has_source").agg(F.sum("times").alias("times")).withColumn("length", F.lit(n))
        out = part if out is None else out.unionByName(part)
        if n <= depth:
            walks = cut(on.groupBy(*state).agg(F.sum("times").alias("times")))
    return out.groupBy("length", "has_source").agg(F.sum("times").alias("times"))


def graph_stats(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: nodes, edges, entry_points, sink_chains, dangerous_chains, max_chain_depth."""
    c = walk_counts(edges, functions).agg(F.coalesce(F.sum("times"), F.lit(0)).alias("sink_chains"), F.coalesce(F.sum(F.when(F.col("has_source"), F.col("times"))), F.lit(0)).alias("dangerous_chains"), F.coalesce(F.max("length"), F.lit(0)).alias("max_chain_depth"))
    one = functions.agg(F.count("*").alias("nodes")).crossJoin(clean_edges(edges).agg(F.count("*").alias("edges"))).crossJoin(entry_points(edges, functions).agg(F.count("*").alias("entry_points")))
    return one.crossJoin(c)
