"""Symbol table: keyword flags of functions, look-ups, statistics. Keyword lists are unrolled into JVM expressions; nothing is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import SANITIZERS, SINKS, SOURCES
from ..functions.text import contains_any


def body_text(body: Column) -> Column:
    return F.lower(F.coalesce(body, F.lit("")))


def all_text(body: Column, calls: Column) -> Column:
    return F.concat(body_text(body), F.lit(" "), F.coalesce(F.lower(F.array_join(calls, " ")), F.lit("")))


def matching(text: Column, words: list[str]) -> Column:
    """The words that the text holds, in the order of the list."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w.lower())), F.lit(w)) for w in words]))


def sink_categories(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(contains_any(text, [w.lower() for w in words]), F.lit(c)) for c, words in SINKS.items()]))


def flagged(functions: DataFrame) -> DataFrame:
    """functions with sink_categories, is_sink, is_source, has_sanitizer derived from body and calls. Null bodies and calls count as empty."""
    t, b = all_text(F.col("body"), F.col("calls")), body_text(F.col("body"))
    out = functions.withColumn("sink_categories", sink_categories(t))
    return out.withColumns({"is_sink": F.size("sink_categories") > 0, "is_source": contains_any(b, [w.lower() for w in SOURCES]), "has_sanitizer": contains_any(b, [w.lower() for w in SANITIZERS])})


def details(functions: DataFrame) -> DataFrame:
    """func_id with the lists of sources and sinks met and the first sanitizer (null if none)."""
    b = body_text(F.col("body"))
    sinks = [w for words in SINKS.values() for w in words]
    return functions.select("func_id", matching(b, SOURCES).alias("sources"), matching(all_text(F.col("body"), F.col("calls")), sinks).alias("sinks"), F.get(matching(b, SANITIZERS), F.lit(0)).alias("sanitizer"))


def base_name(call: Column) -> Column:
    """Last dotted part of a call without closing parentheses; null if nothing is left."""
    name = F.regexp_replace(F.element_at(F.split(call, r"\."), -1), r"[()]+$", "")
    return F.when(name != "", name)


def qualified_name(parent: Column, name: Column) -> Column:
    return F.when(F.coalesce(parent, F.lit("")) != "", F.concat(parent, F.lit("."), name)).otherwise(name)


def callers_by_name(functions: DataFrame, names: DataFrame) -> DataFrame:
    """Functions with a call that is one of names(func_name) or ends in a dot and it: an equality semi join on every dotted suffix."""
    parts = F.split("call", r"\.")
    calls = functions.select("func_id", F.explode("calls").alias("call"))
    suffixes = calls.select("func_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("func_name"))
    return functions.join(suffixes.join(names.select("func_name").distinct(), "func_name", "left_semi").select("func_id").distinct(), "func_id", "left_semi")


def security_relevant(functions: DataFrame) -> DataFrame:
    """func_id of sinks, sources, and functions that call a sink by name."""
    sinks = functions.where("is_sink")
    return functions.where("is_sink or is_source").select("func_id").unionByName(callers_by_name(functions, sinks).select("func_id")).distinct()


def first_by_name(functions: DataFrame, name: str) -> DataFrame:
    return functions.where(F.col("func_name") == name).orderBy("ordinal", "func_id").limit(1)


def in_file(functions: DataFrame, file: str) -> DataFrame:
    return functions.where(F.col("file") == file)


def in_category(functions: DataFrame, category: str) -> DataFrame:
    return functions.where(F.array_contains("sink_categories", category))


def stats(functions: DataFrame) -> DataFrame:
    """One row: totals, distinct files, functions of each sink category."""
    per = [F.count_if(F.array_contains("sink_categories", c)).alias(f"sink_{c}") for c in SINKS]
    return functions.agg(F.count("*").alias("functions"), F.countDistinct("file").alias("files"), F.count_if("is_sink").alias("sinks"), F.count_if("is_source").alias("sources"), F.count_if("has_sanitizer").alias("sanitizers"), F.count_if("is_exported").alias("exported"), *per)
