"""Selection of the functions that an analysis has to see, with reasons, and its budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import chains_to_sinks, clean_edges, described_chains, entry_points, sink_callers

MOST_CHARS = 60_000


def selected_functions(edges: DataFrame, functions: DataFrame, flagged_files: DataFrame | None = None) -> DataFrame:
    """func_id, reasons (distinct, in order of step and name).

    Entry points are taken if they have a source, or call a function selected by the steps before them: the set is not extended while
    entry points are looked at, so the result does not depend on their order.
    """
    f = functions.dropDuplicates(["func_id"])
    names = f.select(F.col("func_id").alias("sink_id"), F.col("func_name").alias("sink_name"))
    part = lambda df, step, text: df.select("func_id", F.lit(step).alias("step"), text.alias("reason"))
    # The wording of the reasons.
    sinks = part(f.where("is_sink"), 1, F.concat(F.lit("contains_sink:"), F.array_join("sink_categories", ",")))
    sources = part(f.where("is_source"), 2, F.lit("contains_user_input_source"))
    callers = part(sink_callers(edges, f).join(names, "sink_id"), 3, F.concat(F.when(F.col("level") == 1, "calls_sink:").otherwise("indirect_caller_of_sink:"), "sink_name"))
    chains = described_chains(chains_to_sinks(edges, f), f).where("has_source")
    on_chain = part(chains.join(names, "sink_id").select(F.explode("path").alias("func_id"), "sink_name"), 4, F.concat(F.lit("in_dangerous_chain:"), "sink_name"))
    before = sinks.unionByName(sources).unionByName(callers).unionByName(on_chain).distinct()
    calls = clean_edges(edges).join(before.select(F.col("func_id").alias("dst_id")).distinct(), "dst_id", "left_semi").select(F.col("src_id").alias("func_id")).distinct()
    linked = calls.unionByName(f.where("is_source").select("func_id")).distinct()
    entries = part(entry_points(edges, f).join(linked, "func_id", "left_semi"), 5, F.lit("entry_point_with_security_connection"))
    every = before.unionByName(entries)
    if flagged_files is not None:
        hit = f.join(flagged_files.select(F.col("file_path").alias("file")).distinct(), "file")
        every = every.unionByName(part(hit, 6, F.concat(F.lit("scanner_flagged_file:"), "file")))
    listed = every.distinct().groupBy("func_id").agg(F.array_sort(F.collect_set(F.struct("step", "reason"))).alias("r"))
    return listed.select("func_id", F.transform("r", lambda x: x["reason"]).alias("reasons"))


def ordered_context(functions: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected functions with the keys of the order in which a context holds them: sources, sinks, file, line."""
    return functions.dropDuplicates(["func_id"]).join(selected, "func_id").select("func_id", (~F.col("is_source")).alias("late_source"), (~F.col("is_sink")).alias("late_sink"), "file", "line", "ordinal", "body", "reasons")


def context_blocks(functions: DataFrame, selected: DataFrame, used: int = 0, most: int = MOST_CHARS) -> DataFrame:
    """func_id, text of the functions that a context holds: taken in order until the running total exceeds `most`.

    Only keys and lengths are ordered in one window, of the first most + 1 functions (a block has a character at least); bodies join after.
    """
    order = ["late_source", "late_sink", "file", "line", "ordinal", "func_id"]
    head = F.concat(F.lit("\n  // [SECURITY-RELEVANT: "), F.array_join("reasons", ", "), F.lit("]\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    rows = ordered_context(functions, selected).select(*order, head.alias("text"))
    place = F.concat(F.lit("\n--- FILE: "), F.coalesce("file", F.lit("")), F.lit(" ---\n"))
    w = W.orderBy(*order)
    short = rows.select(*order, F.length("text").alias("n")).orderBy(*order).limit(most + 1).withColumn("begins", ~F.col("file").eqNullSafe(F.lag("file").over(w)) | (F.row_number().over(w) == 1))
    sized = short.withColumn("n", F.col("n") + F.when(F.col("begins"), F.length(place)).otherwise(0))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + used
    kept = sized.withColumn("before", before).where(F.col("before") <= most).select("func_id", "begins")
    return rows.join(kept, "func_id").select("func_id", F.when(F.col("begins"), F.concat(place, "text")).otherwise(F.col("text")).alias("text"))


def reduction(full_chars: int, kept_chars: int) -> float:
    """Per cent of characters saved, to one decimal."""
    return round((1 - kept_chars / max(full_chars, 1)) * 100, 1) if full_chars else 0.0


def config_blocks(files: DataFrame, used: int = 0, most: int = MOST_CHARS) -> DataFrame:
    """path, text of the configuration files that still fit: one that does not is skipped and the next tried. files come from scan.config_files(),
    at most 20,000 characters in all, so one task holds them."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        total, kept = used, []
        for r in frame.sort_values("path").itertuples(index=False):
            text = f"\n--- CONFIG: {r.path} ---\n{r.content}\n"
            if total + len(text) < most:
                kept.append((r.path, text))
                total += len(text)
        return pd.DataFrame(kept, columns=["path", "text"])

    return files.select("path", "content", F.lit(1).alias("one")).groupBy("one").applyInPandas(fold, "path string, text string")
