"""Small operators on stored tables: look-ups, insertions, updates, counts, run totals, shortcuts of incremental scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tables that views() registers.
VIEWS = ["findings", "finding_batches", "scans", "function_symbols", "edges", "snapshot_files", "documents"]


def views(spark: SparkSession, folder: str, names: list[str] = VIEWS) -> None:
    """Temporary views that pass the parquet tables of a folder through, so that SQL reads them by name; filters reach the scans."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def inserted(rows: DataFrame, path: str) -> None:
    """Append rows to a stored table."""
    rows.write.mode("append").parquet(path)


def updated(current: DataFrame, changes: dict[str, Column], where: Column) -> DataFrame:
    """current with columns changed in the rows that fit; a null condition fits no row."""
    hit = F.coalesce(where, F.lit(False))
    return current.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def counted(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: n of all rows, of each condition the number of rows that fit and whether there is one."""
    per = [x for name, c in conditions.items() for x in (F.count_if(c).alias(name), F.coalesce(F.bool_or(c), F.lit(False)).alias(f"any_{name}"))]
    return df.agg(F.count("*").alias("n"), *per)


def run_totals(validated: DataFrame) -> DataFrame:
    """One row: total, kept, removed and fixed rows of validated findings."""
    return validated.agg(F.count("*").alias("total"), F.count_if(~F.col("removed")).alias("kept"), F.count_if("removed").alias("removed"), F.count_if("fixed").alias("fixed"))


def usage_totals(calls: DataFrame, by: list[str] = ()) -> DataFrame:
    """calls, prompt and completion tokens and their sum of calls(prompt_tokens, completion_tokens); nulls count as none."""
    p, c = F.coalesce(F.sum("prompt_tokens"), F.lit(0)), F.coalesce(F.sum("completion_tokens"), F.lit(0))
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), p.alias("prompt_tokens"), c.alias("completion_tokens"), (p + c).alias("total_tokens"))


def listed_by_file(findings: DataFrame) -> DataFrame:
    """file_path, seqs of its findings in order of seq. A list is as long as its file has findings: for stores that keep them so."""
    return findings.groupBy("file_path").agg(F.array_sort(F.collect_list("seq")).alias("seqs"))


def sorted_paths(files: DataFrame) -> DataFrame:
    return files.select("path").distinct().orderBy("path")


def untracked(lines: DataFrame) -> DataFrame:
    """rel_path of captured output lines (value), stripped, without empty ones."""
    return lines.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("rel_path")).where("rel_path != ''")


def all_cached(findings: DataFrame, diff: DataFrame) -> DataFrame:
    """The stored findings if no file changed, else no row: what a scan answers without work."""
    touched = diff.where("status != 'same'").limit(1).select(F.lit(1).alias("_one"))
    return findings.withColumn("_one", F.lit(1)).join(F.broadcast(touched), "_one", "left_anti").drop("_one")


def changed_context(files: DataFrame, diff: DataFrame, most: int = 200_000) -> DataFrame:
    """path, chars of the added and changed files in order of path, while the running total before a file is below `most`.

    Only paths and lengths are ordered; files without text are left out, so the first `most` rows are enough.
    """
    touched = diff.where("status in ('added', 'changed')").select(F.col("rel_path").alias("path")).distinct()
    sized = files.join(touched, "path", "left_semi").select("path", F.length("content").alias("chars")).where("chars > 0").orderBy("path").limit(most)
    before = F.coalesce(F.sum("chars").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("before", before).where(F.col("before") < most).select("path", "chars")


def slug(text: Column, n: int = 12) -> Column:
    """A short stable name for a folder."""
    return F.substring(F.sha1(text), 1, n)


def chain_order(chains: DataFrame, n: int) -> DataFrame:
    """The first n described chains: those with a source first, then the shorter, then by sink and path; with their place."""
    order = [F.col("has_source").desc(), "length", "sink_id", "path"]
    return chains.orderBy(*order).limit(n).withColumn("place", F.row_number().over(W.orderBy(*order)))


def durations(scans: DataFrame) -> DataFrame:
    """scan_id, seconds (null while unfinished), started as text in UTC of scans in epoch seconds."""
    took = F.when(F.col("scan_end") > 0, F.col("scan_end") - F.col("scan_start"))
    return scans.select("scan_id", took.alias("seconds"), F.date_format(F.timestamp_seconds(F.floor("scan_start")), "yyyy-MM-dd HH:mm:ss").alias("started"))


def first_of_each(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each key: a cap on what is shown of a kind. A rank filter that the planner turns into a limit for each group."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("_n") <= n).drop("_n")
