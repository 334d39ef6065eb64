"""Paths: which spellings name the same file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip


def spelled(path: Column) -> Column:
    """Lower case, forward slashes, no repeated slash, no outer blanks."""
    return F.regexp_replace(F.lower(strip(path)), r"[\\/]+", "/")


def with_file_key(df: DataFrame, scans: DataFrame, path: str = "file_path", out: str = "file_key") -> DataFrame:
    """df with the key of the file that `path` names; null paths get a null key.

    Whatever precedes the project directory (any scans.target_path; the leftmost if several occur) is dropped; a path without
    one keeps its whole spelling. Only distinct spellings are exploded and joined, so the cost beside one narrow join follows
    the number of different paths. Neither side is broadcast by hint: the list of projects grows with the data. The join keeps
    the rows on the left, so AQE may split a hot path.
    """
    p = f"{out}__spelled"
    rows = df.withColumn(p, spelled(F.col(path)))
    parts = F.split(F.col(p), "/")
    targets = scans.select(F.element_at(F.filter(F.split(spelled(F.col("target_path")), "/"), lambda x: x != ""), -1).alias("seg")).where("seg is not null").distinct()
    spelt = rows.where(F.col(p).isNotNull()).select(p).distinct()
    first = spelt.select(p, F.posexplode(parts).alias("pos", "seg")).join(targets, "seg").groupBy(p).agg(F.min("pos").alias("pos"))
    keyed = first.select(p, F.array_join(F.slice(parts, F.col("pos") + 1, F.size(parts)), "/").alias(out))
    return rows.join(keyed, p, "left").withColumn(out, F.coalesce(out, p)).drop(p)
