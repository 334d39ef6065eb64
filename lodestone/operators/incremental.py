"""Snapshots, carry-forward, upserts and message logs: incremental batch without a table format."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _one_each(snapshot: DataFrame) -> DataFrame:
    return snapshot.where("rel_path is not null").groupBy("rel_path").agg(F.max("sha256").alias("sha256"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """rel_path, status (added, removed, changed, same) of two snapshots (rel_path, sha256); repeated rows count once, by the largest hash."""
    o, n = _one_each(old).select("rel_path", F.col("sha256").alias("old")), _one_each(new).select("rel_path", F.col("sha256").alias("new"))
    both = o.withColumn("was", F.lit(True)).join(n.withColumn("now", F.lit(True)), "rel_path", "full_outer")
    return both.select("rel_path", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("same").alias("status"))


def diff_summary(d: DataFrame) -> DataFrame:
    return d.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "changed", "removed", "same")])


def with_untracked(d: DataFrame, untracked: DataFrame) -> DataFrame:
    """Adds untracked paths as added, where the diff does not know them."""
    return d.unionByName(untracked.select("rel_path").distinct().join(d, "rel_path", "left_anti").withColumn("status", F.lit("added")))


def carried(findings: DataFrame, d: DataFrame, path: str = "file_path") -> DataFrame:
    """Findings of files that the diff does not call added, changed or removed."""
    touched = d.where("status != 'same'").select(F.col("rel_path").alias(path))
    return findings.join(touched, path, "left_anti")


def carried_forward(cached: DataFrame, fresh: DataFrame, d: DataFrame, path: str = "file_path") -> DataFrame:
    return carried(cached, d, path).unionByName(fresh, allowMissingColumns=True)


def is_warm(findings: DataFrame | None, hashes: DataFrame | None) -> bool:
    return any(x is not None and not x.isEmpty() for x in (findings, hashes))


VERSION = 2


def save_snapshot(spark: SparkSession, root: str, **tables: DataFrame) -> str:
    """Write tables into a new folder below root and switch a pointer file to it: readers see the old state or the new one whole."""
    at = f"{root}/v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{at}/{name}")
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    tmp = path(f"{root}/.current-{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps({"version": VERSION, "at": at, "tables": sorted(tables)}), "utf-8"))
    out.close()
    fs.delete(path(f"{root}/current.json"), False)
    fs.rename(tmp, path(f"{root}/current.json"))
    return at


def load_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the current snapshot; empty if there is none, or one of another version, or a broken pointer (a cold start)."""
    try:
        state = json.loads("".join(r.value for r in spark.read.text(f"{root}/current.json").collect()))
        if state["version"] != VERSION:
            return {}
        return {n: spark.read.parquet(f"{state['at']}/{n}") for n in state["tables"]}
    except Exception:  # noqa: BLE001 - whatever is wrong with the state, a scan starts cold
        return {}


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], order: Column | str, counter: str | None = None) -> DataFrame:
    """current with changes applied by key: the change latest by `order` wins; `counter` grows by one for each change (a new key starts with their number).

    Changes are reduced to one row a key before they meet the table.
    """
    o = F.col(order) if isinstance(order, str) else order
    values = [c for c in current.columns if c not in keys and c != counter]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), o).alias("_new"), F.count("*").alias("_n"))
    joined = current.withColumn("_old", F.struct(*values)).join(last, keys, "full_outer")
    picked = F.coalesce("_new", "_old")
    out = joined.select(*keys, *[picked[c].alias(c) for c in values], *([(F.coalesce(counter, F.lit(0)) + F.coalesce("_n", F.lit(0))).alias(counter)] if counter else []))
    return out.select(current.columns)


def deleted(current: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(ids.select(*keys).distinct(), keys, "left_anti")


def cleaned(state: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """State rows that still have a report."""
    return state.join(reports.select(*keys).distinct(), keys, "left_semi")


def latest_messages(messages: DataFrame, n: int = 1000, receiver: str | None = None) -> DataFrame:
    """The last n messages, or those of them that reach a receiver directly or by `all`. A top-k, no window."""
    last = messages.orderBy(F.desc("seq")).limit(n)
    return last if receiver is None else last.where(F.col("receiver").isin(receiver, "all"))


def digest(kind: Column, text: Column, items: Column) -> Column:
    """Bounded view of a remembered value: strings to 2000 characters, lists by count and the first five to 200, maps to 500, others not at all."""
    shown = F.array_join(F.transform(F.slice(items, 1, 5), lambda x: F.substring(x, 1, 200)), "; ")
    return F.when(kind == "string", F.substring(text, 1, 2000)).when(kind == "list", F.concat(F.size(items).cast("string"), F.lit(" items: "), shown)).when(kind == "map", F.substring(text, 1, 500))


def name_status(lines: DataFrame, split_renames: bool = False) -> DataFrame:
    """status, path of captured `git diff --name-status` lines (value): A added, D removed, M, R and C changed; others are left out.

    A rename keeps `old<TAB>new` as its path; with split_renames it gives the old path as removed and the new one as added.
    """
    code, rest = F.substring("value", 1, 1), F.regexp_extract("value", r"^[^\t]*\t(.*)$", 1)
    status = F.when(code == "A", "added").when(code == "D", "removed").when(code.isin("M", "R", "C"), "changed")
    out = lines.where(F.contains("value", F.lit("\t"))).select(status.alias("status"), code.alias("code"), rest.alias("path")).where("status is not null")
    if not split_renames:
        return out.select("status", "path")
    old, new = F.get(F.split("path", "\t"), F.lit(0)), F.get(F.split("path", "\t"), F.lit(1))
    moved = out.where("code = 'R'").select(F.explode(F.array(F.struct(F.lit("removed").alias("status"), old.alias("path")), F.struct(F.lit("added").alias("status"), new.alias("path")))).alias("x")).select("x.*")
    return out.where("code != 'R'").select("status", "path").unionByName(moved)
