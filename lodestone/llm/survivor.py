"""Problem 2: the best record of each group of redeliveries, by skyline layers of whole records.

The records of one id are points with three qualities: completeness (which of FIELDS are usable), trust (rank of the source) and recency
(found_at, of equals the smaller seq). A record dominates another that it equals or beats in all three. Layer 1 holds the undominated
records, layer 2 those that only layer 1 dominates, and so on. The surviving record is the first of layer 1 by the lexicographic
policy trust, recency; a field that it lacks is filled from layer 1, then from the layers behind it in turn, by the same policy within
a layer.

Completeness is compared in one of two ways. "fields": a record is at least as complete as another if it has all fields that the other
has. Then the best value by the policy over all records is always in layer 1: whatever dominates its record has the field too and
comes first by the policy. So this is the form that gives p2_found. "count": by the number of usable fields. Then a record with more
fields hides one that has the missing field, and later layers supply values (p2_layers).

Before anything is gathered, records of one id that agree in rank and usable fields are reduced to the most recent: it dominates the
rest, which have nothing to add. source_trust has a fixed number of ranks (12) and there are 16 sets of fields, so an id has at most 208
points, whatever the number of redeliveries; a hot id is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, key_or_null, usable

FIELDS = ("confidence", "cwe_id", "remediation", "source")
#: Rank of a null or unlisted source: after all others.
LAST_RANK = 2_000_000_000
_OLDEST = float("-inf")


def _candidate(name: str) -> Column:
    if name == "confidence":
        return F.coalesce((F.col(name) > 0) & (F.col(name) <= 1), F.lit(False))
    if name == "source":
        return F.col(name).isNotNull()
    return usable(F.col(name))


def layered(points: Column, completeness: str = "fields") -> Column:
    """points (array of struct rank, neg_at, seq, has) in their own order, each with its dominance layer."""
    empty = F.array().cast("array<struct<rank:int,neg_at:double,seq:bigint,has:int,layer:int>>")

    def add(acc: Column, p: Column) -> Column:
        def beats(q: Column) -> Column:
            # Points of acc come first by rank, so rank need not be compared.
            newer = (q["neg_at"] < p["neg_at"]) | (q["neg_at"] == p["neg_at"]) & (q["seq"] <= p["seq"])
            return newer & (q["has"].bitwiseAND(p["has"]) == p["has"] if completeness == "fields" else F.bit_count(q["has"]) >= F.bit_count(p["has"]))

        layer = F.coalesce(F.array_max(F.transform(F.filter(acc, beats), lambda q: q["layer"])), F.lit(0)) + 1
        return F.concat(acc, F.array(F.struct(p["rank"].alias("rank"), p["neg_at"].alias("neg_at"), p["seq"].alias("seq"), p["has"].alias("has"), layer.cast("int").alias("layer"))))

    return F.aggregate(points, empty, add)


def skylines(findings: DataFrame, trust: DataFrame, completeness: str = "fields") -> DataFrame:
    """finding_key, points (rank, neg_at, seq, has, layer in order of the policy) of each id on two rows or more; bit i of has: FIELDS[i] is usable."""
    ranks = trust.select(folded(F.col("source")).alias("trust_source"), F.col("trust_rank").cast("int").alias("trust_rank")).groupBy("trust_source").agg(F.min("trust_rank").alias("trust_rank"))
    at = F.coalesce(F.when(~F.isnan("found_at"), F.col("found_at")), F.lit(_OLDEST))
    has = sum((F.when(_candidate(f), F.lit(1 << i)).otherwise(0) for i, f in enumerate(FIELDS)), F.lit(0))
    rows = findings.select(F.col("seq").alias("seq"), key_or_null(F.col("finding_id")).alias("finding_key"), folded(F.col("source")).alias("trust_source"), (-at).alias("neg_at"), has.alias("has")).where("finding_key is not null")
    ranked = rows.join(ranks, "trust_source", "left").withColumn("rank", F.coalesce("trust_rank", F.lit(LAST_RANK)))
    newest = ranked.groupBy("finding_key", "rank", "has").agg(F.count("*").alias("n"), F.min(F.struct("neg_at", "seq")).alias("p"))
    point = F.struct("rank", F.col("p.neg_at").alias("neg_at"), F.col("p.seq").cast("long").alias("seq"), "has")
    groups = newest.groupBy("finding_key").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(point)).alias("points")).where("n >= 2")
    return groups.select("finding_key", layered(F.col("points"), completeness).alias("points"))


def survivors(findings: DataFrame, trust: DataFrame, completeness: str = "fields") -> DataFrame:
    """finding_key, field_name, seq of the surviving value, layer it came from, for each id on two rows or more.

    Null or blank ids form no group; null found_at is oldest; NaN confidence is unusable; fields without a candidate give no row.
    """
    found = []
    for i, f in enumerate(FIELDS):
        holders = F.filter("points", lambda p: p["has"].bitwiseAND(F.lit(1 << i)) != 0)
        lowest = F.array_min(F.transform(holders, lambda p: p["layer"]))
        found.append(F.struct(F.lit(f).alias("field_name"), F.get(F.filter(holders, lambda p: p["layer"] == lowest), F.lit(0)).alias("w")))
    cells = skylines(findings, trust, completeness).select("finding_key", F.explode(F.array(*found)).alias("c")).where("c.w is not null")
    return cells.select("finding_key", "c.field_name", F.col("c.w.seq").alias("seq"), F.col("c.w.layer").alias("layer"))


def surviving_records(findings: DataFrame, trust: DataFrame, completeness: str = "fields") -> DataFrame:
    """One built record for each id: the surviving value of each field, in its own type, null where no delivery had one."""
    won = survivors(findings, trust, completeness).select("finding_key", "field_name", "seq")
    picked = won.join(findings.select("seq", *FIELDS), "seq")
    return picked.groupBy("finding_key").agg(*[F.max(F.when(F.col("field_name") == f, F.col(f))).alias(f) for f in FIELDS])
