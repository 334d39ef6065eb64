"""Problem 1: new batches against all history, through a stored index of string segments.

Two reports are the same if their ids agree, or if they are about the same file with agreeing titles: the same numbers, and at
least half of all distinct trigrams of the normalised titles in common.

The index is a folder with three tables, each in partitions by a hash of its key:

* ids: id_key, arrival (the earliest).
* titles: file_key, nums, title_key, arrival; one row for equal titles of a file, so repeated rows cost nothing.
* segments: each title of length n cut into EDITS + 1 even segments, stored by (file_key, nums, n, segment number, segment).

deliver() holds a batch against a stored index and appends the batch to it. It reads only the partitions that the batch's ids and
files hash to, so its cost follows the batch; a hot file is split over several files of its partition.

Edit path. A title within EDITS edits of a stored one holds one of its segments whole; at which places follows from both lengths and
the number of edits that can lie before and behind it. The probe makes just these substrings, looks them up, and verifies candidates
with the bounded levenshtein(), then by trigrams.

Phrase path. Titles also agree when one has a phrase more ("... in save_form()") or its words in another order, which no edit bound of
use covers. What ids and edits leave unknown is therefore held against the stored titles of its files by shared trigrams. Every trigram
covers one of the m aligned two-character segments whole, and a segment lies in two trigrams at most. If A has a distinct trigrams, an
agreeing title shares at least ceil(a/2) of them, so it holds at least ceil(ceil(a/2)/2) of A's segments, and by the pigeonhole principle
one of any m - that + 1 of them: those with the rarest letters are made, for the files at hand only. Nothing is lost.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import with_file_key
from ..functions.text import key_or_null
from ..session import checkpoint_dir, cut

#: Edits that the segment index covers; a title has one segment more.
EDITS = 2
#: Partitions of each table of an index; also the most partition numbers that a delivery gathers.
BUCKETS = 32
#: Letters from frequent to rare, and what they are replaced by so that ascending order puts the rare first.
_FREQUENT_FIRST = " etaoinsrhldcumfpgwybvkxjqz0123456789"
_RANKS = "".join(chr(126 - i) for i in range(len(_FREQUENT_FIRST)))
#: Arrival of rows that were there before the first batch.
HISTORY = -1
#: Tables of an index and the column that partitions are made of.
TABLES = {"ids": "id_key", "titles": "file_key", "segments": "file_key"}


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def numbers(title: Column) -> Column:
    return F.array_join(F.array_sort(F.regexp_extract_all(title, F.lit("[0-9]+"), F.lit(0))), ",")


def _grams(t: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(t) - F.lit(n - 1))
    return F.when(F.length(t) >= n, F.array_distinct(F.transform(starts, lambda i: F.substr(t, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def keyed_reports(df: DataFrame, scans: DataFrame, arrival: Column) -> DataFrame:
    """seq, arrival, id_key, file_key, title_key, nums of each report."""
    picked = df.select("seq", arrival.cast("long").alias("arrival"), key_or_null(F.col("finding_id")).alias("id_key"), "file_path", normal_title(F.col("title")).alias("title_key"), numbers(F.col("title")).alias("nums"))
    return with_file_key(picked, scans).drop("file_path")


def _titles(rows: DataFrame) -> DataFrame:
    """One entry for each different title of a file, with its earliest arrival. Titles under three characters have no trigram and never agree."""
    return rows.where("file_key is not null and length(title_key) >= 3").groupBy("file_key", "nums", "title_key").agg(F.min("arrival").alias("arrival"))


def _spread(titles: DataFrame) -> DataFrame:
    """Over all partitions: titles are few bytes, which AQE would put into few tasks, but each makes dozens of entries."""
    # Keys in another order than the aggregate's: else the planner drops the step as done already.
    return titles.repartition(int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions")), "title_key", "nums", "file_key")


def _start(n: Column, number: Column) -> Column:
    """0-based place at which a segment of a text of length n begins."""
    return F.floor(number * n / (EDITS + 1)).cast("int")


def stored_segments(titles: DataFrame) -> DataFrame:
    """file_key, nums, title_key, arrival, n, number, segment of titles that are long enough to be cut."""
    n, i = F.col("n"), F.col("number")
    cuts = titles.withColumn("n", F.length("title_key")).where(n > EDITS).select("*", F.explode(F.sequence(F.lit(0), F.lit(EDITS))).alias("number"))
    return cuts.withColumn("segment", F.substr("title_key", _start(n, i) + 1, _start(n, i + 1) - _start(n, i)))


def probed_segments(titles: DataFrame) -> DataFrame:
    """file_key, nums, probe, n, number, segment: for each length within EDITS and each segment number the substrings that can be that segment.

    Of the edits at most `number` can lie before a segment and EDITS - number behind it (else an earlier or a later segment is whole too), so
    it begins within `number` of its place, and within EDITS - number of its place moved by the difference of the lengths.
    """
    n, i, d = F.col("n"), F.col("number"), F.col("own") - F.col("n")
    lengths = titles.select("file_key", "nums", F.col("title_key").alias("probe"), F.length("title_key").alias("own"))
    each = lengths.select("*", F.explode(F.sequence(F.greatest(F.lit(EDITS + 1), F.col("own") - EDITS), F.col("own") + EDITS)).alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.lit(EDITS))).alias("number"))
    wide = _start(n, i + 1) - _start(n, i)
    low = F.greatest(F.lit(0), _start(n, i) - i, _start(n, i) + d - (EDITS - i))
    high = F.least(F.col("own") - wide, _start(n, i) + i, _start(n, i) + d + (EDITS - i))
    placed = each.withColumns({"low": low, "high": high, "wide": wide}).where("low <= high")
    return placed.select("file_key", "nums", "probe", "n", "number", F.explode(F.transform(F.sequence("low", "high"), lambda p: F.substr("probe", p + 1, F.col("wide")))).alias("segment")).distinct()


def index_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of an index over keyed_reports()."""
    titles = _titles(rows)
    return {"ids": rows.where("id_key is not null").groupBy("id_key").agg(F.min("arrival").alias("arrival")), "titles": titles, "segments": stored_segments(titles)}


def _bucket(table: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(TABLES[table]), F.lit(buckets)).cast("int")


def append_index(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Add keyed reports to the index at path, or begin one; nothing stored is read or rewritten. A hot partition is written by several tasks."""
    for name, df in index_tables(rows).items():
        df.withColumn("bucket", _bucket(name, buckets)).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/{name}")


def read_index(path: str, new: DataFrame, buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """The tables of a stored index, only the partitions that the keys of new (keyed reports) hash to. At most `buckets` numbers a table come to the driver."""
    out, shapes = {}, index_tables(new)
    for name, key in TABLES.items():
        at = [r.b for r in new.where(F.col(key).isNotNull()).select(_bucket(name, buckets).alias("b")).distinct().collect()]
        stored = new.sparkSession.read.schema(shapes[name].withColumn("bucket", F.lit(0)).schema).parquet(f"{path}/{name}")
        out[name] = stored.where(F.col("bucket").isin(at) if at else F.lit(False)).drop("bucket")
    return out


def _agree(a: str, b: str) -> Column:
    x, y = _grams(F.col(a), 3), _grams(F.col(b), 3)
    return F.size(F.array_intersect(x, y)) * 3 >= F.size(x) + F.size(y)


def _by_edits(probes: DataFrame, segments: DataFrame) -> DataFrame:
    """file_key, nums, title_key, first: earliest arrival of a stored title within EDITS edits that agrees."""
    pairs = probed_segments(_spread(probes)).join(segments, ["file_key", "nums", "n", "number", "segment"]).where(f"probe != title_key and levenshtein(probe, title_key, {EDITS}) >= 0")
    agreed = pairs.groupBy("file_key", "nums", "probe", "title_key").agg(F.min("arrival").alias("arrival")).where(_agree("probe", "title_key"))
    return agreed.groupBy("file_key", "nums", F.col("probe").alias("title_key")).agg(F.min("arrival").alias("first"))


def _by_phrases(probes: DataFrame, titles: DataFrame) -> DataFrame:
    """file_key, nums, title_key, first: earliest arrival of a stored title that agrees, by shared pieces of two characters."""
    t = F.col("title_key")
    grams = F.size(_grams(t, 3))
    m = F.floor(F.length(t) / 2).cast("int")
    need = F.ceil(F.ceil(grams / 2) / 2).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.substr(t, i * 2 + 1, F.lit(2)))
    rare = F.array_sort(F.transform(cuts, lambda s: F.struct(F.translate(s, _FREQUENT_FIRST, _RANKS).alias("r"), s.alias("s"))))
    kept = F.array_distinct(F.transform(F.slice(rare, F.lit(1), m - need + 1), lambda x: x["s"]))
    places = probes.select("file_key", "nums").distinct()
    near = titles.join(places, ["file_key", "nums"], "left_semi").groupBy("file_key", "nums", "title_key").agg(F.min("arrival").alias("arrival"))
    made = _spread(near).select("file_key", "nums", "title_key", "arrival", grams.alias("grams"), F.explode(kept).alias("segment"))
    asked = _spread(probes).select("file_key", "nums", t.alias("probe"), grams.alias("probe_grams"), F.explode(_grams(t, 2)).alias("segment"))
    pairs = asked.join(made, ["file_key", "nums", "segment"]).where("probe != title_key and grams <= 2 * probe_grams and probe_grams <= 2 * grams")
    agreed = pairs.groupBy("file_key", "nums", "probe", "title_key").agg(F.min("arrival").alias("arrival")).where(_agree("probe", "title_key"))
    return agreed.groupBy("file_key", "nums", F.col("probe").alias("title_key")).agg(F.min("arrival").alias("first"))


def deliver(batch: DataFrame, scans: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """seq of each row of a batch that the index at path or an earlier row of the batch already holds; the batch is then appended to the index.

    Null or blank ids agree with nothing, neither do null paths, null titles and titles under three characters. Of repeated rows in
    the batch the one with the smallest seq is new. An empty batch gives an empty result; other columns are ignored.
    """
    new = cut(keyed_reports(batch, scans, F.col("seq")))
    stored, own = read_index(path, new, buckets), index_tables(new)
    every = {n: stored[n].unionByName(own[n]) for n in TABLES}
    key = ["file_key", "nums", "title_key"]
    ids = every["ids"].join(new.where("id_key is not null").select("id_key").distinct(), "id_key", "left_semi").groupBy("id_key").agg(F.min("arrival").alias("first_id"))
    probes = own["titles"].drop("arrival")
    same = every["titles"].join(probes, key, "left_semi").select(*key, F.col("arrival").alias("first")).unionByName(_by_edits(probes, every["segments"])).groupBy(*key).agg(F.min("first").alias("first_title"))
    seen = new.join(ids, "id_key", "left").join(same, key, "left")
    known = F.coalesce(F.col("first_id") < F.col("arrival"), F.lit(False)) | F.coalesce(F.col("first_title") < F.col("arrival"), F.lit(False))
    seen = cut(seen.select("seq", "arrival", *key, known.alias("known")))
    left = seen.where("not known and file_key is not null and length(title_key) >= 3").select("seq", "arrival", *key)
    late = left.join(_by_phrases(left.select(*key).distinct(), every["titles"]), key).where("first < arrival").select("seq")
    append_index(new, path, buckets)
    return seen.where("known").select("seq").unionByName(late).distinct()


def known_reports(batches: DataFrame, history: DataFrame, scans: DataFrame) -> DataFrame:
    """seq of each batch row that history or an earlier batch row already holds: an index of history is begun in the checkpoint folder,
    and the batches delivered to it. Where an index is kept between runs, call append_index() once and deliver() for each batch."""
    path = f"{checkpoint_dir(batches.sparkSession)}/known-{uuid.uuid4().hex}"
    append_index(cut(keyed_reports(history, scans, F.lit(HISTORY))), path)
    return deliver(batches, scans, path)
