"""Source trees and prompt texts as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import EXTENSIONS
from ..operators.scan import selected


def files(spark: SparkSession, root: str, names: str = "*") -> DataFrame:
    """path (below root), content (UTF-8, broken bytes replaced), sha256 and size of the files below root whose name fits the glob: others
    are left out when the folder is listed and never opened."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.substring_index(F.col("path"), base + "/", -1), "^/+", "")
    return raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """The selected files; only names with a supported suffix are opened."""
    return selected(files(spark, root, "*{" + ",".join(EXTENSIONS) + "}"))


def method_texts(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """name, text of wanted(name) Markdown files; a missing one gives its notice."""
    have = spark.read.text(f"{root}/*.md", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    return wanted.join(have, "name", "left").withColumn("text", F.coalesce("text", F.concat(F.lit("Skill "), "name", F.lit(" not found."))))


# Query parameters that hold secrets.
_SECRET_PARAMETERS = "token|access_token|auth|auth_token|key|api_key|apikey|secret|password|passwd|pwd|private_token|client_secret"


def sanitised_url(url: Column) -> Column:
    """A URL without user name, password, secret parameters and fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^([A-Za-z][\w+.-]*://)[^/@]*@", "$1"), "#.*$", "")
    kept = F.regexp_replace(bare, rf"(?i)(?<=[?&])(?:{_SECRET_PARAMETERS})=[^&]*&?", "")
    return F.regexp_replace(kept, "[?&]$", "")


def is_git_url(url: Column) -> Column:
    return F.regexp_like(url, F.lit(r"^(?:https?://|git@|ssh://|git://)"))
