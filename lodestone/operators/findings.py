"""Algebra of findings: predicates, risk, deduplication, numbering, prioritising."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..dims import ASSUMED_CONFIDENCE, LOCK_FILES, MERGE_EXEMPT, SEVERITIES, TEST_MARKS, by_severity, rank_of, score_of
from ..functions.text import basename, contains_any
from ..session import cut

NAMES = [s for s, _, _, _ in SEVERITIES]


def low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def confirmed(findings: DataFrame) -> DataFrame:
    return findings.where(~F.coalesce("is_false_positive", F.lit(False)))


def severity_counts(findings: DataFrame, by: list[str] = ()) -> DataFrame:
    """severity, n of confirmed findings with all five severities, for each value of `by` that occurs."""
    c = confirmed(findings).groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in NAMES])
    return c.select(*by, F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in NAMES])).alias("x")).select(*by, "x.severity", "x.n")


IDENTITY = ["title", "file_path", "line_number", "end_line", "severity"]


def unique_first(findings: DataFrame, keys: list[str] = IDENTITY) -> DataFrame:
    """The row with the smallest seq of each key; nulls are equal. An aggregate, so a hot key is combined map-side."""
    others = [c for c in findings.columns if c not in keys]
    return findings.groupBy(*keys).agg(F.min(F.struct("seq", *[c for c in others if c != "seq"])).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def risk_scores(findings: DataFrame, by: list[str] = ()) -> DataFrame:
    """risk_score (0 to 10) and unique_findings of confirmed findings, for each value of `by`.

    Weighted mean of severity scores by confidence, where none or less than 0 is replaced by the severity's assumed one and more than
    1 counts as 1; plus a volume boost of up to 2.
    """
    keys = [*by, *[k for k in IDENTITY if k not in by]]
    first = confirmed(findings).groupBy(*keys).agg(F.min(F.struct("seq", "confidence")).alias("r"))
    given = F.coalesce(F.col("r.confidence"), F.lit(0.0))
    conf = F.least(F.lit(1.0), F.when(given <= 0, by_severity(F.col("severity"), ASSUMED_CONFIDENCE, 0.70)).otherwise(given))
    sums = first.withColumn("c", conf).groupBy(*by).agg(F.sum(score_of(F.col("severity")) * F.col("c")).alias("weighted"), F.sum("c").alias("total"), F.count("*").alias("unique_findings"))
    score = F.when(F.col("total") > 0, F.least(F.lit(10.0), F.col("weighted") / F.col("total") + F.least(F.lit(2.0), F.log1p("unique_findings") * 0.8))).otherwise(0.0)
    return sums.select(*by, score.alias("risk_score"), "unique_findings")


# Predicates of the false-positive rules.


def is_test_file() -> Column:
    return contains_any(low("file_path"), TEST_MARKS)


def is_migration() -> Column:
    return F.contains(F.coalesce("file_path", F.lit("")), F.lit("/migrations/")) & F.coalesce(F.col("file_path").endswith(".py"), F.lit(False))


def is_config_file() -> Column:
    return basename(low("file_path")).isin("manage.py", "wsgi.py", "asgi.py", "conftest.py", "setup.py", "setup.cfg")


def is_lock_file() -> Column:
    return basename(low("file_path")).isin(LOCK_FILES)


def is_dependency_cve() -> Column:
    return contains_any(low("title"), ["cve-", "vulnerable dependency"]) | F.coalesce(F.col("source").isin("trivy", "npm_audit"), F.lit(False))


# Query calls that bind their parameters.
_SAFE_QUERIES = [
    ".objects.filter(", ".objects.get(", ".objects.create(", ".objects.all()", ".objects.exclude(", ".objects.values(", ".objects.annotate(", ".objects.aggregate(", ".objects.count()", ".objects.first()", ".objects.last()", ".objects.exists()",
    ".objects.update(", ".objects.delete(", ".objects.bulk_create(", "model.findone(", "model.findall(", "model.create(", ".findbyid(", ".findbypk(", ".where(", "session.query(", "session.add(", "session.commit(",
]
_TYPED_QUERIES = ["prisma.", "findunique", "findfirst", "findmany", "create(", "update(", "delete(", "upsert(", "aggregate(", "groupby("]


def is_safe_query() -> Column:
    about = contains_any(low("title"), ["sql", "injection"]) | F.contains(low("cwe_id"), F.lit("cwe-89"))
    return about & contains_any(F.concat(low("code_snippet"), low("description")), _SAFE_QUERIES)


# Words that the framework rule looks for.
_UPLOAD_CODE = ["file.name", "file_name", "filename", "upload", "originalname", "extension", "ext", "formdata", "multipart", "buffer", "writefile", "write_file", "savefile", "save_file"]
_BYPASS = ["otp", "fallback", "bypass", "dev-", "test-", "111111", "123456", "000000", "hardcoded otp", "hardcoded password", "hardcoded token", "auth bypass", "authentication bypass", "dev backdoor", "fallback code", "fallback otp"]
_DEFAULTS = [", '", ', "', "default=", "default ='", 'default ="', "fallback", "or '", 'or "']
_FROM_ENV = ["process.env", "os.environ", "os.getenv(", "config(", "from env", "from @shared/config/env", "environment variable", "env var"]
_SETTINGS = ["const ", "constant", "config", "env_type", "switch", "local_url", "dev_url", "prod_url", "base_url"]
_NOTHING_FOUND = ["no vulnerabilit", "not vulnerable", "none found", "no issues found", "no findings found", "not applicable", "— no ", "- no ", "no evident", "no direct", "no injection", "no command injection", "no code execution", "properly validated", "correctly implemented"]


def is_safe_framework() -> Column:
    """Ordered early exits as one CASE; each line is one exit."""
    code, desc, title, path, cwe = low("code_snippet"), low("description"), low("title"), low("file_path"), low("cwe_id")
    has = contains_any
    typed = has(code, _TYPED_QUERIES) | has(desc, _TYPED_QUERIES)
    no_request = ~has(code, ["req.", "request."])
    secret = has(title, ["secret", "hardcoded"])
    env = has(code, _FROM_ENV) | has(desc, _FROM_ENV) | F.contains(title, F.lit("jwt")) & (F.contains(code, F.lit("env")) | F.contains(desc, F.lit("environment")))
    return (
        F.when(has(title, ["cve-", "vulnerable dependency"]), False)
        .when((F.coalesce("confidence", F.lit(0.0)) >= 0.95) & F.col("source").isin("semgrep", "pattern_scanner"), False)
        .when(F.col("source").isin("trivy", "npm_audit") & F.contains(F.coalesce("owasp_category", F.lit("")), F.lit("A06:2021")), False)
        .when(F.contains(title, F.lit("injection")) & typed, True)
        .when((F.contains(title, F.lit("prototype pollution")) | F.contains(cwe, F.lit("cwe-1321"))) & typed, True)
        .when((F.contains(title, F.lit("path traversal")) | F.contains(cwe, F.lit("cwe-22"))) & F.contains(code, F.lit("path.join(")) & no_request & ~has(code, _UPLOAD_CODE) & ~has(path, ["upload", "file", "media", "attachment", "asset"]), True)
        .when(secret & has(code, ["bcrypt", "argon2", "hashlib", "crypto.", "pbkdf2"]), True)
        .when(~(has(title, _BYPASS) | has(desc, _BYPASS)) & (secret | F.contains(cwe, F.lit("cwe-798"))) & ~has(code, _DEFAULTS) & env, True)
        .when((F.contains(title, F.lit("ssrf")) | F.contains(cwe, F.lit("cwe-918"))) & (has(code, _SETTINGS) | has(desc, _SETTINGS)) & no_request & ~F.contains(code, F.lit("user")), True)
        .when(F.contains(title, F.lit("hardcoded")) & F.contains(title, F.lit("url")) & (has(desc, ["config", "environment"]) | F.contains(code, F.lit("switch"))), True)
        .otherwise(has(title, _NOTHING_FOUND))
    )


def rule_filtered(findings: DataFrame) -> DataFrame:
    """findings with is_false_positive and false_positive_reason set by the first rule that holds; nothing is ever cleared."""
    cve = is_dependency_cve()
    reason = (
        F.when(~cve & is_test_file(), "test or example code")
        .when(~cve & is_migration(), "generated migration")
        .when(is_safe_query(), "query with bound parameters")
        .when(is_safe_framework(), "safe by the framework")
        .when(is_lock_file(), "tracked by the manifest")
    )
    out = findings.withColumn("_reason", reason)
    flag = F.col("_reason").isNotNull()
    return out.withColumns({"is_false_positive": flag | F.coalesce("is_false_positive", F.lit(False)), "false_positive_reason": F.coalesce("_reason", "false_positive_reason")}).drop("_reason")


def is_protected() -> Column:
    title = contains_any(low("title"), ["hardcoded", "otp", "bypass", "missing auth", "admin", "stack trace", "error.stack"])
    return (F.coalesce("confidence", F.lit(0.0)) >= 0.90) | (F.col("severity") == "CRITICAL") | F.coalesce(F.col("source").isin("trivy", "npm_audit"), F.lit(False)) | title


# Titles of reports that report nothing.
REJECTED = ["no vulnerabilit", "not vulnerable", "none found", "no issues found", "no findings found", "not applicable", "no issues identified", "no security issues", "properly validated", "correctly implemented", "analysis complete", "no concerns"]


def is_rejected_title() -> Column:
    title = contains_any(low("title"), REJECTED)
    return title | F.lower(F.trim(F.coalesce("file_path", F.lit("")))).isin("n/a", "", "none", "not applicable")


def default_confidence(findings: DataFrame) -> DataFrame:
    return findings.withColumn("confidence", F.when(F.col("confidence") == 0.0, 0.7).otherwise(F.col("confidence")))


# Deduplication for reports.


def relative_path(path: Column, target: Column) -> Column:
    """Path below the target, or below the first directory after `workspace/`, else as it is."""
    below = F.regexp_replace(F.substr(path, F.length(target) + 1), "^/+", "")
    after = F.regexp_extract(path, r"workspace/[^/]*/((?:(?!workspace/).)*)", 1)
    return F.when((target != "") & F.startswith(path, target), below).when(after != "", after).otherwise(path)


def cwe_number(cwe: Column) -> Column:
    found = F.upper(F.regexp_extract(cwe, r"(?i)(CWE-\d+)", 1))
    return F.when(F.coalesce(cwe, F.lit("")) == "", "").when(found != "", found).otherwise(F.upper(F.trim(cwe)))


def report_keys(path: Column) -> Column:
    """Keys of a finding; two findings that share one are the same for a report."""
    line, title = F.coalesce(F.col("line_number"), F.lit(0)).cast("string"), F.coalesce("title", F.lit(""))
    cve, cwe = F.regexp_extract(title, r"(CVE-\d{4}-\d+)", 1), cwe_number(F.col("cwe_id"))
    sep = F.lit("|")
    return F.array_compact(
        F.array(
            F.concat(F.lit("1|"), title, sep, path, sep, line),
            F.when(cve != "", F.concat(F.lit("2|"), cve, sep, path)),
            F.when((cwe != "") & (path != "") & ~basename(path).isin(MERGE_EXEMPT), F.concat(F.lit("3|"), cwe, sep, path, sep, line)),
            F.concat(F.lit("4|"), title, sep, path, sep, F.col("severity"), sep, line, sep, F.trim(F.substring(F.coalesce("description", F.lit("")), 1, 100))),
        )
    )


def report_groups(findings: DataFrame, target: str = "", most_rounds: int = 30) -> DataFrame:
    """seq, group (smallest seq) of findings linked by shared keys, over any number of steps.

    Labels travel from rows to keys and back as aggregates, so a key that many rows share is combined map-side; each round is cut
    through the checkpoint folder. Rounds follow the longest chain of links, which is short since every key holds the path.
    """
    path = relative_path(F.coalesce("file_path", F.lit("")), F.lit(target))
    links = cut(findings.select("seq", F.explode(report_keys(path)).alias("k")).select("seq", F.xxhash64("k").alias("k")).distinct())
    labels, before = links.groupBy("k").agg(F.min("seq").alias("l")), None
    for _ in range(most_rounds):
        rows = links.join(labels, "k").groupBy("seq").agg(F.min("l").alias("group"))
        labels = cut(links.join(rows, "seq").groupBy("k").agg(F.min("group").alias("l")))
        now = labels.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return links.join(labels, "k").groupBy("seq").agg(F.min("l").alias("group"))
        before = now
    raise RuntimeError(f"groups did not settle in {most_rounds} rounds")


def report_unique(findings: DataFrame, target: str = "") -> DataFrame:
    """Strict report deduplication: of each group the row with the highest confidence, then with a remediation, then the most severe, then
    the first; independent of the order of rows, and idempotent."""
    groups = report_groups(findings, target)
    has = F.coalesce(F.trim("remediation") != "", F.lit(False)).cast("int")
    rank = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("a"), (-has).alias("b"), rank_of(F.col("severity")).alias("c"), "seq")
    best = findings.join(groups, "seq").groupBy("group").agg(F.min(rank).alias("r")).select(F.col("r.seq").alias("seq"))
    return findings.join(best, "seq", "left_semi")


def report_fold(findings: DataFrame, target: str = "") -> DataFrame:
    """Order-dependent report deduplication: rows in order of seq, a row whose first known key was seen replaces the row behind it if it is
    better in any respect, else is dropped. Gives the kept rows and slot_seq, the seq whose place they take.

    Rows of different groups never meet, so each group is folded on its own. A group is what one report holds of one defect; the strict
    form is the one for unbounded input.
    """
    path = relative_path(F.coalesce("file_path", F.lit("")), F.lit(target))
    rows = findings.select("seq", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("remediation", F.lit("")).alias("remediation"), F.coalesce("remediation_code", F.lit("")).alias("remediation_code"), score_of(F.col("severity")).alias("score"), report_keys(path).alias("keys"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        seen: dict[str, list] = {}
        slots: list[list] = []
        for r in frame.sort_values("seq").itertuples(index=False):
            holder = next((seen[k] for k in r.keys if k in seen), None)
            if holder is None:
                slot = [r, r.seq]
                slots.append(slot)
                for k in r.keys:
                    seen[k] = [r, slot]
                continue
            old, slot = holder
            if r.confidence > old.confidence or (r.remediation and not old.remediation) or (r.remediation_code and not old.remediation_code) or r.score > old.score:
                if slot[0] is old:
                    slot[0] = r
                for k in r.keys:
                    seen[k] = [r, slot]
        return pd.DataFrame({"seq": [s[0].seq for s in slots], "slot_seq": [s[1] for s in slots]})

    kept = rows.join(report_groups(findings, target), "seq").groupBy("group").applyInPandas(fold, "seq long, slot_seq long")
    return findings.join(kept, "seq")


# Order and numbers.


def numbered(findings: DataFrame, order: list[Column], out: str = "index") -> DataFrame:
    """Adds the 1-based place in the given total order, without moving all rows into one task: a range partitioning, a count for each
    range, and the offsets of the ranges (one number for each shuffle partition, so of bounded size) joined back."""
    parts = int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = findings.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())
    placed = ranged.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    placed = cut(placed)
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.select("_p", (F.sum("_c").over(W.orderBy("_p")) - F.col("_c")).alias("_before"))
    return placed.join(F.broadcast(before), "_p").withColumn(out, F.col("_n") + F.col("_before")).drop("_p", "_n", "_before")


def report_index(findings: DataFrame) -> DataFrame:
    """Global report number: by severity, then input order."""
    return numbered(confirmed(findings), [rank_of(F.col("severity")), F.col("seq")], "report_index")


def batches(findings: DataFrame, size: int = 25) -> DataFrame:
    """index (from 1, input order) and batch_no (from 0) of rows to be validated."""
    return numbered(findings, [F.col("seq")], "index").withColumn("batch_no", F.floor((F.col("index") - 1) / size))


def top_by_score(findings: DataFrame, n: int = 5) -> DataFrame:
    return confirmed(findings).orderBy(score_of(F.col("severity")).desc(), "seq").limit(n)


def priority_fixes(findings: DataFrame, n: int = 5) -> DataFrame:
    return confirmed(findings).where(F.col("severity").isin("CRITICAL", "HIGH")).orderBy(rank_of(F.col("severity")), "seq").limit(n)


def to_verify(findings: DataFrame, n: int = 25) -> DataFrame:
    """The first n unflagged findings of each of two priorities: critical and high, the rest. Two top-k selections, no window."""
    open_ = confirmed(findings)
    urgent = F.col("severity").isin("CRITICAL", "HIGH")
    return open_.where(urgent).orderBy("seq").limit(n).withColumn("priority", F.lit(1)).unionByName(open_.where(~urgent).orderBy("seq").limit(n).withColumn("priority", F.lit(2)))


def by_file(findings: DataFrame) -> DataFrame:
    """file_path with its number of findings and the severities met."""
    return findings.groupBy("file_path").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.array_join(F.array_sort(F.collect_set("severity")), ",").alias("severities"))


def merged(*parts: DataFrame) -> DataFrame:
    """Bag union by column name; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
