"""Queries of the core operators over the test tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from .operators import findings as fnd
from .operators import graph, incremental, packed, protocol, report, scan, symbols, taint
from .operators import context as ctx
from .session import table
from .sources import code, tools
from .streaming import continuous

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# SQL text made of the same fixed lists.


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def holds(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(w)})" for w in words) + ")"


def one_of(words: list[str]) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def lower(c: str) -> str:
    return f"lower(coalesce({c}, ''))"


def cased(c: str, values: dict, other: object) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {lit(k)} THEN {v!r}" for k, v in values.items()) + f" ELSE {other!r} END"


BASE = "regexp_extract({c}, '([^/]*)$', 1)"
RANK = cased("severity", {s: r for s, _, r, _ in dims.SEVERITIES}, 9)
SCORE = cased("severity", {s: n for s, n, _, _ in dims.SEVERITIES}, 0)
CONFIRMED = "NOT coalesce(is_false_positive, false)"
BODY = lower("body")
TEXT = f"{BODY} || ' ' || coalesce(lower(array_to_string(calls, ' ')), '')"


def listed(text: str, words: list[str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains({text}, {lit(w.lower())}) THEN {lit(w)} END" for w in words) + "], lambda x: x IS NOT NULL), ',')"


FUNCTIONS = "functions AS (SELECT func_id, any_value(ordinal) AS ordinal, any_value(func_name) AS func_name, any_value(file) AS file, bool_or(is_sink) AS is_sink, bool_or(is_source) AS is_source, bool_or(has_sanitizer) AS has_sanitizer, bool_or(is_exported) AS is_exported FROM function_symbols GROUP BY func_id), edge AS (SELECT DISTINCT src_id, dst_id FROM edges WHERE src_id IS NOT NULL AND dst_id IS NOT NULL)"


def _f(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "findings")


def _sym(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "function_symbols")


def _edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "edges")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("file_path").alias("path"), F.col("text").alias("content"), "doc_id")


def _snippets(s: SparkSession, d: str) -> DataFrame:
    return _f(s, d).select(F.col("file_path").alias("path"), F.col("code_snippet").alias("content"))


# Problem 4.


@query()
def p4_found(s, d):
    return packed.split_values(packed.packed_findings(_f(s, d)))


# Findings.


@query(f"SELECT s.severity, coalesce(n, 0) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) s(severity) LEFT JOIN (SELECT severity, count(*) AS n FROM findings WHERE {CONFIRMED} GROUP BY 1) c USING (severity)")
def a1_severity_counts(s, d):
    return fnd.severity_counts(_f(s, d))


@query(f"SELECT scan_id, severity, count(f) AS n FROM (SELECT DISTINCT scan_id FROM findings WHERE {CONFIRMED}) i CROSS JOIN (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) s(severity) LEFT JOIN (SELECT scan_id AS f_scan, severity AS f_sev, 1 AS f FROM findings WHERE {CONFIRMED}) f ON f_scan IS NOT DISTINCT FROM scan_id AND f_sev = severity GROUP BY 1, 2")
def a1_severity_by_scan(s, d):
    return fnd.severity_counts(_f(s, d), ["scan_id"])


@query(f"""WITH u AS (SELECT scan_id, severity, coalesce(confidence, 0.0) AS given FROM findings WHERE {CONFIRMED} QUALIFY row_number() OVER (PARTITION BY scan_id, title, file_path, line_number, end_line, severity ORDER BY seq) = 1),
c AS (SELECT *, least(1.0, CASE WHEN given <= 0 THEN {cased("severity", dims.ASSUMED_CONFIDENCE, 0.7)} ELSE given END) AS c, {SCORE} AS w FROM u)
SELECT scan_id, round(least(10.0, sum(w * c) / sum(c) + least(2.0, ln(1 + count(*)) * 0.8)), 6) AS risk_score, count(*) AS unique_findings FROM c GROUP BY 1""")
def a2_risk_score(s, d):
    return fnd.risk_scores(_f(s, d), ["scan_id"]).withColumn("risk_score", F.round("risk_score", 6))


@query("SELECT seq FROM findings QUALIFY row_number() OVER (PARTITION BY title, file_path, line_number, end_line, severity ORDER BY seq) = 1")
def w1_unique_findings(s, d):
    return fnd.unique_first(_f(s, d)).select("seq")


@query(f"SELECT seq, {holds(lower('file_path'), dims.TEST_MARKS)} AS is_test, contains(coalesce(file_path, ''), '/migrations/') AND coalesce(file_path LIKE '%.py', false) AS is_migration, {BASE.format(c=lower('file_path'))} IN {one_of(dims.LOCK_FILES)} AS is_lock, {BASE.format(c=lower('file_path'))} IN ('manage.py', 'wsgi.py', 'asgi.py', 'conftest.py', 'setup.py', 'setup.cfg') AS is_config FROM findings")
def f11_path_flags(s, d):
    return _f(s, d).select("seq", fnd.is_test_file().alias("is_test"), fnd.is_migration().alias("is_migration"), fnd.is_lock_file().alias("is_lock"), fnd.is_config_file().alias("is_config"))


_SAFE_QUERY = f"({holds(lower('title'), ['sql', 'injection'])} OR contains({lower('cwe_id')}, 'cwe-89')) AND {holds(lower('code_snippet') + ' || ' + lower('description'), fnd._SAFE_QUERIES)}"
_T, _C, _D, _W, _P = lower("title"), lower("code_snippet"), lower("description"), lower("cwe_id"), lower("file_path")
_TYPED = f"({holds(_C, fnd._TYPED_QUERIES)} OR {holds(_D, fnd._TYPED_QUERIES)})"
_NO_REQ = f"NOT {holds(_C, ['req.', 'request.'])}"
_ENV = f"({holds(_C, fnd._FROM_ENV)} OR {holds(_D, fnd._FROM_ENV)} OR (contains({_T}, 'jwt') AND (contains({_C}, 'env') OR contains({_D}, 'environment'))))"
_SAFE_FRAMEWORK = f"""CASE
WHEN {holds(_T, ['cve-', 'vulnerable dependency'])} THEN false
WHEN coalesce(confidence, 0.0) >= 0.95 AND source IN ('semgrep', 'pattern_scanner') THEN false
WHEN source IN ('trivy', 'npm_audit') AND contains(coalesce(owasp_category, ''), 'A06:2021') THEN false
WHEN contains({_T}, 'injection') AND {_TYPED} THEN true
WHEN (contains({_T}, 'prototype pollution') OR contains({_W}, 'cwe-1321')) AND {_TYPED} THEN true
WHEN (contains({_T}, 'path traversal') OR contains({_W}, 'cwe-22')) AND contains({_C}, 'path.join(') AND {_NO_REQ} AND NOT {holds(_C, fnd._UPLOAD_CODE)} AND NOT {holds(_P, ['upload', 'file', 'media', 'attachment', 'asset'])} THEN true
WHEN {holds(_T, ['secret', 'hardcoded'])} AND {holds(_C, ['bcrypt', 'argon2', 'hashlib', 'crypto.', 'pbkdf2'])} THEN true
WHEN NOT ({holds(_T, fnd._BYPASS)} OR {holds(_D, fnd._BYPASS)}) AND ({holds(_T, ['secret', 'hardcoded'])} OR contains({_W}, 'cwe-798')) AND NOT {holds(_C, fnd._DEFAULTS)} AND {_ENV} THEN true
WHEN (contains({_T}, 'ssrf') OR contains({_W}, 'cwe-918')) AND ({holds(_C, fnd._SETTINGS)} OR {holds(_D, fnd._SETTINGS)}) AND {_NO_REQ} AND NOT contains({_C}, 'user') THEN true
WHEN contains({_T}, 'hardcoded') AND contains({_T}, 'url') AND ({holds(_D, ['config', 'environment'])} OR contains({_C}, 'switch')) THEN true
ELSE {holds(_T, fnd._NOTHING_FOUND)} END"""
_CVE = f"({holds(_T, ['cve-', 'vulnerable dependency'])} OR coalesce(source IN ('trivy', 'npm_audit'), false))"


@query(f"SELECT seq, {_SAFE_QUERY} AS safe_query, {_SAFE_FRAMEWORK} AS safe_framework FROM findings")
def f14_f15_safe(s, d):
    return _f(s, d).select("seq", fnd.is_safe_query().alias("safe_query"), fnd.is_safe_framework().alias("safe_framework"))


@query(f"""WITH r AS (SELECT *, CASE WHEN NOT {_CVE} AND {holds(_P, dims.TEST_MARKS)} THEN 'test or example code' WHEN NOT {_CVE} AND contains(coalesce(file_path, ''), '/migrations/') AND coalesce(file_path LIKE '%.py', false) THEN 'generated migration'
WHEN {_SAFE_QUERY} THEN 'query with bound parameters' WHEN {_SAFE_FRAMEWORK} THEN 'safe by the framework' WHEN {BASE.format(c=_P)} IN {one_of(dims.LOCK_FILES)} THEN 'tracked by the manifest' END AS reason FROM findings)
SELECT seq, reason IS NOT NULL OR coalesce(is_false_positive, false) AS is_false_positive, coalesce(reason, false_positive_reason) AS false_positive_reason FROM r""")
def f17_rule_filter(s, d):
    return fnd.rule_filtered(_f(s, d)).select("seq", "is_false_positive", "false_positive_reason")


@query(f"SELECT seq FROM findings WHERE coalesce(confidence, 0.0) >= 0.9 OR severity = 'CRITICAL' OR coalesce(source IN ('trivy', 'npm_audit'), false) OR {holds(_T, ['hardcoded', 'otp', 'bypass', 'missing auth', 'admin', 'stack trace', 'error.stack'])}")
def f18_protected(s, d):
    return _f(s, d).where(fnd.is_protected()).select("seq")


@query(f"SELECT seq FROM findings WHERE NOT ({holds(_T, ['no vulnerabilit', 'not vulnerable', 'none found', 'no issues found', 'no findings found', 'not applicable', 'no issues identified', 'no security issues', 'properly validated', 'correctly implemented', 'analysis complete', 'no concerns'])} OR lower(trim(coalesce(file_path, ''))) IN ('n/a', '', 'none', 'not applicable'))")
def f19_reporting_titles(s, d):
    return _f(s, d).where(~fnd.is_rejected_title()).select("seq")


def _report_sql() -> str:
    """Groups by labels that travel from rows to keys and back, eight times; the largest distance over shared keys is far below."""
    path = "CASE WHEN regexp_extract(p, 'workspace/[^/]*/(.*)$', 1) != '' THEN regexp_extract(p, 'workspace/[^/]*/(.*)$', 1) ELSE p END"
    cwe = "CASE WHEN coalesce(cwe_id, '') = '' THEN '' WHEN regexp_matches(cwe_id, '(?i)CWE-\\d+') THEN upper(regexp_extract(cwe_id, '(?i)(CWE-\\d+)', 1)) ELSE upper(trim(cwe_id)) END"
    rounds = "".join(f", k{i} AS (SELECT k, min(l) AS l FROM links JOIN r{i - 1} USING (seq) GROUP BY k), r{i} AS (SELECT seq, min(l) AS l FROM links JOIN k{i} USING (k) GROUP BY seq)" for i in range(1, 9))
    return f"""WITH f AS (SELECT *, coalesce(title, '') AS t, coalesce(file_path, '') AS p, coalesce(line_number, 0)::VARCHAR AS line, {cwe} AS cwe FROM findings WHERE {CONFIRMED}), g AS (SELECT *, {path} AS path FROM f),
links AS (SELECT DISTINCT seq, unnest([concat('1|', t, '|', path, '|', line), CASE WHEN regexp_matches(t, 'CVE-\\d{{4}}-\\d+') THEN concat('2|', regexp_extract(t, '(CVE-\\d{{4}}-\\d+)', 1), '|', path) END,
CASE WHEN cwe != '' AND path != '' AND {BASE.format(c="path")} NOT IN {one_of(dims.MERGE_EXEMPT)} THEN concat('3|', cwe, '|', path, '|', line) END, concat('4|', t, '|', path, '|', severity, '|', line, '|', trim(substr(coalesce(description, ''), 1, 100)))]) AS k FROM g),
r0 AS (SELECT DISTINCT seq, seq AS l FROM links WHERE k IS NOT NULL){rounds}
SELECT seq FROM r8 JOIN f USING (seq) QUALIFY row_number() OVER (PARTITION BY l ORDER BY coalesce(confidence, 0.0) DESC, CASE WHEN coalesce(trim(remediation), '') != '' THEN 0 ELSE 1 END, {RANK}, seq) = 1"""


@query(_report_sql())
def w5_report_unique(s, d):
    return fnd.report_unique(fnd.confirmed(_f(s, d))).select("seq")


@query()
def w5_report_fold(s, d):
    return fnd.report_fold(fnd.confirmed(_f(s, d))).select("seq", "slot_seq")


@query(f"SELECT seq, row_number() OVER (ORDER BY {RANK}, seq) AS report_index FROM findings WHERE {CONFIRMED}")
def w7_report_index(s, d):
    return fnd.report_index(_f(s, d)).select("seq", "report_index")


@query("SELECT seq, row_number() OVER (ORDER BY seq) AS index, (row_number() OVER (ORDER BY seq) - 1) // 25 AS batch_no FROM findings")
def w6_batches(s, d):
    return fnd.batches(_f(s, d)).select("seq", "index", "batch_no")


@query(f"SELECT seq, severity FROM findings WHERE {CONFIRMED} ORDER BY {SCORE} DESC, seq LIMIT 5")
def l5_top_by_score(s, d):
    return fnd.top_by_score(_f(s, d)).select("seq", "severity")


@query(f"SELECT seq, severity FROM findings WHERE {CONFIRMED} AND severity IN ('CRITICAL', 'HIGH') ORDER BY {RANK}, seq LIMIT 5")
def l6_priority_fixes(s, d):
    return fnd.priority_fixes(_f(s, d)).select("seq", "severity")


@query(f"SELECT seq, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 1 ELSE 2 END AS priority FROM findings WHERE {CONFIRMED} QUALIFY row_number() OVER (PARTITION BY severity IN ('CRITICAL', 'HIGH') ORDER BY seq) <= 25")
def l7_to_verify(s, d):
    return fnd.to_verify(_f(s, d)).select("seq", "priority")


@query("SELECT file_path, count(*) AS n, min(seq) AS first_seq, array_to_string(list_sort(list_distinct(list(severity))), ',') AS severities FROM findings GROUP BY 1")
def a10_by_file(s, d):
    return fnd.by_file(_f(s, d))


@query("SELECT seq, CASE WHEN confidence = 0.0 THEN 0.7 ELSE confidence END AS confidence FROM findings")
def m2_default_confidence(s, d):
    return fnd.default_confidence(_f(s, d)).select("seq", "confidence")


_CWE_CASE = "CASE " + " ".join(f"WHEN contains({_T}, {lit(w)}) THEN {lit(c)}" for w, c, _ in dims.CWE_BY_TITLE) + " END"
_OWASP_CASE = "CASE " + " ".join(f"WHEN contains({_T}, {lit(w)}) THEN {lit(o)}" for w, _, o in dims.CWE_BY_TITLE) + " END"


@query(f"SELECT seq, CASE WHEN coalesce(cwe_id, '') = '' AND {_CWE_CASE} IS NOT NULL THEN {_CWE_CASE} ELSE cwe_id END AS cwe_id, CASE WHEN coalesce(cwe_id, '') = '' AND {_CWE_CASE} IS NOT NULL AND coalesce(owasp_category, '') = '' THEN {_OWASP_CASE} ELSE owasp_category END AS owasp_category FROM findings")
def m6_backfill(s, d):
    return protocol.backfilled(_f(s, d)).select("seq", "cwe_id", "owasp_category")


# Each finding with a verdict made of its own fields, as one transcript block.
_VERDICT = "CASE WHEN severity IN ('LOW', 'INFO') THEN 'REMOVE' WHEN severity = 'MEDIUM' THEN 'FIX' ELSE 'KEEP' END"


def _validation_blocks(s: SparkSession, d: str) -> DataFrame:
    numbered = fnd.batches(_f(s, d))
    text = F.concat(F.lit("VALIDATION: "), F.col("index").cast("string"), F.lit("\n- Finding: x\n- Verdict: "), F.expr(_VERDICT), F.lit("\n- Duplicate Of: "), F.when(F.col("line_number") == 0, F.lit("none")).otherwise(F.concat(F.lit("#"), (F.col("index") - 1).cast("string"))), F.lit("\n- Corrected Severity: low\n- Remediation Issue: wrong language\n"))
    return protocol.validations(numbered.select(F.col("seq").alias("id"), text.alias("text")))


@query(f"SELECT seq AS id, row_number() OVER (ORDER BY seq) AS number, {_VERDICT} AS verdict, CASE WHEN line_number = 0 THEN 'none' ELSE '#' || (row_number() OVER (ORDER BY seq) - 1) END AS duplicate_of, 'LOW' AS severity FROM findings WHERE line_number IS NOT NULL")
def x12_validation_blocks(s, d):
    return _validation_blocks(s, d).select("id", "number", "verdict", "duplicate_of", "severity")


@query(f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY seq) AS i, {_VERDICT} AS v, {BASE.format(c=_P)} AS base FROM findings),
o AS (SELECT n.*, coalesce(lag(base) OVER (ORDER BY seq) = base AND (i - 1) // 25 = (i - 2) // 25, false) AS same FROM n)
SELECT seq, v = 'REMOVE' AND NOT (coalesce(confidence, 0.0) >= 0.9 OR severity = 'CRITICAL' OR coalesce(source IN ('trivy', 'npm_audit'), false) OR {holds(_T, ['hardcoded', 'otp', 'bypass', 'missing auth', 'admin', 'stack trace', 'error.stack'])}) AND (line_number = 0 OR same) AS removed,
v = 'FIX' AS fixed, CASE WHEN v != 'REMOVE' AND {RANK} < 3 THEN 'LOW' ELSE severity END AS severity, CASE WHEN v = 'FIX' THEN '' ELSE remediation_code END AS remediation_code FROM o""")
def m3_validated(s, d):
    return protocol.validated(fnd.batches(_f(s, d)), _validation_blocks(s, d)).select("seq", "removed", "fixed", "severity", "remediation_code")


@query("SELECT seq AS id, trim(regexp_replace(title, '^[- ]+', '')) AS title, CASE WHEN coalesce(is_false_positive, false) THEN 'FALSE_POSITIVE' ELSE 'CONFIRMED' END AS verdict, coalesce(confidence, 0.8) AS confidence, severity FROM findings WHERE title IS NOT NULL AND severity IS NOT NULL")
def x11_verification_blocks(s, d):
    text = F.concat(F.lit("Notes\nVERIFICATION:\n- Finding: "), F.regexp_replace("title", "^[- ]+", ""), F.lit("\n- Verdict: "), F.when(F.coalesce("is_false_positive", F.lit(False)), "false_positive").otherwise("confirmed"), F.lit("\n- Confidence: "), F.coalesce(F.col("confidence").cast("string"), F.lit("high")), F.lit("\n- Adjusted Severity: "), F.lower("severity"))
    made = _f(s, d).where("title is not null and severity is not null").select(F.col("seq").alias("id"), text.alias("text"))
    return protocol.verifications(made).select("id", "title", "verdict", "confidence", "severity")


_CLEAN_PATH = "regexp_replace(coalesce(file_path, ''), '^`+|`+$', '', 'g')"


@query(f"SELECT seq AS id, trim(replace(title, '**', '')) AS title, coalesce(severity, 'MEDIUM') AS severity, {_CLEAN_PATH} AS file_path, CASE WHEN line_number > 0 THEN line_number ELSE 0 END AS line_number FROM findings WHERE trim(replace(coalesce(title, ''), '**', '')) != '' AND NOT ({holds(lower('title'), fnd.REJECTED)} OR lower(trim({_CLEAN_PATH})) IN ('n/a', '', 'none', 'not applicable'))")
def x10_finding_blocks(s, d):
    """A block of every finding, dirty ones included."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    text = F.concat(F.lit("### Finding 1\n**Title**: "), said("title"), F.lit("\n- Risk Level: "), F.lower(said("severity")), F.lit("\n- Location: `"), said("file_path"), F.lit("`\n- Line: "), said("line_number"), F.lit("-9\n- Details: first\nsecond\n"))
    return protocol.parsed_findings(_f(s, d).select(F.col("seq").alias("id"), text.alias("text"))).select("id", "title", "severity", "file_path", "line_number")


@query("SELECT seq, 'fix' || seq AS strategy, 'a = ' || seq AS code FROM findings")
def x13_remediation_blocks(s, d):
    n = F.col("seq").cast("string")
    text = F.concat(F.lit("REMEDIATION:\n- Vulnerability: x\n- Fix Strategy: fix"), n, F.lit("\n```py\nold\n```\n```py\na = "), n, F.lit("\n```\n"))
    return protocol.remediations(_f(s, d).select("seq", text.alias("text")), keep=["seq"]).select("seq", "strategy", "code")


_BARE = r"regexp_replace(regexp_replace(coalesce(code_snippet, ''), '```\w*\s*\n?', '', 'g'), '`+\s*$', '')"
_PROSE = f"NOT regexp_matches(lower(trim(x)), {lit(protocol.CODE_SIGN)}) AND (regexp_matches(trim(x), {lit(protocol.SENTENCE)}) AND len(string_split_regex(trim(x), '\\s+')) >= 3 OR len(trim(x)) > 40 AND len(string_split_regex(trim(x), '\\s+')) >= 6)"


@query(f"SELECT seq, trim(array_to_string(list_filter(string_split({_BARE}, chr(10)), lambda x: trim(x) NOT IN ('', '---', '***', '___') AND NOT ({_PROSE})), chr(10))) AS code FROM findings")
def x14_clean_code(s, d):
    return _f(s, d).select("seq", protocol.clean_code(F.col("code_snippet")).alias("code"))


# Reports.


@query(f"""WITH c AS (SELECT *, CASE WHEN coalesce(cwe_id, '') != '' THEN cwe_id ELSE finding_id END AS rule_id FROM findings WHERE {CONFIRMED})
SELECT rule_id, title, substr(description, 1, 500) AS description, {cased("severity", {x: y for x, _, _, y in dims.SEVERITIES}, "warning")} AS level, {SCORE} AS score FROM c QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY seq) = 1""")
def k2_sarif_rules(s, d):
    return report.sarif_rules(_f(s, d))


_BELOW = "CASE WHEN regexp_extract(file_path, 'workspace/[^/]*/(.*)$', 1) != '' THEN regexp_extract(file_path, 'workspace/[^/]*/(.*)$', 1) ELSE file_path END"
_RULE_ID = "CASE WHEN coalesce(cwe_id, '') != '' THEN cwe_id ELSE finding_id END"
_LEVEL = cased("severity", {x: y for x, _, _, y in dims.SEVERITIES}, "warning")


@query(f"""WITH c AS (SELECT *, {_RULE_ID} AS rule_id, {_LEVEL} AS level FROM findings WHERE {CONFIRMED})
SELECT 'rule' AS part, 0 AS seq, rule_id, level, title AS text, NULL AS uri, NULL AS first, NULL AS last FROM c QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY c.seq) = 1
UNION ALL SELECT 'result', seq, rule_id, level, description, {_BELOW}, greatest(coalesce(line_number, 0), 1), greatest(CASE WHEN coalesce(end_line, 0) > 0 THEN end_line ELSE coalesce(line_number, 0) END, 1) FROM c""")
def k2_sarif_lines(s, d):
    """The lines, read back as JSON."""
    place = "$.locations[0].physicalLocation."
    get = lambda *paths: F.coalesce(*[F.get_json_object("text", p) for p in paths])
    return report.sarif_lines(_f(s, d)).select("part", "seq", get("$.ruleId", "$.id").alias("rule_id"), get("$.level", "$.defaultConfiguration.level").alias("level"), get("$.message.text", "$.shortDescription.text").alias("said"),
                                               get(place + "artifactLocation.uri").alias("uri"), get(place + "region.startLine").cast("int").alias("first"), get(place + "region.endLine").cast("int").alias("last")).withColumnRenamed("said", "text")


@query(f"""WITH c AS (SELECT count(*) FILTER (severity = 'CRITICAL') AS "CRITICAL", count(*) FILTER (severity = 'HIGH') AS "HIGH", count(*) FILTER (severity = 'MEDIUM') AS "MEDIUM", count(*) FILTER (severity = 'LOW') AS "LOW", count(*) FILTER (severity = 'INFO') AS "INFO", count(*) AS total_confirmed FROM findings WHERE {CONFIRMED}),
u AS (SELECT severity, coalesce(confidence, 0.0) AS given FROM findings WHERE {CONFIRMED} QUALIFY row_number() OVER (PARTITION BY title, file_path, line_number, end_line, severity ORDER BY seq) = 1),
r AS (SELECT round(least(10.0, sum({SCORE} * c) / sum(c) + least(2.0, ln(1 + count(*)) * 0.8)), 1) AS risk_score FROM (SELECT *, least(1.0, CASE WHEN given <= 0 THEN {cased("severity", dims.ASSUMED_CONFIDENCE, 0.7)} ELSE given END) AS c FROM u))
SELECT c.*, (SELECT count(*) FROM findings WHERE is_false_positive) AS false_positives_filtered, risk_score, CASE WHEN "CRITICAL" > 0 THEN 'HIGH RISK' WHEN "HIGH" > 0 THEN 'MODERATE RISK' WHEN "MEDIUM" > 0 THEN 'LOW-MODERATE RISK' WHEN total_confirmed > 0 THEN 'LOW RISK' ELSE 'NONE' END AS assessment FROM c, r""")
def a11_report_summary(s, d):
    return report.summary(_f(s, d))


@query(f"""WITH c AS (SELECT * FROM findings WHERE {CONFIRMED})
SELECT -1 AS rank, -1 AS seq, '# Security report' AS head UNION ALL SELECT -1, 0, '## First to mend' WHERE EXISTS (SELECT 1 FROM c)
UNION ALL SELECT {RANK}, -1, '## ' || severity || ' (' || count(*) || ')' FROM c WHERE {RANK} < 9 GROUP BY severity UNION ALL SELECT {RANK}, seq, string_split('### ' || coalesce(title, ''), chr(10))[1] FROM c""")
def k1_markdown_rows(s, d):
    return report.markdown_rows(_f(s, d)).select("rank", "seq", F.get(F.split("text", "\n"), F.lit(0)).alias("head"))


_CLASS = "coalesce(try_cast(nullif(regexp_extract(coalesce(cwe_id, ''), '([0-9]+)', 1), '') AS INT), CASE " + " ".join(f"WHEN contains({_T}, {lit(w)}) THEN {int(c[4:])}" for w, c, _ in dims.CWE_BY_TITLE) + " END)"


def _advice(kind: int) -> str:
    return f"CASE {_CLASS} " + " ".join(f"WHEN {k} THEN {lit(v[kind])}" for k, v in report.ADVICE.items()) + " END"


_ENRICHED = f"""SELECT seq, severity, title, file_path, line_number, cwe_id, CASE WHEN trim(coalesce(reasoning_chain, '')) = '' THEN coalesce({_advice(0)}, description) ELSE reasoning_chain END AS why,
CASE WHEN trim(coalesce(remediation, '')) = '' THEN coalesce({_advice(1)}, CASE WHEN trim(coalesce(cwe_id, '')) != '' THEN 'Address ' || cwe_id || ' at the place shown.' ELSE 'Review the code at the place shown.' END) ELSE remediation END AS how,
CASE WHEN trim(coalesce(remediation_code, '')) = '' AND trim(coalesce(code_snippet, '')) NOT IN {one_of(report.NO_SNIPPET)} THEN coalesce({_advice(2)}, '') ELSE remediation_code END AS code,
CASE WHEN trim(coalesce(code_snippet, '')) IN {one_of(report.NO_SNIPPET)} THEN '' ELSE code_snippet END AS snippet FROM findings"""


@query(f"SELECT seq, severity, title, {_BELOW} AS file, line_number AS line, why, how, code, snippet, cwe_id AS cwe FROM ({_ENRICHED} WHERE {CONFIRMED})")
def k3_json_findings(s, d):
    """The bodies, read back as JSON."""
    get = lambda p, name: F.get_json_object("body", "$." + p).alias(name)
    return report.json_findings(_f(s, d)).select("seq", "severity", get("title", "title"), get("vulnerable_code.file", "file"), F.get_json_object("body", "$.vulnerable_code.line").cast("int").alias("line"), get("why_vulnerable", "why"), get("solution.description", "how"), get("solution.fixed_code", "code"), get("vulnerable_code.snippet", "snippet"), get("metadata.cwe", "cwe"))


@query(f"SELECT seq, why AS reasoning_chain, how AS remediation, code AS remediation_code, snippet AS code_snippet FROM ({_ENRICHED})")
def m5_enriched(s, d):
    return report.enriched(_f(s, d)).select("seq", "reasoning_chain", "remediation", "remediation_code", "code_snippet")


@query(f"""WITH c AS (SELECT *, {_RULE_ID} AS rule_id FROM findings WHERE {CONFIRMED})
SELECT 1 AS section, count(DISTINCT rule_id) AS lines, count(DISTINCT rule_id) - 1 AS commas FROM c UNION ALL SELECT 3, count(*), count(*) - 1 FROM c UNION ALL SELECT unnest([-1, 0, 2, 4]), 1, 0""")
def k2_sarif_document(s, d):
    return report.sarif_document(_f(s, d)).groupBy("section").agg(F.count("*").alias("lines"), F.count_if(F.startswith("text", F.lit(",{"))).alias("commas"))


# Symbols.

_CATEGORIES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {holds(TEXT, [w.lower() for w in ws])} THEN {lit(c)} END" for c, ws in dims.SINKS.items()) + "], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT func_id, ordinal, {_CATEGORIES} AS sink_categories, {holds(BODY, [w.lower() for w in dims.SOURCES])} AS is_source, {holds(BODY, [w.lower() for w in dims.SANITIZERS])} AS has_sanitizer FROM function_symbols")
def f1_f2_flags(s, d):
    return symbols.flagged(_sym(s, d)).select("func_id", "ordinal", F.array_join("sink_categories", ",").alias("sink_categories"), "is_source", "has_sanitizer")


@query(f"SELECT func_id, {listed(BODY, dims.SOURCES)} AS sources, {listed(TEXT, [w for ws in dims.SINKS.values() for w in ws])} AS sinks, nullif(string_split({listed(BODY, [w for w in dims.SANITIZERS])}, ',')[1], '') AS sanitizer FROM function_symbols")
def f3_f5_details(s, d):
    return symbols.details(_sym(s, d)).select("func_id", F.array_join("sources", ",").alias("sources"), F.array_join("sinks", ",").alias("sinks"), "sanitizer")


@query("SELECT count(*) AS functions, count(DISTINCT file) AS files, count(*) FILTER (is_sink) AS sinks, count(*) FILTER (is_source) AS sources, count(*) FILTER (has_sanitizer) AS sanitizers, count(*) FILTER (is_exported) AS exported, " + ", ".join(f"count(*) FILTER (list_contains(sink_categories, {lit(c)})) AS sink_{c}" for c in dims.SINKS) + " FROM function_symbols")
def a3_symbol_stats(s, d):
    return symbols.stats(_sym(s, d))


_CALLS = "calls AS (SELECT func_id, file, unnest(calls) AS call FROM function_symbols)"


@query(f"WITH {_CALLS}, sinks AS (SELECT DISTINCT func_name FROM function_symbols WHERE is_sink) SELECT func_id FROM function_symbols WHERE is_sink OR is_source UNION SELECT func_id FROM calls c JOIN sinks s ON c.call = s.func_name OR ends_with(c.call, '.' || s.func_name)")
def f9_security_relevant(s, d):
    return symbols.security_relevant(_sym(s, d))


@query("SELECT func_id, ordinal, CASE WHEN coalesce(parent_class, '') != '' THEN parent_class || '.' || func_name ELSE func_name END AS qualified_name FROM function_symbols")
def x3_qualified_names(s, d):
    return _sym(s, d).select("func_id", "ordinal", symbols.qualified_name(F.col("parent_class"), F.col("func_name")).alias("qualified_name"))


# Call graph.

_IMPORTS = r"""texts AS (SELECT file, trim(unnest(string_split(coalesce(body, ''), chr(10)))) AS text FROM function_symbols),
words AS (SELECT file, list_filter(string_split_regex(replace(replace(text, 'from', ''), 'import', ' '), '\s+'), lambda w: w != '') AS w FROM texts WHERE (starts_with(text, 'import') OR starts_with(text, 'from')) AND contains(text, 'from') AND contains(text, 'import')),
imported AS (SELECT file, name, max(module) AS module FROM (SELECT file, w[1] AS module, regexp_replace(unnest(w[2:]), ',+$', '') AS name FROM words WHERE len(w) >= 2) WHERE name NOT IN ('', 'as') GROUP BY 1, 2)"""


@query(f"WITH {_IMPORTS} SELECT file, name, module FROM imported")
def g1_import_map(s, d):
    return graph.import_map(graph.imports_of(_sym(s, d)))


@query(f"""WITH {_IMPORTS},
calls AS (SELECT DISTINCT func_id, file, regexp_replace(string_split(call, '.')[-1], '[()]+$', '') AS name FROM (SELECT func_id, file, unnest(calls) AS call FROM function_symbols)),
named AS (SELECT * FROM calls WHERE name != ''),
local AS (SELECT c.func_id, c.name, arg_min(f.func_id, (f.ordinal, f.func_id)) AS dst FROM named c JOIN function_symbols f ON f.file = c.file AND f.func_name = c.name AND f.func_id != c.func_id GROUP BY 1, 2),
everywhere AS (SELECT func_name AS name, arg_min(func_id, (ordinal, func_id)) AS dst, count(*) AS n FROM function_symbols GROUP BY 1)
SELECT DISTINCT src_id, dst_id FROM (SELECT c.func_id AS src_id, coalesce(l.dst, CASE WHEN i.name IS NOT NULL OR e.n = 1 THEN e.dst END) AS dst_id FROM named c LEFT JOIN local l ON l.func_id = c.func_id AND l.name = c.name LEFT JOIN everywhere e ON e.name = c.name LEFT JOIN imported i ON i.file = c.file AND i.name = c.name) WHERE dst_id IS NOT NULL""")
def g2_call_edges(s, d):
    f = _sym(s, d)
    return graph.call_edges(f, graph.import_map(graph.imports_of(f)))


@query(f"WITH {FUNCTIONS} SELECT func_id, (SELECT count(*) FROM edge WHERE dst_id = func_id) AS callers, (SELECT count(*) FROM edge WHERE src_id = func_id) AS callees FROM functions")
def g3_neighbours(s, d):
    return graph.neighbours(_edges(s, d), _sym(s, d).dropDuplicates(["func_id"]))


@query(f"WITH {FUNCTIONS}, one AS (SELECT src_id AS func_id, dst_id AS sink_id FROM edge JOIN functions ON dst_id = func_id WHERE is_sink) SELECT func_id, sink_id, 1 AS level FROM one UNION SELECT e.src_id, o.sink_id, 2 FROM edge e JOIN one o ON e.dst_id = o.func_id")
def g4_sink_callers(s, d):
    return graph.sink_callers(_edges(s, d), _sym(s, d).dropDuplicates(["func_id"]))


_WALKS = f"""WITH RECURSIVE {FUNCTIONS}, walk AS (
SELECT func_id AS sink_id, [func_id] AS path, false AS ended FROM functions WHERE is_sink
UNION ALL SELECT sink_id, CASE WHEN e.src_id IS NULL OR list_contains(path[2:], e.src_id) THEN path ELSE list_append(path, e.src_id) END, e.src_id IS NULL OR list_contains(path[2:], e.src_id) OR len(path) >= 5
FROM walk LEFT JOIN edge e ON e.dst_id = path[-1] WHERE NOT ended)"""


@query(_WALKS + " SELECT sink_id, array_to_string(list_reverse(path), '>') AS path, count(*) AS times FROM walk WHERE ended GROUP BY 1, 2")
def g5_sink_chains(s, d):
    return graph.chains_to_sinks(_edges(s, d), _sym(s, d).dropDuplicates(["func_id"])).groupBy("sink_id", F.array_join("path", ">").alias("path")).agg(F.count("*").alias("times"))


@query(f"""WITH RECURSIVE {FUNCTIONS}, walk AS (SELECT func_id AS src_id, [func_id] AS path FROM functions WHERE is_source
UNION ALL SELECT w.src_id, list_append(path, e.dst_id) FROM walk w JOIN edge e ON e.src_id = path[-1] WHERE len(path) <= 4 AND NOT list_contains(path, e.dst_id))
SELECT w.src_id, path[-1] AS sink_id, array_to_string(path, '>') AS path FROM walk w JOIN functions f ON f.func_id = path[-1] WHERE len(path) > 1 AND f.is_sink""")
def g6_forward_paths(s, d):
    return taint.forward_paths(_edges(s, d), _sym(s, d).dropDuplicates(["func_id"])).select("src_id", "sink_id", F.array_join("path", ">").alias("path"))


@query(_WALKS + """, c AS (SELECT sink_id, path, count(*) AS times FROM walk WHERE ended GROUP BY 1, 2), n AS (SELECT sink_id, path, times, unnest(path) AS func_id FROM c)
SELECT sink_id, array_to_string(list_reverse(path), '>') AS path, len(path) AS length, bool_or(is_source) AS has_source, bool_or(has_sanitizer) AS has_sanitizer, array_to_string(list_sort(list_distinct(list(file))), ',') AS files, any_value(times) AS times FROM n JOIN functions USING (func_id) GROUP BY sink_id, n.path""")
def g7_described_chains(s, d):
    f = _sym(s, d).dropDuplicates(["func_id"])
    return graph.described_chains(graph.chains_to_sinks(_edges(s, d), f), f).select("sink_id", F.array_join("path", ">").alias("path"), F.col("length").cast("long").alias("length"), "has_source", "has_sanitizer", F.array_join("files", ",").alias("files"), "times")


def _words(text: str, words: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains({text}, {lit(w.lower())}) THEN {lit(w)} END" for w in words) + "], lambda x: x IS NOT NULL)"


_FLOWS = _WALKS + f""", det AS (SELECT func_id, any_value(file) AS file, any_value(line) AS line, any_value(ordinal) AS ordinal, any_value(so) AS sources, any_value(si) AS sinks, any_value(sa) AS sanitizer
FROM (SELECT func_id, file, line, ordinal, {_words(BODY, dims.SOURCES)} AS so, {_words(TEXT, [w for ws in dims.SINKS.values() for w in ws])} AS si, {_words(BODY, dims.SANITIZERS)}[1] AS sa FROM function_symbols) GROUP BY 1),
src AS (SELECT func_id AS src_id, i AS source_no, sources[i + 1] AS source FROM (SELECT *, unnest(range(0, len(sources))) AS i FROM det)), snk AS (SELECT func_id AS sink_id, i AS sink_no, sinks[i + 1] AS sink FROM (SELECT *, unnest(range(0, len(sinks))) AS i FROM det)),
fw AS (SELECT func_id AS src_id, [func_id] AS path FROM functions WHERE is_source UNION ALL SELECT w.src_id, list_append(path, e.dst_id) FROM fw w JOIN edge e ON e.src_id = path[-1] WHERE len(path) <= 4 AND NOT list_contains(path, e.dst_id)),
ch AS (SELECT DISTINCT sink_id, list_reverse(path) AS path FROM walk WHERE ended), cn AS (SELECT *, path[pos] AS func_id FROM (SELECT *, unnest(range(1, len(path) + 1)) AS pos FROM ch)),
back AS (SELECT sink_id, path, arg_min(func_id, pos) AS src_id FROM cn JOIN functions USING (func_id) WHERE is_source GROUP BY 1, 2),
every AS (SELECT 0 AS kind, src_id, source_no, source, sink_id, sink_no, sink, [src_id] AS path FROM src JOIN snk ON src_id = sink_id
UNION ALL SELECT 1, f.src_id, source_no, source, k.sink_id, sink_no, sink, path FROM fw f JOIN functions t ON t.func_id = f.path[-1] AND t.is_sink JOIN src s ON s.src_id = f.src_id JOIN snk k ON k.sink_id = t.func_id WHERE len(path) > 1
UNION ALL SELECT 2, b.src_id, source_no, source, b.sink_id, sink_no, sink, path FROM back b JOIN src s ON s.src_id = b.src_id AND source_no = 0 JOIN snk k ON k.sink_id = b.sink_id),
kept AS (SELECT source, sink, min(struct_pack(late := (kind = 2)::INT, o := CASE WHEN kind < 2 THEN a.ordinal ELSE 0 END, source_no := source_no, kind := kind, path := path, sink_no := sink_no, src_id := src_id, sink_id := sink_id)) AS r
FROM every e JOIN det a ON a.func_id = e.src_id JOIN det z ON z.func_id = e.sink_id GROUP BY source, a.file, a.line, sink, z.file, z.line),
flow AS (SELECT row_number() OVER () AS id, source, r.src_id AS src_id, sink, r.sink_id AS sink_id, r.path AS path FROM kept),
san AS (SELECT id, arg_min(sanitizer, pos) AS sanitizer FROM (SELECT id, pos, path[pos] AS func_id FROM (SELECT *, unnest(range(1, len(path) + 1)) AS pos FROM flow)) JOIN det USING (func_id) WHERE sanitizer IS NOT NULL GROUP BY 1),
told AS (SELECT flow.*, sanitizer, CASE WHEN sanitizer IS NOT NULL THEN 'safe' WHEN len(path) <= 2 THEN 'critical' ELSE 'high' END AS risk_level FROM flow LEFT JOIN san USING (id))"""


@query(_FLOWS + " SELECT source, src_id, sink, sink_id, array_to_string(path, '>') AS path, sanitizer, risk_level FROM told")
def g10_taint_flows(s, d):
    return taint.flows(_edges(s, d), _sym(s, d)).withColumn("path", F.array_join("path", ">"))


@query(_FLOWS + " SELECT count(*) AS total_chains, count(*) FILTER (risk_level <> 'safe') AS vulnerable_chains, count(*) FILTER (risk_level = 'safe') AS safe_chains, count(*) FILTER (risk_level = 'critical') AS critical_chains, count(*) FILTER (risk_level = 'high') AS high_chains FROM told")
def a5_taint_stats(s, d):
    return taint.flow_stats(taint.flows(_edges(s, d), _sym(s, d)))


@query(f"WITH {FUNCTIONS} SELECT func_id FROM functions WHERE func_id NOT IN (SELECT dst_id FROM edge) OR is_exported OR {holds('lower(func_name)', dims.ENTRY_WORDS)}")
def g12_entry_points(s, d):
    f = _sym(s, d).groupBy("func_id").agg(F.first("func_name").alias("func_name"), F.bool_or("is_exported").alias("is_exported"))
    return graph.entry_points(_edges(s, d), f)


@query(_WALKS + f""", c AS (SELECT sink_id, path, count(*) AS times FROM walk WHERE ended GROUP BY 1, 2), n AS (SELECT sink_id, path, len(path) AS length, any_value(times) AS times, bool_or(is_source) AS src FROM (SELECT sink_id, path, times, unnest(path) AS func_id FROM c) JOIN functions USING (func_id) GROUP BY 1, 2)
SELECT (SELECT count(*) FROM functions) AS nodes, (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM functions WHERE func_id NOT IN (SELECT dst_id FROM edge) OR is_exported OR {holds('lower(func_name)', dims.ENTRY_WORDS)}) AS entry_points, coalesce(sum(times), 0)::BIGINT AS sink_chains, coalesce(sum(times) FILTER (src), 0)::BIGINT AS dangerous_chains, coalesce(max(length), 0) AS max_chain_depth FROM n""")
def a4_graph_stats(s, d):
    f = _sym(s, d).groupBy("func_id").agg(F.first("func_name").alias("func_name"), F.first("file").alias("file"), *[F.bool_or(c).alias(c) for c in ("is_sink", "is_source", "has_sanitizer", "is_exported")])
    return graph.graph_stats(_edges(s, d), f)


_CHOSEN = _WALKS + f""", full_f AS (SELECT func_id, any_value(sink_categories) AS cats, any_value(line) AS line, any_value(body) AS body FROM function_symbols GROUP BY 1),
one AS (SELECT src_id AS func_id, dst_id AS sink_id, 1 AS level FROM edge JOIN functions ON dst_id = func_id WHERE is_sink), callers AS (SELECT * FROM one UNION SELECT e.src_id, o.sink_id, 2 FROM edge e JOIN one o ON e.dst_id = o.func_id),
cn AS (SELECT sink_id, path, unnest(path) AS func_id FROM (SELECT DISTINCT sink_id, path FROM walk WHERE ended)), bad AS (SELECT sink_id, path FROM cn JOIN functions USING (func_id) GROUP BY 1, 2 HAVING bool_or(is_source)),
before_entries AS (SELECT f.func_id, 1 AS step, 'contains_sink:' || array_to_string(cats, ',') AS reason FROM functions f JOIN full_f USING (func_id) WHERE is_sink UNION SELECT func_id, 2, 'contains_user_input_source' FROM functions WHERE is_source
UNION SELECT c.func_id, 3, CASE WHEN level = 1 THEN 'calls_sink:' ELSE 'indirect_caller_of_sink:' END || s.func_name FROM callers c JOIN functions s ON s.func_id = c.sink_id
UNION SELECT unnest(b.path), 4, 'in_dangerous_chain:' || s.func_name FROM bad b JOIN functions s ON s.func_id = b.sink_id),
entries AS (SELECT func_id, 5 AS step, 'entry_point_with_security_connection' AS reason FROM functions WHERE (func_id NOT IN (SELECT dst_id FROM edge) OR is_exported OR {holds('lower(func_name)', dims.ENTRY_WORDS)}) AND (is_source OR func_id IN (SELECT src_id FROM edge WHERE dst_id IN (SELECT func_id FROM before_entries)))),
chosen AS (SELECT func_id, list(reason ORDER BY step, reason) AS reasons FROM (SELECT * FROM before_entries UNION SELECT * FROM entries) GROUP BY 1)"""


@query(_CHOSEN + " SELECT func_id, array_to_string(reasons, '; ') AS reasons FROM chosen")
def g13_selected_functions(s, d):
    return ctx.selected_functions(_edges(s, d), _sym(s, d)).select("func_id", F.array_join("reasons", "; ").alias("reasons"))


@query(_CHOSEN + """, b AS (SELECT func_id, file, NOT is_source AS a1, NOT is_sink AS a2, line, ordinal, chr(10) || '  // [SECURITY-RELEVANT: ' || array_to_string(reasons, ', ') || ']' || chr(10) || coalesce(body, '') || chr(10) AS text FROM chosen JOIN functions USING (func_id) JOIN full_f USING (func_id)),
h AS (SELECT *, CASE WHEN file IS DISTINCT FROM lag(file) OVER w OR row_number() OVER w = 1 THEN chr(10) || '--- FILE: ' || coalesce(file, '') || ' ---' || chr(10) ELSE '' END || text AS whole FROM b WINDOW w AS (ORDER BY a1, a2, file, line, ordinal, func_id)),
r AS (SELECT *, coalesce(sum(len(whole)) OVER (ORDER BY a1, a2, file, line, ordinal, func_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h) SELECT func_id, whole AS text FROM r WHERE before <= 60000""")
def l2_context_blocks(s, d):
    return ctx.context_blocks(_sym(s, d), ctx.selected_functions(_edges(s, d), _sym(s, d)))


# Files.

_EXT = r"coalesce(nullif(regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '.(\.[^.]+)$', 1), ''), '')"
_SKIP = f"len(list_intersect(string_split(file_path, '/')[:-2], [{', '.join(lit(x) for x in dims.SKIPPED_DIRECTORIES)}])) = 0"
_SELECTED = f"{_EXT} IN {one_of(dims.EXTENSIONS)} AND {_SKIP}"


@query(f"SELECT {_EXT} AS extension, count(*) AS files, sum(len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) + CASE WHEN coalesce(text, '') != '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS lines FROM documents WHERE {_SELECTED} GROUP BY 1")
def a6_file_stats(s, d):
    return scan.file_stats(_docs(s, d))


_LANGUAGE = "CASE ext " + " ".join(f"WHEN {lit(e)} THEN {lit(n)}" for e, n in dims.LANGUAGES.items()) + " END"


@query(f"""WITH f AS (SELECT {_EXT} AS ext, lower(coalesce(text, '')) AS t, {BASE.format(c="file_path")} AS base FROM documents WHERE {_SKIP}), g AS (SELECT *, ext IN {one_of(dims.EXTENSIONS)} AS chosen FROM f)
SELECT (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT {_LANGUAGE} AS x FROM g) WHERE x IS NOT NULL) AS languages, concat_ws(',', {", ".join(f"CASE WHEN bool_or(chosen AND contains(t, {lit(w)})) THEN {lit(n)} END" for n, w in dims.FRAMEWORKS.items())}) AS frameworks,
coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT base AS x FROM g WHERE base IN {one_of(dims.MANIFESTS)})), '') AS manifests, count(*) FILTER (chosen) AS total_files, (sum(len(t) - len(replace(t, chr(10), ''))) FILTER (chosen))::BIGINT AS total_lines FROM g""")
def a7_tech_stack(s, d):
    return scan.tech_stack(_docs(s, d)).withColumns({c: F.array_join(c, ",") for c in ("languages", "frameworks", "manifests")})


@query(f"SELECT doc_id, CASE WHEN {BASE.format(c='file_path')} IN {one_of(dims.PRIORITY_FILES)} THEN 0 ELSE 1 END AS priority, CASE WHEN {holds('lower(file_path)', dims.SECURITY_WORDS)} THEN 1 ELSE 2 END AS security, strlen(text) AS size FROM documents WHERE {_SELECTED}")
def l1_prioritised(s, d):
    return scan.prioritised(_docs(s, d)).select("doc_id", "priority", "security", "size")


@query(f"""WITH one AS (SELECT file_path, arg_min(text, doc_id) AS text FROM documents WHERE text IS NOT NULL AND file_path IS NOT NULL GROUP BY 1),
f AS (SELECT file_path AS path, len(text) AS n, CASE WHEN {BASE.format(c='file_path')} IN {one_of(dims.PRIORITY_FILES)} THEN 0 ELSE 1 END AS a, CASE WHEN {holds('lower(file_path)', dims.SECURITY_WORDS)} THEN 1 ELSE 2 END AS b, strlen(text) AS size FROM one WHERE {_SELECTED}),
w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY a, b, size, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT path, (CASE WHEN n > 200000 - before THEN 200000 - before + 16 ELSE n END)::BIGINT AS chars FROM w WHERE before < 200000 AND (before + n <= 200000 OR 200000 - before > 500)""")
def w3_within_budget(s, d):
    one = _docs(s, d).where("content is not null and path is not null").groupBy("path").agg(F.min_by("content", "doc_id").alias("content"))
    return scan.within_budget(one).select("path", F.length("content").alias("chars"))


@query("SELECT doc_id, coalesce(sha256(text), '') AS sha256 FROM documents")
def x17_file_hashes(s, d):
    return _docs(s, d).select("doc_id", F.coalesce(F.sha2("content", 256), F.lit("")).alias("sha256"))


def _rule_sql(r: dims.Rule) -> str:
    """RE2 knows no look-around: the two rules with one are said as the plain pattern over a text in which what must not match is blanked, same in length."""
    content = "content"
    if r.id == "stack-trace-leak":
        content = "regexp_replace(content, '(\\.stac)k(Trace)', '\\1_\\2', 'gi')"
    if r.id == "weak-password-length-only":
        content = "regexp_replace(content, '(confirm)p(assword)', '\\1_\\2', 'gi')"
    regex = "(?i)" + (r.plain or r.regex)
    fits = " OR ".join(f"ends_with(path, {lit(e)})" for e in r.extensions)
    absent = f"AND NOT {holds('lower(content)', list(r.absent))} AND {holds('lower(path)', list(r.context))}" if r.absent else ""
    skipped = f"len(list_intersect(string_split(path, '/')[:-2], [{', '.join(lit(x) for x in dims.PATTERN_SKIPPED)}])) = 0"
    return f"""SELECT {lit(r.id)} AS rule_id, path, line, match FROM (
  SELECT path, content, m[i] AS match, 1 + len(array_to_string(p[1:i], '') || array_to_string(m[1:i - 1], '')) - len(replace(array_to_string(p[1:i], '') || array_to_string(m[1:i - 1], ''), chr(10), '')) AS line
  FROM (SELECT path, content, p, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT path, content, string_split_regex({content}, {lit(regex)}) AS p, regexp_extract_all({content}, {lit(regex)}) AS m FROM files WHERE ({fits}) AND len(content) <= 500000 AND {skipped} {absent}))
) WHERE {holds("lower(array_to_string(string_split(content, chr(10))[greatest(1, line - 5):line + 5], chr(10)))", list(r.context))}"""


_HITS = "WITH files AS (SELECT file_path AS path, code_snippet AS content FROM findings WHERE code_snippet IS NOT NULL), hits AS (" + "\nUNION ALL ".join(_rule_sql(r) for r in dims.RULES) + ")"


@query(_HITS + " SELECT rule_id, path, line, match, count(*) AS n FROM hits GROUP BY ALL")
def x7_pattern_hits(s, d):
    return scan.pattern_hits(_snippets(s, d)).groupBy("rule_id", "path", F.col("line").cast("long").alias("line"), "match").agg(F.count("*").alias("n"))


@query(_HITS + r""", t AS (SELECT *, string_split(replace(path, '\', '/'), '/') AS parts FROM hits), k AS (SELECT rule_id, CASE WHEN len(parts) >= 4 THEN array_to_string(parts[-4:], '/') ELSE array_to_string(parts, '/') END AS tail, path, line, match FROM t)
SELECT rule_id, path AS file_path, line AS line_number, match FROM k QUALIFY row_number() OVER (PARTITION BY rule_id, tail ORDER BY path, line, match) = 1""")
def w4_pattern_findings(s, d):
    return scan.pattern_findings(_snippets(s, d)).select("rule_id", "file_path", "line_number", "match")


@query(_HITS + ", t AS (SELECT rule_id, string_split(replace(path, '\\', '/'), '/') AS parts FROM hits), k AS (SELECT DISTINCT rule_id, CASE WHEN len(parts) >= 4 THEN array_to_string(parts[-4:], '/') ELSE array_to_string(parts, '/') END AS tail FROM t) SELECT severity, count(*) FILTER (rule_id IS NOT NULL) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) s(severity) LEFT JOIN (SELECT rule_id, " + cased("rule_id", {r.id: r.severity for r in dims.RULES}, "") + " AS sev FROM k) ON sev = severity GROUP BY 1")
def e1_scan_severities(s, d):
    return fnd.severity_counts(scan.pattern_findings(_snippets(s, d)).withColumn("is_false_positive", F.lit(False)))


@query(r"""WITH f AS (SELECT seq, string_split(regexp_replace(code_snippet, '\n$', ''), chr(10)) AS l, code_snippet AS c FROM findings WHERE code_snippet IS NOT NULL)
SELECT seq, CASE WHEN c = '' THEN '' ELSE array_to_string(list_transform(range(1, least(len(l), 4) + 1), lambda i: printf('%s %4d | %s', CASE WHEN i BETWEEN 2 AND 3 THEN '>>>' ELSE '   ' END, i, rtrim(l[i]))), chr(10)) END AS text FROM f""")
def w10_marked_lines(s, d):
    f = _f(s, d).select("seq", F.col("code_snippet").alias("content"))
    return f.where("content is not null").select("seq", scan.marked_lines(F.col("content"), F.lit(2), F.lit(3), 1).alias("text"))


@query()
def s2_parsed_code(s, d):
    return code.parsed(_docs(s, d)).select("file", "kind", "name", "line", "end_line", F.array_join("calls", ",").alias("calls"), "is_exported")


# Scanner reports, made of findings and read again.


@query("SELECT seq, coalesce(description, 'No description') AS description, CASE severity WHEN 'CRITICAL' THEN 'HIGH' WHEN 'HIGH' THEN 'HIGH' WHEN 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity, coalesce(file_path, '') AS file_path, coalesce(line_number, 0) AS line_number, coalesce(cwe_id, '') AS cwe_id FROM findings")
def s7_semgrep(s, d):
    said = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "WARNING").otherwise("INFO")
    one = F.struct(F.concat(F.lit("rules.x-"), F.col("seq").cast("string")).alias("check_id"), F.col("file_path").alias("path"), F.struct(F.col("line_number").alias("line")).alias("start"), F.struct(F.col("description").alias("message"), said.alias("severity"), F.struct(F.array("cwe_id").alias("cwe")).alias("metadata")).alias("extra"))
    made = _f(s, d).select(F.to_json(F.struct(F.array(one).alias("results"))).alias("json"))
    return tools.semgrep(made).select(F.regexp_extract("title", r"(\d+)$", 1).cast("long").alias("seq"), "description", "severity", "file_path", "line_number", "cwe_id")


@query("SELECT seq, substr(coalesce(code_snippet, ''), 1, 200) AS code_snippet, coalesce(file_path, '') AS file_path, coalesce(line_number, 0) AS line_number FROM findings")
def s10_gitleaks(s, d):
    made = _f(s, d).select(F.to_json(F.array(F.struct(F.col("seq").cast("string").alias("Description"), F.col("file_path").alias("File"), F.col("line_number").alias("StartLine"), F.col("code_snippet").alias("Match")))).alias("json"))
    return tools.gitleaks(made).select(F.regexp_extract("title", r"(\d+)$", 1).cast("long").alias("seq"), "code_snippet", "file_path", "line_number")


# Snapshots and state.

_DIFF = """o AS (SELECT rel_path, max(sha256) AS h FROM snapshot_files WHERE snap_no = 1 AND rel_path IS NOT NULL GROUP BY 1), n AS (SELECT rel_path, max(sha256) AS h FROM snapshot_files WHERE snap_no = 2 AND rel_path IS NOT NULL GROUP BY 1),
d AS (SELECT coalesce(o.rel_path, n.rel_path) AS rel_path, CASE WHEN o.rel_path IS NULL THEN 'added' WHEN n.rel_path IS NULL THEN 'removed' WHEN o.h IS DISTINCT FROM n.h THEN 'changed' ELSE 'same' END AS status FROM o FULL JOIN n ON o.rel_path = n.rel_path)"""


def _diff(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "snapshot_files")
    return incremental.diff(t.where("snap_no = 1"), t.where("snap_no = 2"))


@query(f"WITH {_DIFF} SELECT rel_path, status FROM d")
def t2_snapshot_diff(s, d):
    return _diff(s, d)


@query(f"WITH {_DIFF} SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'same') AS same FROM d")
def t6_diff_summary(s, d):
    return incremental.diff_summary(_diff(s, d))


@query(f"WITH {_DIFF} SELECT seq, 'cached' AS origin FROM findings WHERE file_path IS NULL OR file_path NOT IN (SELECT rel_path FROM d WHERE status != 'same') UNION ALL SELECT seq, 'fresh' FROM finding_batches")
def t3_carried_forward(s, d):
    fresh = table(s, d, "finding_batches").drop("batch_no").withColumn("origin", F.lit("fresh"))
    return incremental.carried_forward(_f(s, d).withColumn("origin", F.lit("cached")), fresh, _diff(s, d)).select("seq", "origin")


@query("""WITH c AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p, count(*) AS n FROM orders WHERE o_orderstatus != 'F' GROUP BY 1), t AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT coalesce(c.o_custkey, t.o_custkey) AS o_custkey, coalesce(c.p, t.p) AS status, coalesce(t.n, 0) + coalesce(c.n, 0) AS total_scans FROM t FULL JOIN c ON c.o_custkey = t.o_custkey""")
def m7_upsert(s, d):
    o = table(s, d, "orders")
    order = F.struct("o_orderdate", "o_orderkey")
    current = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max_by("o_orderpriority", order).alias("status"), F.count("*").alias("total_scans"))
    changes = o.where("o_orderstatus != 'F'").withColumnRenamed("o_orderpriority", "status")
    return incremental.upserted(current, changes, ["o_custkey"], order, "total_scans")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def m8_delete(s, d):
    gone = table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return incremental.deleted(table(s, d, "orders"), gone, ["o_custkey"]).select("o_orderkey")


@query("SELECT scan_id, target_path, scan_end FROM scans ORDER BY scan_end DESC NULLS LAST, scan_id LIMIT 20")
def l10_recent_scans(s, d):
    table(s, d, "scans").createOrReplaceTempView("scans")
    return s.sql("SELECT scan_id, target_path, scan_end FROM scans ORDER BY scan_end DESC NULLS LAST, scan_id LIMIT 20")


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 1000) WHERE event_type IN ('click', 'all')")
def w8_latest_messages(s, d):
    m = table(s, d, "events").select("event_id", F.col("event_id").alias("seq"), "event_type", F.col("event_type").alias("receiver"))
    return incremental.latest_messages(m, 1000, "click").select("event_id", "event_type")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def st_windowed_counts(s, d):
    return continuous.windowed_counts(table(s, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))
