"""Further queries of the core operators: stored tables, scanner reports, transcripts, look-ups, rules on a corpus of their own."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import dims
from .functions.text import py_title
from .operators import findings as fnd
from .operators import graph, incremental, protocol, scan, symbols, tables
from .plans import pipeline
from .queries import _DIFF, _HITS, _SELECTED, _VERDICT, _WALKS, CONFIRMED, RANK, _diff, _docs, _edges, _f, _snippets, _sym, _validation_blocks, lit, one_of, query
from .session import table
from .sources import repo, tools


def _sql(text: str):
    """A query that is SQL itself, over the registered views."""

    def run(s: SparkSession, d: str):
        tables.views(s, d)
        return s.sql(text)

    return run


def _plain(name: str, text: str) -> None:
    f = _sql(text)
    f.__name__ = name
    query(text)(f)


_plain("q1_scan_by_key", "SELECT scan_id, target_path, files_scanned FROM scans WHERE scan_id = 3")
_plain("q2_valid_session", "SELECT f.seq, s.target_path FROM findings f JOIN scans s ON f.scan_id = s.scan_id WHERE s.scan_end > s.scan_start ORDER BY f.seq LIMIT 1")
_plain("q4_counts", "SELECT count(*) AS n, count(finding_id) AS with_id FROM findings WHERE severity = 'CRITICAL'")
_plain("q4_exists", "SELECT 1 AS found FROM findings WHERE severity = 'CRITICAL' LIMIT 1")
_plain("q6_view", "SELECT seq, title, severity, scan_id FROM findings")
_plain("j15_scan_of_finding", "SELECT f.seq, s.target_path, s.total_lines FROM findings f JOIN scans s ON f.scan_id = s.scan_id")
_plain("a12_lines_by_target", "SELECT target_path, count(*) AS scans, sum(total_lines) AS total_lines FROM scans GROUP BY target_path")


@query("SELECT count(*) AS n, count(*) FILTER (severity = 'HIGH') AS high, coalesce(bool_or(severity = 'HIGH'), false) AS any_high FROM findings")
def a14_counted(s, d):
    return tables.counted(_f(s, d), high=F.col("severity") == "HIGH")


@query("SELECT seq, CASE WHEN severity = 'HIGH' AND confidence < 0.5 THEN 'MEDIUM' ELSE severity END AS severity FROM findings")
def q5_updated(s, d):
    return tables.updated(_f(s, d), {"severity": F.lit("MEDIUM")}, (F.col("severity") == "HIGH") & (F.col("confidence") < 0.5)).select("seq", "severity")


@query("SELECT file_path, array_to_string(list(seq ORDER BY seq), ',') AS seqs FROM findings GROUP BY 1")
def a10_listed_by_file(s, d):
    return tables.listed_by_file(_f(s, d)).withColumn("seqs", F.array_join("seqs", ","))


@query("SELECT event_type, count(*) AS calls, sum(event_id)::BIGINT AS prompt_tokens, sum(user_id)::BIGINT AS completion_tokens, (sum(event_id) + sum(user_id))::BIGINT AS total_tokens FROM events GROUP BY 1")
def a12_usage(s, d):
    return tables.usage_totals(table(s, d, "events").select("event_type", F.col("event_id").alias("prompt_tokens"), F.col("user_id").alias("completion_tokens")), ["event_type"])


@query(f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY seq) AS i, {_VERDICT} AS v, regexp_extract(lower(coalesce(file_path, '')), '([^/]*)$', 1) AS base FROM findings),
o AS (SELECT n.*, coalesce(lag(base) OVER (ORDER BY seq) = base AND (i - 1) // 25 = (i - 2) // 25, false) AS same FROM n),
r AS (SELECT v, v = 'REMOVE' AND NOT (coalesce(confidence, 0.0) >= 0.9 OR severity = 'CRITICAL' OR coalesce(source IN ('trivy', 'npm_audit'), false) OR regexp_matches(lower(coalesce(title, '')), 'hardcoded|otp|bypass|missing auth|admin|stack trace|error\\.stack')) AND (coalesce(line_number, -1) = 0 OR same) AS removed FROM o WHERE line_number IS NOT NULL)
SELECT count(*) AS total, count(*) FILTER (NOT removed) AS kept, count(*) FILTER (removed) AS removed, count(*) FILTER (v = 'FIX') AS fixed FROM r""")
def a9_run_totals(s, d):
    return tables.run_totals(protocol.validated(fnd.batches(_f(s, d)), _validation_blocks(s, d)).where("line_number is not null"))


@query(_WALKS + """, c AS (SELECT DISTINCT sink_id, path FROM walk WHERE ended), n AS (SELECT sink_id, path, unnest(path) AS func_id FROM c), k AS (SELECT sink_id, list_reverse(path) AS path, len(path) AS length, bool_or(is_source) AS has_source FROM n JOIN functions USING (func_id) GROUP BY sink_id, n.path)
SELECT row_number() OVER (ORDER BY has_source DESC, length, sink_id, path)::INT AS place, sink_id, array_to_string(path, '>') AS path FROM k ORDER BY has_source DESC, length, sink_id, k.path LIMIT 200""")
def l3_chain_order(s, d):
    f = _sym(s, d).dropDuplicates(["func_id"])
    return tables.chain_order(graph.described_chains(graph.chains_to_sinks(_edges(s, d), f), f), 200).select("place", "sink_id", F.array_join("path", ">").alias("path"))


@query("SELECT DISTINCT file_path AS path FROM documents")
def l9_sorted_paths(s, d):
    return tables.sorted_paths(_docs(s, d))


@query("SELECT seq, severity, title FROM findings QUALIFY row_number() OVER (PARTITION BY severity ORDER BY seq) <= 15")
def l8_first_of_each(s, d):
    return tables.first_of_each(_f(s, d), "severity", "seq", 15).select("seq", "severity", "title")


@query("SELECT scan_id, substr(sha1(coalesce(target_path, '')), 1, 12) AS slug FROM scans")
def x17_slugs(s, d):
    return table(s, d, "scans").select("scan_id", tables.slug(F.coalesce("target_path", F.lit(""))).alias("slug"))


@query("SELECT scan_id, CASE WHEN scan_end > 0 THEN scan_end - scan_start END AS seconds, strftime(make_timestamp(floor(scan_start)::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') AS started FROM scans")
def x20_durations(s, d):
    return tables.durations(table(s, d, "scans"))


@query("SELECT rel_path FROM snapshot_files WHERE rel_path IS NOT NULL")
def s13_untracked(s, d):
    return tables.untracked(table(s, d, "snapshot_files").select(F.concat(F.lit("  "), "rel_path", F.lit("\t")).alias("value")))


@query(f"WITH {_DIFF} SELECT rel_path, status FROM d UNION ALL SELECT DISTINCT file_path, 'added' FROM findings WHERE file_path IS NOT NULL AND file_path NOT IN (SELECT rel_path FROM d)")
def u4_with_untracked(s, d):
    return incremental.with_untracked(_diff(s, d), _f(s, d).where("file_path is not null").select(F.col("file_path").alias("rel_path")))


@query(f"WITH {_DIFF} SELECT seq, 'changed' AS run FROM findings WHERE NOT EXISTS (SELECT 1 FROM d WHERE status <> 'same') UNION ALL SELECT seq, 'unchanged' FROM findings")
def t4_all_cached(s, d):
    """Against the next snapshot, and against the same one."""
    t = table(s, d, "snapshot_files").where("snap_no = 1")
    runs = {"changed": _diff(s, d), "unchanged": incremental.diff(t, t)}
    return fnd.merged(*[tables.all_cached(_f(s, d), x).select("seq", F.lit(name).alias("run")) for name, x in runs.items()])


_ONE_EACH = "one AS (SELECT file_path AS path, arg_min(text, doc_id) AS text, arg_min(lang, doc_id) AS lang FROM documents WHERE text IS NOT NULL AND file_path IS NOT NULL GROUP BY 1)"


@query(f"WITH {_ONE_EACH}, f AS (SELECT path, len(text) AS chars, coalesce(sum(len(text)) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM one WHERE lang = 'en' AND len(text) > 0) SELECT path, chars FROM f WHERE before < 200000")
def t5_changed_context(s, d):
    docs = table(s, d, "documents").where("text is not null and file_path is not null").groupBy(F.col("file_path").alias("path")).agg(F.min_by("text", "doc_id").alias("content"), F.min_by("lang", "doc_id").alias("lang"))
    status = docs.select(F.col("path").alias("rel_path"), F.when(F.col("lang") == "en", "changed").otherwise("same").alias("status"))
    return tables.changed_context(docs, status)


@query(f"WITH {_DIFF} SELECT rel_path FROM d WHERE status = 'same' AND rel_path IN (SELECT file_path FROM findings)")
def t7_cleaned(s, d):
    return incremental.cleaned(_diff(s, d).where("status = 'same'"), _f(s, d).select(F.col("file_path").alias("rel_path")), ["rel_path"]).select("rel_path")


@query("SELECT seq, substr(description, 1, 2000) AS d FROM findings")
def x25_digest(s, d):
    return _f(s, d).select("seq", incremental.digest(F.lit("string"), F.col("description"), F.array(F.col("title"))).alias("d"))


_WORDS = r"""regexp_extract_all(title, '[A-Za-z]+|[^A-Za-z]+')"""


@query(f"SELECT seq, coalesce(array_to_string(list_transform({_WORDS}, lambda w: upper(w[1]) || lower(w[2:])), ''), NULL) AS t FROM findings")
def x4_title_case(s, d):
    return _f(s, d).select("seq", py_title(F.col("title")).alias("t"))


@query(f"WITH v AS (SELECT seq, title, {_VERDICT} = 'REMOVE' AS removed, is_false_positive FROM findings) SELECT seq, (removed AND title IS NOT NULL AND title NOT IN (SELECT title FROM v WHERE NOT removed AND title IS NOT NULL)) OR (removed AND title IS NULL) OR coalesce(is_false_positive, false) AS is_false_positive FROM v")
def m4_without_removed(s, d):
    return protocol.without_removed(_f(s, d).withColumn("removed", F.expr(_VERDICT) == "REMOVE")).select("seq", "is_false_positive")


@query("SELECT func_id, ordinal FROM function_symbols WHERE list_contains(sink_categories, 'sql')")
def f7_in_category(s, d):
    return symbols.in_category(_sym(s, d), "sql").select("func_id", "ordinal")


@query("WITH m AS (SELECT min(func_name) AS name, min(file) AS file FROM function_symbols) SELECT 'name' AS kind, arg_min(func_id, (ordinal, func_id)) AS func_id FROM function_symbols, m WHERE func_name = name UNION ALL SELECT 'file', func_id FROM function_symbols f, m WHERE f.file = m.file")
def f8_lookups(s, d):
    f = _sym(s, d)
    m = f.agg(F.min("func_name").alias("name"), F.min("file").alias("file")).first()
    return symbols.first_by_name(f, m.name).select(F.lit("name").alias("kind"), "func_id").unionByName(symbols.in_file(f, m.file).select(F.lit("file").alias("kind"), "func_id"))


@query(" UNION ALL ".join(f"(SELECT {lit(f)} AS framework, {lit(m)} AS method FROM documents WHERE {_SELECTED} AND contains(lower(text), {lit(dims.FRAMEWORKS[f])}) LIMIT 1)" for f, m in pipeline.FRAMEWORK_METHODS.items()))
def j14_framework_methods(s, d):
    return pipeline.framework_methods(scan.tech_stack(_docs(s, d)))


@query("SELECT seq, regexp_matches(refs, '^(https?://|git@|ssh://|git://)') AS is_url FROM findings WHERE refs IS NOT NULL")
def f20_urls(s, d):
    return _f(s, d).where("refs is not null").select("seq", repo.is_git_url(F.col("refs")).alias("is_url"))


# Scanner reports, made of findings and read again.


@query("SELECT seq, coalesce(description, 'No description') AS description, CASE WHEN severity IN ('HIGH', 'LOW') THEN severity ELSE 'MEDIUM' END AS severity, coalesce(file_path, '') AS file_path, coalesce(line_number, 0) AS line_number, CASE severity WHEN 'HIGH' THEN 0.9 WHEN 'LOW' THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence, 'CWE-' || seq AS cwe_id FROM findings")
def s8_bandit(s, d):
    one = F.struct(F.concat(F.lit("x_"), F.col("seq").cast("string")).alias("test_name"), F.col("description").alias("issue_text"), F.lower("severity").alias("issue_severity"), F.col("severity").alias("issue_confidence"), F.struct(F.col("seq").cast("string").alias("id")).alias("issue_cwe"), F.col("file_path").alias("filename"), F.col("line_number"))
    made = _f(s, d).select(F.to_json(F.struct(F.array(one).alias("results"))).alias("json"))
    return tools.bandit(made).select(F.regexp_extract("title", r"(\d+)$", 1).cast("long").alias("seq"), "description", "severity", "file_path", "line_number", "confidence", "cwe_id")


@query("SELECT 'V' || seq || ' in p' AS title, coalesce(description, 'No description') AS description, CASE WHEN severity = 'INFO' THEN 'MEDIUM' ELSE severity END AS severity, coalesce(file_path, '') AS file_path, coalesce(cvss_score, 0.0) AS cvss_score FROM findings")
def s9_trivy(s, d):
    score = F.create_map(F.lit("nvd"), F.struct(F.col("cvss_score").alias("V3Score")))
    one = F.struct(F.concat(F.lit("V"), F.col("seq").cast("string")).alias("VulnerabilityID"), F.lit("p").alias("PkgName"), F.col("severity").alias("Severity"), F.col("description").alias("Description"), score.alias("CVSS"))
    made = _f(s, d).select(F.to_json(F.struct(F.array(F.struct(F.col("file_path").alias("Target"), F.array(one).alias("Vulnerabilities"))).alias("Results"))).alias("json"))
    return tools.trivy(made).select("title", "description", "severity", "file_path", "cvss_score")


@query("SELECT 'Vulnerable Dependency: p' || seq || '@<2' AS title, CASE WHEN coalesce(title, '') = '' THEN 'Vulnerability in p' || seq ELSE title END AS description, CASE severity WHEN 'MEDIUM' THEN 'MEDIUM' ELSE severity END AS severity FROM findings")
def s11_npm_audit(s, d):
    said = F.when(F.col("severity") == "MEDIUM", "moderate").otherwise(F.lower("severity"))
    entry = F.struct(said.alias("severity"), F.lit("<2").alias("range"), F.lit(True).alias("fixAvailable"), F.array(F.struct("title")).alias("via"))
    made = _f(s, d).select(F.to_json(F.struct(F.create_map(F.concat(F.lit("p"), F.col("seq").cast("string")), entry).alias("vulnerabilities"))).alias("json"))
    return tools.npm_audit(made).select("title", "description", "severity")


# Verdicts by title within a scan: each scan's transcript speaks of the title of its first finding.

_FIRST = "WITH t AS (SELECT scan_id, trim(regexp_replace(arg_min(title, seq), '^[- ]+', '')) AS said FROM findings WHERE title IS NOT NULL AND NOT contains(title, chr(10)) GROUP BY 1), m AS (SELECT f.*, coalesce(t.said <> '' AND (contains(lower(title), lower(said)) OR contains(lower(said), lower(title))), false) AS hit FROM findings f LEFT JOIN t ON f.scan_id IS NOT DISTINCT FROM t.scan_id)"


def _first_titles(s: SparkSession, d: str, before: str, after: str):
    t = _f(s, d).where("title is not null and not contains(title, '\n')").groupBy("scan_id").agg(F.trim(F.regexp_replace(F.min_by("title", "seq"), "^[- ]+", "")).alias("said"))
    return t.select("scan_id", F.concat(F.lit(before), "said", F.lit(after)).alias("text"))


@query(_FIRST + " SELECT seq, CASE WHEN hit THEN 0.25 ELSE confidence END AS confidence, CASE WHEN hit THEN 'LOW' ELSE severity END AS severity, hit OR coalesce(is_false_positive, false) AS is_false_positive FROM m")
def m1_verified(s, d):
    said = protocol.verifications(_first_titles(s, d, "VERIFICATION:\n- Finding: ", "\n- Verdict: FALSE_POSITIVE\n- Confidence: 0.25\n- Adjusted Severity: low\n"), keep=["scan_id"])
    return protocol.verified(_f(s, d), said).select("seq", "confidence", "severity", "is_false_positive")


@query(_FIRST + " SELECT seq, CASE WHEN hit THEN 'x = 1' ELSE remediation_code END AS remediation_code, CASE WHEN NOT hit THEN remediation WHEN coalesce(remediation, '') = '' THEN 'do it' ELSE 'do it. ' || remediation END AS remediation FROM m")
def j7_remediated(s, d):
    said = protocol.remediations(_first_titles(s, d, "REMEDIATION:\n- Vulnerability: ", "\n- Fix Strategy: do it\n```\nx = 1\n```\n"), keep=["scan_id"])
    return protocol.remediated(_f(s, d), said).select("seq", "remediation_code", "remediation")


@query("SELECT seq AS id, 'text' AS origin FROM findings UNION ALL SELECT seq, 'method' FROM findings")
def u7_parsed_and_methods(s, d):
    text = lambda origin: F.concat(F.lit("VULNERABILITY:\nTitle: t"), F.col("seq").cast("string"), F.lit("\nFile: a.py\n"))
    parts = [protocol.parsed_findings(_f(s, d).select(F.col("seq").alias("id"), text(o).alias("text"))).withColumn("origin", F.lit(o)) for o in ("text", "method")]
    return fnd.merged(*parts).select("id", "origin")


# Rules on code that meets all of them: a text for each finding, made of its seq.

_LINES = [
    "const otp = '123456' // verify login code", "if (password === 'admin') login()", "const token = Math.random() // token", "res.json({ e: error.stack })", "throw 'User not found' // login", "if (password.length < 8) reset()", "app.post('/x')",
    "const k = process.env.API_KEY || 'dev'", "plain = 1",
]


def _corpus(s: SparkSession, d: str):
    pick = F.get(F.array(*[F.lit(x) for x in _LINES]), F.pmod("seq", F.lit(len(_LINES))).cast("int"))
    return _f(s, d).select(F.concat(F.lit("app/admin/f"), F.col("seq").cast("string"), F.lit(".js")).alias("path"), F.concat(F.lit("// first\n"), pick, F.lit("\n")).alias("content"))


_MADE = "files AS (SELECT 'app/admin/f' || seq || '.js' AS path, '// first' || chr(10) || [" + ", ".join(lit(x) for x in _LINES) + f"][seq % {len(_LINES)} + 1] || chr(10) AS content FROM findings)"


@query(_HITS.replace("files AS (SELECT file_path AS path, code_snippet AS content FROM findings WHERE code_snippet IS NOT NULL)", _MADE) + " SELECT rule_id, path, line, match FROM hits")
def x7_every_rule(s, d):
    """Every rule is met by a ninth of the files."""
    return scan.pattern_hits(_corpus(s, d)).select("rule_id", "path", F.col("line").cast("long").alias("line"), "match")


@query(f"SELECT seq, severity, {RANK} AS r FROM findings WHERE {CONFIRMED}")
def l4_ranked(s, d):
    return fnd.confirmed(_f(s, d)).select("seq", "severity", dims.rank_of(F.col("severity")).alias("r"))


@query("SELECT file_path AS rel_path, coalesce(sha256(code_snippet), '') AS sha256 FROM findings")
def s6_file_hashes(s, d):
    return scan.file_hashes(_snippets(s, d))
