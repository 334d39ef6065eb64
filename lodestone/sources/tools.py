"""Findings from captured JSON of scanners. Each reader takes one document per row (column `json`) and explodes it natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import by_severity
from ..functions.text import py_title

COLUMNS = ["title", "description", "severity", "source", "file_path", "line_number", "end_line", "code_snippet", "cwe_id", "owasp_category", "cvss_score", "confidence", "remediation", "references"]

# The JSON shapes of the tools; in the readers, the wording of titles and the confidence given to each tool.
_SEMGREP = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,severity:string,lines:string,metadata:struct<cwe:array<string>,owasp:array<string>,source:string>>>>>"
_BANDIT = "struct<results:array<struct<test_name:string,test_id:string,issue_text:string,issue_severity:string,issue_confidence:string,issue_cwe:struct<id:string>,filename:string,line_number:int,end_col_offset:int,code:string>>>"
_TRIVY = "struct<Results:array<struct<Target:string,Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,Severity:string,Title:string,Description:string,CVSS:map<string,struct<V3Score:double>>,CweIDs:array<string>,References:array<string>>>,Secrets:array<struct<Category:string,Title:string,StartLine:int,EndLine:int,Match:string>>>>>"
_GITLEAKS = "array<struct<Description:string,RuleID:string,File:string,StartLine:int,EndLine:int,Match:string>>"


def _or(c: Column | str, other: object) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(other))


def _shape(df: DataFrame, **given: Column) -> DataFrame:
    kinds = {"line_number": "int", "end_line": "int", "cvss_score": "double", "confidence": "double", "references": "array<string>"}
    empty = {"int": F.lit(0), "double": F.lit(0.0), "array<string>": F.array().cast("array<string>")}
    return df.select(*[given.get(c, empty.get(kinds.get(c, ""), F.lit(""))).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def semgrep(reports: DataFrame) -> DataFrame:
    r = reports.select(F.explode(F.from_json("json", _SEMGREP)["results"]).alias("r"))
    severity = by_severity(F.upper(_or("r.extra.severity", "WARNING")), {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}, "MEDIUM")
    rule = F.element_at(F.split(_or("r.check_id", "Unknown Rule"), r"\."), -1)
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(""))
    return _shape(r, title=py_title(F.replace(rule, F.lit("-"), F.lit(" "))), description=_or("r.extra.message", "No description"), severity=severity, source=F.lit("semgrep"), file_path=_or("r.path", ""), line_number=_or("r.start.line", 0), end_line=_or("r.end.line", 0), code_snippet=_or("r.extra.lines", ""), cwe_id=first("r.extra.metadata.cwe"), owasp_category=first("r.extra.metadata.owasp"), confidence=F.lit(0.85), references=F.array(_or("r.extra.metadata.source", "")))


def bandit(reports: DataFrame) -> DataFrame:
    """end_line takes the end column, as reports of this tool have always been read."""
    r = reports.select(F.explode(F.from_json("json", _BANDIT)["results"]).alias("r"))
    severity = F.upper(_or("r.issue_severity", ""))
    return _shape(r, title=py_title(F.replace(_or("r.test_name", "Unknown Issue"), F.lit("_"), F.lit(" "))), description=_or("r.issue_text", "No description"), severity=F.when(severity.isin("HIGH", "LOW"), severity).otherwise("MEDIUM"), source=F.lit("bandit"), file_path=_or("r.filename", ""), line_number=_or("r.line_number", 0), end_line=F.coalesce("r.end_col_offset", "r.line_number", F.lit(0)), code_snippet=_or("r.code", ""), cwe_id=F.when(F.col("r.issue_cwe").isNotNull(), F.concat(F.lit("CWE-"), _or("r.issue_cwe.id", ""))).otherwise(""), confidence=by_severity(F.upper(_or("r.issue_confidence", "")), {"HIGH": 0.9, "MEDIUM": 0.7, "LOW": 0.5}, 0.7), references=F.array(F.concat(F.lit("https://bandit.readthedocs.io/en/latest/plugins/"), _or("r.test_id", ""))))


def trivy(reports: DataFrame) -> DataFrame:
    t = reports.select(F.explode(F.from_json("json", _TRIVY)["Results"]).alias("t"))
    v = t.select("t.Target", F.explode("t.Vulnerabilities").alias("v"))
    said = F.upper(_or("v.Severity", ""))
    score = F.get(F.filter(F.transform(F.map_values("v.CVSS"), lambda x: x["V3Score"]), lambda x: x.isNotNull()), F.lit(0))
    name, old, new = _or("v.PkgName", "unknown"), _or("v.InstalledVersion", ""), _or("v.FixedVersion", "")
    fix = F.when(new != "", F.concat(F.lit("Upgrade `"), name, F.lit("` from `"), old, F.lit("` to `"), new, F.lit("`"))).otherwise(F.concat(F.lit("No fix available yet for `"), name, F.lit("@"), old, F.lit("`")))
    found = _shape(v, title=F.concat(_or("v.VulnerabilityID", "CVE-Unknown"), F.lit(" in "), name), description=F.coalesce("v.Description", "v.Title", F.lit("No description")), severity=F.when(said.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), said).when(said == "UNKNOWN", "INFO").otherwise("MEDIUM"), source=F.lit("trivy"), file_path=_or("Target", ""), cwe_id=F.array_join(F.coalesce("v.CweIDs", F.array()), ", "), owasp_category=F.lit("A06:2021 Vulnerable Components"), cvss_score=F.coalesce(score, F.lit(0.0)), confidence=F.lit(0.95), remediation=fix, references=F.slice(F.coalesce("v.References", F.array().cast("array<string>")), 1, 3))
    s = t.select("t.Target", F.explode("t.Secrets").alias("s"))
    leaked = _shape(s, title=F.concat(F.lit("Secret Detected: "), _or("s.Category", "Unknown")), description=F.concat(F.lit("Hardcoded secret found: "), _or("s.Title", "")), severity=F.lit("HIGH"), source=F.lit("trivy"), file_path=_or("Target", ""), line_number=_or("s.StartLine", 0), end_line=_or("s.EndLine", 0), code_snippet=_or("s.Match", ""), cwe_id=F.lit("CWE-798"), owasp_category=F.lit("A07:2021 Auth Failures"), confidence=F.lit(0.9), remediation=F.lit("Move this secret into a vault or the environment."))
    return found.unionByName(leaked)


def gitleaks(reports: DataFrame) -> DataFrame:
    r = reports.select(F.explode(F.from_json("json", _GITLEAKS)).alias("r"))
    return _shape(r, title=F.concat(F.lit("Secret Leaked: "), _or("r.Description", "Unknown Secret")), description=F.concat(F.lit("Rule: "), _or("r.RuleID", "unknown"), F.lit(" — "), _or("r.Description", "")), severity=F.lit("HIGH"), source=F.lit("gitleaks"), file_path=_or("r.File", ""), line_number=_or("r.StartLine", 0), end_line=_or("r.EndLine", 0), code_snippet=F.substring(_or("r.Match", ""), 1, 200), cwe_id=F.lit("CWE-798"), owasp_category=F.lit("A07:2021 Auth Failures"), confidence=F.lit(0.92), remediation=F.lit("Remove and revoke the secret; read its successor from the environment or a vault."))


def npm_audit(reports: DataFrame) -> DataFrame:
    """The entries of `via` are strings or objects, so they stay VARIANT until read."""
    entry = "struct<severity:string,range:string,fixAvailable:variant,via:array<variant>>"
    r = reports.select(F.explode(F.from_json("json", f"struct<vulnerabilities:map<string,{entry}>>")["vulnerabilities"]).alias("pkg", "v"))
    via = F.coalesce("v.via", F.array().cast("array<variant>"))
    is_text = lambda x: F.schema_of_variant(x) == "STRING"
    said = F.filter(F.transform(via, lambda x: F.when(is_text(x), F.concat(F.lit("Transitive via "), F.try_variant_get(x, "$", "string"))).otherwise(F.try_variant_get(x, "$.title", "string"))), lambda x: F.coalesce(x, F.lit("")) != "")
    urls = F.filter(F.transform(via, lambda x: F.when(~is_text(x), F.try_variant_get(x, "$.url", "string"))), lambda x: F.coalesce(x, F.lit("")) != "")
    cwes = F.flatten(F.filter(F.transform(via, lambda x: F.when(~is_text(x), F.try_variant_get(x, "$.cwe", "array<string>"))), lambda x: x.isNotNull()))
    fixable = F.coalesce(F.try_variant_get("v.fixAvailable", "$", "boolean"), F.coalesce(F.schema_of_variant("v.fixAvailable"), F.lit("VOID")).startswith("OBJECT"))
    text = F.array_join(said, " | ")
    return _shape(r, title=F.concat(F.lit("Vulnerable Dependency: "), "pkg", F.lit("@"), _or("v.range", "?")), description=F.when(text != "", text).otherwise(F.concat(F.lit("Vulnerability in "), "pkg")), severity=by_severity(F.lower(_or("v.severity", "")), {"critical": "CRITICAL", "high": "HIGH", "moderate": "MEDIUM", "low": "LOW", "info": "INFO"}, "MEDIUM"), source=F.lit("npm_audit"), file_path=F.lit("package.json"), cwe_id=F.array_join(F.slice(cwes, 1, 2), ", "), owasp_category=F.lit("A06:2021 Vulnerable Components"), confidence=F.lit(0.95), remediation=F.when(fixable, "Run `npm audit fix`").otherwise(F.concat(F.lit("Upgrade `"), "pkg", F.lit("` by hand"))), references=F.slice(urls, 1, 3))


READERS = {"semgrep": semgrep, "bandit": bandit, "trivy": trivy, "gitleaks": gitleaks, "npm_audit": npm_audit}
