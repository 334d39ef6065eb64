import math
import random

from lodestone.operators import findings as fnd
from lodestone.operators import protocol, report

SCHEMA = "seq long, title string, description string, severity string, source string, file_path string, line_number int, end_line int, code_snippet string, cwe_id string, owasp_category string, confidence double, remediation string, remediation_code string, reasoning_chain string, is_false_positive boolean, false_positive_reason string, finding_id string"


def row(seq, **k):
    base = dict(seq=seq, title="T", description="d", severity="HIGH", source="semgrep", file_path="a/b.py", line_number=1, end_line=0, code_snippet="", cwe_id="", owasp_category="", confidence=0.8, remediation="", remediation_code="", reasoning_chain="", is_false_positive=False, false_positive_reason=None, finding_id="x")
    return tuple({**base, **k}.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_risk_score(spark):
    rows = [row(1), row(2), row(3, title="U", severity="LOW", confidence=0.0), row(4, title="V", severity="CRITICAL", confidence=9.0), row(5, title="W", is_false_positive=True)]
    r = fnd.risk_scores(frame(spark, rows)).first()
    w = (8 * 0.8 + 3 * 0.7 + 10 * 1.0) / (0.8 + 0.7 + 1.0) + min(2, math.log1p(3) * 0.8)
    assert r.unique_findings == 3 and abs(r.risk_score - min(10, w)) < 1e-9
    assert fnd.risk_scores(frame(spark, [])).first().risk_score == 0.0


def test_rules_never_clear_and_spare_dependencies(spark):
    rows = [row(1, file_path="x/tests/a.py"), row(2, file_path="x/tests/a.py", title="CVE-2020-1 in y"), row(3, is_false_positive=True, false_positive_reason="old"), row(4, title="Hardcoded secret", code_snippet="k = os.environ['K']"), row(5, title="Hardcoded secret", code_snippet="os.environ.get('K', 'v')"), row(6, file_path="package-lock.json"), row(7, title=None, file_path=None, code_snippet=None, description=None, source=None, confidence=None)]
    got = {r.seq: (r.is_false_positive, r.false_positive_reason) for r in fnd.rule_filtered(frame(spark, rows)).collect()}
    assert got[1] == (True, "test or example code") and got[2] == (False, None) and got[3] == (True, "old")
    assert got[4] == (True, "safe by the framework") and got[5][0] is False and got[6][0] is True and got[7] == (False, None)


def groups_plain(keys):
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first = {}
    for i, ks in enumerate(keys):
        for k in ks:
            a, b = root(i), root(first.setdefault(k, i))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(keys))]


def test_report_groups_unique_and_fold(spark):
    r = random.Random(3)
    rows = [row(i, title=r.choice(["A", "B", "CVE-2020-1 x"]), file_path=r.choice(["a.py", "package.json", "workspace/r/a.py"]), line_number=r.choice([1, 2]), cwe_id=r.choice(["", "CWE-1: n", "cwe-1"]), severity=r.choice(["HIGH", "LOW"]), confidence=r.choice([0.5, 0.9]), remediation=r.choice(["", "fix"]), description=r.choice(["d", "e"])) for i in range(60)]
    df = frame(spark, rows)
    keyed = df.select("seq", fnd.report_keys(fnd.relative_path(df.file_path, fnd.F.lit(""))).alias("k")).orderBy("seq").collect()
    want = groups_plain([x.k for x in keyed])
    assert [x.group for x in fnd.report_groups(df).orderBy("seq").collect()] == want
    once = fnd.report_unique(df)
    assert once.count() == len(set(want)) and sorted(x.seq for x in fnd.report_unique(once).collect()) == sorted(x.seq for x in once.collect())
    seen, slots = {}, []
    for x, k in zip(df.orderBy("seq").collect(), keyed):
        have = next((seen[q] for q in k.k if q in seen), None)
        if have is None:
            slots.append([x, x.seq])
            seen.update({q: (x, slots[-1]) for q in k.k})
        else:
            old, slot = have
            score = {"HIGH": 8, "LOW": 3}
            if x.confidence > old.confidence or (x.remediation and not old.remediation) or score[x.severity] > score[old.severity]:
                if slot[0] is old:
                    slot[0] = x
                seen.update({q: (x, slot) for q in k.k})
    assert {(x.seq, x.slot_seq) for x in fnd.report_fold(df).collect()} == {(a.seq, b) for a, b in slots}


def test_numbers_are_dense_without_one_task(spark):
    df = frame(spark, [row(i, severity="LOW" if i % 3 else "HIGH") for i in range(200)])
    got = [(r.seq, r.report_index) for r in fnd.report_index(df).orderBy("report_index").collect()]
    assert [i for _, i in got] == list(range(1, 201)) and got[0][0] == 0


def test_validation_only_lowers_and_spares(spark):
    rows = [row(1, severity="MEDIUM"), row(2, severity="CRITICAL"), row(3, severity="LOW", file_path="z/b.py"), row(4, severity="LOW", file_path="other.py")]
    text = "".join(f"VALIDATION: {i}\n- Verdict: {v}\n- Duplicate Of: {dup}\n- Corrected Severity: {s}\n" for i, v, dup, s in [(1, "FIX", "none", "critical"), (2, "REMOVE", "none", "low"), (3, "REMOVE", "#1", "info"), (4, "REMOVE", "#1", "info")])
    said = protocol.validations(spark.createDataFrame([(1, text)], "id long, text string"))
    got = {r.seq: (r.severity, r.removed, r.fixed) for r in protocol.validated(fnd.batches(frame(spark, rows)), said).collect()}
    assert got == {1: ("MEDIUM", False, True), 2: ("CRITICAL", False, False), 3: ("LOW", True, False), 4: ("LOW", False, False)}


def test_verification_and_remediation(spark):
    rows = [row(1, title="SQL in login"), row(2, title="Other", remediation="keep")]
    v = protocol.verifications(spark.createDataFrame([(1, "VERIFICATION:\n- Finding: sql in LOGIN page\n- Verdict: FALSE_POSITIVE\n- Confidence: 7\n- Reasoning: because\n- Adjusted Severity: low\n")], "id long, text string"))
    a = {r.seq: r for r in protocol.verified(frame(spark, rows), v).collect()}
    assert (a[1].confidence, a[1].is_false_positive, a[1].false_positive_reason, a[1].severity, a[1].reasoning_chain) == (1.0, True, "because", "LOW", "because") and a[2].severity == "HIGH"
    m = protocol.remediations(spark.createDataFrame([(1, "REMEDIATION:\nVulnerability: other\nFix Strategy: one\n```\nx\n```\nREMEDIATION:\nVulnerability: Other\nFix Strategy: two\n")], "id long, text string"))
    b = {r.seq: r for r in protocol.remediated(frame(spark, rows), m).collect()}
    assert b[2].remediation == "two. one. keep" and b[2].remediation_code == "x" and b[1].remediation == ""


def test_finding_blocks_in_all_header_forms(spark):
    text = "intro\n**VULNERABILITY:**\n- **Title**: A\n- File: `a.py`\n- Line: 12-14\n### Finding\nName: B\nPath: b.py\nRisk: critical\nDetails: x\nmore\n2. ISSUE:\nTitle: No vulnerabilities\nFile: c.py\nFINDING:\nTitle: C\nFile: n/a\n"
    got = protocol.parsed_findings(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("block_no").collect()
    assert [(r.title, r.file_path, r.line_number, r.severity) for r in got] == [("A", "a.py", 12, "MEDIUM"), ("B", "b.py", 0, "CRITICAL")] and got[1].description == "x\nmore"


def test_reports_on_empty_and_null_rows(spark):
    df = frame(spark, [row(1, title=None, description=None, file_path=None, code_snippet=None, cwe_id=None, confidence=None, line_number=None, end_line=None)])
    assert report.markdown_rows(df).count() == 4 and report.sarif_lines(df).count() == 2 and report.json_findings(df).count() == 1
    assert report.summary(frame(spark, [])).first().assessment == "NONE"
