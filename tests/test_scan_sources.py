import re

from lodestone import dims
from lodestone.operators import incremental, scan
from lodestone.plans.pipeline import CapturedReports, PatternScanner, Registry, full_scan
from lodestone.sources import code, repo, tools
from lodestone.streaming import continuous

FILES = [
    ("app/login.py", "def verify(code):\n    if code == '123456':\n        return True\n"),
    ("app/user.js", "// login\nif (password.length < 8) {}\nif (confirmPassword.length < 8) {}\nlog(err.stack); return json\nx.stackTrace\n"),
    ("app/admin.ts", "export async function POST(req) {\n  return prisma.user.update(req.body)\n}\n"),
    ("app/admin_ok.ts", "export async function POST(req) { requireAuth; jwt }\n"),
    ("node_modules/x/login.py", "code = '123456'\n"),
    ("app/token.tsx", "const t = Math.random() // token\n"),
    ("app/env.py", "key = os.environ.get('API_KEY', 'abc')\n"),
    ("app/plain.py", "x = '123456'\n"),
    ("app/README", "nothing"),
]


def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


def plain_hits():
    out = set()
    for path, text in FILES:
        if any(p in dims.PATTERN_SKIPPED for p in path.split("/")[:-1]):
            continue
        for r in dims.RULES:
            if not path.endswith(r.extensions):
                continue
            for m in re.finditer(r.regex, text, re.IGNORECASE):
                n = text.count("\n", 0, m.start()) + 1
                near = "\n".join(text.split("\n")[max(0, n - 6) : n + 5]).lower()
                if r.absent and (any(a in text.lower() for a in r.absent) or not any(k in path.lower() for k in r.context)):
                    continue
                if any(k in near for k in r.context):
                    out.add((r.id, path, n, m[0]))
    return out


def test_pattern_hits_equal_a_plain_scan(spark):
    got = {(h.rule_id, h.path, h.line, h.match) for h in scan.pattern_hits(files(spark)).collect()}
    assert got == plain_hits() and len({g[0] for g in got}) >= 5
    assert scan.pattern_findings(files(spark)).count() == len({(a, b) for a, b, _, _ in got})


def test_stats_and_selection(spark):
    assert {(r.extension, r.files, r.lines) for r in scan.file_stats(files(spark)).collect()} >= {(".py", 3, 5), (".tsx", 1, 1)}
    one = scan.tech_stack(files(spark)).first()
    assert one.languages == ["JavaScript", "Python", "TypeScript"] and one.total_files == 7
    kept = scan.within_budget(files(spark), 60, 10).collect()
    assert sum(len(r.content) for r in kept) <= 60 + len("\n... [TRUNCATED]")


def test_marked_lines(spark):
    df = spark.createDataFrame([("a\nb\nc\nd\n", 2, 0)], "c string, l int, e int")
    assert df.select(scan.marked_lines(df.c, df.l, df.e, 1)).first()[0] == "       1 | a\n>>>    2 | b\n       3 | c"


def test_python_and_javascript_parsers():
    got = code.parse_python("import os\nX = 1\nclass A:\n    def m(self):\n        os.system(f(1))\n    @p\n    def d(self): pass\n@q\ndef g():\n    def h(): pass\n    h()\n")
    assert [(r["kind"], r["name"], r["parent_class"]) for r in got] == [("import", "", None), ("variable", "X", None), ("class", "A", None), ("function", "m", "A"), ("function", "g", None), ("function", "h", None)]
    assert got[3]["calls"] == ["os.system", "f"]
    js = code.parse_javascript("import { a } from './m';\nexport function f(x) { return g(x, '}'); }\nconst h = async (y) => { f(y) }\nclass K { run(z) { this.f(z) } }\n")
    assert [(r["kind"], r["name"], r["is_exported"], r["parent_class"]) for r in js if r["kind"] == "function"] == [("function", "f", True, None), ("function", "f", False, None), ("function", "h", False, None), ("function", "run", False, "K")]


def test_full_scan_and_registry(spark):
    reports = spark.createDataFrame([('[{"Description":"key","RuleID":"r","File":"app/env.py","StartLine":1,"Match":"k"}]',)], "json string")

    class Broken:
        name = "broken"

        def available(self):
            return True

        def scan(self, files):
            raise RuntimeError("no")

    registry = Registry().add(PatternScanner()).add(CapturedReports("gitleaks", reports)).add(Broken())
    s = full_scan(files(spark), registry)
    assert {r.source for r in s.findings.collect()} == {"semgrep", "gitleaks"} and registry.failed == {"broken": "no"}
    assert s.functions.count() >= 1 and s.edges.count() >= 0 and s.flows.count() >= 0


def test_tool_reports(spark):
    def one(reader, text):
        return reader(spark.createDataFrame([(text,)], "json string")).collect()

    t = one(tools.trivy, '{"Results":[{"Target":"p.lock","Vulnerabilities":[{"VulnerabilityID":"CVE-1","PkgName":"a","InstalledVersion":"1","FixedVersion":"2","Severity":"high","CVSS":{"x":{},"y":{"V3Score":7.5}},"CweIDs":["CWE-1","CWE-2"],"References":["a","b","c","d"]}],"Secrets":[{"Category":"c","Title":"t","StartLine":3}]},{"Target":"q"}]}')
    assert [(r.title, r.severity, r.cvss_score, r.cwe_id, len(r.references)) for r in t] == [("CVE-1 in a", "HIGH", 7.5, "CWE-1, CWE-2", 3), ("Secret Detected: c", "HIGH", 0.0, "CWE-798", 0)]
    b = one(tools.bandit, '{"results":[{"test_name":"hard_coded tmp","issue_severity":"LOW","issue_confidence":"HIGH","issue_cwe":{"id":377},"filename":"x.py","line_number":4,"end_col_offset":19}]}')
    assert (b[0].title, b[0].severity, b[0].confidence, b[0].cwe_id, b[0].end_line) == ("Hard Coded Tmp", "LOW", 0.9, "CWE-377", 19)
    n = one(tools.npm_audit, '{"vulnerabilities":{"p":{"severity":"moderate","range":"<1","fixAvailable":true,"via":["q",{"title":"bad","url":"u","cwe":["CWE-9"]}]}}}')
    assert (n[0].title, n[0].description, n[0].severity, n[0].cwe_id, n[0].references, n[0].remediation) == ("Vulnerable Dependency: p@<1", "Transitive via q | bad", "MEDIUM", "CWE-9", ["u"], "Run `npm audit fix`")
    g = one(tools.semgrep, '{"results":[{"check_id":"a.b.no-eval","extra":{"severity":"odd"}}]}')
    assert (g[0].title, g[0].severity, g[0].references) == ("No Eval", "MEDIUM", [""])
    assert one(tools.semgrep, "{}") == []


def test_snapshots_and_upserts(spark, tmp_path):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1"), ("z", "1")], "rel_path string, sha256 string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "rel_path string, sha256 string")
    d = incremental.diff(a, b)
    assert {(r.rel_path, r.status) for r in d.collect()} == {("x", "same"), ("y", "changed"), ("z", "removed"), ("w", "added")}
    root = str(tmp_path / "state")
    assert incremental.load_snapshot(spark, root) == {}
    incremental.save_snapshot(spark, root, files=a)
    incremental.save_snapshot(spark, root, files=b)
    assert incremental.load_snapshot(spark, root)["files"].count() == 3
    now = spark.createDataFrame([(1, "a", 3)], "k long, v string, n long")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1)], "k long, v string, at long")
    assert {tuple(r) for r in incremental.upserted(now, new, ["k"], "at", "n").collect()} == {(1, "c", 5), (2, "d", 1)}
    lines = spark.createDataFrame([("M\ta",), ("A\tb",), ("D\tc",), ("R100\told\tnew",), ("x",)], "value string")
    assert {tuple(r) for r in incremental.name_status(lines).collect()} == {("changed", "a"), ("added", "b"), ("removed", "c"), ("changed", "old\tnew")}
    assert ("added", "new") in {tuple(r) for r in incremental.name_status(lines, True).collect()}


def test_repo_reader_and_urls(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.py").write_text("y")
    assert [(r.path, r.content) for r in repo.source_files(spark, str(tmp_path)).collect()] == [("src/a.py", "x = 1\n")]
    u = spark.createDataFrame([("https://u:p@h.example/r?token=1&a=2&Key=3#f",)], "u string")
    assert u.select(repo.sanitised_url(u.u)).first()[0] == "https://h.example/r?a=2"


def test_continuous_scan_and_windows(spark, tmp_path):
    files(spark).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = continuous.landing(spark, str(tmp_path / "in"), files(spark).schema)
    q = continuous.continuous_scan(stream, lambda df, n: seen.extend(r.rule_id for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert len(seen) == len(plain_hits())
    events = spark.sql("select timestamp_seconds(x * 600) as ts, 'a' as event_type, cast(1 as double) as value from range(12) t(x)")
    assert sorted(r.n for r in continuous.windowed_counts(events).collect()) == [6, 6]


def test_files_without_text_take_no_room_in_the_budget(spark):
    empty = [(f"e{i:03}.py", "" if i % 2 else None) for i in range(100)]
    df = spark.createDataFrame([*empty, ("a.py", "x" * 20), ("b.py", "y" * 30), ("c.py", "z" * 40)], "path string, content string")
    kept = {r.path: r.content for r in scan.within_budget(df, 60, 50).collect()}
    assert kept == {**dict(empty), "a.py": "x" * 20, "b.py": "y" * 30}
