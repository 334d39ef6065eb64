import json

from lodestone.operators import context, incremental, report, scan, tables
from lodestone.plans import pipeline
from lodestone.sources import repo
from pyspark.sql import functions as F
from test_findings import frame, row


def text_of(lines):
    return "\n".join(r.text for r in lines.orderBy("section", "key").collect())


def test_documents_are_valid_json_of_any_number_of_findings(spark):
    rows = [row(1), row(2, severity="LOW", cwe_id="CWE-79", code_snippet="x", title='a "b"\n'), row(3, is_false_positive=True), row(4, cwe_id="CWE-79", finding_id="f4")]
    for n in (0, 1, 4):
        df = frame(spark, rows[:n])
        sarif = json.loads(text_of(report.sarif_document(df)))
        run = sarif["runs"][0]
        assert sarif["version"] == "2.1.0" and len(run["results"]) == min(n, 3) and {r["ruleId"] for r in run["results"]} == {r["id"] for r in run["tool"]["driver"]["rules"]}
        whole = json.loads(text_of(report.json_document(df)))
        assert sum(map(len, whole["findings"].values())) == min(n, 3) == whole["summary"]["total_confirmed"]


def test_written_documents_read_back(spark, tmp_path):
    report.write_document(report.json_document(frame(spark, [row(i) for i in range(50)])), str(tmp_path / "d"))
    parts = sorted(p for p in (tmp_path / "d").iterdir() if p.suffix == ".txt")
    assert len(json.loads("".join(p.read_text() for p in parts))["findings"]["HIGH"]) == 50


def test_advice_fills_only_what_is_empty(spark):
    rows = [row(1, cwe_id="cwe 89", reasoning_chain="", remediation="keep", code_snippet="requires login"), row(2, title="XSS in page", cwe_id="", reasoning_chain=" ", remediation="", code_snippet="x"), row(3, cwe_id="CWE-9999", remediation="", reasoning_chain="")]
    got = {r.seq: r for r in report.enriched(frame(spark, rows)).collect()}
    assert got[1].reasoning_chain == report.ADVICE[89][0] and got[1].remediation == "keep" and got[1].code_snippet == ""
    assert got[2].remediation == report.ADVICE[79][1] and got[2].remediation_code == report.ADVICE[79][2]
    assert got[3].reasoning_chain == "d" and "CWE-9999" in got[3].remediation


def test_tables_on_nulls_and_empty_input(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3), (2, None, 3)], "k int, s string, v int")
    tables.inserted(df, str(tmp_path / "t"))
    tables.inserted(df.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    assert [r.v for r in tables.updated(df, {"v": F.lit(9)}, F.col("s") == "a").orderBy("k").collect()] == [9, 3, 3]
    assert tables.counted(df.limit(0), some=F.col("v") > 1).first() == (0, 0, False)
    calls = spark.createDataFrame([(None, 2), (3, None)], "prompt_tokens int, completion_tokens int")
    assert tuple(tables.usage_totals(calls).first()) == (2, 3, 2, 5)
    same = spark.createDataFrame([("a", "h")], "rel_path string, sha256 string")
    assert tables.all_cached(df, incremental.diff(same, same)).count() == 3 and tables.all_cached(df, incremental.diff(same, same.limit(0))).count() == 0
    files = spark.createDataFrame([("b", "12345"), ("a", "123"), ("c", None), ("d", "1")], "path string, content string")
    d = spark.createDataFrame([(p, "added") for p in "abcd"], "rel_path string, status string")
    assert [r.path for r in tables.changed_context(files, d, 4).orderBy("path").collect()] == ["a", "b"]


def test_small_operators(spark):
    text = spark.createDataFrame([("list", None, ["x" * 300, "b"]), ("string", "t" * 3000, None), ("odd", "t", None)], "kind string, text string, items array<string>")
    got = [r.d for r in text.select(incremental.digest(F.col("kind"), F.col("text"), F.col("items")).alias("d")).collect()]
    assert got[0] == "2 items: " + "x" * 200 + "; b" and len(got[1]) == 2000 and got[2] is None
    assert context.reduction(200, 50) == 75.0 and context.reduction(0, 0) == 0.0
    files = spark.createDataFrame([("x/config/a.py", "A" * 5000), ("Dockerfile", "FROM x"), ("x/settings.py", " "), ("x/b.py", "no")], "path string, content string")
    kept = {r.path: len(r.content) for r in scan.config_files(files).collect()}
    assert kept == {"x/config/a.py": 4000, "Dockerfile": 6}
    assert {r.path for r in context.config_blocks(scan.config_files(files), most=3000).collect()} == {"Dockerfile"}
    urls = spark.createDataFrame([("git@a:b",), ("ftp://x",)], "u string")
    assert [r.g for r in urls.select(repo.is_git_url(F.col("u")).alias("g")).collect()] == [True, False]


def test_files_are_pruned_by_name_and_scanned_once(spark, tmp_path):
    for name, content in {"a.py": "def f(request):\n    eval(request.args)\n", "b.bin": "x", "node_modules/c.js": "y"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(content)
    found = repo.source_files(spark, str(tmp_path))
    assert [r.path for r in found.collect()] == ["a.py"]
    assert "pathGlobFilter" not in found.columns
    got = pipeline.full_scan(repo.files(spark, str(tmp_path), "*.py"))
    assert got.functions.count() == 1 and got.flows.count() > 0


def test_a_shared_checkpoint_folder_is_demanded_on_clusters():
    from lodestone import session

    class No:
        def isEmpty(self):
            return True

    class Fake:
        master = "spark://x"

        class conf:
            @staticmethod
            def get(*a):
                return None

        def getConf(self):
            return self.conf

        @property
        def _jsc(self):
            return type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(No)})())})()

    spark = type("P", (), {"sparkContext": Fake(), "conf": Fake.conf})()
    try:
        session.checkpoint_dir(spark)
    except RuntimeError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("no error")
