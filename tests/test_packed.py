import random

from lodestone.operators import packed

VALUES = ["https://a.example/x/y", "https://b.test/q?id=1&v=2", "https://c.invalid/z#top", "CVE-2091-1234", "ADV-2090-77", "https://d.example/role/incident"]


def column(n=400, seed=5):
    r = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        items = [r.choice(VALUES) for _ in range(r.choice([1, 1, 2, 3, 4]))]
        style = r.choice([";", "; ", ",", "|", " | ", "\n", "\r\n", "\t", " ", ";;", '"', "[", "['"])
        if style == '"':
            items = [x if r.random() < 0.5 else f'The "{x[-3:]}" memo, part; 3' for x in items]
            text = "; ".join('"' + x.replace('"', '""') + '"' for x in items)
        elif style == "[":
            text = "[" + ", ".join(f'"{x}"' for x in items) + "]"
        elif style == "['":
            text = "[" + ", ".join(f"'{x}'" for x in items) + "]"
        else:
            text = style.join(items)
        rows.append((i, "refs", text))
        if len(items) > 1:
            truth[i] = items
    return rows, truth


def test_split_matches_what_was_joined(spark):
    rows, truth = column()
    got = packed.split_values(spark.createDataFrame(rows, "seq long, field_name string, value string")).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.seq, r.pos)):
        found.setdefault(r.seq, []).append(r.item)
    assert found == truth
    assert all([r.pos for r in sorted(got, key=lambda r: r.pos) if r.seq == s] == list(range(1, len(v) + 1)) for s, v in list(truth.items())[:40])


def test_titles_quotes_stand_ins_and_empty_slots(spark):
    cwe = [f"CWE-{i}; cwe-{i + 1}" for i in range(60)] + [f"CWE-{i}, CWE-{i + 7}, CWE-3" for i in range(60)]
    special = {
        1000: ("CWE-345: Origin of a message, delayed; or not", []),
        1001: ('CWE-1: One thing,"CWE-2: Two, three"', ["CWE-1: One thing", "CWE-2: Two, three"]),
        1002: ("n/a", []),
        1003: (None, []),
        1004: ("  ", []),
        1005: (";;CWE-1;;CWE-2;", ["CWE-1", "CWE-2"]),
        1006: ("CWE-9 and CWE-9", ["CWE-9", "CWE-9"]),
        1007: ("N/A", []),
    }
    rows = [(i, "cwe_id", v) for i, v in enumerate(cwe)] + [(k, "cwe_id", v) for k, (v, _) in special.items()]
    df = spark.createDataFrame(rows, "seq long, field_name string, value string").selectExpr("*", "1 as pos", "'x' as item")
    got = packed.split_values(df).where("seq >= 1000").collect()
    for k, (_, want) in special.items():
        assert [r.item for r in sorted(got, key=lambda r: r.pos) if r.seq == k] == want, k


def test_empty_table(spark):
    assert packed.split_values(spark.createDataFrame([], "seq long, field_name string, value string")).collect() == []


def test_very_long_field(spark):
    rows = [(i, "refs", "CVE-2091-1;CVE-2091-2") for i in range(50)] + [(99, "refs", ";".join(["CVE-2091-5"] * 3000))]
    got = packed.split_values(spark.createDataFrame(rows, "seq long, field_name string, value string")).where("seq = 99").count()
    assert got == 3000


def test_items_of_many_atoms_stay_whole(spark):
    deep = "https://github.example/org/repo/blob/main/src/main/java/com/acme/auth/Login.java"
    prose = "Notes of the vendor about a flaw in the parser that all users read"
    assert len(packed.lattice(deep)[1]) == 14 and len(packed.lattice(prose)[1]) == 14
    special = {
        1000: (deep, []),
        1001: (f"CVE-2091-1; {deep}; https://a.example/x/y", ["CVE-2091-1", deep, "https://a.example/x/y"]),
        1002: (prose, []),
        1003: (f"{prose}; CVE-2091-1", [prose, "CVE-2091-1"]),
        1004: (f"{deep}\n{deep}", [deep, deep]),
        1005: ("; ".join([*["CVE-2091-1"] * 60, deep]), ["CVE-2091-1"] * 60 + [deep]),
    }
    rows = [*column()[0], *((k, "refs", v) for k, (v, _) in special.items())]
    got = packed.split_values(spark.createDataFrame(rows, "seq long, field_name string, value string")).where("seq >= 1000").collect()
    for k, (_, want) in special.items():
        assert [r.item for r in sorted(got, key=lambda r: r.pos) if r.seq == k] == want, k


def test_control_characters_and_long_prose(spark):
    prose = " ".join(f"word{'abcdefghij'[k % 10]}" for k in range(30))
    special = {1000: ("a\x1eb\x1fc", []), 1001: ("CVE-2091-1\x1f; CVE-2091-2", ["CVE-2091-1", "CVE-2091-2"]), 1002: (prose, [])}
    rows = [*column()[0], *((k, "refs", v) for k, (v, _) in special.items())]
    got = packed.split_values(spark.createDataFrame(rows, "seq long, field_name string, value string")).where("seq >= 1000").collect()
    for k, (_, want) in special.items():
        assert [r.item for r in sorted(got, key=lambda r: r.pos) if r.seq == k] == want, k
