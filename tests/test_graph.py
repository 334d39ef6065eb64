import random
from collections import Counter

import pytest

from lodestone.operators import graph, symbols, taint


def functions(spark, n, sinks, sources, files=3):
    rows = [(i, i, f"f{i}", f"m{i % files}.py", i, i, "()", [], "eval(request.body)" if i in sinks and i in sources else "eval(" if i in sinks else "request.body" if i in sources else "", None, False) for i in range(n)]
    return symbols.flagged(spark.createDataFrame(rows, "func_id long, ordinal long, func_name string, file string, line int, end_line int, parameters string, calls array<string>, body string, parent_class string, is_exported boolean"))


def back_walks(edges, sinks, depth=5):
    callers, out = {}, Counter()
    for a, b in set(edges):
        callers.setdefault(b, []).append(a)

    def go(path):
        if len(path) > depth or not callers.get(path[-1]):
            out[tuple(reversed(path))] += 1
            return
        for c in callers[path[-1]]:
            if c in path[1:]:
                out[tuple(reversed(path))] += 1
            else:
                go([*path, c])

    for s in sinks:
        go([s])
    return out


def forward(edges, sources, sinks, depth=4):
    callees, out = {}, Counter()
    for a, b in set(edges):
        callees.setdefault(a, []).append(b)

    def go(path):
        if path[-1] in sinks and len(path) > 1:
            out[tuple(path)] += 1
        if len(path) <= depth:
            for c in callees.get(path[-1], []):
                if c not in path:
                    go([*path, c])

    for s in sources:
        go([s])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chains_and_paths_equal_a_plain_search(spark, seed):
    r = random.Random(seed)
    n = 14
    sinks, sources = set(r.sample(range(n), 3)), set(r.sample(range(n), 3))
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(24)] * 2
    f, e = functions(spark, n, sinks, sources), spark.createDataFrame(edges, "src_id long, dst_id long")
    assert Counter(tuple(x.path) for x in graph.chains_to_sinks(e, f).collect()) == back_walks(edges, sinks)
    assert Counter(tuple(x.path) for x in taint.forward_paths(e, f).collect()) == forward(edges, sources, sinks)


def test_flows_risk_and_stats(spark):
    rows = [
        (1, 1, "a", "x.py", 1, 2, "", ["b"], "q = request.args", None, False),
        (2, 2, "b", "x.py", 5, 6, "", ["c"], "int(q)", None, False),
        (3, 3, "c", "y.py", 1, 2, "", [], "cursor.execute(q)", None, False),
        (4, 4, "d", "z.py", 1, 2, "", [], "os.system(request.args)", None, False),
    ]
    f = symbols.flagged(spark.createDataFrame(rows, "func_id long, ordinal long, func_name string, file string, line int, end_line int, parameters string, calls array<string>, body string, parent_class string, is_exported boolean"))
    e = graph.call_edges(f, spark.createDataFrame([], "file string, name string, module string"))
    assert {(x.src_id, x.dst_id) for x in e.collect()} == {(1, 2), (2, 3)}
    got = {(x.source, x.src_id, x.sink, x.sink_id): (tuple(x.path), x.sanitizer, x.risk_level) for x in taint.flows(e, f).collect()}
    assert got["request.args", 4, "os.system", 4] == ((4,), None, "critical")
    assert got["request.args", 1, "cursor.execute", 3] == ((1, 2, 3), "int(", "safe")
    s = taint.flow_stats(taint.flows(e, f)).first()
    assert s.total_chains == s.vulnerable_chains + s.safe_chains and s.critical_chains >= 1


def test_resolution_prefers_file_then_import_then_unique_name(spark):
    rows = [(1, 1, "run", "a.py", ["help()", "x.util", "lone"]), (2, 2, "help", "a.py", []), (3, 3, "help", "b.py", []), (4, 4, "util", "b.py", []), (5, 5, "util", "c.py", []), (6, 6, "lone", "d.py", ["lone"])]
    f = spark.createDataFrame(rows, "func_id long, ordinal long, func_name string, file string, calls array<string>")
    imports = graph.import_map(spark.createDataFrame([("a.py", "from b import util, other")], "file string, text string"))
    assert {(x.src_id, x.dst_id) for x in graph.call_edges(f, imports).collect()} == {(1, 2), (1, 4), (1, 6), (6, 6)}
    assert {(x.src_id, x.dst_id) for x in graph.call_edges(f, imports.limit(0)).collect()} == {(1, 2), (1, 6), (6, 6)}


def test_callers_by_dotted_suffix(spark):
    f = spark.createDataFrame([(1, ["db.run"]), (2, ["run"]), (3, ["rerun"]), (4, None)], "func_id long, calls array<string>")
    assert {x.func_id for x in symbols.callers_by_name(f, spark.createDataFrame([("run",)], "func_name string")).collect()} == {1, 2}
