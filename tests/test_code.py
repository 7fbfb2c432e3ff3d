import random

import pytest

from stratalog.operators import graphs
from stratalog.packs.code import Code


def pairs(frame):
    return {tuple(r) for r in frame.collect()}


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(3)
    edges = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(22)})
    return edges, spark.createDataFrame(edges, "a long, b long")


def closed(edges):
    out = set(edges)
    while True:
        new = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not new:
            return out
        out |= new


def test_closure_and_reach(spark, graph):
    edges, frame = graph
    assert pairs(graphs.closure(frame)) == closed(edges)
    seeds = spark.createDataFrame([(edges[0][0],)], "n long")
    start = edges[0][0]
    assert {n for (n,) in pairs(graphs.reach(frame, seeds))} == {start} | {b for a, b in closed(edges) if a == start}
    assert pairs(graphs.reach_from(frame, seeds)) == {(a, b) for a, b in closed(edges) if a == start}
    nodes = spark.range(14).toDF("n")
    both = closed([*edges, *[(b, a) for a, b in edges]])
    assert pairs(graphs.groups(frame, nodes)) == {(n, min([n, *[b for a, b in both if a == n]])) for n in range(14)}


def test_dominators(spark):
    edges = [(0, 1), (1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (6, 5)]
    nodes = spark.createDataFrame([("f", n) for n in range(7)], "fn string, node long")
    frame, entry = spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([("f", 0)], "fn string, node long")
    found = graphs.dominators(nodes, frame, entry)
    live = {0} | {b for a, b in closed(edges) if a == 0}
    expected = {(d, n) for n in live for d in range(7) if d == 0 or d == n or n not in {0} | {b for a, b in closed([(x, y) for x, y in edges if d not in (x, y)]) if a == 0}}
    assert pairs(found) == expected
    assert pairs(graphs.back_edges(frame, found)) == {(4, 1)}


def test_flow(spark):
    nodes = [(0, "f", "entry", 1), (1, "f", "stmt", 2), (2, "f", "stmt", 3), (3, "f", "stmt", 4), (4, "f", "stmt", 5)]
    code = Code(
        flow_node=spark.createDataFrame(nodes, "id long, fn string, kind string, line long"),
        flow_edge=spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 2)], "from long, to long"),
        **{"def": spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "node long, var string"), "use": spark.createDataFrame([(2, "x"), (3, "z")], "node long, var string")},
        captures=spark.createDataFrame([], "fn string, var string"),
        symbol=spark.createDataFrame([(v, "local", "f") for v in "xyz"], "id string, kind string, parent string"),
    )
    assert pairs(code.unreachable(("stmt",))) == {("f", 4, 5)}
    assert pairs(code.def_use()) == {(1, 2, "x"), (3, 2, "x")}
    assert pairs(code.undefined_use()) == {(3, "z")}
    assert pairs(code.dead_store()) == {(2, "y", 3)}
    assert pairs(code.loop_header()) == {("f", 2)}


def symbols(spark, rows):
    full = [(r.get("id"), r.get("kind", "class"), r.get("name", "n"), r.get("origin", "project"), r.get("file"), r.get("parent"), r.get("is_static", False), r.get("is_abstract"), r.get("exported", True)) for r in rows]
    return spark.createDataFrame(full, "id string, kind string, name string, origin string, file string, parent string, is_static boolean, is_abstract boolean, exported boolean")


def test_metrics(spark):
    rows = [{"id": "A", "file": "a"}, {"id": "B", "file": "b"}, {"id": "I", "kind": "interface", "file": "b"}]
    rows += [{"id": m, "kind": "method", "parent": "A"} for m in ("m1", "m2", "m3")] + [{"id": f, "kind": "property", "parent": "A"} for f in ("f1", "f2")]
    code = Code(
        symbol=symbols(spark, rows), extends=spark.createDataFrame([("B", "A"), ("A", "L")], "child string, parent string"),
        fn=spark.createDataFrame([("m1", 2), ("m2", 3), ("m3", 1)], "id string, cyclomatic long"),
        call_site=spark.createDataFrame([(1, "m1", "m2", "static"), (2, "m1", "x", "virtual"), (3, "m2", "m1", "static")], "id long, caller string, callee string, dispatch string"),
        overrides=spark.createDataFrame([("y", "x"), ("z", "y")], "member string, base string"),
        member_access=spark.createDataFrame([("m1", "f1", "A", True), ("m2", "f1", "A", True), ("m3", "f2", "A", True), ("m3", "f1", "A", False)], "fn string, member string, owner string, via_this boolean"),
    )
    assert pairs(code.call_edge()) == {("m1", "m2"), ("m2", "m1"), ("m1", "x"), ("m1", "y"), ("m1", "z")}
    assert pairs(code.recursive()) == {("m1",), ("m2",)} and pairs(code.mutual()) == {("m1", "m2")}
    assert pairs(code.dit()) == {("A", 1), ("B", 2)} and pairs(code.noc()) == {("A", 1), ("B", 0)}
    assert pairs(code.wmc()) == {("A", 6), ("B", None)} and pairs(code.rfc()) == {("A", 6), ("B", 0)}
    assert pairs(code.fan_out()) == {("m1", 4), ("m2", 1), ("m3", 0)} and pairs(code.fan_in()) == {("m1", 1), ("m2", 1), ("m3", 0)}
    assert pairs(code.lcom4()) == {("A", 2), ("B", 0)}
    assert pairs(code.tcc()) == {("A", 1 / 3)} and pairs(code.lcom_hs()) == {("A", (1.5 - 3) / (1 - 3))}


def test_coupling_and_history(spark):
    files = spark.createDataFrame([(f, "p", f == "t", None) for f in ("a", "b", "c", "t")], "path string, package string, is_test boolean, namespace string")
    code = Code(
        file=files, symbol=symbols(spark, [{"id": "A", "file": "a", "is_abstract": True}, {"id": "B", "file": "b"}, {"id": "C", "file": "c"}]),
        ref=spark.createDataFrame([("A", "B", "use", 1), ("B", "C", "use", 2), ("A", "B", "use", 3)], "from string, to string, kind string, line long"),
        file_member=spark.createDataFrame([("a", -1, "ca"), ("b", -1, "cb"), ("c", -1, "cc")], "file string, grain long, comp string"),
        imports=spark.createDataFrame([("a", "b", None, True, "static", False, None)], "file string, target_file string, target_package string, runtime boolean, kind string, builtin boolean, unresolved_package string"),
        commit=spark.createDataFrame([("1", "x@", 1, 2), ("2", "y@", 2, 3), ("3", "x@", 3, 2), ("4", "x@", 4, 99)], "sha string, email string, time long, files long"),
        touch=spark.createDataFrame([("1", "a", 1, 0), ("1", "b", 2, None), ("2", "a", 1, 1), ("2", "b", 1, 1), ("2", "c", 5, 5), ("3", "a", 1, 1), ("3", "c", 1, 1), ("4", "a", 100, 100)], "sha string, path_now string, added long, deleted long"),
    )
    assert pairs(code.comp_edge_weight()) == {(-1, "ca", "cb", 2), (-1, "cb", "cc", 1)}
    assert pairs(code.instability()) == {(-1, "ca", 1.0), (-1, "cb", 0.5), (-1, "cc", 0.0)} and pairs(code.sdp_violation()) == set()
    assert pairs(code.distance()) == {(-1, "ca", 1.0), (-1, "cb", 0.5), (-1, "cc", 1.0)}
    assert pairs(code.cochange()) == {("a", "b", 2), ("a", "c", 2), ("b", "c", 1)}
    assert ("a", "b", 2 / 3) in pairs(code.confidence()) and ("b", "a", 1.0) in pairs(code.confidence())
    assert pairs(code.hidden_coupling()) == {("a", "c", 2)}
    assert pairs(code.churn()) == {("a", 3, 2), ("b", 3, 1), ("c", 6, 6), ("t", None, None)}
    assert pairs(code.main_author()) == {("a", "x@", 2 / 3), ("b", "x@", 0.5), ("b", "y@", 0.5), ("c", "x@", 0.5), ("c", "y@", 0.5)}
    assert pairs(code.revisions()) == {("a", 3), ("b", 2), ("c", 2), ("t", 0)}
    assert pairs(code.violations({"file": ["path"]}, [("touch", "sha", "commit", "sha"), ("touch", "path_now", "file", "path")], {("imports", "kind"): ["dynamic"]})) == {("imports.kind has another value", "static")}


def test_packages(spark):
    code = Code(
        file=spark.createDataFrame([("s", "p", False), ("t", "p", True)], "path string, package string, is_test boolean"),
        imports=spark.createDataFrame([("s", None, "r", True, "static", False, None), ("t", None, "d", True, "static", False, None), ("s", None, "d", None, "static", False, None), ("s", None, "ty", False, "type_only", False, None), ("s", None, None, True, "static", False, "g"), ("t", None, "only", True, "static", False, None)], "file string, target_file string, target_package string, runtime boolean, kind string, builtin boolean, unresolved_package string"),
        package_dep=spark.createDataFrame([("p", "d", "dev", None), ("p", "ty", "prod", None), ("p", "idle", "prod", None), ("p", "@types/r", "dev", "r"), ("p", "only", "prod", None)], "package string, dep string, kind string, types_for string"),
    )
    assert pairs(code.undeclared()) == {("p", "r", "s")}
    assert pairs(code.unused()) == {("p", "idle", "prod")}
    assert pairs(code.dev_in_production()) == {("p", "d", "s")}
    assert pairs(code.only_in_tests()) == {("p", "only")} and pairs(code.types_only()) == {("p", "ty")}


def test_points_to(spark):
    e = lambda schema, rows=(): spark.createDataFrame(list(rows), schema)
    code = Code(
        alloc=e("var string, site long, kind string, type string, fn_target string", [("a", 1, "object", None, None), ("b", 2, "object", None, None), ("f", 3, "function", None, "g")]),
        assign=e("to string, from string, kind string", [("c", "a", "copy"), ("h", "f", "copy"), ("q", "a", "op")]),
        store=e("base string, field string, from string", [("c", "x", "b")]), load=e("to string, base string, field string", [("d", "a", "x")]),
        call_site=e("id long, caller string, callee string, dispatch string", [(10, "main", None, "indirect"), (11, "main", None, "indirect")]),
        callee_var=e("call_site long, var string", [(10, "h")]), actual=e("call_site long, index long, var string", [(10, 0, "d")]), formal=e("fn string, index long, var string", [("g", 0, "p")]),
        formal_ret=e("fn string, var string", [("g", "p")]), actual_ret=e("call_site long, var string", [(10, "r")]), this_var=e("fn string, var string"), receiver=e("call_site long, var string"),
        var=e("id string, fn string, kind string"), extends=e("child string, parent string"), overrides=e("member string, base string"), symbol=symbols(spark, [{"id": "z", "kind": "function"}]),
    )
    assert pairs(code.points_to["pts"]) == {("a", "1"), ("b", "2"), ("c", "1"), ("d", "2"), ("f", "3"), ("h", "3"), ("p", "2"), ("r", "2")}
    assert pairs(code.points_to["heap"]) == {("1", "x", "2")}
    assert pairs(code.call_edge_pt()) == {("main", "g")} and pairs(code.unresolved_call()) == {("11",)}
    assert {v for (v,) in pairs(code.tainted(e("v string", [("b",)])))} == {"b", "d", "p", "r"}


def test_modules(spark):
    code = Code(
        file=spark.createDataFrame([(f, "p" if f < "c" else "q", f"n{f}") for f in "abcd"], "path string, package string, namespace string"),
        imports=spark.createDataFrame([("a", "b", None, True, "static"), ("b", "a", None, None, "static"), ("b", "c", None, None, "type_only"), ("c", "c", "x", True, "static"), ("c", None, "x", True, "static")], "file string, target_file string, target_package string, runtime boolean, kind string"),
        file_ancestor=spark.createDataFrame([("a", "d1", 0), ("b", "d1", 0), ("c", "d2", 0)], "file string, dir string, depth long"),
    )
    assert pairs(code.dep()) == {("a", "b"), ("b", "a"), ("b", "c")} and pairs(code.runtime_dep()) == {("a", "b"), ("b", "a")}
    assert pairs(code.in_cycle()) == {("a",), ("b",)} and pairs(code.cycle_edge()) == {("a", "b"), ("b", "a")}
    assert pairs(code.unit_dep()) == {(0, "d1", "d2")} and pairs(code.package_edge()) == {("p", "q")} and pairs(code.external_dep()) == {("c", "x")}
    assert pairs(code.in_namespace_cycle()) == {("na",), ("nb",)}
    assert {r.what: r.n for r in code.summary().collect()} == {"file": 4, "imports": 5, "file_ancestor": 3}
