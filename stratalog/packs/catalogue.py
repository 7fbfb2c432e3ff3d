"""Queries over the star-schema and event tables, one or more for each operator, with the same question in SQL.

Answers are the question's variables, lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine


@dataclass(frozen=True)
class Item:
    tables: str
    program: str
    question: str
    sql: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        for t in self.tables.split():
            engine.register(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        found = engine.load(self.program).query(self.question)
        return found.toDF(*[c.lower() for c in found.columns])


# Graphs derived from the tables.
TREE = "edge(C, P) :- part(p_partkey: C), P = C / 2, P >= 1. "
TREE_SQL = "WITH RECURSIVE edge AS (SELECT p_partkey AS c, p_partkey // 2 AS p FROM part WHERE p_partkey // 2 >= 1)"
RING = "edge(A, B) :- customer(c_custkey: K, c_nationkey: A), B = K * 7 - K * 7 / 25 * 25. "
RING_SQL = "WITH RECURSIVE edge AS (SELECT DISTINCT c_nationkey::BIGINT AS a, (c_custkey * 7) % 25 AS b FROM customer)"
TURNS = "edge(C, A, B) :- conversations(conv_id: C, turn: A), conversations(conv_id: C, turn: B), B = A + 1. "
TURNS_SQL = "WITH RECURSIVE edge AS (SELECT DISTINCT x.conv_id AS c, x.turn AS a, y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"
# A control-flow graph of the parts: each leads to the next and to its double, every tenth ends.
FLOW = "node(N) :- part(p_partkey: N). flow(A, B) :- node(A), node(B), B = A + 1, A - A / 10 * 10 != 0. flow(A, B) :- node(A), node(B), B = A * 2. defines(N, V) :- node(N), V = N - N / 4 * 4. uses(N, V) :- node(N), V = N / 2 - N / 8 * 4. "
FLOW_SQL = """WITH RECURSIVE node AS (SELECT p_partkey AS n FROM part),
flow AS (SELECT x.n AS a, y.n AS b FROM node x JOIN node y ON y.n = x.n + 1 AND x.n % 10 <> 0 UNION SELECT x.n, y.n FROM node x JOIN node y ON y.n = x.n * 2),
defines AS (SELECT n, n % 4 AS v FROM node), uses AS (SELECT n, n // 2 - n // 8 * 4 AS v FROM node)"""
# Where pairs of nodes are asked for, the parts are dealt into functions (trees, 64 parts each; 40 or 60 else) so that all
# parts take part and the pairs stay within a function: F is it, the rest counts from 0 in it.
FLOWS = "node(F, N) :- part(p_partkey: P), F = P / 40, N = P - P / 40 * 40. flow(F, A, B) :- node(F, A), node(F, B), B = A + 1, A - A / 10 * 10 != 0. flow(F, A, B) :- node(F, A), node(F, B), B = A * 2. "
FLOWS_SQL = """WITH RECURSIVE node AS (SELECT p_partkey // 40 AS f, p_partkey % 40 AS n FROM part),
flow AS (SELECT x.f, x.n AS a, y.n AS b FROM node x JOIN node y ON y.f = x.f AND y.n = x.n + 1 AND x.n % 10 <> 0 UNION SELECT x.f, x.n, y.n FROM node x JOIN node y ON y.f = x.f AND y.n = x.n * 2)"""
TREES = "edge(F, C, P) :- part(p_partkey: K), F = K / 64, C = K - K / 64 * 64, P = C / 2, P >= 1. "
TREES_SQL = "WITH RECURSIVE edge AS (SELECT p_partkey // 64 AS f, p_partkey % 64 AS c, p_partkey % 64 // 2 AS p FROM part WHERE p_partkey % 64 // 2 >= 1)"

ITEMS: dict[str, Item] = {
    # projection and filter
    "scan_named": Item("customer", "", "customer(c_custkey: K, c_nationkey: N, c_acctbal: B), B > 5000.0", "SELECT DISTINCT c_custkey AS k, c_nationkey::BIGINT AS n, c_acctbal AS b FROM customer WHERE c_acctbal > 5000"),
    "const_match": Item("nation", "", "nation(n_name: N, n_regionkey: 1, n_nationkey: K)", "SELECT DISTINCT n_name AS n, n_nationkey::BIGINT AS k FROM nation WHERE n_regionkey = 1"),
    "repeat_var": Item("lineitem", "", "lineitem(l_partkey: K, l_suppkey: K)", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey = l_suppkey"),
    "wildcard_distinct": Item("lineitem", "", "lineitem(l_returnflag: R, l_linestatus: S, l_tax: _)", "SELECT DISTINCT l_returnflag AS r, l_linestatus AS s FROM lineitem"),
    "filter_cmp": Item("orders", "", 'orders(o_orderkey: K, o_orderstatus: S, o_totalprice: T, o_orderpriority: P), T >= 100000.0, S != "O", P < "3"', "SELECT DISTINCT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS t, o_orderpriority AS p FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'O' AND o_orderpriority < '3'"),
    "head_expression": Item("lineitem", 'priced(K, L, Q * 2.0 + 1.0, "double") :- lineitem(l_orderkey: K, l_linenumber: L, l_quantity: Q).', "priced(K, L, V, W)", "SELECT DISTINCT l_orderkey AS k, l_linenumber::BIGINT AS l, l_quantity * 2 + 1 AS v, 'double' AS w FROM lineitem"),
    "assignment_order": Item("part", "", "D = C - A, C = A * 3, part(p_partkey: A, p_size: S), D > S", "SELECT DISTINCT a * 3 - a AS d, a * 3 AS c, a, s FROM (SELECT p_partkey AS a, p_size::BIGINT AS s FROM part) WHERE a * 2 > s"),
    "presence_absent": Item("orders", "rank(K, V) :- orders(o_orderkey: K, o_orderpriority: P), V = P as int. known(K) :- rank(K, V), V is not absent.", "orders(o_orderkey: K), not known(K)", "SELECT DISTINCT o_orderkey AS k FROM orders WHERE TRY_CAST(o_orderpriority AS BIGINT) IS NULL"),
    # joins
    "join_3way": Item("customer orders lineitem", "", "customer(c_custkey: C, c_nationkey: N), orders(o_orderkey: O, o_custkey: C), lineitem(l_orderkey: O, l_suppkey: S), N = 7", "SELECT DISTINCT c_custkey AS c, c_nationkey::BIGINT AS n, o_orderkey AS o, l_suppkey AS s FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey = 7"),
    "self_join": Item("nation", "", "nation(n_nationkey: A, n_regionkey: R), nation(n_nationkey: B, n_regionkey: R), A < B", "SELECT DISTINCT x.n_nationkey::BIGINT AS a, x.n_regionkey::BIGINT AS r, y.n_nationkey::BIGINT AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey"),
    "theta_interval": Item("events", "", "events(event_id: A, user_id: U, ts: S), events(event_id: B, user_id: U, ts: T), A != B, T >= S, T < S + @6h", "SELECT DISTINCT x.event_id AS a, x.user_id AS u, x.ts AS s, y.event_id AS b, y.ts AS t FROM events x JOIN events y ON x.user_id = y.user_id AND x.event_id <> y.event_id AND y.ts >= x.ts AND y.ts < x.ts + INTERVAL 6 HOUR"),
    "cross_product": Item("region nation", "", "region(r_name: R), nation(n_name: N, n_nationkey: K), K < 5", "SELECT DISTINCT r_name AS r, n_name AS n, n_nationkey::BIGINT AS k FROM region, nation WHERE n_nationkey < 5"),
    "semi_join": Item("customer orders", "busy(C) :- customer(c_custkey: C), orders(o_custkey: C, o_totalprice: T), T > 200000.0.", "busy(C)", "SELECT DISTINCT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"),
    "anti_wildcard": Item("customer orders", "", 'customer(c_custkey: C), not orders(o_custkey: C, o_orderstatus: "P")', "SELECT DISTINCT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "anti_computed": Item("orders", "", "orders(o_orderkey: K), not orders(o_orderkey: K + 1)", "SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey + 1 NOT IN (SELECT o_orderkey FROM orders)"),
    "anti_absent": Item("nation", "code(K, V) :- nation(n_nationkey: K, n_name: N), V = N as int. code(K, K) :- nation(n_nationkey: K, n_regionkey: 1). blank(V) :- code(_, V), V is absent.", "code(K, V), not blank(V)", "SELECT n_nationkey::BIGINT AS k, n_nationkey::BIGINT AS v FROM nation WHERE n_regionkey = 1 UNION SELECT n_nationkey::BIGINT, TRY_CAST(n_name AS BIGINT) FROM nation WHERE TRY_CAST(n_name AS BIGINT) IS NOT NULL"),
    "division_all": Item("lineitem supplier", "sells(P, N) :- lineitem(l_partkey: P, l_suppkey: S), supplier(s_suppkey: S, s_nationkey: N). wanted(N) :- supplier(s_nationkey: N), N < 5. lacks(P) :- sells(P, _), wanted(N), not sells(P, N). all(P) :- sells(P, _), not lacks(P).", "all(P)", "WITH s AS (SELECT DISTINCT l_partkey AS p, s_nationkey AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) SELECT DISTINCT p FROM s WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_nationkey < 5) w WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.p = s.p AND t.n = w.n))"),
    # sets
    "union_disjunction": Item("orders", 'hot(K) :- orders(o_orderkey: K, o_orderstatus: "F") ; orders(o_orderkey: K, o_totalprice: T), T > 300000.0.', "hot(K)", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 300000"),
    "intersection": Item("customer supplier", "", "customer(c_nationkey: N), supplier(s_nationkey: N)", "SELECT c_nationkey::BIGINT AS n FROM customer INTERSECT SELECT s_nationkey::BIGINT FROM supplier"),
    "difference": Item("part supplier", "", "part(p_size: S), not supplier(s_nationkey: S)", "SELECT p_size::BIGINT AS s FROM part EXCEPT SELECT s_nationkey::BIGINT FROM supplier"),
    # scalars
    "int_arithmetic": Item("part", "", "part(p_partkey: K, p_size: S), A = K * 3 - S, B = (S - 25) / 4, C = K + S", "SELECT DISTINCT p_partkey AS k, p_size::BIGINT AS s, p_partkey * 3 - p_size AS a, ((p_size - 25) // 4)::BIGINT AS b, p_partkey + p_size AS c FROM part"),
    "float_arithmetic": Item("part", "", "part(p_partkey: K, p_retailprice: P), A = P * 0.5, B = P / 4.0, C = P - 1.0, D = P / 0.0", "SELECT DISTINCT p_partkey AS k, p_retailprice AS p, p_retailprice * 0.5 AS a, p_retailprice / 4.0 AS b, p_retailprice - 1.0 AS c, 'inf'::DOUBLE AS d FROM part"),
    "cast_number": Item("lineitem", "", "lineitem(l_orderkey: K, l_linenumber: L, l_quantity: Q), I = Q as int, F = I as float, H = F / 2.0", "SELECT DISTINCT l_orderkey AS k, l_linenumber::BIGINT AS l, l_quantity AS q, l_quantity::BIGINT AS i, l_quantity AS f, l_quantity / 2 AS h FROM lineitem"),
    "cast_text": Item("orders", "", 'orders(o_orderkey: K, o_orderdate: D, o_orderstatus: S), T = D as string, U = T as timestamp, I = K as string, J = I as int, B = "true" as bool, N = S as float', "SELECT DISTINCT o_orderkey AS k, o_orderdate AS d, o_orderstatus AS s, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS t, o_orderdate AS u, o_orderkey::VARCHAR AS i, o_orderkey AS j, true AS b, NULL::DOUBLE AS n FROM orders"),
    "cast_float_text": Item("part", "", "part(p_partkey: K, p_size: S), F = (S as float) / 8.0, T = F as string", "SELECT DISTINCT p_partkey AS k, p_size::BIGINT AS s, p_size / 8.0::DOUBLE AS f, (p_size / 8.0::DOUBLE)::VARCHAR AS t FROM part"),
    "point_difference": Item("orders lineitem", "", "orders(o_orderkey: K, o_orderdate: O), lineitem(l_orderkey: K, l_linenumber: L, l_shipdate: S), D = S - O, N = D / @1d", "SELECT DISTINCT o_orderkey AS k, o_orderdate AS o, l_linenumber::BIGINT AS l, l_shipdate AS s, (epoch_us(l_shipdate) - epoch_us(o_orderdate))::BIGINT AS d, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0::DOUBLE AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey"),
    "point_shift": Item("events", "", "events(event_id: E, ts: T), A = T + @1d12h, B = T - @90m, D = (T as string)", "SELECT DISTINCT event_id AS e, ts AS t, ts + INTERVAL 36 HOUR AS a, ts - INTERVAL 90 MINUTE AS b, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE rtrim(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '0') END AS d FROM events"),
    "duration_algebra": Item("events", "", "events(event_id: E), D = @1h * E, H = D / 2, R = D / @30m, S = D - @10m, T = D as string", "SELECT DISTINCT event_id AS e, event_id * 3600000000 AS d, event_id * 1800000000 AS h, event_id * 2.0::DOUBLE AS r, event_id * 3600000000 - 600000000 AS s, CASE WHEN event_id = 0 THEN '0s' ELSE (CASE WHEN event_id >= 24 THEN (event_id // 24)::VARCHAR || 'd' ELSE '' END) || (CASE WHEN event_id % 24 > 0 THEN (event_id % 24)::VARCHAR || 'h' ELSE '' END) END AS t FROM events"),
    "components": Item("orders", 'import "std/time".', "orders(o_orderkey: K, o_orderdate: D), year(D, Y), month(D, M), day(D, A), hour(D, H)", "SELECT DISTINCT o_orderkey AS k, o_orderdate AS d, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS a, hour(o_orderdate) AS h FROM orders"),
    "component_filter": Item("orders", 'import "std/time".', "orders(o_orderkey: K, o_orderdate: D), month(D, 6)", "SELECT DISTINCT o_orderkey AS k, o_orderdate AS d FROM orders WHERE month(o_orderdate) = 6"),
    "truncation": Item("events", 'import "std/time".', "events(event_id: E, ts: T), truncate(T, year, Y), truncate(T, quarter, Q), truncate(T, month, M), truncate(T, week, W), truncate(T, day, D), truncate(T, hour, H), truncate(T, minute, I)", "SELECT DISTINCT event_id AS e, ts AS t, date_trunc('year', ts)::TIMESTAMP AS y, date_trunc('quarter', ts)::TIMESTAMP AS q, date_trunc('month', ts)::TIMESTAMP AS m, date_trunc('week', ts)::TIMESTAMP AS w, date_trunc('day', ts)::TIMESTAMP AS d, date_trunc('hour', ts)::TIMESTAMP AS h, date_trunc('minute', ts)::TIMESTAMP AS i FROM events"),
    # aggregates
    "count_group_empty": Item("customer orders", "made(C, N) :- customer(c_custkey: C), N = count { O | orders(o_orderkey: O, o_custkey: C) }.", "made(C, N)", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "sum_group": Item("orders lineitem", "total(K, Q) :- orders(o_orderkey: K), Q = sum { V | lineitem(l_orderkey: K, l_quantity: V, l_linenumber: _) }.", "total(K, Q)", "SELECT o_orderkey AS k, sum(q) AS q FROM orders LEFT JOIN (SELECT DISTINCT * REPLACE (l_quantity AS l_quantity), l_quantity AS q FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1"),
    # DuckDB has no exact sum of floats, so this one has no SQL; a test holds it against math.fsum
    "sum_float": Item("lineitem", "", "lineitem(l_suppkey: S), D = sum { V | lineitem(l_suppkey: S, l_orderkey: _, l_linenumber: _, l_discount: V), V < 0.5 }, A = avg { V | lineitem(l_suppkey: S, l_orderkey: _, l_linenumber: _, l_discount: V) }", ""),
    "avg_min_max": Item("part", "", 'part(p_brand: B), A = avg { S | part(p_brand: B, p_size: S) }, L = min { P | part(p_brand: B, p_retailprice: P) }, H = max { N | part(p_brand: B, p_name: N) }', "SELECT p_brand AS b, avg(p_size) AS a, min(p_retailprice) AS l, max(p_name) AS h FROM part GROUP BY 1"),
    "global_aggregate": Item("lineitem", "", "N = count { K | lineitem(l_orderkey: K) }, Q = sum { V | lineitem(l_quantity: V) }, Z = count { W | lineitem(l_linenumber: W), W > 100 }", "SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS n, (SELECT sum(l_quantity) FROM (SELECT DISTINCT * FROM lineitem)) AS q, 0::BIGINT AS z"),
    "nested_aggregate": Item("orders", "", "M = max { N | orders(o_custkey: C), N = count { K | orders(o_orderkey: K, o_custkey: C) } }", "SELECT max(n) AS m FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)"),
    "having": Item("orders", "", "orders(o_custkey: C), count { K | orders(o_orderkey: K, o_custkey: C) } >= 15", "SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING count(*) >= 15"),
    "count_distinct_helper": Item("lineitem", "pair(S, P) :- lineitem(l_suppkey: S, l_partkey: P).", "lineitem(l_suppkey: S), N = count { P | pair(S, P) }", "SELECT l_suppkey AS s, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1"),
    "sum_skips_absent": Item("orders", "score(K, S, V) :- orders(o_orderkey: K, o_orderstatus: S, o_orderpriority: P), V = P as int. score(K, S, K) :- orders(o_orderkey: K, o_orderstatus: S), K < 100.", "score(_, S, _), N = count { V | score(_, S, V) }, T = sum { V | score(_, S, V) }", "SELECT o_orderstatus AS s, count(*) + count(*) FILTER (o_orderkey < 100) AS n, (sum(o_orderkey) FILTER (o_orderkey < 100))::BIGINT AS t FROM orders GROUP BY 1"),
    "duration_aggregate": Item("orders lineitem", "lag(K, L, D) :- orders(o_orderkey: K, o_orderdate: O), lineitem(l_orderkey: K, l_linenumber: L, l_shipdate: S), D = S - O.", "S = sum { D | lag(_, _, D) }, A = avg { D | lag(_, _, D) }, M = max { D | lag(_, _, D) }", "SELECT sum(d)::BIGINT AS s, (sum(d) // count(*))::BIGINT AS a, max(d) AS m FROM (SELECT DISTINCT o_orderkey, l_linenumber, epoch_us(l_shipdate) - epoch_us(o_orderdate) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"),
    "aggregate_in_expression": Item("part", "", "part(p_brand: B), R = (count { K | part(p_partkey: K, p_brand: B, p_size: S), S > 25 } as float) / (count { K | part(p_partkey: K, p_brand: B) } as float)", "SELECT p_brand AS b, count(*) FILTER (p_size > 25) / count(*)::DOUBLE AS r FROM part GROUP BY 1"),
    # idioms in place of windows
    "argmax_not_beaten": Item("orders", 'import "std/time". monthly(M, N) :- orders(o_orderdate: D), truncate(D, month, M), N = count { K | orders(o_orderkey: K, o_orderdate: E), truncate(E, month, M) }. beaten(M) :- monthly(M, N), monthly(_, X), X > N.', "monthly(M, N), not beaten(M)", "WITH m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, count(*) AS n FROM orders GROUP BY 1) SELECT m, n FROM m WHERE n = (SELECT max(n) FROM m)"),
    "max_then_join": Item("customer", "", "customer(c_nationkey: N, c_custkey: K, c_acctbal: B), B = max { X | customer(c_nationkey: N, c_acctbal: X) }", "SELECT c_nationkey::BIGINT AS n, c_custkey AS k, c_acctbal AS b FROM customer QUALIFY c_acctbal = max(c_acctbal) OVER (PARTITION BY c_nationkey)"),
    # recursion
    "tc_right": Item("part", TREE + "up(A, B) :- edge(A, B). up(A, C) :- edge(A, B), up(B, C).", "up(A, B)", TREE_SQL + ", up AS (SELECT c AS a, p AS b FROM edge UNION SELECT up.a, e.p FROM up JOIN edge e ON e.c = up.b) SELECT a, b FROM up"),
    "tc_left": Item("part", TREE + "up(A, B) :- edge(A, B). up(A, C) :- up(A, B), edge(B, C).", "up(A, 1)", TREE_SQL + ", up AS (SELECT c AS a, p AS b FROM edge UNION SELECT up.a, e.p FROM up JOIN edge e ON e.c = up.b) SELECT a FROM up WHERE b = 1"),
    "tc_nonlinear": Item("customer", RING + "r(A, B) :- edge(A, B). r(A, C) :- r(A, B), r(B, C).", "r(A, B)", RING_SQL + ", r AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM r JOIN edge e ON e.a = r.b) SELECT a, b FROM r"),
    "cycle_members": Item("customer", RING + "r(A, B) :- edge(A, B). r(A, C) :- edge(A, B), r(B, C).", "r(A, A)", RING_SQL + ", r AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM r JOIN edge e ON e.a = r.b) SELECT a FROM r WHERE a = b"),
    "same_generation": Item("part", TREES + "sg(F, A, B) :- edge(F, A, P), edge(F, B, P). sg(F, A, B) :- edge(F, A, P), sg(F, P, Q), edge(F, B, Q).", "sg(F, A, B)", TREES_SQL + ", sg AS (SELECT x.f, x.c AS a, y.c AS b FROM edge x JOIN edge y ON x.f = y.f AND x.p = y.p UNION SELECT x.f, x.c, y.c FROM sg JOIN edge x ON x.f = sg.f AND x.p = sg.a JOIN edge y ON y.f = sg.f AND y.p = sg.b) SELECT f, a, b FROM sg"),
    "mutual_recursion": Item("part", TREE + "even(1) :- part(p_partkey: 1). odd(C) :- even(P), edge(C, P). even(C) :- odd(P), edge(C, P).", "even(A)", TREE_SQL + ", d AS (SELECT 1::BIGINT AS n, 0 AS k WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = 1) UNION ALL SELECT e.c, d.k + 1 FROM d JOIN edge e ON e.p = d.n) SELECT n AS a FROM d WHERE k % 2 = 0"),
    "seeded_reach": Item("part", TREE + "from(B) :- edge(77, B). from(C) :- from(B), edge(B, C).", "from(A)", TREE_SQL + ", f AS (SELECT p AS a FROM edge WHERE c = 77 UNION SELECT e.p FROM f JOIN edge e ON e.c = f.a) SELECT a FROM f"),
    "recursion_over_negation": Item("customer nation", RING + "closed(N) :- nation(n_nationkey: N, n_regionkey: 2). r(B) :- edge(0, B), not closed(B). r(B) :- r(A), edge(A, B), not closed(B).", "r(A)", RING_SQL + ", closed AS (SELECT n_nationkey AS n FROM nation WHERE n_regionkey = 2), r AS (SELECT b AS a FROM edge WHERE a = 0 AND b NOT IN (SELECT n FROM closed) UNION SELECT e.b FROM r JOIN edge e ON e.a = r.a WHERE e.b NOT IN (SELECT n FROM closed)) SELECT a FROM r"),
    "value_creating_path": Item("conversations", TURNS + "path(C, A, B, 1) :- edge(C, A, B). path(C, A, D, N) :- path(C, A, B, M), edge(C, B, D), N = M + 1.", "path(C, A, B, N)", TURNS_SQL + ", path AS (SELECT c, a, b, 1::BIGINT AS n FROM edge UNION SELECT path.c, path.a, e.b, path.n + 1 FROM path JOIN edge e ON e.c = path.c AND e.a = path.b) SELECT c, a, b, n FROM path"),
    "components_min": Item("customer nation", RING + "both(A, B) :- edge(A, B), A != B. both(B, A) :- edge(A, B), A != B. r(A, A) :- nation(n_nationkey: A). r(A, C) :- r(A, B), both(B, C).", "nation(n_nationkey: A), L = min { B | r(A, B) }", RING_SQL + ", both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), r AS (SELECT n_nationkey::BIGINT AS a, n_nationkey::BIGINT AS b FROM nation UNION SELECT r.a, e.b FROM r JOIN both_ways e ON e.a = r.b) SELECT a, min(b) AS l FROM r GROUP BY 1"),
    # analyses of programs
    "dominators": Item("part", FLOWS + "live(F, 1) :- node(F, 1). live(F, N) :- flow(F, M, N), live(F, M). free(F, 1, D) :- live(F, 1), live(F, D), D > 1. free(F, N, D) :- live(F, D), flow(F, M, N), free(F, M, D), D != N.", "live(F, N), live(F, D), not free(F, N, D)", FLOWS_SQL + ", avoid AS (SELECT x.f, x.n AS a, y.n AS b FROM node x JOIN node y ON y.f = x.f AND y.n = 1 AND x.n <> 1 UNION SELECT avoid.f, avoid.a, w.b FROM avoid JOIN flow w ON w.f = avoid.f AND w.a = avoid.b AND w.b <> avoid.a), live AS (SELECT f, n FROM node WHERE n = 1 UNION SELECT w.f, w.b FROM live JOIN flow w ON w.f = live.f AND w.a = live.n) SELECT node.f, live.n, node.n AS d FROM node JOIN live ON live.f = node.f WHERE NOT EXISTS (SELECT 1 FROM avoid WHERE avoid.f = node.f AND avoid.a = node.n AND avoid.b = live.n)"),
    "reaching_definitions": Item("part", FLOW + "at(D, V, N) :- defines(D, V), flow(D, N). at(D, V, N) :- at(D, V, M), not defines(M, V), flow(M, N).", "at(D, V, N), uses(N, V)", FLOW_SQL + ", out_ AS (SELECT n, n AS d, v FROM defines UNION SELECT f.b, o.d, o.v FROM out_ o JOIN flow f ON f.a = o.n WHERE NOT EXISTS (SELECT 1 FROM defines k WHERE k.n = f.b AND k.v = o.v)) SELECT DISTINCT f.b AS n, o.d, o.v FROM out_ o JOIN flow f ON f.a = o.n JOIN uses u ON u.n = f.b AND u.v = o.v"),
    "liveness": Item("part", FLOW + "needed(N, V) :- uses(N, V). needed(A, V) :- flow(A, B), not defines(A, V), needed(B, V).", "needed(N, V)", FLOW_SQL + ", l AS (SELECT n, v FROM uses UNION SELECT f.a, l.v FROM l JOIN flow f ON f.b = l.n WHERE NOT EXISTS (SELECT 1 FROM defines k WHERE k.n = f.a AND k.v = l.v)) SELECT n, v FROM l"),
    "points_to": Item("part", "var(F, V) :- part(p_partkey: P), F = P / 60, V = P - P / 60 * 60. copy(F, A, B) :- var(F, A), B = A / 3, B >= 1. copy(F, A, B) :- var(F, A), var(F, B), B = A + 7. pts(F, V, V) :- var(F, V). pts(F, A, O) :- copy(F, A, B), pts(F, B, O).", "pts(F, V, O)", "WITH RECURSIVE var AS (SELECT p_partkey // 60 AS f, p_partkey % 60 AS v FROM part), copy AS (SELECT f, v AS a, v // 3 AS b FROM var WHERE v // 3 >= 1 UNION SELECT x.f, x.v, y.v FROM var x JOIN var y ON y.f = x.f AND y.v = x.v + 7), pts AS (SELECT f, v, v AS o FROM var UNION SELECT c.f, c.a, pts.o FROM pts JOIN copy c ON c.f = pts.f AND c.b = pts.v) SELECT f, v, o FROM pts"),
    "taint": Item("part", TREE + "clean(V) :- part(p_partkey: V, p_size: S), S > 40. tainted(V) :- part(p_partkey: V), not edge(_, V), not clean(V). tainted(P) :- tainted(V), edge(V, P), not clean(P).", "tainted(V)", TREE_SQL + ", clean AS (SELECT p_partkey AS v FROM part WHERE p_size > 40), t AS (SELECT p_partkey AS v FROM part WHERE p_partkey NOT IN (SELECT p FROM edge) AND p_size <= 40 UNION SELECT e.p FROM t JOIN edge e ON e.c = t.v WHERE e.p NOT IN (SELECT v FROM clean)) SELECT v FROM t"),
    # metrics
    "cochange_pairs": Item("lineitem", "touch(O, P) :- lineitem(l_orderkey: O, l_partkey: P). together(A, B) :- touch(O, A), touch(O, B), A < B.", "together(A, B), N = count { O | touch(O, A), touch(O, B) }, N >= 2", "WITH t AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT x.p AS a, y.p AS b, count(*) AS n FROM t x JOIN t y ON x.o = y.o AND x.p < y.p GROUP BY 1, 2 HAVING count(*) >= 2"),
    "confidence": Item("lineitem", "touch(O, P) :- lineitem(l_orderkey: O, l_suppkey: P). revisions(P, N) :- touch(_, P), N = count { O | touch(O, P) }. pair(A, B, N) :- touch(O, A), touch(O, B), A != B, N = count { X | touch(X, A), touch(X, B) }.", "pair(A, B, N), revisions(A, M), C = (N as float) / (M as float), C > 0.05", "WITH t AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS p FROM lineitem), r AS (SELECT p, count(*) AS m FROM t GROUP BY 1), x AS (SELECT a.p AS a, b.p AS b, count(*) AS n FROM t a JOIN t b ON a.o = b.o AND a.p <> b.p GROUP BY 1, 2) SELECT a, b, n, m, n / m::DOUBLE AS c FROM x JOIN r ON r.p = x.a WHERE n / m::DOUBLE > 0.05"),
    "instability": Item("customer nation", RING + "dep(A, B) :- edge(A, B), A != B. out(A, N) :- nation(n_nationkey: A), N = count { B | dep(A, B) }. into(A, N) :- nation(n_nationkey: A), N = count { B | dep(B, A) }.", "out(A, E), into(A, F), E + F > 0, I = (E as float) / ((E + F) as float)", RING_SQL + ", dep AS (SELECT a, b FROM edge WHERE a <> b) SELECT a, e, f, e / (e + f)::DOUBLE AS i FROM (SELECT n_nationkey::BIGINT AS a, (SELECT count(*) FROM dep WHERE dep.a = n_nationkey) AS e, (SELECT count(*) FROM dep WHERE dep.b = n_nationkey) AS f FROM nation) WHERE e + f > 0"),
    # domains
    "access_closure": Item("part nation", TREE + "role(C, P) :- edge(C, P). role(A, C) :- edge(A, B), role(B, C). grant(R, D) :- part(p_partkey: R, p_size: D). revoked(U, D) :- part(p_partkey: U, p_size: D). may(U, D) :- role(U, R), grant(R, D).", "may(U, D), not revoked(U, D)", TREE_SQL + ", role AS (SELECT c AS a, p AS b FROM edge UNION SELECT role.a, e.p FROM role JOIN edge e ON e.c = role.b) SELECT DISTINCT role.a AS u, g.p_size::BIGINT AS d FROM role JOIN part g ON g.p_partkey = role.b JOIN part u ON u.p_partkey = role.a WHERE u.p_size <> g.p_size"),
    "one_criterion_fails": Item("customer", 'fails(C, balance) :- customer(c_custkey: C, c_acctbal: B), B < 0.0. fails(C, segment) :- customer(c_custkey: C, c_mktsegment: "BUILDING"). fails(C, nation) :- customer(c_custkey: C, c_nationkey: N), N < 10. failing(C, N) :- customer(c_custkey: C), N = count { W | fails(C, W) }.', "failing(C, 1), fails(C, W)", "WITH f AS (SELECT c_custkey AS c, 'balance' AS w FROM customer WHERE c_acctbal < 0 UNION SELECT c_custkey, 'segment' FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT c_custkey, 'nation' FROM customer WHERE c_nationkey < 10) SELECT c, w FROM f QUALIFY count(*) OVER (PARTITION BY c) = 1"),
    "most_specific": Item("part", TREE + "isa(C, P) :- edge(C, P). isa(A, C) :- edge(A, B), isa(B, C). says(C, V) :- part(p_partkey: C, p_size: V), V < 10. has(C, K, V) :- isa(C, K), says(K, V). has(C, C, V) :- says(C, V). nearer(C, K) :- has(C, K, _), has(C, J, _), isa(J, K).", "has(C, K, V), not nearer(C, K)", TREE_SQL + ", up AS (SELECT c, p, 1 AS d FROM edge UNION ALL SELECT up.c, e.p, up.d + 1 FROM up JOIN edge e ON e.c = up.p), h AS (SELECT up.c, up.p AS k, p_size::BIGINT AS v, d FROM up JOIN part ON p_partkey = up.p AND p_size < 10 UNION ALL SELECT p_partkey, p_partkey, p_size, 0 FROM part WHERE p_size < 10) SELECT c, k, v FROM h QUALIFY d = min(d) OVER (PARTITION BY c)"),
    "rest_gap": Item("events", "", "events(event_id: A, user_id: U, ts: S), events(event_id: B, user_id: U, ts: T), T > S, T - S < @10h, E = T - S", "SELECT DISTINCT x.event_id AS a, x.user_id AS u, x.ts AS s, y.event_id AS b, y.ts AS t, (epoch_us(y.ts) - epoch_us(x.ts))::BIGINT AS e FROM events x JOIN events y ON x.user_id = y.user_id AND y.ts > x.ts AND epoch_us(y.ts) - epoch_us(x.ts) < 36000000000"),
}

QUERIES = {name: item.run for name, item in ITEMS.items()}
ORACLE_SQL = {name: item.sql for name, item in ITEMS.items() if item.sql}
