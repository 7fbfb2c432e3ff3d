"""Whole programs: text in, canonical facts out."""

import pytest

from stratalog.engine import Engine, question, run_text
from stratalog.plans.errors import DataError, ProgramError


def lines(spark, text):
    return run_text(spark, text).lines


FAMILY = 'child_of("ben", "ada"). child_of("cy", "ben"). child_of("di", "ben"). child_of("ed", "di"). '


def test_closure_and_shapes(spark):
    text = FAMILY + """
    below(X, Y) :- child_of(X, Y). below(X, Z) :- child_of(X, Y), below(Y, Z).
    ?- below(X, "ada").
    ?- child_of("cy", "ben"), child_of("ben", "ada").
    ?- not child_of("ada", "cy").
    ?- child_of(X, Y), N = count { Z | child_of(Z, Y) }, N > 1.
    ?- pairs: child_of(X, "ben").
    ?- yes: child_of("ed", _).
    ?- 1 < 2.
    ?- child_of("nobody", X).
    """
    assert lines(spark, text) == [
        'below("ben", "ada").', 'below("cy", "ada").', 'below("di", "ada").', 'below("ed", "ada").',
        'child_of("ben", "ada").', 'child_of("cy", "ben").', "holds(true).",
        'answer("cy", "ben", 2).', 'answer("di", "ben", 2).', 'pairs("cy").', 'pairs("di").', "yes(true).", "holds(true).",
    ]


def test_exit_codes(spark):
    assert run_text(spark, "p(1).").code == 0
    assert run_text(spark, "p(1). ?- p(2).").code == 1
    assert run_text(spark, "p(1). ?- p(2). ?- p(1).").code == 0


def test_absent(spark):
    base = "p(1, absent). p(2, 7). p(absent, 7). q(absent). q(7). "
    assert lines(spark, base + "?- p(X, Y).") == ["p(absent, 7).", "p(1, absent).", "p(2, 7)."]
    assert lines(spark, base + "r(X) :- p(X, Y), q(Y). ?- r(X).") == ["r(absent).", "r(2)."]  # absent never joins
    assert lines(spark, base + "r(X) :- p(X, Y), not q(Y). ?- r(X).") == []  # but a stored absent refutes
    assert lines(spark, base + "r(X) :- q(X), q(X). ?- r(X).") == ["r(7)."]
    assert lines(spark, base + "r(X) :- p(X, Y), Y != 7. ?- r(X).") == []
    assert lines(spark, base + "r(X, Z) :- p(X, Y), Z = Y + 1. ?- r(X, Z).") == ["r(absent, 8).", "r(1, absent).", "r(2, 8)."]
    assert lines(spark, base + "r(X) :- p(X, Y), Y is absent. s(X) :- p(X, Y), Y is not absent. ?- r(X). ?- s(X).") == ["r(1).", "s(absent).", "s(2)."]
    assert lines(spark, "k(absent). k(1). v(absent, 5). v(1, 6). r(K, N) :- k(K), N = count { X | v(K, X) }. ?- r(K, N).") == ["r(absent, 0).", "r(1, 1)."]
    assert lines(spark, "k(absent). k(1). v(5). v(6). r(K, N) :- k(K), N = count { X | v(X), K is absent }. ?- r(K, N).") == ["r(absent, 2).", "r(1, 0)."]


def test_aggregates(spark):
    text = """sale(a, 1, 10). sale(a, 2, absent). sale(a, 3, 5). sale(b, 1, absent). shop(a). shop(b). shop(c).
    n(S, N) :- shop(S), N = count { V | sale(S, _, V) }.
    t(S, T) :- shop(S), T = sum { V | sale(S, _, V) }.
    a(S, T) :- shop(S), T = avg { V | sale(S, _, V) }.
    m(S, L, H) :- shop(S), L = min { V | sale(S, _, V) }, H = max { V | sale(S, _, V) }.
    all(N, T) :- N = count { S | sale(S, _, _) }, T = sum { V | sale(_, _, V) }.
    most(M) :- M = max { T | shop(S), T = sum { V | sale(S, _, V) } }.
    many(S) :- shop(S), count { V | sale(S, _, V) } > 1.
    ?- n(S, N). ?- t(S, T). ?- a(S, T). ?- m(S, L, H). ?- all(N, T). ?- most(M). ?- many(S)."""
    assert lines(spark, text) == [
        "n(a, 3).", "n(b, 1).", "n(c, 0).", "t(a, 15).", "t(b, absent).", "t(c, absent).", "a(a, 7.5).", "a(b, absent).", "a(c, absent).",
        "m(a, 5, 10).", "m(b, absent, absent).", "m(c, absent, absent).", "all(4, 15).", "most(15).", "many(a).",
    ]
    assert lines(spark, "f(1, 1.0e16). f(2, -1.0e16). f(3, 0.1). s(T) :- T = sum { X | f(_, X) }. ?- s(T).") == ["s(0.1)."]
    assert lines(spark, "d(@1h). d(@30m). d(@1us). s(T, A) :- T = sum { X | d(X) }, A = avg { X | d(X) }. ?- s(T, A).") == ["s(@1h30m1us, @30m)."]


def test_numbers(spark):
    text = """n(7, -2). 
    r(A, B, C, D) :- n(X, Y), A = X / Y, B = X * Y, C = X - Y, D = Y / X.
    f(A, B) :- n(X, _), A = (X as float) / 2.0, B = 1.0 / 0.0.
    c(A, B, C, D) :- A = 2.0 as int, B = "12" as int, C = "x" as float, D = 1.5 as string.
    e(S) :- S = 1.0e20 as string. e(S) :- S = 12345678.5 as string. e(S) :- S = 0.0001 as string. e(S) :- S = 1.0e-7 as string.
    ?- r(A, B, C, D). ?- f(A, B). ?- c(A, B, C, D). ?- e(S)."""
    assert lines(spark, text) == ["r(-3, -14, 9, 0).", "f(3.5, inf).", 'c(2, 12, absent, "1.5").', 'e("0.0001").', 'e("12345678.5").', 'e("1e-7").', 'e("1e20").']


@pytest.mark.parametrize("body, code", [
    ("X = 9223372036854775807, Y = X + 1", "arithmetic-error"), ("X = 0, Y = 1 / X", "arithmetic-error"), ("X = 0.0, Y = X / X", "arithmetic-error"),
    ("X = 2.5, Y = X as int", "lossy-conversion"), ("X = 9007199254740993, Y = X as float", "lossy-conversion"), ("X = @2026-01-01, Y = X + @1h", "arithmetic-error"),
    ("X = @2026-01-01T10:00:00, Y = X as date", "lossy-conversion"),
])
def test_data_errors(spark, body, code):
    head, rest = body.split(", ", 1)
    with pytest.raises((DataError, ProgramError)) as e:
        lines(spark, f"v({head.split(' = ')[1]}). r(Y) :- v(X), {rest}. ?- r(Y).")
    assert code in e.value.codes


def test_temporal(spark):
    text = """import "std/time".
    e(1, @2026-03-31, @2026-03-31T23:59:59.25). e(2, @2024-02-29, @2024-12-30T00:00:00).
    a(I, D) :- e(I, X, Y), D = Y - (X as timestamp).
    b(I, X) :- e(I, D, _), X = D + @1d. 
    c(I, Y, M, W) :- e(I, D, T), year(D, Y), month(T, M), truncate(T, week, W).
    q(I, Q) :- e(I, D, _), truncate(D, quarter, Q).
    h(H, R, N) :- H = @1h * 3, R = @3h / @45m, N = @1d12h as string.
    ?- a(I, D). ?- b(I, X). ?- c(I, Y, M, W). ?- q(I, Q). ?- h(H, R, N)."""
    assert lines(spark, text) == [
        "a(1, @23h59m59s250ms).", "a(2, @305d).", "b(1, @2026-04-01).", "b(2, @2024-03-01).", "c(1, 2026, 3, @2026-03-30T00:00:00).", "c(2, 2024, 12, @2024-12-30T00:00:00).",
        "q(1, @2026-01-01).", "q(2, @2024-01-01).", 'h(@3h, 4.0, "1d12h").',
    ]


def test_recursions(spark):
    edges = "".join(f"edge({i}, {i + 1}). " for i in range(12)) + "edge(12, 5). "
    left = edges + "r(X, Y) :- edge(X, Y). r(X, Z) :- r(X, Y), edge(Y, Z). ?- r(3, Y)."
    right = edges + "r(X, Y) :- edge(X, Y). r(X, Z) :- edge(X, Y), r(Y, Z). ?- r(3, Y)."
    both = edges + "r(X, Y) :- edge(X, Y). r(X, Z) :- r(X, Y), r(Y, Z). ?- r(3, Y)."
    assert lines(spark, left) == lines(spark, right) == lines(spark, both) == [f"r(3, {i})." for i in range(4, 13)]
    mutual = "n(0). even(0) :- n(0). odd(Y) :- even(X), X < 9, Y = X + 1. even(Y) :- odd(X), Y = X + 1. ?- even(X)."
    found = run_text(spark, mutual)
    assert found.lines == [f"even({i})." for i in range(0, 11, 2)] and "value-creating-recursion" in [w.code for w in found.warnings]
    with pytest.raises(RuntimeError):
        Engine(spark, max_rounds=4).load("n(0). n(Y) :- n(X), Y = X + 1.").query("n(X)")


@pytest.mark.parametrize("text, codes", [
    ("p(X) :- q(Y). q(1).", {"unsafe-rule"}), ("p(X) :- q(X), not r(Y). q(1). r(1).", {"unsafe-premise"}), ("p(X) :- q(X), not p(X). q(1).", {"unstratified"}),
    ("p(1). p(1, 2).", {"arity-mismatch"}), ('p(1). p("a").', {"type-clash"}), ("p(1). r(X) :- p(X), X > 1.0.", {"type-clash"}), ("p(X, Y) :- q(X), Y = X + 1.0. q(1).", {"type-mismatch", "type-clash"}),
    ("p(X) :- q(X), X = absent. q(1).", {"absent-misuse"}), ("p(X) :- q(X, absent). q(1, 2).", {"absent-misuse"}), ("p(1) :- 1 < 2 < 3.", {"chained-comparison"}), ("p(f(1)).", {"compound-term"}),
    ("p(X) :- q(X), N = median { Y | q(Y) }. q(1).", {"unknown-aggregate"}), ("Q(1).", {"uppercase-relation"}), ("p(1,).", {"trailing-comma"}), ('p("a).', {"unterminated-string"}), ("p(99999999999999999999).", {"malformed-literal"}),
    ("p(X).", {"not-ground"}), ("p(a: 1).", {"no-schema"}), ("declare p(a: int). p(b: 1).", {"field-mismatch"}), ("declare p(a: int). p(true).", {"type-clash"}), ("p(true). r(Y) :- p(X), Y = X as int.", {"unsupported-conversion"}),
    ("p(X) :- q(X), X = Y, Y = X + 0, Z = W, W = Z. q(1).", {"circular-premise", "unsafe-premise"}), ("p(1 / 0).", {"arithmetic-error"}), ("?- p(X) ; q(X). p(1). q(1).", {"unsupported-construct"}), ("p(1) & q(2).", {"unsupported-token"}),
    ('import "std/time". year(1, 2).', {"name-collision"}), ('import "std/time". p(X) :- q(D), truncate(D, era, X). q(@2026-01-01).', {"builtin-misuse"}), ('import "std/time". p(X) :- q(D), hour(D, X). q(@2026-01-01).', {"type-mismatch"}),
    ("s(T) :- T = sum { X | q(X) }. q(true).", {"type-mismatch"}), ('import "nowhere.csv" as p.', {"file-not-found"}), ('import "x.xls" as p.', {"unsupported-format"}), ('import "gone.dl".', {"module-not-found"}),
])
def test_rejected(spark, text, codes):
    with pytest.raises(ProgramError) as e:
        lines(spark, text)
    assert codes & set(e.value.codes), e.value.codes


def test_all_errors_of_a_stage(spark):
    with pytest.raises(ProgramError) as e:
        lines(spark, "P(1).\nq(1,).\nr(X) :- 1 < 2 < 3.")
    assert e.value.codes == ["uppercase-relation", "trailing-comma", "chained-comparison"] and [d.line for d in e.value.diagnostics] == [1, 2, 3]


def test_named_arguments_and_disjunction(spark):
    text = """declare person(name: string, age: int, town: string).
    person(name: "a", town: "x", age: 30). person("b", 10, "y"). person("c", 50, absent).
    adult(N) :- person(name: N, age: A), A >= 18.
    odd_one(N) :- person(name: N, town: T), T is absent ; person(name: N, age: 10).
    ?- adult(N). ?- odd_one(N)."""
    assert lines(spark, text) == ['adult("a").', 'adult("c").', 'odd_one("b").', 'odd_one("c").']


def test_warnings(spark):
    found = run_text(spark, "employee(1). p(X) :- employe(X). q(X) :- employee(X), month(X, 1). ?- p(X).")
    assert {"undefined-predicate", "gated-predicate"} <= {w.code for w in found.warnings} and "did you mean employee" in str(found.warnings)


def test_output_reads_back(spark):
    first = lines(spark, 'v(a, "q\\"x\\n", -3, 1.5, true, @2026-01-02, @2026-01-02T03:04:05.5, @-1h, absent). ?- v(A, B, C, D, E, F, G, H, I).')
    assert lines(spark, " ".join(first) + " ?- v(A, B, C, D, E, F, G, H, I).") == first


def test_engine_api(spark):
    e = Engine(spark).register("edge", spark.createDataFrame([(1, 2), (2, 3), (2, None)], "src int, dst int")).load("r(X, Y) :- edge(X, Y). r(X, Z) :- edge(X, Y), r(Y, Z).")
    assert sorted(map(tuple, e.query("r(1, X), X is not absent").collect())) == [(2,), (3,)]
    assert e.table("edge").columns == ["src", "dst"]
    assert [type(s).__name__ for s in question("p(X) :- q(X)")] == ["Clause", "Query"]
    assert [type(s).__name__ for s in question("?why p(1)")] == ["Goal"]
    assert [type(s).__name__ for s in question("p(X), X > 1")] == ["Query"]


def test_cli(spark, tmp_path, capsys):
    from stratalog.cli import main

    (tmp_path / "lib.dl").write_text("up(X, Y) :- child_of(X, Y). up(X, Z) :- child_of(X, Y), up(Y, Z).")
    (tmp_path / "main.dl").write_text('import "lib.dl". import "lib.dl". ' + FAMILY)
    assert main([str(tmp_path / "main.dl"), "-q", 'up("cy", X)'], spark) == 0
    assert capsys.readouterr().out == 'up("cy", "ada").\nup("cy", "ben").\n'
    assert main([str(tmp_path / "main.dl"), "-q", 'up("ada", X)'], spark) == 1
    assert main(["-q", "p("], spark) == 2 and main([], spark) == 2
    (tmp_path / "bad.dl").write_text('import "lib2.dl".')
    (tmp_path / "lib2.dl").write_text("?- p(1).")
    assert main([str(tmp_path / "bad.dl")], spark) == 2


def test_reports(spark):
    base = 'shop(a). shop(b). sale(a, 1, absent). sale(a, 2, 5). sale(b, 1, absent). raw("1"). raw("x"). raw(absent). '
    found = run_text(spark, base + "t(S, T) :- shop(S), T = sum { V | sale(S, _, V) }. ?- t(S, T).")
    assert [str(w).split(" (")[0] for w in found.warnings] == ["warning [absent-skipped]: sum skipped 2 absent values in 2 groups of t"]
    assert not run_text(spark, base + "t(S, T) :- shop(S), T = count { V | sale(S, _, V) }. ?- t(S, T).").warnings
    found = run_text(spark, base + "n(Y) :- raw(X), Y = X as int. ?- n(Y).")
    assert [w.code for w in found.warnings] == ["conversion-failed-on-data"] and "made 1 value absent" in str(found.warnings[0])
    assert not run_text(spark, base + "n(Y) :- raw(X), Y = X as int, Y is not absent. ?- n(Y).").warnings
