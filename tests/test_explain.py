from stratalog.engine import Engine, run_text

GRAPH = "link(1, 2). link(2, 3). link(3, 1). link(3, 4). to(X, Y) :- link(X, Y). to(X, Z) :- to(X, Y), link(Y, Z). "


def test_why(spark):
    assert Engine(spark).load(GRAPH).why("to(1, 4)") == [
        "% why to(1, 4)",
        "% 0  to(1, 4)  by to(X, Z) :- to(X, Y), link(Y, Z)",
        "% 1    to(1, 3)  by to(X, Z) :- to(X, Y), link(Y, Z)",
        "% 2      to(1, 2)  by to(X, Y) :- link(X, Y)",
        "% 3        link(1, 2)  [fact]",
        "% 2      link(2, 3)  [fact]",
        "% 1    link(3, 4)  [fact]",
    ]


def test_why_of_tests_and_folds(spark):
    found = Engine(spark).load('declare s(shop: symbol, v: int). s(a, 5). s(a, absent). big(S, T) :- s(shop: S), T = sum { V | s(S, V) }, T >= 5, not s(S, 9).').why("big(a, 5)")
    assert found[1].startswith("% 0  big(a, 5)  by big(S, T) :- s(S, _)") and '% 1    s(shop: a, v: absent)  [fact]' in found
    assert any("(5 over 1 values, 1 absent skipped)" in x for x in found) and any("T >= 5  (5 >= 5)" in x for x in found) and any("no s(shop: a, v: 9)" in x for x in found)


def test_whynot(spark):
    text = 'made("k", "m1"). sold("m1", "v"). buys(A, B) :- made(A, I), sold(I, N), made(B, N). buys(A, A) :- made(A, _), not banned(A). banned("k"). far(X) :- buys(X, "z"). '
    e = Engine(spark).load(text)
    assert e.why_not('buys("k", "b")') == [
        '% whynot buys("k", "b")', "% not derivable", "% 0  buys(A, B) :- made(A, I), sold(I, N), made(B, N)", '% 1    made("k", "m1")', '% 1    sold("m1", "v")', "% 1    blocked at made(B, N)", '% 1    repair: add made("b", "v")',
    ]
    assert any('refuted by banned("k")' in x for x in e.why_not('buys("k", "k")'))
    assert any('ask ?whynot buys("q", "z")' in x for x in e.why_not('far("q")'))
    assert e.why('buys("k", "b")')[1] == "% not derivable"


def test_explanations_change_nothing(spark):
    plain = run_text(spark, GRAPH + "?- to(2, X).")
    asked = run_text(spark, GRAPH + "?- to(2, X). ?why to(2, 1). ?whynot to(4, 1).")
    assert [x for x in asked.lines if not x.startswith("%")] == plain.lines and asked.code == plain.code
