import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import ann, chat, components, topk, url_rules

VECTORS = "vec_id long, embedding array<float>, label int, score string, rank string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "s", "r") for i, v in rows], VECTORS)


def odd_vectors(seed, n=700, dim=12):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, dim).astype("f4")]) for i in range(n)]
    rows += [(n + 20 * k, list(rows[3][1])) for k in range(1, 40)]  # many copies
    rows += [(3, rows[4][1]), (5000, None), (5020, [1.0, None] + [0.0] * (dim - 2)), (5040, [float("nan")] * dim), (5060, [float("inf")] * dim), (5080, [0.0] * dim), (5100, [1.0, 2.0]), (None, rows[0][1])]
    return rows


def usable(rows, zero):
    dim = max(len(v) for _, v in rows if v)
    out = [(i, np.array([*v, *[0.0] * (dim - len(v))], "f4").astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    return out if zero else [(i, v) for i, v in out if v.any()]


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k(spark, seed):
    rows = odd_vectors(seed)
    got = {}
    for r in topk.top_k(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    fine = [(i, np.floor(64 * v)) for i, v in usable(rows, True)]
    queries = {i: v for i, v in fine if i % 20 == 0}
    assert set(got) == set(queries)
    for q, v in queries.items():
        best = sorted((-int(v @ x), i) for i, x in fine if i != q)[:20]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(vectors(spark, [])).count() == 0
    assert topk.top_k(vectors(spark, [(0, [1.0])])).count() == 0


def test_top_k_beyond_exact_doubles(spark):
    rows = [(20, [1e7, 3.0]), (1, [2e7, 1.0]), (2, [2e7, -1.0]), (3, [-5e6, 0.5])]
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(vectors(spark, rows)).orderBy("rank").collect()]
    whole = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in rows}
    best = sorted((-sum(a * b for a, b in zip(whole[20], whole[i])), i) for i in (1, 2, 3))
    assert got == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_rounds_prune_and_stay_exact():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-30, 30, (2000, 16)).astype(float), rng.integers(-30, 30, (8, 16)).astype(float)
    lists = topk.Lists.load(topk.Lists.build(np.arange(2000), x).dump())
    assert (lists.rows() == x).all()
    scores = q @ x.T
    known = np.sort(scores, axis=1)[:, -20]
    qi, ci, s = topk.aggregate(lists, q, np.full(8, -1), known, 20)
    assert (s == scores[qi, ci]).all() and len(qi) < 8 * 2000 / 4
    for k in range(8):
        assert set(np.flatnonzero(scores[k] >= known[k])) <= set(ci[qi == k])


def test_nearest(spark):
    rows = odd_vectors(4, n=2000, dim=24)
    got = {}
    for r in ann.nearest(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    fine = usable(rows, False)
    hits = total = 0
    for q, v in ((i, v) for i, v in fine if i % 50 == 0):
        best = sorted((-float(v @ x) / float(np.linalg.norm(v) * np.linalg.norm(x)), i) for i, x in fine if i != q)
        assert len(got[q]) == 5 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        exact = {i: -s for s, i in best}
        assert all(abs(exact[i] - s) < 1e-12 for i, s in got[q] if i != 3)
        hits += len({i for i, _ in got[q]} & {i for _, i in best[:5]})
        total += 5
    assert hits / total >= 0.9
    assert ann.nearest(vectors(spark, [])).count() == 0
    assert [(r.vec_id, round(r.score, 6)) for r in ann.nearest(vectors(spark, [(50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1e-30]), (3, [-1.0])])).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (3, -1.0)]


def test_beam_search_beats_greedy():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (1500, 16))
    q = ann.AdditiveQuantiser.train(x, books=4, words=32)
    error = lambda z: ((z.decode(z.encode(x)) - x) ** 2).sum()
    assert error(q) < error(ann.AdditiveQuantiser(q.books, beam=1)) < (x**2).sum()
    codes = q.encode(x)
    norms = np.sqrt((q.decode(codes) ** 2).sum(1))
    assert np.allclose(q.lookup(ann.unit(x[:5]), codes, norms), (ann.unit(x[:5]) @ q.decode(codes).T) / norms, atol=1e-4)


URLS = [
    "http://a.example.net/en/x", "https://example.net/en/", "http://example.net/en", "http://EXAMPLE.com/de/y?q#f", "http://net/", "http://x.net", "http://x.org/fr/a/b", "http://xorg/fr/", "no scheme", None, "", "://",
    "ftp://net/en/", "http://b.a.example.com/de/", "http://example.com:80/de/", "http://example.net/en/é", "http://q.net?x/", "a://b://net/", "http://.net/", "HTTP://Net/%7F",
]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (len(rule), len(h)) > (len(best[0]), len(best[0].split("/")[0]))):
            best = (rule, verdict)
    return host, path, best[0] if best else None, best[1] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(6)
    nested = [("block", "net/"), ("allow", "net/en/"), ("block", "net/en/x/"), ("allow", "net/en/x/y"), ("block", "a.net/"), ("allow", "a.net/en"), ("block", "com/a"), ("allow", "com/a/b"), ("block", "b.com/a/b/c/")]
    urls = URLS + ["http://" + rng.choice(["", "a.", "b.", "c.a."]) + rng.choice(["net", "com", "org"]) + "".join("/" + rng.choice(["en", "x", "y", "a", "b", "c"]) for _ in range(rng.randrange(5))) for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "<html>", "r") for i, u in enumerate(urls)] + [(0, urls[0], "", ""), (None, "http://net/", "", "")], "page_id long, url string, html string, rule string")
    for rules in (url_rules.RULES, nested):
        got = sorted(((-1 if r.page_id is None else r.page_id), r.host, r.path, r.rule or "", r.verdict) for r in url_rules.judge(pages, url_rules.rule_table(spark, rules)).collect())
        expected = [(i, *judged(u, rules)) for i, u in [*enumerate(urls), (0, urls[0]), (-1, "http://net/")]]
        assert got == sorted((i, h, p, r or "", v) for i, h, p, r, v in expected)
    none = url_rules.rule_table(spark, url_rules.RULES).limit(0)
    assert {r.verdict for r in url_rules.judge(pages, none, "block").collect()} == {"block"}
    assert url_rules.judge(pages.limit(0), url_rules.rule_table(spark)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", ""), (1, 700, "cat", "é😀"), (1, None, None, "who"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (3, 0, "system", "alone"), (None, 1, "x", "y")]
    table = spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {}
    for r in chat.perspectives(table).orderBy("conv_id", "speaker", "seat").collect():
        got.setdefault((r.conv_id, r.speaker), []).append(r)
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cat"), (2, "user"), (2, "assistant"), (None, "x")}
    low = lambda v: (v is not None, v if v is not None else 0)
    for (conv, speaker), found in got.items():
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (low(r[1]), (r[2] is not None, r[2] or ""), r[3] or ""))
        whole, masks = "", []
        for _, _, role, text in own:
            whole += "<|im_start|>" + ("assistant" if role == speaker else "system" if role == "system" else "user" + (f" name={role}" if role else "")) + "\n"
            masks.append((len(whole), len((text or "") + "<|im_end|>\n") if role == speaker else 0))
            whole += (text or "") + "<|im_end|>\n"
        assert "".join(r.segment for r in found) == whole
        assert [r.seat for r in found] == list(range(1, len(own) + 1))
        assert [(r.mask_start, r.mask_length) for r in found] == masks
        assert all(whole[r.start : r.start + r.length] == r.segment for r in found)
    assert chat.perspectives(table.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (7, 7)] + [(2000, i) for i in range(2001, 2100)]
    of = {}

    def find(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        of[max(x, y)] = min(x, y)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources", "best-fit packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf)
        assert out.columns == docs.columns
        seen = out
    assert seen.count() > 0.5 * docs.count()
    found = corpus_pipeline.run(spark, sf)
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
