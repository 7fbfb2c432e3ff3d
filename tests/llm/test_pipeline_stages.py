"""Each stage of the pipeline against a brute-force version on the same rows: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalog.llm import quality, secrets, tokens

from .helpers import groups
from .test_text_operators import brute_spans

SF = "/root/testdata/sf0.001"
CLASHING = ["row", "size", "score", "target", "copies", "rate", "spans", "x", "node", "component_id", "length"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels of a folder of its own: a real table and odd rows beside it."""
    rng = random.Random(9)
    out = str(tmp_path_factory.mktemp("corpus"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [r.text for r in docs.where(F.length("text") > 200).orderBy("doc_id").limit(6).collect()]
    odd = [
        (90_000, None, "s"), (90_001, "", "s"), (90_002, " \t\n", None), (90_003, "é " + some[0] + " password = 'abcdefgh' end", "s"), (90_004, some[1], None), (90_004, some[1], None),
        (None, some[2], "s"), (None, None, None), (90_005, " ".join(some[rng.randrange(6)] for _ in range(60)), "s"), (90_006, some[3] + " token=12345678 AKIA" + "Q7" * 9, "s"), (90_007, some[4] + " edited", "s"),
    ]
    for k, text in enumerate(some):  # secrets in texts that are like no other, so that they reach their stage
        own = text.split()
        rng.shuffle(own)
        odd.append((91_000 + k, " ".join(own[: len(own) // 2]) + f" passwd: é{k} password=abcdefgh{k} AKIA{'Q7' * 9} " + " ".join(own[len(own) // 2 :]), "s"))
    odd = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in odd], docs.schema)
    whole = docs.unionByName(odd)
    whole.select("*", *[F.lit("own").alias(c) for c in CLASHING]).write.parquet(f"{out}/documents.parquet")
    return out


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], folder).write.parquet(f"{folder}/after{k}")
        seen.append(spark.read.parquet(f"{folder}/after{k}"))
    return seen


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_columns_stay(stages):
    for after in stages[1:-1]:
        assert after.columns == stages[0].columns
        assert {tuple(r) for r in after.select(CLASHING).distinct().collect()} == {("own",) * len(CLASHING)}


def test_classifier_keeps_what_it_predicts(spark, folder, stages):
    """The rows that the query op1 marks 1, judged text by text."""
    judged = quality.classify(stages[0], spark.read.parquet(f"{folder}/labels.parquet"))
    assert bag(stages[1], "doc_id") == bag(judged.where("predicted = 1"), "doc_id")
    assert 0 < stages[1].count() < stages[0].count()


def test_one_document_of_each_group(stages):
    before = stages[1].where("doc_id IS NOT NULL").collect()
    roots = groups({r.doc_id: r.text for r in before})
    expected = {i for i in roots if roots[i] == i}
    after = stages[2].collect()
    assert {r.doc_id for r in after if r.doc_id is not None} == expected
    assert len(expected) < len(roots)
    of = {r.doc_id: r.text for r in before}
    assert all(r.text == of[r.doc_id] for r in after if r.doc_id is not None)


def test_secrets_are_replaced(stages):
    random_spans = {}
    for r in secrets.find(stages[2]).collect():
        random_spans.setdefault(r.doc_id, set()).update((int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "random")

    def hidden(doc_id, text):
        spans = sorted({(a, b) for a, _, b in brute_spans(text)} | random_spans.get(doc_id, set()))
        out, at, end = [], 0, 0
        for a, b in spans:
            if a >= end:
                out += [text[at:a], "<secret>"]
            at = end = max(end, b)
        return "".join(out) + text[at:] if text is not None else None

    expected = Counter((r.doc_id, t, None if t is None else len(t)) for r in stages[2].collect() for t in [hidden(r.doc_id, r.text)])
    assert bag(stages[3], "doc_id", "text", "n_chars") == expected
    assert any("<secret>" in (t or "") for _, t, _ in expected)


def test_copies(stages):
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in stages[3].collect()]
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left = {}, 1.5 * sum(size.values())
    for s in sorted(order, key=lambda s: 2 * size[s] / weight[s]):  # the least room for its weight first
        target[s] = min(2 * size[s], left * weight[s] / sum(weight[o] for o in order if o not in target))
        left -= target[s]
    got = Counter(r.doc_id for r in stages[4].collect())
    expected = Counter()
    for i, s, n in rows:
        rate = target[s] / size[s] if size[s] else 0
        coin = int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) / 2**52
        if i is not None:
            expected[i] += floor(rate) + (coin < rate - floor(rate))
    assert {i: n for i, n in got.items() if i is not None} == {i: n for i, n in expected.items() if n}


def test_pieces_hold_every_id(stages):
    whole = tokens.Encoder.of().whole
    expected = Counter()
    for r in stages[4].collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        expected.update((r.doc_id, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096)))
    assert bag(stages[5], "doc_id", "piece", "start", "length", "ids_crc32") == expected
    total = sum(k[3] * n for k, n in expected.items())
    sequences = stages[5].toPandas().sort_values("offset").groupby("sequence_id")
    assert sequences.ngroups <= -(-total // 4096) + 1
    for _, g in sequences:
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and "sequence_id" in found.columns
