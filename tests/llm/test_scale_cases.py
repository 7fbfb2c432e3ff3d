"""Cases that grow: lists of candidates beyond one part, texts with very many matches, many pieces of one length, rows without ids."""

import time

from pyspark.sql import functions as F

from stratalog.llm import mixing, ngram_join, packing, secrets

from .helpers import documents
from .test_text_operators import brute_spans


def test_long_lists_of_unlinked_neighbours(spark):
    """Variants of one text with a word replaced: those of the same place share 31 of 41 shingles and are linked, others 26 of 46 at least and at
    most 30 of 42, and are not. A signature is shared by more nodes than a list holds."""
    base = [f"w{i}" for i in range(40)]
    rows, least = [], {}
    for i in range(4000):
        place = 4 + i * 7 % 32
        rows.append((i, " ".join([*base[:place], f"own{i}", *base[place + 1 :]]), "s"))
        least.setdefault(place, i)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(documents(spark, rows)).collect()}
    assert got == {i: least[4 + i * 7 % 32] for i in range(4000)}


def test_signatures_of_linked_sets_meet():
    """Sets at the very bound share a signature, whatever shingles a sketch calls frequent."""
    import numpy as np

    rng = np.random.default_rng(3)
    bands, rare = ngram_join.Bands(75), rng.integers(0, 16, 1 << ngram_join.SKETCH_BITS).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        keep = -(-3 * len(a) // 4) if rng.random() < 0.5 else len(a)  # a subset, or as many new ones as the bound lets in
        extra = 0 if keep < len(a) else len(a) // 3
        b = np.unique(np.concatenate([rng.permutation(a)[:keep], rng.integers(0, 2**64, extra, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert 100 * both >= 75 * (len(a) + len(b) - both)
        own, sig = ngram_join.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), bands, rare)
        assert set(sig[own == 0].tolist()) & set(sig[own == 1].tolist())


def test_packed_signatures_come_back():
    """Each signature with its set, in the partition of its hash's range; equal ones and the largest too."""
    import numpy as np

    rng = np.random.default_rng(5)
    names = rng.integers(-(2**63), 2**63, 50)
    for n, parts in ((0, 3), (1, 1), (3000, 7), (3000, 5000)):
        sig, own = rng.integers(0, 2**52, n), rng.integers(0, 50, n)
        sig[: n // 3] = sig[:1].sum() if n else 0
        sig[n // 2 : n // 2 + 1] = 2**52 - 1
        got = []
        for part, body in ngram_join.packed(sig, own, names, parts):
            assert 0 <= part < parts
            back, node = ngram_join.unpacked(body)
            assert ((((back >> 16) & 0xFFFFFFFF) * parts) >> 32 == part).all() and (np.diff(back) >= 0).all()
            got += zip(back.tolist(), node.tolist())
        assert sorted(got) == sorted(zip(sig.tolist(), names[own].tolist()))


def test_text_with_very_many_secrets(spark):
    text = " ".join(f"é token=abcdefgh{i % 7} {i:032x} x" for i in range(3000))
    docs = documents(spark, [(1, text, "s")])
    r = secrets.find(docs).collect()[0]
    base = brute_spans(text)
    assert (r.n_assign, r.n_hex) == (3000, 3000)
    assert {f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(r.spans.split(","))
    want, at = [], 0
    for a, _, b in sorted(base):
        want += [text[at:a], "<secret>"]
        at = b
    assert secrets.redact(docs).collect()[0].text == "".join([*want, text[at:]])


def test_packing_of_equal_lengths():
    for sizes, bins in (([100] * 2048, 52), ([300] * 2048, 158), ([1] * 4096 + [4095], 3), ([], 0)):
        began = time.time()
        packed = packing.pack(sizes, 4096)
        assert len(packed) <= bins and sorted(i for b in packed for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 4096 for b in packed) and time.time() - began < 5


def test_rows_without_ids_toss_their_own_coins(spark):
    rows = [(None, f"text {i} of some words", "a") for i in range(400)] + [(i, "five words are in here", "b") for i in range(400)]
    taken = mixing.mix(documents(spark, rows)).groupBy("source").agg(F.countDistinct("text").alias("texts"), F.count(F.lit(1)).alias("n")).collect()
    by = {r.source: r for r in taken}
    assert 0 < by["b"].n and by["a"].texts <= 400 and abs(by["a"].n - 2 * 400) < 1e-9 or 400 < by["a"].n < 800
