"""Approximate nearest neighbours by cosine: additive quantisation, table lookups, exact reranking."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .vectors import BLOCK, QUERIES, best_pairs, blocks, groups_for, prepared, search, shape


class AdditiveQuantiser:
    """Sums of one full-dimensional codeword from each codebook."""

    def __init__(self, books: np.ndarray, beam: int = 4):
        self.books, self.beam = books.astype(np.float32), beam

    @classmethod
    def train(cls, x: np.ndarray, books: int = 8, words: int = 256, rounds: int = 6, refits: int = 1, beam: int = 4, seed: int = 5) -> "AdditiveQuantiser":
        """Codebooks by k-means of the residuals one after another, then refitted together by least squares for the sample's beam-search codes."""
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        words = max(1, min(words, len(x)))
        made, rest = np.zeros((books, words, x.shape[1]), np.float32), x.copy()
        for m in range(books):
            c = rest[rng.choice(len(rest), words, replace=False)].copy() if len(rest) else made[m]
            for _ in range(rounds if len(rest) else 0):
                near = (rest @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
                n = np.bincount(near, minlength=words)
                order = np.argsort(near, kind="stable")
                have = np.flatnonzero(n)
                c[have] = np.add.reduceat(rest[order], (np.cumsum(n) - n)[have], axis=0) / n[have, None]
                if len(empty := np.flatnonzero(n == 0)):
                    c[empty] = rest[rng.choice(len(rest), len(empty))]
            made[m] = c
            if len(rest):
                rest -= c[(rest @ c.T - 0.5 * (c * c).sum(1)).argmax(1)]
        out = cls(made, beam)
        for _ in range(refits if len(x) else 0):
            flat = out.encode(x).astype(np.int64) + np.arange(books) * words
            gram, right = np.zeros((books * words, books * words), np.float32), np.zeros((books * words, x.shape[1]), np.float32)
            for i in range(books):
                np.add.at(right, flat[:, i], x)
                for j in range(books):
                    np.add.at(gram, (flat[:, i], flat[:, j]), 1)
            gram[np.diag_indices_from(gram)] += 1e-2
            out = cls(np.linalg.solve(gram, right + 1e-2 * out.books.reshape(-1, x.shape[1])).reshape(books, words, -1), beam)
        return out

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes by beam search: after each codebook the `beam` partial sums nearest to the vector go on."""
        x = x.astype(np.float32)
        out = np.zeros((len(x), len(self.books)), np.uint8)
        for a in range(0, len(x), 512):
            rest = x[a : a + 512, None, :]
            codes = np.zeros((len(rest), 1, 0), np.uint8)
            for c in self.books:
                far = (rest * rest).sum(-1)[..., None] - 2 * (rest @ c.T) + (c * c).sum(1)
                flat = far.reshape(len(rest), -1)
                keep = min(self.beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                word, came = best % len(c), best // len(c)
                rest = np.take_along_axis(rest, came[..., None], 1) - c[word]
                codes = np.concatenate([np.take_along_axis(codes, came[..., None], 1), word[..., None].astype(np.uint8)], axis=2)
            best = (rest * rest).sum(-1).argmin(1)
            out[a : a + 512] = np.take_along_axis(codes, best[:, None, None], 1)[:, 0]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))

    def lookup(self, q: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate cosines of unit queries with coded vectors: sums of table entries over the stored norm of each sum."""
        scores = np.zeros((len(q), len(codes)), np.float32)
        for m, c in enumerate(self.books):
            scores += np.take(q.astype(np.float32) @ c.T, codes[:, m], axis=1)
        return scores / norms


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    top = np.abs(x).max(1, keepdims=True)
    x = np.where((top > 1e100) | (top < 1e-100), x / top, x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact measure in double precision, row by row, each row summed alike."""
    def scaled(v):
        top = np.abs(v).max(-1, keepdims=True)
        return np.where((top > 1e100) | (top < 1e-100), v / top, v)

    q, x = scaled(q), scaled(x)
    return (q * x).sum(-1) / (np.sqrt((q * q).sum(-1)) * np.sqrt((x * x).sum(-1)))


def nearest(table: DataFrame, each: int = 50, k: int = 5, sample: int = 16384, rerank: float = 1 / 16) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id `each` divides, against all others; score: cosine, in double precision, on the vectors.

    table: vec_id, embedding; other columns are ignored. Vectors that are null, zero or hold null or non-finite components, and null vec_ids, take no
    part; shorter vectors count as followed by zeros. Rows of one vec_id are candidates each, but never for a query of that id. Ties go
    to the smaller vec_id. No rows, no answers.

    The codebooks are fitted on at most `sample` vectors, those with the least hashes of their ids; every row is encoded and searched. In each block of
    vectors 64 and a share `rerank` of them, those with the best lookup scores, are compared exactly.
    """
    rows = prepared(table, False, "vectors")
    count, asked, dim = shape(rows, each)
    seen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").collect()
    fitted = np.zeros((len(seen), dim))
    for i, r in enumerate(seen):
        fitted[i, : len(r.x)] = r.x
    del seen
    books = rows.sparkSession.sparkContext.broadcast(AdditiveQuantiser.train(unit(fitted) if len(fitted) else fitted).books)

    def body(ids, x):
        quantiser = AdditiveQuantiser(books.value)
        codes = quantiser.encode(unit(x))
        out = io.BytesIO()
        np.savez(out, ids=ids, x=x, codes=codes, norms=np.maximum(np.sqrt((quantiser.decode(codes) ** 2).sum(1)), 1e-9))
        return out.getvalue()

    def question(ids, x):
        out = io.BytesIO()
        np.savez(out, ids=ids, x=x)
        return out.getvalue()

    def look(bodies, body):
        quantiser = AdditiveQuantiser(books.value)
        z = np.load(io.BytesIO(body))
        ids, q = z["ids"], z["x"]
        best, tables = None, unit(q)
        for b in bodies:
            y = np.load(io.BytesIO(b))
            scores = quantiser.lookup(tables, y["codes"], y["norms"])
            scores[y["ids"][None, :] == ids[:, None]] = -np.inf
            n = scores.shape[1]
            short = min(n, 64 + int(n * rerank))
            # the best `short`, ties to the smaller id, which has the smaller place
            limit = np.partition(scores, n - short, axis=1)[:, n - short, None]
            over = scores > limit
            level = (scores == limit) & np.isfinite(scores)
            level &= np.cumsum(level, axis=1) <= short - over.sum(1, keepdims=True)
            qi, ci = np.nonzero(over | level)
            exact, x = np.empty(len(qi)), y["x"]
            for a in range(0, len(qi), 65536):
                s = slice(a, a + 65536)
                exact[s] = cosines(q[qi[s]], x[ci[s]])
            found = (qi, y["ids"][ci], exact)
            best = best_pairs(*(found if best is None else (np.concatenate(v) for v in zip(best, found))), k)
        return ids[best[0]], best[1], best[2]

    index = blocks(rows, count, BLOCK, dim, body)
    asking = blocks(rows.where(F.col("vec_id") % each == 0), asked, QUERIES, dim, question)
    return search(index, asking, groups_for(count), k, look, "double")
