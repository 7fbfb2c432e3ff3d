"""Document quality by regularised quadratic discriminant analysis of text statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import ship, written

FEATURES = ("upper", "digits", "marks", "bars", "shouts", "stops", "other", "repeats", "lines", "word_length")
#: Characters and words of ordinary text that each text is smoothed with.
CHARS, WORDS = 100, 20
#: Kinds of bytes: 0 space, 1 newline, 2 lower, 3 upper, 4 digit, 5 # $ % & *, 6 |, 7 ! ?, 8 . and comma, 9 other ASCII, 10 a character beyond ASCII, 11 its further bytes.
_KIND = np.full(256, 9, np.uint8)
_KIND[[9, 11, 12, 13, 32]] = 0
_KIND[10] = 1
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 2, 3, 4
_KIND[list(b"#$%&*")], _KIND[ord("|")], _KIND[list(b"!?")], _KIND[list(b".,")] = 5, 6, 7, 8
_KIND[192:], _KIND[128:192] = 10, 11


def statistics(column) -> np.ndarray:
    """A row of transformed statistics for each text of an Arrow column (null: empty): logs of shares, offset so that zero shares are alike at any length."""
    from .shingles import pieces, words

    out = [np.zeros((0, len(FEATURES)))]
    for _, data, ends in pieces(column):
        n = np.diff(ends, prepend=0)
        doc = np.repeat(np.arange(len(ends)), n)
        count = np.bincount(doc * 12 + _KIND[data], minlength=12 * len(ends)).reshape(-1, 12).astype(float)
        chars = count[:, :11].sum(1)
        word, upto = words(data, ends)
        w = np.diff(upto, prepend=0).astype(float)
        same = np.zeros(len(word) + 1)
        if len(word) > 1:
            again = word[1:] == word[:-1]
            inner = upto[(upto > 0) & (upto < len(word))]
            again[inner - 1] = False  # not across texts
            same[2:] = np.cumsum(again)
            same[1] = 0
        repeats = np.diff(same[upto], prepend=0.0)
        # shares as if PRIOR more characters or words of ordinary text stood there, so that a short text's few signs weigh little
        share = lambda x, y, usual, more: np.log((x + usual * more) / (y + more) + 0.01)
        letters = count[:, 2] + count[:, 3] + count[:, 10]
        out.append(np.stack([
            share(count[:, 3], letters, 0.03, CHARS), share(count[:, 4], chars, 0.0, CHARS), share(count[:, 5], chars, 0.0, CHARS), share(count[:, 6], chars, 0.0, CHARS), share(count[:, 7], chars, 0.0, CHARS),
            share(count[:, 8], w, 0.15, WORDS), share(count[:, 9], chars, 0.0, CHARS), share(repeats, w, 0.0, WORDS), share(count[:, 1], w, 0.03, WORDS), np.log((letters + 4.7 * WORDS) / (w + WORDS)),
        ], axis=1))
    return np.concatenate(out)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of `text`, for each row."""
    ship(docs.sparkSession)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            x = statistics(batch.column("text"))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, x array<double>")


class Discriminant:
    """Gaussian classes 0 and 1 with shrunk covariances; keeps the inverse Cholesky factors and log determinants."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.2):
        """moments: per class the number, sums and sums of products. pooled: the share of the common covariance in each class's."""
        d = len(FEATURES)
        self.priors, self.means, self.inverse, self.logdet = [], [], [], []
        total = sum(m[0] for m in moments.values())
        covariances = []
        for k in (0, 1):
            n, s, ss = moments.get(k, (0.0, np.zeros(d), np.zeros((d, d))))
            mean = s / n if n else np.zeros(d)
            covariances.append((n, mean, ss / n - np.outer(mean, mean) if n else np.eye(d)))
        common = sum(n * c for n, _, c in covariances) / max(total, 1) if total else np.eye(d)
        for n, mean, c in covariances:
            c = (1 - pooled) * c + pooled * common
            # oracle-approximating shrinkage towards a multiple of the identity
            trace, square = np.trace(c), float((c * c).sum())
            below = (n + 1 - 2 / d) * (square - trace**2 / d)
            shrink = 1.0 if below <= 0 else min(1.0, ((1 - 2 / d) * square + trace**2) / below)
            c = (1 - shrink) * c + (shrink * trace / d + 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(c)
            self.inverse.append(np.linalg.inv(factor))
            self.logdet.append(2 * float(np.log(np.diag(factor)).sum()))
            self.means.append(mean)
            self.priors.append((n + 1) / (total + 2))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, from the difference of log densities."""
        log = [math.log(p) - 0.5 * (ld + (((x - m) @ i.T) ** 2).sum(1)) for p, m, i, ld in zip(self.priors, self.means, self.inverse, self.logdet)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -700, 700)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class number, sums and sums of products of rows (label, x), summed on the executors: the driver gets 2 x (1 + d + d * d) numbers."""
    d = len(FEATURES)
    ship(rows.sparkSession)

    def partial(batches):
        import pyarrow as pa

        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(-1, d)
                y = batch.column("label").to_numpy()
                for k in (0, 1):
                    own = x[y == k]
                    sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for k in (0, 1):
            yield pa.RecordBatch.from_pydict({"label": np.full(sums.shape[1], k, np.int32), "at": np.arange(sums.shape[1], dtype=np.int32), "v": sums[k]})

    out = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for r in rows.mapInArrow(partial, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect():
        out[r.label][r.at] = r.v
    return {k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in out.items() if v[0]}


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """From rows (doc_id, x) and labels (doc_id, quality) of 0 or 1 that aren't held out. All such rows count: only their moments leave the executors."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    train = stats.join(usable.where(~held_out(F.col("doc_id"))), "doc_id").select("label", "x")
    return Discriminant(moments(train))


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(rows, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text; other columns are ignored).

    Scores come from the text alone. Null and empty texts have the statistics of an empty text and so a score; a null doc_id is
    kept and not held out; repeated rows are scored each and, if labelled, count each. With no labels of a class its
    density is the standard normal; labels other than 0 and 1 are ignored.
    """
    stats = written(with_statistics(docs), "statistics")
    out = scored(stats, fit(stats, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are classified as quality 1, columns as they came."""
    model = fit(with_statistics(docs), labels)
    names = docs.columns
    ship(docs.sparkSession)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(model.score(statistics(batch.column("text"))) >= 0.5))

    return docs.mapInArrow(keep, docs.schema).select(names)
