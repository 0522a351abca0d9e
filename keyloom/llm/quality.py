"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 poor, 1 good but toxic, 2 good. One weight vector over hashed text
features gives a score f; ordered thresholds t0 < t1 give P(grade <= k) =
sigmoid(t_k - f), hence the expected grade and the tail P(grade >= 2) by which
documents are selected. Features are the presence of words, of their first 4
and 5 bytes, and of binned measures of style, hashed to 2^18 buckets.

The model is fitted on the driver on at most SAMPLE labelled documents, those
with the least keyed hash of their id, one row for each id and equal feature sets
once; every document is scored, on its whole text. Defined results: null or empty text has style features only; labels with
nulls, or without document, are ignored; of repeated labels of a document the
worst grade holds; without labels nothing is rejected; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, filter_slices, map_slices, stored

#: Labelled documents that the fit uses at most, hash buckets, and the fewest documents that a fitted feature occurs in.
SAMPLE, BUCKETS, MIN_DOCS = 12_000, 1 << 18, 8
#: P(grade >= 2) from which a document is kept; chosen on held-out labels so that few toxic documents pass.
LEAST = 0.8

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_UPPER, _SYMBOL, _PIPE = (bytes(set(range(256)) - set(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&<>!", b"|"))


def features(text: str | None) -> np.ndarray:
    """The distinct hash buckets of a text's features."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = raw.translate(_WORD).split()
    plain = raw.split()
    n = max(1, len(plain))
    bins = lambda x, top=12: min(top, int(x * 24))
    style = [
        b"\0upper %d" % bins(len(raw.translate(None, _UPPER)) / max(1, len(raw))),
        b"\0symbol %d" % bins(len(raw.translate(None, _SYMBOL)) / n / 4),
        b"\0pipe %d" % bins(len(raw.translate(None, _PIPE)) / n / 2),
        b"\0distinct %d" % bins(len(set(plain)) / n, 24),
        b"\0long %d" % bins(len(raw) / n / 24, 24),
        b"\0words %d" % len(plain).bit_length(),
        b"\0lines %d" % bins(len(set(x := raw.split(b"\n"))) / len(x), 24),
    ]
    kinds = set(found)
    stems = {b"\0" + w[:4] for w in kinds} | {b"\0" + w[:5] for w in kinds}
    return np.unique(HASHES.of([*kinds, *stems, *style]) % np.uint64(BUCKETS)).astype(np.int32)


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade > k) for each row and threshold k."""
        f = np.array([self.weights[x].sum() for x in rows])
        return 1 / (1 + np.exp(np.clip(self.thresholds - f[:, None], -50, 50)))


def evidence(flat: np.ndarray, of: np.ndarray, grades: np.ndarray, grades_n: int, names: int) -> np.ndarray:
    """How well each feature tells grades apart: its largest log ratio, over the thresholds, of the rates above and below."""
    best = np.full(names, 0.05)
    for k in range(grades_n - 1):
        above = grades > k
        high = np.bincount(flat, above[of], minlength=names) + 1
        low = np.bincount(flat, ~above[of], minlength=names) + 1
        best = np.maximum(best, np.abs(np.log(high / (above.sum() + 2)) - np.log(low / ((~above).sum() + 2))))
    return best


def fit(rows: list[np.ndarray], grades: np.ndarray, grades_n: int = 3, l1: float = 3e-4, steps: int = 160, rate: float = 0.2) -> Model:
    """Penalised maximum likelihood by Adam steps with soft thresholding; deterministic.

    A feature's steps are as long as its evidence, so that rare decisive words aren't held back by the penalty.
    """
    seen = np.bincount(np.concatenate(rows), minlength=BUCKETS) >= MIN_DOCS if rows else np.zeros(BUCKETS, bool)
    rows = [x[seen[x]] for x in rows]
    size = np.array([len(x) for x in rows])
    flat, of = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), size)
    names = np.flatnonzero(np.bincount(flat, minlength=BUCKETS))
    flat = np.searchsorted(names, flat).astype(np.int32)
    # The same entries by feature: sums over runs are quicker than over scattered places.
    by_name = of[np.argsort(flat, kind="stable")]
    name_at = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(names)))[:-1]])
    some = np.flatnonzero(size)
    row_at = (np.cumsum(size) - size)[some]
    w, gap = np.zeros(len(names)), np.zeros(grades_n - 1)
    told = evidence(flat, of, grades, grades_n, len(names))
    m, v, gm, gv = (np.zeros_like(x) for x in (w, w, gap, gap))
    share = np.cumsum([(grades == k).mean() for k in range(grades_n - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    gap[0], gap[1:] = start[0], np.log(np.maximum(np.diff(start), 0.1))
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])]))
        f = np.zeros(len(rows))
        f[some] = np.add.reduceat(w[flat], row_at) if len(flat) else 0
        low = 1 / (1 + np.exp(-np.clip(np.concatenate([[-np.inf], cuts])[grades] - f, -50, 50)))
        high = 1 / (1 + np.exp(-np.clip(np.concatenate([cuts, [np.inf]])[grades] - f, -50, 50)))
        low, high = np.where(grades == 0, 0, low), np.where(grades == grades_n - 1, 1, high)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        dw = np.add.reduceat(((dh - dl) / len(rows))[by_name], name_at) if len(names) else np.zeros(0)
        dc = np.array([-(dh[grades == k].sum() - dl[grades == k + 1].sum()) / len(rows) for k in range(grades_n - 1)])
        dg = np.array([dc.sum(), *(dc[k:].sum() * np.exp(gap[k]) for k in range(1, grades_n - 1))])
        for x, d, a, b, pace in ((w, dw, m, v, rate * told), (gap, dg, gm, gv, rate)):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            x -= pace * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)
        pull = rate * l1 / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w[:] = np.sign(w) * np.maximum(np.abs(w) - pull, 0)
    weights = np.zeros(BUCKETS, np.float32)
    weights[names] = w
    return Model(weights, np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])])))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.dropna(subset=["doc_id", "quality", "toxic"]).groupBy("doc_id").agg(F.min(grade).alias("grade"))


def labelled(docs: DataFrame, labels: DataFrame, rows: int, skip: int = 0, seed: int = 11) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of the labelled documents of least keyed hash, after the first `skip` of them."""
    order = F.xxhash64("doc_id", F.lit(seed))
    picked = stored(graded(labels).orderBy(order, "doc_id").limit(skip + rows), "sample").orderBy(order, "doc_id").offset(skip)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # One row for each document, so that repeated ids don't make the sample larger.
    found = found.groupBy("doc_id", "grade").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))
    step = lambda r: {"doc_id": r["doc_id"], "grade": r["grade"], "f": [features(x) for x in r["text"]]}
    got = map_slices(found, step, "doc_id long, grade int, f array<int>").toArrow().sort_by([("doc_id", "ascending")])
    return [x.values.to_numpy() for x in got["f"]], got["grade"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    rows, grades = labelled(docs, labels, sample)
    once = list({x.tobytes(): i for i, x in enumerate(rows)}.values())
    rows, grades = [rows[i] for i in once], grades[once]
    return fit(rows, grades) if len(rows) else None


def scored(docs: DataFrame, model: Model | None, least: float = LEAST) -> DataFrame:
    """doc_id, expected_grade, p_ge_1, p_ge_2, kept (p_ge_2 >= least) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(rows: dict) -> dict:
        n = len(rows["text"])
        tails = shared.value.tails([features(x) for x in rows["text"]]) if shared.value else np.ones((n, 2))
        return {"doc_id": rows["doc_id"], "expected_grade": tails.sum(axis=1), "p_ge_1": tails[:, 0], "p_ge_2": tails[:, 1], "kept": tails[:, 1] >= least}

    return map_slices(docs.select("doc_id", "text"), step, "doc_id long, expected_grade double, p_ge_1 double, p_ge_2 double, kept boolean")


def selected(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs that the classifier keeps; each row is judged by its own text, whatever its doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    keep = lambda texts: shared.value.tails([features(x) for x in texts])[:, 1] >= least
    return filter_slices(docs, keep) if shared.value else docs
