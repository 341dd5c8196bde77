"""Text quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from sondage.llm.common import arrow_pass, arrow_rows, col, raw_text

FEATURES = ["chars", "words", "word_length", "distinct", "repeats", "top_word", "upper", "symbols", "stops", "digits", "spaces", "line_words", "same_lines", "non_ascii"]
# Labelled rows that the model is fitted on at most, drawn by a hash of the id.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
MIN_LEAF = 8
KEEP = 0.3

_KIND = np.zeros((256, 6))
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = [65 <= _b <= 90, _c in "!\"#$%&'()*+-/:;<=>@[\\]^_`{|}~", _c in ".,", 48 <= _b <= 57, _c in " \t\n\r\x0b\x0c", 192 <= _b]


def features(raw: bytes) -> list[float]:
    """Figures of a whole text, given as UTF-8; an empty text has zeros."""
    n = len(raw)
    words = raw.split()
    m = len(words)
    if not m:
        return [float(np.log1p(n))] + [0.0] * (len(FEATURES) - 1)
    upper, symbols, stops, digits, spaces, wide = (np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _KIND).tolist()
    kinds: dict[bytes, int] = {}
    get = kinds.get
    for w in words:
        kinds[w] = get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    return [
        float(np.log1p(n)), float(np.log1p(m)), (n - spaces) / m, len(kinds) / m, sum(map(eq, words, words[1:])) / m, max(kinds.values()) / m,
        upper / n, symbols / n, stops / m, digits / n, spaces / n, float(np.log1p(m / max(len(lines), 1))), 1.0 - len(set(lines)) / max(len(lines), 1), wide / n,
    ]


def cuts_of(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def step_1d(grad: np.ndarray, hess: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The values of a tree of depth 2 over ordered bins: the best cut, then the best cut of either side."""

    def split(lo: int, hi: int, depth: int, out: np.ndarray) -> None:
        g, h, c = np.cumsum(grad[lo:hi]), np.cumsum(hess[lo:hi]), np.cumsum(count[lo:hi])
        out[lo:hi] = -g[-1] / (h[-1] + 1.0)
        if depth == 0 or hi - lo < 2:
            return
        gain = g[:-1] ** 2 / (h[:-1] + 1.0) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1.0) - g[-1] ** 2 / (h[-1] + 1.0)
        gain[(c[:-1] < MIN_LEAF) | (c[-1] - c[:-1] < MIN_LEAF)] = -1.0
        at = int(np.argmax(gain))
        if gain[at] > 1e-9:
            split(lo, lo + at + 1, depth - 1, out)
            split(lo + at + 1, hi, depth - 1, out)

    out = np.zeros(len(grad))
    split(0, len(grad), 2, out)
    return out


def quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best two crossing cuts of a grid: their gain and the four values spread over the grid."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    parts = []
    for x in (g, h):
        a = x[:-1, :-1]
        parts.append([a, x[:-1, -1:] - a, x[-1:, :-1] - a, x[-1, -1] - x[:-1, -1:] - x[-1:, :-1] + a])
    gain = sum(p**2 / (q + 1.0) for p, q in zip(*parts))
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    v = [-p[i, j] / (q[i, j] + 1.0) for p, q in zip(*parts)]
    out = np.empty(grad.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + 1.0)), out


class Model:
    """Intercept, a table per feature and a grid per chosen pair; a score is the sum of the bins' values."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n = len(y)
        prior = (y.sum() + 1.0) / (n + 2.0)
        self.intercept = float(np.log(prior / (1 - prior)))
        self.cuts = [cuts_of(x[:, f], BINS) if n else np.empty(0) for f in range(len(FEATURES))]
        self.coarse = [cuts_of(x[:, f], PAIR_BINS) if n else np.empty(0) for f in range(len(FEATURES))]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if n == 0 or y.min() == y.max():
            return
        bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]
        z = np.full(n, self.intercept)
        size = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, self.tables)]
        for _ in range(ROUNDS):
            for f, b in enumerate(bins):
                p = 1 / (1 + np.exp(-z))
                k = len(self.tables[f])
                step = RATE * step_1d(np.bincount(b, p - y, k), np.bincount(b, p * (1 - p), k), size[f])
                self.tables[f] += step
                z += step[b]
        wide = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.coarse)]
        found = []
        p = 1 / (1 + np.exp(-z))
        for f in range(len(FEATURES)):
            for g in range(f + 1, len(FEATURES)):
                a, b = len(self.coarse[f]) + 1, len(self.coarse[g]) + 1
                if a > 1 and b > 1:
                    at = wide[f] * b + wide[g]
                    found.append((quadrants(np.bincount(at, p - y, a * b).reshape(a, b), np.bincount(at, p * (1 - p), a * b).reshape(a, b))[0], f, g))
        found.sort(key=lambda t: (-t[0], t[1], t[2]))
        self.pairs = [(f, g, np.zeros((len(self.coarse[f]) + 1, len(self.coarse[g]) + 1))) for _, f, g in found[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for f, g, grid in self.pairs:
                p = 1 / (1 + np.exp(-z))
                at = wide[f] * grid.shape[1] + wide[g]
                step = RATE * quadrants(np.bincount(at, p - y, grid.size).reshape(grid.shape), np.bincount(at, p * (1 - p), grid.size).reshape(grid.shape))[1]
                grid += step
                z += step[wide[f], wide[g]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (c, t) in enumerate(zip(self.cuts, self.tables)):
            z += t[np.searchsorted(c, x[:, f], side="right")]
        wide = {f: np.searchsorted(self.coarse[f], x[:, f], side="right") for pair in self.pairs for f in pair[:2]}
        for f, g, grid in self.pairs:
            z += grid[wide[f], wide[g]]
        return 1 / (1 + np.exp(-z))


def fit_quality(docs: DataFrame, labels: DataFrame, where: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE_ROWS) -> Model:
    """A model of label 1 from the labelled documents (that fit ``where``, a condition on the id column).

    At most ``sample`` labels are used, those with the smallest hash of their id. Labels other than 0 and 1, and null
    ids, are passed over; a repeated label or document counts once; with no label, or one kind only, the model is the smoothed
    share. The sample is sorted before fitting, so the same rows give the same model.
    """
    marks = labels.select(col(doc_id).alias("doc_id"), col(label).cast("int").alias("y"))
    if where is not None:
        marks = marks.where(where)
    marks = marks.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = docs.select(col(doc_id).alias("doc_id"), raw_text(text).alias("raw")).join(F.broadcast(marks), "doc_id").select("doc_id", "y", "raw")

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in b.column(2).to_pylist()], dtype=float).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x[:, i]) for i in range(x.shape[1])]], names=["doc_id", "y", *FEATURES])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = arrow_rows(rows, run, f"doc_id {kind}, y int, " + ", ".join(f"{f} double" for f in FEATURES))
    # a row per label, however often its document is repeated, so the sample's bound holds
    got = found.groupBy("doc_id", "y").agg(F.min(F.struct(*FEATURES)).alias("x")).select("doc_id", "y", "x.*").toPandas()
    got = got.sort_values(["doc_id", "y", *FEATURES], kind="stable")
    return Model(got[FEATURES].to_numpy(float), got["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Columns ``row`` (the input row) and ``score`` (0 to 1, higher: label 1 likelier).

    Null and empty texts are scored as a text without words. Every row is scored over its whole text, repeated rows
    alike; other columns stay inside ``row`` whatever their names; an empty table gives an empty result.
    """

    def make():
        def fn(arrays):
            x = np.array([features(t) for t in arrays[0].to_pylist()], dtype=float).reshape(len(arrays[0]), len(FEATURES))
            return [pa.array(model.score(x))]

        return fn

    return arrow_pass(docs, make, {"raw": raw_text(text)}, [StructField("score", DoubleType())])
