"""Quality classifier: a generalised additive model with pairwise interactions, learnt by cyclic boosting of shallow trees."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that training reads at most: those with the smallest hashes of doc_id.
TRAINING_ROWS = 20_000
BINS = 24
PAIR_BINS = 8
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.12

FEATURES = (
    "log_words", "word_length", "distinct_words", "top_word", "next_same", "upper", "digits", "symbols", "bars", "exclaims", "stops", "commas",
    "other_ascii", "high_bytes", "dup_lines", "words_a_line", "long_words", "distinct_pairs",
)


def features(text: str) -> list[float]:
    """Numbers of a whole text, in the order of FEATURES; an empty text has zeros."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw) - int(c[[9, 10, 11, 12, 13, 32]].sum()))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    upper, lower, digits = int(c[65:91].sum()), int(c[97:123].sum()), int(c[48:58].sum())
    symbols = int(c[[35, 42, 36, 37, 38, 60, 62]].sum())
    bars, exclaims, stops, commas = int(c[124]), int(c[33] + c[63]), int(c[46]), int(c[44])
    high = int(c[128:].sum())
    other = size - upper - lower - digits - symbols - bars - exclaims - stops - commas - high
    return [
        float(np.log1p(n)), size / n, len(counts) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, upper / size, digits / size, symbols / size,
        bars / n, exclaims / n, stops / n, commas / n, other / size, high / size, 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        sum(k > 18 for k in map(len, counts)) / n, len(set(zip(words, words[1:], strict=False))) / n,
    ]


@dataclass
class Model:
    """Lookup tables: a score's logit is the intercept, plus a table's value for each feature's bin, plus one for each pair's bins."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += values[np.searchsorted(cuts, x[:, j], "right")]
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            out += values[np.searchsorted(self.pair_cuts[a], x[:, a], "right"), np.searchsorted(self.pair_cuts[b], x[:, b], "right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of an ordered run of bins."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of three leaves at most over ordered bins."""
    gain, cut = _best_cut(g, h)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    parts = [slice(0, cut), slice(cut, len(g))]
    gains = [_best_cut(g[p], h[p]) for p in parts]
    k = int(gains[1][0] > gains[0][0])
    if gains[k][0] > 1e-9:
        at = parts[k].start + gains[k][1]
        parts[k : k + 1] = [slice(parts[k].start, at), slice(at, parts[k].stop)]
    out = np.empty(len(g))
    for p in parts:
        out[p] = g[p].sum() / (h[p].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that cuts the first feature once and each side's second feature once: gain and values."""
    best, values = -1.0, np.zeros_like(g)
    for cut in range(1, g.shape[0]):
        gain, candidate = 0.0, np.empty_like(g)
        for p in (slice(0, cut), slice(cut, g.shape[0])):
            gs, hs = g[p].sum(0), h[p].sum(0)
            more, at = _best_cut(gs, hs)
            gain += more + gs.sum() ** 2 / (hs.sum() + 1)
            for q in (slice(0, at), slice(at, g.shape[1])) if more > 0 else (slice(0, g.shape[1]),):
                candidate[p, q] = gs[q].sum() / (hs[q].sum() + 1)
        if gain > best:
            best, values = gain, candidate
    return best, values


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting: each round visits every feature in turn and adds a small tree to its table, then the strongest pairs likewise."""
    model = Model()
    if not len(y):
        return model
    mean = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    model.intercept = float(np.log(mean / (1 - mean)))
    model.cuts = [_quantile_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    model.pair_cuts = [_quantile_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    if y.min() == y.max():
        return model
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    logit = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            if len(model.tables[j]) < 2:
                continue
            p = 1 / (1 + np.exp(-logit))
            step = RATE * np.clip(_tree(np.bincount(b, y - p, len(model.tables[j])), np.bincount(b, p * (1 - p), len(model.tables[j]))), -4, 4)
            model.tables[j] += step
            logit += step[b]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        cell = coarse[a] * sizes[b] + coarse[b]
        n = sizes[a] * sizes[b]
        return np.bincount(cell, y - p, n).reshape(sizes[a], sizes[b]), np.bincount(cell, p * (1 - p), n).reshape(sizes[a], sizes[b]), cell

    gains = [(_pair_tree(*sums(a, b)[:2])[0], a, b) for a, b in combinations(range(x.shape[1]), 2) if min(sizes[a], sizes[b]) > 1]
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h, cell = sums(a, b)
            step = RATE * np.clip(_pair_tree(g, h)[1], -4, 4)
            model.pair_tables[k] += step
            logit += step.ravel()[cell]
    return model


def held_out() -> F.Column:
    """Rows that training must not learn labels from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Fits on `rows` labelled documents at most, never on held-out ones. A document labelled twice counts once, with its larger label."""
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("_y"))
    sample = usable.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)  # bounded by rows: safe to broadcast

    def run(batches):
        for batch in batches:
            values = np.array([features(t.as_py() or "") for t in batch.column(3)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(values), pa.list_(pa.float64()))], ["doc_id", "_y", "_tag", "_x"])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.col("_y").cast("int").alias("_y"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tag"), "text")
    # of an id with several texts, that with the least hash
    rows = joined.mapInArrow(run, "doc_id long, _y int, _tag long, _x array<double>").groupBy("doc_id").agg(F.min(F.struct("_tag", "_y", "_x")).alias("_r"))
    found = rows.select("doc_id", "_r._y", "_r._x").collect()
    found.sort(key=lambda r: r.doc_id)
    return fit(np.array([r._x for r in found], np.float64).reshape(-1, len(FEATURES)), np.array([r._y for r in found], np.float64))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): every whole text is scored by bin lookups, a batch at a time; no shuffle.

    A null text is an empty one, whose features are zeros and which gets a score too; repeated rows give a row each;
    other columns are ignored; an empty table gives an empty result; without labels every score is 0.5.
    """

    def run(batches):
        for batch in batches:
            x = np.array([features(t.as_py() or "") for t in batch.column(2)], np.float64).reshape(-1, len(FEATURES))
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns and order within a partition; no shuffle."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            x = np.array([features(t.as_py() or "") for t in batch.column(at)], np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(run, schema)
