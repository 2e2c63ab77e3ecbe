"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one feature after another, always on what the others leave unexplained, and each
tree is added into its feature's lookup table over bins; then the same is done for the pairs of features that explain
most of the rest. A score is a sum of table entries, looked up for a whole batch at once.

The model is fitted on a bounded sample: at most ``MAX_ROWS`` labelled rows, taken in the order of a hash of the id, and
of equal ids in the order of label and a hash of the text, so that the same tables always give the same model.
Scores are computed for every document from its whole text.

Nulls: a null text is scored as an empty one, which has a score like any other text. Rows with a null id or label are not
learned from; an id with several labels or texts is learned from as often as it occurs, within the bound. With no labelled rows, or only
one class, every score is the rate of label 1 (0.5 without any). Repeated rows get equal scores. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .rules import STOP_WORDS

MAX_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, SHRINK, LEAST_ROWS = 150, 60, 0.1, 1.0, 20

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "shouts", "stops", "marks", "lines", "foreign",
    "entropy", "distinct", "adjacent", "stop_words", "single", "dup_lines",
)
_STOP_BYTES = frozenset(w.encode() for w in STOP_WORDS)


def features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words, size = raw.split(), max(1, len(raw))
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    p = counts[counts > 0] / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    per_word = max(1, n)
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / per_word,
        counts[65:91].sum() / letters,
        counts[48:58].sum() / size,
        counts[[ord(c) for c in "#*$%&|<>"]].sum() / size,
        counts[ord("!")] / per_word,
        counts[ord(".")] / per_word,
        counts[[ord(c) for c in ",;:?()\"'"]].sum() / per_word,
        counts[10] / per_word,
        counts[128:].sum() / size,
        float(-(p * np.log2(p)).sum()),
        len(set(words)) / per_word,
        sum(map(eq, words, words[1:])) / per_word,
        sum(map(_STOP_BYTES.__contains__, words)) / per_word,
        sum(len(w) == 1 for w in words) / per_word,
        1 - len(set(lines)) / max(1, len(lines)),
    ]


@dataclass
class AdditiveModel:
    """Lookup tables over bins: one for each feature, and one for each of the chosen pairs."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, k], "right")]
        if self.pairs:
            coarse = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.pair_cuts)]
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + SHRINK)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best split of a run of bins; gain 0 if there is none."""
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    gain = np.where((left_n >= LEAST_ROWS) & (n.sum() - left_n >= LEAST_ROWS), gain, 0.0)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree of depth two over the bins of one feature, as a table."""
    parts = [(0, len(g))]
    for _ in range(2):
        split = []
        for a, b in parts:
            gain, k = _best_cut(g[a:b], h[a:b], n[a:b])
            split += [(a, a + k), (a + k, b)] if gain > 1e-9 else [(a, b)]
        parts = split
    table = np.zeros(len(g))
    for a, b in parts:
        table[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return table


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a two-way table into four parts: gain over no cut, and the leaves as a table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    top, top_h, left, left_h = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    whole, whole_h = cg[-1, -1], ch[-1, -1]
    parts = [(a, b), (top - a, top_h - b), (left - a, left_h - b), (whole - top - left + a, whole_h - top_h - left_h + b)]
    gain = sum(_gain(x, y) for x, y in parts) - _gain(whole, whole_h)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    table = np.empty_like(g)
    for (x, y), rows, cols in zip(parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None)) * 2):
        table[rows, cols] = _leaf(x[i, j], y[i, j])
    return float(gain[i, j]), table


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    rate = float(y.mean()) if len(y) else 0.5
    if not len(y) or rate in (0.0, 1.0):
        return AdditiveModel(base=float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
    model = AdditiveModel(base=float(np.log(rate / (1 - rate))))
    inner = lambda bins: [np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins)) for k in range(x.shape[1])]
    model.cuts, model.pair_cuts = inner(BINS), inner(PAIR_BINS)
    bins = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(model.cuts)]
    coarse = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.cuts]
    counts = [np.bincount(b, minlength=m) for b, m in zip(bins, sizes)]
    model.tables = [np.zeros(m) for m in sizes]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _shallow_tree(np.bincount(b, g, sizes[k]), np.bincount(b, h, sizes[k]), counts[k])
            model.tables[k] += step
            total += step[b]

    shape = [len(c) + 1 for c in model.pair_cuts]

    def two_way(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        cell = coarse[i] * shape[j] + coarse[j]
        fold = lambda v: np.bincount(cell, v, shape[i] * shape[j]).reshape(shape[i], shape[j])
        return fold(g), fold(h)

    able = [k for k, m in enumerate(shape) if m > 1]
    ranked = sorted(((_cross(*two_way(i, j))[0], i, j) for i, j in combinations(able, 2)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            step = RATE * _cross(*two_way(i, j))[1]
            model.pair_tables[k] += step
            total += step[coarse[i], coarse[j]]
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Fits on at most ``max_rows`` rows that are not held out. Their numbers, not their texts, reach the driver."""
    usable = labels.where("doc_id is not null and quality is not null").where(~is_held_out(F.col("doc_id")))
    first = [F.xxhash64("doc_id"), "doc_id", "quality"]
    chosen = usable.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(*first).limit(max_rows)
    # At most max_rows rows of two numbers.
    chosen = chosen.select(F.col("doc_id").alias("labelled_id"), "quality")

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"quality": b["quality"], "id": b["labelled_id"], "content": b["content"], "x": [features(t) for t in b["text"]]})

    body = text_or_empty(F.col("text").cast("string"))
    rows = docs.select("doc_id", body.alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
    got = rows.select("labelled_id", "quality", F.xxhash64("text").alias("content"), "text").mapInPandas(of_batches, "quality int, id long, content long, x array<double>")
    # Where ids repeat there are more rows than labels; the bound holds for what is learned from.
    got = got.orderBy(F.xxhash64("id"), "id", "quality", "content").limit(max_rows).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, (got["quality"].to_numpy() == 1).astype(float))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([features(t) for t in b["text"]], float).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(x)})

    # The id travels as text, so that pandas does not turn long ids with nulls into floats.
    scored = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty(F.col("text").cast("string")).alias("text")).mapInPandas(of_batches, "doc_id string, score double")
    scored = scored.withColumn("doc_id", F.col("doc_id").cast("long"))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
