"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles, one feature at a time, and add up to one
lookup table for each feature; then the pairs of features that explain most of
what is left get tables of two dimensions, boosted the same way. A score is
the logistic of the sum of a document's table entries, so scoring is a bin
search and an addition for each table, over whole batches.

The model is fitted on the driver, on a sample of labelled rows whose size is
a parameter; features are computed where the documents are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import bound_batches

FEATURES = (
    "log_words", "word_bytes", "upper", "symbols", "bars", "digits", "exclamations", "stops",
    "distinct", "top_word", "adjacent", "repeated_windows", "repeated_lines", "words_a_line", "beyond_ascii",
)


def features(raw: bytes | None) -> list[float]:
    """The features of one UTF-8 text; of a wordless one, zeros."""
    words = (raw or b"").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, upper = c[97:123].sum() + c[65:91].sum(), c[65:91].sum()
    wide = c[192:].sum()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    in_words = sum(map(len, words))
    return [
        float(np.log1p(n)),
        in_words / n,
        upper / max(1, letters),
        sum(int(c[x]) for x in b"#*$%&<>") / n,
        c[ord("|")] / n,
        c[48:58].sum() / max(1, in_words),
        c[ord("!")] / n,
        (c[ord(".")] + c[ord(",")]) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(windows)) / max(1, len(windows)),
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        wide / max(1, letters + wide),
    ]


@dataclass
class Additive:
    """bias + sum of tables[f][bin of f] + sum of pair tables."""

    edges: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, f], "right")]
        for i, j, ei, ej, t in self.pairs:
            total += t[np.searchsorted(ei, x[:, i], "right"), np.searchsorted(ej, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n - 1 inner edges at quantiles."""
    return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0)


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A tree over neighbouring bins: the value of each bin."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    out = np.full(len(g), _leaf(cg[-1], ch[-1]))
    if depth == 0 or len(g) < 2:
        return out
    gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
    at = int(np.argmax(gains)) + 1
    if gains[at - 1] <= _gain(cg[-1], ch[-1]) + 1e-9:
        return out
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of a grid into four parts: the value of each cell, and the gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best = np.zeros(g.shape), -1.0
    if min(g.shape) < 2:
        return best
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    right_g, right_h = cg[:-1, -1:] - a, ch[:-1, -1:] - b
    low_g, low_h = cg[-1:, :-1] - a, ch[-1:, :-1] - b
    rest_g, rest_h = cg[-1, -1] - a - right_g - low_g, ch[-1, -1] - b - right_h - low_h
    gains = _gain(a, b) + _gain(right_g, right_h) + _gain(low_g, low_h) + _gain(rest_g, rest_h)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :] = _leaf(a[i, j], b[i, j]), _leaf(right_g[i, j], right_h[i, j])
    out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = _leaf(low_g[i, j], low_h[i, j]), _leaf(rest_g[i, j], rest_h[i, j])
    return out, float(gains[i, j])


def fit(x: np.ndarray, y: np.ndarray, cycles: int = 120, pair_cycles: int = 40, rate: float = 0.15, bins: int = 48, pair_bins: int = 8, n_pairs: int = 6) -> Additive:
    """Fits the model. Without rows, or with one class alone, it says that class's share, 0.5 without rows."""
    edges = [_cuts(x[:, f], bins) for f in range(x.shape[1])]
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Additive(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges])
    if len(y) == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    total = np.full(len(y), model.bias)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(cycles):
        for f, b in enumerate(at):
            g, h = residuals()
            n = len(model.tables[f])
            step = rate * _tree(np.bincount(b, g, n), np.bincount(b, h, n), 2)
            model.tables[f] += step
            total += step[b]
    coarse = [_cuts(x[:, f], pair_bins) for f in range(x.shape[1])]
    low = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        ni, nj = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(low[i] * nj + low[j], v, ni * nj).reshape(ni, nj)

    g, h = residuals()
    ranked = sorted(((-_quarters(grid(i, j, g), grid(i, j, h))[1], i, j) for i, j in combinations(range(x.shape[1]), 2)))
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in ranked[:n_pairs]]
    for _ in range(pair_cycles):
        for i, j, _, _, t in model.pairs:
            g, h = residuals()
            step = rate * _quarters(grid(i, j, g), grid(i, j, h))[0]
            t += step
            total += step[low[i], low[j]]
    return model


def held_out(id_: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, mod 5, is 0. False for null ids."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", **settings: float) -> Additive:
    """Fits on labelled documents that aren't held out.

    At most ``sample_rows`` labels are used, those of the smallest id hashes,
    and at most as many labelled rows where ids repeat; so the ids that are
    broadcast, and the features that come to the driver, are bounded. Labels
    other than 0 and 1, and ids without a document, are passed over; a document
    or label that repeats counts each time. Null and wordless texts have
    features of zero. Other columns are ignored, whatever their names. Without
    labelled rows the model says 0.5.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y")).orderBy(F.xxhash64("_id"), "_id", "y").limit(sample_rows)
    # at most sample_rows rows of two numbers are broadcast
    rows = bound_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["_id", "y", "x"])

    kind = rows.schema[0].dataType.simpleString()
    made = rows.mapInArrow(run, f"_id {kind}, y double, x array<double>")
    made = made.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("y", "x")).limit(sample_rows)
    got = sorted(((r["_id"], r["y"], list(r["x"])) for r in made.collect()), key=lambda r: (str(r[0]), r[1], r[2]))
    x = np.array([r[2] for r in got]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in got]), **settings)


def scorer(model: Additive):
    """A vectorised function of a binary text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(None if t is None else bytes(t)) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return score


def score_quality(docs: DataFrame, model: Additive, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of each row, by its whole text alone.

    Null and wordless texts have the score of all-zero features. Ids may be
    null (not held out) or repeat. Other columns are ignored, whatever their
    names; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], [id_col, "score"])

    slim = bound_batches(docs).select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    scored = slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, score double")
    return scored.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Additive, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is under the threshold, all columns kept, whatever their names.

    Null and wordless texts have the score of all-zero features; ids don't
    matter, rows that repeat are all kept or all dropped. An empty table gives
    an empty one.
    """
    return bound_batches(docs).where(scorer(model)(F.col(text_col).cast("binary")) >= threshold)
