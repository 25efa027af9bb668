"""Quality classifier: a generalised additive model with pairwise interactions.

Features are rates counted over whole texts. Each is binned by quantiles of the training rows; shallow
trees, boosted over the features in turn, add up to one lookup table per feature, then trees over the
pairs with the most left to explain add one table per pair. A score is a sum of looked-up values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.measure import measure
from larder.llm.storage import cut
from larder.llm.text import slices

BINS, COARSE, PAIRS = 32, 8, 8
FEATURES = ("length", "word_length", "symbols", "dup_lines", "repeats", "distinct", "top", "stutter", "upper", "digits", "pipes", "exclaims", "stops", "commas", "line_length", "letters")


def features(m: dict[str, np.ndarray]) -> np.ndarray:
    """documents x FEATURES, all finite; texts without words have zeros."""
    per = lambda a, b: a / np.maximum(b, 1)
    letters = m["upper"] + m["lower"] + m["lead"]
    columns = (
        np.log1p(m["n_words"]), per(m["word_chars"], m["n_words"]), per(m["n_symbols"], m["word_chars"]), per(m["n_dup_lines"], m["n_lines"]),
        per(m["n_repeat_words"], m["n_words"]), per(m["n_distinct"], m["n_words"]), per(m["n_top"], m["n_words"]), per(m["n_stutter"], m["n_words"]),
        per(m["upper"], letters), per(m["digit"], m["word_chars"]), per(m["pipe"], m["n_words"]), per(m["exclaim"], m["n_words"]),
        per(m["stop"], m["n_words"]), per(m["comma"], m["n_words"]), per(m["n_words"], m["n_lines"]), per(letters, m["word_chars"]),
    )
    return np.stack(columns, axis=1).astype(float)


@dataclass
class Additive:
    """intercept + sum of tables[feature][bin] + sum of pair_tables[pair][coarse bin, coarse bin]."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pair_tables: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        fine = self.bins(x, self.edges)
        raw = np.full(len(x), self.intercept)
        for table, b in zip(self.tables, fine, strict=True):
            raw += table[b]
        if self.pair_tables:
            wide = self.bins(x, self.coarse)
            for (i, j), table in self.pair_tables.items():
                raw += table[wide[i], wide[j]]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def cut_bins(g: np.ndarray, h: np.ndarray, leaves: int) -> list[int]:
    """Bin numbers at which a greedy tree with so many leaves splits one feature's gradient sums."""
    cuts = [0, len(g)]
    gs, hs = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    while len(cuts) <= leaves:
        best = (1e-6, 0)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = np.arange(a + 1, b)
            if len(at):
                got = gain(gs[at] - gs[a], hs[at] - hs[a]) + gain(gs[b] - gs[at], hs[b] - hs[at]) - gain(gs[b] - gs[a], hs[b] - hs[a])
                best = max(best, (float(got.max()), int(at[got.argmax()])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    return cuts


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.15, leaves: int = 3) -> Additive:
    """Cyclic boosting: in every round each feature in turn gets one shallow tree; then the pairs likewise."""
    at = lambda n: [np.unique(np.quantile(x[:, j], np.arange(1, n) / n)) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = Additive(at(BINS), at(COARSE))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    share = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return model
    raw, fine, wide = np.full(len(y), model.intercept), model.bins(x, model.edges), model.bins(x, model.coarse)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            if len(table) < 2:
                continue
            g, h = (np.bincount(fine[j], v, len(table)) for v in slopes())
            cuts = cut_bins(g, h, leaves)
            step = np.zeros(len(table))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                step[a:b] = rate * g[a:b].sum() / (h[a:b].sum() + 1.0)
            table += step
            raw += step[fine[j]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        cell = wide[i] * shape[1] + wide[j]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in slopes())

    def quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """Best pair of cuts, one on each feature, and the step of each cell."""
        best, step = 0.0, np.zeros(g.shape)
        for a in range(1, g.shape[0]):
            for b in range(1, g.shape[1]):
                blocks = [(slice(0, a), slice(0, b)), (slice(0, a), slice(b, None)), (slice(a, None), slice(0, b)), (slice(a, None), slice(b, None))]
                got = sum(gain(g[k].sum(), h[k].sum()) for k in blocks)
                if got > best:
                    best, step = got, np.zeros(g.shape)
                    for k in blocks:
                        step[k] = g[k].sum() / (h[k].sum() + 1.0)
        return best, step

    ranked = sorted(((quarters(*grid(i, j))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    for _, i, j in ranked[:PAIRS]:
        model.pair_tables[i, j] = np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))
    for _ in range(rounds // 4):
        for (i, j), table in model.pair_tables.items():
            step = rate * quarters(*grid(i, j))[1]
            table += step
            raw += step[wide[i], wide[j]]
    return model


def measured(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id and one double per feature, for whole texts; null counts as empty."""
    names = ["doc_id", *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(measure(part.column("text")))
                yield pa.record_batch([part.column("doc_id"), *(pa.array(x[:, j].copy()) for j in range(x.shape[1]))], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def held_out_fold(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample: int = 30_000) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every row.

    The model learns from at most `sample` labelled rows, those with the smallest hashes of doc_id
    among rows whose crc32(doc_id) mod 3 isn't 1; a threshold on the hash, from their count, keeps the
    others on the executors. Several labels of one document count by their mean,
    ties as good; null labels don't count. Without both classes the score is the smoothed share of good.
    Null and empty texts are scored like others; repeated rows are scored each; further columns are left out;
    null ids aren't held out; empty in, empty out.
    """
    table = cut(measured(docs), "features").withColumn("held_out", held_out_fold())
    known = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    labelled = table.where(~F.col("held_out")).join(known, "doc_id").withColumn("rank", F.shiftrightunsigned(F.xxhash64("doc_id"), 24))
    share = min(1.0, (sample + 6 * sample**0.5) / max(labelled.count(), 1))  # six deviations above, so that sample rows are nearly sure to be there
    rows = labelled.where(F.col("rank") <= int(share * 2**40)).orderBy("rank", "doc_id", *FEATURES).limit(sample)
    frame = rows.select("good", *FEATURES).toPandas()
    model = fit(frame[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), frame["good"].to_numpy(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy() for f in FEATURES], axis=1)
            score = model.score(x)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return table.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
