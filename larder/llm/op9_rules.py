"""Quality rules combined by weak supervision.

Each rule votes bad (0), abstains (1) or votes good (2). Documents with the same votes are one
pattern; the counts of the patterns (at most 3 ** rules) are all that expectation-maximisation needs
to estimate each rule's vote distribution among good and bad documents. The posterior probability of
good, not the unanimity of the rules, decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.measure import measure
from larder.llm.storage import cut
from larder.llm.text import slices

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rates(m: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, float, float]]:
    """Rule -> (rate, good at or below, bad above); between them the rule abstains."""
    per = lambda a, b: a / np.maximum(b, 1)
    letters = m["upper"] + m["lower"] + m["lead"]
    return {
        "short": (-m["n_words"].astype(float), -40.0, -20.0),
        "symbols": (per(m["n_symbols"], m["word_chars"]), 0.01, 0.05),
        "repeated": (per(m["n_repeat_words"], m["n_words"]), 0.05, 0.30),
        "lines": (per(m["n_dup_lines"], m["n_lines"]), 0.05, 0.30),
        "shouting": (per(m["upper"], letters), 0.10, 0.30),
        "exclaims": (per(m["exclaim"], m["n_words"]), 0.02, 0.20),
        "stutter": (per(m["n_stutter"], m["n_words"]), 0.02, 0.15),
        "tables": (per(m["pipe"], m["n_words"]), 0.01, 0.20),
        "letters": (1 - per(letters, m["word_chars"]), 0.10, 0.20),
        "top": (per(m["n_top"], m["n_words"]), 0.15, 0.30),
    }


RULES = ("short", "symbols", "repeated", "lines", "shouting", "exclaims", "stutter", "tables", "letters", "top")


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """Pattern number of each document: its votes as base-3 digits, first rule first. Rates without a word abstain."""
    code = np.zeros(len(m["n_words"]), np.int64)
    for name, (rate, good, bad) in rates(m).items():
        vote = np.where(rate > bad, 0, np.where(rate <= good, 2, 1))
        if name != "short":
            vote = np.where(m["n_words"] == 0, 1, vote)
        code = code * 3 + vote
    return code


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def posteriors(counts: dict[int, int], rules: int = len(RULES), rounds: int = 200, trust: float = 0.5) -> dict[int, float]:
    """Probability of good for each vote pattern, by expectation-maximisation over the pattern counts.

    Bad starts as "some rule votes bad". The prior holds that a rule is better than chance: trust times
    its bad votes count as seen among bad documents before any is; half a document per vote smooths
    small tables. The class in which bad votes are rarer is the good one.
    """
    if not counts:
        return {}
    codes = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(c)] for c in codes], float)
    digits = (codes[:, None] // 3 ** np.arange(rules - 1, -1, -1)) % 3
    onehot = digits[:, :, None] == np.arange(3)
    good = np.where((digits == 0).any(axis=1), 0.02, 0.98)
    trusted = np.zeros((rules, 3))
    trusted[:, 0] = trust * (n[:, None] * onehot[:, :, 0]).sum(axis=0)
    for _ in range(rounds):
        logs = []
        for weight, prior_votes in ((good * n, 0), ((1 - good) * n, trusted)):
            seen = (weight[:, None, None] * onehot).sum(axis=0) + 0.5 + prior_votes
            logs.append(np.log(seen / seen.sum(axis=1, keepdims=True)))
        prior = (good * n).sum() + 1, ((1 - good) * n).sum() + 1
        odds = np.log(prior[0] / prior[1]) + (onehot * (logs[0] - logs[1])).sum(axis=(1, 2))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    bad_votes = lambda p: ((digits == 0).sum(axis=1) * p * n).sum() / max((p * n).sum(), 1e-9)
    if bad_votes(good) > bad_votes(1 - good):
        good = 1 - good
    return dict(zip(codes.tolist(), good.tolist(), strict=True))


def estimate(patterns: DataFrame) -> dict[int, float]:
    """posteriors of a table with a column pattern; its counts are at most 3 ** rules rows."""
    return posteriors({r["pattern"]: r["n"] for r in patterns.groupBy("pattern").agg(F.count("*").alias("n")).collect()})


def score(docs: DataFrame, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """key, BASE, base_failed, pattern, posterior, kept of every row.

    Null text is empty (no words: base_failed). Repeated rows are scored each; null keys stay; an empty
    table gives none; ties of the posterior at the threshold are kept; further columns are left out.
    """
    types = [("doc_id", pa.int64()), *((c, pa.int64()) for c in BASE), ("base_failed", pa.bool_()), ("pattern", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                m = measure(part.column("text"))
                columns = [part.column("doc_id"), *(m[c] for c in BASE), base_failed(m), votes(m)]
                yield pa.record_batch([pa.array(c, t) if isinstance(c, np.ndarray) else c for c, (_, t) in zip(columns, types, strict=True)], names=[k for k, _ in types])

    ddl = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, pattern long"
    measured = cut(docs.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(run, ddl), "votes")
    known = sorted(estimate(measured).items())
    table = docs.sparkSession.createDataFrame(known or [(0, 0.0)], "pattern long, posterior double")
    return measured.join(F.broadcast(table), "pattern").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, that score() keeps. docs needs a column text.

    Null and empty texts fail the base rules and go; repeated rows are judged each; empty in, empty out.
    The texts are measured once, and written with their votes until the posteriors are known.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"c{docs_text}"):
                m = measure(part.column(f"c{docs_text}"))
                fine = ~base_failed(m)
                codes = votes(m)
                yield pa.record_batch([*(c.filter(pa.array(fine)) for c in part.columns), pa.array(codes[fine]), pa.array(np.ones(fine.sum(), np.int64))], names=[*names, "pattern", "n"])
                failed, n = np.unique(codes[~fine], return_counts=True)
                yield pa.record_batch([*(pa.nulls(len(n), c.type) for c in part.columns), pa.array(failed), pa.array(-n)], names=[*names, "pattern", "n"])

    docs_text = docs.columns.index("text")
    plain = docs.toDF(*names)
    schema = ", ".join(f"{name} {kind}" for name, kind in plain.dtypes) + ", pattern long, n long"
    # n: 1 for a row that passes the base rules; else minus the number of rows that don't, which only count
    held = cut(plain.mapInArrow(measured, schema), "voted")
    counts = {r["pattern"]: r["n"] for r in held.groupBy("pattern").agg(F.sum(F.abs("n")).alias("n")).collect()}
    good = [c for c, p in posteriors(counts).items() if p >= threshold]
    table = docs.sparkSession.createDataFrame([(c,) for c in good], "good long")
    return held.where("n > 0").join(F.broadcast(table), F.col("pattern") == F.col("good"), "left_semi").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
