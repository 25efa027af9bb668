"""Packing by column generation for the cutting-stock problem.

Documents become token ids and are cut into pieces of at most one sequence. The histogram of piece
lengths, in units of a few tokens, is the demand of a cutting-stock linear program; a knapsack by
dynamic programming prices new patterns; the rounded-down pattern counts plus a first-fit-decreasing
plan for what they leave cover the histogram exactly. Pieces, ranked inside their length class, find
their sequence in the plan by rank alone, so the assignment is one pass over the pieces.
Only the histogram (at most capacity / unit rows) comes to the driver.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.storage import cut

UNIT = 8
END_ID = 1
#: Words a Python worker remembers; longer words and words beyond this are encoded each time.
KEPT_WORDS, KEPT_BYTES = 600_000, 48
_coders: dict[str, WordCoder] = {}


class WordCoder:
    """Ids of a text as little-endian uint32 bytes, by a tokenizers file that drops white space.

    Text between ASCII white space is encoded by itself, ASCII letters lowered first; both leave the
    ids of this kind of vocabulary (lower case, words end at white space) as they are. Only added tokens
    are matched in their own case: a text that holds one in any case isn't lowered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[bytes, bytes] = {b"": b""}
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, word: bytes) -> bytes:
        if word.isascii() and word.isalpha():
            ids = [t.id for t in self.tokenizer.model.tokenize(word.decode().lower())]
        else:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def word(self, word: bytes) -> bytes:
        if (found := self.kept.get(word)) is not None:
            return found
        core = word.rstrip(b",.!?;:#$%&*|")
        if len(core) < len(word) and core and core[-1:].isalpha():  # letters end before punctuation
            out = self.word(core) + self.word(word[len(core) :])
        else:
            out = self._encode(word)
        if len(word) <= KEPT_BYTES:
            if len(self.kept) >= KEPT_WORDS:
                self.kept = {b"": b""}
            self.kept[word] = out
        return out

    def text(self, text: str) -> bytes:
        raw = text.encode()
        low = raw.lower()
        parts = (raw if any(a in low for a in self.added) else low).translate(_ONE_SPACE).split(b" ")
        kept = self.kept
        try:
            return b"".join([kept[w] for w in parts])
        except KeyError:
            return b"".join([self.word(w) for w in parts])


_ONE_SPACE = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


# ---- the plan, on the driver: a few hundred lengths, no documents ----


def best_pattern(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: counts of the lengths that fit into capacity with the greatest value."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fit = np.flatnonzero(lengths <= c)
        if len(fit):
            got = values[fit] + best[c - lengths[fit]]
            k = int(np.argmax(got))
            if got[k] > best[c] + 1e-12:
                best[c], choice[c] = got[k], fit[k]
    counts, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= lengths[choice[c]]
    return float(best[capacity]), counts


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and fractional uses of min sum(x), patterns @ x = demand, x >= 0.

    Revised simplex from one-length patterns; it ends when the knapsack prices no pattern above 1.
    """
    basis = np.diag(capacity // lengths).astype(float)
    inverse, x = np.diag(1.0 / (capacity // lengths)), demand / (capacity // lengths)
    for _ in range(rounds):
        price, column = best_pattern(inverse.sum(axis=0), lengths, capacity)
        if price <= 1 + 1e-7:
            break
        direction = inverse @ column
        rows = np.flatnonzero(direction > 1e-9)
        ratios = x[rows] / direction[rows]
        leave = rows[np.argmin(ratios)]
        step = ratios.min()
        x = np.maximum(x - step * direction, 0)
        x[leave] = step
        basis[:, leave] = column
        inverse[leave] /= direction[leave]
        others = np.arange(len(x)) != leave
        inverse[others] -= np.outer(direction[others], inverse[leave])
    return basis.astype(np.int64), x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length, number of sequences) rows that use up the histogram exactly."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(n)] for n in lengths], np.int64)
    patterns, x = solve(lengths, demand.astype(float), capacity)
    rows, left = [], demand.copy()
    for k in np.argsort(-x, kind="stable"):
        uses = int(x[k] + 1e-6)
        used = patterns[:, k]
        if uses and (had := used > 0).any():
            uses = min(uses, int((left[had] // used[had]).min()))
            if uses:
                rows.append(({int(n): int(c) for n, c in zip(lengths[had], used[had], strict=True)}, uses))
                left -= uses * used
    while left.any():  # what rounding left: the longest first, each sequence filled from what remains
        room, taken = capacity, {}
        for i in range(len(lengths) - 1, -1, -1):
            if n := min(int(left[i]), room // int(lengths[i])):
                taken[int(lengths[i])] = n
                room -= n * int(lengths[i])
        times = min(int(left[lengths == n][0]) // c for n, c in taken.items())
        rows.append((taken, times))
        for n, c in taken.items():
            left[lengths == n] -= c * times
    return rows


# ---- the pieces, on the executors ----


def pieces(docs: DataFrame, tokenizer: str, capacity: int, key: str, keep_ids: bool) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    if keep_ids:
        schema = schema.append(pa.field("ids", pa.binary()))
    width, end = 4 * capacity, np.array([END_ID], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = [[] for _ in schema]
                for doc, text in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    ids = code.text(text or "") + end
                    for at in range(0, len(ids), width):
                        part = ids[at : at + width]
                        for column, value in zip(out, (doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part), strict=False):
                            column.append(value)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text")).mapInArrow(encode, ddl)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its ids and END_ID, cut only at multiples of capacity. Pieces of a sequence lie
    without gaps from offset 0; sequence_id runs from 0. Null and empty texts are one END_ID; repeated
    rows are packed each; null keys stay null; an empty table gives none; further columns are left out.
    """
    spark = docs.sparkSession
    made = cut(
        pieces(docs, tokenizer, capacity, key, keep_ids).withColumns({"units": F.ceil(F.col("length") / UNIT).cast("int"), "place": F.monotonically_increasing_id()}), "pieces"
    )
    histogram = {r["units"]: r["n"] for r in made.groupBy("units").agg(F.count("*").alias("n")).collect()}
    rows = plan(histogram, -(-capacity // UNIT))

    # Place of each rank: for every class, the first rank, sequence and number per sequence of each plan row.
    places: dict[int, list[tuple[int, int, int]]] = {n: [] for n in histogram}
    rank, sequence = dict.fromkeys(histogram, 0), 0
    for taken, times in rows:
        for n, c in taken.items():
            places[n].append((rank[n], sequence, c))
            rank[n] += c * times
        sequence += times
    table = {n: np.array(v, np.int64).T for n, v in places.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("units", "rank"))
            out = np.zeros(len(units), np.int64)
            for n in np.unique(units):
                own = units == n
                first, base, each = table[int(n)]
                k = np.searchsorted(first, ranks[own], "right") - 1
                out[own] = base[k] + (ranks[own] - first[k]) // each[k]
            yield batch.append_column("sequence_id", pa.array(out))

    runs = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), max(histogram.values(), default=0) // 50_000)
    runned = made.withColumn("run", F.pmod(F.xxhash64("place"), F.lit(runs)).cast("int"))
    before = Window.partitionBy("units").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = runned.groupBy("units", "run").agg(F.count("*").alias("n")).select("units", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("units", "run").orderBy("place")
    ranked = runned.join(base, ["units", "run"]).withColumn("rank", F.col("base") + F.row_number().over(own) - 1).drop("base", "run", "place")
    ddl = ", ".join(f"{name} {kind}" for name, kind in ranked.dtypes) + ", sequence_id long"
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("units"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.mapInArrow(assign, ddl).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("units", "rank")
