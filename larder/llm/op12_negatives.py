"""Hard negatives by exact inner products: a PCA rotation orders the components, bounds discard early, integers decide.

Vectors become integers. A rotation turns most of the length of the vectors into the leading components, so a
few of them give an inner product up to the product of the residual norms (Cauchy and Schwarz) and a slack for
rounding. A pair of rows whose upper bound can't reach what is surely there is dropped before the next
components are added; what is left is decided by integer products. The rotation changes cost, never results.

Anchors meet rows in pairs of blocks, a stated query set against all rows: first the rows of their own label,
for the positives, then all rows, for the negatives between the limits that the positives set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.storage import cut

#: Components of the rows and of the anchors of a block (vectors count as 16 at least), anchors of a tile, shares of the components after which candidates are dropped, and candidates multiplied at once.
ROWS, ANCHORS, TILE, STEPS, AT_ONCE = 1 << 20, 1 << 18, 64, (0.25, 0.5, 0.75, 1.0), 1 << 16
#: Above this many vectors of one length, a rotation is fitted; its matrix has length * length doubles.
LEAST_FITTED, LONGEST_FITTED = 64, 1024
KEYS = ["dim", "slice", "low", "high"]


def scaled(scale: int):
    """key, label, vector -> those that take part, with dim and the components floor(scale * x) as int64 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims = [], []
            for label, v in zip(batch.column("label").to_pylist(), batch.column("vector"), strict=True):
                x = None
                if label is not None and v.is_valid and v.values.null_count == 0:
                    x = np.floor(scale * np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64))
                    x = x if np.isfinite(x).all() and x @ x < 2.0**56 else None
                out.append(None if x is None else x.astype(np.int64).tobytes())
                dims.append(0 if x is None else len(x))
            columns = [batch.column(c) for c in ("vec_id", "label", "anchor", "place")]
            made = pa.record_batch([*columns, pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "label", "anchor", "place", "dim", "vector"])
            yield made.filter(made.column("vector").is_valid())

    return run


def integers(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), dim)


def moments(dim: int):
    """vector -> for each batch its sums of products of components, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.int64).reshape(-1, dim).astype(np.float64)
            total += x.T @ x
        yield pa.record_batch([pa.array(np.repeat(np.arange(dim), dim), pa.int32()), pa.array(np.tile(np.arange(dim), dim), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    return run


def fitted(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The rotation of the commonest length, from the second moments of all its vectors; other lengths keep their axes."""
    common = vectors.groupBy("dim").count().where(F.col("dim").between(2, LONGEST_FITTED) & (F.col("count") >= LEAST_FITTED)).orderBy(F.desc("count"), "dim").first()
    if common is None:
        return {}
    dim = common["dim"]
    sums = vectors.where(F.col("dim") == dim).select("vector").mapInArrow(moments(dim), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    square = np.zeros((dim, dim))
    square[sums["i"], sums["j"]] = sums["s"]
    return {dim: np.linalg.eigh(square)[1][:, ::-1]}


class Bounds:
    """Rotated vectors, the norms of what follows each step, and the slack of rounding for a pair."""

    def __init__(self, x: np.ndarray, rotation: np.ndarray | None):
        self.x = x
        dim = x.shape[1]
        y = x.astype(np.float64)
        self.y = y if rotation is None else y @ rotation
        self.norm = np.sqrt(np.einsum("ij,ij->i", y, y))
        squares = np.cumsum(self.y[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.steps = sorted({max(1, round(dim * s)) for s in STEPS}) if dim else []
        self.rest = [np.sqrt(squares[:, s]) if s < dim else np.zeros(len(x)) for s in self.steps]
        off = 0.0 if rotation is None else float(np.abs(rotation.T @ rotation - np.eye(dim)).sum())
        self.slack = off + 8 * (dim + 8) ** 1.5 * 2.0**-52


def products(a: Bounds, b: Bounds, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The integer products of pairs of rows."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        out[part] = np.einsum("ij,ij->i", a.x[i[part]], b.x[j[part]])
    return out


def best(scores: np.ndarray, ids: np.ndarray, owners: np.ndarray, most: int) -> np.ndarray:
    """Places of each owner's first `most`: higher scores, then smaller ids."""
    order = np.lexsort((ids, -scores, owners))
    own = owners[order]
    start = np.maximum.accumulate(np.where(np.concatenate(([True], own[1:] != own[:-1])), np.arange(len(own)), 0)) if len(own) else own
    return order[np.arange(len(own)) - start < most]


def tiles(a: Bounds, b: Bounds, allowed, keep) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each tile of anchors: pairs (i, j) that `keep` can't drop by their bounds, and their integer products.

    allowed(anchors) says which pairs count at all; keep(anchors, low, high, alive) drops pairs by bounds.
    """
    for at in range(0, len(a.x), TILE):
        rows = np.arange(at, min(at + TILE, len(a.x)))
        alive = allowed(rows)
        slack = a.slack * np.outer(a.norm[rows], b.norm) + 1e-6
        got, done = np.zeros(alive.shape), 0
        for step, upto in enumerate(a.steps):
            got += a.y[rows, done:upto] @ b.y[:, done:upto].T
            done = upto
            reach = np.outer(a.rest[step][rows], b.rest[step]) * (1 + 1e-9) + slack
            alive = keep(rows, got - reach, got + reach, alive)
            if not alive.any():
                break
        i, j = np.nonzero(alive)
        yield rows[i], j, products(a, b, rows[i], j)


def at_least(values: np.ndarray, most: int) -> np.ndarray:
    """Of each row, the most-th largest value; -inf where there are fewer."""
    if values.shape[1] < most:
        return np.full(len(values), -np.inf)
    return -np.partition(-values, most - 1, axis=1)[:, most - 1]


def positives_of(rotations: dict[int, np.ndarray], most: int):
    """Rows and anchors of a pair of blocks of one label -> each anchor's first `most` of these rows."""

    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        b, a = (Bounds(integers(t.column("vector"), dim), rotations.get(dim)) for t in (rows, anchors))
        places, own = rows.column("place").to_numpy(), anchors.column("place").to_numpy()
        ids, out = rows.column("vec_id").to_numpy(), []

        def allowed(i: np.ndarray) -> np.ndarray:
            return own[i][:, None] != places[None, :]

        def keep(i: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
            sure = at_least(np.where(alive, low, -np.inf), most)
            return alive & (high >= sure[:, None])

        for i, j, score in tiles(a, b, allowed, keep):
            first = best(score, ids[j], i, most)
            out.append(pa.table({"anchor": own[i[first]], "positive_id": ids[j[first]], "positive_score": score[first]}))
        return pa.concat_tables(out)

    return run


def negatives_of(rotations: dict[int, np.ndarray], most: int, percent: int):
    """Rows and anchors (with their positives' scores) of a pair of blocks -> for each positive the first `most` rows of other labels inside its limits."""

    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        b, a = (Bounds(integers(t.column("vector"), dim), rotations.get(dim)) for t in (rows, anchors))
        labels, own_labels = rows.column("label").to_numpy(), anchors.column("label").to_numpy()
        ids, own = rows.column("vec_id").to_numpy(), anchors.column("place").to_numpy()
        lists = [np.unique(np.array(s, np.int64)) for s in anchors.column("scores").to_pylist()]
        top = np.array([s[-1] for s in lists], np.float64)
        least = np.array([s[0] for s in lists], np.float64) * percent / 100
        out = []

        def allowed(i: np.ndarray) -> np.ndarray:
            return own_labels[i][:, None] != labels[None, :]

        def keep(i: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
            alive = alive & (high >= least[i][:, None]) & (low <= top[i][:, None])
            for k, at in enumerate(i):  # what is left of an anchor: is it surely behind `most` others for each positive?
                left = np.flatnonzero(alive[k])
                if len(left) > most:
                    lo, hi, wanted = low[k, left], high[k, left], np.zeros(len(left), bool)
                    for score in lists[at]:
                        inside = np.sort(lo[hi <= score])
                        sure = max(inside[-most] if len(inside) >= most else -np.inf, score * (percent / 100) - 1)
                        wanted |= (lo <= score) & (hi >= sure)
                    alive[k, left] = wanted
            return alive

        for i, j, score in tiles(a, b, allowed, keep):
            for rank in range(max(map(len, lists), default=0)):
                limit = np.array([s[rank] if rank < len(s) else -1 for s in lists], np.int64)[i]
                has = np.array([rank < len(s) for s in lists])[i]
                fit = np.flatnonzero(has & (percent * limit <= 100 * score) & (score <= limit))
                first = fit[best(score[fit], ids[j[fit]], i[fit], most)]
                out.append(pa.table({"anchor": own[i[first]], "positive_score": limit[first], "negative_id": ids[j[first]], "negative_score": score[first]}))
        return pa.concat_tables(out)

    return run


def ranked(df: DataFrame, keys: list[str], score: str, id_: str, most: int, name: str) -> DataFrame:
    """The first `most` rows of each key, numbered: Spark cuts to them before the shuffle too."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), id_))).where(F.col(name) <= most)


def grid(rows: DataFrame, anchors: DataFrame, slices: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to blocks of each (dim, slice) and repeated for every block of the other side: KEYS name a pair of blocks."""
    rows, anchors = rows.withColumn("slice", slices), anchors.withColumn("slice", slices)
    size = rows.groupBy("dim", "slice").agg(F.ceil(F.count("*") * F.greatest("dim", F.lit(16)) / ROWS).cast("int").alias("row_blocks"))
    of = anchors.groupBy("dim", "slice").agg(F.ceil(F.count("*") * F.greatest("dim", F.lit(16)) / ANCHORS).cast("int").alias("anchor_blocks"))
    size = cut(size.join(of, ["dim", "slice"]), "blocks")
    own = lambda n: F.pmod(F.xxhash64("place"), F.col(n)).cast("int")
    left = rows.join(size, ["dim", "slice"]).withColumn("low", own("row_blocks")).withColumn("high", F.explode(F.sequence(F.lit(0), F.col("anchor_blocks") - 1)))
    right = anchors.join(size, ["dim", "slice"]).withColumn("high", own("anchor_blocks")).withColumn("low", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)))
    return left.drop("row_blocks", "anchor_blocks"), right.drop("row_blocks", "anchor_blocks")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    Every component x counts as floor(scale * x), a row's score is its integer inner product with the anchor;
    higher scores come first, then smaller keys. An anchor's positives are its first other rows of the same
    label; each has the first rows of other labels with percent% of its score <= score <= its score.

    Rows without label or vector, or with a null or non-finite component, take no part, nor do vectors whose
    scaled squared norm reaches 2^56, as their products need not fit a long. Only vectors of one length are
    compared; empty ones score 0 with each other. Repeated rows are rows of their own, anchors too, so equal
    result rows may repeat; null keys come first among equal scores. An empty table gives an empty result;
    further columns are left out.
    """
    slim = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("place"), F.col(vector).alias("vector"))
    rows = cut(slim.mapInArrow(scaled(scale), "vec_id long, label long, anchor boolean, place long, dim int, vector binary"), "vectors")
    rotations = fitted(rows)
    anchors = cut(rows.where("anchor").select("vec_id", "label", "place", "dim", "vector"), "anchors")
    some = rows.select("vec_id", "label", "place", "dim", "vector")

    left, right = grid(some, anchors, F.col("label"))
    near = left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInArrow(skipping(positives_of(rotations, positives), POSITIVE), POSITIVE)
    near = cut(ranked(near, ["anchor"], "positive_score", "positive_id", positives, "positive_rank"), "positives")

    wanted = near.groupBy("anchor").agg(F.collect_set("positive_score").alias("scores")).withColumnRenamed("anchor", "place")
    left, right = grid(some, anchors.join(wanted, "place"), F.lit(0))
    far = left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInArrow(skipping(negatives_of(rotations, negatives, percent), NEGATIVE), NEGATIVE)
    far = ranked(far, ["anchor", "positive_score"], "negative_score", "negative_id", negatives, "rank")
    named = anchors.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return near.join(far, ["anchor", "positive_score"]).join(named, "anchor").select("anchor_id", "positive_id", "positive_rank", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


POSITIVE = "anchor long, positive_id long, positive_score long"
NEGATIVE = "anchor long, positive_score long, negative_id long, negative_score long"


def skipping(work, schema: str):
    """work on pairs of blocks that have both sides; nothing from the others."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        none = pa.table({n: pa.array([], pa.int64()) for n in names})
        return work(key, rows, anchors).select(names) if rows.num_rows and anchors.num_rows else none

    return run
