"""Near-duplicate vectors by sorted projection passes, counted exactly inside what they unite, and audited.

A pass orders the vectors of a label lexicographically by concatenated random hashes: the signs of random
projections, taken around the label's mean, so that a label of one topic is spread too. Neighbours in that
order are compared in bounded windows; the pairs that link are united across all passes, of which a larger
label gets more. Batches of passes go on until QUIET of them in a row unite nothing new among all vectors.
Inside each component found, every pair is then counted in pairs of blocks.

An audit compares a sample of each label's vectors with the whole label. Where the passes found under LEAST
of the sample's links, every pair of the label is compared in pairs of blocks instead. Exact copies are one
class with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.components import connected_components, smallest_names
from larder.llm.storage import cut

#: Passes of a label of up to MANY vectors, and more for each doubling above; vectors of a window, windows held at once.
PASSES, MORE, MANY, WINDOW, HELD = 16, 2, 4096, 64, 64
#: Batches of passes in a row that unite nothing new before passes end.
QUIET = 2
#: Sampled vectors of a label, and the share of their links that passes have to find.
AUDIT, LEAST = 256, 0.995
PARTITION_BYTES = 16 << 20
BLOCK = 1024
TILE = 1024
#: Multiplications of a task.
PART_PRODUCTS = 2 << 30


def usable(kind: type):
    """vec_id, label, embedding -> with its bytes as numbers of a kind; null where the vector or its label can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, v in zip(batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
                ok = label is not None and v.is_valid and v.values.null_count == 0
                a = np.asarray(v.values.to_numpy(zero_copy_only=False), kind) if ok else np.zeros(0)
                out.append(a.tobytes() if np.isfinite(a).all() and a.any() else None)
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "vector"])

    return run


def matrix(raw: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    whole = raw.to_pylist()
    return np.frombuffer(b"".join(whole), kind).reshape(len(whole), -1).astype(np.float64)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Edges of the runs of equal rows."""
    keys = np.stack(columns)
    return np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [keys.shape[1]]))


def partial_sums(kind: type):
    """label, dim, vector -> for each batch the sum of each label's vectors, each by its length, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
            for label, dim, raw in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "vector")), strict=True):
                v = np.frombuffer(raw, kind).astype(np.float64)
                n, total = out.get((label, dim), (0, 0.0))
                out[label, dim] = n + 1, total + v / np.sqrt(v @ v)
            yield pa.record_batch([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int32()), pa.array([n for n, _ in out.values()], pa.int64()), pa.array([t.tobytes() for _, t in out.values()], pa.binary())], names=["label", "dim", "rows", "sum"])

    return run


def mean(table: pa.Table) -> pa.Table:
    """partial_sums of one label and length -> its number of vectors and their mean."""
    n = sum(table.column("rows").to_pylist())
    total = np.sum([np.frombuffer(raw, np.float64) for raw in table.column("sum").to_pylist()], axis=0)
    return pa.table([table.column("label").slice(0, 1), table.column("dim").slice(0, 1), pa.array([n]), pa.array([(total / n).tobytes()], pa.binary())], names=["label", "dim", "rows", "mean"])


def keyed(kind: type, turn: int):
    """vertex, label, dim, vector, mean, rows -> for each pass a row with its sort key: the signs of 64 projections, the first most significant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "dim", "pass", "key", "vertex", "vector"]
        for batch in batches:
            dims, rows = batch.column("dim").to_numpy(), batch.column("rows").to_numpy()
            deep = np.maximum(0, np.ceil(np.log2(rows / MANY))).astype(np.int64)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(own))
                x = matrix(part.column("vector"), kind)
                x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] - matrix(part.column("mean"), np.float64)
                for number in range(PASSES + MORE * int(deep[own].max())):
                    again = np.flatnonzero(number < PASSES + MORE * deep[own])
                    planes = np.random.default_rng([number, int(dim), turn]).standard_normal((64, int(dim)))
                    keys = np.packbits(x[again] @ planes.T > 0, axis=1).view(">u8").ravel().astype(np.uint64)
                    some = part.take(pa.array(again))
                    columns = [some.column("label"), some.column("dim"), pa.array(np.full(len(again), number, np.int32)), pa.array((keys ^ np.uint64(1 << 63)).view(np.int64)), some.column("vertex"), some.column("vector")]
                    yield pa.record_batch(columns, names=names)

    return run


def neighbours(threshold: float, kind: type):
    """Rows sorted by (label, dim, pass, key) -> stars (a, b) of the links inside the windows.

    The rows of a pass are cut into windows of WINDOW; each is compared with itself and the next. HELD
    windows are in memory at once. A window doesn't reach over the end of a partition, a place that differs
    from pass to pass.
    """

    def stars(table: pa.Table) -> pa.RecordBatch:
        ids, x = table.column("vertex").to_numpy(), matrix(table.column("vector"), kind)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        windows = -(-len(x) // WINDOW)
        x = np.concatenate([x, np.zeros((windows * WINDOW - len(x), x.shape[1]))]).reshape(windows, WINDOW, -1)
        root = np.arange(windows * WINDOW)
        for at, other in ((x, x), (x[:-1], x[1:])):
            w, i, j = np.nonzero(at @ other.transpose(0, 2, 1) >= threshold)
            left, right = w * WINDOW + i, (w + (other is not at)) * WINDOW + j
            unite(root, left[left < right], right[left < right])
        leaf = np.flatnonzero(root[: len(ids)] != np.arange(len(ids)))
        return pa.record_batch([pa.array(ids[root[leaf]]), pa.array(ids[leaf])], names=["a", "b"])

    return by_key(["label", "dim", "pass"], stars, HELD * WINDOW, WINDOW)


def by_key(keys: list[str], work, most: int = 0, again: int = 0):
    """Runs work over the rows of each key of sorted batches, one key at a time.

    With `most`, a key's rows go in portions of about so many, each beginning with the last `again` rows of the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in keys]
            edges = runs(*columns)
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(c[start] for c in columns)
                if held and now != key:
                    yield work(pa.Table.from_batches(held))
                    held = []
                key = now
                for at in range(start, end, most or end - start):
                    held.append(batch.slice(at, min(end - at, most or end - at)))
                    if most and sum(b.num_rows for b in held) >= most:
                        table = pa.Table.from_batches(held)
                        yield work(table)
                        held = table.slice(table.num_rows - again).combine_chunks().to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    return run


PAIR = ["label", "dim", "part", "low", "high"]


def compared(threshold: float, kind: type):
    """Rows sorted by PAIR -> (vertex, star, around) of the vectors that link between the blocks low and high.

    `around` counts the rows of the other block, or of the own one, that link; `star` names one vector of
    those that the links of this pair of blocks connect.
    """

    def pair(table: pa.Table) -> pa.RecordBatch:
        ids, n, block = (table.column(c).to_numpy() for c in ("vertex", "n", "block"))
        low, high = (table.column(c)[0].as_py() for c in ("low", "high"))
        x = matrix(table.column("vector"), kind)
        norms, around, root = np.sqrt(np.einsum("ij,ij->i", x, x)), np.zeros(len(ids), np.int64), np.arange(len(ids))
        first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for i in range(0, len(first), TILE):
            for j in range(i if low == high else 0, len(second), TILE):
                a, b = first[i : i + TILE], second[j : j + TILE]
                hit = x[a] @ x[b].T / np.outer(norms[a], norms[b]) >= threshold
                if low == high and i == j:
                    hit = np.triu(hit, 1)
                left, right = np.nonzero(hit)
                if len(left):
                    left, right = a[left], b[right]
                    for at, other in ((left, right), (right, left)):
                        around += np.bincount(at, n[other], len(ids)).astype(np.int64)
                    unite(root, left, right)
        some = around > 0
        return pa.record_batch([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(around[some])], names=["vertex", "star", "around"])

    return by_key(PAIR, pair)


def sampled(threshold: float, kind: type):
    """Rows sorted by (label, dim, block), some of them asking -> (vertex, around) of those: the rows of the block that link."""

    def run(table: pa.Table) -> pa.RecordBatch:
        ids, n, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("vertex", "n", "asks"))
        x = matrix(table.column("vector"), kind)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        asking, own = np.flatnonzero(asks), np.flatnonzero(~asks.astype(bool))
        around = np.zeros(len(asking), np.int64)
        for j in range(0, len(own), TILE):
            b = own[j : j + TILE]
            around += ((x[asking] @ x[b].T >= threshold) & (ids[asking][:, None] != ids[b])) @ n[b]
        return pa.record_batch([pa.array(ids[asking]), pa.array(around)], names=["vertex", "around"])

    return by_key(["label", "dim", "block"], run)


def unite(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Joins in root, which maps each row to the first row of its group, the groups of the pairs (left, right)."""
    while len(left):
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]


def links(members: DataFrame, threshold: float, kind: type) -> DataFrame:
    """vertex, star, around of every pair of blocks of a part, by compared(). Every pair of vectors of a part meets once.

    members: vertex, label, dim, part, n, vector. The vectors of a part are dealt to blocks, and each pair of
    blocks is one unit of work with a key of its own. A block has BLOCK vectors, or, so that the copies a
    vector is sent in grow with the root of the part only, the root of BLOCK times the part's vectors, up to
    PARTITION_BYTES. The work is quadratic in the part's distinct vectors; no link becomes a row.
    """
    part, many = ["label", "dim", "part"], F.count("*")
    wide = F.least(F.sqrt(many * BLOCK), PARTITION_BYTES / (8 * F.col("dim")))
    sizes = cut(members.groupBy(*part).agg(F.ceil(many / F.greatest(F.lit(float(BLOCK)), wide)).cast("int").alias("blocks"), many.alias("many")), "vector-blocks")
    sent, work = sizes.agg(F.sum(8.0 * F.col("dim") * F.col("many") * F.col("blocks")), F.sum(0.5 * F.col("dim") * F.col("many") * F.col("many"))).first()
    parts = max(1, int((sent or 0) // PARTITION_BYTES), int((work or 0) // PART_PRODUCTS))
    met = members.join(sizes, part).withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = met.select("vertex", *part, F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "n", "vector")
    return cut(keyed.repartition(parts, *PAIR).sortWithinPartitions(*PAIR).mapInArrow(compared(threshold, kind), "vertex long, star long, around long"), "vector-links")


def passed(members: DataFrame, threshold: float, kind: type, batch: int = 0) -> DataFrame:
    """Stars (a, b) of the links that a batch of passes finds; each batch has hashes of its own. members: vertex, label, dim, vector, mean, rows; each row is sent once a pass."""
    rows = members.select("vertex", "label", "dim", "vector", "mean", "rows").mapInArrow(keyed(kind, batch), "label long, dim int, pass int, key long, vertex long, vector binary")
    order = ["label", "dim", "pass", "key", "vertex"]
    bytes_ = members.agg(F.sum(F.octet_length("vector"))).first()[0] or 0
    return rows.repartitionByRange(max(1, PASSES * bytes_ // PARTITION_BYTES), *order).sortWithinPartitions(*order).mapInArrow(neighbours(threshold, kind), "a long, b long").distinct()


def united(members: DataFrame, threshold: float, kind: type) -> DataFrame:
    """node, component of what the passes unite: batches of passes go on until QUIET of them in a row unite nothing new among all vectors."""
    stars, quiet, batch = None, 0, 0
    while quiet < QUIET:
        fresh = cut(passed(members, threshold, kind, batch), "vector-stars")
        if stars is not None:
            a, b = (found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")) for end in ("a", "b"))
            named = fresh.join(a, "a", "left").join(b, "b", "left")
            fresh = cut(named.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"), "vector-fresh")
        batch += 1
        if fresh.isEmpty():
            quiet += 1
            found = cut(connected_components(fresh), "vector-components") if stars is None else found
            stars = fresh if stars is None else stars
            continue
        quiet, stars = 0, fresh if stars is None else stars.union(fresh)
        found = cut(connected_components(cut(stars, "vector-united")), "vector-components")
    return found


def audited(members: DataFrame, threshold: float, kind: type) -> DataFrame:
    """label, dim, vertex, around: the links that about AUDIT vectors of each label have in the whole label."""
    blocks = F.ceil(F.col("rows") / (8 * BLOCK)).cast("int")
    of = ["vertex", "label", "dim", "n", "vector"]
    own = members.select(*of, F.pmod(F.xxhash64("vertex"), blocks).cast("int").alias("block"), F.lit(False).alias("asks"))
    sample = members.where(F.pmod(F.xxhash64("vertex", F.lit(1)), F.ceil(F.col("rows") / AUDIT)) == 0)
    every = own.union(sample.select(*of, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("asks")))
    where = ["label", "dim", "block"]
    counted = every.repartition(*where).sortWithinPartitions(*where).mapInArrow(sampled(threshold, kind), "vertex long, around long")
    return sample.select("vertex", "label", "dim").join(counted.groupBy("vertex").agg(F.sum("around").alias("around")), "vertex")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, exact_up_to: int = 0) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Only rows of one label are compared. Vectors that are null, empty or zero or hold nulls, NaN or
    infinities, and rows with a null label, have no links and are their own component. Vectors of
    different lengths don't link. Rows with a null vec_id have no links and a null component. Repeated
    rows are copies and count as links of each other. Empty in, empty out; further columns are left out. Labels of
    up to exact_up_to vectors are compared whole instead of by passes.
    """
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = cut(plain.mapInArrow(usable(kind), "vec_id long, label long, vector binary"), "vectors")
    live = rows.where("vector is not null and vec_id is not null")
    of = live.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = cut(of.withColumns({"dim": (F.octet_length("vector") / np.dtype(kind).itemsize).cast("int"), "vertex": F.monotonically_increasing_id()}), "vector-classes")
    sums = classes.select("label", "dim", "vector").mapInArrow(partial_sums(kind), "label long, dim int, rows long, sum binary")
    labels = cut(sums.groupBy("label", "dim").applyInArrow(mean, "label long, dim int, rows long, mean binary"), "vector-labels")
    members = classes.join(labels, ["label", "dim"])
    whole = lambda df: df.select("vertex", "label", "dim", F.lit(0).cast("long").alias("part"), "n", "vector")

    large = members.where(F.col("rows") > exact_up_to)
    found = united(large, threshold, kind)
    inside = large.join(found, F.col("vertex") == F.col("node")).withColumn("part", F.col("component"))
    met = links(inside.select("vertex", "label", "dim", "part", "n", "vector"), threshold, kind)
    stars = found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    told = audited(large, threshold, kind).join(met.groupBy("vertex").agg(F.sum("around").alias("held")), "vertex", "left")
    recall = told.groupBy("label", "dim").agg(F.sum("around").alias("around"), F.sum(F.coalesce("held", F.lit(0))).alias("held"))
    weak = cut(recall.where(F.col("held") < LEAST * F.col("around")).select("label", "dim").union(labels.where(F.col("rows") <= exact_up_to).select("label", "dim")), "vector-weak")
    if not weak.isEmpty():
        met = met.join(members.join(weak, ["label", "dim"]).select("vertex"), "vertex", "left_anti")
        more = links(whole(members.join(weak, ["label", "dim"])), threshold, kind)
        met, stars = met.union(more), stars.union(more.where("star <> vertex").select("star", "vertex"))
    named = cut(connected_components(cut(stars.distinct(), "vector-edges")), "vector-named")
    around = met.groupBy("vertex").agg(F.sum("around").alias("around"))
    names = smallest_names(named, classes.select(F.col("vertex").alias("node"), F.col("first").alias("name")))
    summary = classes.join(around, "vertex", "left").join(names, classes["vertex"] == names["node"], "left")
    summary = summary.select("label", "vector", (F.coalesce("around", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("name", "first").alias("component_id"))
    joined = live.join(summary, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
