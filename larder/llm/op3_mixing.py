"""Mixing sources to target weights by hash thresholds, with DataFrame functions only.

Every document has a fixed hash. A source's words are summed by hash bucket; the budget falls into
one bucket; only that bucket is split by the next bits, level by level, until it holds one document of
each source. Documents that share a hash, being rows of one id, are split further by a hash of their
row. Documents below the threshold are taken; nothing is sorted. A larger budget has a larger
threshold, so smaller mixes lie inside larger ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.storage import cut

BITS = 12
#: Levels of the hash of an id (BITS each), then of the hash of a row.
ID_LEVELS, ROW_LEVELS = 5, 5
#: A table with one row per source is broadcast up to so many rows, and joined by shuffle beyond.
SMALL_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Number of runs outside ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """sizes with rank, from 0 by code point, null last: rows are dealt by range, ranked inside each part, parts counted."""
    dealt = cut(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return dealt.join(base, "part").withColumn("rank", F.col("base") + F.row_number().over(inside) - 1).drop("part", "base")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size -> with target, one row per source.

    Targets are min(most * source_size, level * weight), one level for all: it starts as if no source were
    capped and rises to what the capped ones leave for the rest, until no further source is above its cap.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = cut(
        ranked_sources(sizes)
        .withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most))),
        "mix-weights",
    )
    total, level, capped = (weighed.agg(F.sum("source_size")).first()[0] or 0) * float(share), 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        held, free, n = weighed.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == capped or not free:
            break
        level, capped = (total - (held or 0.0)) / free, n
    return weighed.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def id_hash(key: Column) -> Column:
    """60 bits of a document's key; null counts as empty."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def row_hash() -> Column:
    """60 bits of a row's place in its table."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4)


def bits(level: int) -> Column:
    """The first level * BITS bits of a row's hashes: of h, and where level is above ID_LEVELS, of g below an equal h."""
    word, n = ("h", level) if level <= ID_LEVELS else ("g", level - ID_LEVELS)
    return F.shiftrightunsigned(F.col(word), BITS * (ID_LEVELS - n))


def limits_of(slim: DataFrame, weights: Sequence[float], share: float, most: float) -> tuple[DataFrame, Column]:
    """A row per source (source, source_size, target, passes, path, limit) and, for rows with h and g, how often each is taken."""
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goals = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    frontier = cut(goals.withColumns({"path": F.lit(0).cast("long"), "now": F.lit(0).cast("long"), "need": F.col("target") - F.col("passes") * F.col("source_size")}), "mix-goals")
    few = frontier.count() <= SMALL_ROWS
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    for level in range(1, ID_LEVELS + ROW_LEVELS + 1):
        # path: the boundary bucket's bits of h; now: its bits of the hash in use
        first = level == ID_LEVELS + 1
        inside = slim
        if level > 1:
            here = bits(level - 1) == F.col("now")
            edge = frontier.select("source", "path", "now")
            inside = slim.alias("a").join(F.broadcast(edge).alias("b") if few else edge.alias("b"), same & (here if level - 1 <= ID_LEVELS else here & (F.col("h") == F.col("path")))).select("a.*")
        hist = inside.groupBy("source", bits(level).bitwiseAND(F.lit(2**BITS - 1)).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("words").over(run)).withColumn("below", F.col("upto") - F.col("words"))
        kept = [c for c in ("source", "source_size", "target", "passes", "path", "now", "need")]
        hit = F.min(F.when(F.col("b.upto") > F.col("a.need"), F.struct("b.bucket", "b.below", "b.words", "b.rows"))).alias("hit")
        placed = frontier.alias("a").join(hist.alias("b"), same, "left").groupBy(*[f"a.{c}" for c in kept]).agg(hit)
        # no bucket passes the budget: the boundary is the end of the range
        now = (F.lit(0) if first else F.col("now")) * 2**BITS + F.coalesce("hit.bucket", F.lit(2**BITS - 1))
        frontier = cut(
            placed.select(
                "source", "source_size", "target", "passes",
                (now if level <= ID_LEVELS else F.col("path")).cast("long").alias("path"), now.cast("long").alias("now"),
                (F.col("need") - F.coalesce("hit.below", F.lit(0))).alias("need"), F.col("hit.words").alias("edge"), F.coalesce("hit.rows", F.lit(0)).alias("rows"),
            ),
            f"mix-{level}",
        )
        if not frontier.agg(F.max("rows") > 1).first()[0]:
            break
    # The boundary bucket holds one document: take it if that comes nearer.
    nearer = F.when(F.coalesce(F.col("edge"), F.lit(0)) < 2 * F.col("need"), 1).otherwise(0)
    limits = frontier.select("source", "source_size", "target", "passes", "path", (F.col("now") + nearer).alias("limit"))
    under = bits(level) < F.col("limit")
    if level > ID_LEVELS:
        under = (F.col("h") < F.col("path")) | (F.col("h") == F.col("path")) & under
    copies = F.col("passes") + F.when(under & (F.col("passes") < int(most)), 1).otherwise(0)
    return F.broadcast(limits) if few else limits, copies


def sized(docs: DataFrame, key: str) -> DataFrame:
    return cut(docs.select(F.col(key).alias("doc_id"), "source", word_count(F.col("text")).alias("size"), id_hash(F.col(key)).alias("h"), row_hash().alias("g")), "mix")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, key: str = "doc_id") -> DataFrame:
    """key, source, size, source_size, target, copies, taken, one row per document.

    copies is how often the mix takes the document: whole passes over its source, plus one more where
    its hash lies under the source's threshold. Each source misses its target by half its largest
    document at most, also where rows repeat. Null texts have size 0 (taken 0); a null source is a
    source, last in order; null keys share one hash and are told apart by their row; empty in, empty
    out; further columns are left out.
    """
    slim = sized(docs, key)
    limits, copies = limits_of(slim, weights, share, most)
    joined = slim.join(limits.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))).withColumn("copies", copies)
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, key: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns as they are, each as often as mix() takes it.

    Rows that share a key are told apart by their place in docs, which has to be a table that gives its
    rows in one order each time, as one read from files does. Rows of sources without words go; empty in,
    empty out.
    """
    limits, copies = limits_of(sized(docs, key), weights, share, most)
    names = {c: F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(docs.columns)}
    marked = docs.select(*names.values(), F.col("source").alias("__source"), id_hash(F.col(key)).alias("h"), row_hash().alias("g"))
    taken = marked.join(limits.withColumnRenamed("source", "its"), F.col("__source").eqNullSafe(F.col("its"))).withColumn("__copies", copies).where("__copies > 0")
    taken = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return taken.select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns)])
