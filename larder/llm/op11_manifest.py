"""A Merkle manifest of a dataset: a tree over the rows of each group, and one over the groups' roots.

Levels are windows: nodes are partitioned by their group and their parent's place, and the ordered list of a
whole window gives both what the parent hashes and what each child's siblings are. The first node of a window
stands for the parent and takes along the steps of all rows below it. Nodes are laid out in blocks of up to
BLOCK nodes of a group, in which several levels follow each other without a shuffle; a block leaves one row.
The steps of the levels above then come back to each block by its place, from the top down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.storage import cut

#: Nodes of a block, whose levels are hashed one after the other in one task.
BLOCK = 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def written(value: Column) -> Column:
    """'-' for null, else the number of UTF-8 bytes, ':' and the value as text: no two lists of values look alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with idx, the place of each in its group g (from 0), and nodes, the rows of that group.

    Rows are dealt to parts by range, so a large group and even equal rows spread over many; a place is what
    the group has in the parts before plus the place in the own part.
    """
    placed = cut(rows.repartitionByRange("g", *order).withColumn("part", F.spark_partition_id()), "placed")
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("g", "part").agg(F.count("*").alias("n"))
    counts = counts.select("g", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(group).alias("nodes"))
    own = Window.partitionBy("g", "part").orderBy(*order)
    return placed.withColumn("own", F.row_number().over(own) - 1).join(counts, ["g", "part"]).withColumn("idx", F.col("base") + F.col("own")).drop("part", "base", "own")


def climb(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """g, idx, node, nodes, carried -> a row for each block: its place idx and node some levels up, and members, every node's carried and steps.

    A step is what stands left and right of a node in the parent's preimage. A group down to one node climbs no further.
    """
    step = "array<struct<left: string, right: string>>"
    df = nodes.select("g", "idx", "node", "nodes", F.floor(F.col("idx") / arity**levels).alias("block"), F.array(F.struct("carried", F.array().cast(step).alias("path"))).alias("members"))
    df = df.repartition("g", "block")
    for _ in range(levels):
        whole = Window.partitionBy("g", "block", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        df = df.withColumn("parent", F.floor(F.col("idx") / arity)).withColumn("run", F.collect_list(F.struct("node", "members")).over(whole))
        df = df.where(F.col("idx") % arity == 0).withColumn("digests", F.col("run.node"))  # the first of a run stands for the parent

        def below(child: Column, at: Column) -> Column:
            left, right = F.slice("digests", F.lit(1), at), F.slice("digests", at + 2, F.lit(arity))
            beside = F.array(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
            return F.transform(child["members"], lambda m: F.struct(m["carried"].alias("carried"), F.concat(m["path"], beside).alias("path")))

        df = df.select(
            "g", "block", F.col("parent").alias("idx"), F.ceil(F.col("nodes") / arity).alias("nodes"),
            F.when(F.col("nodes") > 1, F.sha2(F.array_join("digests", ""), 256)).otherwise(F.col("node")).alias("node"),
            F.when(F.col("nodes") > 1, F.flatten(F.transform("run", below))).otherwise(F.col("members")).alias("members"),
        )
    return df.drop("block")


def tree(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """g, idx, node, nodes, carried -> the tables of blocks, from the leaves up to one node for each group."""
    most = leaves.agg(F.max("nodes")).first()[0] or 1
    tables = []
    while not tables or most > 1:
        levels = 1
        while arity**levels < most and arity ** (levels + 1) <= BLOCK:
            levels += 1
        tables.append(cut(climb(leaves, arity, levels), "blocks"))
        leaves = tables[-1].select("g", "idx", "node", "nodes", F.struct("idx").alias("carried"))
        most = -(-most // arity**levels)
    return tables


def paths(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The carried columns of every leaf and its path, from the leaf up; `above` has g, idx, the path to go on with, and more columns for all below."""
    more = [c for c in above.columns if c not in ("g", "idx", "path")]
    for blocks in reversed(tables):
        joined = blocks.select("g", "idx", "members").join(above.withColumnRenamed("path", "rest"), ["g", "idx"])
        member = joined.select("g", F.explode("members").alias("m"), "rest", *more)
        above = member.select("g", "m.carried.*", F.concat("m.path", "rest").alias("path"), *more)
    return above


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """key (as doc_id), group, leaf, path, subroot, root of every row, and claimed, the leaf with tampered values in place.

    A leaf is the SHA-256 of a row's fields; the leaves of a group stand in the order of key, then leaf, and
    every `arity` of them, the last run maybe fewer, become one until one is left: subroot. The subroots, null
    group first, then by bytes, become root in the same way. path lists from the leaf up what stands left and
    right of the node in its parent's preimage, so folding it over the leaf gives root.

    Nulls are written as '-': a null key, group or text is a value like any other; null keys come first.
    Repeated rows are leaves of their own, side by side. A group of one row has its leaf as subroot. An empty
    table gives an empty result; columns outside key, group and fields are left out. Block tables hold about
    130 bytes for each row and level.
    """
    changed = {f: F.col(f) for f in fields} | (tampered or {})
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("g"),
        F.col(key).alias("doc_id"),
        digest(*(written(F.col(f)) for f in fields)).alias("node"),
        digest(*(written(changed[f]) for f in fields)).alias("claimed"),
        F.monotonically_increasing_id().alias("place"),
    )
    leaves = numbered(cut(rows, "leaves"), "doc_id", "node", "place")
    groups = tree(leaves.withColumn("carried", F.struct("doc_id", F.col("node").alias("leaf"), "claimed")), arity)
    subroots = groups[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "node")
    top = tree(numbered(subroots, "of").withColumn("carried", F.struct("of", F.col("node").alias("subroot"))), arity)
    root = top[-1].select("g", "idx", F.array().cast("array<struct<left: string, right: string>>").alias("path"), F.col("node").alias("root"))
    above = paths(top, root).select(F.col("of").alias("g"), F.lit(0).cast("long").alias("idx"), "path", "subroot", "root")
    named = F.when(F.col("g") != "-", F.substring("g", 2, 1 << 30)).alias("group")
    return paths(groups, above).select("doc_id", named, "leaf", "claimed", "path", "subroot", "root")


def verify(made: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of all siblings in order), folded_root (claimed folded along the path), verified."""
    siblings = F.transform("path", lambda s: F.concat(s["left"], s["right"]))
    folded = F.aggregate("path", F.col("claimed"), lambda node, s: digest(s["left"], node, s["right"]))
    proved = made.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))
