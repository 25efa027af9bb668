"""Cross-entropy difference scoring (Moore and Lewis) with bigram models counted over the whole corpus.

The target model counts the target documents, the background model all documents; both are bigrams
that back off to unigrams with the same smoothing over one vocabulary, the corpus's words. A document's
own counts are left out of both models while it is scored. Documents are dealt to chunks; each chunk
asks, by hash bucket, for the counts of its distinct n-grams and gets them back in the same order, so
no task or driver holds a model. What is gathered is one entry per distinct n-gram of each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.op4_jaccard import high_bits, pack6, unpack6
from larder.llm.storage import cut
from larder.llm.text import mix, slices, words

CHUNK_BYTES, SLICE_BYTES = 6 << 20, 1 << 20
PER_BUCKET = 1_000_000
ALPHA, BACKOFF = 0.1, 2.0
_ONE, _TWO = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A99)


def grams(texts: pa.Array, buckets: int):
    """Per token its unigram key and, but for first words (0), the key of the bigram it ends; word ranges.

    The lowest bit tells bigrams from unigrams; bits between the bucket's and the low 48 are dropped.
    """
    w = words(texts, lower=True)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    trim = lambda h: (h >> shift << shift) | (h & np.uint64(2**48 - 1))
    one = trim(mix(w.hashes * _ONE + np.uint64(1)) & ~np.uint64(1))
    two = np.zeros(len(one), np.uint64)
    two[1:] = trim(mix(w.hashes[:-1] * _TWO + w.hashes[1:]) | np.uint64(1))
    two[w.first[:-1][np.diff(w.first) > 0]] = 0
    return one, two, w.first


def count(table: pa.Table, buckets: int):
    """A chunk's distinct keys in order, their counts and counts in target documents; grams of each batch."""
    parts, marks, read = [], [], []
    for batch in (part for batch in table.to_batches() for part in slices(batch, "text", SLICE_BYTES)):
        one, two, first = grams(batch.column("text"), buckets)
        read.append((batch, one, two, first))
        target = np.repeat(batch.column("is_target").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
        parts += [one, two[two != 0]]
        marks += [target, target[two != 0]]
    keys, hits = np.concatenate(parts), np.concatenate(marks)
    hit = np.sort(keys[hits])
    keys.sort()
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    unique = keys[edges[:-1]]
    return unique, np.diff(edges), np.searchsorted(hit, unique, "right") - np.searchsorted(hit, unique, "left"), read


ENTRIES = "bucket long, chunk long, keys binary, n binary, t binary"


def entries(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "chunk", "keys", "n", "t"])


def planes(v: np.ndarray) -> bytes:
    """Counts by byte, lowest bytes first: the empty high bytes cost nothing once compressed."""
    return np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def chunk_counts(buckets: int):
    """A chunk's documents -> for each bucket its distinct keys, their counts and counts in target documents."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        unique, n, t, _ = count(table, buckets)
        cuts = np.searchsorted(high_bits(unique, buckets), np.arange(buckets + 1))
        return entries([(int(k), chunk, pack6(unique[a:b]), planes(n[a:b]), planes(t[a:b])) for k in np.flatnonzero(np.diff(cuts)) for a, b in [cuts[k : k + 2]]])

    return run


def answer(table: pa.Table) -> pa.Table:
    """Keys of a bucket from all chunks -> per chunk the corpus's counts of its keys, in their order."""
    parts = sorted(table.select(["bucket", "chunk", "keys", "n", "t"]).to_pylist(), key=lambda r: r["chunk"])
    keys = [unpack6(r["keys"]) for r in parts]
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    n, t = (np.bincount(at, np.concatenate([unplanes(r[c]) for r in parts])) for c in ("n", "t"))
    cuts = np.cumsum([0, *map(len, keys)])
    return entries([(r["bucket"], r["chunk"], b"", planes(n[at[a:b]]), planes(t[at[a:b]])) for r, a, b in zip(parts, cuts[:-1], cuts[1:], strict=True)])


def losses(vocabulary: int, tokens: tuple[int, int], buckets: int):
    """A chunk's documents and its answered counts -> one scored row per document."""
    names = ["doc_id", "is_target", "n_tokens", "target_loss", "background_loss"]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64())

    def own_counts(keys: np.ndarray) -> np.ndarray:
        _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
        return n[at]

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        known, n, t, read = count(docs, buckets)
        n, t = n.astype(float), t.astype(float)
        cuts = np.searchsorted(high_bits(known, buckets), np.arange(buckets + 1))
        for bucket, total, target in zip(*(counts.column(c).to_pylist() for c in ("bucket", "n", "t")), strict=True):
            n[cuts[bucket] : cuts[bucket + 1]], t[cuts[bucket] : cuts[bucket + 1]] = unplanes(total), unplanes(target)
        out = [[] for _ in names]
        for batch, one, two, first in read:
            at_one, at_two = np.searchsorted(known, one), np.searchsorted(known, two)
            for i, (doc, target) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("is_target").to_pylist(), strict=True)):
                a, b = first[i], first[i + 1]
                sums = [0.0, 0.0]
                if b > a:
                    mine, pairs = own_counts(one[a:b]), own_counts(two[a + 1 : b])
                    for side, (table, total) in enumerate(((t, tokens[1]), (n, tokens[0]))):
                        out_of = 1 if side == 1 or target else 0  # whether the model has seen this document
                        single = table[at_one[a:b]] - out_of * mine
                        p = (single + ALPHA) / (total - out_of * (b - a) + ALPHA * (vocabulary + 1))
                        joint = table[at_two[a + 1 : b]] - out_of * pairs
                        p[1:] = (joint + BACKOFF * p[1:]) / (np.maximum(single[:-1], joint) + BACKOFF)
                        sums[side] = float(-np.log(p).sum())
                for column, value in zip(out, (doc, target, int(b - a), *sums), strict=True):
                    column.append(value)
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def vocabulary_parts(buckets: int):
    """Documents -> the distinct words of each batch; one row (key null) with its tokens and target tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                one, _, first = grams(part.column("text"), buckets)
                target = part.column("is_target").to_numpy(zero_copy_only=False).astype(bool)
                keys = np.unique(one).view(np.int64)
                none = np.zeros(len(keys), np.int64)
                yield pa.record_batch([pa.array(keys), pa.array(none), pa.array(none)], names=["key", "n", "t"])
                yield pa.record_batch([pa.array([None], pa.int64()), pa.array([len(one)], pa.int64()), pa.array([int(np.diff(first)[target].sum())], pa.int64())], names=["key", "n", "t"])

    return run


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, is_target, n_tokens, target_loss, background_loss (nats), score = their difference per token.

    Lower scores are more like the target. target_ids has one column of keys; repeats and nulls in it
    don't count. Null and empty texts and texts without words score 0.0; repeated rows count each time;
    null keys are never target; with no target documents the target model is uniform; empty in, empty
    out; further columns are left out. Rows are dealt to chunks by their place in docs, so that repeated
    ones spread; docs is read twice and has to give its rows in one order, as a table read from files does.
    """
    ids = target_ids.toDF("doc_id").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("is_target", F.lit(True))
    marked = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("place"))
    sizes = marked.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    chunks = max(1, -(-(sizes[0] or 0) // CHUNK_BYTES))
    buckets = 64
    while buckets < 2**30 and buckets * PER_BUCKET < (sizes[0] or 0) // 3:
        buckets *= 2
    flags = cut(marked.select("doc_id").distinct().join(ids, "doc_id"), "target")
    marked = marked.join(flags, "doc_id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    totals = marked.select("text", "is_target").mapInArrow(vocabulary_parts(buckets), "key long, n long, t long").agg(F.countDistinct("key"), F.sum("n"), F.sum("t")).first()
    vocabulary, n, t = (int(v or 0) for v in totals)
    dealt = marked.withColumn("chunk", F.pmod(F.xxhash64("place"), F.lit(chunks)).cast("long")).drop("place")
    asked = dealt.groupBy("chunk").applyInArrow(chunk_counts(buckets), ENTRIES)
    answered = asked.groupBy("bucket").applyInArrow(answer, ENTRIES)
    scored = dealt.groupBy("chunk").cogroup(answered.groupBy("chunk"))
    result = scored.applyInArrow(losses(vocabulary, (n, t), buckets), "doc_id long, is_target boolean, n_tokens long, target_loss double, background_loss double")
    return result.withColumn("score", F.when(F.col("n_tokens") > 0, (F.col("target_loss") - F.col("background_loss")) / F.col("n_tokens")).otherwise(0.0))
