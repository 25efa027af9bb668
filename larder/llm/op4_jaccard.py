"""Self-join of word-shingle sets by Jaccard similarity, with adaptive multi-match prefixes.

Shingles are ordered by document frequency, then hash. Two sets of similarity t share at least k
shingles of their prefixes of length n - ceil(t n) + k, for every k (AdaptJoin). Each set picks the k
that makes scanning plus verifying cheapest for the frequencies in its own prefix; a pair is verified
if it shares min(k of both) prefix shingles. Shingles of one document alone lead every prefix and
need not be sent anywhere: only shared ones travel on. A shared shingle speaks for a pair only where
what follows it in both sets still suffices: the j-th common shingle (j up to k) at places p and q
leaves at most j + min(n - p, m - q) in common.

Exact copies (equal sets) are one class from the start. Rounds of stars then verify every set against a
few common partners, a bounded number of candidates for each posting, and unite what links; lists whose
sets are all in one component are dropped. Rounds go on while the lists still hold many pairs between
components and each round halves them. Only then does every remaining pair between components become a
candidate, so a large group of near copies isn't expanded into its pairs, and no link between different
groups is lost.

Shingle hashes travel as packed numpy arrays per hash bucket; Spark groups the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.components import connected_components, smallest_names
from larder.llm.storage import cut
from larder.llm.text import mix, slices, words

WIDTH = 5
PER_BUCKET, PER_CHUNK = 500_000, 1_500_000
#: Sets of a chunk; the step from one to another fits two bytes.
MOST_HELD = 60_000
LONGEST = 16
#: Cost of a verification against sending one candidate from a list.
VERIFY_COST = 6.0
#: In a round of stars: partners of a posting, and candidates of a set that are verified.
ANCHORS, TRIED = 3, 4
#: Pairs between components, for each posting at first, above which another round of stars goes before them.
CROWDED = 4


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, a text without words none."""
    w = words(texts, lower=True)
    runs = w.windows(width)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= width:
            own = np.sort(runs[a : b - width + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            whole = np.uint64(b - a)
            for h in w.hashes[a:b]:
                whole = mix(np.array([whole ^ h], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return int(own.sum(dtype=np.uint64).view(np.int64)), int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    return (percent * n + 99) // 100


def pack6(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack6(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def profile(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th, n, k1, k2 of every row: the text's hash, the size of its set and what stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                keys = [set_key(s) for s in sets]
                yield pa.record_batch([part.column("doc_id"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], names=["doc_id", "th", "n", "k1", "k2"])

    return docs.mapInArrow(run, "doc_id long, th long, n long, k1 long, k2 long")


PARTS = "bucket long, chunk long, x binary, y binary, z binary"
_PARTS = ["bucket", "chunk", "x", "y", "z"]


def _rows(rows: list[tuple], names: list[str] = _PARTS) -> pa.Table:
    kinds = [pa.int64() if k in ("bucket", "chunk", "vertex", "n") else pa.binary() for k in names]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def high_bits(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash (buckets: a power of two); hashes keep their low 48 bits besides."""
    return (h >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def restored(low: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """A hash's low 48 bits and what its bucket tells of the 16 above."""
    bits = buckets.bit_length() - 1
    return low + (np.uint64(bucket >> (bits - 16) if bits > 16 else bucket << (16 - bits)) << np.uint64(48))


def postings(width: int, buckets: int):
    """Chunks of documents -> per chunk one head (vertices, set sizes; bucket under 0) and its hashes by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        held: list[np.ndarray] = []
        ids: list[int] = []
        seen: set[int] = set()  # rows of one key and text stand for one set

        def flush() -> Iterator[pa.RecordBatch]:
            n = np.array([len(s) for s in held], "<u4")
            yield from _rows([(-1 - chunk, chunk, np.array(ids, "<i8").tobytes(), n.tobytes(), b"")]).to_batches()
            allh, owner = np.concatenate(held), np.repeat(np.arange(len(held), dtype="<u4"), n)
            bucket = high_bits(allh, buckets)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 65536 else bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(edges)):
                own = order[edges[k] : edges[k + 1]]
                rows.append((int(k), chunk, pack6(allh[own]), owner_steps(owner[own]), b""))
                if len(rows) == 64:
                    yield from _rows(rows).to_batches()
                    rows = []
            if rows:
                yield from _rows(rows).to_batches()

        for batch in batches:
            for part in slices(batch, "text"):
                k1, k2 = part.column("k1").to_pylist(), part.column("k2").to_pylist()
                for vertex, own, a, b in zip(part.column("vertex").to_pylist(), shingle_sets(part.column("text"), width), k1, k2, strict=True):
                    if vertex not in seen and set_key(own) == (a, b):
                        held.append(own)
                        ids.append(vertex)
                        seen.add(vertex)
                        if len(held) == MOST_HELD:
                            yield from flush()
                            held, ids, chunk = [], [], chunk + 1
                if sum(map(len, held)) >= PER_CHUNK:
                    yield from flush()
                    held, ids, chunk = [], [], chunk + 1
        if held:
            yield from flush()

    return run


def owner_steps(owner: np.ndarray) -> bytes:
    """Ascending numbers of a chunk's sets, as the steps between them: two bytes a hash, however many buckets there are."""
    return np.diff(owner, prepend=owner.dtype.type(0)).astype("<u2").tobytes()


def owners_of(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, "<u2"), dtype="<u4")


def frequencies(table: pa.Table) -> pa.Table:
    """Hashes of a bucket from all chunks -> for each chunk those in two sets or more, with their frequency."""
    if table.column("bucket")[0].as_py() < 0:
        return table
    parts = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    hashes = [unpack6(r["x"]) for r in parts]
    allh = np.concatenate(hashes)
    order = np.argsort(allh)
    s = allh[order]
    edges = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
    df = np.empty(len(s), "<u4")
    df[order] = np.repeat(np.diff(edges), np.diff(edges))
    rows, at = [], 0
    for r, own in zip(parts, hashes, strict=True):
        owner = owners_of(r["y"])
        f = df[at : at + len(own)]
        at += len(own)
        keep = f > 1
        if keep.any():
            rows.append((r["bucket"], r["chunk"], pack6(own[keep]), owner[keep].tobytes(), f[keep].tobytes()))
    return _rows(rows)


def choose_prefix(df: np.ndarray, n: int, percent: int) -> tuple[int, int]:
    """(k, shared shingles in the prefix) for a set of n whose shared shingles have the ascending frequencies df."""
    alone = n - len(df)
    least = n - int(needed(np.int64(n), percent)) + 1 - alone
    if least <= 0:
        return 1, 0
    top = min(LONGEST, len(df) - least + 1, n)
    ks = np.arange(1, max(top, 1) + 1)
    scanned = np.cumsum(df.astype(np.float64) - 1)[least - 2 + ks]
    k = int(ks[np.argmin(scanned * (ks + VERIFY_COST / ks))])  # a candidate comes up to k times, one in k is verified
    return k, least + k - 1


def prefixes(percent: int, buckets: int):
    """A chunk's head and shared hashes -> kind 0: prefix postings by bucket; kind 1: a set's shared hashes."""
    names = ["bucket", "vertex", "n", "x", "y"]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["bucket"] < 0)
        ids, sizes = np.frombuffer(head["x"], "<i8"), np.frombuffer(head["y"], "<u4")
        rows = sorted((r for r in rows if r["bucket"] >= 0), key=lambda r: r["bucket"])
        if not rows:
            return _rows([], names)
        h = np.concatenate([restored(unpack6(r["x"]), r["bucket"], buckets) for r in rows])
        owner = np.concatenate([np.frombuffer(r["y"], "<u4") for r in rows])
        df = np.concatenate([np.frombuffer(r["z"], "<u4") for r in rows])
        order = np.lexsort((h, df, owner))
        h, owner, df = h[order], owner[order], df[order]
        edges = np.searchsorted(owner, np.arange(len(ids) + 1))
        out, ph, pv, pn, pk, pp = [], [], [], [], [], []
        for i in np.flatnonzero(np.diff(edges)):
            a, b = edges[i], edges[i + 1]
            k, q = choose_prefix(df[a:b], int(sizes[i]), percent)
            if q:
                ph.append(h[a : a + q])
                pv.append(np.full(q, ids[i]))
                pn.append(np.full(q, sizes[i]))
                pk.append(np.full(q, k))
                pp.append(int(sizes[i]) - (b - a) + 1 + np.arange(q))
                out.append((-1, int(ids[i]), int(sizes[i]), pack6(np.sort(h[a:b] & np.uint64(2**48 - 1))), b""))
        if ph:
            packed = np.stack([np.concatenate(ph).view(np.int64), *(np.concatenate(c).astype(np.int64) for c in (pv, pn, pk, pp))], axis=1)
            bucket = high_bits(np.ascontiguousarray(packed[:, 0]).view(np.uint64), buckets)
            order = np.argsort(bucket, kind="stable")
            packed, bucket = packed[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            out += [(int(bucket[a]), 0, 0, packed[a:b].tobytes(), b"") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return _rows(out, names)

    return run


def postings_of(raw: bytes) -> np.ndarray:
    """Rows (hash, vertex, n, k, place, component)."""
    return np.frombuffer(raw, "<i8").reshape(-1, 6)


def list_edges(p: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], p[1:, 0] != p[:-1, 0], [True]))) if len(p) else np.zeros(1, np.int64)


def surveyed(table: pa.Table) -> pa.Table:
    """Postings of a bucket -> those of lists with several components, by hash, then vertex, and their pairs between components."""
    p = np.stack([table.column(c).to_numpy() for c in ("h", "vertex", "n", "k", "place", "component")], axis=1)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    p = p[np.concatenate(([True], (p[1:, :2] != p[:-1, :2]).any(axis=1)))]
    edges = list_edges(p)
    sizes = np.diff(edges)
    mixed = np.minimum.reduceat(p[:, 5], edges[:-1]) != np.maximum.reduceat(p[:, 5], edges[:-1])
    p = p[np.repeat(mixed, sizes)]
    in_list = np.repeat(np.arange(mixed.sum()), sizes[mixed])
    own = np.unique(np.stack([in_list, p[:, 5]], axis=1), axis=0, return_counts=True)[1].astype(float) if len(p) else np.zeros(0)
    pairs = int(((sizes[mixed].astype(float) ** 2).sum() - (own**2).sum()) / 2)
    rows = [(table.column("bucket")[0].as_py(), p.tobytes(), len(p), pairs)] if len(p) else []
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["bucket", "x", "postings", "pairs"])


def can_link(p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Whether postings of one shingle, from different components, can be among the first k common ones of a link."""
    n, m = p[..., 2], q[..., 2]
    least = -(-percent * (n + m) // (100 + percent))
    rest = np.minimum(n - p[..., 4], m - q[..., 4])
    return (p[..., 5] != q[..., 5]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(p[..., 3], q[..., 3]) + rest >= least)


COUNTED = "a long, b long, n long, k long"


def counted(pairs: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs (of a fixed k each), how often they came, and their k."""
    pairs, at, n = np.unique(pairs, axis=0, return_index=True, return_counts=True)
    return pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(n.astype(np.int64)), pa.array(k[at])], names=["a", "b", "n", "k"])


def stars(salt: int, percent: int):
    """Each member of a list with the list's first members and the one before it, if of another component.

    The order is by place, then salted: a set with few rarer shingles before a common one strayed least
    from what its group shares, and so links with most of the group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("x"):
                p = postings_of(raw.as_py())
                p = p[np.lexsort((mix(p[:, 1].view(np.uint64).copy() ^ np.uint64(salt)), p[:, 4], p[:, 0]))]
                at, edges = np.arange(len(p)), list_edges(p)
                first = np.repeat(edges[:-1], np.diff(edges))
                found = []
                for partner in (*(first + r for r in range(ANCHORS)), np.maximum(at - 1, first + ANCHORS)):
                    partner = np.minimum(partner, at)
                    ok = (partner < at) & can_link(p[partner], p, percent)
                    found.append(np.stack([p[ok, 1], p[partner[ok], 1], np.minimum(p[ok, 3], p[partner[ok], 3])], axis=1))
                pairs = np.concatenate(found)
                yield counted(pairs[:, :2], pairs[:, 2])

    return run


def crossings(percent: int):
    """Every pair of a list from different components whose sizes allow a link; n: lists shared in this bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("x"):
                p = postings_of(raw.as_py())
                edges, found = list_edges(p), [np.zeros((0, 3), np.int64)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    own = p[a:b]
                    for i in range(len(own) - 1):
                        rest = own[i + 1 :]
                        ok = can_link(own[i], rest, percent)
                        if ok.any():
                            found.append(np.stack([np.full(ok.sum(), own[i, 1]), rest[ok, 1], np.minimum(rest[ok, 3], own[i, 3])], axis=1))
                pairs = np.concatenate(found)
                yield counted(pairs[:, :2], pairs[:, 2])

    return run


def linked(percent: int):
    """Rows with both sets of a pair -> the pairs that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, xa, xb = (batch.column(c) for c in ("a", "b", "na", "nb", "xa", "xb"))
            na, nb = na.to_numpy(), nb.to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                both = np.intersect1d(unpack6(xa[i].as_py()), unpack6(xb[i].as_py()), assume_unique=True).size
                keep[i] = 100 * both >= percent * (na[i] + nb[i] - both)
            yield pa.record_batch([a, b], names=["a", "b"]).filter(pa.array(keep))

    return run


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = WIDTH, key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id of every row: the smallest key reachable over links of percent similarity.

    Texts without words (null too) have n_shingles 0 and link with nothing. Each distinct set of shingles
    is a node: equal texts link, under one key or several; different texts under one key link only if they
    are similar. Rows with a null key get their n_shingles, component null, and link with nothing. Empty
    in, empty out; further columns are left out.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
    rows = cut(profile(docs, width), "sets")
    known = rows.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    classes = cut(known.select("k1", "k2", "n", "first.doc_id", "first.th").withColumn("vertex", F.monotonically_increasing_id()), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = 64
    while buckets < 2**30 and buckets * PER_BUCKET < total:
        buckets *= 2

    chosen = docs.join(classes.select("doc_id", "th", "vertex", "k1", "k2"), ["doc_id", "th"])
    shared = chosen.mapInArrow(postings(width, buckets), PARTS).groupBy("bucket").applyInArrow(frequencies, PARTS)
    parts = cut(shared.groupBy("chunk").applyInArrow(prefixes(percent, buckets), "bucket long, vertex long, n long, x binary, y binary"), "prefixes")
    sets = parts.where("bucket < 0").select("vertex", "n", "x")

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("vertex").alias("a"), F.col("n").alias("na"), F.col("x").alias("xa"))
        right = sets.select(F.col("vertex").alias("b"), F.col("n").alias("nb"), F.col("x").alias("xb"))
        return cut(pairs.join(left, "a").join(right, "b").mapInArrow(linked(percent), "a long, b long"), "links")

    flat = parts.where("bucket >= 0").select("bucket", "x").mapInArrow(flatten(5), f"bucket long, {FLAT}").withColumn("component", F.col("vertex"))
    links, named, salt, least, before = None, None, 1, None, 0
    while True:
        lists = cut(flat.groupBy("bucket").applyInArrow(surveyed, "bucket long, x binary, postings long, pairs long"), "lists")
        held, pairs = (n or 0 for n in lists.agg(F.sum("postings"), F.sum("pairs")).first())
        least = held if least is None else least
        if not held or links is not None and (pairs <= CROWDED * least or 2 * pairs > before):
            break
        tried = lists.select("x").mapInArrow(stars(salt, percent), COUNTED).groupBy("a", "b").agg(F.sum("n").alias("n"))
        best = Window.partitionBy("a").orderBy(F.desc("n"), "b")
        fresh = verified(tried.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TRIED).select("a", "b"))
        links = fresh if links is None else links.union(fresh)
        named, salt, before = connected_components(links), salt + 1, pairs
        flat = lists.select("bucket", "x").mapInArrow(flatten(6), f"bucket long, {FLAT}, component long").drop("component")
        flat = flat.join(named.withColumnRenamed("node", "vertex"), "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    if held:
        rest = lists.select("x").mapInArrow(crossings(percent), COUNTED).groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("k").alias("k")).where("n >= k")
        named = connected_components(links.union(verified(rest.select("a", "b"))))

    of_class = classes.select("k1", "k2", "n", F.col("doc_id").alias("component_id"), "vertex")
    if named is not None:
        names = smallest_names(named, classes.select(F.col("vertex").alias("node"), F.col("doc_id").alias("name")))
        of_class = of_class.join(names, of_class["vertex"] == names["node"], "left").withColumn("component_id", F.coalesce("name", "component_id"))
    placed = rows.alias("r").join(of_class.select("k1", "k2", "n", "component_id"), ["k1", "k2", "n"], "left")
    alone = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


FLAT = "h long, vertex long, n long, k long, place long"


def flatten(width: int):
    """Packed postings of width numbers each -> one row each."""
    names = ["bucket", "h", "vertex", "n", "k", "place", "component"][: width + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, x in zip(batch.column("bucket").to_pylist(), batch.column("x").to_pylist(), strict=True):
                p = np.frombuffer(x, "<i8").reshape(-1, width)
                yield pa.record_batch([pa.array(np.full(len(p), bucket)), *(pa.array(p[:, i].copy()) for i in range(width))], names=names)

    return run
