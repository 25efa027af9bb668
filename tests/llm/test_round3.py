"""Merkle manifest, hard negatives and byte-level BPE against brute force, awkward rows and empty tables."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import op4_jaccard, op5_vectors, op11_manifest, op12_negatives, op13_bpe, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, idx long, node string, part int, path string, ids long, bytes string, place long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), *["x", 9, "x", 9, "x", 9, "x", 9]) for i, t, lang in rows], DOCS)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, arity):
    """Digest on top and, for each leaf, its (left, right) at every level."""
    steps, level, of = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, at in enumerate(of):
            start = at // arity * arity
            steps[k].append(("".join(level[start:at]), "".join(level[at + 1 : start + arity])))
        level, of = [h(*level[k : k + arity]) for k in range(0, len(level), arity)], [at // arity for at in of]
    return (level[0] if level else None), steps


def plain_manifest(rows, arity):
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for i, t, lang in rows:
        n = None if t is None else len(t)
        changed = n if n is None or i is None or zlib.crc32(str(i).encode()) % 7 else n + 1
        leaf, claimed = (h(show(i), show("s"), show(lang), show(x), show(t)) for x in (n, changed))
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf, claimed, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: r[:3])
        trees[g] = plain_tree([r[2] for r in groups[g]], arity)
    root, above = plain_tree([trees[g][0] for g in names], arity)
    out = []
    for g, more in zip(names, above, strict=True):
        for (_, _, leaf, claimed, i), own in zip(groups[g], trees[g][1], strict=True):
            folded = claimed
            for left, right in own + more:
                folded = h(left, folded, right)
            out.append((i, leaf, trees[g][0], root, h(*(a + b for a, b in own + more)), folded, folded == root))
    return out


@pytest.mark.parametrize(("arity", "block"), [(2, 256), (2, 4), (3, 9)])
def test_manifest_is_that_of_a_plain_tree(spark, monkeypatch, arity, block):
    monkeypatch.setattr(op11_manifest, "BLOCK", block)
    rows = [(i, f"text {i} é", ("en", "de", None, "zh")[i % 7 % 4]) for i in range(61)] + [(5, "again", "en")] * 9 + [(None, "no id", "en"), (None, None, "en"), (900, "", "one"), (901, "w " * 100_000, "")]
    docs = documents(spark, rows).repartition(5)
    changed = F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    got = op11_manifest.verify(op11_manifest.manifest(docs, tampered={"n_chars": changed}, arity=arity)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows, arity))
    assert 0 < sum(r.verified for r in got) < len(got)


def test_manifest_of_one_row_and_of_none(spark):
    one = op11_manifest.verify(op11_manifest.manifest(documents(spark, [(1, "a", None)]))).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h() and one.verified
    assert op11_manifest.verify(op11_manifest.manifest(documents(spark, []))).collect() == []


def plain_negatives(rows, anchors, percent=80, most=5):
    """Rows (id, label, vector) that take part -> result rows, products in Python integers."""
    out = []
    for a, (i, label, x) in enumerate(rows):
        if not anchors(i):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), j, other == label) for b, (j, other, y) in enumerate(rows) if b != a and len(y) == len(x))
        for rank, (s, j, _) in enumerate([r for r in scored if r[2]][:most], 1):
            fit = [r for r in scored if not r[2] and percent * -s <= 100 * -r[0] <= 100 * -s][:most]
            out += [(i, j, rank, k, n, -s, -t) for k, (t, n, _) in enumerate(fit, 1)]
    return out


@pytest.mark.parametrize("blocks", [(1 << 20, 1 << 18), (1 << 10, 1 << 7)])
def test_negatives_are_those_of_all_products(spark, monkeypatch, blocks):
    monkeypatch.setattr(op12_negatives, "ROWS", blocks[0])
    monkeypatch.setattr(op12_negatives, "ANCHORS", blocks[1])
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 24)) @ np.diag(1 / (1 + np.arange(24))) + 0.4
    labels = rng.choice(4, 700, p=[0.6, 0.2, 0.1, 0.1]).tolist()
    vectors = x.astype(np.float32).astype(float).tolist()
    vectors[40:80] = [vectors[7]] * 40  # equal scores
    vectors[90:95] = [[0.0] * 24] * 5
    rows = list(zip(range(700), labels, vectors, strict=True)) + [(20, 1, vectors[20])] * 3 + [(800 + k, k % 2, [1.5, k / 9]) for k in range(30)] + [(900 + k, k % 2, []) for k in range(12)]
    awkward = [(1000, None, vectors[1]), (1010, 1, None), (1020, 1, [None, *vectors[1][1:]]), (1030, 1, [float("nan"), *vectors[1][1:]]), (1040, 1, [float("inf"), *vectors[1][1:]]), (1050, 1, [1e9, 0.0])]
    wide = [(*r, 1, 2, 3, 4) for r in rows + awkward]
    random.Random(1).shuffle(wide)
    df = spark.createDataFrame(wide, "vec_id long, label int, embedding array<double>, slice int, place long, dim int, rank int").repartition(7)
    got = op12_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    whole = [(i, label, [int(np.floor(256 * v)) for v in x]) for i, label, x in rows]
    want = plain_negatives(whole, lambda i: i % 10 == 0)
    assert len(want) > 500 and Counter(map(tuple, got)) == Counter(want)


def test_bounds_drop_most_pairs_and_no_needed_one():
    rng = np.random.default_rng(4)
    x = np.floor(256 * (rng.standard_normal((3000, 32)) * np.linspace(2, 0.05, 32) @ np.linalg.qr(rng.standard_normal((32, 32)))[0])).astype(np.int64)
    rotation = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    a, b, kept = op12_negatives.Bounds(x[:50], rotation), op12_negatives.Bounds(x, rotation), 0
    exact = x[:50] @ x.T
    keep = lambda i, low, high, alive: alive & (high >= op12_negatives.at_least(np.where(alive, low, -np.inf), 5)[:, None])
    for i, j, score in op12_negatives.tiles(a, b, lambda i: np.ones((len(i), 3000), bool), keep):
        assert (exact[i, j] == score).all()
        for k in np.unique(i):
            assert sorted(score[i == k])[-5:] == sorted(exact[k])[-5:]
        kept += len(i)
    assert kept < 0.01 * exact.size
    first = a.y[:, : a.steps[0]] @ b.y[:, : a.steps[0]].T
    assert (np.abs(exact - first) <= np.outer(a.rest[0], b.rest[0]) + a.slack * np.outer(a.norm, b.norm) + 1e-6).all()


def test_no_negatives_of_an_empty_table_or_without_anchors(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert op12_negatives.hard_negatives(empty, F.lit(True)).collect() == []
    one = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], empty.schema)
    assert op12_negatives.hard_negatives(one, F.lit(False)).collect() == op12_negatives.hard_negatives(one, F.lit(True)).collect() == []


@pytest.fixture(scope="module")
def byte_bpe():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def awkward_texts():
    rng = random.Random(7)
    alphabet = "ab- \n'sé中\xa0\x85\x1c　\t.,Z9\r̈́😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice(["don", "'t", "'s", " ", "\xa0", "  ", "(", ".", "I'", "ll", "LL", "é", "’"]) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    texts += [c * n for c in ("-", "=", "ab", " ", "\n", "\r\n", "0", "_", "é", "aa b") for n in range(1, 130, 3)]
    return [None, "", " ", "\n", "<|endoftext|>", "long words " * 60_000, "x" * 300_000, *texts]


def test_ids_are_those_of_the_rank_file_and_decode_to_the_text(spark, byte_bpe):
    path, pattern, plain = byte_bpe
    texts = awkward_texts() + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = documents(spark, [(None if k % 50 == 1 else k // 2, t, None) for k, t in enumerate(texts)]).repartition(3)
    got = op13_bpe.decode(op13_bpe.encode(docs, path, pattern), path, pattern).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((None if k % 50 == 1 else k // 2, t or "") for k, t in enumerate(texts))
    for r in got:
        assert r.ids == plain.encode_ordinary(r.text) and bytes(r.bytes) == r.text.encode()
        assert len(r.starts) == len(r.ends) == len(r.ids)
        if len(r.ids) < 5000:
            at = 0
            for one, start, end in zip(r.ids, r.starts, r.ends, strict=True):  # the span holds the token's bytes and no character more
                n = len(plain.decode_single_token_bytes(one))
                assert len(r.text[:start].encode()) <= at and at + n <= len(r.text[:end].encode())
                assert len(r.text[: start + 1].encode()) > at and len(r.text[: end - 1].encode()) < at + n
                at += n
    want = Counter((r.doc_id, len(r.ids), hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest(), h(r.text)) for r in got)
    assert Counter(map(tuple, op13_bpe.round_trip(docs, path, pattern).collect())) == want


def test_a_small_part_size_changes_no_id(byte_bpe, monkeypatch):
    path, pattern, plain = byte_bpe
    monkeypatch.setattr(op13_bpe, "PART", 40)
    monkeypatch.setattr(op13_bpe, "KEPT", 300)
    texts = [t for t in awkward_texts() if t is not None and len(t) < 1000]
    texts = [" ".join(texts[k : k + 9]) for k in range(0, len(texts), 9)]
    assert [i.tolist() for i in op13_bpe.ByteCoder(path, pattern).encode(texts)] == plain.encode_ordinary_batch(texts)


def test_split_characters_and_unknown_ids(spark, byte_bpe):
    path, pattern, plain = byte_bpe
    code = op13_bpe.ByteCoder(path, pattern)
    text = "a😀b 中国 naïve 🧪🧪"
    ids = code.encode([text])[0]
    for k in range(len(ids) + 1):
        assert code.decode(ids[:k]) + code.decode(ids[k:]) == text.encode()
        assert "".join(code.pieces(ids[:k])) == code.decode(ids[:k]).decode("utf-8", "replace")
    assert "�" not in "".join(code.pieces(ids)) and "" in code.pieces(ids) and "�" in "".join(code.pieces(ids[:2]))
    rows = spark.createDataFrame([(1, [50_256, -1, 64]), (2, None), (3, []), (4, [64, None])], "doc_id long, ids array<int>")
    assert [(r.doc_id, r.text) for r in op13_bpe.decode(rows, path, pattern).orderBy("doc_id").collect()] == [(1, "��a"), (2, None), (3, ""), (4, "a�")]
    assert op13_bpe.round_trip(documents(spark, []), path, pattern).collect() == []


def test_queries_cover_their_tables(spark):
    docs, vectors = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/embeddings.parquet")
    for name in ("op11_merkle_manifest", "op13_byte_bpe"):
        assert sorted(r.doc_id for r in queries.queries()[name](spark, SF).collect()) == sorted(r.doc_id for r in docs.collect())
    got = queries.op12_hard_negatives(spark, SF).collect()
    moved = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(v))) for v in r.embedding]) for r in vectors.collect()]
    assert Counter(map(tuple, got)) == Counter(plain_negatives(moved, lambda i: i % 100 == 0))


def test_postings_follow_the_hashes_and_not_the_buckets():
    rng = np.random.default_rng(9)
    owner, h = np.sort(rng.integers(0, 60_000, 200_000)).astype("<u4"), rng.integers(0, 2**63, 200_000, dtype=np.uint64) * np.uint64(2)
    for buckets in (256, 131_072):
        bucket, total = op4_jaccard.high_bits(h, buckets), 0
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)):
            own = owner[order[edges[k] : edges[k + 1]]]
            steps = op4_jaccard.owner_steps(own)
            assert (op4_jaccard.owners_of(steps) == own).all()
            total += len(steps)
        assert total == 2 * len(owner)


def test_passes_lose_no_planted_link_among_close_topics(spark):
    rng = np.random.default_rng(21)
    topics = rng.standard_normal((8, 64))
    topics /= np.linalg.norm(topics, axis=1, keepdims=True)
    own = rng.standard_normal((8 * 700, 64))
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    x = np.sqrt(0.95) * np.repeat(topics, 700, axis=0) + np.sqrt(0.05) * own
    for k in range(60):
        x[90 * k + 1] = x[90 * k] + 0.018 * rng.standard_normal(64)
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    df = spark.createDataFrame([(k, v.tolist(), 3) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(6)
    got = {r.vec_id: r.n_links for r in op5_vectors.near_duplicate_vectors(df).collect()}
    assert want.sum() >= 100 and [got[k] for k in range(len(x))] == want.tolist()
    whole = {r.vec_id: r.component_id for r in op5_vectors.near_duplicate_vectors(df, exact_up_to=10_000).collect()}
    passes = {r.vec_id: r.component_id for r in op5_vectors.near_duplicate_vectors(df).collect()}
    assert whole == passes
