"""Each operator against a brute-force version, over the small tables and over awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from larder.llm import op1_scoring, op2_packing, op3_mixing, op4_jaccard, op5_vectors, op6_quality, op7_chat, op8_pii, op9_rules, op10_sharding, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "size", "n", "chunk", "bucket", "run", "units", "h", "shard", "vertex"]
DOCS = StructType([StructField(c, StringType() if c in ("text", "lang", "source") else LongType()) for c in NAMES])


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids and texts, empty and very long texts, repeated rows, one id with two texts, clashing columns."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(120_000))
    texts = [(1, None), (2, ""), (3, " \n\t "), (None, "a null id is a row too"), (4, "one two three"), (5, "one two three"), (5, "one two three"), (6, long), (6, "another text under the same id"), (7, "mail a@b.co now " * 40), (8, long + " end"), (None, None)]
    return spark.createDataFrame([(i, t, None, "s" if k % 3 else None, None, *[9] * 9) for k, (i, t) in enumerate(texts)], DOCS), texts


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def components(ids, links):
    top = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(top[a], top[b])
            if top[a] != low or top[b] != low:
                top[a] = top[b] = low
                changed = True
    return top


def test_scores_are_those_of_plain_bigram_models(spark, documents):
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    own = {i: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(t or "")] for i, t, _ in documents}
    counts = [Counter(), Counter()]
    totals = [0, 0]
    for i, ws in own.items():
        for side in (0, 1) if i in good else (1,):
            counts[side].update(ws)
            counts[side].update(zip(ws[:-1], ws[1:], strict=True))
            totals[side] += len(ws)
    v = len({w for ws in own.values() for w in ws})
    got = {r.doc_id: r for r in queries.op1_lm_scoring(spark, SF).collect()}
    assert got.keys() == own.keys()
    a, b = op1_scoring.ALPHA, op1_scoring.BACKOFF
    for i, ws in list(own.items())[:60]:
        mine = Counter(ws) + Counter(zip(ws[:-1], ws[1:], strict=True))
        sums = []
        for side in (0, 1):
            out = 1 if side or i in good else 0
            c = lambda g, side=side, out=out: counts[side][g] - out * mine[g]
            loss = 0.0
            for k, w in enumerate(ws):
                p = (c(w) + a) / (totals[side] - out * len(ws) + a * (v + 1))
                if k:
                    joint = c((ws[k - 1], w))
                    p = (joint + b * p) / (max(c(ws[k - 1]), joint) + b)
                loss -= math.log(p)
            sums.append(loss)
        assert got[i].target_loss == pytest.approx(sums[0]) and got[i].background_loss == pytest.approx(sums[1])


def test_pieces_hold_each_id_once_without_gaps(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op2_packing_query(spark, SF).collect()
    of, inside = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        inside[r.sequence_id].append(r)
    for i, t, _ in documents:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(of[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for own in inside.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sorted(inside) == list(range(len(inside)))
    assert sum(r.length for r in rows) > 0.93 * 2048 * len(inside)


def test_a_plan_uses_its_histogram_up_near_the_bound():
    rng = np.random.default_rng(1)
    histogram = {int(n): int(rng.integers(1, 90)) for n in rng.choice(np.arange(1, 257), 60, replace=False)}
    rows = op2_packing.plan(histogram, 256)
    used = Counter()
    for taken, times in rows:
        assert sum(n * c for n, c in taken.items()) <= 256
        for n, c in taken.items():
            used[n] += c * times
    assert used == histogram
    least = math.ceil(sum(n * c for n, c in histogram.items()) / 256)
    assert sum(t for _, t in rows) <= 1.02 * least + 60


def test_the_mix_comes_near_its_targets(spark, documents):
    rows = queries.op3_mixing_query(spark, SF).collect()
    assert rows and sorted(r.doc_id for r in rows) == sorted(i for i, _, _ in documents)
    sizes = Counter()
    for _, t, s in documents:
        sizes[s] += len(WORD.findall(t or ""))
    weight = dict(zip(sorted(sizes), [5, 2, 1] * len(sizes), strict=False))
    target, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
        if not free:
            break
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.size == len(WORD.findall({i: t for i, t, _ in documents}[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)


def test_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 4000, 60)]
    texts = []
    for i in range(160):  # near copies at, above and below the threshold, one common passage, exact copies
        own = list(base) if i % 4 else [f"x{k}" for k in rng.integers(0, 50, 12)] + base[:40]
        for k in rng.integers(0, len(own), rng.integers(0, 4)):
            own[k] = f"y{rng.integers(0, 30)}"
        texts.append((i, " ".join(own)))
    sets = {i: shingles(t) for i, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top = components(sets, links)
    got = op4_jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), top[i]) for i, s in sets.items()}
    assert 1 < len(set(top.values())) < 160


def test_vectors_find_their_links(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    rows = [(i, (centres[i % 40] + 0.1 * rng.standard_normal(32)).tolist(), int(i % 2)) for i in range(800)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    np.fill_diagonal(close, False)
    odd = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [1.0] * 32, None), (904, [1.0, None], 1), (None, [1.0] * 32, 1)]
    got = {r.vec_id: r for r in op5_vectors.near_duplicate_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    found, there = sum(got[i].n_links for i in range(800)), int(close.sum())
    assert 0.98 * there <= found <= there and there > 1000
    assert all(got[i].n_links == 0 for i in (900, 901, 902, 903, 904)) and got[None].component_id is None


def test_links_of_a_dense_group_are_counted_over_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(op5_vectors, "BLOCK", 64)
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal(16) + 0.12 * rng.standard_normal((400, 16))
    vectors[300:] = vectors[200:300]
    x = vectors.astype(np.float32).astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    close = x @ x.T / np.outer(norms, norms) >= 0.98
    want = close.sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in op5_vectors.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()}
    assert want.max() > 200 and [got[i] for i in range(400)] == want.tolist()


def test_links_of_a_large_label_around_one_topic_are_all_found(spark):
    rng = np.random.default_rng(6)
    topic = rng.standard_normal(64)
    topic *= np.sqrt(0.95) / np.linalg.norm(topic)
    noise = lambda n, share: np.sqrt(share / 64) * rng.standard_normal((n, 64))
    x = topic + noise(6000, 0.05)
    x[4000:] = x[:2000] + noise(2000, 0.03)
    x = x.astype(np.float32).astype(np.float64)
    norms = np.sqrt((x * x).sum(1))
    hit = x @ x.T / np.outer(norms, norms) >= 0.98
    np.fill_diagonal(hit, False)
    assert hit.sum() > 2000
    got = {r.vec_id: r for r in op5_vectors.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()}
    assert [got[i].n_links for i in range(6000)] == hit.sum(1).tolist()
    assert {i: got[i].component_id for i in got} == components(range(6000), list(zip(*np.nonzero(hit), strict=True)))


def test_held_out_quality(spark):
    rows = queries.op6_quality_classifier(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    agree = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert agree > 0.9 and len(rows) > 100, agree
    ids = {r.doc_id: r.held_out for r in rows}
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in ids)


def test_chats_come_back_with_attachments(spark):
    part = op7_chat.PART
    turns = spark.sql(
        f"""SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, cast(array(struct('text', 'see <image:1>', null, null, null, null, null), struct('image', null, 'a.png', 57, 28, null, null), struct('audio', null, 'b.wav', null, null, 1.5D, null)) AS array<{part}>) AS parts
        UNION ALL SELECT 1L, 1L, 'assistant', cast(array(struct('text', '\\\\l </turn> é', null, null, null, null, null), struct('document', null, 'c.pdf', null, null, null, 2)) AS array<{part}>)
        UNION ALL SELECT null, null, null, null"""
    )
    made = op7_chat.format_chats(turns)
    row = made.where("conv_id = 1").first()
    assert [(a.number, a.type, a.ref, a.tokens) for a in row.attachments] == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 38), (3, "document", "c.pdf", 1024)]
    assert row.formatted.count("</turn>") == 2 and "<image:1><audio:2></turn>" in row.formatted
    span = row.spans[0]
    assert row.formatted[span["at"] : span["at"] + span.length].endswith("<document:3>")
    assert op7_chat.digest(made).count() == 2


def test_patterns_are_those_given(spark, documents):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fine(kind, s):
        digits = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and op8_pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    plain = lambda t: [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, t) if fine(k, m[0])]
    odd = ["a@b@c.de x@y.z.", "1.2.3.4.5.6.7.8", "300.1.1.1 12.3.4.5", "4111 1111 1111 1111-4111", "+1 (23) 456-78 9", "a.b@c..d e@f.g@h.i", "+12345678901234567", "é@x.yz", "0001.2.3.4"]
    for t in [t or "" for _, t, _ in documents] + odd:
        assert op8_pii.base_spans(t) == plain(t)
    rows = {r.doc_id: r for r in queries.op8_personal_data(spark, SF).collect()}
    for i, t, _ in documents:
        own = plain(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()
        assert rows[i].n_email == sum(k == "email" for k, _, _ in own) and set(op8_pii.told(own).split(",")) <= set(rows[i].spans.split(","))


def test_the_tagger_finds_written_variants():
    text = "Write to anna (at) posta (dot) org or call (555) 123-4567 today; order 20240117 costs 1,234."
    (base, spans), _ = op8_pii.find([text, "nothing here"], op8_pii.default_tagger())
    assert base == [] and {text[a:b] for _, a, b in spans} == {"anna (at) posta (dot) org", "(555) 123-4567"}


@pytest.mark.parametrize("piece", ["name (at) mail.department (dot) some-university (dot) ac (dot) uk", "a-very-long-local-part.of.an.address.which.goes.on (at) example (dot) org", "x at y dot org", "john.doe (AT) example.com", "name@host[.]com", "192[.]168[.]10[.]4", "10 (dot) 20 (dot) 30 (dot) 40", "555-123-4567", "030 123 4567"])
def test_written_variants_are_found_whole(piece):
    text = f"Say it: {piece} and go"
    assert [text[a:b] for _, a, b in op8_pii.find([text], op8_pii.default_tagger())[0][1]] == [piece]


def test_what_only_looks_like_personal_data_stays():
    texts = ["look at the house. Then go at noon", "we met at example.org on 12.12.2020", "card 4111 1111 1111 1112 no", "on 2024-01-01 12.30 and 2023-10-10 11:12"]
    assert [s for _, s in op8_pii.find(texts, op8_pii.default_tagger())] == [[]] * 4


def test_rules_count_whole_texts(spark, documents):
    rows = {r.doc_id: r for r in queries.op9_quality_rules(spark, SF).collect()}
    for i, t, _ in documents:
        words = WORD.findall(t or "")
        seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        marked = {k + j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked))
        assert tuple(rows[i][c] for c in op9_rules.BASE) == want
        assert rows[i].base_failed == (len(words) < 20 or 100 * len(marked) > 30 * len(words)) and not (rows[i].kept and rows[i].base_failed)
    assert op9_rules.posteriors({}) == {}
    good = "".join("2" for _ in op9_rules.RULES)
    bad, noisy = "000" + good[3:], good[:-1] + "0"
    p = op9_rules.posteriors({int(good, 3): 700, int(bad, 3): 250, int("00" + good[2:], 3): 40, int(noisy, 3): 10})
    assert p[int(good, 3)] > 0.5 > p[int(bad, 3)] and p[int(noisy, 3)] > 0.5  # one rule alone doesn't reject


def test_shards_move_only_to_the_new_one(spark, documents):
    rows = queries.op10_sharding_query(spark, SF).collect()
    slots = defaultdict(list)
    for r in rows:
        text = {i: t for i, t, _ in documents}[r.doc_id] or ""
        assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode()) and r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keys = np.arange(40_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    now, more = op10_sharding.jump_hash(keys, 40), op10_sharding.jump_hash(keys, 41)
    assert np.bincount(now).min() > 850 and 0.02 < (now != more).mean() < 0.03 and set(more[now != more]) == {40}


def test_awkward_rows_and_empty_tables(spark, awkward, empty):
    df, texts = awkward
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    runs = {
        "scores": lambda d: op1_scoring.cross_entropy_difference(d, labels.where("quality = 1").select("doc_id")),
        "mix": op3_mixing.mix, "near": op4_jaccard.near_duplicates, "quality": lambda d: op6_quality.classify(d, labels),
        "pii": op8_pii.find_personal_data, "redact": op8_pii.redact, "rules": op9_rules.score, "shards": op10_sharding.shard_documents,
    }
    for name, run in runs.items():
        got = run(df)
        assert Counter(r["doc_id"] for r in got.collect()) == Counter(i for i, _ in texts), name
        assert run(empty).collect() == [], name
    tok = queries.tokenizer_path()
    assert {r.doc_id for r in op2_packing.pack(df, tok).collect()} == {i for i, _ in texts} and op2_packing.pack(empty, tok).collect() == []
    assert op9_rules.keep_good(empty).collect() == [] and op9_rules.keep_good(df).columns == df.columns
    near = {(r.doc_id, r.n_shingles): r.component_id for r in op4_jaccard.near_duplicates(df).collect()}
    assert near[1, 0] == 1 and near[4, 1] == near[5, 1] == 4 and near[8, 119_997] == near[6, 119_996] == 6
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert op5_vectors.near_duplicate_vectors(none).collect() == []
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op7_chat.format_chats(chats.select("conv_id", "turn", "role", op7_chat.text_parts(F.col("text")).alias("parts"))).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_says_what_its_sql_says(name, spark, duck, same):
    same(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name])


def test_the_pipeline_is_its_stages_one_after_the_other(spark, documents):
    import corpus_pipeline
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mix", "packing"]
    kept = {r.doc_id for r in queries.op9_quality_rules(spark, SF).where("kept").collect()}
    docs = {i: t for i, t, _ in documents if i in kept}
    sets = {i: shingles(t) for i, t in docs.items()}
    top = components(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    tagger, tok = op8_pii.default_tagger(), Tokenizer.from_file(queries.tokenizer_path())
    lengths = {}
    for i, t in docs.items():
        if top[i] == i:
            out, at = "", 0
            for kind, a, b in sorted(op8_pii.find([t or ""], tagger)[0][1], key=lambda s: (s[1], -s[2])):
                if a >= at:
                    out += (t or "")[at:a] + f"<{kind.upper()}>"
                at = max(at, b)
            lengths[i] = len(tok.encode(out + (t or "")[at:], add_special_tokens=False).ids) + 1
    total = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        total[r.doc_id] += r.length
        assert r.doc_tokens == lengths[r.doc_id]
    assert all(total[i] in (n, 2 * n) for i, n in ((i, lengths[i]) for i in total)) and len(total) > 0.5 * len(lengths)
