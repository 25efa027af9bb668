"""Repeated, null and hot rows, several partitions, and plain restatements of the models."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import bilstm_crf, op2_packing, op3_mixing, op4_jaccard, op5_vectors, op6_quality, op7_chat, op8_pii, op9_rules, op10_sharding, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def base(k, n=40):
    return " ".join(f"w{k}x{i}" for i in range(n))


def test_special_tokens_keep_their_case():
    from tokenizers import Tokenizer

    tokenizer, code = Tokenizer.from_file(queries.tokenizer_path()), op2_packing.WordCoder(queries.tokenizer_path())
    for text in ("<|ENDOFTEXT|>", "<|endoftext|>", "a<|EndOfText|>b <|startoftext|> C", "<|STARTOFTEXT|>,x", "Plain Words, THEN <|endoftext|>. Don't", "É <|endofTEXT|> ÄB", "<|", "ENDOFTEXT"):
        assert np.frombuffer(code.text(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_repeated_rows_are_one_set(spark):
    near = base(1)[:-6] + " other"
    rows = [(i, base(1), "a") for i in range(300)] + [(1000 + i, near, "a") for i in range(300)] + [(5, base(2), "a")] * 200 + [(6, base(3), "a"), (6, base(4), "a"), (None, base(1), "a")]
    got = op4_jaccard.near_duplicates(documents(spark, rows).repartition(7)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(i, 0) for i in [*range(300), *range(1000, 1300)] if i not in (5, 6)] + [(5, 0), (6, 0)] + [(5, 5)] * 200 + [(6, 6)] * 2 + [(None, None)])


def test_many_rounds_of_stars_find_all_links(spark, monkeypatch):
    monkeypatch.setattr(op4_jaccard, "CROWDED", 0)
    rng = np.random.default_rng(8)
    texts = []
    for i in range(240):
        own = [f"w{i % 3}x{k}" for k in range(60)]
        for k in rng.integers(0, 60, rng.integers(0, 3)):
            own[k] = f"y{rng.integers(0, 9)}"
        texts.append((i, " ".join(own), "a"))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t, _ in texts}
    top = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and top[a] != top[b]:
                    top[a] = top[b] = min(top[a], top[b])
                    changed = True
    got = {r.doc_id: r.component_id for r in op4_jaccard.near_duplicates(documents(spark, texts)).collect()}
    assert got == top


def test_the_mix_meets_its_target_with_repeated_rows(spark):
    rows = [(1, " ".join(["w"] * 40), "a")] * 2000 + [(10 + i, " ".join(["w"] * 400), "a") for i in range(200)] + [(None, "x y", "b")] * 50 + [(7000, None, None)]
    df = documents(spark, rows).repartition(5)
    for weights in ((5, 2, 1), (1, 1, 1)):
        got = op3_mixing.mix(df, weights, share=0.9).collect()
        taken = Counter()
        for r in got:
            taken[r.source] += r.taken
        for source, target in {(r.source, r.target) for r in got}:
            assert abs(taken[source] - target) <= max(r.size for r in got if r.source == source) / 2 + 1e-9
    again = op3_mixing.mix(df, (5, 2, 1), share=0.9).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, op3_mixing.mix(df, (5, 2, 1), share=0.9).collect()))


def test_sources_are_capped_and_ranked_by_code_point(spark):
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(10, "Z"), (1000, "a"), (30, "é"), (200, None), (50, "b")])]
    got = {r.source: r.target for r in op3_mixing.mix(documents(spark, rows), share=1.5).collect()}
    sizes, weight = {"Z": 10, "a": 1000, "b": 50, "é": 30, None: 200}, {"Z": 5, "a": 2, "b": 1, "é": 5, None: 2}
    left, free, want = 1.5 * 1290, set(sizes), {}
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]}:
        want |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert got == pytest.approx(want)


def test_the_pipeline_stages_take_awkward_rows(spark):
    long = base(9, 5000)
    rows = [(1, base(1), "a"), (1, base(1), "a"), (None, base(1), "b"), (None, base(2), None), (None, base(2), None), (3, None, "a"), (4, "", "a"), (4, long, "a"), (5, long, "b"), (6, base(1) + " tail", "b")]
    df, empty = documents(spark, rows), documents(spark, [])
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert Counter(r.text for r in kept) == Counter({base(1): 1, base(2): 1, None: 1, "": 1, long: 1})
    mixed = corpus_pipeline.source_mix(spark, df, "")
    assert mixed.columns == df.columns
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    for r in mixed.collect():
        taken[r.source] += len((r.text or "").split())
    assert all(taken[s] <= 2 * sizes[s] for s in sizes) and sum(taken.values()) > 0
    assert sum(r.length for r in corpus_pipeline.packing(spark, df, "").collect()) >= len(rows)
    assert [r.text for r in corpus_pipeline.personal_data(spark, df, "").collect()] == [t for _, t, _ in rows]
    good = corpus_pipeline.quality_rules(spark, df, "")
    assert good.columns == df.columns and not {None, ""} & {r.text for r in good.collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []


def test_vectors_over_partitions_repeats_and_clashing_names(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((300, 16))
    x[150:] = x[:150] + 0.03 * rng.standard_normal((150, 16))
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist(), 1, 9, 9, 9, 9) for i, v in enumerate(x)] + [(7, x[7].tolist(), 1, 9, 9, 9, 9)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, vertex int, component int, block int, star int").repartition(11)
    every = np.vstack([x, np.repeat(x[7:8], 3, axis=0)])
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    got = op5_vectors.near_duplicate_vectors(df).collect()
    ids = [*range(300), 7, 7, 7]
    assert Counter((r.vec_id, r.n_links) for r in got) == Counter(zip(ids, links.tolist(), strict=True))
    assert links.sum() > 280


def test_the_tagger_on_held_out_spans():
    held, right, made, wanted = op8_pii.labelled_examples(400, seed=77), 0, 0, 0
    for (_, spans), (_, found) in zip(held, op8_pii.find([t for t, _ in held], op8_pii.default_tagger()), strict=True):
        right, made, wanted = right + len(set(spans) & set(found)), made + len(found), wanted + len(spans)
    assert right / made > 0.93 and right / wanted > 0.92, (right, made, wanted)


def test_a_path_is_the_best_of_all_paths():
    import itertools

    tagger, rng = bilstm_crf.Tagger(3), np.random.default_rng(2)
    e, lengths = rng.standard_normal((5, 4, 3)), np.array([5, 3, 1, 4])
    path, sure = tagger.paths(e, lengths)
    for i, n in enumerate(lengths):
        score = lambda p, i=i: tagger.p["S"][p[0]] + sum(e[t, i, k] for t, k in enumerate(p)) + sum(tagger.p["T"][a, b] for a, b in zip(p[:-1], p[1:], strict=True))
        every = {p: score(p) for p in itertools.product(range(3), repeat=int(n))}
        best, total = max(every, key=every.get), sum(math.exp(v) for v in every.values())
        assert tuple(path[i, :n]) == best
        assert sure[i, :n] == pytest.approx([sum(math.exp(v) for p, v in every.items() if p[t] == best[t]) / total for t in range(n)])


def test_long_stretches_are_decoded_in_parts(monkeypatch):
    text = "call +39 055 1234567 or " + "12 34 5678 " * 60 + "mail anna (at) posta (dot) org, " + "7 " * 200 + "(555) 123-4567 end"
    tagger = op8_pii.default_tagger()
    whole = op8_pii.find([text], tagger)
    monkeypatch.setattr(op8_pii, "PART", 256)
    assert op8_pii.find([text], tagger) == whole and any(k == "email" for k, _, _ in whole[0][1])


def test_jump_hash_is_that_of_one_key_at_a_time():
    def jump(key, buckets):
        b, j = -1, 0
        while j < buckets:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    for n in (1, 2, 40, 41, 1000):
        assert op10_sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_a_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = op6_quality.fit(x, y)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        raw = model.intercept + sum(t[sum(v >= e for e in edges)] for t, edges, v in zip(model.tables, model.edges, row, strict=True))
        wide = [sum(v >= e for e in edges) for edges, v in zip(model.coarse, row, strict=True)]
        raw += sum(t[wide[i], wide[j]] for (i, j), t in model.pair_tables.items())
        assert score == pytest.approx(1 / (1 + math.exp(-raw)))
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_posteriors_are_those_of_documents_one_by_one():
    rng, rules = np.random.default_rng(4), 4
    good = rng.random(500) < 0.7
    votes = np.where(good[:, None], rng.choice(3, (500, rules), p=[0.05, 0.25, 0.7]), rng.choice(3, (500, rules), p=[0.6, 0.3, 0.1]))
    codes = (votes * 3 ** np.arange(rules - 1, -1, -1)).sum(axis=1)
    got = op9_rules.posteriors(dict(Counter(codes.tolist())), rules)
    p = [0.02 if 0 in v else 0.98 for v in votes.tolist()]
    for _ in range(200):
        seen = [[[0.5 + (0.5 * sum(w[r] == 0 for w in votes) if side and v == 0 else 0) for v in range(3)] for r in range(rules)] for side in (0, 1)]
        for q, doc in zip(p, votes.tolist(), strict=True):
            for r, v in enumerate(doc):
                seen[0][r][v] += q
                seen[1][r][v] += 1 - q
        prior = math.log((sum(p) + 1) / (len(p) - sum(p) + 1))
        odds = [prior + sum(math.log(seen[0][r][v] / sum(seen[0][r])) - math.log(seen[1][r][v] / sum(seen[1][r])) for r, v in enumerate(doc)) for doc in votes.tolist()]
        new = [1 / (1 + math.exp(-o)) for o in odds]
        if max(abs(a - b) for a, b in zip(new, p, strict=True)) < 1e-9:
            break
        p = new
    assert [got[c] for c in codes.tolist()] == pytest.approx(p, abs=1e-6)
    assert (np.array(p) >= 0.5).astype(bool).tolist() == [g >= 0.5 for g in [got[c] for c in codes.tolist()]] and ((np.array(p) >= 0.5) == good).mean() > 0.9


def test_chats_of_awkward_rows(spark):
    long = "word <x> \\ " * 30_000
    rows = [(1, None, None, None, 9), (1, 1, "user", "", 9), (1, 1, "user", "", 9), (2, 0, "assistant", long, 9), (None, 0, "user", "no id", 9), (None, 1, "assistant", "</turn>", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, number int")
    chats = op7_chat.digest(op7_chat.format_chats(df.select("conv_id", "turn", "role", op7_chat.text_parts(F.col("text")).alias("parts"), "number")))
    got = {r.conv_id: r for r in chats.collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, 2: 1, None: 2} and got[2].loss_chars == len(long) and got[None].loss_chars == 7


def test_values_of_awkward_rows(spark):
    from tokenizers import Tokenizer

    long = base(7, 9000)
    rows = [(1, None, "a"), (2, "", "a"), (None, "no id", None), (4, base(1), "b"), (4, base(1), "b"), (4, long, "b"), (5, long + " end", "a"), (None, None, None)]
    df = documents(spark, rows).withColumns({c: F.lit(9) for c in ("h", "g", "place", "part", "shard", "pattern", "n", "units", "th", "vertex", "rank", "its")})
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    lengths = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows)
    pieces = op2_packing.pack(df, queries.tokenizer_path()).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == lengths and sum(r.length for r in pieces) == sum(n * k for (_, n), k in lengths.items())
    mixed = op3_mixing.mix(df).collect()
    assert Counter((r.doc_id, r.size) for r in mixed) == Counter((i, len((t or "").split())) for i, t, _ in rows) and all(0 <= r.taken <= 2 * r.size for r in mixed)
    shards = op10_sharding.shard_documents(df, 3).collect()
    for k in range(3):
        assert sorted(r.slot for r in shards if r.shard == k) == list(range(sum(r.shard == k for r in shards)))
    assert Counter((r.doc_id, r.size) for r in shards) == Counter((i, len((t or "").encode()) + 16) for i, t, _ in rows)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    scored = op6_quality.classify(df, labels).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert len({r.score for r in scored if r.doc_id in (1, 2)}) == 1
    found = {(r.doc_id, r.spans) for r in op8_pii.find_personal_data(df).collect()}
    assert found == {(i, "") for i, _, _ in rows}
    kept = op9_rules.score(df)
    assert Counter((r.doc_id, r.n_words) for r in kept.collect()) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    prose = documents(spark, [(i, "The quick brown fox jumps over a lazy dog near the old river bank, and then it rests for a while under green trees." if i % 3 else "# # " * 30, "a") for i in range(60)])
    assert {(r.doc_id, r.kept) for r in op9_rules.score(prose).collect()} == {(i, i % 3 > 0) for i in range(60)}
    assert sorted(r.doc_id for r in op9_rules.keep_good(prose).collect()) == [i for i in range(60) if i % 3]
