"""The additive model's fit and features against a plain restatement, row by row."""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import op6_quality
from larder.llm.measure import measure


def plain_fit(x, y, rounds, rate, leaves, bins, coarse, n_pairs):
    """Score function of cyclic boosting written with loops over rows: no histograms, no cumulative sums."""
    n, m = len(x), len(x[0])

    def edges(j, k):
        column, out = sorted(row[j] for row in x), []
        for i in range(1, k):
            at = (n - 1) * (i / k)
            low = int(math.floor(at))
            high = min(low + 1, n - 1)
            out.append(column[low] + (column[high] - column[low]) * (at - low))
        return sorted(set(out))

    fine, wide = [edges(j, bins) for j in range(m)], [edges(j, coarse) for j in range(m)]
    place = lambda v, cuts: sum(e <= v for e in cuts)
    f = [[place(row[j], fine[j]) for j in range(m)] for row in x]
    w = [[place(row[j], wide[j]) for j in range(m)] for row in x]
    share = (sum(y) + 1) / (n + 2)
    base = math.log(share / (1 - share))
    raw = [base] * n
    tables = [[0.0] * (len(e) + 1) for e in fine]
    slopes = lambda: [(t - p, p * (1 - p)) for t, p in ((t, 1 / (1 + math.exp(-r))) for t, r in zip(y, raw, strict=True))]
    gain = lambda s: sum(g for g, _ in s) ** 2 / (sum(h for _, h in s) + 1)
    step_of = lambda s: sum(g for g, _ in s) / (sum(h for _, h in s) + 1)
    for _ in range(rounds):
        for j, table in enumerate(tables):
            if len(table) < 2:
                continue
            s, cuts = slopes(), [0, len(table)]
            within = lambda a, b, j=j, s=s: [s[i] for i in range(n) if a <= f[i][j] < b]
            while len(cuts) <= leaves:
                found = [(gain(within(a, c)) + gain(within(c, b)) - gain(within(a, b)), c) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for c in range(a + 1, b)]
                found = [v for v in found if v[0] > 1e-6]
                if not found:
                    break
                top = max(v for v, _ in found)
                cuts = sorted([*cuts, min(c for v, c in found if v >= top - 1e-12)])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                add = rate * step_of(within(a, b))
                for k in range(a, b):
                    table[k] += add
                for i in range(n):
                    raw[i] += add if a <= f[i][j] < b else 0

    def quarters(i, j):
        s, best = slopes(), (0.0, None)
        for a in range(1, len(wide[i]) + 1):
            for b in range(1, len(wide[j]) + 1):
                blocks = {(p, q): [s[k] for k in range(n) if (w[k][i] >= a) == p and (w[k][j] >= b) == q] for p in (False, True) for q in (False, True)}
                got = sum(gain(v) for v in blocks.values())
                if got > best[0] + 1e-12:
                    best = (got, {k: step_of(v) for k, v in blocks.items()} | {"at": (a, b)})
        return best

    ranked = sorted(((quarters(i, j)[0], i, j) for i, j in combinations(range(m), 2)), reverse=True)[:n_pairs]
    pairs = {(i, j): {} for _, i, j in ranked}
    for _ in range(rounds // 4):
        for (i, j), table in pairs.items():
            _, steps = quarters(i, j)
            if steps is None:
                continue
            a, b = steps["at"]
            for p in range(len(wide[i]) + 1):
                for q in range(len(wide[j]) + 1):
                    table[p, q] = table.get((p, q), 0.0) + rate * steps[p >= a, q >= b]
            for k in range(n):
                raw[k] += rate * steps[w[k][i] >= a, w[k][j] >= b]

    def score(row):
        total = base + sum(tables[j][place(row[j], fine[j])] for j in range(m))
        total += sum(t.get((place(row[i], wide[i]), place(row[j], wide[j])), 0.0) for (i, j), t in pairs.items())
        return 1 / (1 + math.exp(-total))

    return tables, pairs, score


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_fit_is_that_of_plain_boosting(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((90, 4)), 3)
    x[:, 3] = 1.0  # a feature that says nothing
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(90) < 0.1)).astype(float)
    monkeypatch.setattr(op6_quality, "BINS", 9)
    monkeypatch.setattr(op6_quality, "COARSE", 4)
    monkeypatch.setattr(op6_quality, "PAIRS", 2)
    model = op6_quality.fit(x, y, rounds=8, rate=0.3, leaves=3)
    tables, pairs, score = plain_fit(x.tolist(), y.tolist(), 8, 0.3, 3, 9, 4, 2)
    assert list(pairs) == list(model.pair_tables) and (0, 1) in pairs
    for got, want in zip(model.tables, tables, strict=True):
        assert got == pytest.approx(want, abs=1e-9)
    for k, table in model.pair_tables.items():
        assert [v for row in table for v in row] == pytest.approx([pairs[k].get((p, q), 0.0) for p in range(table.shape[0]) for q in range(table.shape[1])], abs=1e-9)
    fresh = rng.standard_normal((40, 4))
    assert model.score(fresh) == pytest.approx([score(r) for r in fresh.tolist()], abs=1e-9)


def test_features_of_plain_texts():
    texts = ["One two, two THREE!\nfour | five 66\n\nOne two, two THREE!", "", "word", "a b c d e f g h a b c d e f g h"]
    got = dict(zip(op6_quality.FEATURES, op6_quality.features(measure(pa.array(texts))).T, strict=True))
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, chars = len(words), sum(map(len, words))
        per = lambda a, b: a / max(b, 1)
        assert got["length"][i] == pytest.approx(math.log1p(n)) and got["word_length"][i] == pytest.approx(per(chars, n))
        assert got["symbols"][i] == pytest.approx(per(len(re.findall(r"[#*$%&|<>]", t)), chars))
        assert got["pipes"][i] == pytest.approx(per(t.count("|"), n)) and got["exclaims"][i] == pytest.approx(per(t.count("!"), n)) and got["commas"][i] == pytest.approx(per(t.count(","), n))
        assert got["digits"][i] == pytest.approx(per(len(re.findall("[0-9]", t)), chars))
        windows = [tuple(words[k : k + 8]) for k in range(n - 7)]
        twice = {k + d for k, v in enumerate(windows) if windows.count(v) > 1 for d in range(8)}
        assert got["repeats"][i] == pytest.approx(per(len(twice), n))
        assert np.isfinite([got[k][i] for k in got]).all()
