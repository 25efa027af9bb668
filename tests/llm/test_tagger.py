"""The tagger on texts that its generator didn't make, its limits, and what it reads."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from larder.llm import bilstm_crf, op8_pii

PEOPLE = "Anna Rossi,John Miller,Chiara Bianchi,Peter Schmidt,Sofia Garcia,Luc Moreau,Hannah Weber,Omar Haddad,Grace Okafor,Katarzyna Nowak".split(",")
FIRMS = "northwind,riverside-books,acme,green-valley,city-library,university,kaufhaus,panaderia,open-maps,harbour".split(",")
ENDS = "org,com,net,de,it,fr,es,co.uk,ac.uk,eu".split(",")
LEADS = (
    "The museum opens again in spring and the staff would like to hear from its visitors. You can reach us under {} during the week.",
    "Please send your application to {} before the end of the month, together with a short letter.",
    "Bitte schreiben Sie an {} wenn Sie noch Fragen zum Vertrag haben.",
    "For the minutes of the last meeting contact {}, who keeps the archive of the society.",
    "My new number or address is {}\nand the old one no longer works.",
    "Scrivete a {} per avere il catalogo completo della mostra.",
)
CLEAN = (
    "They met at the station at noon and walked at leisure to the old bridge, where a small dot on the map marked the inn.",
    "The figures of 2019-2023 rose from 1,234,567 to 2,345,678; see table 12.4 and pages 110-125.",
    "We arrived at 10.30 and left at 18.45. At home there was nobody.",
    "The article was published at example.org on 12.12.2020 and read 1 234 567 times.",
    "Version 10.2.33 was released on 2021-05-06 07.08 at last. It fixes issue 12345678901.",
    "He looked at it. Then at dusk, at sea, at 45 degrees, the crew saw land.",
)


def written(rng: random.Random, kind: str) -> str:
    first, last = rng.choice(PEOPLE).lower().split()
    if kind == "email":
        at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[AT]", "."), (" AT ", " DOT "), ("@", "[.]"), ("(at)", "(dot)")])
        name = rng.choice([first, f"{first}.{last}", f"{first[0]}{last}", f"{first}_{last}", f"{first}{dot if dot != '[.]' else '.'}{last}", f"{last}{rng.randint(1, 99)}"])
        return name + at + dot.join([rng.choice(FIRMS), *rng.choice(ENDS).split(".")])
    if kind == "ip":
        return rng.choice(["[.]", " dot ", " (dot) ", "[dot]"]).join(str(rng.randint(1, 254)) for _ in range(4))
    return rng.choice(["({}) {}-{}", "{}-{}-{}", "({}) {} {}", "{} {} {}"]).format(rng.randint(200, 989), rng.randint(200, 999), rng.randint(1000, 9999))


def test_written_forms_in_prose_of_another_kind():
    rng, right, made, wanted = random.Random(3), 0, 0, 0
    texts, spans = [], []
    for _ in range(400):
        kind = rng.choice(["email", "email", "ip", "phone"])
        piece, lead = written(rng, kind), rng.choice(LEADS)
        at = lead.index("{}")
        texts.append(rng.choice(CLEAN) + " " + lead.format(piece) + " " + rng.choice(CLEAN))
        start = texts[-1].index(lead[:at]) + at
        spans.append({(kind, start, start + len(piece))})
    for want, (_, got) in zip(spans, op8_pii.find(texts, op8_pii.default_tagger()), strict=True):
        right, made, wanted = right + len(want & set(got)), made + len(got), wanted + len(want)
    print(f"right {right}, found {made}, wanted {wanted}")
    assert right / made > 0.95 and right / wanted > 0.9, (right, made, wanted)


def test_clean_prose_stays_clean():
    texts = [" ".join(random.Random(i).choices(CLEAN, k=8)) for i in range(100)]
    assert not [s for _, every in op8_pii.find(texts, op8_pii.default_tagger()) for s in every]


@pytest.mark.parametrize("piece", ["anna dot rossi at posta dot org", "anna (dot) rossi (at) posta (dot) org", "anna.rossi@mail.posta[.]org"])
def test_a_local_part_with_written_dots_is_one_span(piece):
    text = f"You can write to {piece} for more"
    base, every = op8_pii.find([text], op8_pii.default_tagger())[0]
    assert [text[a:b] for _, a, b in set(every) - set(base)] == [piece] and set(base) <= set(every)  # a pattern's span inside it stays


def test_a_written_local_part_before_a_plain_address_goes_whole():
    text = "You can write to anna (dot) rossi@posta.org for more"
    base, every = op8_pii.find([text], op8_pii.default_tagger())[0]
    assert [text[a:b] for _, a, b in base] == ["rossi@posta.org"] and set(base) <= set(every)
    assert "anna (dot) rossi@posta.org" in [text[a:b] for _, a, b in every]


def test_kind_and_limits_are_those_of_the_tags(monkeypatch):
    text, tagger = "so anna (at) posta (dot) org is", op8_pii.default_tagger()
    at = text.index("posta")

    def tagged(e, lengths):
        path = np.zeros((1, int(lengths[0])), np.int8)
        path[0, 5:28] = 2  # a run that begins inside the name
        return path

    monkeypatch.setattr(tagger, "best", tagged)
    assert op8_pii.find([text], tagger)[0][1] == []  # cut out of a longer word

    def shorter(e, lengths):
        path = np.zeros((1, int(lengths[0])), np.int8)
        path[0, 3 : text.index(" is")] = 2
        return path

    monkeypatch.setattr(tagger, "best", shorter)
    assert op8_pii.find([text], tagger)[0][1] == [("email", 3, text.index(" is"))] and at > 3
    monkeypatch.setattr(tagger, "best", lambda e, lengths: np.zeros((1, int(lengths[0])), np.int8))
    assert op8_pii.find([text], tagger)[0][1] == []  # the network says no: no pattern adds it


def test_every_span_that_passes_lies_in_what_is_read():
    rng, signs = random.Random(9), ["at", "dot", "(at)", "[dot]", "[.]", "@", ".", " ", " ", " ", "a", "b.c", "x-y", "7", "12", "(", ")", "+", "-", "555", "1234", "\n"]
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(4, 30)))
        read = op8_pii.regions(text)
        for a in range(len(text)):
            for b in range(a + 5, len(text) + 1):
                for kind in op8_pii.KINDS:
                    if op8_pii.passes(kind, text[a:b]) and op8_pii.whole(kind, text, a, b) and not re.search(r"\.[0-9]+\.[0-9]+\.", text[a:b]):
                        assert any(x <= a and b <= y for x, y in read), (text, kind, text[a:b])


def test_candidates_take_linear_time():
    import time

    for text in ("dot " * 250_000, "a dot " * 170_000, "at dot " * 150_000, "a@b." * 250_000, "x" * 1_000_000, "1 " * 500_000, "1.2 dot " * 120_000):
        began = time.time()
        op8_pii.candidates(text)
        assert time.time() - began < 10


def test_the_weights_are_those_of_the_network_and_training_lowers_the_loss():
    tagger = bilstm_crf.Tagger.load(op8_pii.WEIGHTS)
    pairs = [w for text, spans in op8_pii.labelled_examples(60, seed=41) for w in op8_pii.windows_of(text, spans)]
    x, y = np.stack([p[0] for p in pairs]), np.stack([p[1] for p in pairs])
    fresh = bilstm_crf.Tagger(tagger.tags, tagger.hidden)
    before = fresh.gradients(x, y)[0]
    fresh.train(x, y, 3)
    after = fresh.gradients(x, y)[0]
    assert tagger.gradients(x, y)[0] < after < before


def test_gradients_are_those_of_small_steps():
    rng = np.random.default_rng(4)
    tagger = bilstm_crf.Tagger(3, hidden=4)
    x, y = rng.integers(0, bilstm_crf.N_CHARS, (3, 7)), rng.integers(0, 3, (3, 7))
    grads = tagger.gradients(x, y)[1]
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in g.shape) if not name.startswith("X") else (x[rng.integers(3), rng.integers(7)], rng.integers(g.shape[1]))
            kept, losses = tagger.p[name][at], []
            for step in (1e-5, -1e-5):
                tagger.p[name][at] = kept + step
                losses.append(tagger.gradients(x, y)[0])
            tagger.p[name][at] = kept
            assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-3, abs=1e-6), name
