"""Personal data: patterns for the plain forms, a character BiLSTM-CRF for written variants of them.

The tagger is trained in numpy from labelled spans (`python -m larder.llm.op8_pii` trains it and writes
WEIGHTS, which every later run reads). It reads the characters as they stand; kind and limits of an added
span are those of its decoded tags. It reads every stretch of a text that can hold a span that passes(),
and REACH characters around it: runs of ten digits or more with their separators (a card or phone that
passes lies inside one), every name, @ or "at", bare or bracketed, and host with a dot, plain or written,
and every ip with a written dot. Each stretch is cut into overlapping windows; a character takes its
emissions from the window in which it lies most central, and one CRF decoding over the whole stretch
reconciles them. A decoded span is kept if it isn't cut out of a longer word or number, its form passes
the kind's check, and no pattern's span touches it; an address may also reach beyond the patterns'
addresses inside it. An "at" inside the host of an address before it belongs to that host.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.bilstm_crf import Tagger, encode

Span = tuple[str, int, int]
KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, REACH = 96, 48, 48
#: Characters decoded as one sequence; longer stretches are decoded in such parts, which overlap by twice REACH.
PART = 8192
#: Made-up texts that the tagger learns from, and its trained weights.
TEXTS = 6000
WEIGHTS = os.path.join(os.path.dirname(__file__), "op8_tagger.npz")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"\+?\(?[0-9](?:[0-9 ./()-]*[0-9])?")
_AT = re.compile(r"@|[(\[{]\s?at\s?[)\]}]|(?<=\s)at(?=\s)", re.IGNORECASE)
_SAID_DOT = r"(?:\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\sdot\s)"
_DOT = rf"(?:{_SAID_DOT}|\.)"
_HOST = re.compile(rf"\s?[\w-]++(?:{_DOT}[\w-]++)++", re.IGNORECASE)
_NAME = re.compile(rf"[\w.%+-]++(?:{_SAID_DOT}[\w.%+-]++)*+", re.IGNORECASE)
_EMAIL = re.compile(rf"{_NAME.pattern}(?:\s?(?:@|[(\[{{]\s?at\s?[)\]}}])\s?|\sat\s)[\w-]++(?:{_DOT}[\w-]++)++", re.IGNORECASE)
_WRITTEN_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 - 9 if i % 2 and d > 4 else d * 2 if i % 2 else d
        total += d
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind as listed, then start. Linear in the text: no run is scanned twice."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = only_digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(only_digits(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


# ---- labelled spans ----


#: Words of the made-up texts beside invented ones.
_PLAIN = "the a of and to in is was for on with by from that this at dot or an it as he she they we you der die und das le la et il di che el los con por not all some new old day house river table green little morning".split()
_CUES = "mail email e-mail contact write reach ask address message or to from cc".split()
_VERBS = "look looked met arrived see seen stay read more found available hosted published visit us live join started team page news shop is are it them".split()
_TOPS = "com org net de it fr io info edu eu es co.uk ac.uk example test".split()


def labelled_examples(n: int = 1500, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Made-up texts with labelled spans: plain forms, written variants, and look-alikes without a label."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    sound = lambda: pick(*"bcdfghjklmnprstvwxyz", "ch", "st", "th") + pick(*"aeiou") + pick("", "", "", *"nrstlm")
    label = lambda: "".join(sound() for _ in range(pick(1, 1, 2, 2, 3, 4)))

    def word() -> str:
        w = pick(*_PLAIN) if rng.random() < 0.5 else "".join(pick(sound(), sound(), sound(), "é", "ö") for _ in range(rng.integers(1, 5)))
        return w.capitalize() if rng.random() < 0.1 else w

    def card(sep: str) -> str:
        body = str(rng.integers(2, 7)) + digits(14)
        whole = body + next(c for c in "0123456789" if luhn(body + c))
        return sep.join(whole[i : i + 4] for i in range(0, 16, 4))

    def host(dot: str) -> str:
        parts = [label() for _ in range(pick(0, 0, 0, 1, 1, 3))] + [pick(label(), label(), f"{label()}-{label()}", label() + digits(2))]
        return dot.join([*parts, *pick(*_TOPS).split(".")])

    def made(kind: str) -> str:
        if kind == "email":
            at, dot = pick(
                ("@", "."), ("@", "[.]"), ("@", " dot "), ("(at)", "."), ("[at]", "."), (" (at) ", "."), (" [at] ", "."), ("(at)", "(dot)"), ("[at]", "[dot]"),
                (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" {at} ", " {dot} "), (" at ", " dot "), (" at ", " dot "), (" at ", "."),
            )
            inner = pick("", ".", ".", "_", "-", "+")
            if inner == "." and dot != "." and rng.random() < 0.5:
                inner = dot
            many = pick(1, 2, 2, 2, 3, 8) if inner else pick(1, 1, 1, 2)
            name = inner.join(pick(label(), label(), label(), sound()[0], pick(*_PLAIN)) for _ in range(many)) + pick("", "", digits(rng.integers(1, 4)))
            whole = name + at + host(dot)
            if (at, dot) == (" at ", "."):
                whole = name + " at " + host(".")
            if rng.random() < 0.15:
                whole = whole.upper()
            return whole
        if kind == "ip":
            return pick(".", "[.]", "(.)", " (dot) ", "(dot)", " dot ", " [dot] ", "[dot]", " DOT ").join(str(rng.integers(0, 256)) for _ in range(4))
        if kind == "card":
            return card(pick("", " ", "-", ".", "/"))
        area, a, b = digits(3), digits(3), digits(4)
        return pick(f"+{rng.integers(1, 99)} ({area}) {a}-{b}", f"({area}) {a}-{b}", f"({area}) {a} {b}", f"({area}) {a}.{b}", f"+{rng.integers(1, 99)} {area} {a} {b}", f"+{rng.integers(1, 99)}-{area}-{a}-{b}", f"{area}-{a}-{b}", f"{area} {a} {b}", f"{area}.{a}.{b}", f"0{digits(2)} {digits(3)} {digits(4)}", f"0{digits(2)} {digits(7)}")

    def decoy() -> str:
        code = "".join(pick(*"0123456789abcdef") for _ in range(40))
        date = f"20{digits(2)}-{digits(2)}-{digits(2)}"
        return pick(
            f'token = "{code}"', f"version {rng.integers(1, 9)}.{rng.integers(0, 9)}", digits(16), digits(4), f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(3)}-{digits(3)}",
            f"$ {digits(3)}.{digits(2)}", f"@{word()}", digits(rng.integers(5, 12)), f"{digits(1)},{digits(3)}", f"({digits(4)})", f"{date} {digits(2)}{pick(*':.')}{digits(2)}",
            f"{date} {digits(2)}.{digits(2)} and {date} {digits(2)}{pick(*':.')}{digits(2)}", f"{date} - {date}", f"[{digits(2)}]", " ".join(digits(rng.integers(1, 4)) for _ in range(rng.integers(4, 12))),
            f"{pick(*_VERBS)} at {host('.')}", f"{pick(*_VERBS)} at {host('.')} on {digits(2)}.{digits(2)}.{digits(4)}", f"{word()} {pick(*_VERBS)} at {word()}.{word()}", f"{pick(*_VERBS)} at {digits(2)}.{digits(2)}", f"the dot {word()} at {word()}",
        )

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(1, 4)):
            text += " ".join(word() for _ in range(rng.integers(0, 6))) + pick(" ", ". ", "\n", ", ", " ", ": ", " (", ' "', " <")
            if rng.random() < 0.6:
                kind = pick("email", "email", *KINDS)
                piece = made(kind)
                if " at " in piece and " dot " not in piece or rng.random() < 0.15:
                    text += pick("", word() + " ") + pick(*_CUES) + pick(" ", ": ", " ")
                spans.append((kind, len(text), len(text) + len(piece)))
            else:
                piece = decoy()
            text += piece + pick(" ", ". ", ", ", "\n", "; ", ") ", '" ', "> ", "? ")
        out.append((text, spans))
    return out


def windows_of(text: str, spans: Sequence[Span]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    x, y = encode(text), np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        y[a:b] = 2 * KINDS.index(kind) + 2
        y[a] -= 1
    for at in range(0, max(1, len(text) - STRIDE), STRIDE):
        own = slice(at, at + WINDOW)
        pad = WINDOW - len(x[own])
        yield np.pad(x[own], (0, pad)), np.pad(y[own], (0, pad))


def train(examples: Sequence[tuple[str, Sequence[Span]]], epochs: int = 8, hidden: int = 32) -> Tagger:
    """A tagger of 2 tags per kind (first, inside) and 0 (outside) from labelled texts."""
    pairs = [w for text, spans in examples for w in windows_of(text, spans)]
    tagger = Tagger(2 * len(KINDS) + 1, hidden)
    tagger.train(np.stack([p[0] for p in pairs]), np.stack([p[1] for p in pairs]), epochs, batch=96)
    return tagger


# ---- whole texts ----


def candidates(text: str) -> list[tuple[int, int]]:
    """Stretches that hold every span that passes(): long runs of digits, addresses with any "at", ips with a written dot.

    Linear in the text: no name and no host is read twice.
    """
    out = [(m.start(), m.end()) for m in _RUN.finditer(text) if len(only_digits(m[0])) >= 10] if _DIGIT.search(text) else []
    low, done, hosts = text.lower(), 0, []
    if "@" in low or "at" in low:
        for m in _AT.finditer(text):
            if m.start() >= done and (host := _HOST.match(text, m.end())):
                hosts.append((m.start(), host.end()))
                done = host.end()
    if hosts:
        names = {m.end(): m.start() for m in _NAME.finditer(text)}
        for at, end in hosts:
            name = names.get(at, names.get(at - 1) if at and text[at - 1].isspace() else None)
            if name is not None:
                out.append((name, end))
    if "dot" in low or "." in low and any(c in low for c in "([{"):
        out += [(m.start(), m.end()) for m in _WRITTEN_IP.finditer(text) if _DIGIT.search(text)]
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """The candidates with REACH around them, merged where they meet."""
    out: list[list[int]] = []
    for start, end in sorted(candidates(text)):
        a, b = max(0, start - REACH), min(len(text), end + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def passes(kind: str, piece: str) -> bool:
    """Whether a tagged piece has the content of its kind, however it is written."""
    digits = only_digits(piece)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9]+(?:[ ./-]{1,2}[0-9]+)*", piece) is not None
    if kind == "phone":
        return 10 <= len(digits) <= 15 and re.fullmatch(r"\+?[0-9]*[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]+(?:[ .-][0-9]+)*|\+?[0-9]{1,4}(?:[ .-][0-9]{2,7}){1,4}", piece) is not None
    if kind == "email":
        return _EMAIL.fullmatch(piece) is not None
    return _WRITTEN_IP.fullmatch(piece) is not None and all(int(p) <= 255 for p in re.findall("[0-9]+", piece))


def whole(kind: str, text: str, a: int, b: int) -> bool:
    """Whether text[a:b] isn't cut out of a longer number or, for an address, a longer word."""
    inside = (lambda c: c == "_" or c.isalnum()) if kind == "email" else str.isdigit
    return not (a and inside(text[a - 1]) and inside(text[a])) and not (b < len(text) and inside(text[b]) and inside(text[b - 1]))


def parts_of(a: int, b: int) -> Iterator[tuple[int, int]]:
    """a .. b in overlapping parts of PART characters."""
    for at in range(a, max(a + 1, b - 2 * REACH), PART - 2 * REACH):
        yield at, min(b, at + PART)


def emissions(x: np.ndarray, lengths: np.ndarray, tagger: Tagger, batch: int = 512) -> np.ndarray:
    """Emissions (characters x tags) of sequences laid end to end in x, from overlapping windows.

    A window is STRIDE away from the next; each gives the characters nearest to its middle.
    """
    ends = np.cumsum(lengths)
    counts = np.maximum(1, -(-(lengths - STRIDE) // STRIDE))
    of = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (ends - lengths)[of] + number * STRIDE
    edge = (WINDOW - STRIDE) // 2
    low = np.where(number == 0, 0, edge)
    high = np.where(number == counts[of] - 1, np.minimum(WINDOW, ends[of] - start), edge + STRIDE)
    out = np.empty((len(x), tagger.tags))
    inside = np.arange(WINDOW)
    for at in range(0, len(of), batch):
        own = slice(at, at + batch)
        places = start[own, None] + inside
        known = places < ends[of[own], None]
        e = tagger.emissions(np.where(known, x[np.minimum(places, len(x) - 1)], 0)).transpose(1, 0, 2)
        take = (inside >= low[own, None]) & (inside < high[own, None])
        out[places[take]] = e[take]
    return out


def decoded(x: np.ndarray, lengths: np.ndarray, tagger: Tagger, limit: int = 1 << 18) -> np.ndarray:
    """Tags of sequences laid end to end in x: sequences of like length are decoded together."""
    e, starts = emissions(x, lengths, tagger), np.cumsum(lengths) - lengths
    tags = np.zeros(len(x), np.int8)
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and (upto + 1 - at) * lengths[order[upto]] <= limit and lengths[order[upto]] <= 2 * lengths[order[at]] + 16:
            upto += 1
        own = order[at:upto]
        places = np.arange(lengths[own].max())[None, :] + starts[own, None]
        known = places < (starts + lengths)[own, None]
        tags[places[known]] = tagger.best(e[np.minimum(places, len(x) - 1)].transpose(1, 0, 2), lengths[own])[known]
        at = upto
    return tags


def tagged_spans(texts: Sequence[str], tagger: Tagger) -> list[list[Span]]:
    """The tagger's spans of each text."""
    places = [(i, a, b) for i, t in enumerate(texts) for a, b in regions(t)]
    out: list[list[Span]] = [[] for _ in texts]
    if not places:
        return out
    parts = [(k, a, b) for k, (_, x, y) in enumerate(places) for a, b in parts_of(x, y)]
    lengths = np.array([b - a for _, a, b in parts], np.int64)
    tags = decoded(np.concatenate([encode(texts[places[k][0]][a:b]) for k, a, b in parts]), lengths, tagger)
    # of what two parts of a stretch share, each keeps the half on its own side
    own = np.ones(len(tags), bool)
    for end, (k, a, b), before, after in zip(np.cumsum(lengths), parts, [None, *parts], [*parts[1:], None], strict=False):
        if before and before[0] == k:
            own[end - (b - a) : end - (b - a) + REACH] = False
        if after and after[0] == k:
            own[end - REACH : end] = False
    tags, at = tags[own], 0
    for i, a, b in places:
        out[i] += [(kind, a + x, a + y) for kind, x, y in spans_of(tags[at : at + b - a])]
        at += b - a
    return out


def spans_of(tags: np.ndarray) -> list[Span]:
    """Runs of one kind's tags; a first tag begins a run of its own."""
    kind = (tags.astype(np.int64) + 1) // 2  # 0: outside
    first = (kind > 0) & ((tags % 2 == 1) | np.concatenate(([True], kind[1:] != kind[:-1])))
    begins = np.flatnonzero(first)
    stops = np.append(np.flatnonzero(first | (kind == 0)), len(tags))
    ends = stops[np.searchsorted(stops, begins, "right")]
    return [(KINDS[kind[a] - 1], int(a), int(b)) for a, b in zip(begins, ends, strict=True)]


def find(texts: Sequence[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; all spans are by kind as listed, then start."""
    out = []
    for text, own, more in zip(texts, map(base_spans, texts), tagged_spans(texts, tagger), strict=True):
        added = []
        held = sorted((a, b, k) for k, a, b in own)
        reach = list(accumulate((b for _, b, _ in held), max))
        for kind, a, b in more:
            while b > a and text[b - 1] in " .,;:\n":
                b -= 1
            while b > a and text[a] in " \n":
                a += 1
            if b > a and whole(kind, text, a, b) and passes(kind, text[a:b]):
                touched = held[bisect_right(reach, a) : bisect_left(held, (b,))]
                touched = [s for s in touched if s[1] > a]
                if all(kind == k == "email" and a <= x and y <= b and (x, y) != (a, b) for x, y, k in touched):
                    added.append((kind, a, b))
        out.append((own, sorted([*own, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def told(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_read: dict[int, Tagger] = {}


def default_tagger() -> Tagger:
    """The tagger with the weights of WEIGHTS, read once per process."""
    if 0 not in _read:
        _read[0] = Tagger.load(WEIGHTS)
    return _read[0]


def groups(texts: list[str], limit: int = 4 << 20) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None, key: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (patterns' spans), base_sha256, spans (all) of every row.

    Positions are code points, end exclusive. Null and empty texts have no spans; repeated rows give
    repeated results; null keys stay; empty in, empty out; further columns are left out.
    """
    tagger = tagger or default_tagger()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in groups([t or "" for t in batch.column("text").to_pylist()]):
                found = find(texts, tagger)
                counts = [pa.array([sum(s[0] == k for s in own) for own, _ in found], pa.int64()) for k in KINDS]
                digests = pa.array([hashlib.sha256(told(own).encode()).hexdigest() for own, _ in found])
                yield pa.record_batch([batch.column("doc_id").slice(at, len(texts)), *counts, digests, pa.array([told(every) for _, every in found], pa.string())], names=names)
                at += len(texts)

    return docs.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; null and empty texts stay as they are.

    Repeated rows are cleaned each; all other columns stay, whatever their names; empty in, empty out.

    n_chars, where docs has it, becomes the new length of the texts that changed. Where spans of two
    kinds overlap, they go as one, named after the first.
    """
    tagger = tagger or default_tagger()

    def cleaned(text: str, spans: Sequence[Span]) -> str:
        out, at = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = batch.column(k).to_pylist()
            fresh = []
            for part in groups([t or "" for t in texts]):
                fresh += [cleaned(t, every) if every else t for t, (_, every) in zip(part, find(part, tagger), strict=True)]
            fresh = [None if t is None else f for t, f in zip(texts, fresh, strict=True)]
            batch = batch.set_column(k, batch.schema.field(k), pa.array(fresh, batch.schema.field(k).type))
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                old = batch.column(n).to_pylist()
                lengths = [o if t == f else len(f) for o, t, f in zip(old, texts, fresh, strict=True)]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(lengths, batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


if __name__ == "__main__":
    train(labelled_examples(TEXTS)).save(WEIGHTS)
