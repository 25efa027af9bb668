"""Counts of whole texts, from which quality rules and the quality classifier start."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from larder.llm.text import SPACE, words

#: Classes of bytes; every byte has one.
KINDS = ("other", "space", "newline", "upper", "lower", "digit", "symbol", "pipe", "exclaim", "stop", "comma", "tail", "lead")
_kind = np.zeros(256, np.int64)
_kind[SPACE] = 1
_kind[10] = 2
_kind[65:91], _kind[97:123], _kind[48:58] = 3, 4, 5
_kind[list(b"#*$%&<>")] = 6
_kind[ord("|")], _kind[ord("!")], _kind[list(b".?")], _kind[ord(",")] = 7, 8, 9, 10
_kind[128:192], _kind[192:] = 11, 12

REPEAT_WIDTH = 8
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_top", "n_stutter") + KINDS


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """FIELDS of each text as int64 arrays; null counts as empty.

    n_repeat_words: words inside an 8-word window found twice or more, the first included.
    n_dup_lines: lines (split at \\n) with a word that equal an earlier line. n_top: count of the
    commonest word. n_stutter: words equal to the word before.
    """
    texts = pc.fill_null(texts, "")
    w = words(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(w.offsets))
    kinds = np.bincount(doc * len(KINDS) + _kind[w.data], minlength=n * len(KINDS)).reshape(n, len(KINDS))
    out = {f: np.zeros(n, np.int64) for f in FIELDS}
    for k, name in enumerate(KINDS):
        out[name] = kinds[:, k]
    out["n_words"] = np.diff(w.first)
    out["word_chars"] = np.diff(w.offsets) - kinds[:, 11] - kinds[:, 1] - kinds[:, 2]
    out["n_symbols"] = kinds[:, 6] + kinds[:, 7]
    windows, hashes = w.windows(REPEAT_WIDTH), w.hashes
    for i, text in enumerate(texts.to_pylist()):
        lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        a, b = w.first[i], w.first[i + 1]
        if b - a > 1:
            own = hashes[a:b]
            out["n_stutter"][i] = np.count_nonzero(own[1:] == own[:-1])
            own = np.sort(own)
            edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            out["n_distinct"][i] = len(edges) - 1
            out["n_top"][i] = np.diff(edges).max()
        elif b > a:
            out["n_distinct"][i] = out["n_top"][i] = 1
        if b - a > REPEAT_WIDTH:
            part = windows[a : b - REPEAT_WIDTH + 1]
            own = np.sort(part)
            twice = own[1:][own[1:] == own[:-1]]
            if len(twice):
                begin = np.flatnonzero(np.isin(part, twice))
                steps = np.zeros(b - a + 1, np.int64)
                np.add.at(steps, begin, 1)
                np.add.at(steps, begin + REPEAT_WIDTH, -1)
                out["n_repeat_words"][i] = np.count_nonzero(np.cumsum(steps[:-1]))
    return out
