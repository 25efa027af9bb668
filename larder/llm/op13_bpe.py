"""Byte-level BPE over Arrow batches: texts to ids with character offsets, and ids back to bytes and texts.

The vocabulary is a rank file (base64 token, rank). A byte-level model writes every byte as one printable
character; `byte_table` is that mapping, and decoding reverses it. The tokenizers library merges pairs by
their place in a list, a rank file by the rank of what a pair makes: so every pair of tokens that makes a
token is listed, in the order of the made token's rank.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from larder.llm.text import slices

#: Characters of a part of a long text and bytes of texts encoded together: memory follows these, not the texts.
PART, TOGETHER = 1 << 18, 1 << 19
#: Units whose ids a worker remembers, and their longest; both change cost only.
KEPT, KEPT_LENGTH = 1 << 19, 48
#: Fixed: the characters of the Unicode property White_Space, the pattern's own white space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match of the pattern runs from something else into white space, or from an ASCII letter into an ASCII
#: character that is none: texts fall into units there, whose ids don't depend on what stands around them.
UNIT = re.compile(f"[{WHITE}]*[A-Za-z]+(?=[!-@\\[-`{{-~])|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
CUT = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")


def byte_table() -> list[str]:
    """The character of each byte: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class ByteCoder:
    """A tokenizer of the tokenizers library from a rank file, and the bytes of its ids."""

    def __init__(self, ranks_path: str, pattern: str):
        lines = map(bytes.split, Path(ranks_path).read_bytes().splitlines())
        table = byte_table()
        self.pattern = pattern
        self.vocabulary = {"".join(table[b] for b in base64.b64decode(token)): int(rank) for token, rank in lines}
        back = {c: b for b, c in enumerate(table)}
        tokens = [b"\xef\xbf\xbd"] * (max(self.vocabulary.values()) + 2)  # ids without a token, the last entry among them: U+FFFD
        for written, rank in self.vocabulary.items():
            tokens[rank] = bytes(back[c] for c in written)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.kept: dict[str, bytes] = {}

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        ranks, merges = self.vocabulary, []
        for token in sorted(ranks, key=ranks.__getitem__):
            pairs = [(token[:k], token[k:]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
            merges += sorted(pairs, key=lambda p: (ranks[p[0]], ranks[p[1]]))
        out = Tokenizer(models.BPE(ranks, merges, ignore_merges=True))
        split = pre_tokenizers.Split(Regex(self.pattern), "isolated")
        out.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as if each match of the pattern were merged by itself."""
        out, held, size = [], [], 0
        for text in texts:
            if len(text) > PART:
                out += self._short(held) + [np.concatenate([self._short([part])[0] for part in parts(text)])]
                held, size = [], 0
                continue
            held.append(text)
            size += len(text)
            if size > PART:
                out += self._short(held)
                held, size = [], 0
        return out + self._short(held)

    def _short(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.kept) > KEPT:
            self.kept = {}
        units = [UNIT.findall(text) for text in texts]
        known = self.kept
        found = self._units([u for u in dict.fromkeys(itertools.chain.from_iterable(units)) if u not in known])
        known |= {u: i for u, i in found.items() if len(u) <= KEPT_LENGTH}
        found = {u: i for u, i in found.items() if len(u) > KEPT_LENGTH}
        return [np.frombuffer(b"".join([known[u] if u in known else found[u] for u in own]), np.int32) for own in units]

    def _units(self, units: list[str]) -> dict[str, bytes]:
        """The ids of each unit: units are encoded as one text while each begins, and none ends, with white space, where texts split."""
        texts, space = [], re.compile(f"[{WHITE}]")
        for unit in units:
            if texts and space.match(unit) and not space.match(texts[-1][-1][-1]):
                texts[-1].append(unit)
            else:
                texts.append([unit])
        encoded = self.tokenizer.encode_batch_fast(["".join(t) for t in texts], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in encoded)])
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(u.encode()) for u in units])) + 1
        raw, at, out = ids.tobytes(), 0, {}
        for unit, end in zip(units, (4 * ends).tolist(), strict=True):
            out[unit], at = raw[at:end], end
        return out

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code point of each id and the one after its last; ids that share a split character both span it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum(raw & 0xC0 != 0x80).astype(np.int32) - 1  # of each byte: all but continuation bytes begin one
        end = np.cumsum(self.lengths[ids])
        return character[end - self.lengths[ids]], character[end - 1] + 1

    def _known(self, ids: np.ndarray) -> np.ndarray:
        unknown = len(self.lengths) - 1
        return np.where((ids >= 0) & (ids < unknown), ids, unknown)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; an id outside the vocabulary is U+FFFD."""
        ids = self._known(ids)
        lengths = self.lengths[ids]
        end = np.cumsum(lengths)
        return self.bytes[np.arange(end[-1] if len(end) else 0) + np.repeat(self.starts[ids] - end + lengths, lengths)].tobytes()

    def pieces(self, ids: np.ndarray) -> list[str]:
        """What each id adds to the text: a split character appears with the id that ends it, bytes that are no UTF-8 as U+FFFD.

        The pieces join to the text of the whole; bytes still open at the end go to the last id.
        """
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        raw, end = self.decode(ids), np.cumsum(self.lengths[self._known(ids)]).tolist()
        last = len(end) - 1
        return [reader.decode(raw[end[k - 1] if k else 0 : at], final=k == last) for k, at in enumerate(end)]


def parts(text: str) -> Iterator[str]:
    """A text cut before white space once a part has PART characters; a stretch without white space stays whole."""
    at = 0
    while len(text) - at > PART and (cut := CUT.search(text, at + PART)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@functools.cache
def coder(ranks_path: str, pattern: str) -> ByteCoder:
    """One for each Python worker."""
    return ByteCoder(ranks_path, pattern)


Batches = Iterator[pa.RecordBatch]


def encoded(batches: Batches, code: ByteCoder) -> Batches:
    """doc_id, text -> doc_id, ids, starts, ends, for about TOGETHER bytes of text at a time."""
    for batch in batches:
        for part in slices(batch, "text", TOGETHER):
            texts = [t or "" for t in part.column("text").to_pylist()]
            found = code.encode(texts)
            spans = [code.offsets(t, ids) for t, ids in zip(texts, found, strict=True)]
            columns = [part.column("doc_id"), lists(found), lists([a for a, _ in spans]), lists([b for _, b in spans])]
            yield pa.record_batch(columns, names=["doc_id", "ids", "starts", "ends"])


def decoded(batches: Batches, code: ByteCoder) -> Batches:
    """Batches with ids -> the same with the bytes and the text of the ids."""
    for batch in batches:
        raw = [None if ids is None else code.decode(ids) for ids in arrays(batch.column("ids"))]
        texts = [None if b is None else b.decode("utf-8", "replace") for b in raw]
        yield pa.record_batch([*batch.columns, pa.array(raw, pa.binary()), pa.array(texts, pa.string())], names=[*batch.schema.names, "bytes", "text"])


def digested(batches: Batches) -> Batches:
    """doc_id, ids, bytes -> doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit integers), decoded_sha256."""
    for batch in batches:
        ids = [ids.astype("<u4") for ids in arrays(batch.column("ids"))]
        sums = [[hashlib.sha256(x).hexdigest() for x in column] for column in (ids, batch.column("bytes").to_pylist())]
        yield pa.record_batch([batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), *map(pa.array, sums)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def texts_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key (as long), ids, starts, ends of every row: the ids of its whole text and the code points that each spans.

    ranks_path names a file that every machine has. A null text counts as empty and gives empty arrays; null
    and repeated keys are rows like any other; an empty table gives an empty result; further columns are left
    out. Texts of any length are encoded part by part; only a stretch without white space is held whole.
    """
    return texts_of(docs, key, text).mapInArrow(lambda batches: encoded(batches, coder(ranks_path, pattern)), "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(ids: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The table (with a column ids) and for each row `bytes` and `text` of its ids; in text, bytes that are no UTF-8 are U+FFFD.

    Ids cut anywhere can be decoded: a character whose bytes are split over two rows is whole again when
    their bytes are joined. Null ids give nulls, a null among ids and an id outside the vocabulary U+FFFD.
    Columns named bytes or text are replaced.
    """
    kept = ids.drop("bytes", "text")
    more = StructType([*kept.schema.fields, StructField("bytes", BinaryType()), StructField("text", StringType())])
    return kept.mapInArrow(lambda batches: decoded(batches, coder(ranks_path, pattern)), more)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """encode, decode and the digests of both in one pass, so that ids don't leave their worker in between; rows as in encode."""
    run = lambda batches: digested(decoded(encoded(batches, coder(ranks_path, pattern)), coder(ranks_path, pattern)))
    return texts_of(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *values]), pa.int32()))


def arrays(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """The lists of a column; a null inside one counts as id -1."""
    for row in column:
        yield np.asarray(pc.fill_null(row.values, -1)).astype(np.int64) if row.is_valid else None
