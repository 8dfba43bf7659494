"""Byte-level byte-pair encoding by dynamic programming over prefixes, and decoding.

For each prefix of a piece the table stores the one token that the encoding of that prefix ends with. A token may end a
prefix when the pair of it and the last token of the shorter prefix is left alone by the merges, and exactly one token
may. The encoding is read back from the end of the table. So a text can grow at its end, or be edited, and only the
entries near the change are computed anew: an entry depends on the entries of at most one token's length before it.

Defined cases: a null text counts as empty (no tokens, no bytes); strings of special tokens are ordinary text; repeated
rows and ties are encoded row by row; columns of the input that clash with the added ones are replaced; an empty table
gives an empty result with the same columns. Texts and pieces of any length are encoded whole, in steps that grow with
their bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pieces and token pairs that a worker remembers before it starts afresh.
REMEMBERED = 1 << 19


class Vocabulary:
    """Tokens as bytes with their ranks; the lowest-ranked adjacent pair merges first, the leftmost of equals."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.size = max(self.tokens) + 1
        self._settled: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    @classmethod
    def from_lines(cls, content: bytes) -> Vocabulary:
        """From the lines of a rank file: a token in base 64, a blank, its rank."""
        return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines() if content else [])})

    @cached_property
    def tree(self) -> ahocorasick.Automaton:
        """The tokens as keywords, for those that only encode."""
        tree = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            tree.add_word(token.decode("latin-1"), (len(token), rank))
        tree.make_automaton()
        return tree

    def merged(self, piece: bytes) -> list[bytes]:
        """The tokens of a short piece by plain merging."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(self.ranks[pair], i) for i in range(len(parts) - 1) if (pair := parts[i] + parts[i + 1]) in self.ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def decode(self, packed: bytes | None) -> bytes:
        """The bytes that packed token ids stand for."""
        return b"".join(map(self.tokens.__getitem__, struct.unpack(f"<{len(packed) // 4}I", packed))) if packed else b""

    def whole(self, token: int) -> bool:
        """Whether the merges ever make this token of its own bytes."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = len(self.merged(self.tokens[token])) == 1
        return known

    def settled(self, left: int, right: int) -> bool:
        """Whether the merges leave this pair of tokens as it is."""
        key = left * self.size + right
        known = self._settled.get(key)
        if known is None:
            if len(self._settled) >= REMEMBERED:
                self._settled.clear()
            pair = [self.tokens[left], self.tokens[right]]
            known = self._settled[key] = self.merged(pair[0] + pair[1]) == pair
        return known


class PrefixTable:
    """The last token of each prefix of a piece; ``last[i]`` is that of the first i bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _fill(self, data: bytes, last: list[int], begin: int, end: int) -> None:
        """Add the entries of the prefixes of ``begin`` to ``end`` bytes; the tokens that end a prefix come from a keyword tree."""
        vocabulary = self.vocabulary
        known, size, have = vocabulary._settled.get, vocabulary.size, begin
        base = max(0, begin - vocabulary.longest)
        for at, (length, token) in vocabulary.tree.iter(data[base:end].decode("latin-1")):
            at += base + 1
            if at < have:
                continue
            start = at - length
            if start:
                settled = known(last[start] * size + token)
                if settled is None:
                    settled = vocabulary.settled(last[start], token)
            else:
                settled = vocabulary.whole(token)
            if settled:
                last.append(token)
                have = at + 1

    def append(self, more: bytes) -> None:
        """Lengthen the piece; entries that exist stay as they are."""
        begin = len(self.data) + 1
        self.data += more
        self._fill(self.data, self.last, begin, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put other bytes in place of a span and return how many entries were computed for it.

        Once as many entries in a row as a token may be long are the same as before, all later ones are too.
        """
        data = self.data[:start] + new + self.data[end:]
        shift = len(data) - len(self.data)
        last, same, computed = self.last[: start + 1], 0, 0
        for at in range(start + 1, len(data) + 1):
            self._fill(data, last, at, at)
            computed += 1
            unedited = at > start + len(new)
            same = same + 1 if unedited and last[at] == self.last[at - shift] else 0
            if same >= self.vocabulary.longest:
                last += self.last[at - shift + 1 :]
                break
        self.data, self.last = data, last
        return computed

    def token_ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[self.last[end]])
        return out[::-1]


class TextEncoder:
    """Encodes texts piece by piece; a piece that is itself a token is that token."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self._known: dict[str, bytes] = {}

    def piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        token = self.vocabulary.ranks.get(data)
        return [token] if token is not None else PrefixTable(self.vocabulary, data).token_ids()

    def encode(self, text: str) -> bytes:
        """The token ids as little-endian unsigned 32-bit integers."""
        known, out = self._known, []
        for piece in self.pattern.findall(text):
            packed = known.get(piece)
            if packed is None:
                ids = self.piece(piece)
                packed = struct.pack(f"<{len(ids)}I", *ids)
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = packed
            out.append(packed)
        return b"".join(out)


class EditableText:
    """A text with the prefix tables of its pieces, for appends and edits without encoding all of it again.

    How a piece ends depends on the character after it and on nothing before it. So pieces that end before the
    character ahead of an edit stay, and once a new piece starts where an old one did behind the edit, the rest stays too.
    """

    def __init__(self, encoder: TextEncoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.tables: list[PrefixTable] = []
        self.append(text)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put other characters in place of a span and return how many table entries were computed for it."""
        text = self.text[:start] + new + self.text[end:]
        shift, bounds = len(text) - len(self.text), [*self.starts[1:], len(self.text)]
        kept = next((i for i, bound in enumerate(bounds) if bound >= start), len(self.tables)) if self.tables else 0
        behind = {s + shift: i for i, s in enumerate(self.starts) if s >= end and s + shift >= start + len(new)}
        starts, tables, computed = self.starts[:kept], self.tables[:kept], 0
        at = self.starts[kept] if kept < len(self.starts) else (bounds[-1] if self.tables else 0)
        reused = kept
        while at < len(text):
            if at in behind and at > start:
                i = behind[at]
                starts += [s + shift for s in self.starts[i:]]
                tables += self.tables[i:]
                break
            found = self.encoder.pattern.match(text, at)
            piece = found.group().encode("utf-8")
            old = self.tables[reused] if reused < len(self.tables) else None
            if old is not None and at < start and piece.startswith(old.data):
                computed += len(piece) - len(old.data)
                old.append(piece[len(old.data) :])
                tables.append(old)
            else:
                computed += len(piece)
                tables.append(PrefixTable(self.encoder.vocabulary, piece))
            reused = len(self.tables)  # only the piece at the edit can be lengthened
            starts.append(at)
            at = found.end()
        self.text, self.starts, self.tables = text, starts, tables
        return computed

    def token_ids(self) -> list[int]:
        out = []
        for table in self.tables:
            token = self.encoder.vocabulary.ranks.get(table.data)
            out += [token] if token is not None else table.token_ids()
        return out


def read_ranks(path: str) -> bytes:
    """The content of a rank file, read on the driver; it is of the vocabulary's size."""
    with open(path, "rb") as file:
        return file.read()


def encoder_of(spark: SparkSession, vocabulary: str, pattern: str) -> Callable[[Column], Column]:
    """A column function from text to its token ids, packed as little-endian unsigned 32-bit integers."""
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = TextEncoder(Vocabulary.from_lines(shared.value), pattern)
        for texts in batches:
            yield pd.Series([encoder.encode(t) if t else b"" for t in texts], dtype=object)

    return encode


def decoder_of(spark: SparkSession, vocabulary: str) -> Callable[[Column], Column]:
    """A column function from packed token ids to the bytes that they stand for."""
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary.from_lines(shared.value)
        for packed in batches:
            yield pd.Series([vocabulary.decode(p) for p in packed], dtype=object)

    return decode


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows with ``token_ids`` (packed) and ``n_tokens``."""
    encoded = docs.withColumn("token_ids", encoder_of(docs.sparkSession, vocabulary, pattern)(F.coalesce(F.col(text), F.lit(""))))
    return encoded.withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))


def decode_documents(encoded: DataFrame, vocabulary: str, token_ids: str = "token_ids") -> DataFrame:
    """The rows with ``decoded``, the bytes of their token ids; null ids count as none."""
    return encoded.withColumn("decoded", decoder_of(encoded.sparkSession, vocabulary)(F.col(token_ids)))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows with ``token_ids``, ``n_tokens`` and ``decoded``, encoded and decoded by the same worker."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    @F.pandas_udf("token_ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = TextEncoder(Vocabulary.from_lines(shared.value), pattern)
        for texts in batches:
            ids = [encoder.encode(t) if t else b"" for t in texts]
            yield pd.DataFrame({"token_ids": ids, "decoded": map(encoder.vocabulary.decode, ids)}, dtype=object)

    told = docs.drop("token_ids", "n_tokens", "decoded").withColumn("__both", both(F.coalesce(F.col(text), F.lit(""))))
    return told.select("*", "__both.*").drop("__both").withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))
