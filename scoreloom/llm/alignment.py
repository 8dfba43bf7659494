"""How the tokens of two tokenizers lie over each other, with corpus-wide counts of the token pairs that meet.

Both token sequences of a text stand for the same bytes. Offsets where a token of each side ends cut them into groups, and
every token of a group is linked with every token of the other side there. Counts are kept without a table of pairs:

1. Texts are encoded and aligned; tokens and each text's distinct pairs are stored as numbers. Distinct pairs of the corpus are dealt into
   buckets, and tasks build a minimal perfect hash for each bucket: levels of bit arrays in which a pair that has a bit to
   itself is settled and the others go on to the next level. The rank of its bit is the pair's place.
2. Tasks count texts in dense vectors indexed by the hash. Vectors travel in segments and are summed in a tree.
3. Texts are aligned again from their stored tokens, and each link looks its count up; the pair stored at its place must be the
   one asked for.

Buckets are joined to shards of a bounded number of pairs, so whatever reaches the driver or is broadcast is bounded too;
more pairs make more shards, each a pass over the stored pairs and one over the stored tokens.

Defined cases: texts that are null or empty, or whose tokens don't stand for the text's own bytes, have no tokens, groups
or links, and an empty group text; repeated rows are documents of their own; ties of the highest count are all best;
columns of the input that clash with the added ones are replaced; an empty table gives an empty result with the same
columns. Long texts are aligned whole, and a group's pairs are formed in pieces of bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from scoreloom.llm.token_counts import byte_letters
from scoreloom.session import materialize

#: Pairs of a shard: 12 bytes of a broadcast each, with their counts.
SHARD_PAIRS = 4_000_000
#: Pairs of a bucket, on average, whose hash one task builds at a time.
BUCKET_PAIRS = 1 << 17
#: Counts of a segment of a vector.
SEGMENT = 1 << 16
#: Links that are formed at a time.
LINKS_AT_ONCE = 1 << 22
#: Characters of texts that are aligned at a time.
TEXT_AT_ONCE = 1 << 19

#: Columns of stored tables.
_OWN = ["__text", "__a", "__b", "__pairs"]
ADDED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def read_byte_level(path: str) -> dict[bytes, int]:
    """Tokens as bytes with their ids of a byte-level vocabulary file, whose merges must be listed in the order of their ids."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
    special = {t["content"] for t in content["added_tokens"]}
    ids = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [model["vocab"]["".join(p)] for p in pairs] != list(range(256, 256 + len(pairs))):
        raise ValueError("the merges are not in the order of their ids")
    return ids


def read_pieces(path: str) -> bytes:
    """The content of a piece model, read on the driver; it is of the vocabulary's size."""
    with open(path, "rb") as file:
        return file.read()


class Sides:
    """Both tokenizers, with the bytes of each token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes):
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.length_a = np.array([len(t) for t in self.bytes_a])
        self.length_b = np.array([len(t) for t in self.bytes_b])

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode("utf-8")

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        if text:
            whole = " " + text
            # the tokens of side a are the text's own bytes by their making, those of side b may be a normalised text's
            b = self.b.encode(text)
            if b"".join(map(self.bytes_b.__getitem__, b)) == whole.encode("utf-8"):
                return self.a.encode_to_numpy(whole, disallowed_special=()), np.array(b, dtype=np.uint32)
        return _NO_TOKENS, _NO_TOKENS


_NO_TOKENS = np.zeros(0, dtype=np.uint32)


@dataclass
class Aligned:
    """Some texts, one after the other: tokens of both sides, the texts' bounds in them, and the groups' bounds."""

    a: np.ndarray
    b: np.ndarray
    texts_a: np.ndarray  # tokens before each text, and in all
    texts_b: np.ndarray
    groups_a: np.ndarray  # tokens up to the end of each group
    groups_b: np.ndarray
    texts_g: np.ndarray  # groups before each text, and in all

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Linked ids (text, a, b, times), in pieces; ids that repeat in a large group come once with their number."""
        count_a = np.diff(self.groups_a, prepend=0)
        count_b = np.diff(self.groups_b, prepend=0)
        text = np.repeat(np.arange(len(self.texts_g) - 1), np.diff(self.texts_g))
        links = count_a * count_b
        large = np.flatnonzero(links > LINKS_AT_ONCE)
        usual = np.where(links > LINKS_AT_ONCE, 0, count_a)
        rows = np.repeat(np.arange(len(links)), usual)  # the group of each token of side a
        at = np.arange(len(self.a)) if not len(large) else np.concatenate(
            [np.arange(e - n, e) for e, n in zip(self.groups_a, usual) if n] or [np.arange(0)]
        )
        wide = count_b[rows]
        upto = np.cumsum(wide)
        cuts = np.searchsorted(upto, np.arange(LINKS_AT_ONCE, (upto[-1] if len(upto) else 0) + LINKS_AT_ONCE, LINKS_AT_ONCE), "right")
        begin = 0
        for end in dict.fromkeys([*np.minimum(cuts, len(rows)).tolist(), len(rows)]):
            if end > begin:
                r, w = rows[begin:end], wide[begin:end]
                within = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                b = self.b[np.repeat(self.groups_b[r] - count_b[r], w) + within]
                yield np.repeat(text[r], w), np.repeat(self.a[at[begin:end]], w), b, np.ones(len(b), dtype=np.int64)
                begin = end
        for g in large.tolist():
            ids_a, times_a = np.unique(self.a[self.groups_a[g] - count_a[g] : self.groups_a[g]], return_counts=True)
            ids_b, times_b = np.unique(self.b[self.groups_b[g] - count_b[g] : self.groups_b[g]], return_counts=True)
            step = max(1, LINKS_AT_ONCE // len(ids_b))
            for i in range(0, len(ids_a), step):
                some, times = ids_a[i : i + step], times_a[i : i + step]
                n = len(some) * len(ids_b)
                yield np.full(n, text[g]), np.repeat(some, len(ids_b)), np.tile(ids_b, len(some)), np.outer(times, times_b).ravel()


Lengths = tuple[np.ndarray, np.ndarray]


def align(lengths: Lengths, tokens: Sequence[tuple[np.ndarray, np.ndarray]]) -> Aligned:
    """Align the tokens of some texts, given the bytes of each token of both sides."""
    texts_a = np.cumsum([0, *(len(a) for a, _ in tokens)])
    texts_b = np.cumsum([0, *(len(b) for _, b in tokens)])
    a, b = (np.concatenate([_NO_TOKENS, *side]).astype(np.int64) for side in zip(*tokens))
    ends_a, ends_b = np.cumsum(lengths[0][a]), np.cumsum(lengths[1][b])
    # the last tokens of a text end together, so no group reaches over two texts
    _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    groups_a, groups_b = at_a + 1, at_b + 1
    return Aligned(a, b, texts_a, texts_b, groups_a, groups_b, np.searchsorted(groups_a, texts_a, "right"))


def id_words(size: int) -> list[np.ndarray]:
    """Each id as text, with each mark that may follow it."""
    return [np.array([f"{i}{c}" for i in range(size)], dtype=object) for c in ",|;"]


def group_texts(marked: list[np.ndarray], x: Aligned) -> list[str]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    marks_a, marks_b = np.zeros(len(x.a), dtype=bool), np.zeros(len(x.b), dtype=bool)
    marks_a[x.groups_a - 1], marks_b[x.groups_b - 1] = True, True
    before_b, after_a = x.groups_b - np.diff(x.groups_b, prepend=0), x.groups_a
    place_a = np.arange(len(x.a)) + np.repeat(before_b, np.diff(x.groups_a, prepend=0))
    place_b = np.arange(len(x.b)) + np.repeat(after_a, np.diff(x.groups_b, prepend=0))
    words = np.empty(len(x.a) + len(x.b), dtype=object)
    comma, bar, semicolon = marked
    words[place_a] = np.where(marks_a, bar[x.a], comma[x.a])
    words[place_b] = np.where(marks_b, semicolon[x.b], comma[x.b])
    bounds = (x.texts_a + x.texts_b).tolist()
    return ["".join(words[i:j].tolist())[:-1] for i, j in zip(bounds, bounds[1:])]


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """Well spread 64-bit numbers from keys, different for each salt."""
    x = keys.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash of distinct keys: those alone at a bit are settled, the rest try the next level."""
    levels, left = [], keys
    while len(left):
        bits = 2 * len(left) + 1
        at = (_mixed(left, len(levels)) % np.uint64(bits)).astype(np.int64)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(np.packbits(alone))
        left = left[~alone[at]]
    return levels


class PairIndex:
    """The minimal perfect hash of a shard, joined from those of its buckets, with the pairs for verification."""

    def __init__(self, buckets: list[tuple[int, np.ndarray, list[np.ndarray]]], dealt: int):
        buckets = sorted(buckets, key=lambda x: x[0])
        self.dealt, self.first = dealt, buckets[0][0] if buckets else 0
        depth, width = max((len(x[2]) for x in buckets), default=0), (buckets[-1][0] - self.first + 1) if buckets else 0
        self.size = np.zeros((depth, width), dtype=np.uint64)
        self.start = np.zeros((depth, width), dtype=np.int64)
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        taken = 0
        for level in range(depth):
            parts, at = [], 0
            for number, keys, levels in buckets:
                if level < len(levels):
                    self.start[level, number - self.first] = at
                    self.size[level, number - self.first] = 2 * self._left(levels, level, len(keys)) + 1
                    parts.append(levels[level])
                    at += 8 * len(levels[level])
            packed = np.concatenate(parts)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.bits.append(packed)
            self.before.append((taken + np.cumsum(ones) - ones).astype(np.uint32))
            taken += int(ones.sum())
        self.pairs = np.zeros(taken, dtype=np.uint32)
        for _, keys, _ in buckets:
            self.pairs[self._places(keys)] = keys

    @staticmethod
    def _left(levels: list[np.ndarray], level: int, keys: int) -> int:
        return keys - sum(int(np.bitwise_count(x).sum(dtype=np.int64)) for x in levels[:level])

    def _places(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        bucket = bucket_of(keys, self.dealt) - self.first
        rest = np.flatnonzero((bucket >= 0) & (bucket < self.size.shape[1]))
        for level in range(len(self.bits)):
            if not len(rest):
                break
            some, number = keys[rest], bucket[rest]
            size = self.size[level, number]
            rest, some, number, size = (v[size > 0] for v in (rest, some, number, size))
            at = self.start[level, number] + (_mixed(some, level) % size).astype(np.int64)
            byte, bit = self.bits[level][at >> 3], 7 - (at & 7)
            hit = (byte >> bit) & 1 == 1
            ahead = np.bitwise_count(byte >> (bit + 1).astype(np.uint16)).astype(np.int64)
            out[rest[hit]] = self.before[level][at[hit] >> 3] + ahead[hit]
            rest = rest[~hit]
        return out

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Each pair's place, or -1 where the shard doesn't hold it."""
        at = self._places(keys)
        at[at >= 0] = np.where(self.pairs[at[at >= 0]] == keys[at >= 0], at[at >= 0], -1)
        return at


def bucket_of(keys: np.ndarray, dealt: int) -> np.ndarray:
    return (((keys.astype(np.int64) * 2654435761 & 0xFFFFFFFF) * dealt) >> 32).astype(np.int64)


def _bucket(pair: str, dealt: int):
    return F.shiftright(((F.col(pair) * 2654435761).bitwiseAND(0xFFFFFFFF)) * F.lit(dealt), 32)


def _chunks(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of a bounded size; a larger text is one of its own."""
    begin, size = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and size + n > TEXT_AT_ONCE:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _text_pairs(x: Aligned, size_b: int, texts: int) -> list[np.ndarray]:
    """The distinct pairs of each text, as numbers."""
    parts = [np.unique((t << 32) | (a * size_b + b)) for t, a, b, _ in x.links()] or [np.zeros(0, dtype=np.int64)]
    keyed = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
    cuts = np.searchsorted(keyed >> 32, np.arange(1, texts))
    return np.split((keyed & 0xFFFFFFFF).astype(np.int64), cuts)


def _columns(batch: pa.RecordBatch, i: int, j: int) -> dict[str, pa.Array]:
    part = batch.slice(i, j - i)
    return dict(zip(part.schema.names, part.columns))


def encoded_texts(docs: DataFrame, sides: Broadcast, text: str) -> DataFrame:
    """The rows without their text, with ``__a`` and ``__b``, the packed tokens of both sides, and ``__pairs``, the packed distinct
    pairs that they hold linked."""
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Sides(*sides.value)
        lengths = both.length_a, both.length_b
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in _chunks([len(t or "") for t in texts]):
                tokens = [both.tokens(t) for t in texts[i:j]]
                found = _text_pairs(align(lengths, tokens), both.size_b, j - i)
                rows = _columns(batch, i, j)
                del rows["__text"]
                for name, ids, size in zip(("__a", "__b"), zip(*tokens), (both.size_a, both.size_b)):
                    rows[name] = pa.array([x.astype(_id_type(size)).tobytes() for x in ids], pa.binary())
                rows["__pairs"] = pa.array([p.astype("<u4").tobytes() for p in found], pa.binary())
                yield pa.RecordBatch.from_arrays(list(rows.values()), list(rows))

    added = [StructField(c, BinaryType()) for c in ("__a", "__b", "__pairs")]
    read = docs.select(F.col(text).cast("string").alias("__text"), *[F.col(f.name) for f in kept])
    return read.mapInArrow(run, StructType([*kept, *added]))


def _id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def distinct_pairs(stored: DataFrame) -> DataFrame:
    """The distinct pairs of all texts; each task passes on a batch's pairs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def merged() -> np.ndarray:
            return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype="<u4")

        for batch in batches:
            parts.append(np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u4")))
            size += len(parts[-1])
            if size >= SHARD_PAIRS:
                parts = [merged()]
                size = len(parts[0])
                if 2 * size >= SHARD_PAIRS:  # little repeats here: pass on and start afresh
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0].astype(np.int64))], ["pair"])
                    parts, size = [], 0
        rest = merged().astype(np.int64)
        for i in range(0, len(rest), SEGMENT):
            yield pa.RecordBatch.from_arrays([pa.array(rest[i : i + SEGMENT])], ["pair"])

    return stored.select("__pairs").mapInArrow(run, "pair long").distinct()


def hash_buckets(pairs: DataFrame, dealt: int) -> DataFrame:
    """One row per bucket with its pairs and the levels of their minimal perfect hash."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(group["pair"].to_numpy())
        levels = [x.tobytes() for x in build_levels(keys)]
        return pd.DataFrame({"bucket": [int(group["bucket"].iloc[0])], "n": [len(keys)], "pairs": [keys.astype("<u4").tobytes()], "levels": [levels]})

    numbered = pairs.withColumn("bucket", _bucket("pair", dealt))
    return numbered.groupBy("bucket").applyInPandas(build, "bucket long, n long, pairs binary, levels array<binary>")


def _index(built: DataFrame, buckets: Sequence[int], dealt: int) -> PairIndex:
    rows = built.filter(F.col("bucket").between(min(buckets), max(buckets))).collect()
    unpack = lambda r: [np.frombuffer(x, dtype=np.uint8) for x in r["levels"]]
    return PairIndex([(r["bucket"], np.frombuffer(r["pairs"], dtype="<u4").astype(np.int64), unpack(r)) for r in rows], dealt)


def _summed(vectors: DataFrame, *keys: str) -> DataFrame:
    """Vectors of equal keys added up; a task holds one sum at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array([k], pa.int64()) for k in held), pa.array([total.tobytes()], pa.binary())], [*keys, "counts"]
            )

        for batch in batches:
            for *key, packed in zip(*(c.to_pylist() for c in batch.columns)):
                vector = np.frombuffer(packed, dtype="<i8")
                if key == held:
                    total += vector
                else:
                    if held is not None:
                        yield out()
                    held, total = key, vector.copy()
        if held is not None:
            yield out()

    ordered = vectors.select(*keys, "counts").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", counts binary")


def count_vectors(stored: DataFrame, index: Broadcast) -> DataFrame:
    """How many texts hold each pair of the shard: segments of a dense vector in the order of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = index.value
        dense, seen = np.zeros(len(places.pairs), dtype=np.int64), False
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u4").astype(np.int64)
            at = places.places(keys)
            at = at[at >= 0]
            seen = seen or len(at) > 0
            dense += np.bincount(at, minlength=len(dense))
        for i in range(0, len(dense), SEGMENT) if seen else ():
            part = dense[i : i + SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // SEGMENT], pa.int64()), pa.array([part.astype("<i8").tobytes()], pa.binary())], ["segment", "counts"]
                )

    parts = stored.select("__pairs").mapInArrow(run, "segment long, counts binary")
    branches = parts.withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(16)).cast("long"))
    return _summed(_summed(branches, "segment", "branch"), "segment")


def _vector(segments: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    for row in segments.collect():
        part = np.frombuffer(row["counts"], dtype="<i8")
        out[row["segment"] * SEGMENT : row["segment"] * SEGMENT + len(part)] = part
    return out


def look_up(stored: DataFrame, lengths: Broadcast, counted: Broadcast, first: bool) -> DataFrame:
    """Align texts again and add up the counts of their links as far as the shard holds them."""
    names = stored.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [len(x) for x in lengths.value]
        marked = id_words(max(sizes))
        index, counts, highest = counted.value
        for batch in batches:
            packed = [batch.column(names.index(c)).to_pylist() for c in ("__a", "__b")]
            tokens = list(zip(*([np.frombuffer(x, dtype=_id_type(size)) for x in side] for side, size in zip(packed, sizes))))
            for i, j in _chunks([len(a) for a, _ in tokens]):
                x = align(lengths.value, tokens[i:j])
                links, best, total = (np.zeros(j - i, dtype=np.int64) for _ in range(3))
                for t, a, b, times in x.links():
                    at = index.places(a * sizes[1] + b)
                    count = np.where(at >= 0, counts[at], 0) if len(counts) else np.zeros(len(at), dtype=np.int64)
                    edges = np.flatnonzero(np.diff(t, prepend=-1))
                    which = t[edges]
                    links[which] += np.add.reduceat(times, edges)
                    best[which] += np.add.reduceat(times * ((at >= 0) & (count == highest[a])), edges)
                    total[which] += np.add.reduceat(times * count, edges)
                rows = _columns(batch, i, j)
                if first:
                    values = [np.diff(x.texts_a), np.diff(x.texts_b), np.diff(x.texts_g), links, best, total]
                    rows |= {name: pa.array(v.astype(np.int64)) for name, v in zip(ADDED, values)}
                    rows["group_ids"] = pa.array(group_texts(marked, x), pa.string())
                else:
                    rows["n_best"] = pa.array(rows["n_best"].to_numpy() + best)
                    rows["count_sum"] = pa.array(rows["count_sum"].to_numpy() + total)
                yield pa.RecordBatch.from_arrays(list(rows.values()), list(rows))

    fields = list(stored.schema.fields)
    if first:
        fields += [StructField(c, LongType()) for c in ADDED] + [StructField("group_ids", StringType())]
    return stored.mapInArrow(run, StructType(fields))


def align_documents(docs: DataFrame, vocabulary_a: str, pattern_a: str, model_b: str, text: str = "text", shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """The rows without their text, with the numbers of tokens, groups and links, ``n_best``, ``count_sum`` and ``group_ids``.

    ``n_best``: links whose pair is held by as many documents as any pair of its token of side a; ``count_sum``: the
    numbers of documents that hold the pairs, added over the links.
    """
    spark = docs.sparkSession
    ranks, model = read_byte_level(vocabulary_a), read_pieces(model_b)
    both = Sides(ranks, pattern_a, model)
    sides = spark.sparkContext.broadcast((ranks, pattern_a, model))
    lengths = spark.sparkContext.broadcast((both.length_a, both.length_b))
    stored = materialize(encoded_texts(docs.drop(*ADDED, "group_ids", *_OWN), sides, text), "tokens")
    pairs = materialize(distinct_pairs(stored), "pairs")
    dealt = max(1, pairs.count() // BUCKET_PAIRS)
    built = materialize(hash_buckets(pairs, dealt), "hash-buckets")

    shards: list[list[int]] = [[]]
    held = 0
    for row in built.select("bucket", "n").orderBy("bucket").collect():
        if shards[-1] and held + row["n"] > shard_pairs:
            shards.append([])
            held = 0
        shards[-1].append(row["bucket"])
        held += row["n"]
    shards = [s for s in shards if s]

    highest, vectors = np.zeros(both.size_a, dtype=np.int64), []
    counting = stored.coalesce(2 * spark.sparkContext.defaultParallelism)
    for shard in shards:
        index = _index(built, shard, dealt)
        shared = spark.sparkContext.broadcast(index)
        vectors.append(materialize(count_vectors(counting, shared), "counts"))
        np.maximum.at(highest, index.pairs.astype(np.int64) // both.size_b, _vector(vectors[-1], len(index.pairs)))
        shared.unpersist()
    out = stored.drop("__pairs")
    for n, (shard, segments) in enumerate(zip(shards, vectors)):
        index = _index(built, shard, dealt)
        counted = spark.sparkContext.broadcast((index, _vector(segments, len(index.pairs)), highest))
        out = look_up(out, lengths, counted, n == 0)
        if n + 1 < len(shards):
            out = materialize(out, "looked-up")
    if not shards:
        nothing = spark.sparkContext.broadcast((PairIndex([], dealt), np.zeros(0, dtype=np.int64), highest))
        out = look_up(out, lengths, nothing, True)
    return out.drop(*_OWN)


def digest(aligned: DataFrame, *keys: str) -> DataFrame:
    """The keys, the numbers and the SHA-256 of the groups, empty for texts without tokens."""
    hashed = F.when(F.col("group_ids") == "", "").otherwise(F.sha2("group_ids", 256))
    return aligned.select(*keys, *ADDED, hashed.alias("groups_sha256"))
