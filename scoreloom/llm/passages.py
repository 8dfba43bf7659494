"""Passages that repeat across documents, by MinHash banding of paragraphs.

Paragraphs are lines, and runs of sentences that also stand in other documents, so that a passage is a paragraph of its own
even where it was pasted into a longer line or goes over several. (A sentence ends at ``.``, ``!``, ``?`` or the line's end;
very long ones also after words chosen by their hash. Runs end where sentences no longer come from the same documents.)
Equal paragraphs are one class. Classes get a MinHash signature of their word shingles, cut into bands; classes that
collide in a band are joined, confirmed by the exact Jaccard similarity of their shingle sets, and connected. Of a
component that reaches over several documents the paragraphs of one document stay, all others are removals.

With ``BANDS`` = 6 of 2 values a pair at the limit of 0.8 collides with a chance of 0.998, one at 0.9 of 0.99995. Classes of a
band value that more than ``CROWD`` share are linked to the smallest and the next of them first; then all classes of crowds
are joined on their rarest shingles (``prefix_join``), which proposes every pair at the limit that these links left apart.

Defined cases: a null or empty text has no paragraphs; texts of fewer than ``least_run`` words have none; equal rows
(key and text) are one document; a passage that repeats inside one document only is left; of documents the one with the
smallest key stays, a null key being largest; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.llm.components import components
from scoreloom.llm.prefix_join import pairs_across
from scoreloom.llm.shingles import Shingler, least_values, mixed, pairs_within, random_factors, shared_count
from scoreloom.session import materialize

BANDS, ROWS = 6, 2
CROWD = 32
#: Words of a sentence that is looked up; shorter ones only bridge.
SENTENCE = 8
#: Sentences beyond so many words are also cut after one word in eight, chosen by hash; their pieces may be shorter.
LONG_SENTENCE = 48
PIECE = 4
#: Spans that may be broadcast, at some 40 bytes each.
MOST_IDS = 100_000
#: Bits of the filter of documents that hold a span: for each span, and at most (32 MB).
SPAN_BITS, MOST_BITS = 8, 1 << 28

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\n"]] = True
_FACTORS, _SHIFTS = random_factors(BANDS * ROWS, 20240301)
_ODD = np.uint64(0xD6E8FEB86659FD93)


class Reading:
    """Words of a text with their hashes, places in code points, lines and sentences."""

    def __init__(self, text: str, shingler: Shingler):
        data = np.frombuffer(text.encode("utf-8").lower(), dtype=np.uint8)
        self.hashes, starts, ends = shingler.cut(data, ~_WORD)
        self.count = len(starts)
        if not self.count:
            return
        # code points before a byte: bytes less continuation bytes
        before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.starts, self.ends = before[starts], before[ends]
        self.lines = np.cumsum(data == 0x0A)[starts]
        sentence = np.cumsum(_END[data])[starts]
        firsts = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
        sizes = np.diff(np.append(firsts, self.count))
        least = np.full(self.count, SENTENCE)
        if sizes.max() > LONG_SENTENCE:
            long_word = np.repeat(sizes > LONG_SENTENCE, sizes)
            cut_after = np.flatnonzero(long_word & (self.hashes % np.uint64(8) == 0)) + 1
            firsts = np.union1d(firsts, cut_after[cut_after < self.count])
            sizes = np.diff(np.append(firsts, self.count))
            least[long_word] = PIECE
        self.firsts, self.sizes, self.known = firsts, sizes, sizes >= least[firsts]
        place = np.arange(self.count) - np.repeat(firsts, sizes)
        weighted = mixed(self.hashes * _ODD + place.astype(np.uint64))
        self.sentences = mixed(np.add.reduceat(weighted, firsts) + sizes.astype(np.uint64)).view(np.int64)

    def looked_up(self) -> np.ndarray:
        """Hashes of the sentences that are long enough."""
        return np.unique(self.sentences[self.known]) if self.count else np.empty(0, dtype=np.int64)

    def paragraphs(self, repeated: dict[int, int], least: int, least_run: int) -> list[tuple[int, int]]:
        """Word ranges of lines of ``least`` words and runs of ``least_run`` or more; ``repeated``: sentence hash to
        a number for the documents that hold it."""
        found: set[tuple[int, int]] = set()
        edges = np.flatnonzero(np.concatenate(([True], self.lines[1:] != self.lines[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= least:
                found.add((a, b))
        if repeated:
            for same_holders in (False, True):
                run: tuple[int, int, int] | None = None  # first word, end, holders
                for first, size, hashed, known in zip(
                    self.firsts.tolist(), self.sizes.tolist(), self.sentences.tolist(), self.known.tolist(), strict=True
                ):
                    holders = repeated.get(hashed) if known else None
                    joins = run is not None and (not same_holders or holders in (None, run[2]))
                    if not known and joins:
                        continue  # short sentences bridge
                    if holders is not None and joins:
                        run = (run[0], first + size, run[2])
                        continue
                    if run is not None and run[1] - run[0] >= least_run:
                        found.add(run[:2])
                    run = (first, first + size, holders) if holders is not None else None
                if run is not None and run[1] - run[0] >= least_run:
                    found.add(run[:2])
        return sorted(found)


def _sentence_hashes(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler = Shingler(1)
        for texts in batches:
            yield pd.Series([Reading(t, shingler).looked_up() if t else [] for t in texts], dtype=object)

    return hashes(text)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A value per band from the least values of sets (sets x hash functions)."""
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(least), BANDS))
    for i in range(ROWS):
        keys = mixed(keys * _ODD + least[:, i::ROWS])
    return keys.view(np.int64)


def _least_in_ranges(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each range of a text's shingles the least value under each hash function; ranges may overlap."""
    between = np.stack([starts, ends], axis=1).ravel()
    padded = np.append(shingles, shingles[-1:])  # a range may end with the text
    out = np.empty((len(starts), len(_FACTORS)), dtype=np.uint64)
    for i, (factor, shift) in enumerate(zip(_FACTORS, _SHIFTS, strict=True)):
        out[:, i] = np.minimum.reduceat(padded * factor + shift, between)[::2]
    return out


def described(words: np.ndarray, spans: list[tuple[int, int]], shingler: Shingler) -> tuple[list[int], list[int], list[list[int]]]:
    """Number of distinct shingles, hash of the words in order, and band values of spans of a text's words."""
    a, b = (np.array(x) for x in zip(*spans, strict=True))
    hashes = shingler.range_hashes(words, a, b).view(np.int64).tolist()
    width = shingler.width
    if (b - a < width).any():
        own = [shingler.of_words(words[i:j]) for i, j in spans]
        least = np.stack([least_values(x, _FACTORS, _SHIFTS) for x in own])
        return list(map(len, own)), hashes, band_keys(least).tolist()
    # shingles of the whole text, of which a span's are a part
    whole = shingler.in_order(words)
    ends = b - width + 1
    if len(np.unique(whole)) == len(whole):
        counts = (ends - a).tolist()
    else:
        counts = [len(np.unique(whole[i:j])) for i, j in zip(a.tolist(), ends.tolist(), strict=True)]
    return counts, hashes, band_keys(_least_in_ranges(whole, a, ends)).tolist()


PARAGRAPHS = "array<struct<start:int,end:int,words:int,shingles:int,hash:long,bands:array<long>>>"


def _paragraphs(text: Column, repeated: Column, width: int, least: int, least_run: int) -> Column:
    @F.pandas_udf(PARAGRAPHS)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        shingler = Shingler(width)
        for texts, holders in batches:
            out = []
            for text, pairs in zip(texts, holders, strict=True):
                rows = []
                if text:
                    reading = Reading(text, shingler)
                    known = {p["hash"]: p["holders"] for p in pairs} if pairs is not None else {}
                    spans = reading.paragraphs(known, least, least_run) if reading.count else []
                    if spans:
                        starts, ends = reading.starts, reading.ends
                        for (a, b), n, hashed, bands in zip(spans, *described(reading.hashes, spans, shingler), strict=True):
                            rows.append(
                                {
                                    "start": int(starts[a]), "end": int(ends[b - 1]), "words": b - a, "shingles": n, "hash": hashed,
                                    "bands": bands,
                                }
                            )
                out.append(rows)
            yield pd.Series(out, dtype=object)

    return cut(text, repeated)


def _span_sets(text: Column, start: Column, end: Column, width: int) -> Column:
    @F.pandas_udf("binary")
    def sets(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        shingler = Shingler(width)
        for texts, starts, ends in batches:
            out = []
            for t, a, b in zip(texts, starts, ends, strict=True):
                out.append(shingler.packed(shingler.of_words(Reading(t[a:b], shingler).hashes)))
            yield pd.Series(out, dtype=object)

    return sets(text, start, end)


def _document(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.xxhash64(F.col(text)))


def find_paragraphs(docs: DataFrame, width: int, least: int, least_run: int, key: str, text: str) -> DataFrame:
    """One row per distinct document and paragraph: ``doc``, ``key``, place, ``hash`` and ``bands``; stored."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _document(key, text).alias("doc"))
    sentences = materialize(rows.select("doc", F.explode(_sentence_hashes(F.col("text"))).alias("hash")), "sentences")
    shared = (
        sentences.groupBy("hash")
        .agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
        .filter("low < high")
        .select("hash", F.xxhash64("low", "high").alias("holders"))
    )
    by_document = (
        sentences.join(shared, "hash").groupBy("doc").agg(F.collect_set(F.struct("hash", "holders")).alias("repeated"))
    )
    joined = rows.join(by_document, "doc", "left")
    spans = _paragraphs(F.col("text"), F.col("repeated"), width, least, least_run)
    return materialize(joined.select("doc", "key", F.explode(spans).alias("p")).select("doc", "key", "p.*"), "paragraphs")


def _may_hold(doc: Column, spans: DataFrame, count: int) -> Column:
    """False only for documents (by hash) that hold none of the ``count`` spans, and for most of those: a bit for each hash."""
    bits = min(max(1 << (SPAN_BITS * count).bit_length(), 1 << 15), MOST_BITS)
    place = F.pmod(F.col("__doc"), F.lit(bits)) + 1
    parts = spans.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("held")
    )
    held = np.zeros((bits >> 15, 1 << 12), dtype=np.uint8)
    for row in parts.collect():
        held[row["part"] - 1] = np.frombuffer(row["held"], dtype=np.uint8)
    shared = spans.sparkSession.sparkContext.broadcast(held.tobytes())

    @F.pandas_udf("boolean")
    def may(docs: pd.Series) -> pd.Series:
        at = docs.to_numpy(dtype=np.int64) % bits
        return pd.Series((np.frombuffer(shared.value, dtype=np.uint8)[at >> 3] >> (at & 7) & 1).astype(bool))

    return may(doc)


def _colliding(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``u`` < ``v`` of class ids that share a band, in crowds with two others only; and ``id`` of the classes in
    crowds."""
    rows = classes.select("id", F.explode("bands").alias("region"))
    shared = materialize(
        rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("u"), F.max("id").alias("v")).filter("n > 1"),
        "bands",
    )
    crowds = materialize(rows.join(shared.filter("n > 2").select("region", "n", F.col("u").alias("low")), "region"), "bands")
    small = crowds.filter(F.col("n") <= CROWD).select("region", "id")
    large = crowds.filter(F.col("n") > CROWD)
    slot = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 1000))
    order = Window.partitionBy("region", "slot").orderBy("id")
    chain = large.withColumn("slot", slot).select(F.lag("id").over(order).alias("u"), F.col("id").alias("v"))
    pairs = (
        shared.filter("n = 2").select("u", "v")
        .unionByName(pairs_within(small))
        .unionByName(large.select(F.col("low").alias("u"), F.col("id").alias("v")))
        .unionByName(chain.filter(F.col("u").isNotNull()))
    )
    return pairs.filter("u < v").distinct(), large.select("id").distinct()


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``u``, ``v`` with 100 * shared >= percent * union on the full sets; stored."""
    both = pairs.select("u", "v").join(sets.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("set").alias("a")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("set").alias("b")), "v"
    )
    counted = both.select("u", "v", (F.col("nu") + F.col("nv")).alias("sum"), shared_count(F.col("a"), F.col("b")).alias("shared"))
    return materialize(
        counted.filter(100 * F.col("shared") >= percent * (F.col("sum") - F.col("shared"))).select("u", "v"), "passage-links"
    )


def repeated_passages(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    least_words: int = 35,
    least_run: int = 25,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per paragraph that repeats across documents: key, ``start`` and ``end`` (code points, end exclusive),
    ``n_words``, ``cluster_id``, ``keep_id`` (key of the document whose copy stays) and ``kept``."""
    found = find_paragraphs(docs, width, least_words, least_run, key, text)
    classes = materialize(
        found.groupBy("hash")
        .agg(
            F.min(F.struct("doc", "start", "end")).alias("name"), F.first("bands").alias("bands"), F.first("shingles").alias("n")
        )
        .select("hash", "name.*", "bands", "n", F.monotonically_increasing_id().alias("id")),
        "paragraph-classes",
    )
    sizes = classes.select("id", "n")
    colliding, crowd = _colliding(classes)
    crowd = materialize(crowd, "crowd-ids")
    pairs = materialize(
        colliding.join(sizes.select(F.col("id").alias("u"), F.col("n").alias("nu")), "u")
        .join(sizes.select(F.col("id").alias("v"), F.col("n").alias("nv")), "v")
        .filter(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")),
        "colliding",
    )
    ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).unionByName(crowd).distinct()
    spans = materialize(classes.join(ids, "id").select("id", "n", F.col("doc").alias("__doc"), "start", "end"), "named-spans")
    count = spans.count()
    few = count <= MOST_IDS
    texts = docs.select(F.col(text).alias("text"), _document(key, text).alias("doc"))
    if not few:
        # only texts that are likely to hold a span are moved to them
        texts = texts.filter(_may_hold(F.col("doc"), spans, count))
    named = texts.join(F.broadcast(spans) if few else spans, F.col("doc") == F.col("__doc"))
    sets = materialize(
        named.select("id", "n", _span_sets(F.col("text"), F.col("start"), F.col("end"), width).alias("set")).dropDuplicates(["id"]),
        "paragraph-sets",
    )
    links = _links(pairs, sets, percent)
    part = components(links)
    if not crowd.isEmpty():
        rest = pairs_across(sets.join(crowd, "id", "left_semi"), part, percent)
        part = components(links.unionByName(_links(rest, sets, percent)))
    cluster = classes.select("hash", "id").join(part, "id", "left").select(
        "hash", F.coalesce("component", "id").alias("cluster_id")
    )
    members = materialize(
        found.select("doc", "key", "start", "end", F.col("words").cast("long").alias("n_words"), "hash").join(cluster, "hash"),
        "members",
    )
    reach = (
        members.groupBy("cluster_id")
        .agg(
            F.min("doc").alias("low"),
            F.max("doc").alias("high"),
            F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("doc"))).alias("keep"),
        )
        .filter("low < high")
    )
    return members.join(reach, "cluster_id").select(
        F.col("key").alias(key),
        "start",
        "end",
        "n_words",
        "cluster_id",
        F.col("keep.key").alias("keep_id"),
        (F.col("doc") == F.col("keep.doc")).alias("kept"),
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which may overlap."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    return "".join(out) + text[at:]


def remove_passages(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with ``clean_text``: the text without the passages that are not kept. Keys must be unique and not null."""
    spans = passages.filter(~F.col("kept")).groupBy(key).agg(F.collect_set(F.struct("start", "end")).alias("__spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series(
            [
                t if t is None or p is None else cut_spans(t, [(s["start"], s["end"]) for s in p])
                for t, p in zip(texts, places, strict=True)
            ],
            dtype=object,
        )

    return docs.join(spans, key, "left").withColumn("clean_text", cut(F.col(text), F.col("__spans"))).drop("__spans")
