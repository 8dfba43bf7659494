"""Token counts by byte-pair merging over a heap and a linked list.

The counter needs no identifiers: a word starts as one symbol per byte, every merge removes one symbol, so
its count is its bytes minus its merges. Words repeat, so each Python worker remembers a bounded number of
word counts.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); white space gives no tokens; repeated rows
and ties are counted row by row; columns of the input that clash with the added ones are replaced; an empty
table gives an empty result with the same columns. Texts of any length are merged whole: a word of n bytes
takes O(n log n) steps.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Words whose counts a worker remembers before it starts afresh.
REMEMBERED_WORDS = 1 << 20

#: Below this letter all Unicode versions agree on classes and lower case (measured against the library).
SETTLED_LETTERS = "\u0500"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabularies of this kind."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(printable))
    return [letters[b] for b in range(256)]


def merges_needed(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges the symbols of one word undergo, always the lowest-ranked adjacent pair first, then the leftmost."""
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(ranks[pair], i) for i in range(n - 1) if (pair := (symbols[i], symbols[i + 1])) in ranks]
    heapq.heapify(heap)
    merged = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if not symbols[i] or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two has been merged since
        symbols[i] += symbols[j]
        symbols[j] = ""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        merged += 1
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (pair := (symbols[left], symbols[right])) in ranks:
                heapq.heappush(heap, (ranks[pair], left))
    return merged


class WordCounter:
    """Counts the tokens of texts as a lower-casing byte-pair vocabulary with word ends does.

    ``ranks``: pair of symbols to its place among the merges; ``pattern``: what counts as a word;
    ``specials``: strings of the raw text that are one token each; ``word_end``: what marks a word's last symbol;
    ``cut``: the vocabulary's own splitter into words of byte letters, for texts with letters of which Unicode
    versions disagree.
    """

    def __init__(
        self,
        ranks: dict[tuple[str, str], int],
        pattern: str,
        specials: list[str],
        word_end: str,
        cut: Callable[[str], list[str]] | None = None,
    ):
        self.ranks, self.word_end, self.cut = ranks, word_end, cut
        self.letters = byte_letters()
        self.words = regex.compile(pattern)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.known: dict[str, int] = {}

    @classmethod
    def from_spec(cls, spec: dict) -> WordCounter:
        bare = Tokenizer.from_str(spec["splitter"])

        def cut(text: str) -> list[str]:
            return [word for word, _ in bare.pre_tokenizer.pre_tokenize_str(bare.normalizer.normalize_str(text))]

        return cls({tuple(p): i for i, p in enumerate(spec["merges"])}, spec["pattern"], spec["specials"], spec["word_end"], cut)

    def word(self, letters: list[str]) -> int:
        symbols = letters[:-1] + [letters[-1] + self.word_end]
        return len(symbols) - merges_needed(symbols, self.ranks)

    def segment(self, text: str) -> int:
        if self.cut is not None and not text.isascii() and max(text) >= SETTLED_LETTERS:
            return sum(self.word(list(word)) for word in self.cut(text))
        if not text.isascii():
            # lower case is taken letter by letter: no special form of sigma at the end of a word
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        known, letters, total = self.known, self.letters, 0
        for word in self.words.findall(text.lower()):
            count = known.get(word)
            if count is None:
                if len(known) >= REMEMBERED_WORDS:
                    known.clear()
                count = known[word] = self.word([letters[b] for b in word.encode("utf-8")])
            total += count
        return total

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if self.specials is None:
            return self.segment(text)
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(map(self.segment, parts))


def read_vocabulary(path: str) -> dict:
    """What counting needs from a vocabulary file, read on the driver; its size is that of the file."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    split = next(p for p in content["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    bare = content | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
    return {
        "splitter": json.dumps(bare),
        "merges": merges,
        "pattern": split["pattern"]["Regex"],
        "specials": [t["content"] for t in content["added_tokens"]],
        "word_end": model["end_of_word_suffix"] or "",
    }


def token_counter(spark: SparkSession, vocabulary: str) -> Callable[[Column], Column]:
    """A column function from text to its number of tokens under the vocabulary file."""
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = WordCounter.from_spec(shared.value)
        for texts in batches:
            yield pd.Series([counter.text(t) for t in texts], dtype="int64")

    return count


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """The rows with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumns(
        {"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": token_counter(docs.sparkSession, vocabulary)(whole)}
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
