"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding lower-cases, maps look-alike letters to Latin ones and reads digits and signs inside words as the
letters they stand for. Lexicon entries are whole words or word beginnings with weights learned from labelled
documents; a word counts once, by its longest entry; words inside an exception phrase do not count. The sum of
weights, and the sum for each hundred words, go through a logistic curve that is fitted on the same labelled documents.

Learning is bounded: at most ``sample`` labelled documents (expected; drawn by a hash of the id, toxic and other ones
by half each) are looked at, so the lexicon, the automaton and what is broadcast are bounded too. Scoring covers all documents.

Defined cases: a null or empty text has no matches and gets the lowest score; a label that is null or occurs more
than once counts by its largest value; documents with a null id are scored and never learned from; ids that occur more than
once are scored row by row; without labelled documents, or with one class only, the given seed words alone
score, by a fixed curve; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.session import materialize

# Letters that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKES = dict(
    zip(
        "аеорсухіјѕԁԛԝһкмтвнгпαβεικνοπρτυχνκıɑɡӏ",
        "aeopcyxijsdqwhkmtbhrnabeiknonptuxvkiagl",
        strict=True,
    )
)
DIGITS = dict(zip("0134578", "oieastb", strict=True))
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
#: Words that insult in any context; learned weights replace and extend these.
SEED = (
    "idiot idiots moron morons imbecile loser losers scum trash worthless pathetic disgusting stupid dumb clown "
    "cretin scumbag bastard retard degenerate subhuman vermin"
).split()
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "class clown", "clown fish", "sore loser", "dumb bell", "dumb waiter")
SEED_WEIGHT = 3.0

WORD = re.compile(r"[^\W\d_]+")
SIGN_IN_WORD = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")
DIGIT_IN_WORD = re.compile(r"\w*[^\W\d_]\w*")
HAS_DIGIT = re.compile(r"[0-9]")
_FOLD = str.maketrans({**LOOK_ALIKES, **{chr(0xFF01 + i): chr(0x21 + i).lower() for i in range(94)}})
_DIGITS = str.maketrans(DIGITS)
#: Toxic share that some language or source may have among its labelled texts; chance is reckoned with it at least.
LANGUAGE_SHARE = 0.2
#: A beginning is an entry of its own if it reaches so many times the texts of any longer entry below it.
GENERALISES = 1.2
#: Lengths of word beginnings that learning considers besides whole words.
STEMS = (4, 5, 6)


def fold(text: str) -> str:
    """Lower case with look-alikes, and digits and signs inside words, read as Latin letters."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(_FOLD)
    if "@" in low or "$" in low or "!" in low or "|" in low:
        low = SIGN_IN_WORD.sub(lambda m: SIGNS[m[0]], low)
    if HAS_DIGIT.search(low):
        low = DIGIT_IN_WORD.sub(lambda m: m[0].translate(_DIGITS), low)
    return low


@dataclass
class Lexicon:
    """``words`` and ``stems`` (word beginnings) with weights; ``exceptions`` are phrases in folded form."""

    words: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        """Entries with a space for each word boundary, so one pass over spaced words finds all."""
        machine = ahocorasick.Automaton()
        for entries, end in ((self.stems, ""), (self.words, " ")):
            for entry, weight in entries.items():
                machine.add_word(f" {entry}{end}", (len(entry) + 1, weight, len(end)))
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 1, None, 1))
        if len(machine):
            machine.make_automaton()
        return machine


def match(text: str | None, machine: ahocorasick.Automaton) -> tuple[float, int]:
    """Sum of the weights of matched words, and the number of words."""
    if not text:
        return 0.0, 0
    words = WORD.findall(fold(text))
    if not len(machine):
        return 0.0, len(words)
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for last, (length, weight, end) in machine.iter(f" {' '.join(words)} "):
        start = last - end - length + 1
        if weight is None:
            spared.append((start, last))
        elif length > best.get(start, (0, 0.0))[0]:
            best[start] = (length, weight)
    if spared:
        best = {s: v for s, v in best.items() if not any(a <= s < b for a, b in spared)}
    return sum(w for _, w in best.values()), len(words)


def _weights(text: Column, lexicon: Lexicon) -> Column:
    @F.pandas_udf("weight double, words int")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = lexicon.automaton()
        for texts in batches:
            yield pd.DataFrame([match(t, machine) for t in texts], columns=["weight", "words"])

    return weigh(F.coalesce(text, F.lit("")))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> DataFrame:
    """Texts with labels (``text``, ``label``) for learning: none held out, at most ``sample`` rows expected; stored."""
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(key)
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("label") == c, min(1.0, sample / 2 / n)) for c, n in sizes.items()], F.lit(0.0))
    chosen = known.filter(place < share)
    # the sample is bounded by its parameter, so the small side may be broadcast
    joined = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key)
    return materialize(joined.select("text", "label"), "toxicity-sample")


def _feature_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        toxic: dict[str, set] = defaultdict(set)
        held_by: Counter = Counter()
        clean: Counter = Counter()
        for text, label in zip(batch["text"], batch["label"], strict=True):
            words = WORD.findall(fold(text or ""))
            if label:
                for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                    for feature in features(word):
                        toxic[feature].add(hash_of(before, after))
            (held_by if label else clean).update({f for w in set(words) for f in features(w)})
        yield pd.DataFrame(
            [(f, list(c), held_by[f], 0) for f, c in toxic.items()] + [(f, [], 0, n) for f, n in clean.items()],
            columns=["feature", "contexts", "toxic", "clean"],
        )


def features(word: str) -> list[str]:
    """The whole word, marked by a space at its end, and its beginnings."""
    return [word + " "] + [word[:n] for n in STEMS if len(word) > n]


def hash_of(*words: str) -> int:
    """A number for a tuple of words that is the same in every worker."""
    value = 0
    for c in "\n".join(words):
        value = (value * 1000003 ^ ord(c)) & 0x7FFFFFFFFFFFFFFF
    return value


def learn_lexicon(sample: DataFrame, most: int = 4000) -> Lexicon:
    """Entries that stand in toxic texts far more often than chance allows, at most ``most``.

    An entry counts by its toxic texts or by its distinct neighbouring words there, whichever are fewer, so that
    copies of one toxic text count once. It is taken when so many toxic and so few clean texts have a chance
    below 5 % over all entries looked at.
    """
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({w: SEED_WEIGHT for w in SEED})
    rows = sample.mapInPandas(_feature_counts, "feature string, contexts array<long>, toxic long, clean long")
    counts = (
        rows.groupBy("feature")
        .agg(
            F.least(
                F.size(F.array_distinct(F.flatten(F.collect_list("contexts")))).cast("long"), F.sum("toxic")
            ).alias("toxic"),
            F.sum("clean").alias("clean"),
        )
    )
    p = max(toxic / (toxic + clean), LANGUAGE_SHARE)
    needed = max(3.0, math.log(0.05 / max(200 * toxic, 1)) / math.log(p))
    taken = (
        counts.filter((F.col("toxic") >= needed) & (F.col("clean") * 20 * toxic < F.col("toxic") * clean))
        .orderBy(F.desc("toxic"), "feature")
        .limit(most)
        .collect()
    )
    words, stems = {}, {}
    reached: dict[str, int] = {}  # the most that one longer entry with this beginning reaches
    for r in taken:
        entry = r.feature.rstrip(" ")
        for n in STEMS:
            if n < len(r.feature):
                reached[entry[:n]] = max(reached.get(entry[:n], 0), r.toxic)
    for r in taken:
        if r.toxic < GENERALISES * reached.get(r.feature, 0):
            continue
        weight = math.log((r.toxic + 0.5) / (toxic + 1)) - math.log((r.clean + 0.5) / (clean + 1))
        if weight <= 0:
            continue
        if r.feature.endswith(" "):
            words[r.feature[:-1]] = weight
        else:
            stems[r.feature] = weight
    for word in SEED:
        if word not in words:
            words[word] = SEED_WEIGHT
    return Lexicon(words, stems)


@dataclass
class ToxicityModel:
    """A lexicon and the curve: intercept, factor of log(1 + weight) and of log(1 + weight in a hundred words)."""

    lexicon: Lexicon
    curve: tuple[float, float, float] = (-4.0, 3.0, 1.0)

    def inputs(self, found: Column) -> list[Column]:
        rate = 100.0 * found["weight"] / F.greatest(found["words"], F.lit(1))
        return [F.log1p(found["weight"]), F.log1p(rate)]

    def score(self, text: Column) -> Column:
        """The score of a text, in 0 to 1."""
        found = _weights(text, self.lexicon)
        intercept, by_sum, by_rate = self.curve
        total, rate = self.inputs(found)
        return 1.0 / (1.0 + F.exp(-(F.lit(intercept) + F.lit(by_sum) * total + F.lit(by_rate) * rate)))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = 12000,
) -> ToxicityModel:
    """Lexicon and curve from the labelled documents that are not held out."""
    rows = labelled_sample(docs, labels, key, text, label, sample)
    model = ToxicityModel(learn_lexicon(rows))
    found = rows.select("label", _weights(F.col("text"), model.lexicon).alias("found"))
    inputs = materialize(
        found.select(F.col("label").cast("double"), array_to_vector(F.array(*model.inputs(F.col("found")))).alias("x")),
        "toxicity-inputs",
    )
    classes = inputs.groupBy("label").count().collect()
    if len(classes) < 2:
        return model
    fitted = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-3, standardization=False).fit(inputs)
    return ToxicityModel(model.lexicon, (fitted.intercept, *map(float, fitted.coefficients)))


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", cut_off: float = 0.3
) -> DataFrame:
    """The rows with ``held_out``, ``score`` and ``predicted`` (1 from the cut-off on)."""
    return (
        docs.withColumn("score", model.score(F.col(text)))
        .withColumn("held_out", held_out(F.col(key)))
        .withColumn("predicted", (F.col("score") >= cut_off).cast("int"))
    )
