"""Token alignment against a plain version, and the perfect hash on its own."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from corpus import awkward
from tokenizers import Tokenizer

from scoreloom.llm import alignment
from scoreloom.llm.token_counts import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["a  b\n c▁d", "  two  spaces", "naïve café — 中文 😀", "<|endoftext|> and <s> are text", "x" * 400, "\u0000 \t\r\n", "1234567890" * 30]


def plain(texts):
    """(doc number -> groups) by walking both token sequences."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)

    def piece(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        e = tokenizer.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        b = [(i, piece(i)) for i in pieces.encode(text)]
        if any(b"".join(t for _, t in side) != (" " + text).encode() for side in (a, b)):
            return []
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        return [
            tuple([i for (i, _), e in zip(side, end) if low < e <= high] for side, end in zip((a, b), ends))
            for low, high in zip([0, *cuts], cuts)
        ]

    return [groups(t) for t in texts]


def digests(ids, texts):
    found = plain(texts)
    held = Counter()
    for groups in found:
        held.update({(x, y) for a, b in groups for x in a for y in b})
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    for i, groups in zip(ids, found):
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        )


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(alignment, "TEXT_AT_ONCE", 3000)


def test_documents_align_as_plainly(spark, small):
    docs = awkward(spark).withColumn("n_a", alignment.F.lit("x"))
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    rows = docs.collect()
    want = ordered(digests([r.doc_id for r in rows], [r.text for r in rows]))
    for shard in (alignment.SHARD_PAIRS, 1):
        got = alignment.align_documents(docs, A, public_tokenizers.PATTERN, B, shard_pairs=shard)
        assert ordered(alignment.digest(got, "doc_id").collect()) == want
        assert set(got.columns) == {*docs.columns, *alignment.ADDED, "group_ids"} - {"text"}


def test_shards_add_up(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BUCKET_PAIRS", 40)
    rows = awkward(spark).filter("text is not null").collect()
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    got = alignment.align_documents(docs, A, public_tokenizers.PATTERN, B, shard_pairs=60)
    assert ordered(alignment.digest(got, "doc_id").collect()) == ordered(digests([r.doc_id for r in rows], [r.text for r in rows]))


def test_empty_table(spark):
    got = alignment.align_documents(awkward(spark).limit(0), A, public_tokenizers.PATTERN, B)
    assert alignment.digest(got, "doc_id").collect() == []


def test_large_groups_are_formed_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    x = alignment.Aligned(
        rng.integers(0, 9, 60), rng.integers(0, 7, 50), np.array([0, 60]), np.array([0, 50]),
        np.array([3, 43, 60]), np.array([2, 40, 50]), np.array([0, 3]),
    )
    want = Counter(
        (int(a), int(b))
        for (i, j), (k, m) in zip([(0, 3), (3, 43), (43, 60)], [(0, 2), (2, 40), (40, 50)])
        for a in x.a[i:j] for b in x.b[k:m]
    )
    for at_once in (1 << 20, 200, 5):
        monkeypatch.setattr(alignment, "LINKS_AT_ONCE", at_once)
        got = Counter()
        for _, a, b, times in x.links():
            for p, q, n in zip(a.tolist(), b.tolist(), times.tolist()):
                got[p, q] += n
        assert got == want


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 31, 20000))
    where = alignment.bucket_of(keys, 5)
    buckets = [(i, keys[where == i], alignment.build_levels(keys[where == i])) for i in range(5)]
    index = alignment.PairIndex(buckets, 5)
    assert sorted(index.places(keys).tolist()) == list(range(len(keys)))
    other = np.setdiff1d(rng.integers(0, 1 << 31, 5000), keys)
    assert (index.places(other) == -1).all()
