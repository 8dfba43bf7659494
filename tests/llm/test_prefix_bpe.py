"""Prefix tables against the library, edits against fresh encodings."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from corpus import awkward, prose

from scoreloom.llm.prefix_bpe import EditableText, PrefixTable, TextEncoder, Vocabulary, decode_documents, encode_documents, read_ranks, round_trip

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BITS = ["a", "b", "e", "th", " ", "  ", "\n", "'s", "'", "1", "22", "é", "ß", "中", "!", "?!", "　", "😀", "x" * 30, "<|endoftext|>"]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.from_lines(read_ranks(RANKS))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_texts_encode_as_the_library_does(vocabulary, library):
    rng = random.Random(1)
    encoder = TextEncoder(vocabulary, public_tokenizers.PATTERN)
    for _ in range(600):
        text = "".join(rng.choices(BITS, k=rng.randrange(20)))
        ids = library.encode_ordinary(text)
        assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_edited_texts_equal_fresh_ones(vocabulary, library):
    rng = random.Random(2)
    encoder = TextEncoder(vocabulary, public_tokenizers.PATTERN)
    for _ in range(300):
        text = EditableText(encoder, "".join(rng.choices(BITS, k=rng.randrange(12))))
        for _ in range(4):
            start = rng.randrange(len(text.text) + 1)
            end = rng.randrange(start, len(text.text) + 1)
            new = "".join(rng.choices(BITS, k=rng.randrange(4)))
            want = text.text[:start] + new + text.text[end:]
            text.replace(start, end, new)
            assert text.text == want
            assert text.token_ids() == library.encode_ordinary(want)
        text.append("there's")
        assert text.token_ids() == library.encode_ordinary(text.text)


def test_edits_compute_only_what_is_near(vocabulary):
    rng = random.Random(3)
    data = bytes(rng.choices(b"abct he", k=5000))
    table = PrefixTable(vocabulary, data)
    computed = table.replace(2000, 2003, b"zz")
    assert computed <= 4 * vocabulary.longest
    assert table.last == PrefixTable(vocabulary, data[:2000] + b"zz" + data[2003:]).last
    text = EditableText(TextEncoder(vocabulary, public_tokenizers.PATTERN), prose(rng, 2000))
    assert text.replace(5000, 5001, "q") < 100


def test_documents_round_trip(spark, library):
    docs = awkward(spark)
    encoded = decode_documents(encode_documents(docs.withColumn("token_ids", docs.tag), RANKS, public_tokenizers.PATTERN), RANKS)
    rows = encoded.collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert bytes(r.token_ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert r.n_tokens == len(ids) and bytes(r.decoded) == (r.text or "").encode()
    assert {tuple(r) for r in round_trip(docs, RANKS, public_tokenizers.PATTERN).select("token_ids", "n_tokens", "decoded").collect()} == {
        tuple(r) for r in encoded.select("token_ids", "n_tokens", "decoded").collect()
    }
    assert encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN).columns == [c for c in docs.columns if c != "n_tokens"][:3] + [
        "n_tokens", *[c for c in docs.columns[4:]], "token_ids"
    ]


def test_query_equals_the_library(spark, tmp_path, library):
    from scoreloom.llm.queries import QUERIES

    awkward(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_prefix_bpe"](spark, str(tmp_path)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in awkward(spark).collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((r.text or "").encode())))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
