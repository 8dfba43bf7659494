import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scoreloom.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def counter():
    return tc.WordCounter.from_spec(tc.read_vocabulary(PATH))


def test_counts_equal_the_library(counter):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    letters = list("abcdeé ßÀÉΣσς'İ.,!?0123 \n\t<|>“”日本́ ſK") + ["<|endoftext|>", "'s", "the", "ing", "₏", "\U0001f600"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, "abcdefghij" * 800, "", " \n", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>"]
    assert [counter.text(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_frame_cases(spark):
    rows = [(1, "hello world", 7), (1, "hello world", 7), (2, None, 8), (3, "", 9), (None, "don't " * 2000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = tc.count_tokens(docs, PATH).orderBy("doc_id").collect()
    by = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in out}
    assert len(out) == 5
    assert by[(1, 11)] == (2, False)
    assert by[(2, 0)] == by[(3, 0)] == (0, False)
    assert by[(None, 12000)] == (4000, True)
    assert tc.count_tokens(docs.limit(0), PATH).count() == 0


def test_query(spark):
    from scoreloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op10_token_counts"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)
