import hashlib
import random
from collections import defaultdict
from itertools import combinations

import pytest
from corpus import as_docs, awkward, prose
from pyspark.sql import functions as F

from scoreloom.llm import exact_dedup, line_templates, near_dedup, passages
from scoreloom.llm.components import components


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_components(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 60)] + [(7, 7), (6, 5), (300, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = brute_components(links, {x for p in links for x in p})
    assert got == {i: c for i, c in want.items() if i != c}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_groups_hot_and_small(spark):
    texts = ["hot"] * 40 + ["warm"] * 3 + [None, "", "Hot"] + [f"t{i}" for i in range(20)]
    docs = as_docs(spark, texts)
    rows = {r.doc_id: r for r in exact_dedup.mark_duplicates(docs, least=16).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for i, t in enumerate(texts):
        r, group = rows[i], groups[t or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), i == max(group))
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r.doc_id for r in exact_dedup.drop_duplicates(docs).collect()) == sorted(max(g) for g in groups.values())


def test_exact_awkward_rows_keep_one_of_each(spark):
    docs = awkward(spark)
    rows = exact_dedup.mark_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r.text_sha256 for r in rows})
    assert exact_dedup.mark_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_components_equal_brute_force(spark, width):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(30, 120)) for _ in range(60)]
    for base in range(8):
        for _ in range(6):
            words = texts[base].split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice("pqrs")
            texts.append(" ".join(words))
    # a crowd: many variants of one text, so regions are larger than what is compared pair by pair
    crowd = prose(rng, 150).split()
    for i in range(150):
        words = list(crowd)
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = f"v{i}"
        texts.append(" ".join(words))
    texts += ["", None, "one", "One", "one two", " one\ttwo ", texts[0].upper(), texts[3]]
    sets = [shingle_set(t, width) for t in texts]
    links = [
        (a, b) for a, b in combinations(range(len(texts)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = brute_components(links, range(len(texts)))
    rows = {r.doc_id: r for r in near_dedup.near_duplicates(as_docs(spark, texts), width=width).collect()}
    assert {i: r.n_shingles for i, r in rows.items()} == {i: len(s) for i, s in enumerate(sets)}
    assert {i: r.component_id for i, r in rows.items()} == want
    assert {i for i, r in rows.items() if r.kept} == {i for i, c in want.items() if i == c}


def test_stars_of_crowds_list_a_class_only_where_it_is_in_a_crowd(spark):
    """Every member of a crowd is paired with the middle of it, at each depth; classes are not listed by depth beforehand."""
    rng = random.Random(5)
    base = {tree: bytes(rng.randrange(256) for _ in range(16)) for tree in range(3)}
    rows = []
    for i in range(260):
        for tree, path in base.items():
            # some leave the path of the crowd early, some late
            cut = 16 if i % 3 == 0 else 8 + 2 * rng.randrange(4) if tree else 16 if i % 5 else 10
            rows.append((i, tree, path[:cut] + bytes(rng.randrange(256) for _ in range(16 - cut))))
    crowd = spark.createDataFrame(rows, "id long, tree int, path binary")
    stars = near_dedup._stars(crowd)
    want = []
    members, on_path = defaultdict(list), defaultdict(int)
    for i, tree, path in rows:
        for d in near_dedup.LEVELS:
            members[d, tree, path[: 2 * d]].append((i, path))
    members = {k: v for k, v in members.items() if len(v) > near_dedup.CROWD}
    middles = {}
    for k, v in members.items():
        count = defaultdict(int)
        for _, path in v:
            count[path] += 1
        middles[k] = max(count, key=lambda path: (count[path], path))
        if k[0] == near_dedup.LEVELS[0]:
            for i, path in v:
                on_path[i] += path == middles[k]
    for k, v in members.items():
        pivot = max((i for i, path in v if path == middles[k]), key=lambda i: (on_path[i], -i))
        want += [(pivot, i) for i, _ in v]
    assert len({k[0] for k in members}) == 3
    assert sorted(map(tuple, stars.collect())) == sorted(want)
    assert "Generate" not in stars._jdf.queryExecution().toString()


def test_near_families_in_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWD", 4)
    rng = random.Random(31)
    common = prose(rng, 84).split()
    texts = []
    for i in range(150):
        own = [f"{rng.choice('pqrs')}{rng.randrange(10**6)}" for _ in range(12)]
        base = [*common[:42], *own, *common[42:]]
        twin = list(base)
        for at in (10, 80):
            twin[at] = f"z{i}"
        texts += [" ".join(base), " ".join(twin)]
    sets = [shingle_set(t, 5) for t in texts]
    links = [
        (a, b) for a, b in combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    assert len(links) == 150
    rows = near_dedup.near_duplicates(as_docs(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_components(links, range(len(texts)))


def test_near_awkward_rows(spark):
    docs = awkward(spark)
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.filter("doc_id in (5, 6)").collect()] == [5]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_passages_found_and_clean_documents_left(spark):
    rng = random.Random(2)
    passage, edited = prose(rng, 63), None
    words = passage.split()
    edited = " ".join(words[:30] + words[31:])
    clean = [prose(rng, 90) for _ in range(20)]
    texts = clean + [
        f"{prose(rng, 20)}.\n{passage}\n{prose(rng, 30)}.",
        f"{prose(rng, 18)}. {passage}",
        f"{prose(rng, 40)}.\n{edited}",
        f"{passage} {passage}",
        None, "", "short. text.",
    ]
    docs = as_docs(spark, texts)
    found = passages.repeated_passages(docs)
    rows = found.collect()
    assert {r.doc_id for r in rows} == {20, 21, 22, 23}
    assert {r.keep_id for r in rows} == {20}
    assert all(r.kept == (r.doc_id == 20) for r in rows)
    cleaned = {r.doc_id: r.clean_text for r in passages.remove_passages(docs, found).collect()}
    assert all(cleaned[i] == t for i, t in enumerate(texts[:21]))
    assert words[5] + " " + words[6] + " " + words[7] not in cleaned[21]
    assert cleaned[24] is None


def test_passages_in_a_crowd_that_shares_a_template(spark):
    rng = random.Random(21)
    head, tail = prose(rng, 36).replace(".", ""), prose(rng, 36).replace(".", "")
    texts = []
    for i in range(300):
        own = [f"{rng.choice('pqrs')}{rng.randrange(10**6)}" for _ in range(32)]
        texts += [f"{head} {' '.join(own)} {tail}", f"{head} {' '.join([*own[:9], f'z{i}', *own[10:]])} {tail}"]
    sets = [shingle_set(t, 5) for t in texts]
    links = [
        (a, b) for a, b in combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    assert len(links) == 300
    rows = passages.repeated_passages(as_docs(spark, texts)).filter("n_words = 104").collect()
    groups = defaultdict(set)
    for r in rows:
        groups[r.cluster_id].add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == [[2 * i, 2 * i + 1] for i in range(300)]


def test_passages_repeat_in_one_document_only(spark):
    rng = random.Random(3)
    text = prose(rng, 63)
    assert passages.repeated_passages(as_docs(spark, [f"{text}\n{text}", prose(rng, 70)])).count() == 0
    docs = awkward(spark)
    rows = passages.repeated_passages(docs).collect()
    assert {r.doc_id for r in rows} == {5, 6}
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def test_several_templates_share_a_leaf(spark):
    """Two templates of one leaf, and an identical line among prose of its leaf."""
    rng, texts = random.Random(3), []
    for i in range(100):
        at = f"2024-01-{i % 28:02d} 10:{i % 60:02d}:00 INFO"
        texts += [f"{at} Connection from 10.0.{i}.1 closed\n{prose(rng, 9)}", f"{at} Worker w{i} has stopped\n{prose(rng, 9)}"]
    rows = {r.doc_id: r for r in line_templates.drop_template_lines(as_docs(spark, texts)).collect()}
    assert all(r.n_dropped == 1 and r.clean_text == texts[i].split("\n")[1] for i, r in rows.items())
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    same = "one two three all rights are reserved here"
    texts = [f"{same}\n{prose(rng, 9)}" for i in range(200)] + [f"one two three {' '.join(rng.sample(words, 5))}" for i in range(200)]
    rows = {r.doc_id: r for r in line_templates.drop_template_lines(as_docs(spark, texts)).collect()}
    assert all(same not in rows[i].clean_text for i in range(200)) and all(rows[i].n_dropped == 0 for i in range(200, 400))
    long = as_docs(spark, ["\n".join(["same line of a text", "x"] * 30000)] + ["same line of a text"] * 10)
    first = line_templates.drop_template_lines(long).filter("doc_id = 0").first()
    assert (first.n_lines, first.n_dropped, first.text == long.first().text) == (60000, 30000, True)


def test_template_lines(spark):
    rng = random.Random(9)
    texts = [f"{prose(rng, 12)}\nat 10:{i:02d} the server answered in {i} ms to user u{i}\n\n{prose(rng, 11)}" for i in range(14)]
    texts += [None, "", "\n", "at noon the server answered in no ms to user none"]
    rows = {r.doc_id: r for r in line_templates.drop_template_lines(as_docs(spark, texts)).collect()}
    for i in range(14):
        lines = texts[i].split("\n")
        assert (rows[i].n_lines, rows[i].n_dropped) == (4, 1)
        assert rows[i].clean_text == "\n".join([lines[0], "", lines[3]])
    assert [(rows[i].n_lines, rows[i].n_dropped, rows[i].clean_text) for i in (14, 15, 16)] == [(0, 0, ""), (1, 0, ""), (2, 0, "\n")]
    assert rows[17].n_dropped == 0
    docs = awkward(spark)
    assert line_templates.drop_template_lines(docs).count() == docs.count()
    assert line_templates.drop_template_lines(docs.limit(0)).count() == 0


def test_only_texts_that_may_hold_a_span_are_moved_to_it(spark, monkeypatch):
    docs = spark.range(20_000).select(F.xxhash64("id").alias("doc"), "id")
    spans = docs.filter("id % 10 = 0").select(F.col("doc").alias("__doc"))
    passed = {r["id"] for r in docs.filter(passages._may_hold(F.col("doc"), spans, 2_000)).select("id").collect()}
    assert passed >= set(range(0, 20_000, 10)) and len(passed) < 6_000
    rng = random.Random(3)
    shared = [prose(rng, 60) for _ in range(6)]
    texts = [prose(rng, 40) + "\n" + shared[i % 6].replace(" ", " x ", i % 3) + "\n" + prose(rng, 40) for i in range(40)]
    found = [passages.repeated_passages(as_docs(spark, texts)).drop("cluster_id").collect()]
    monkeypatch.setattr(passages, "MOST_IDS", 0)
    used = []
    may_hold = passages._may_hold
    monkeypatch.setattr(passages, "_may_hold", lambda *a: used.append(1) or may_hold(*a))
    found.append(passages.repeated_passages(as_docs(spark, texts)).drop("cluster_id").collect())
    assert used and found[0] and sorted(map(tuple, found[0])) == sorted(map(tuple, found[1]))
