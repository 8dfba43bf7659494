import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from corpus import as_docs, awkward, prose

import corpus_pipeline
from scoreloom.llm import decontaminate, mixing


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in low + " ":
        if c >= "\x80" or "0" <= c <= "9" or "a" <= c <= "z":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute_hits(texts, items, n):
    result = []
    for t in texts:
        words, hit, found = words_of(t), set(), set()
        for name, item in items:
            own = words_of(item)
            k = min(n, len(own))
            windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own and name is not None else set()
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found.add(str(name))
        result.append((len(words), len(hit), sorted(found)))
    return result


@pytest.mark.parametrize("most_windows", [10**6, 0])
def test_hits_equal_brute_force(spark, most_windows):
    rng = random.Random(6)
    items = [(1, prose(rng, 30)), (2, prose(rng, 12)), (10, "Rare Ünder x9"), (3, "solo"), (4, ""), (5, None), (2, prose(rng, 15))]
    items += [(11, items[0][1]), (None, prose(rng, 20))]
    texts = [prose(rng, 50) for _ in range(6)]
    texts += [prose(rng, 20) + " " + items[0][1].upper(), "rare, Ünder; X9!", "rare ünder X9 solo", "a solo b", None, "", items[1][1] * 3]
    texts += [" ".join(items[0][1].split()[:12]), texts[6]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_hits(as_docs(spark, texts), bench, most_windows=most_windows).collect()
    got = {r.doc_id: (r.n_words, len(r.hit), sorted(r["items"])) for r in found}
    assert [got[i] for i in range(len(texts))] == brute_hits(texts, items, 10)
    kept = decontaminate.drop_contaminated(as_docs(spark, texts), bench, most_windows=most_windows)
    assert {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if not g[1]}


def test_hits_of_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    rows = decontaminate.contamination(decontaminate.find_hits(docs, bench)).collect()
    assert len(rows) == docs.count()
    assert [(r.n_words, r.n_hit) for r in rows if r.contaminated] == [(2, 2)]
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    for few, many in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert decontaminate.find_hits(few, many).filter("size(hit) > 0").count() == 0
    assert decontaminate.find_hits(docs, bench.limit(0)).count() == docs.count()


def sources(spark):
    rng = random.Random(1)
    rows = []
    for source, n in (("big", 300), ("mid", 60), ("small", 12), (None, 5)):
        rows += [(len(rows) + i, " ".join(["w"] * rng.randint(1, 30)), source) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def readings(frame):
    out = defaultdict(lambda: [0, 0, 0.0])
    for r in frame.collect():
        out[r.source][0] += r.n_tokens
        out[r.source][1] = max(out[r.source][1], r.epoch)
        out[r.source][2] = r.source_weight
    return out


def test_repetition_limit_is_met_and_everything_read(spark):
    docs = sources(spark)
    mixed = mixing.mix(docs, mixing.Target(repetitions=3.0))
    by, own = readings(mixed), defaultdict(int)
    for r in docs.collect():
        own[r.source] += len(r.text.split())
    passes = {s: by[s][0] / own[s] for s in own}
    assert min(passes.values()) == passes["big"] == 1
    assert 2.7 < max(passes.values()) <= 3.0 and max(b[1] for b in by.values()) == 3
    total = sum(b[0] for b in by.values())
    for s, (tokens, _, weight) in by.items():
        assert tokens <= weight * total * 1.1
        assert abs(tokens / total - weight) < 0.02
    assert mixed.select("doc_id").distinct().count() == docs.count()
    # an epoch reads each document once, in an order of its own
    assert mixed.groupBy("doc_id", "epoch").count().filter("count > 1").count() == 0
    first, second = ([r.doc_id for r in mixed.filter(f"source = 'small' and epoch = {e}").orderBy("read_order").collect()] for e in (1, 2))
    assert sorted(first) == sorted(second) and first != second


def test_entropy_budget_and_salted_plans(spark, monkeypatch):
    docs = sources(spark)
    plain = mixing.mix(docs, mixing.Target(entropy=0.8, budget=2000))
    by = readings(plain)
    weights = [b[2] for b in by.values()]
    entropy = -sum(w * math.log(w) for w in weights) / math.log(4)
    assert abs(entropy - 0.8) < 1e-3
    assert sum(b[0] for b in by.values()) <= 2000 + 4
    assert sum(b[0] for b in by.values()) > 2000 - 4 * 30
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    salted = mixing.mix(docs, mixing.Target(entropy=0.8, budget=2000))
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_mixing_awkward_rows(spark):
    docs = awkward(spark)
    mixed = mixing.mix(docs, mixing.Target(repetitions=2.0))
    assert mixed.columns[: len(docs.columns)] != [] and set(docs.columns) <= set(mixed.columns)
    assert mixed.filter("epoch = 1").count() == docs.count()
    assert mixing.mix(docs.limit(0), mixing.Target(repetitions=2.0)).count() == 0


def test_pipeline_stages_against_planted_cases(spark, tmp_path):
    rng = random.Random(12)
    bench = prose(rng, 30)
    clean = [prose(rng, 70) for _ in range(60)]
    toxic = [prose(rng, 40) + " you worthless idiot, pathetic scum " + prose(rng, 9) for _ in range(20)]
    near = [" ".join(clean[i].split() + ["extra"]) for i in range(5)]
    texts = clean + toxic + [clean[9]] * 3 + near + [prose(rng, 20) + " " + bench]
    docs = as_docs(spark, texts).selectExpr("doc_id", "text", "'en' AS lang", "concat('s', doc_id % 3) AS source", "length(text) AS n_chars")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(60 <= i < 80)) for i in range(80)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf)
        kept.append({r.doc_id for r in frame.collect()})
        if len(kept) < len(corpus_pipeline.STAGES):
            assert frame.columns == docs.columns
    every = set(range(len(texts)))
    assert kept[0] == every - set(range(60, 80))
    assert kept[1] == kept[0] - {9, 80, 81}
    assert kept[2] == kept[1] - set(range(83, 88))
    assert kept[3] == kept[2] - {88}
    assert kept[4] == kept[3]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == kept[4]
    assert max(r.epoch for r in rows) <= 2


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns: what differs stays, once."""
    sf = str(tmp_path)
    docs = awkward(spark).withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.length("text")})
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 0), (8, 0), (None, None)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "one two"), (2, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    frame, texts = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, sf)
        assert frame.columns == docs.columns
        texts.append([r.text or "" for r in frame.collect()])
    every = {r.text or "" for r in docs.collect()}
    assert len(texts[0]) == docs.count()  # nothing toxic was there to learn from
    assert sorted(texts[1]) == sorted(every)
    assert set(texts[2]) == set(texts[1]) == set(texts[3]) and len(texts[3]) == len(set(texts[3]))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.text or "" for r in rows} == set(texts[3])


def test_pipeline_on_empty_documents(spark, tmp_path):
    sf = str(tmp_path)
    empty = as_docs(spark, ["x"]).limit(0)
    empty.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
