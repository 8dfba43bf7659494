import hashlib
import html as entities
import random
import re

from corpus import as_docs, awkward, prose

from scoreloom.llm import html_text, secrets, toxicity

SF = "/root/testdata/sf0.01"


def base_spans(text):
    """The contract of the base spans, word for word."""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


def test_secret_query_equals_brute_force(spark):
    from scoreloom.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_secret_scan"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r.n_assign + r.n_access + r.n_hex == len(want)
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_secret_kinds_owners_and_awkward_rows(spark):
    bare = "Zx81kQp07LmNv5TtRw2Y"
    texts = [
        "é password: 'hunter22x' secret:token:abcdefgh", "AKIA" + "B2" * 8 + " AKIAAKIA", "0123456789abcdef01234567 abc",
        "api_key=abc", f"use {bare} here", "token = deadbeefdeadbeefdeadbeef12",
    ]
    docs = as_docs(spark, texts + ["token = c0ffee12c0ffee34c0ffee56"] * 4)
    docs = docs.selectExpr("doc_id", "text", "if(doc_id > 5, concat('s', doc_id), 'own') AS source")
    rows = {r.doc_id: r for r in secrets.secret_report(secrets.find_secrets(docs)).collect()}
    for i, t in enumerate(texts):
        spans = [s for s in rows[i].spans.split(",") if s and not s.startswith("bare")]
        assert spans == base_spans(t)
    assert rows[4].spans == f"bare:4:{4 + len(bare)}" and rows[4].n_live == 1
    assert rows[7].n_example == 2 and rows[7].n_live == 0
    odd = awkward(spark)
    assert secrets.secret_report(secrets.find_secrets(odd)).count() == odd.count()
    assert secrets.find_secrets(odd.limit(0)).count() == 0


def test_values_of_many_repositories_of_one_owner_are_examples(spark):
    value = "token = c0ffee12c0ffee34c0ffee56"
    docs = as_docs(spark, [f"{value} {i}" for i in range(20)] + ["token = 9f8e7d6c5b4a39281706f5e4"] * 19)
    rows = {r.doc_id: r for r in secrets.secret_report(secrets.find_secrets(docs)).collect()}
    assert all(rows[i].n_example == 2 and rows[i].n_live == 0 for i in range(20))
    assert all(rows[i].n_example == 0 and rows[i].n_live > 0 for i in range(20, 39))
    assert rows[0].spans == "assign:0:32,hex:8:32"


def test_articles_stay_whatever_their_class():
    article = " ".join(f"word{i}" for i in range(120))
    wrappers = {
        '<article class="post hentry comments-open">': "</article>", '<main class="site-main has-sidebar">': "</main>",
        '<div class="content response-article">': "</div>", '<article class="article with-header">': "</article>",
        '<div class="layout-sidebar-right"><div>': "</div></div>", '<div class="elementor-widget-text">': "</div>",
        '<div class="sidebar-wrapper"><article>': "</article></div>",
    }
    for begin, end in wrappers.items():
        page = (
            f'<html><body><div class="site-header">menu</div>{begin}<p>{article}</p><div class="comments-area">first!</div>{end}'
            f"<footer>{'foot ' * 15}</footer><div>{'small ' * 15}</div></body></html>"
        )
        assert html_text.main_text(page, {}).startswith(article), begin
        assert "first!" not in html_text.main_text(page, {})


def test_html_query_equals_articles(spark):
    from scoreloom.llm.queries import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op9_html_extraction"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1]
        want = " ".join(entities.unescape(re.sub(r"</?(p|h1|br)>", " ", re.sub(r"</?b>", "", inner))).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_html_furniture_and_broken_markup(spark):
    page = (
        "<html><head><title>T</title></head><body><header>Top of site</header><div class='site-menu'><a>Home</a></div>"
        "<div id=main-text><h1>A &lt;title&gt;</h1><p>First&nbsp;<b>bo</b>ld one two three four five six."
        "<div class='ad-box'>Buy now buy now</div><form>Your name</form><p>Second\n\n part <!-- gone --> of the text, seven eight."
        "<script>if (a < b) { x('</p>') }</script><aside>Side words here</aside></div><div class=comments><p>nice post indeed</p></div>"
        "<footer>Imprint</footer>"
    )
    cost = html_text.costs({"p": (50, 1), "div": (3, 4), "h1": (9, 1), "header": (0, 9), "footer": (0, 9), "html": (0, 9)})
    want = "A <title> First bold one two three four five six. Second part of the text, seven eight."
    assert html_text.main_text(page, cost) == want
    for odd in ("", None, "plain words only", "<p", "<!-- open", "a < b > c", "<p>" * 3000 + "end", "<a href='x>y</a>"):
        html_text.main_text(odd, cost)
    assert html_text.main_text("plain  words\nonly", {}) == "plain words only"
    rows = spark.createDataFrame([(1, None, "t"), (1, "", "t"), (None, page, "t")], "page_id long, html string, text string")
    out = html_text.extract_main_text(rows)
    assert [(r.text == "", r.n_chars == 0) for r in out.orderBy("n_chars").collect()] == [(True, True), (True, True), (False, False)]
    assert html_text.extract_main_text(rows.limit(0)).count() == 0


def brute_match(text, lexicon):
    words = re.findall(r"[^\W\d_]+", toxicity.fold(text))
    skip = set()
    for phrase in lexicon.exceptions:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                skip |= set(range(i, i + len(parts)))
    total = 0.0
    for i, w in enumerate(words):
        options = [(len(s), x) for s, x in lexicon.stems.items() if w.startswith(s)] + [(len(w), lexicon.words.get(w))] * (w in lexicon.words)
        if options and i not in skip:
            total += max(options, key=lambda o: o[0])[1]
    return total, len(words)


def test_matching_equals_brute_force():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "trash": 2.0, "fool": 1.0}, {"idio": 0.5, "foo": 0.25})
    machine = lexicon.automaton()
    rng = random.Random(4)
    parts = ["idiot", "IDIOT!!", "1d10t", "іdiot", "idiotic", "trash", "trash can", "fool", "f00l", "foot", "t.rash", "9", "a$$", "é", "can"]
    for _ in range(500):
        text = " ".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert toxicity.match(text, machine) == brute_match(text, lexicon)
    assert toxicity.match(None, machine) == (0.0, 0)


def test_held_out_accuracy_and_learning_bounds(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = prose(rng, 60).split()
        if toxic:
            words[rng.randrange(60)] = rng.choice(["zurko", "zurkolat", "zurkomen", "zurkosi", "brimdal"])
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    docs = as_docs(spark, texts)
    labelled = spark.createDataFrame(labels + [(0, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labelled)
    rows = toxicity.score_toxicity(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    small = toxicity.labelled_sample(docs, labelled, "doc_id", "text", "toxic", 100)
    assert 40 < small.count() < 180


def test_toxicity_awkward_rows(spark):
    docs = awkward(spark)
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == docs.count() and all(r.predicted == 0 for r in rows)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    [odd] = toxicity.score_toxicity(as_docs(spark, ["you idiot, worthless trash"]), model).collect()
    assert odd.predicted == 1
