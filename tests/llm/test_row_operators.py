"""Extraction, language, toxicity, quality: fixtures, edge cases, held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import html_text, langid, packing, quality, toxicity

PAGE = """<html><head><title>T</title><style>p{margin:0}</style></head><body><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies to give you a good experience here.</div><nav><a href=/x>One</a></nav>
<div class="content"><h2>Title &amp; more</h2><p>A long  paragraph with a good deal of text, and <em>emphasis</em>, so it counts.
<ul><li>first<li>second</ul><p>Short.</p><p>Another long paragraph that goes on for some time to be sure of its ratio.</p>
<form><label>Email</label><input></form><script>var t="</p>";</script></div><aside>Popular posts</aside>
<div id="comments"><p>Reader says: a very long comment about this article, thanks for it.</p></div><footer>(c)</footer></body></html>"""


def test_extraction():
    assert html_text.main_text(PAGE) == "\n".join(
        ["Title & more", "A long paragraph with a good deal of text, and emphasis, so it counts.", "first", "second", "Short.", "Another long paragraph that goes on for some time to be sure of its ratio."]
    )
    assert html_text.main_text("<nav>open menu<article><p>Text of the article.</article>") == "Text of the article."
    assert html_text.main_text('<div id="header"><p>Site name</p></div><div class="post-header"><h2>Title</h2></div><p>Words of the text itself.</p>') == "Title\nWords of the text itself."
    for empty in (None, "", "<nav>menu</nav>", "<script>x</script>"):
        assert html_text.main_text(empty) == ""
    assert html_text.main_text("plain &lt;text&gt;") == "plain <text>"
    assert html_text.main_text("<p>" * 3000 + "deep") == "deep"


def test_extraction_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df, ["page_id", "url"]).collect()
    assert [r["n_chars"] for r in got] == [len(got[0]["text"])] * 2 + [0] and got[2]["text"] == ""
    assert html_text.extract(df.limit(0), ["page_id", "url"]).count() == 0


LANGS = {"en": "the cat sat on the mat and the dog ran with it", "de": "der hund und die katze sind nicht auf dem tisch", "fr": "le chat est sur la table avec les deux chiens"}


def lang_docs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.permutation(LANGS[k].split())), k) for i, k in enumerate(list(LANGS) * 20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(spark):
    docs, model = lang_docs(spark), packing.public_path("piece_bpe_32k.model")
    languages, p = langid.train(docs.where("doc_id % 4 <> 2"), langid.Pieces(model))
    assert languages == ["de", "en", "fr"] and np.allclose(p[2:].sum(0), 1, atol=1e-6)
    odd = spark.createDataFrame([(100, None, "x"), (101, "12 !!", "x"), (102, "", None), (103, "the " * 20000, "en"), (None, "der hund", None), (None, "der hund", None)], docs.schema)
    got = langid.identify(docs.unionByName(odd), languages, p, model, ["doc_id", "lang"]).collect()
    right = [r["lang_pred"] == r["lang"] for r in got if r["doc_id"] is not None and r["doc_id"] < 100 and r["doc_id"] % 4 == 2]
    assert np.mean(right) == 1.0
    tail = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert tail[100] == tail[101] == tail[102] == ("und", 0.0) and tail[103][0] == "en" and tail[None][0] == "de"
    none = langid.identify(docs, [], np.zeros((2, 0)), model, ["doc_id"])
    assert none.where("lang_pred <> 'und'").count() == 0


def test_forward_sums_all_segmentations():
    """Against the sum over every way to cut a word."""
    pieces = langid.Pieces(packing.public_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    p = langid.normal(rng.random((pieces.size, 2)))

    def brute(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, min(len(word), langid.LONGEST_PIECE) + 1):
            number = pieces.number.get(word[:n], 1 if n == 1 else 0)
            if number:
                total = total + p[number] * brute(word[n:])
        return total

    for word in ("▁thing", "▁ñandú", "▁a", "▁qqq"):
        assert np.allclose(langid.forward(pieces.lattice([word]), p)[0, -1], brute(word))


def test_transducers():
    g = toxicity.Grammar({"blorg": 3.0, "zap*": 2.0})
    plain, aimed = g.features("a blorg here.")[0], g.features("you blorg.")[0]
    assert aimed == pytest.approx(plain * toxicity.AIMED)
    assert g.features("not a blorg.")[0] == pytest.approx(plain * toxicity.NEGATED)
    assert g.features("it said: a blorg")[0] == pytest.approx(plain)  # the clause of the report ended
    assert g.features("it said a blorg.")[0] == pytest.approx(plain * toxicity.REPORTED)
    assert g.features("zapper zap")[4] == 1.0  # a stem needs a longer word
    assert g.features("")[:6] == [0.0] * 6 and g.features("nothing here")[4] == 0.0


def toxic_docs(spark, n=400):
    rng = np.random.default_rng(5)
    words = np.array([f"w{a}{b}" for a in "abcdefgh" for b in "klmnopqr"])
    words = np.array([w.replace("w", "st") for w in words])
    rows, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, 40))
        bad = i % 6 == 0
        if bad:
            for k in rng.choice(40, 3, replace=False):
                text[k] = str(rng.choice(["grobnik", "vexalo", "vexari"]))
        rows.append((i, " ".join(text), "en"))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_docs(spark)
    lexicon, model = toxicity.train(docs.where("doc_id % 5 <> 0"), labels)
    assert "grobnik" in lexicon and any(t.startswith("vexa") for t in lexicon)
    odd = spark.createDataFrame([(1000, None, None), (1001, "", None), (1002, "you grobnik " * 5000, None), (None, "x", "y")], docs.schema)
    got = {r["doc_id"]: r for r in toxicity.score(docs.unionByName(odd), lexicon, model, ["doc_id"]).collect()}
    held = [i for i in range(0, 400, 5)]
    assert np.mean([(got[i]["predicted"] == 1) == (i % 6 == 0) for i in held]) > 0.97
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0 and got[1002]["predicted"] == 1 and 0 <= got[None]["score"] <= 1
    assert toxicity.train(docs, labels.limit(0))[1] is None
    assert toxicity.score(docs.limit(2), {}, None, ["doc_id"]).where("score <> 0").count() == 0


def test_quality(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        good = i % 5 != 0
        words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(30)]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en", f"src{i % 3}", len(text), "extra"))
        if i % 2:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(600) if i % 5}
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(1, None, None, None, None, None)], docs.schema)
    assert 0 <= quality.score(odd, model, ["doc_id"]).first()["score"] <= 1
    assert quality.score(odd.select("doc_id", "text"), model, ["doc_id"]).count() == 1
    assert quality.train(docs, labels.limit(0)).score(np.zeros((2, 18)), np.zeros((2, 66))).tolist() == [1.0, 1.0]


def test_queries_read_no_labels_of_held_out_rows(spark):
    docs, labels = toxic_docs(spark, 60)
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs.where("doc_id % 5 <> 0"), x.where("doc_id % 5 <> 0")) for x in (labels, flipped))
    assert a[0] == b[0]


LONG = "A sentence of an article that goes on, with many words in it, so that it counts as text. " * 3


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<main><article><p>{LONG}</p><p>{LONG}</p></article><section id=comments><article class=comment><p>{LONG} reader</p></article></section></main>", [LONG, LONG]),
        (f"<aside><article class=teaser><p>{LONG} teaser</p></article></aside><article><p>{LONG}</p></article>", [LONG]),
        (f"<nav><ul><li><a href=/>Home</a></li></ul><p>{LONG}</p><p>{LONG}</p>", [LONG, LONG]),
        (f"<article><p>one line<br>and {LONG}</p></article>", [f"one line and {LONG}"]),
        (f"<div id=main><h1>Title</h1><div class=lead><p>{LONG}</p></div><div class=body>{f'<p>{LONG}</p>' * 6}</div></div><div>short</div>", ["Title", *[LONG] * 7]),
        (f"<article><p>{LONG}</p></article><article><p>{LONG}</p></article>", [LONG, LONG]),
        (f"<div class='content has-sidebar'><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>", [LONG]),
        (f"<article><p>{LONG}</p><figure><img src=x><figcaption>A caption</figcaption></figure></article>", [LONG, "A caption"]),
        (f"<article><header><h1>Title</h1><p>By somebody</p></header><p>{LONG}</p><footer>foot</footer></article>", ["Title", LONG]),
    ],
)
def test_regions_of_pages(html, want):
    assert html_text.main_text(f"<html><body>{html}</body></html>") == "\n".join(w.strip() for w in want)


def test_deep_pages_take_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        assert html_text.main_text("<body>" + "<div>x" * n + LONG + "</i>" * n).endswith(LONG.strip())
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


def test_whole_words_and_letters_only(spark):
    """Long words are scored whole, in scaled numbers; what isn't a letter is no word."""
    pieces = langid.Pieces(packing.public_path("piece_bpe_32k.model"))
    p = langid.normal(np.random.default_rng(2).random((pieces.size, 2)))

    def brute(word):
        total = [np.ones(2)]
        for end in range(1, len(word) + 1):
            parts = [total[end - n] * p[pieces.number[word[end - n : end]]] for n in range(1, min(end, pieces.longest) + 1) if word[end - n : end] in pieces.number]
            total.append(sum(parts, total[end - 1] * p[1] if word[end - 1] not in pieces.number else np.zeros(2)))
        return np.log(total[-1])

    words = ["▁" + w for w in ("internationalisation", "a", "qü", "abcdefgh" * 5)]
    assert np.allclose(pieces.lattice(words).sums(p), [brute(w) for w in words])
    long = pieces.lattice(["▁" + "abcde" * 4000, "▁abcde"]).sums(p)
    assert np.isfinite(long).all() and (long[0] < 1000 * long[1]).all()
    assert langid.words_of("½ ² ① x½y Straße 3a_b") == ["x", "y", "straße", "a", "b"]
    docs = spark.createDataFrame([(i, w * 5, lang) for i in range(40) for w, lang in (("the cat and ", "en"), ("und der hund ", "de"))], "doc_id long, text string, lang string")
    languages, q = langid.train(docs, pieces)
    odd = spark.createDataFrame([(1, "½ ² ①"), (2, "und " * 9)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, languages, q, packing.public_path("piece_bpe_32k.model"), ["doc_id"]).collect()}
    assert got == {1: "und", 2: "de"}
    assert langid.identify(odd.limit(0), languages, q, packing.public_path("piece_bpe_32k.model"), ["doc_id"]).count() == 0
    assert langid.train(docs.limit(0), pieces)[0] == []
