"""Encoding, packing, classifiers and pages: against the libraries, brute force and held-out labels."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF
from pyspark.sql import functions as F

from tasador.llm import langid, packing, pieces, quality, sitestyle
from tasador.llm.splits import held_out

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor sit amet " * 4000
# extra columns named like columns of our own
ODD = [
    (1, "One two three.", "en", "x", 1.0),
    (2, "", "en", None, None),
    (3, None, None, "y", 2.0),
    (None, "no id here", "en", "z", 3.0),
    (5, LONG, "en", "q", 4.0),
    (6, "same row", "de", "w", 5.0),
    (6, "same row", "de", "w", 5.0),
    (7, "123 !!! ...", "de", "w", 5.0),
]
COLUMNS = "doc_id long, text string, lang string, score string, n_tokens double"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


def test_pieces_equal_the_library(spark):
    own, library = pieces.PieceCoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "1", "▁", "①", "日本", "ing", "!!", "%%%", "🙂", "\x00", "ﬁ", "aaaa", "...."]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(2000)] + [LONG[:9000], "a" * 3000, " " * 999]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids), repr(text)


def test_piece_digests(odd):
    rows = pieces.digest_documents(odd, PIECES).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ODD)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["n_tokens"] == by_id[3]["n_tokens"] == 1 and by_id[2][2:] == by_id[3][2:]
    assert by_id[5]["n_tokens"] == len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(LONG)) + 1
    assert pieces.digest_documents(odd.limit(0), PIECES).count() == 0
    back = odd.select(F.col("text"), pieces.text_column(PIECES, pieces.ids_column(PIECES, F.col("text"))).alias("again"))
    assert all(r["again"] == (r["text"] or "") for r in back.collect())


def test_words_equal_the_library():
    own = packing.WordTokenizer(WORDS)
    rng = random.Random(4)
    parts = ["a", "B", "É", "ß", "'s", "'", "’", "1", "²", "½", " ", "\n", "<|endoftext|>", "ſ", "İ", "Σ", "!", "_", "ª", "\xad", "can't", "THE"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(20))) for _ in range(3000)]
    assert own.encode(texts) == [own.whole(t) for t in texts]
    assert own.encode([None, ""]) == [b"", b""]


def test_packing_places_every_piece_once(odd, monkeypatch):
    monkeypatch.setattr(packing, "PER_SALT", 2)
    rows = packing.pack_documents(odd, WORDS, most=64).collect()
    tokens = packing.WordTokenizer(WORDS)
    ids = {i: tokens.whole(t or "") + bytes(4) for i, t, *_ in ODD}
    held = defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(part) == r["ids_crc32"] and r["start"] == 64 * r["piece"]
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(ids[i]) // 4 for i, *_ in ODD)
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(odd.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_plans_are_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(4, 1, 20_000).astype(int), 1, 512)
    counts = np.bincount(lengths, minlength=513)
    made = packing.plan(counts)
    assert made.sequences <= 1.01 * lengths.sum() / 512 + 1
    place = np.concatenate([np.arange(n) for n in counts])
    sequence, offset = made.find(np.repeat(np.arange(513), counts), place)
    assert len(set(zip(sequence.tolist(), offset.tolist()))) == len(lengths)
    assert packing.plan(np.zeros(513, int)).sequences == 0


def test_language(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert rows.where("lang = lang_pred").count() >= 0.95 * rows.count() > 0
    model = langid.learn(docs)
    told = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert told[2]["lang_pred"] == told[3]["lang_pred"] == told[7]["lang_pred"] == "und" and told[3]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in told.values()) and told[5]["lang_pred"] in model[0]
    nothing = langid.identify(odd.where("lang is null"))
    assert [r["lang_pred"] for r in nothing.collect()] == ["und"]
    assert langid.identify(odd.limit(0)).count() == 0
    long = langid.gram_counts(LONG)
    monkey = langid.SLICE
    try:
        langid.SLICE = 1000  # slices of a long text count every run once
        assert (langid.gram_counts(LONG) == long).all()
    finally:
        langid.SLICE = monkey


def test_quality(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels)
    assert rows.count() == docs.count() and rows.where("score < 0 or score > 1 or score is null").isEmpty()
    tested = rows.where("held_out").join(labels, "doc_id")
    assert tested.where("predicted = quality").count() >= 0.95 * tested.count()
    assert rows.where(F.col("held_out") != held_out("doc_id")).isEmpty()
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == rows.where("predicted = 1").count()


def test_quality_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.score_documents(odd, none).collect()
    assert len(rows) == len(ODD) and {r["score"] for r in rows} == {0.5}
    assert quality.score_documents(odd.limit(0), none).count() == 0


PAGES = [
    ("<p>a<p>b&amp;c &nbsp; d", "a\nb&c d"),
    ("<div class='sidebar'>s</div>t", "t"),
    ("<article>1<div class=comments>no</div><p>2<b>3</article>x", "1\n23"),
    ("<body><main><h1>T</h1><p>x</p></main>foot", "T\nx"),
    ('<p title="unclosed>text</p>more', "text\nmore"),
    ("<p>one <span class='ad'>buy</span> two</p>", "one\ntwo"),
    ("<script>var a='<p>no</p>';</script><p hidden>no</p>a < b<br>c &copy &quo", "a < b c © &quo"),
    ("<!-- <p>no --><ul><li>x<li>y</ul><form>f</form>", "x\ny"),
    ("", ""),
    (None, ""),
    ("<p>" + "word " * 50_000, " ".join(["word"] * 50_000)),
    # names and forms around the article declare nothing
    ("<div class='wrap has-sidebar'><nav>n</nav><h1>T</h1><p>some text</p><div class=sidebar>s</div></div>", "T\nsome text"),
    ("<article class='post no-comments'><p>some text</p></article><div class=comments>c</div>", "some text"),
    ("<form id=f><div class=menu>m</div><h1>T</h1><p>text</p><fieldset><legend>L</legend></fieldset></form>", "T\ntext"),
    ("<div class='site social'><p>long text of a page without any heading</p></div>x", "long text of a page without any heading\nx"),
    ("<article><p>one <label>two</label> three</p><form><label>Mail</label>me</form></article>", "one two three"),
    ("<div><p>the text</p></div><div class=responses>r</div><div class=adbox>a</div><p class=gdpr>g</p><div id=topbar>t</div>", "the text"),
    ("<div><p>the text of it</p></div><div class=related><article>teaser</article></div>", "the text of it"),
    ("<article>text</article><div class=comments><article>a long reader comment, longer than all</article></div>", "text"),
]


def test_pages(spark):
    rows = [(i, None if i % 2 else f"http://h{i}.example/", p, "t") for i, (p, _) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in sitestyle.main_text(pages).collect()}
    for i, (_, text) in enumerate(PAGES):
        assert got[i]["text"] == text and got[i]["n_chars"] == len(text), PAGES[i][0]
    assert sitestyle.main_text(pages.limit(0)).count() == 0


def test_style_tree_finds_what_a_site_repeats(spark):
    """Nothing is declared here: only the merged tree tells the repeated parts."""
    page = "<body><div class=top><a>Home</a><a>Shop</a></div><div class=body><p>Text {0}.</p>{1}</div><div class=low>Call us</div>"
    rows = [(i, "http://Shop.example/a", page.format(i, "<p>more {}</p>".format(i) * (i % 3))) for i in range(9)]
    rows += [(100 + i, "http://copy.example/", page.format(0, "")) for i in range(9)]  # one page, many copies
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in sitestyle.main_text(pages).collect()}
    for i in range(9):
        assert got[i] == "\n".join([f"Text {i}."] + [f"more {i}"] * (i % 3))
        assert got[100 + i] == "HomeShop\nText 0.\nCall us"


def test_hosts_with_noise_like_wrappers(spark):
    """The wrapper stays on every page, what the host repeats inside it goes."""
    page = "<body><div class='page has-sidebar'><div class=promoted>Buy our book</div><h1>About {0}</h1><p>Text {0}.</p><div class=x7>Write us</div></div>"
    shop = "<body><form id=aspnetForm><div class=top>Home Shop</div><h1>Thing {0}</h1><p>It is {0}.</p><div class=low>Call us</div></form>"
    rows = [(i, "http://news.example/", page.format(i)) for i in range(9)] + [(100 + i, "http://shop.example/", shop.format(i)) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in sitestyle.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(9):
        assert got[i] == f"About {i}\nText {i}." and got[100 + i] == f"Thing {i}\nIt is {i}."


def test_what_a_site_repeats_inside_articles_goes(spark):
    page = (
        "<body><p>Top</p><article><h1>Title {0}</h1><p>Text {0}.</p><div class=offer><p>Order our magazine</p></div>"
        "<div>Call us</div><p>More {0}.</p></article>"
    )
    rows = [(i, "http://many.example/", page.format(i)) for i in range(9)]
    rows += [(100 + i, "http://few.example/", page.format(i).replace("article", "main")) for i in range(3)]
    rows += [(200, "http://one.example/", page.format(0))]
    # versions of one article: only a date differs
    rows += [(300 + i, "http://same.example/", page.format(0).replace("<p>Text", f"<i>{i}</i><p>Text")) for i in range(6)]
    rows += [(400 + i, "http://two.example/", page.format(0).replace("More", f"More {i}")) for i in range(2)]
    rows += [(500 + i, "http://plain.example/", f"<body><div class=a>Go</div><p>Own {i}.</p><p>Its {i}.</p>") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in sitestyle.main_text(pages).collect()}
    for i, _, _ in rows:
        n = i % 100
        if i < 200:
            assert got[i] == f"Title {n}\nText {n}.\nMore {n}.", i
        elif i < 500:
            assert "Title 0" in got[i] and "Text 0." in got[i] and "Order our magazine\nCall us" in got[i]
        else:
            assert got[i] == f"Own {n}.\nIts {n}."


def test_article_markup_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in sitestyle.main_text(pages).collect()}
    import html

    for row in pages.collect():
        article = re.search("<article>(.*?)</article>", row["html"], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert got[row["page_id"]] == "\n".join(p for p in parts if p)
