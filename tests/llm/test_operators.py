"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns; and empty tables."""

import base64
import dataclasses
import hashlib
import os
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluvial.llm import bpe, decontaminate, host_rules, html_extract, langid, line_dedup, minhash, pii_crf, quality_lm, warc_index
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return brute.documents(spark, [])


def rows(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# -- 1 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(open(VOCABULARY, encoding="utf-8").read()))


def test_bpe_documents(docs, none, tokenizer):
    done = bpe.decode_documents(bpe.encode_documents(docs, VOCABULARY), VOCABULARY)
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in done.collect())
    want = Counter()
    for doc_id, text, *_ in brute.DOCS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want[doc_id, len(ids), tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    again = bpe.encode_documents(docs, VOCABULARY, decoded="decoded")
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in again.collect()) == want
    assert bpe.decode_documents(bpe.encode_documents(none, VOCABULARY), VOCABULARY).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeinst  \n'0ñ漢"))))
def test_bpe_any_text(tokenizer, encoder, text):
    assert encoder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=6))
def test_bpe_joined_tokens(tokenizer, encoder, ids):
    text = b"".join(encoder.v.bytes[i] for i in ids).decode("utf-8", "ignore")
    assert encoder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_special_and_long(tokenizer, encoder):
    for text in ("a<|endoftext|>b", "x" * 5000, " " * 3000 + "y", "\n\n a", "<|endoftext|><|endoftext|>"):
        assert encoder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    decoder = bpe.Decoder(encoder.v)
    bad = [150, 230, 50256, 99]  # bytes that aren't UTF-8
    assert decoder.decode(np.array(bad)) == tokenizer.decode(bad, skip_special_tokens=False)
    assert decoder.decode(np.array([], int)) == ""


# -- 2 -----------------------------------------------------------------------------------------------------------------


def test_quality_model_separates(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    done = quality_lm.classify(d, labels).join(labels.select("doc_id", "quality"), "doc_id")
    share = {r.quality: r.k for r in done.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.97 and share[0] < 0.45
    held = done.where("trusted").join(d.where(quality_lm.held_out(F.col("text"))).select("doc_id"), "doc_id")
    assert held.agg(F.avg(F.col("kept").cast("int")).alias("k")).first().k > 0.97  # also of those that it hasn't learned


def test_quality_model_cases(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (1, 1), (17, 0), (None, 1), (20, 1)], "doc_id bigint, quality int")
    got = quality_lm.classify(docs, labels)
    assert got.count() == len(brute.DOCS)
    byid = {r.doc_id: r for r in got.collect()}
    assert not byid[5].kept and not byid[6].kept and not byid[7].kept and byid[5].perplexity is None
    assert byid[1].kept and byid[1].trusted and not byid[17].trusted
    assert quality_lm.classify(none, labels).count() == 0
    untrained = quality_lm.classify(docs, labels.limit(0))
    assert all(r.kept == (r.n_chars_scored > 0) for r in untrained.collect())


TRUSTED = ["alpha beta gamma delta", "alpha beta gamma delta", "alpha beta zeta", "Alpha gamma beta alpha once", "漢字 かな née", None, " "]


def gains_of(spark, trusted):
    d = spark.createDataFrame([(t,) for t in trusted], "text string")
    speller = quality_lm.train_speller(d)
    return speller, *quality_lm.train(d, speller)


def test_brute_model_sums_to_one():
    _, model = brute.perplexity([t for t in TRUSTED if t and t.isascii()])
    words = {k[-1] for k in model.counts[0]}
    unknown = 1 - sum(model.base(w) for w in words)  # all other words together: only the lowest order has them
    for context in (("", ""), ("alpha", "beta"), ("beta", "alpha"), ("never", "seen")):
        left = 1.0
        for n in (2, 1, 0):
            c = context[2 - n :]
            if total := model.total[n].get(c, 0):
                left *= model.left[n][c] / total
        assert abs(sum(model.p(*context, w) for w in words) + left * unknown - 1) < 1e-9


@pytest.mark.parametrize("hot,bits", [(0, 10), (5, 7), (10_000, 27)])
def test_perplexities_against_brute_force(spark, monkeypatch, hot, bits):
    """Whatever hot table and Bloom filter hold, perplexities are those of the plain model."""
    monkeypatch.setattr(quality_lm, "BLOOM_BITS", bits)
    texts = ["alpha beta gamma", "gamma delta alpha unseen", "漢字 文字 née", "alpha", "zzz 1 \U0001F600", "", None, "once alpha beta zeta " * 50]
    speller, gains, free = gains_of(spark, TRUSTED)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: r.perplexity for r in quality_lm.perplexities(docs, speller, gains, free, ["doc_id"], hot=hot).collect()}
    of, _ = brute.perplexity(TRUSTED)
    for k, t in enumerate(texts):
        assert got[k] is None and of(t) is None or got[k] == pytest.approx(of(t), rel=1e-5), t


def test_quality_model_in_rounds(spark, monkeypatch):
    """Many rounds, shards and packs give the plain model's perplexities, and of all tables only the scores stay on disk."""
    from fluvial.common import shared_dir

    monkeypatch.setattr(quality_lm, "ROUND_TOKENS", 8)
    monkeypatch.setattr(quality_lm, "SHARDS", 3)
    texts = [t for t in TRUSTED if t] + ["gamma delta alpha unseen", "alpha beta", "alpha beta", "漢字 文字 née"]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(3)
    held = {r.doc_id for r in docs.where(quality_lm.held_out(F.col("text"))).collect()}
    good = range(len(TRUSTED) - 2)
    labels = spark.createDataFrame([(k, 1) for k in good], "doc_id bigint, quality int")
    at = f"{shared_dir(spark).removeprefix('file:')}/fluvial"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    got = {r.doc_id: r.perplexity for r in quality_lm.classify(docs, labels).collect()}
    assert {name.rsplit("-", 1)[0] for name in set(os.listdir(at)) - before} == {"lm-scores"}
    of, _ = brute.perplexity([texts[k] for k in good if k not in held])
    for k, t in enumerate(texts):
        assert got[k] is None and of(t) is None or got[k] == pytest.approx(of(t), rel=1e-5), t


def shard_of(spark, texts, learned):
    """All trigrams of texts in one shard."""
    d = spark.createDataFrame([(t, x, True) for t, x in zip(texts, learned)], "text string, learned boolean, scored boolean").repartition(2)
    deal = dataclasses.replace(quality_lm.dealt(d.select("text", "learned"), 10**9), shards=1, rounds=1)
    shared = quality_lm.share(spark, deal, None)
    return quality_lm.Shard(quality_lm.packs(d, shared, 1, 0).toArrow(), shared.value[2])


@pytest.mark.parametrize("book", [0, 2, 1000])
def test_quality_packs_hold_every_trigram(spark, monkeypatch, book):
    """Whatever words have numbers of their own, and also if three don't fit in one number."""
    monkeypatch.setattr(quality_lm, "BOOK", book)
    texts = [t for t in TRUSTED if t] + ["once alpha beta zeta " * 5, "漢字 文字 née", "alpha"]
    shard = shard_of(spark, texts, [k % 2 == 0 for k in range(len(texts))])
    want = Counter()
    for k, t in enumerate(texts):
        if w := quality_lm.words_of(t):
            at = [quality_lm.START] * 2 + quality_lm.hashes(w).tolist() + [quality_lm.END]
            want.update((int(a), int(b), int(c), quality_lm.LEARN * (k % 2 == 0) + quality_lm.SCORE, quality_lm.text_key(t)) for a, b, c in zip(at, at[1:], at[2:]))
    key = shard.key.tolist()
    rows = zip(shard.first, shard.middle, shard.last, shard.use.tolist(), shard.texts[shard.text].tolist())
    assert Counter((key[a], key[b], key[c], use, text) for a, b, c, use, text in rows) == want
    plain = Counter(x[:3] for x in want.elements())
    for bits in (64, 1):
        monkeypatch.setattr(quality_lm, "BITS", bits)
        t = quality_lm.Trigrams(shard, np.arange(len(shard.use)))
        assert sorted(t.counts(np.arange(len(t.of)))) == sorted(plain.values())
        assert sorted(Counter(t.context.tolist()).values()) == sorted(Counter(x[:2] for x in plain).values())


def test_quality_packs_are_small(spark):
    """On its way to one of many shards a trigram takes fewer bytes than with hashes of all its words: those were 12.3."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text IS NOT NULL AND doc_id < 4000").select("text", F.lit(True).alias("learned"), F.lit(True).alias("scored")).coalesce(1)
    deal = dataclasses.replace(quality_lm.dealt(d.select("text", "learned"), 10**9), shards=48, rounds=1)
    size = sum(r.n for r in quality_lm.packs(d, quality_lm.share(spark, deal, None), 1, 0).select(F.length("pack").alias("n")).collect())
    assert size < 11 * d.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")) + 1)).first()[0]


# -- 3 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("min_sites", [2, 3])
def test_line_dedup(docs, none, min_sites):
    got = line_dedup.remove_boilerplate(docs, min_sites=min_sites)
    assert rows(got, "doc_id", "text") == Counter(brute.line_dedup(brute.DOCS, min_sites))
    assert set(brute.CLASHES) - set(got.columns) == set() and got.select("n_removed").agg(F.sum("n_removed")).first()[0] > 0
    assert line_dedup.remove_boilerplate(none).count() == 0


# -- 4 -----------------------------------------------------------------------------------------------------------------

ITEMS = [(1, "Word5 word6, word7 word8 word9 word10 word11 word12 word13 word14 WORD15"), (2, "lazy dog"), (10, "dog near the"), (3, None), (4, "!!!"), (5, "no such text anywhere in here at all my friend of mine"), (2, "lazy dog"), (None, "fox jumps")]


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.contamination(docs, items)
    want = brute.contamination(brute.DOCS, [("" if i is None else i, t) for i, t in ITEMS])
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == Counter((*w[:3], tuple(w[3])) for w in want)
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_decontaminate_many_windows_and_segments(spark, docs, monkeypatch):
    """Windows that aren't broadcast, in several parts, and small segments."""
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    want = brute.contamination(brute.DOCS, [("" if i is None else i, t) for i, t in ITEMS])
    got = decontaminate.contamination(docs, items, segment_words=50)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == Counter((*w[:3], tuple(w[3])) for w in want)


def test_decontaminate_moves_only_segments_with_windows(spark, monkeypatch):
    """Of many segments one holds windows, more than a block of them; the others aren't moved, and it is in parts."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    moved = []
    plain = decontaminate.checked_join
    monkeypatch.setattr(decontaminate, "checked_join", lambda *a, **k: moved.append(plain(*a, **k)) or moved[-1])
    d = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(40))) for k in range(30)], "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([(1, " ".join(f"w7x{j}" for j in range(5, 35)))], "item_id bigint, text string")
    index = decontaminate.materialize(decontaminate.build_index(d, 40), "index")
    assert index.count() == 30
    found = decontaminate.search(index, items).collect()
    assert [(r.doc_id, [tuple(s) for s in r.spans]) for r in found] == [(7, [(5, 35)])]
    wanted = next(m for m in moved if {"positions", "parts"} <= set(m.columns)).collect()
    assert len(wanted) == 1 and wanted[0].parts > 1


def test_proximity(spark):
    d = spark.createDataFrame([(1, "red fox runs home"), (2, "red big fox runs home"), (3, "fox red"), (4, "red"), (5, "fox runs home")], "doc_id bigint, text string")
    index = decontaminate.build_index(d)
    items = spark.createDataFrame([(7, "red fox runs")], "item_id bigint, text string")
    assert [r.doc_id for r in decontaminate.search(index, items).collect()] == [1]
    assert sorted(r.doc_id for r in decontaminate.search(index, items, slop=1).collect()) == [1, 2]
    again = spark.createDataFrame([(7, "a b"), (8, "b c")], "item_id bigint, text string")
    index = decontaminate.build_index(spark.createDataFrame([(1, "a b a b x a b c")], "doc_id bigint, text string"))
    assert {(r.item_id, tuple(map(tuple, r.spans))) for r in decontaminate.search(index, again).collect()} == {("7", ((0, 4), (5, 7))), ("8", ((6, 8),))}


# -- 5 -----------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>x="</p>"</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies, many, many, many.</div><article><h1>Title &amp; more</h1><p><b>First para, with commas, and
 enough text to count.<br><p>Second &lt;para&gt;&nbsp;here.</p><aside>Related, things, here, and, there</aside><p>A.</p><div class="comments"><p>Great, really, great, so, great!</p></div></article>
<form><p>Name, address, phone</p></form><footer>&copy; me</footer></body>"""


def test_html_cases(spark):
    want = "Title & more\nFirst para, with commas, and enough text to count.\nSecond <para> here.\nA."
    cases = [(1, "u", PAGE, want), (2, None, None, ""), (3, "u", "", ""), (4, "u", "just text", "just text"), (4, "u", "just text", "just text"), (5, "u", "<p>a<p>b", "a\nb"), (6, "u", "<script>only()</script>", ""), (7, "u", "<div>" * 5000 + "deep", "deep"), (None, "u", "<p>x", "x"), (8, "u", "<a href='\">q</a> <p", "q <p")]
    df = spark.createDataFrame([c[:3] for c in cases], "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars")})
    assert rows(html_extract.extract_pages(df), "page_id", "url", "text", "n_chars") == Counter((*c[:2], c[3], len(c[3])) for c in cases)
    assert html_extract.extract_pages(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abp divlscrt=\"'&;!-\n", max_size=80))
def test_html_never_fails(page):
    assert isinstance(html_extract.extract(page), str)


def tag_end(page, at):
    """The same as _tag_end, tag by tag."""
    while q := html_extract.IN_TAG.search(page, at):
        if not q[1]:
            return q.start()
        close = page.find(q[1], q.end())
        if close < 0:
            return -1
        at = close + 1
    return -1


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="<> a='\"", max_size=60))
def test_html_tags_end_where_each_alone_does(page):
    ends = {}
    assert [html_extract._tag_end(page, k, ends) for k in range(len(page) + 1)] == [tag_end(page, k) for k in range(len(page) + 1)]


@pytest.mark.parametrize("n", [1, 31, 32, 33, 1000])
def test_html_quotes_count_behind_any_number_of_open_ones(n):
    assert html_extract.extract("<b ='' ='>" * n + '<p title="x > y">Text of the paragraph.</p>') == "Text of the paragraph."


def test_html_without_article():
    page = "<body><div id=menu><a href=1>One, two</a></div><div class=content><p>" + "Long text, with commas, " * 5 + "</p><p>Tail</p></div><div class=sidebar><p>Side, side, side</p></div></body>"
    assert html_extract.extract(page) == ("Long text, with commas, " * 5).strip() + "\nTail"


def test_html_siblings_of_the_container():
    long = "<p>" + "Long text, with commas, " * 8 + "</p>"
    menu = "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><div><a href=3>Three</a></div>"
    page = f"<body><h1>Title</h1><p>intro</p>{menu}<div>{long * 5}</div><div><h2>Short</h2><p>section</p></div><p>end</p><pre>x = 1</pre></body>"
    body = ("Long text, with commas, " * 8).strip()
    assert html_extract.extract(page) == "\n".join(["Title", "intro", *[body] * 5, "Short", "section", "end", "x = 1"])
    loose = f"<body>See <a href=1>this</a> before all <a href=2>Home</a> of it<div>{long * 5}</div></body>"
    assert html_extract.extract(loose) == "\n".join(["See this before all Home of it", *[body] * 5])


def test_html_words_in_names_of_wrappers():
    long = "<p>" + "Long text, with commas, " * 8 + "</p>"
    for name in ("site has-sidebar", "no-sidebar", "with-comments", "page-with-widget-area", "layout-sidebar-left"):
        page = f'<body><div class="{name}"><div class="article-header"><h1>Title</h1></div><div>{long * 5}</div><div class="left-sidebar"><p>Side, side</p></div></div></body>'
        assert html_extract.extract(page).split("\n") == ["Title", *[("Long text, with commas, " * 8).strip()] * 5], name
    assert "Long" not in html_extract.extract(f"<body><div class='comments'>{long * 9}</div><div>{'A body of text. ' * 20}</div></body>")


WORDY = st.text("ab, ", min_size=0, max_size=260).map(lambda t: " ".join(t.split()))
LEAF = st.one_of(st.tuples(st.sampled_from(["p", "h2"]), st.lists(WORDY, min_size=1, max_size=1)), st.tuples(st.just("p"), st.tuples(st.tuples(st.just("a"), st.lists(WORDY, min_size=1, max_size=1))).map(list)))
TREE = st.recursive(LEAF, lambda inner: st.tuples(st.sampled_from(["div", "section"]), st.lists(inner, min_size=1, max_size=4)), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(TREE)
def test_html_against_brute_force(tree):
    assert html_extract.extract(f"<html><body>{brute.page(tree)}</body></html>") == brute.main_text(tree)


@pytest.mark.parametrize("name", ["overflow-hidden", "content with-sidebar", "col has-sidebar", "post no-comments", "article-header-image", "ad-free", "social-science", "sidebar", "hidden"])
def test_html_wrapper_of_all_text(name):
    text = "A paragraph of the article, which is not short, and has commas."
    assert html_extract.extract(f'<body><div class="{name}"><p>{text}</p><p>{text}</p></div></body>') == f"{text}\n{text}"
    assert html_extract.extract(f'<body><form action="/"><div id="x"><p>{text}</p><p>{text}</p></div></form></body>') == f"{text}\n{text}"


def test_html_leaves_out_what_is_beside_the_text():
    text = "A paragraph of the article, which is not short, and has commas. " * 4
    page = f'<header><h1>Site</h1></header><div class="main"><div class="text"><p>{text}</p><p>{text}</p></div><div class="sidebar"><p>Side</p></div><div class="site-comments"><p>Reader</p></div><form><p>Form</p></form></div>'
    got = html_extract.extract(f"<body>{page}</body>")
    assert got == f"{text.strip()}\n{text.strip()}"
    assert html_extract.extract(f"<article><header><h1>Title</h1></header><p>{text}</p></article>").startswith("Title\n")


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a " * 350_000 + ">", "<b>" * 100_000 + "<li>" * 100_000, "<b>" * 100_000 + "<p>x" * 100_000, "<a href=\">" * 100_001, "<a ='' ='>" * 100_001, "<a =\"'>" * 100_001, "<a =\"' ='\" >" * 70_000 + "<b =\"", "<svg>" * 200_000, "<td>" * 250_000, "<ul><li>" * 120_000, "<div><p>" * 60_000 + "</p></div>" * 60_000])
def test_html_of_a_megabyte_takes_linear_time(page):
    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 60


# -- 6 -----------------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.train(d, ~langid.held_out(F.col("doc_id")), per_lang=200)
    done = langid.identify(d, model).where(langid.held_out(F.col("doc_id")))
    r = done.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.avg(F.col("rejected").cast("int")).alias("r"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a > 0.99 and r.r < 0.01 and 0 <= r.lo and r.hi <= 1


def test_language_cases(docs, none):
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    got = langid.identify(docs, model).collect()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
        assert r.lang_pred == "und" or r.lang_pred in model.languages
        assert r.rejected or r.lang_pred != "und"
    assert len(got) == len(brute.DOCS)
    assert langid.identify(none, model).count() == 0
    empty = langid.train(none, ~langid.held_out(F.col("doc_id")))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_language_parts_agree(docs, monkeypatch):
    model = langid.train(docs, F.lit(True))
    texts = [d[1] for d in brute.DOCS]
    whole = model.predict(texts)
    monkeypatch.setattr(langid, "CHUNK", 50)
    parts = model.predict(texts)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("aé ß1,漢", max_size=40)), max_size=5))
def test_language_against_brute_force(texts):
    """Each text's n-grams one by one: their rows of the table averaged, the bias added, a softmax with the temperature."""
    rng = np.random.default_rng(5)
    model = langid.Model(["x", "y", "z"], rng.normal(0, 3, (langid.BUCKETS, 3)).astype(np.float32), rng.normal(size=3), 1.7, 0.5)
    found, score = model.predict(texts)
    for t, f, s in zip(texts, found, score):
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        rows = []
        for w in words:
            padded = f" {w} "
            for n in (1, 2, 3, 4):
                for gram in (padded[i : i + n] for i in range(len(padded) - n + 1)):
                    if gram != " ":
                        h = n
                        for c in gram:
                            h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
                            h ^= h >> 15
                        rows.append(((h * 0x9E3779B1) & 0xFFFFFFFF) >> 16)
        if not words:
            assert f == "und" and s == 0
            continue
        # words lie side by side, so the space between two of them also ends one n-gram and begins another
        z = (model.table[rows].astype(float).mean(0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert s == pytest.approx(p.max(), abs=1e-4) and f == model.languages[int(p.argmax())]


# -- 7 -----------------------------------------------------------------------------------------------------------------


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@+- 0123(456)\n", max_size=60))
def test_pii_base_spans(text):
    got = sorted(pii_crf.base_spans(text), key=lambda s: (s[1], pii_crf.KINDS.index(s[0])))
    assert got == brute.base_spans(text)


def test_pii_documents(docs, none):
    field = pii_crf.train(docs)
    got = pii_crf.find(docs, field).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, len(r.base))
    want = sorted(((d[0], brute.base_spans(d[1])) for d in brute.DOCS), key=lambda x: (x[0] is None, x[0] or 0, len(x[1])))
    assert [(r.doc_id, [tuple(s) for s in r.base]) for r in sorted(got, key=key)] == want
    for r in got:
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert pii_crf.find(none, field).count() == 0
    assert pii_crf.train(none).weights.any() == False  # noqa: E712


def agreeing_field():
    """A field that knows a phone by its plus sign, and that repeats agree."""
    labels, n = len(pii_crf.LABELS), len(pii_crf.ENTITIES)
    weights = np.zeros((pii_crf.BUCKETS, labels))
    weights[pii_crf._hash("+"), 4] = 6.0
    weights[pii_crf._hash("no +"), 0] = 0.5
    spokes = np.full((2, labels, labels), -2.0)
    for k in range(labels):
        spokes[:, k, k - n if k > n else k] = 2.0
    return pii_crf.Field(weights, np.zeros((labels, labels)), spokes)


def graph_of(text):
    g = pii_crf.Graph()
    g.add(0, text, pii_crf.base_spans(text))
    return g


def test_pii_evidence_reaches_all_repeats():
    """One marked number among a hundred repeats, at the beginning, in the middle or at the end."""
    for marked in (0, 50, 99):
        g = graph_of(" and ".join("+12125550100" if i == marked else "12125550100" for i in range(100)))
        p = agreeing_field().probabilities(g)
        phone = (p[:, 4] + p[:, 9])[[i for i, (a, b) in enumerate(g.span) if b - a > 3]]
        assert len(phone) == 100 and len(g.spokes) <= 200 and (phone > 0.7).all()


def test_pii_marginals_are_those_of_all_labellings():
    """Graphs of small texts that are trees, summed over all labellings."""
    rng = np.random.default_rng(3)
    labels = len(pii_crf.LABELS)
    field = pii_crf.Field(rng.normal(size=(pii_crf.BUCKETS, labels)), rng.normal(size=(labels, labels)), rng.normal(size=(2, labels, labels)))
    for text in ("x jo@a.example y", "7 + 7", "+12125550100\n.\n.\nor then 12125550", "aa b@c.d"):
        g = graph_of(text)
        unary, edges, kinds, tables = field.factors(g)
        assert len(edges) < len(unary) <= 5
        joint = np.zeros((labels,) * len(unary))
        for i, u in enumerate(unary):
            joint = joint + u.reshape([labels if j == i else 1 for j in range(len(unary))])
        for (a, b), k in zip(edges, kinds):
            t = tables[k] if a < b else tables[k].T
            joint = joint + t.reshape([labels if j in (a, b) else 1 for j in range(len(unary))])
        joint = np.exp(joint - joint.max())
        joint /= joint.sum()
        want = np.array([joint.sum(tuple(j for j in range(len(unary)) if j != i)) for i in range(len(g.span))])
        assert np.allclose(field.probabilities(g), want, atol=1e-5)


def test_pii_trained_field_finds_all_repeats(spark):
    field = pii_crf.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = [" and ".join("+1 (407) 555-7710" if i == marked else other for i in range(100)) for marked in (0, 50, 99) for other in ("14075557710", "407-555-7710", "1 (407) 555-7710")]
    got = pii_crf.find(spark.createDataFrame([*enumerate(texts), (9, " and ".join(["14075557710"] * 50))], "doc_id int, text string"), field)
    assert {r.doc_id: (len(r.base), len(r.spans)) for r in got.collect()} == {i: (1, 100) if i < 9 else (0, 0) for i in range(10)}


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01", "sf0.1"])
def trained(spark, request):
    return pii_crf.train(spark.read.parquet(f"/root/testdata/{request.param}/documents.parquet"))


@pytest.mark.parametrize("kind", pii_crf.ENTITIES)
def test_pii_every_layout_and_any_number_of_repeats(trained, kind):
    """For each layout of what a pattern knows, all repeats in each other layout are found, and none of as many unmarked ones."""
    rng = np.random.default_rng(9)
    for known in pii_crf.KNOWN[kind]:
        for other in pii_crf.OTHER[kind]:
            for n in (1, 2, 10, 100):
                entity = pii_crf.made_entity(kind, rng)
                unmarked = [other(pii_crf.made_entity(kind, rng)) for _ in range(n)]
                if pii_crf.base_spans(" ; ".join([other(entity), *unmarked])):
                    continue  # a pattern knows it by chance
                head = f"call {known(entity)} now and then "
                text = head + " and ".join(f"see {other(entity)} there or {u} here" for u in unmarked)
                base = pii_crf.base_spans(text)
                g = pii_crf.Graph()
                g.add(0, text, base + pii_crf.secret_spans(text, base))
                p, label = trained.probabilities(g), np.array(g.label)
                assert (p[label > 0, label[label > 0]] > 0.99).all()
                got = {(k, *pii_crf._core(text, g.span[i][0], g.span[j][1])) for _, k, i, j in pii_crf.further_spans(g, p, 0.7)}
                want, at = set(), len(head)
                while (at := text.find(other(entity), at)) >= 0:
                    want.add((kind, *pii_crf._core(text, at, at + len(other(entity)))))
                    at += 1
                assert {x for x in got if x[1] >= len(head)} == want and len(want) == n, (known(entity), other(entity), n)


def test_pii_unsettled_documents_lose_only_free_hubs(monkeypatch):
    g, field = graph_of("7 1234567 and 1234567 or 12345678 +12125550100 2125550100"), agreeing_field()
    monkeypatch.setattr(pii_crf, "STILL", -1.0)  # nothing ever settles
    monkeypatch.setattr(pii_crf, "ROUNDS", 30)
    got = field.probabilities(g)
    unary, edges, kinds, tables = field.factors(g, free=False)
    assert set(kinds) <= {2} and np.allclose(got, pii_crf.marginals(unary, edges, kinds, tables)[: len(g.span)])


def test_pii_numbers_of_several_tokens_repeat():
    same = ["+1 (407) 555-7710", "14075557710", "1-407-555-7710", "407-555-7710", "407 555 7710", "1 (407) 555-7710"]
    for other in same[1:]:
        text = f"call {same[0]} now or {other} then"
        g = graph_of(text)
        tied = {t for t, _, kind in g.spokes if kind == 0}
        assert {i for i, (a, b) in enumerate(g.span) if text[a:b] not in ("1", "call", "now", "or", "then")} <= tied, other
    g = graph_of("card 4111 1111 1111 1112 and 4111111111111112 end")
    assert len({t for t, *_ in g.spokes}) == 5
    g = graph_of("write to jo.doe@a.example or to JoDoe+x@b.example today")
    assert len({t for t, _, kind in g.spokes if kind == 1}) == 2 and not [x for x in g.spokes if x[2] == 0]
    long = "x" * 3000 + "@example.com"
    assert pii_crf._hash("@") in pii_crf.token_features(long, "", "") and pii_crf.token_features(long, "", "") != pii_crf.token_features(long + ".uk", "", "")


def test_pii_finds_secrets_and_leaves_other_numbers(spark):
    field = pii_crf.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    texts = [f'we have token = "{key}" here', f'token = "{key}" and later {key} again', "version 2.0. and 3.11, 1984 pages, 4712341234123412 items", "plain words only"]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii_crf.find(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string"), field).collect()}
    assert got[0] == [("secret", 17, 57)] and ("secret", 9, 49) in got[1] and got[2] == got[3] == []


def test_pii_long_and_hostile_texts():
    began = time.process_time()
    for text in ("1" * 300_000, "@" * 300_000, "a@" * 150_000, "1.1." * 80_000, "+1 " * 100_000, "word" * 200_000 + " 1", " " * 500_000 + "1" + " " * 500_000, "0" * 45 + "1.2.3.4"):
        graph_of(text)
    assert pii_crf.base_spans("a " + "0" * 45 + "1.2.3.4 b") == [("ip", 2, 54)]
    assert time.process_time() - began < 60


def test_message_passing_is_exact_on_trees():
    rng = np.random.default_rng(0)
    unary, edges, tables = rng.normal(size=(4, 3)), np.array([[0, 1], [1, 2], [1, 3]]), rng.normal(size=(3, 3, 3))
    joint = np.zeros((3,) * 4)
    for y in np.ndindex(*joint.shape):
        joint[y] = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(t[y[a], y[b]] for (a, b), t in zip(edges, tables)))
    joint /= joint.sum()
    want = np.array([joint.sum(tuple(j for j in range(4) if j != i)) for i in range(4)])
    assert np.allclose(pii_crf.marginals(unary, edges, np.arange(3), tables), want, atol=1e-6)


# -- 8 -----------------------------------------------------------------------------------------------------------------


def test_host_rules(docs, none):
    got = host_rules.apply_rules(docs)
    want = Counter((d[0], *brute.host_metrics(d[1])) for d in brute.DOCS)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not r.kept or not r.base_failed
    assert host_rules.apply_rules(none).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from(["a b c d e", "a b", "x\n", "\n", " ", "c d e f g", "#$ é"]), max_size=9))
def test_host_metrics_any(spark, parts):
    text = " ".join(parts)
    m = host_rules.document_metrics(spark.createDataFrame([(1, text, "h")], "doc_id int, text string, source string")).first()
    assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute.host_metrics(text)


def test_host_verdict(spark):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(20)), f"good{i % 5}") for i in range(100)]
    bad = [(1000 + i, "short text", "bad") for i in range(50)] + [(2000, " ".join(f"v{k}" for k in range(20)), "bad")]
    got = host_rules.apply_rules(spark.createDataFrame(good + bad, "doc_id int, text string, source string"))
    assert got.where("doc_id = 2000 AND NOT base_failed AND NOT kept").count() == 1 and got.where("doc_id < 1000 AND NOT kept").count() == 0


# -- 9 -----------------------------------------------------------------------------------------------------------------

PAGES = [(5, "http://www.B.example.com/x?a=1#f", "<p>one</p>"), (2, "https://a.example.org/", "<p>one</p>"), (9, "http://b.example.com/y", None), (10, "bad\turl\r\n", ""), (11, None, "r\r\n\r\nWARC/1.1\r\n\r\n é漢"), (12, "http://b.example.com/y", "z" * 3_000_000), (12, "http://b.example.com/y", "z" * 3_000_000), (None, "http://c.example.com/", "nobody"), (None, "http://c.example.com/", "nobody")]


def _pages(spark, data=PAGES):
    return spark.createDataFrame(data, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("n", "path", "payload", "first")}).repartition(3)


def test_warc_round_trip(spark):
    got = warc_index.archive_and_read(_pages(spark))
    want = Counter()
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(same) if same else None
        kind = "response" if page_id == first else "revisit"
        want[page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, None if kind == "response" else first] += 1
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert warc_index.archive_and_read(_pages(spark).limit(0)).count() == 0
    odd = [(1, "  no host\t", "x" * 3_000_000), (2, None, "a"), (3, "http://h.example/\r\n?q", "b"), (4, "no host", "c"), (None, "\t", None)]
    got = warc_index.archive_and_read(spark.createDataFrame(odd, "page_id bigint, url string, html string"))
    assert Counter((r.page_id, r.payload_bytes) for r in got.collect()) == Counter((p, len(h or "")) for p, _, h in odd)


def test_warc_page_ids_of_any_text(spark, tmp_path):
    ids = ["d\n1", " b ", "b", "tab\there", "50%", "%20", "%2520", "cr\r\n\r\nWARC/1.1", "", "\u00a0x\u2003", "\x0b\x85", "e: f", "\U0001F600"]
    pages = spark.createDataFrame([(i, f"http://h.example/{k % 3}", "same" if k < 4 else f"own {k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc_index.archive_and_read(pages).collect()}
    first = min(ids[:4], key=lambda s: s.encode())
    assert got == {i: ("response", None) if k >= 4 or i == first else ("revisit", first) for k, i in enumerate(ids)}
    warc_index.write_archives(pages, f"{tmp_path}/a")
    warc_index.build_index(spark, f"{tmp_path}/a", f"{tmp_path}/i")
    assert sorted(r.page_id for r in warc_index.lookup(spark, f"{tmp_path}/i", pages).collect()) == sorted(ids)


def test_warc_lookup(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    warc_index.write_archives(_pages(spark), f"{path}/warc", min_bytes=5, records_per_file=2)
    warc_index.build_index(spark, f"{path}/warc", f"{path}/index", block_lines=2)
    wanted = spark.createDataFrame([("http://b.example.com/y",), ("https://A.example.org",), ("http://none.example",), (None,)], "url string")
    found = warc_index.lookup(spark, f"{path}/index", wanted)
    assert Counter(r.page_id for r in found.collect()) == Counter({"9": 1, "12": 2, "2": 1, "11": 1})
    read = {r.page_id: r for r in warc_index.fetch(found, with_payload=True).collect()}
    assert read["2"].payload == b"<p>one</p>" and read["11"].payload.decode().endswith("é漢") and read["9"].record_type == "response"
    monkeypatch.setattr(warc_index, "PAGE_BLOCKS", 1)
    monkeypatch.setattr(warc_index, "reads_ranges", lambda path: False)  # a scheme that only Spark knows
    warc_index.build_index(spark, f"{path}/warc", f"{path}/index2", block_lines=1)
    assert spark.read.parquet(f"{path}/index2/root").count() > 1
    again = warc_index.lookup(spark, f"{path}/index2", wanted.unionByName(spark.createDataFrame([("http://a.example.org/ \n",)], "url string")))
    assert Counter(r.page_id for r in again.collect()) == Counter(r.page_id for r in found.collect())
    assert {r.page_id: r.payload for r in warc_index.fetch(again, with_payload=True).collect()} == {i: r.payload for i, r in read.items()}
    for file in tmp_path.glob("warc/*.txt"):
        for offset, length, fields in warc_index.scan_archive(str(file)):
            data = file.read_bytes()[offset : offset + length]
            assert data.startswith(b"WARC/1.1\r\n") and fields["warc-type"] in ("response", "revisit")


# -- 10 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, none, k):
    got = minhash.near_duplicates(docs, k=k)
    assert rows(got, "doc_id", "n_shingles", "component_id") == Counter(brute.near_duplicates(brute.DOCS, k))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got.collect() if not (r.doc_id is None and r.component_id is not None))
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicate_chains(spark):
    """Chains of documents of which only neighbours are similar, and groups around a threshold."""
    rng, data = np.random.default_rng(5), []
    for c in range(6):
        words = [f"c{c}w{i}" for i in range(80)]
        for step in range(12):
            data.append((c * 100 + step, " ".join(words)))
            for _ in range(2):
                words[rng.integers(80)] = f"c{c}s{step}r{rng.integers(10**6)}"
    data = [data[i] for i in rng.permutation(len(data))]
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string").repartition(4), k=4)
    assert rows(got, "doc_id", "n_shingles", "component_id") == Counter(brute.near_duplicates(data, 4))


def test_pruning_table():
    least = minhash.least_matches(0.8, 1e-6)
    assert len(least) == minhash.HASHES // minhash.BATCH and all(np.diff(least) > 0) and least[-1] < 0.8 * minhash.HASHES
