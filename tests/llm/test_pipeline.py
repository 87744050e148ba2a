"""The pipeline against a plain version of its stages, and each query against its SQL on the smallest tables."""

import hashlib
import html
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from fluvial.llm import langid, quality_lm
from tests.conftest import SF
from tests.llm import brute


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    data = [(r.doc_id, r.text, r.lang, r.source) for r in langid.identify(docs, model).where("NOT rejected").collect()]
    before = {d[0]: d[1] for d in data}
    lines = dict(brute.line_dedup(data, 10))
    data = [(d[0], lines[d[0]], *d[2:]) for d in data if lines[d[0]].strip() or lines[d[0]] == before[d[0]]]
    keep = {i for i, _, c in brute.near_duplicates(data, 5) if i == c}
    data = [d for d in data if d[0] in keep]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, _, n, _ in brute.contamination(data, items) if n}
    want = {d[0]: d[1] for d in data if d[0] not in leaks}
    got = {r.doc_id: r.text for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and leaks and len(keep) < len(before)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, SF)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want.fetchall())


def documents(spark):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_near_duplicate_query(spark):
    got = __spark_entry__.queries()["op10_minhash"](spark, SF)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == Counter(brute.near_duplicates(documents(spark), 4))


def test_pii_query(spark):
    texts = {d[0]: d[1] for d in documents(spark)}
    for r in __spark_entry__.queries()["op7_pii"](spark, SF).collect():
        base = brute.base_spans(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) <= {*r.spans.split(","), ""}
        assert r.n_spans == len([x for x in r.spans.split(",") if x])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in ("email", "ip", "card", "phone")]


def test_quality_query(spark):
    data = documents(spark)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    held = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").where(quality_lm.held_out(F.col("text"))).collect()}
    of, _ = brute.perplexity([d[1] for d in data if d[0] in good - held])
    assert good & held
    got = {r.doc_id: r for r in __spark_entry__.queries()["op2_quality_lm"](spark, SF).collect()}
    assert len(got) == len(data) and len(good) > 20
    for doc_id, text, *_ in data:
        assert got[doc_id].perplexity == pytest.approx(of(text), rel=1e-5)
        assert got[doc_id].kept == (got[doc_id].perplexity is not None and got[doc_id].perplexity <= got[doc_id].threshold)


def test_html_query(spark):
    """These pages have an article of headings and paragraphs, and everything else outside of it."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in __spark_entry__.queries()["op5_html"](spark, SF).collect():
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("<p>|</p>|<h1>|</h1>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_bpe_query(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in __spark_entry__.queries()["op1_bpe"](spark, SF).collect()}
    for doc_id, text, *_ in documents(spark):
        ids = t.encode(text, add_special_tokens=False).ids
        r = got[doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


PASSAGE = "one passage of the benchmark that nobody may have read before today in any text"
CLASHING = ["n_words", "row", "_row", "key", "kept", "n_lines", "n_removed", "_gone", "lang_pred"]


def odd_documents(spark, rows):
    """Rows (doc_id, text, lang, source) as documents with n_chars and columns that stages use themselves."""
    df = spark.createDataFrame(rows, brute.SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(1) for c in CLASHING})


@pytest.fixture(scope="module")
def bench_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([("i1", PASSAGE), (None, "few words"), ("i2", None), ("i1", PASSAGE)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_decontamination_judges_each_row(spark, bench_dir):
    rows = [(None, f"x {PASSAGE} y", "en", "a"), (None, "a clean text", "en", "a"), (7, PASSAGE, "en", "a"), (7, "clean, though another row with its id leaks", "en", "a"), (8, None, "en", "a"), (9, "", None, None), (10, "Few, words!", "en", "a"), (11, PASSAGE.upper(), "en", "b")]
    got = corpus_pipeline.decontaminate_stage(spark, odd_documents(spark, rows), bench_dir)
    want = [r for r, (*_, n, _) in zip(rows, brute.contamination(rows, [("i1", PASSAGE), ("", "few words")])) if not n]
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in got.collect()) == Counter(want) and len(want) == 4
    assert set(CLASHING) < set(got.columns)


def test_near_dedup_keeps_one_row_of_each_group(spark, bench_dir):
    near = brute.BASE.replace("word30", "other")
    rows = [(1, brute.BASE, "en", "a"), (1, brute.BASE, "en", "b"), (None, brute.BASE, "en", "a"), (None, brute.BASE, "en", "a"), (2, near, "en", "a"), (3, brute.FAR, "en", "a"), (3, "another text with this id, which is clean and stays here", "en", "a")]
    rows += [(None, "nobody's text, twice the same, word by word", "en", "a")] * 2 + [(4, None, "en", "a"), (4, None, "en", "a"), (5, "", "en", "a"), (None, "", "en", "a"), (6, brute.LONG, "de", "a")]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.minhash_stage(spark, odd_documents(spark, rows), bench_dir).collect())
    want = Counter({(1, brute.BASE): 1, (3, brute.FAR): 1, (3, rows[6][1]): 1, (None, rows[7][1]): 1, (4, None): 2, (5, ""): 1, (None, ""): 1, (6, brute.LONG): 1})
    assert got == want


def test_stages_on_odd_and_empty_tables(spark, bench_dir):
    docs = odd_documents(spark, brute.DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, bench_dir).columns == docs.columns
        none = stage(spark, odd_documents(spark, []), bench_dir)
        assert none.columns == docs.columns and none.count() == 0
    known = Counter(t for _, t, *_ in brute.DOCS)
    for k in (0, 1, 2):
        left = Counter(r.text for r in corpus_pipeline.STAGES[k][1](spark, docs, bench_dir).collect())
        assert left and (k == 1 or not left - known)
