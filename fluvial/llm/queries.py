"""One query for each operator of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.common import table
from fluvial.llm import bpe, decontaminate, host_rules, html_extract, langid, license_scan, line_dedup, merkle, minhash, pii_crf, quality_lm, resample, warc_index


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    done = bpe.encode_documents(table(spark, sf_dir, "documents"), path, decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "n_chars_scored", "perplexity", "threshold", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", "text")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    done = langid.identify(docs.select("doc_id", "text"), model)
    return done.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = pii_crf.find(docs, pii_crf.train(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", *map(count, pii_crf.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = host_rules.apply_rules(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.archive_and_read(table(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = license_scan.scan(table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return done.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_features", "weight", "score", "rank")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    done = merkle.manifest_documents(table(spark, sf_dir, "documents"), tampered=F.when(chosen, F.translate("text", upper, lower)).otherwise(F.col("text")))
    return done.drop("source")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality_lm, op3_line_dedup, op4_decontaminate, op5_html, op6_langid, op7_pii, op8_host_rules, op9_warc, op10_minhash, op11_licenses, op12_resample, op13_merkle)}

ORACLE = {
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY h) AS first_id, array_to_string(list_transform(range(8), lambda i:
  array_to_string(list_transform(range(4), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * i, 5))::INT >> (15 - 5 * k)::INT) & 31)::INT, 1)), '')), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d""",
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM lines),
bad AS (SELECT k, arg_min(doc_id, doc_id * 10000000 + pos) AS first_doc, min(doc_id * 10000000 + pos) % 10000000 AS first_pos
  FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 10),
marked AS (SELECT l.*, b.k IS NOT NULL AND NOT (l.doc_id = b.first_doc AND l.pos = b.first_pos) AS gone FROM keyed l LEFT JOIN bad b ON l.k = b.k)
SELECT d.doc_id, CASE WHEN d.text = '' OR d.text IS NULL THEN 0 ELSE count(*) END AS n_lines, count(*) FILTER (WHERE m.gone) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.gone), '') END AS text
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id, d.text""",
    "op4_decontaminate": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS k, least(10, len(w)) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.i, g.n, wins.item_id FROM grams g JOIN wins ON g.k = wins.k AND g.n = wins.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, coalesce(len(w.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id LEFT JOIN items i ON w.doc_id = i.doc_id""",
    "op8_host_rules": r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
grams AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN lines ON w.doc_id = lines.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM b GROUP BY host),
prior AS (SELECT avg(f / n) AS mu, var_pop(f / n) AS v FROM hosts),
weight AS (SELECT mu, CASE WHEN mu = 0 OR mu >= 1 OR v = 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, mu * (1 - mu) / v - 1)) END AS k FROM prior),
verdict AS (SELECT host, (f + k * mu) / (n + k) > 0.5 AS host_failed FROM hosts, weight)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept FROM b JOIN verdict ON b.host = verdict.host""",
    "op12_resample": r"""
WITH crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
all_words AS (SELECT doc_id, true AS doc, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT NULL, false, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
feats AS (SELECT doc_id, doc, unnest(w) AS f FROM all_words UNION ALL SELECT doc_id, doc, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM all_words),
counted AS (SELECT doc_id, doc, f, count(*) AS n FROM feats GROUP BY doc_id, doc, f),
kinds AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
hashed AS (SELECT f, xor(list_reduce(list_transform(range(0, len(h), 2), lambda k: ('0x' || substr(h, k + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM kinds, crc_table),
cells AS (SELECT doc_id, doc, bucket, n FROM counted JOIN hashed ON counted.f = hashed.f),
totals AS (SELECT coalesce(sum(n) FILTER (WHERE doc), 0) AS s_all, coalesce(sum(n) FILTER (WHERE NOT doc), 0) AS t_all FROM cells),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE doc), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT doc), 0) AS t FROM cells GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM sums, totals),
sizes AS (SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words FROM all_words WHERE doc),
weighed AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM cells JOIN gains ON cells.bucket = gains.bucket WHERE doc GROUP BY doc_id),
noisy AS (SELECT s.doc_id, n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || s.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise FROM sizes s LEFT JOIN weighed w ON s.doc_id = w.doc_id),
ranked AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS k, (25 * count(*) OVER (PARTITION BY n_words >= 20)) // 100 AS draws FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= draws THEN k END AS rank FROM ranked""",
    "op13_merkle": r"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
tampered AS (SELECT *, CASE WHEN xor(list_reduce(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) % 5 = 0
  THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents, crc_table),
fields AS (SELECT doc_id, source, other, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front FROM tampered),
digests AS (SELECT doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(front || coalesce(strlen(other) || ':' || other, '-')) AS fake FROM fields),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM digests),
up AS (SELECT tree, 0 AS level, pos, n, leaf AS d FROM leaves UNION ALL SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 16, n),
subroots AS (SELECT tree, d AS subroot FROM up WHERE n = 1),
top AS (SELECT 0 AS level, tree AS pos, count(*) OVER () AS n, subroot AS d FROM subroots UNION ALL SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 16, n),
sub_runs AS (SELECT tree, level, pos // 16 AS run, list(d ORDER BY pos) AS c FROM up WHERE n > 1 GROUP BY tree, level, pos // 16),
top_runs AS (SELECT level, pos // 16 AS run, list(d ORDER BY pos) AS c FROM top WHERE n > 1 GROUP BY level, pos // 16),
steps AS (SELECT l.tree, l.pos, r.level AS k, array_to_string(r.c[1:(l.pos // (16 ** r.level)::BIGINT) % 16], '') AS lo, array_to_string(r.c[(l.pos // (16 ** r.level)::BIGINT) % 16 + 2:], '') AS hi
  FROM leaves l JOIN sub_runs r ON r.tree = l.tree AND r.run = l.pos // (16 ** (r.level + 1))::BIGINT
  UNION ALL SELECT l.tree, l.pos, 100 + r.level, array_to_string(r.c[1:(l.tree // (16 ** r.level)::BIGINT) % 16], ''), array_to_string(r.c[(l.tree // (16 ** r.level)::BIGINT) % 16 + 2:], '')
  FROM leaves l JOIN top_runs r ON r.run = l.tree // (16 ** (r.level + 1))::BIGINT),
proofs AS (SELECT tree, pos, sha256(string_agg(lo || hi, '' ORDER BY k)) AS proof_sha256, list({'lo': lo, 'hi': hi} ORDER BY k) AS path FROM steps GROUP BY tree, pos),
fold AS (SELECT l.doc_id, l.tree, l.pos, l.leaf, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, coalesce(p.path, []) AS path, 1 AS k, l.fake AS d FROM leaves l LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos
  UNION ALL SELECT doc_id, tree, pos, leaf, proof_sha256, path, k + 1, sha256(path[k].lo || d || path[k].hi) FROM fold WHERE k <= len(path))
SELECT f.doc_id, f.leaf, s.subroot, t.d AS root, f.proof_sha256, f.d AS folded_root, f.d = t.d AS verified
FROM fold f JOIN subroots s ON s.tree = f.tree, (SELECT d FROM top WHERE n = 1) t WHERE f.k = len(f.path) + 1""",
}
