"""License scans, importance resampling and Merkle manifests against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluvial.common import numbered
from fluvial.llm import license_scan, merkle, queries, resample
from tests.conftest import SF
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return brute.documents(spark, [])


def words(text):
    return brute.ITEM_WORD.findall(brute.lower(text))


# -- 11: license scans -------------------------------------------------------------------------------------------------

PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def base_places(text):
    w = words(text)
    return sorted((i, label) for label, phrase in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase)] == phrase)


def plain_scan(rules, text):
    """Labels without gate, automaton or sweep: every rule on the text, suppression pair by pair."""
    plain = " " + " ".join(words(text)) + " "
    alike = plain.replace("licence", "license")
    found = []
    for k, r in enumerate(rules):
        over = plain if r.section == "base" else alike
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", over):
            if m.end() > m.start() and all(x in alike for x in r.keywords):
                found.append((r.priority, k, over[: m.start()].count(" ") - 1, over[: m.end()].rstrip(" ").count(" ")))
    kept = [d for d in found if rules[d[1]].section == "base"]
    rest = sorted((d for d in found if rules[d[1]].section != "base"), key=lambda d: (-d[0], d[2], -d[3], d[1]))
    stay = []
    for d in rest:
        if any(e[0] > d[0] and e[2] < d[3] and d[2] < e[3] or e[0] == d[0] and e[2] <= d[2] and d[3] <= e[3] for e in stay):
            continue
        stay.append(d)
    return sorted((k, a, b) for _, k, a, b in kept + stay)


def test_scan_documents(docs, none):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels)) for r in license_scan.scan(docs).collect())
    want = Counter()
    for doc_id, text, *_ in brute.DOCS:
        at = base_places(text)
        want[doc_id, len(words(text)), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), tuple(sorted({x for _, x in at}))] += 1
    assert got == want
    assert license_scan.scan(none).count() == 0


NOTICES = {
    "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc-4.0"},
    "Released under the MIT Licence.": {"mit"},
    "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
    "This work is licensed under the GNU General Public License, version 3.": {"gpl", "gpl-3.0"},
    "the GNU General Public Licence, version 2 or any later version": {"gpl-2.0-or-later"},
    "# SPDX-License-Identifier: LGPL-2.1-or-later": {"spdx-lgpl"},
    "Alle Rechte vorbehalten. Tous droits réservés": {"reserved"},
    "Creative Commons Attribution Non-Commercial ShareAlike 4.0": {"cc-by-nc-sa-4.0"},
    "mit der Lizenz, by cc, general license, rights all reserved": set(),
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": {"mpl-2.0"},
}


def test_scan_notices():
    s = license_scan.Scanner()
    assert len(s.rules) > 300
    for text, want in NOTICES.items():
        kept = s.resolve(s.detections(license_scan.words_of(text)))
        assert {s.rules[k].label for k, *_ in kept} == want, text
        for (_, a, b), (start, end) in zip(kept, license_scan.places(text, kept)):
            assert words(text[start:end]) == words(text)[a:b]
        assert (s.score(kept) > 0) == bool(want) and s.score(kept) <= 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*NOTICES, "CC", "by", "4.0", "GNU", "General Public License", "v2", "or later", "All rights reserved", "né", ";", "Copyright 2020", "MIT license", "cc by sa 3.0"]), max_size=12))
def test_scan_any_order(scanner_of, parts):
    text = " ".join(parts)
    s = scanner_of
    assert sorted(s.resolve(s.detections(license_scan.words_of(text)))) == plain_scan(s.rules, text)


@pytest.fixture(scope="module")
def scanner_of():
    return license_scan.Scanner()


def test_scan_long_and_hostile(scanner_of):
    for text in ("license " * 100_000, "cc by " * 100_000, "gnu general public license version 2 or " * 20_000, "no text " * 50_000 + "ai training"):
        w = license_scan.words_of(text)
        kept = scanner_of.resolve(scanner_of.detections(w))
        assert all(0 <= a < b <= len(w) for _, a, b in kept)
    kept = scanner_of.detections(license_scan.words_of("cc by " * 100_000))
    assert sum(k in scanner_of.base for k, *_ in kept) == 100_000


def test_scan_query(spark):
    got = {r.doc_id: r for r in queries.op11_licenses(spark, SF).collect()}
    rules = license_scan.parse_rules()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        at = base_places(r.text)
        found, g = plain_scan(rules, r.text), got.pop(r.doc_id)
        assert (g.n_words, g.n_base, g.base_labels) == (len(words(r.text)), len(at), ",".join(sorted({x for _, x in at})))
        assert g.labels == ",".join(sorted({rules[k].label for k, *_ in found})) and (g.score > 0) == bool(found)
    assert not got


# -- 12: resampling ----------------------------------------------------------------------------------------------------


def features(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_resample(docs, target, percent=25, least=20, seed=7, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode("utf-8")) % buckets
    s, t = Counter(bucket(f) for d in docs for f in features(d[1])), Counter(bucket(f) for x in target for f in features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for d in docs:
        f = features(d[1])
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        rows.append([d[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(d[1]))])
    pool = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(pool[: percent * len(pool) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


TARGET = ["word1 word2 word3 word4", "the quick brown fox", None, "", "née 漢字"]


@pytest.mark.parametrize("percent,least,buckets", [(25, 20, 10_000), (100, 0, 7), (50, 10, 100_000), (0, 5, 64)])
def test_resample_documents(spark, docs, none, percent, least, buckets):
    target = spark.createDataFrame([(x, 1) for x in TARGET], "text string, doc_id int")
    got = resample.resample(docs, target, percent, least, buckets=buckets)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain_resample(brute.DOCS, TARGET, percent, least, buckets=buckets)
    assert resample.resample(none, target).count() == 0
    assert Counter(r.weight for r in resample.resample(docs, target.limit(0), percent, least, buckets=buckets).collect()) == Counter(r[2] for r in plain_resample(brute.DOCS, [], percent, least, buckets=buckets).elements())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z0é漢.\n"), max_size=30), max_size=6))
def test_bucket_counts_any(texts):
    n, indptr, indices, counts = resample.bucket_counts(texts, 97)
    for k, text in enumerate(texts):
        want = Counter(zlib.crc32(f.encode()) % 97 for f in features(text))
        row = slice(indptr[k], indptr[k + 1])
        assert dict(zip(indices[row].tolist(), counts[row].tolist())) == want and n[k] == len(words(text))


def test_resample_prefers_the_target(spark):
    rng = random.Random(1)
    like = lambda head: " ".join(f"{head}{rng.randrange(50)}" for _ in range(40))
    d = spark.createDataFrame([(i, like("good" if i % 2 else "bad")) for i in range(400)], "doc_id int, text string")
    drawn = resample.resample(d, spark.createDataFrame([(like("good"),) for _ in range(50)], "text string")).where("rank IS NOT NULL")
    assert drawn.count() == 100 and drawn.where("doc_id % 2 = 1").count() > 75  # half of them without weights


# -- 13: Merkle manifest -----------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, arity):
    """The root, and for each leaf its (left, right) siblings from below."""
    paths, level, place = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, at in enumerate(place):
            first = at // arity * arity
            run = level[first : first + arity]
            paths[k].append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
            place[k] = at // arity
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0] if level else None, paths


def plain_manifest(rows, arity=16):
    """rows: (doc_id, source, lang, n_chars, text) -> Counter of the query's rows."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for s in order:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, h(*map(enc, r))))
        built.append((mine, *plain_tree([h(*map(enc, r)) for r in mine], arity)))
    root, tops = plain_tree([b[1] for b in built], arity)
    out = Counter()
    for (mine, subroot, paths), above in zip(built, tops):
        for r, path in zip(mine, paths):
            leaf, path = h(*map(enc, r)), path + above
            chosen = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0
            d = h(*map(enc, (*r[:4], brute.lower(r[4]) if chosen and r[4] is not None else r[4])))
            for lo, hi in path:
                d = h(lo, d, hi)
            out[r[0], leaf, subroot, root, h(*(x for p in path for x in p)), d, d == root] += 1
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest_rows(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def lowered():
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return F.when(chosen, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))


def test_manifest_of_small_tables(docs, none):
    full = docs.withColumn("n_chars", F.length("text")).withColumns({c: F.lit(2) for c in ("tree", "at", "size", "children", "path", "leaf", "root")})
    rows = [(d[0], d[3], d[2], None if d[1] is None else len(d[1]), d[1]) for d in brute.DOCS]
    assert manifest_rows(merkle.manifest_documents(full, tampered=lowered())) == plain_manifest(rows)
    assert merkle.manifest_documents(none.withColumn("n_chars", F.length("text"))).count() == 0
    one = full.where("doc_id = 20")
    assert manifest_rows(merkle.manifest_documents(one, tampered=lowered())) == plain_manifest([r for r in rows if r[0] == 20])


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_manifest_of_uneven_groups(spark, monkeypatch, arity):
    """A hot group over many tasks, groups of one, and as many groups as make a tree of several levels."""
    sizes = {"hot": 700, "b": 17, "c": 16, **{f"s{i}": 1 + i % 3 for i in range(40)}}
    rows = [(i, s, None, 3, f"Text {s} {i}") for s, n in sizes.items() for i in range(n)]
    random.Random(2).shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    done = merkle.manifest_documents(d, arity, tampered=lowered())
    assert manifest_rows(done) == plain_manifest(rows, arity)
    assert done.where("verified").count() == sum(zlib.crc32(str(r[0]).encode()) % 5 != 0 for r in rows)


def test_combiner_settles_in_any_order(spark):
    """Events dealt to tasks at random leave a frontier; rounds of one level settle it."""
    n = 300
    leaves = [h(str(i)) for i in range(n)]
    d = spark.createDataFrame([(t, n, i, x) for t in (1, 2) for i, x in enumerate(leaves)], "tree bigint, size bigint, at bigint, digest string").repartition(7)
    for span in (1, 3):
        nodes = merkle.build(d, 4, span).collect()
        assert {r.digest for r in nodes if r.level == 5} == {plain_tree(leaves, 4)[0]} and len(nodes) == 2 * (75 + 19 + 5 + 2 + 1)


def test_manifest_query_needs_no_text_order(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert manifest_rows(queries.op13_merkle(spark, SF)) == plain_manifest(rows)


# -- numbering ---------------------------------------------------------------------------------------------------------


def test_numbers_in_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(None if g == 9 else int(g), int(v)) for g, v in zip(rng.choice(10, 500, p=[0.55, *[0.05] * 9]), rng.permutation(500))]
    d = spark.createDataFrame(rows, "g int, v int").repartition(6)
    got = numbered(d, [F.asc_nulls_first("g"), "v"], "k", "g").collect()
    for g in {r[0] for r in rows}:
        mine = sorted(v for x, v in rows if x == g)
        assert sorted((r.k, r.v, r.k_of) for r in got if r.g == g) == [(k, v, len(mine)) for k, v in enumerate(mine)]
    assert sorted((r.k, r.v) for r in numbered(d, ["v"], "k").collect()) == [(k, k) for k in range(500)]
    assert numbered(d.limit(0), ["v"], "k", "g").count() == 0
