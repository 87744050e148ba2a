"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

1. Each document becomes its set of distinct word shingles (64-bit hashes), a 128-bit key of that set and a signature of
   BANDS * ROWS minimum hashes. Documents with equal keys form a class; from here on only classes count.
2. Classes that agree in all rows of a band share a bucket. In a bucket every class is compared with one leader, never with
   all others.
3. A comparison reads the two signatures in batches of BATCH hashes; as soon as the posterior probability that the
   similarity reaches the threshold is below `miss`, the pair is pruned. Survivors are verified on their full sets.
4. Links merge into components by alternating large-star and small-star steps, each written to the shared folder.
5. A bucket whose classes then lie in different components still may hold links between them. The classes of all such
   buckets are cut down by an exact prefix filter: two sets can only be similar if they share one of their rarest shingles,
   a fifth of each. So classes that share a bucket but only a common passage don't meet. Of the classes that share a rare
   shingle, those outside the component that most of them belong to, the askers, meet the others and one another in cells,
   blocks of bounded size that are dealt out one by one. In a cell signatures are compared as in step 3, and survivors are
   verified on their full sets until an asker has one link with a component. No pairs become rows, and no link between
   components stays untested, but for the chance `miss` of a pruned pair.

A pair of similarity s is missed by the bands with probability (1 - s ** ROWS) ** BANDS: at 0.8 that is 3e-6.

Where a few buckets, components or classes hold most rows, the tables they are joined with are written before, so that
both sides of each join are exchanged and the adaptive skew join can split them.

Null, empty or blank texts have no set and are linked with nothing. Fewer words than a shingle: the whole sequence is the
only shingle. Repeated rows fall into one class. Rows without doc_id: their component is that of their class, null if
nobody in it has an id. Other columns are ignored, whatever their names. No documents: an empty result. Very long texts are
read whole, in memory linear in the text. doc_id may have any type with an order, also a struct.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.common import materialize, small_batches, small_enough
from fluvial.operators.network import components

BANDS, ROWS, BATCH = 24, 4, 16
HASHES = BANDS * ROWS
CHUNK = 1 << 18  # shingles hashed together

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles of a text. Words: runs other than space and \\x09-\\x0D; A-Z lowered."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = _mix(out * _STEP + h[j : j + n])
    return np.unique(out)


_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of HASHES minima for each non-empty set."""
    out = np.empty((len(sets), HASHES), np.uint32)
    k = 0
    while k < len(sets):
        end, n = k + 1, len(sets[k])
        while end < len(sets) and n + len(sets[end]) <= CHUNK:
            n += len(sets[end])
            end += 1
        x = (np.concatenate(sets[k:end]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0, *map(len, sets[k : end - 1])])
        for j in range(HASHES):
            out[k:end, j] = np.minimum.reduceat(x * _A[j] + _B[j], at)
        k = end
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row; the band's number is part of it."""
    s = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2])
    for j in range(ROWS):
        out = _mix(out * _STEP + s[:, :, j])
    return out.view(np.int64)


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """For each number of batches read, how many equal hashes a pair must have to go on.

    With a uniform prior, m equal hashes of n give the similarity a Beta(m + 1, n - m + 1) posterior; a pair goes on while
    its mass from threshold upwards is at least miss.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    least = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(log - log.max())
            if mass[grid >= threshold].sum() >= miss * mass.sum():
                break
        least.append(m)
    return np.array(least)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, key, sig for each document; key and sig are null without words."""
    small_batches(docs.sparkSession)
    d = docs.select("doc_id", "text")

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), k) for t in batch.column(1)]
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full))
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sigs = [next(sig).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "key", "sig"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, key binary, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            bands = band_keys(sig)
            yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(len(sig)), BANDS)))], ["band", "key"])

    return classes.select("key", "sig").mapInArrow(run, "band bigint, key binary")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """key, members (the sorted hashes) of the wanted classes (doc_id, key), computed anew from one text of each."""
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    ids = F.broadcast(ids) if small_enough(ids, 32) else ids
    d = docs.select("doc_id", "text").where("text IS NOT NULL").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches):
        for batch in batches:
            sets = [s for s in (shingle_set(t.as_py(), k) for t in batch.column(1)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "members"])

    return d.mapInArrow(run, "key binary, members binary")


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) whose similarity is at least percent / 100."""
    least = least_matches(percent / 100, miss)

    def prune(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in (2, 3))
            na, nb = (batch.column(c).to_numpy() for c in (4, 5))
            left = np.flatnonzero(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            equal = np.zeros(len(x), np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                equal[left] += (x[left, part] == y[left, part]).sum(1)
                left = left[equal[left] >= m]
            yield batch.select([0, 1]).take(pa.array(left))

    def confirm(batches):
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    of = lambda df, side, *cols: df.select(F.col("key").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols])
    near = pairs.join(of(classes, "a", "sig", "n_shingles"), "a").join(of(classes, "b", "sig", "n_shingles"), "b")
    near = near.select("a", "b", "sig_a", "sig_b", "n_shingles_a", "n_shingles_b").mapInArrow(prune, "a binary, b binary")
    near = materialize(near, "minhash-survivors")
    full = near.join(of(sets, "a", "members"), "a").join(of(sets, "b", "members"), "b").select("a", "b", "members_a", "members_b")
    return full.mapInArrow(confirm, "a binary, b binary")


def _compare(percent: int, miss: float):
    """For the rows of a cell: the links of askers with classes of other components, one for each such component."""
    least = least_matches(percent / 100, miss)

    def run(cell: pa.Table) -> pa.Table:
        keys, label = cell.column("key").to_pylist(), np.unique(cell.column("label").to_pylist(), return_inverse=True)[1]
        sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in cell.column("members")]
        sig = np.frombuffer(b"".join(cell.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        size, block = np.array([len(x) for x in sets]), cell.column("block").to_numpy()
        at = cell.column("cell")[0].as_py()
        ask = np.array(cell.column("ask").to_pylist(), bool)
        left, right = (np.flatnonzero(~ask), np.flatnonzero(ask)) if at["kind"] == "main" else (np.flatnonzero(block == at["i"]), np.flatnonzero(block == at["j"]))
        small, large = np.minimum(size[left][:, None], size[right][None]), np.maximum(size[left][:, None], size[right][None])
        alive = (label[left][:, None] != label[right][None]) & (100 * small >= percent * large)
        if at["kind"] == "ask" and at["i"] == at["j"]:
            alive = np.triu(alive, 1)
        i, j = np.nonzero(alive)
        equal = np.zeros(len(i), np.int64)
        for k, most in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            equal += (sig[left[i], part] == sig[right[j], part]).sum(1)
            on = equal >= most
            i, j, equal = i[on], j[on], equal[on]
        links, known = [], set()
        for k in np.argsort(-equal, kind="stable").tolist():  # the likeliest first; one link of an asker with a component is enough
            x, y = left[i[k]], right[j[k]]
            if (label[x], y) not in known:
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (size[x] + size[y] - both):
                    known.add((label[x], y))
                    links.append((keys[x], keys[y]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    return run


#: Shingles and rows in a block of a cell; rows in one of a group of more than MANY.
BLOCK_SHINGLES, BLOCK_ROWS, MANY_ROWS, MANY = 1 << 17, 64, 512, 1 << 14
#: Slots of the table of shingle frequencies. Any table gives an exact prefix filter; a larger one a sharper one.
SLOTS = 1 << 20


def shingle_frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets (members) fall into each of SLOTS slots."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for m in batch.column(0):
                np.add.at(total, _slots(np.frombuffer(m.as_buffer(), np.uint64)), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["slot", "n"])

    rows = sets.select("members").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def _slots(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def prefix(x: np.ndarray, frequency: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, so many that a set that shares none of them with its own such ones isn't similar.

    Sets whose intersection is at least percent % of either share one of their len - ceil(percent % of len) + 1 first
    shingles in any order that all sets agree on; here it is that of (frequency of the slot, hash).
    """
    n = len(x) + 1 + (-percent * len(x)) // 100
    return x[np.lexsort((x, frequency[_slots(x)]))[:n]]


def _between_components(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) between classes that share a bucket and lie in different components."""
    spark = members.sparkSession
    named = members.select("band", "key").join(labels.withColumnRenamed("node", "key"), "key", "left")
    named = materialize(named.select("band", "key", F.coalesce("label", "key").alias("label")), "minhash-named")
    spans = named.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    spans = materialize(spans.where("least <> most").select("band"), "minhash-open")
    rows = named.join(spans, "band").select("key", "label").distinct()
    rows = materialize(rows.join(sets, "key").join(classes.select("key", "sig"), "key"), "minhash-askers")

    frequency = spark.sparkContext.broadcast(shingle_frequencies(rows))  # SLOTS numbers

    def prefixes(batches):
        for batch in batches:
            found = [prefix(np.frombuffer(m.as_buffer(), np.uint64), frequency.value, percent) for m in batch.column(2)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], ["token", "key", "label"])

    tokens = materialize(rows.select("key", "label", "members").mapInArrow(prefixes, "token bigint, key binary, label binary"), "minhash-prefixes")
    of_label = tokens.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    split = of_label.groupBy("token").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("most"))
    split = materialize(split.where("labels > 1").select("token", F.col("most.label").alias("group")), "minhash-tokens")
    met = materialize(tokens.join(split, "token").select("group", "key", "label").distinct(), "minhash-meetings")
    met = met.withColumn("ask", F.col("label") != F.col("group"))
    w = F.octet_length("members") / 8
    of = lambda ask, x: F.coalesce(F.sum(F.when(F.col("ask") == ask, x)), F.lit(0))
    sizes = met.join(rows.select("key", w.alias("w")), "key").groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[of(a, x).alias(f"{name}_{a}") for a in (False, True) for name, x in (("w", F.col("w")), ("n", F.lit(1)))])
    room = F.when(F.col("n") > MANY, MANY_ROWS).otherwise(BLOCK_ROWS)
    blocks = lambda a: F.greatest(F.ceil(F.col(f"w_{a}") / BLOCK_SHINGLES), F.ceil(F.col(f"n_{a}") / room), F.lit(1)).cast("int")
    sizes = sizes.withColumns({"mains": blocks(False), "asks": blocks(True)})
    sizes = materialize(sizes.select("group", "mains", "asks", (F.col("w_False") * F.col("asks") + F.col("w_True") * (F.col("mains") + F.col("asks"))).alias("work")), "minhash-groups")
    parts = max(1, math.ceil((sizes.agg(F.sum("work")).first()[0] or 0) / (4 * BLOCK_SHINGLES)))
    met = met.join(sizes.drop("work"), "group")
    met = met.withColumn("block", F.pmod(F.xxhash64("key"), F.when(F.col("ask"), F.col("asks")).otherwise(F.col("mains"))).cast("int"))
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    block = F.col("block")
    asked = F.concat(each("mains", lambda i: cell("main", i, block)), each("asks", lambda j: cell("ask", F.least(block, j), F.greatest(block, j))))
    cells = met.select("group", "key", "label", "ask", "block", F.when(F.col("ask"), asked).otherwise(each("asks", lambda j: cell("main", block, j))).alias("cells"))
    cells = cells.join(rows.drop("label"), "key").withColumn("cell", F.explode("cells")).drop("cells")
    # dealt by cell, not by group: a group's cells go to many tasks
    return cells.repartition(parts, "group", "cell").groupBy("group", "cell").applyInArrow(_compare(percent, miss), "a binary, b binary")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (it is the smallest)."""
    described = materialize(describe(docs, k), "minhash-docs")
    classes = described.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = materialize(classes, "minhash-classes")
    buckets = _bands(classes).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lead"))
    buckets = materialize(buckets.where("n > 1"), "minhash-buckets")
    members = materialize(_bands(classes).join(buckets.select("band", "lead"), "band"), "minhash-members")
    candidates = members.select("key").distinct()
    wanted = classes.select("doc_id", "key").join(F.broadcast(candidates) if small_enough(candidates, 64) else candidates, "key", "left_semi")
    sets = materialize(_sets(docs, wanted, k).dropDuplicates(["key"]), "minhash-sets")

    pairs = members.where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct()
    links = materialize(_verified(pairs, classes, sets, percent, miss), "minhash-links")
    star = lambda e: components(e.select(F.col("a").alias("src"), F.col("b").alias("dst")), "minhash-components")
    labels = star(links)
    further = materialize(_between_components(members, labels, classes, sets, percent, miss), "minhash-links")
    if not further.isEmpty():
        labels = star(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(further))

    named = classes.select("key", "n", "doc_id").join(labels.withColumnRenamed("node", "key"), "key", "left").where("n > 1 OR label IS NOT NULL OR doc_id IS NULL")
    roots = labels.select(F.col("label").alias("key")).distinct().join(classes.select("key", "n", "doc_id"), "key").withColumn("label", F.col("key"))
    named = materialize(named.unionByName(roots.select(*named.columns)).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")).withColumn("label", F.coalesce("label", "key")), "minhash-named")
    least = materialize(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "minhash-least")
    found = materialize(named.select("key", "label").join(least, "label").select("key", "component_id"), "minhash-found")
    out = described.select("doc_id", "n_shingles", "key").join(found, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
