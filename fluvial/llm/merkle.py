"""Merkle manifest of a dataset: digests of rows, a tree for each group of rows, a tree over the groups, and proofs.

A leaf is the digest of a row's fields. Leaves of a group are numbered by key, in a range-partitioned sort, so that a group may hold a third of all rows. Trees
are built by events: (group, level, index, digest) says that a node is known. A combiner, the same in every task, files each event with its parent; the
parent's arity follows from the group's size, and when as many children as that are there, the parent's digest is a new event. What is left at a task's end, the
frontier of parents whose children lie in several tasks, is dealt out anew by ancestors SPAN levels higher in each round, so no task ever gets more than a subtree of
that height from one group, whatever the group's size, and a round settles SPAN levels. Since tasks read ranges of the order, nearly all parents are settled where their leaves lie.

Each settled node is written with its children's digests: the reverse links. Paths run along them from the roots down: a node's path is its own siblings, left and right
of it, before its parent's path. A proof is a row's path; folding a digest along it gives a root. Every join has a bounded number of rows for each key: at most `arity` children
for each parent.

Null fields: as "-". Empty and very long texts are hashed whole. Null group: a group of its own, before all others; null keys come first. Repeated rows are leaves each; of rows with
one key, the smaller leaf comes first. No rows: no leaves, no root, an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.common import materialize, numbered

ARITY = 16
#: Levels that a round of the reshuffle settles: a task gets at most ARITY ** SPAN events of a subtree.
SPAN = 3

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """"-" for null, else the number of UTF-8 bytes, ":" and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def row_digest(fields: Sequence[Column]) -> Column:
    return digest(*map(field, fields))


# -- trees -------------------------------------------------------------------------------------------------------------

EVENT = pa.schema([("tree", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.string())])
#: settled: children is set; waiting (an event of the frontier): children is null.
NODE = pa.schema([*EVENT, ("children", pa.list_(pa.string()))])
DDL = "tree bigint, size bigint, level int, at bigint, digest string"


class Combiner:
    """Parents by (tree, level, index), each with the children that are known so far."""

    def __init__(self, arity: int):
        self.arity = arity
        self.open: dict[tuple[int, int, int], dict[int, str]] = {}
        self.sizes: dict[int, int] = {}
        self.settled: list[tuple] = []

    def width(self, size: int, level: int) -> int:
        """Nodes of a level of a tree with so many leaves."""
        for _ in range(level):
            size = -(-size // self.arity)
        return size

    def add(self, tree: int, size: int, level: int, at: int, value: str) -> None:
        self.sizes[tree] = size
        width = self.width(size, level)
        while width > 1:
            up = at // self.arity
            children = self.open.setdefault((tree, level + 1, up), {})
            children[at] = value
            if len(children) < min(self.arity, width - up * self.arity):
                return
            del self.open[tree, level + 1, up]
            digests = [children[k] for k in sorted(children)]
            value = hashlib.sha256("".join(digests).encode()).hexdigest()
            level, at, width = level + 1, up, -(-width // self.arity)
            self.settled.append((tree, size, level, at, value, digests))

    def drain(self) -> pa.RecordBatch:
        rows, self.settled = self.settled, []
        return self._batch(rows)

    def frontier(self) -> pa.RecordBatch:
        return self._batch([(t, self.sizes[t], level - 1, at, value, None) for (t, level, _), children in self.open.items() for at, value in sorted(children.items())])

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * len(NODE)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, NODE)], schema=NODE)


def combine(events: DataFrame, arity: int) -> DataFrame:
    """Nodes that the events of each task settle, and the events that still wait."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Combiner(arity)
        for batch in batches:
            for event in zip(*(col.to_pylist() for col in batch.columns)):
                c.add(*event)
            yield c.drain()
        yield c.frontier()

    return events.select("tree", "size", "level", "at", "digest").mapInArrow(run, f"{DDL}, children array<string>")


def build(leaves: DataFrame, arity: int = ARITY, span: int = SPAN) -> DataFrame:
    """All inner nodes of the trees whose leaves (tree, size, at, digest) are given: tree, size, level, at, digest, children. size: leaves of the
    tree; at: a node's index in its level."""
    step = materialize(combine(leaves.withColumn("level", F.lit(0)), arity), "merkle-nodes")
    nodes, top = step.where("children IS NOT NULL"), 0
    while True:
        frontier = step.where("children IS NULL")
        if frontier.isEmpty():
            return nodes
        top += span
        # the ancestor at the level `top`, or the parent if that is higher
        up = F.greatest(F.lit(top) - F.col("level"), F.lit(1))
        ancestor = F.col("at") / F.pow(F.lit(float(arity)), up)
        keys = [F.col("tree"), F.floor(ancestor).alias("ancestor"), F.greatest(F.lit(top), F.col("level") + 1)]
        step = materialize(combine(frontier.repartition(*keys), arity), "merkle-nodes")
        nodes = nodes.unionByName(step.where("children IS NOT NULL"))


def paths(nodes: DataFrame, above: DataFrame, arity: int = ARITY) -> DataFrame:
    """tree, at, children, path of each lowest inner node: the path of its children above their own siblings.

    above: tree, path, the path above each tree's root. Links are followed from the roots down, one join for each level.
    """
    nodes = materialize(nodes.select("tree", "size", "level", "at", "children"), "merkle-links")
    height = nodes.agg(F.max("level")).first()[0] or 0
    own = nodes.join(F.broadcast(above) if _few(above) else above, "tree")
    # a root has no sibling; its path is that above its tree
    is_root = F.col("size") <= F.pow(F.lit(float(arity)), F.col("level"))
    known = own.where(is_root).select("tree", "level", "at", "children", "path")
    lowest = [known.where("level = 1")]
    for level in range(height, 1, -1):
        parents = known.where(F.col("level") == level)
        down = parents.select("tree", F.posexplode("children").alias("k", "own"), F.col("at").alias("up"), "children", "path")
        down = down.select("tree", (F.col("up") * arity + F.col("k")).alias("at"), F.concat(F.array(siblings("children", F.col("k"))), F.col("path")).alias("path"))
        below = nodes.where(F.col("level") == level - 1).select("tree", "level", "at", "children")
        step = below.join(down, ["tree", "at"]).select("tree", "level", "at", "children", "path")
        if level - 1 > 1:
            step = materialize(step, "merkle-paths")
            known = step.unionByName(own.where(is_root & (F.col("level") == level - 1)).select(*step.columns))
        else:
            lowest.append(step)
    out = lowest[0]
    for more in lowest[1:]:
        out = out.unionByName(more)
    return out.drop("level")


def _few(df: DataFrame) -> bool:
    from fluvial.common import small_enough

    return small_enough(df, 8192)


def siblings(children: str, k: Column) -> Column:
    """(left, right): the other children before and after the k-th, concatenated."""
    n = F.size(children)
    left = F.array_join(F.slice(children, F.lit(1), k), "")
    right = F.array_join(F.slice(children, k + 2, F.greatest(n - k - 1, F.lit(0))), "")
    return F.struct(left.alias("l"), right.alias("r"))


@dataclass
class Manifest:
    """leaves: the rows given, with leaf, group, tree, size, at; groups: tree, group, size, subroot, place; group_nodes, top_nodes: inner nodes; root: the root (None
    without rows)."""

    leaves: DataFrame
    groups: DataFrame
    group_nodes: DataFrame
    top_nodes: DataFrame
    root: str | None
    arity: int


def build_manifest(rows: DataFrame, group: str, key: str, leaf: str = "leaf", arity: int = ARITY) -> Manifest:
    """The trees of rows, which have columns of the names given; further ones pass through. leaf: a row's digest."""
    order = [F.asc_nulls_first(group), F.asc_nulls_first(key), leaf]
    placed = numbered(rows, order, "at", group)
    # a tree's number is its group's place
    trees = materialize(placed.groupBy(F.col(group).alias("_group")).agg(F.max("at_of").alias("size")), "merkle-trees")
    trees = numbered(trees, [F.asc_nulls_first("_group")], "tree")
    from fluvial.common import checked_join

    leaves = checked_join(placed, trees.select("_group", "tree"), F.col(group).eqNullSafe(F.col("_group")), "inner", row_bytes=128)
    leaves = materialize(leaves.select(*rows.columns, "tree", F.col("at_of").alias("size"), "at"), "merkle-leaves")
    nodes = build(leaves.select("tree", "size", "at", F.col(leaf).alias("digest")), arity)
    tops = nodes.where(F.col("size") <= F.pow(F.lit(float(arity)), F.col("level"))).select("tree", F.col("digest").alias("subroot"))
    single = leaves.where("size = 1").select("tree", F.col(leaf).alias("subroot"))
    groups = materialize(trees.join(tops.unionByName(single), "tree"), "merkle-groups")
    n = groups.count()
    top = build(groups.select(F.lit(0).cast("bigint").alias("tree"), F.lit(n).cast("bigint").alias("size"), F.col("tree").alias("at"), F.col("subroot").alias("digest")), arity)
    root = None
    if n == 1:
        root = groups.first().subroot
    elif n > 1:
        root = top.where(F.col("size") <= F.pow(F.lit(float(arity)), F.col("level"))).first().digest
    return Manifest(leaves, groups, nodes, top, root, arity)


PATH = "array<struct<l:string,r:string>>"


def proofs(m: Manifest) -> DataFrame:
    """The manifest's leaves with subroot and path: an array of (left, right) siblings, from the leaf up to the root."""
    none = F.array().cast(PATH)
    one = m.top_nodes.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("tree"), none.alias("path"))
    spread = paths(m.top_nodes, one, m.arity).select(F.posexplode("children").alias("k", "own"), "at", "children", "path")
    spread = spread.select((F.col("at") * m.arity + F.col("k")).alias("tree"), F.concat(F.array(siblings("children", F.col("k"))), F.col("path")).alias("path"))
    above = materialize(m.groups.join(spread, "tree", "left").select("tree", "subroot", F.coalesce("path", none).alias("path")), "merkle-above")
    runs = materialize(paths(m.group_nodes, above.drop("subroot"), m.arity), "merkle-runs")
    many = m.leaves.where("size > 1").withColumn("_run", F.floor(F.col("at") / m.arity))
    runs = runs.select("tree", F.col("at").alias("_run"), "children", "path")
    joined = many.join(runs, ["tree", "_run"]).withColumn("path", F.concat(F.array(siblings("children", (F.col("at") % m.arity).cast("int"))), F.col("path")))
    subroots = above.select("tree", "subroot")
    joined = joined.select(*m.leaves.columns, "path").join(F.broadcast(subroots) if _few(subroots) else subroots, "tree")
    alone = m.leaves.where("size = 1").join(above, "tree")
    columns = [*m.leaves.columns, "subroot", "path"]
    return joined.select(*columns).unionByName(alone.select(*columns))


def proof_digest(path: str) -> Column:
    """The digest of all siblings of a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def fold(leaf: Column, path: str) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["l"], d, s["r"]), 256))


def manifest_documents(docs: DataFrame, arity: int = ARITY, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs, a table of documents.

    tampered: the text as an attacker leaves it, for a check of the proofs; the rows' own without it. folded_root is what that text's leaf and
    the true siblings give; verified tells whether it is the root.
    """
    f = {c: F.col(c) for c in FIELDS}
    given = row_digest([f[c] for c in FIELDS])
    other = given if tampered is None else row_digest([tampered if c == "text" else f[c] for c in FIELDS])
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), given.alias("leaf"), F.nullif(other, given).alias("other"))
    m = build_manifest(rows, "source", "doc_id", arity=arity)
    done = proofs(m).select("doc_id", "source", "leaf", "subroot", F.lit(m.root).alias("root"), proof_digest("path").alias("proof_sha256"), fold(F.coalesce("other", "leaf"), "path").alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
