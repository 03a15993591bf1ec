"""A Merkle manifest of a dataset that stores few levels and recomputes the others.

Every row is a leaf: the SHA-256 of its columns, each written with its length. The leaves of
a source ascend by id. While a source has several nodes, runs of `FANOUT` consecutive
ones become the digest of their digests; what is left is the source's subroot. The subroots,
ordered by source, give the root in the same way.

`build` stores the leaves and then only every `KEPT_EVERY`-th level. `proofs` regenerates the
levels in between: the nodes of an aligned subtree, at most FANOUT ** KEPT_EVERY of them, are
brought together from their stored level, its inner nodes are computed again, every node gets
its siblings, and the inner nodes are dropped. Stored levels are joined to the one above by
subtree, one row for a subtree on either side, so no key is frequent however large a source is.

Places within a source come from a range partitioning by source and id, and from counts of
rows by partition: no source is ever sorted by one task. What is stored survives lost
executors; a lost task reads its stored level again.

A null column is written as `-`, which no value is. Rows with a null source are a source of
their own, the first; null ids come first in their source. Rows that share an id are separate
leaves, ordered by their digests, and equal rows get equal digests at neighbouring places.
Texts of any length are one hash. Without rows there is no tree: `root` is None and there are no
proofs. Other columns, whatever their names, are neither hashed nor read, unless `carried`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import placed, stored

FANOUT = 16
KEPT_EVERY = 2
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<place int, siblings array<string>>"


def joined_digest(digests: Column) -> Column:
    """SHA-256 of an array of digests, one after the other as hexadecimal text."""
    return F.sha2(F.array_join(digests, ""), 256)


def leaf_digest(columns: dict[str, Column] | None = None) -> Column:
    """The digest of a row; `columns` replaces the row's own values by name."""
    parts = []
    for name in LEAF_COLUMNS:
        value = (columns or {}).get(name, F.col(name)).cast("string")
        written = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(written, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Tree:
    """The stored levels of the trees of all groups."""

    nodes: DataFrame  # (group, place, n, digest, ...): the leaves, n of them in the group
    levels: list[DataFrame]  # (group, place, n, digest): each KEPT_EVERY levels above the one before
    tops: DataFrame  # (group, digest): what is left of each group


@dataclass
class Manifest:
    """The trees of the sources and the tree of their subroots."""

    sources: Tree
    top: Tree

    def subroots(self) -> DataFrame:
        """(source, subroot)."""
        names = self.top.nodes.select("place", "source")
        return self.sources.tops.join(names, F.col("group") == F.col("place")).select(
            "source", F.col("digest").alias("subroot")
        )

    def root(self) -> str | None:
        """The digest of the whole dataset."""
        row = self.top.tops.first()
        return row and row["digest"]


def _numbered_sources(leaves: DataFrame) -> DataFrame:
    """(source, group): the sources of the leaves by number, the null one first, then bytewise."""
    found = leaves.select("source").distinct().withColumn("group", F.lit(0).cast("long"))
    found = placed(found, [F.col("group"), F.col("source").asc_nulls_first()])
    return stored(found.select("source", F.col("place").alias("group")), "merkle-sources")


def _runs(digests: Column, fanout: int) -> Column:
    """The digests of runs of `fanout` consecutive digests."""
    starts = F.sequence(F.lit(1), F.size(digests), F.lit(fanout))
    return F.transform(starts, lambda start: joined_digest(F.slice(digests, start, fanout)))


def _subtrees(level: DataFrame, span: int, *more: str) -> DataFrame:
    """(group, block, n, nodes): the nodes of each aligned subtree in order, `span` at most."""
    block = F.floor(F.col("place") / span).cast("long").alias("block")
    entries = F.array_sort(F.collect_list(F.struct("place", "digest", *more)))
    return level.groupBy("group", block, "n").agg(entries.alias("nodes"))


def _heights(n: Column, fanout: int, levels: int) -> Column:
    """How many of the next `levels` levels a group of n nodes has: none above its last node."""
    height = F.lit(0)
    for k in range(levels):
        height = height + (n > fanout**k).cast("int")
    return height


def _climbed(subtrees: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The subtrees with `inner`, the digests level by level from their nodes to their top."""
    own = F.transform("nodes", lambda node: node.digest)
    climbed = subtrees.withColumn("inner", F.array(own)).withColumn("height", _heights(F.col("n"), fanout, levels))
    for k in range(levels):
        above = F.concat("inner", F.array(_runs(F.element_at("inner", -1), fanout)))
        climbed = climbed.withColumn("inner", F.when(F.col("height") > k, above).otherwise(F.col("inner")))
    return climbed


def _grown(leaves: DataFrame, fanout: int, levels: int) -> Tree:
    """Stores every `levels`-th level above the leaves until each group has a single node."""
    span, level, kept, tops = fanout**levels, leaves, [], []
    while True:
        above = _climbed(_subtrees(level, span), fanout, levels)
        above = stored(
            above.select(
                "group",
                F.col("block").alias("place"),
                F.ceil(F.col("n") / span).cast("long").alias("n"),
                F.element_at(F.element_at("inner", -1), 1).alias("digest"),
            ),
            "merkle-level",
        )
        tops.append(above.where("n = 1").select("group", "digest"))
        level = above.where("n > 1")
        if level.isEmpty():
            break
        kept.append(level)
    done = tops[0]
    for more in tops[1:]:
        done = done.unionByName(more)
    return Tree(leaves, kept, done)


def build(
    docs: DataFrame, carried: tuple[str, ...] = (), fanout: int = FANOUT, kept_every: int = KEPT_EVERY
) -> Manifest:
    """The manifest of the rows; `carried` columns stay beside their leaf."""
    leaves = stored(
        docs.select(
            F.col("doc_id").alias("id"),
            F.col("source").cast("string").alias("source"),
            leaf_digest().alias("digest"),
            *[F.col(name).alias(f"carried_{name}") for name in carried],
            F.monotonically_increasing_id().alias("row"),
        ),
        "merkle-leaves",
    )
    sources = _numbered_sources(leaves)
    numbered = leaves.join(sources, leaves["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    order = [F.col("group"), F.col("id").asc_nulls_first(), F.col("digest"), F.col("row")]
    nodes = stored(placed(numbered, order).drop("row"), "merkle-nodes")
    trees = _grown(nodes, fanout, kept_every)
    tops = trees.tops.withColumnRenamed("group", "place").join(sources.withColumnRenamed("group", "place"), "place")
    one_tree = {"n": F.lit(sources.count()).cast("long"), "group": F.lit(0).cast("long")}
    subroots = stored(tops.withColumns(one_tree), "merkle-subroots")
    return Manifest(trees, _grown(subroots, fanout, kept_every))


def _sibling_steps(inner: Column, height: Column, index: Column, fanout: int, levels: int) -> Column:
    """The steps from the node at `index` of a subtree to its top: its place in each run and the run's others."""
    steps = []
    for k in range(levels):
        at = F.floor(index / fanout**k).cast("int")
        start = at - at % fanout + 1
        run = F.slice(F.element_at(inner, k + 1), start, fanout)
        place = at % fanout
        others = F.concat(F.slice(run, F.lit(1), place), F.slice(run, place + 2, fanout))
        step = F.struct(place.cast("int").alias("place"), others.alias("siblings"))
        steps.append(F.when(height > k, F.array(step)).otherwise(F.array().cast(f"array<{_STEP}>")))
    return F.concat(*steps)


def _with_paths(tree: Tree, beyond: DataFrame, more: list[str], fanout: int, levels: int) -> DataFrame:
    """(group, digest, more, upper, path): each leaf, with its steps up to the root.

    `beyond` has for every group (group, upper, path): a struct of values of the group, and the
    steps above its last node.
    """
    span = fanout**levels
    ancestors = None
    for level in [*reversed(tree.levels), tree.nodes]:
        own = more if level is tree.nodes else []
        blocks = _climbed(_subtrees(level, span, *own), fanout, levels)
        single = blocks.where(F.col("n") <= span).join(beyond, "group")
        if ancestors is not None:
            # One row for a subtree here, one for its top in the level above.
            over = ancestors.select("group", F.col("place").alias("block"), "upper", "path")
            blocks = single.unionByName(blocks.where(F.col("n") > span).join(over, ["group", "block"]))
        else:
            blocks = single
        found = F.transform(
            "nodes",
            lambda node, index: F.struct(
                node.place.alias("place"),
                node.digest.alias("digest"),
                *[node[name].alias(name) for name in own],
                F.concat(
                    _sibling_steps(F.col("inner"), F.col("height"), index, fanout, levels), F.col("path")
                ).alias("path"),
            ),
        )
        ancestors = blocks.select("group", "upper", F.explode(found).alias("node")).select(
            "group", "upper", "node.*"
        )
    return ancestors


def proofs(manifest: Manifest, fanout: int = FANOUT, kept_every: int = KEPT_EVERY) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path, carried columns) of every row of the dataset.

    `path` is the list of steps from the leaf over its subroot to the root: the node's place in its
    run, and the digests of the run's others.
    """
    nodes = manifest.sources.nodes
    carried = [name for name in nodes.columns if name.startswith("carried_")]
    root = manifest.root()
    everything = manifest.top.tops.select(
        "group",
        F.struct(F.lit(root).cast("string").alias("root")).alias("upper"),
        F.array().cast(f"array<{_STEP}>").alias("path"),
    )
    above = _with_paths(manifest.top, everything, ["source"], fanout, kept_every).select(
        F.col("place").alias("group"),
        F.struct("source", F.col("digest").alias("subroot"), F.col("upper.root").alias("root")).alias("upper"),
        "path",
    )
    above = stored(above, "merkle-source-paths")
    found = _with_paths(manifest.sources, above, ["id", *carried], fanout, kept_every)
    return found.select(
        F.col("id").alias("doc_id"),
        "upper.source",
        F.col("digest").alias("leaf"),
        "upper.subroot",
        "upper.root",
        "path",
        *[F.col(name).alias(name.removeprefix("carried_")) for name in carried],
    )


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its steps lead to."""

    def step_up(digest: Column, step: Column) -> Column:
        before = F.slice(step.siblings, F.lit(1), step.place)
        after = F.slice(step.siblings, step.place + 1, F.size(step.siblings) + 1)
        return F.sha2(F.concat(F.array_join(before, ""), digest, F.array_join(after, "")), 256)

    return F.aggregate(path, leaf, step_up)


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level."""
    return joined_digest(F.flatten(F.transform(path, lambda step: step.siblings)))
