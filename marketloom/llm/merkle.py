"""Merkle manifest of a dataset: one tree of digests per group of rows, and one tree over the groups.

A level is a table of nodes (tree, idx, n, digest) with gapless positions. Every level is joined with itself: a node asks for
the digests at its computed sibling positions (idx XOR 1 in binary trees, the other slot offsets of its run otherwise), which
gives the parts of its proof step left and right of it; the rows in slot 0 then emit the parents. A tree is done when one node
remains. On the way down the steps above a run are joined once per run, so no table of all leaves and levels is written.

Digests are kept as 32 bytes; a hash is taken over the lowercase hex text of its inputs.

Defined cases: a null key comes first in its group and equal keys go by digest (copies of a row are interchangeable); a null
group is a group of its own and comes first; an empty table has no leaves and no root; a group of one row has its leaf as root.
Other columns of the table are not read, and names of columns never meet those used here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.llm.common import store

_NO_BYTES = "X''"


def node_digest(joined: Column) -> Column:
    """Binary digest of concatenated binary digests, hashed as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(joined)), 256))


def row_digest(*values: Column) -> Column:
    """Binary digest of a row: each value as `-` if null, else its UTF-8 length, a colon and its text."""
    text = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256))


def fold(digest: Column, path: Column) -> Column:
    """The root reached from a leaf's digest by the steps (left, right) of its proof."""
    return F.aggregate(path, digest, lambda acc, step: node_digest(F.concat(step["left"], acc, step["right"])))


def proof_digest(path: Column) -> Column:
    """Binary digest of all siblings of a path, level by level, left to right."""
    return node_digest(F.aggregate(path, F.expr(_NO_BYTES), lambda acc, step: F.concat(acc, step["left"], step["right"])))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


@dataclass(frozen=True)
class Manifest:
    """leaves: tree, idx, n, digest and the carried columns as struct `row`; levels: per level of the groups' trees the nodes with
    `left` and `right`; groups: tree, value, n, digest (the group's root) and `path`, its steps to the root; root: one row with
    the digest, none for an empty table."""

    leaves: DataFrame
    levels: list[DataFrame]
    groups: DataFrame
    root: DataFrame
    arity: int


def _numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows in ranges by one exchange, with `_part` and `_at`, and per group and range what to add to `_at` for gapless positions."""
    by = [*group, *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = store(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), name)
    spans = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    same = Window.partitionBy(*(group or [F.lit(0)]))  # at most one row per exchange partition
    before = same.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    return placed, spans.select(*group, "_part", shift.alias("_shift"), F.sum("_rows").over(same).alias("n"))


def _leaves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (value, key, digest, row) as leaves with tree, idx and n, and the groups (tree, value, n, total)."""
    placed, spans = _numbered(rows, ["value"], ["key", "digest"], "merkle-rows")
    values, ends = _numbered(spans.select("value", "n").distinct(), [], ["value"], "merkle-groups")
    ends = ends.select(F.col("_part").alias("_p"), "_shift", F.col("n").alias("total"))
    groups = store(values.join(ends, values["_part"] == ends["_p"]).select((F.col("_at") + F.col("_shift")).alias("tree"), "value", "n", "total"), "merkle-trees")
    known = groups.select("tree", F.col("value").alias("_value"))
    spans = spans.join(known, F.col("value").eqNullSafe(F.col("_value"))).select("_value", F.col("_part").alias("_p"), "_shift", "n", "tree")
    met = placed.join(spans, (placed["_part"] == spans["_p"]) & placed["value"].eqNullSafe(spans["_value"]))
    return store(met.select("tree", (F.col("_at") + F.col("_shift")).alias("idx"), "n", "digest", "row"), "merkle-leaves"), groups


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (tree, idx, n, digest) with `left` and `right`: the digests of the run's other nodes before and after each node."""
    idx = F.col("idx")
    slot = idx % arity
    if arity == 2:
        wanted = F.array(idx.bitwiseXOR(F.lit(1)))
    else:
        wanted = F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda o: idx - slot + (slot + o) % arity)
    wanted = F.filter(wanted, lambda w: w < F.col("n"))
    # Only the rows that emit parents need their own digest here.
    asked = nodes.select("tree", "idx", F.when(slot == 0, F.col("digest")).alias("own"), "n", F.explode_outer(wanted).alias("at"))
    there = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_at"), F.col("digest").alias("other"))
    met = asked.join(there, (F.col("tree") == F.col("_tree")) & (F.col("at") == F.col("_at")), "left")
    grouped = met.groupBy("tree", "idx", "n").agg(
        F.max("own").alias("own"), F.sort_array(F.collect_list(F.when(F.col("other").isNotNull(), F.struct("at", "other")))).alias("near")
    )

    def side(keep) -> Column:
        return F.aggregate(F.filter("near", keep), F.expr(_NO_BYTES), lambda acc, s: F.concat(acc, s["other"]))

    return grouped.select("tree", "idx", "n", "own", side(lambda s: s["at"] < idx).alias("left"), side(lambda s: s["at"] > idx).alias("right"))


def _grow(nodes: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels below the roots with their proof steps, and the roots (tree, digest) of all trees."""
    levels, roots = [], nodes.where("n = 1").select("tree", "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level = store(_siblings(nodes.where("n > 1"), arity), f"{name}-{len(levels)}")
        levels.append(level)
        nodes = level.where(F.col("idx") % arity == 0).select(
            "tree",
            F.expr(f"idx div {arity}").alias("idx"),
            F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            node_digest(F.concat("own", "right")).alias("digest"),
        )
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "digest"))
        most = -(-most // arity)
    return levels, roots


def _with_paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """Leaves with `path`, their steps up to the root; `tops` (tree, n, path) holds the steps above the root of each tree."""
    tops = tops.select("tree", "path", F.col("n").alias("c0"))
    for k in range(len(levels) + 1):
        tops = tops.withColumn(f"c{k + 1}", F.expr(f"(c{k} + {arity - 1}) div {arity}"))
    step = F.array(F.struct("left", "right"))
    above = None
    for k in range(max(len(levels), 1), 0, -1):
        single = F.col(f"c{k}") == 1
        found = tops.where(single & (F.col(f"c{k - 1}") > 1) if k > 1 else single).select("tree", F.lit(0).cast("long").alias("idx"), "path")
        if above is not None:
            inner = levels[k].join(above, (F.col("tree") == F.col("_tree")) & (F.expr(f"idx div {arity}") == F.col("_run")))
            found = found.unionByName(inner.select("tree", "idx", F.concat(step, F.col("_path")).alias("path")))
        above = found.select(F.col("tree").alias("_tree"), F.col("idx").alias("_run"), F.col("path").alias("_path"))
    if levels:
        own = levels[0].select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), "left", "right")
        leaves = leaves.join(own, (F.col("tree") == F.col("_t")) & (F.col("idx") == F.col("_i")), "left").drop("_t", "_i")
        own_step = F.when(F.col("left").isNotNull(), step).otherwise(F.slice(step, 1, 0))
    met = leaves.join(above, (F.col("tree") == F.col("_tree")) & (F.expr(f"idx div {arity}") == F.col("_run")))
    path = F.concat(own_step, F.col("_path")) if levels else F.col("_path")
    return met.withColumn("path", path).drop("_tree", "_run", "_path", *(["left", "right"] if levels else []))


def build(
    rows: DataFrame, columns: Sequence[str], key: str, group: str, arity: int = 16, carry: Mapping[str, Column] | None = None
) -> Manifest:
    """The manifest of `rows`: leaves hash `columns` in that order, ascend by `key` inside a `group`, and `arity` neighbours share
    a parent. `carry` names expressions over `rows` that stay with the leaves in the struct `row`, after the key."""
    if arity < 2:
        raise ValueError("arity must be 2 or more")
    named = [F.col(f"`{key}`").alias("key"), *[c.alias(n) for n, c in (carry or {}).items()]]
    digest = row_digest(*[F.col(f"`{c}`") for c in columns])
    hashed = store(rows.select(F.col(f"`{group}`").alias("value"), F.col(f"`{key}`").alias("key"), digest.alias("digest"), F.struct(*named).alias("row")), "merkle-hashed")
    leaves, groups = _leaves(hashed)
    levels, subroots = _grow(leaves.select("tree", "idx", "n", "digest"), arity, "merkle-level")
    subroots = subroots.withColumnRenamed("tree", "_t")
    whole = groups.join(subroots, groups["tree"] == subroots["_t"]).select(
        F.lit(0).cast("long").alias("tree"), groups["tree"].alias("idx"), F.col("total").alias("n"), "digest", F.struct("value", "n").alias("row")
    )
    whole = store(whole, "merkle-subroots")
    upper, root = _grow(whole.select("tree", "idx", "n", "digest"), arity, "merkle-top")
    tops = whole.select("tree", "n").distinct().withColumn("path", F.expr("filter(array(struct(X'' AS left, X'' AS right)), s -> false)"))
    found = _with_paths(whole, upper, tops, arity)
    groups = store(found.select(F.col("idx").alias("tree"), "row.value", "row.n", "digest", "path"), "merkle-paths")
    return Manifest(leaves, levels, groups, root.select("digest"), arity)


def proofs(manifest: Manifest) -> DataFrame:
    """Per leaf: the carried columns, leaf, subroot and root (binary), and `path`, the steps (left, right) from leaf to root."""
    tops = manifest.groups.select("tree", "n", "path")
    found = _with_paths(manifest.leaves, manifest.levels, tops, manifest.arity)
    # One row per group; the root is one row, known before the leaves are read again.
    subroots = manifest.groups.select(F.col("tree").alias("_g"), F.col("digest").alias("subroot"))
    root = manifest.root.first()
    root = F.lit(bytes(root[0]) if root else None).cast("binary")
    return found.join(subroots, F.col("tree") == F.col("_g")).select("row.*", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "path")
