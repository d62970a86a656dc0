"""Merkle manifest of a dataset (operator 12).

Rows are leaves of one tree per group; the roots of these trees are the leaves of a tree over the groups.  A run is up to
`arity` consecutive nodes, its digest the node above them, until one node is left.

1. Bottom-up: each level is grouped by run and written: a node, its place and the nodes of its run.
2. Top-down: the written levels, from the root to the leaves, join each node to the run above it, which hands down its proof;
   the node puts its siblings in front of it.  A proof of a leaf therefore lists its siblings from its own level to the root.

Rows are placed within their group by ranges (`operators.ordering`), so a group of a third of all rows has no task of its own,
and no step has more than `arity` nodes of a level in one place.  A level is `arity` times smaller than the one below it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import drop_table, write_table
from glyphmill.operators.ordering import placed

ARITY = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_PROOF = "array<struct<before:string,after:string>>"


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def leaf_content(values: list[Column]) -> Column:
    """The values as text, each `-` if null, else its UTF-8 length in bytes, a colon, and itself: no two lists have the same."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf leads to by its proof, an array of `(before, after)`: the digests on its left and right in each run."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


@dataclass
class _Forest:
    """Levels `(tree, at, node, n, run)`, leaves first: n nodes of the tree at that level, run the nodes below this one."""

    levels: list[DataFrame]
    arity: int

    def roots(self) -> DataFrame:
        """`(tree, node)` of each tree."""
        found = [level.filter("n = 1").select("tree", "node") for level in self.levels]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out

    def pushed(self, handed: DataFrame, *carried: str) -> DataFrame:
        """The leaves with `carried` of their columns, and the proof and further columns of `handed(tree, proof, ..)` of their tree.

        All but the join of the leaves is written; what that reads is named for `drop_table` of the result.
        """
        below = None
        more = [c for c in handed.columns if c not in ("tree", "proof")]
        for level in reversed(self.levels):
            own = ("tree", "at", "run") if "run" in level.columns else ("tree", *carried)
            top = level.filter("n = 1").join(handed, "tree").select(*own, *more, "proof")
            if below is not None:
                above = below.select(F.col("tree").alias("of"), F.col("at").alias("over"), F.col("run").alias("nodes"), F.col("proof").alias("suffix"), *more)
                pos = (F.col("at") % self.arity).cast("int")
                joined = level.filter("n > 1").join(above, (F.col("tree") == F.col("of")) & (F.floor(F.col("at") / self.arity) == F.col("over")))
                left = F.array_join(F.slice("nodes", F.lit(1), pos), "")
                right = F.array_join(F.slice("nodes", pos + 2, F.lit(self.arity)), "")
                step = F.array(F.struct(left.alias("before"), right.alias("after")))
                top = joined.select(*own, *more, F.concat(step, "suffix").alias("proof")).unionByName(top)
            if level is self.levels[0]:
                top._glyphmill_under = (*self.levels, *([] if below is None else [below]))
                return top
            made = write_table(top)
            drop_table(*([] if below is None else [below]))
            below = made


def _grown(leaves: DataFrame, arity: int) -> _Forest:
    """The levels over `leaves(tree, at, n, node, ..)`, a written table; places of a tree are 0 to n - 1."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        run = F.sort_array(F.collect_list(F.struct("at", "node")))  # at most `arity` nodes
        level = levels[-1].filter("n > 1").groupBy("tree", F.floor(F.col("at") / arity).alias("above")).agg(F.max("n").alias("n"), run.alias("nodes"))
        nodes = F.transform("nodes", lambda x: x["node"])
        levels.append(
            write_table(level.select("tree", F.col("above").alias("at"), digest(F.array_join(nodes, "")).alias("node"), F.ceil(F.col("n") / arity).alias("n"), nodes.alias("run")))
        )
        most = -(-most // arity)
    return _Forest(levels, arity)


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", key: str = "doc_id", arity: int = ARITY, **carried: Column) -> DataFrame:
    """One row per row of `docs`: `(key, leaf, subroot, root, proof)` and the columns of `carried`, made of the row.

    `leaf` is the digest of the row's `columns`; in each group leaves ascend by `key`, repeated keys by their leaf; groups
    are ordered by their value as text, null first.  `proof` is an array of `(before, after)` for `fold`.  Defined results:
    nulls have a content of their own, other than that of empty texts; null keys come first; rows that repeat have a leaf
    each, with proofs of their own; other columns of `docs` are ignored; an empty table gives an empty result.
    """
    if arity < 2:
        raise ValueError("a run has at least two nodes")
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-")).alias("tree")
    leaf = digest(leaf_content([F.col(f"`{c}`") for c in columns])).alias("node")
    rows = docs.select(tree, F.col(f"`{key}`").alias("key"), leaf, *[c.alias(f"carried_{k}") for k, c in carried.items()])
    extra = [f"carried_{k}" for k in carried]
    at = placed(rows, "key", "node", within=("tree",), name="place", total="n")
    leaves = write_table(at.select("tree", (F.col("place") - 1).alias("at"), "node", "n", "key", *extra))
    drop_table(at)
    forest = _grown(leaves, arity)

    named = forest.roots().withColumn("name", F.when(F.col("tree") != "-", F.substr("tree", F.lit(2))))
    order = placed(named, "name", name="place", total="n")
    tops = write_table(order.select(F.lit("").alias("tree"), (F.col("place") - 1).alias("at"), "node", "n", F.col("tree").alias("under")))
    drop_table(order)
    above = _grown(tops, arity)
    first = above.roots().select("tree", F.col("node").alias("root"), F.array().cast(_PROOF).alias("proof"))
    lower = above.pushed(first, "under", "node")
    handed = write_table(lower.select(F.col("under").alias("tree"), F.col("node").alias("subroot"), "root", "proof"))
    drop_table(lower)
    found = forest.pushed(handed, "key", "node", *extra)
    out = found.select(F.col("key").alias(key), F.col("node").alias("leaf"), "subroot", "root", "proof", *[F.col(f"carried_{k}").alias(k) for k in carried])
    out._glyphmill_under = (found, handed)
    return out
