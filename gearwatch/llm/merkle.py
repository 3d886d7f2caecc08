"""Merkle manifest of a table: one tree per group, a tree over the groups, a proof for every row.

Trees have arity ``ARITY``: while several nodes remain, runs of consecutive ones become their hash. Their nodes are kept as
an append log. An aligned builder owns ``BLOCK`` consecutive nodes of one tree and writes them and everything above them
that it can complete, in completion order (postorder); its last node starts the next round. Where a node stands in the log
of its builder follows from the sizes of the subtrees before it (``position``), so siblings are read by address.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gearwatch.llm.common import running_totals
from gearwatch.session import materialise

ARITY, HEIGHT = 16, 2
#: Nodes that one builder takes: whole subtrees of two levels.
BLOCK = ARITY**HEIGHT
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
OUTPUTS = ("leaf", "subroot", "root", "path", "folded_root", "verified")
PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value with its length in bytes in front, so that no two rows are the same text; ``-`` stands for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return digest(*map(framed, values))


def position(level: Column | int, index: Column, n: Column) -> Column:
    """Place of a node in the log of a builder of ``n`` nodes, counted from 0: the nodes completed up to its last leaf, and its level.

    A full subtree of height h has (ARITY^(h + 1) - 1) / (ARITY - 1) nodes; what stands before leaf e are e leaves and the
    floor(e / ARITY^h) full subtrees of each height.
    """
    last = F.least((index + 1) * F.pow(F.lit(ARITY), F.lit(level)).cast("long"), n.cast("long")) - 1
    return last + sum((F.expr("0L") + F.floor(last / ARITY**h) for h in range(1, HEIGHT + 1)), F.lit(level))


def _append_log(nodes: DataFrame) -> DataFrame:
    """Logs of the builders from their sorted ``nodes``: (tree, block, n, height, log, ...)."""
    run = lambda q: F.slice("nodes", q * ARITY + 1, ARITY)
    runs = F.sequence(F.lit(0), F.floor((F.size("nodes") - 1) / ARITY).cast("int"))
    m = F.size("nodes")
    height = F.when((F.col("n") > BLOCK) | (m > ARITY), 2).when(m > 1, 1).otherwise(0)
    parents = F.transform(runs, lambda q: digest(F.array_join(run(q), "")))
    two = F.concat(F.flatten(F.zip_with(runs, F.col("parents"), lambda q, p: F.concat(run(q), F.array(p)))),
                   F.array(digest(F.array_join("parents", ""))))
    log = F.when(F.col("height") == 2, two).when(F.col("height") == 1, F.concat("nodes", "parents")).otherwise(F.col("nodes"))
    return nodes.withColumns({"height": height, "parents": parents}).withColumn("log", log).drop("parents", "nodes")


def _builders(nodes: DataFrame, *carry: str) -> DataFrame:
    """One row per builder of (tree, i, n, digest): at most ``BLOCK`` nodes of one tree."""
    fields = F.sort_array(F.collect_list(F.struct("i", "digest", *carry)))
    rows = nodes.groupBy("tree", "n", F.floor(F.col("i") / BLOCK).cast("long").alias("block")).agg(fields.alias("rows"))
    extra = [F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in carry])).alias("carried")] if carry else []
    return rows.select("tree", "n", "block", F.col("rows.digest").alias("nodes"), F.size("rows").alias("m"), *extra)


@dataclass
class Forest:
    """Logs of all rounds: ``rounds[r]`` holds (tree, n, block, m, height, log) of round r; ``roots`` holds (tree, digest)."""

    rounds: list[DataFrame]
    roots: DataFrame


def build(nodes: DataFrame, name: str, *carry: str) -> Forest:
    """The trees over (tree, i, n, digest): ``i`` from 0 inside the tree of ``n`` nodes. ``carry`` stays with the leaves.

    Each round has 1 / ``BLOCK`` of the nodes of the one before, and each builder is a row of its own, so one tree of any
    size is built by many tasks.
    """
    rounds, roots = [], None
    widest = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    while True:
        rounds.append(materialise(_append_log(_builders(nodes, *(carry if not rounds else ()))), f"{name}-log"))
        heads = rounds[-1].select("tree", "n", F.col("block").alias("i"), F.element_at("log", -1).alias("digest"))
        done = heads.filter(F.col("n") <= BLOCK).select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if widest <= BLOCK:
            return Forest(rounds, roots)
        widest = -(-widest // BLOCK)
        nodes = heads.filter(F.col("n") > BLOCK).withColumn("n", F.ceil(F.col("n") / BLOCK))


def extract(forest: Forest, above: DataFrame) -> DataFrame:
    """(tree, i, path, carried) of every leaf: per level the siblings left and right of it, each side as one text.

    ``above`` holds (tree, path): what follows the root of each tree. From the last round down each builder hands the path
    of its own root to its nodes, so the top of a tree is looked up once per builder and not once per leaf.
    """
    handed = None
    for r, logs in reversed(list(enumerate(forest.rounds))):
        ended = logs.filter(F.col("n") <= BLOCK).join(above.withColumnRenamed("path", "above"), "tree")
        if handed is not None:
            inner = logs.filter(F.col("n") > BLOCK).join(handed.select("tree", F.col("i").alias("block"), F.col("path").alias("above")), ["tree", "block"])
            ended = ended.unionByName(inner)
        handed = _paths(ended)
        if r:
            handed = materialise(handed, "merkle-paths")
    return handed


def _paths(logs: DataFrame) -> DataFrame:
    """Paths of all nodes of the builders, run by run and then node by node."""
    q, m = F.col("_q"), F.col("m")
    runs = F.floor((m - 1) / ARITY).cast("int")
    at = lambda level, j: F.element_at("log", (position(level, j, m) + 1).cast("int"))
    side = lambda keep: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), runs), keep), lambda j: at(1, j)), "")
    step = lambda left, right: F.array(F.struct(left.alias("left"), right.alias("right")))
    none = F.array().cast(PATH)
    carried = ["carried"] if "carried" in logs.columns else []
    first = (position(0, (q * ARITY).cast("long"), m) + 1).cast("int")
    by_run = logs.withColumn("_q", F.explode(F.sequence(F.lit(0), runs))).select(
        "tree", "block", "height", "_q",
        F.slice("log", first, F.least(F.lit(ARITY), m - q * ARITY)).alias("_run"),
        F.concat(F.when(F.col("height") == 2, step(side(lambda j: j < q), side(lambda j: j > q))).otherwise(none), F.col("above")).alias("_up"),
        *[F.slice(c, q * ARITY + 1, ARITY).alias(c) for c in carried])
    k = F.col("_k")
    left, right = F.array_join(F.slice("_run", F.lit(1), k), ""), F.array_join(F.slice("_run", k + 2, F.lit(ARITY)), "")
    by_node = by_run.withColumn("_k", F.explode(F.sequence(F.lit(0), F.size("_run") - 1)))
    return by_node.select(
        "tree", (F.col("block") * BLOCK + q * ARITY + k).alias("i"),
        F.concat(F.when(F.col("height") >= 1, step(left, right)).otherwise(none), F.col("_up")).alias("path"),
        *[F.element_at(c, k + 1).alias(c) for c in carried])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def prove(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_column: str = "doc_id", group_column: str = "source",
          presented: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, path, folded_root, verified) for every row of ``docs``.

    A leaf is the digest of ``columns``, each framed by its length. Leaves of a group ascend by id (nulls first), rows with
    one id by their leaf; groups ascend by their bytes, null first. ``presented`` replaces columns in what is verified: the
    root is folded from the leaf of the presented row and the siblings of the manifest, and ``verified`` says whether it is
    the root. A row alone in its tree is the root of it, and a table of one row has an empty path.

    Nulls in any column are hashed as nulls; empty texts differ from them. Repeated rows are leaves each. An empty table
    gives an empty result. Other columns of ``docs`` are not returned and may have any name.
    """
    own = {c: F.col(f"`{c}`") for c in columns}
    shown = own | (presented or {})
    changed = F.nullif(leaf_digest([shown[c] for c in columns]), leaf_digest([own[c] for c in columns])) if presented else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{group_column}`").alias("group"), F.col(f"`{id_column}`").alias("id"),
                       leaf_digest([own[c] for c in columns]).alias("digest"), changed.alias("changed"), F.lit(1).alias("one"))
    ranked = running_totals(rows, ["group", "id", "digest"], ["one"], "merkle-leaves")
    groups = ranked.groupBy("group").agg(F.min("end_one").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = materialise(running_totals(groups.withColumn("one", F.lit(1)), ["group"], ["one"], "merkle-groups").select(
        F.col("group").alias("g"), "first", "n", (F.col("end_one") - 1).alias("tree")), "merkle-groups")
    placed = ranked.join(groups, F.col("group").eqNullSafe(F.col("g")))
    leaves = placed.select("tree", (F.col("end_one") - F.col("first")).alias("i"), "n", "digest", "id", F.col("digest").alias("leaf"), "changed")
    forest = build(leaves, "merkle", "id", "leaf", "changed")
    n_trees = groups.agg(F.count(F.lit(1)).alias("n")).scalar()
    subroots = materialise(forest.roots, "merkle-subroots")
    top = build(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), n_trees.alias("n"), "digest"), "merkle-top")
    root = materialise(top.roots, "merkle-root")
    above = extract(top, root.select("tree", F.array().cast(PATH).alias("path"))).select(F.col("i").alias("tree"), "path")
    above = materialise(above.join(subroots.withColumnRenamed("digest", "subroot"), "tree"), "merkle-above")
    proofs = extract(forest, above.select("tree", "path")).join(above.select("tree", "subroot"), "tree")
    proofs = proofs.withColumn("root", root.select("digest").scalar())
    leaf = F.col("carried.leaf")
    out = proofs.select(
        F.col("carried.id").alias(id_column), leaf.alias("leaf"), "subroot", "root", "path",
        fold(F.coalesce("carried.changed", leaf), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
