"""Merkle manifest of a dataset: a tree per source, and one over the sources, with nested-interval labels.

Every node carries the interval of leaf ranks that it covers. Parents and children
meet in joins on the level's bucket (the rank divided by the level's width) where the
parent's interval contains the child's; the siblings of a node are what the parent's
interval holds besides the node's own. All hashes are Spark's ``sha2``; no Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage

from .common import all_of

#: Children of a node.
FAN_OUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:binary,right:binary>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def ranked(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``leaves`` with tree (0, 1, ... by ``group``, null first), n (leaves of the tree) and lo (rank in the tree, from 0).

    Rows are sorted once over all groups and cut into ranges, so a group with a third of all
    rows lies in many ranges. One row per range carries on where a group began and where it ends.
    """
    cut = cut_lineage(leaves.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "merkle-ranges")
    key = F.struct(F.col(group).isNotNull().alias("has"), F.col(group).alias("key"))
    pieces = cut.groupBy("_range", group).agg(F.count(F.lit(1)).alias("c")).withColumn("k", key)
    per = pieces.groupBy("_range").agg(
        F.sum("c").alias("rows"), F.count(F.lit(1)).alias("groups"), F.min("k").alias("first"), F.max("k").alias("last"),
        F.min_by("c", "k").alias("n_first"), F.max_by("c", "k").alias("n_last"),
    )
    # One row per range of the sort, so no more than there were shuffle partitions.
    by, before = Window.orderBy("_range"), Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    upto, onward = before.rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("_range").rowsBetween(0, Window.unboundedFollowing)
    single = F.col("groups") == 1
    edges = per.select(
        "*", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
        F.coalesce(F.lag("last").over(by) == F.col("first"), F.lit(False)).alias("carries"),
        F.coalesce(F.lead("first").over(by) == F.col("last"), F.lit(False)).alias("goes_on"),
    ).select(
        "*", F.coalesce(F.sum(F.col("groups") - F.col("carries").cast("int")).over(before), F.lit(0)).alias("trees"),
        F.when(~(single & F.col("carries")), F.col("before") + F.col("rows") - F.col("n_last")).alias("begun"),
        F.when(~(single & F.col("goes_on")), F.col("before") + F.col("n_first")).alias("ended"),
    ).select(
        "*", F.last("begun", ignorenulls=True).over(upto).alias("start_last"), F.first("ended", ignorenulls=True).over(onward).alias("end_first"),
    ).select(
        "_range", "before", "groups", (F.col("trees") - F.col("carries").cast("int")).alias("trees"), "start_last", "end_first",
        F.when(F.col("carries"), F.lag("start_last").over(by)).otherwise(F.col("before")).alias("start_first"),
        F.when(F.col("goes_on"), F.lead("end_first").over(by)).otherwise(F.col("before") + F.col("rows")).alias("end_last"),
    )
    inside = Window.partitionBy("_range").orderBy(group, *order)
    groups = Window.partitionBy("_range").orderBy(group)
    rows = cut.withColumns({
        "_row": F.row_number().over(inside), "_start": F.rank().over(groups), "_turn": F.dense_rank().over(groups),
        "_n": F.count(F.lit(1)).over(Window.partitionBy("_range", group)),
    }).join(edges, "_range")
    is_first, is_last = F.col("_turn") == 1, F.col("_turn") == F.col("groups")
    start = F.when(is_first, F.col("start_first")).when(is_last, F.col("start_last")).otherwise(F.col("before") + F.col("_start") - 1)
    end = F.when(is_first, F.col("end_first")).when(is_last, F.col("end_last")).otherwise(F.col("before") + F.col("_start") - 1 + F.col("_n"))
    return rows.select(
        *leaves.columns, (F.col("trees") + F.col("_turn") - 1).cast("long").alias("tree"), (end - start).alias("n"), (F.col("before") + F.col("_row") - 1 - start).alias("lo")
    )


def _bucket(level: int) -> Column:
    """Which node of ``level`` a leaf rank lies under."""
    return F.expr(f"lo div {FAN_OUT**level}L")


def grow(leaves: DataFrame, largest: int, label: str) -> list[DataFrame]:
    """The nodes above ``leaves`` (tree, n, lo, digest), a table per level: tree, n, lo, hi, digest, kids.

    A tree of n leaves has a next level while n is over the width of the present one.
    Each level has a third of the rows of the one below; a node is made from its three children.
    """
    below, levels, width = leaves.select("tree", "n", "lo", F.col("lo").alias("hi"), "digest"), [], 1
    while width < largest:
        kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
        grouped = below.where(F.col("n") > width).groupBy("tree", "n", _bucket(len(levels) + 1).alias("b")).agg(kids.alias("kids"))
        made = F.unhex(digest(*[F.coalesce(as_hex(F.get("kids.digest", F.lit(i))), F.lit("")) for i in range(FAN_OUT)]))
        node = grouped.select("tree", "n", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), made.alias("digest"), "kids")
        levels.append(cut_lineage(node, f"{label}-level"))
        below, width = levels[-1].drop("kids"), width * FAN_OUT
    return levels


def _is_root(level: int) -> Column:
    return (F.col("n") <= FAN_OUT**level) & (F.lit(level == 0) | (F.col("n") > FAN_OUT ** max(level - 1, 0)))


def tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The node left at the top of each tree: tree, digest."""
    found = leaves.where(_is_root(0)).select("tree", "digest")
    for i, nodes in enumerate(levels, 1):
        found = found.unionByName(nodes.where(_is_root(i)).select("tree", "digest"))
    return found


def _siblings(side: str) -> Column:
    """Digests of the children in the parent's interval before or after the node's own, left to right."""
    outside = (lambda k: k["hi"] < F.col("lo")) if side == "left" else (lambda k: k["lo"] > F.col("hi"))
    return F.aggregate(F.filter("kids", outside), F.unhex(F.lit("")), lambda found, k: F.concat(found, k["digest"]))


def descend(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, label: str) -> DataFrame:
    """``leaves`` with the path from each to the top of everything: above's columns, and path with one struct of left and right siblings per level.

    ``above`` has tree, path (what lies over the tree's top) and any other columns of a tree. Paths travel
    down a level at a time in containment joins, so a path is made once per parent and all levels together move
    half as many rows as there are leaves, and then the leaves once.
    """
    rest = [c for c in above.columns if c not in ("tree", "path")]
    parents = None
    for i in range(len(levels), -1, -1):
        nodes = levels[i - 1] if i else leaves.withColumn("hi", F.col("lo"))
        placed = nodes.where(_is_root(i)).join(above, "tree")
        if parents is not None:
            over = parents.select(F.col("tree").alias("_tree"), _bucket(i + 1).alias("_b"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("kids").alias("_kids"), F.col("path").alias("_path"), *rest)
            same = [F.col("tree") == F.col("_tree"), _bucket(i + 1) == F.col("_b"), F.col("_lo") <= F.col("lo"), F.col("hi") <= F.col("_hi")]
            met = nodes.where(F.col("n") > FAN_OUT**i).join(over, all_of(same))
            step = F.struct(_siblings("left").alias("left"), _siblings("right").alias("right"))
            own = met.withColumn("_own", F.lit(None)) if not i else met.withColumnRenamed("kids", "_own")
            path = F.concat(F.array(step), F.col("_path")).cast(PATH).alias("path")
            below = own.withColumnRenamed("_kids", "kids").select(*[F.col("_own").alias(c) if c == "kids" else c for c in nodes.columns], *rest, path)
            placed = placed.select(*below.columns).unionByName(below)
        parents = cut_lineage(placed, f"{label}-paths") if i else placed
    return parents.drop("hi")


def fold(leaf: Column, path: Column) -> Column:
    """The top that ``leaf`` (hex) and its siblings give."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(as_hex(s["left"]), at, as_hex(s["right"])).cast("binary"), 256))


def leaf_table(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, source, leaf and, where ``tampered`` gives another text, the leaf of that (tampered_leaf)."""
    leaf = F.unhex(digest(*[field(F.col(c)) for c in fields]))
    other = F.lit(None).cast("binary")
    if tampered is not None:
        changed = F.unhex(digest(*[field(F.col("_text") if c == "text" else F.col(c)) for c in fields]))
        docs = docs.withColumn("_text", tampered)
        other = F.when(~F.col("_text").eqNullSafe(F.col("text")), changed)
    return docs.select("doc_id", "source", leaf.alias("digest"), other.alias("tampered"), F.monotonically_increasing_id().alias("tie"))


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The manifest of ``docs``: doc_id, source, leaf, subroot, root, path, proof_sha256, folded_root, verified.

    A leaf is the digest of the ``fields``. Per source (null first, then bytewise) leaves ascend by doc_id (null first),
    equal ids by leaf; every three consecutive nodes make one, and so on to the source's subroot; subroots make the root
    alike. ``path`` lists the siblings on the way up; a run of one has none and is hashed alone. ``proof_sha256`` is the
    digest of the siblings, level by level, left to right, ``folded_root`` what the present leaf and the path give:
    the leaf of ``tampered`` (a text as it is now) where that is given and differs.

    Null values: ``-`` in the leaf; a null source is a source of its own, null ids come first. Empty and very long texts are
    values like others. Repeated rows are leaves of their own, side by side; which of them is first does not matter.
    Empty table: no rows. Further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    made = cut_lineage(leaf_table(docs, tampered, fields), "merkle-leaves")
    leaves = cut_lineage(ranked(made, "source", ["doc_id", "digest", "tie"]).drop("tie"), "merkle-ranked")
    largest, trees = leaves.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("tree") + 1, F.lit(0))).first()
    levels = grow(leaves, largest, "merkle")
    subroots = cut_lineage(tops(leaves, levels), "merkle-subroots")
    crown = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("lo"), "digest")
    crown_levels = grow(crown, trees, "merkle-crown")
    top = tops(crown, crown_levels).first()
    root = top["digest"].hex() if top else None
    start = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.array().cast(PATH).alias("path"))
    over = descend(crown, crown_levels, start, "merkle-crown").select(F.col("lo").alias("tree"), F.col("digest").alias("subroot"), "path")
    placed = descend(leaves, levels, cut_lineage(over, "merkle-over"), "merkle")
    siblings = F.aggregate("path", F.unhex(F.lit("")), lambda found, s: F.concat(found, s["left"], s["right"]))
    folded = fold(as_hex(F.coalesce("tampered", "digest")), F.col("path"))
    return placed.select(
        "doc_id", "source", as_hex(F.col("digest")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), F.lit(root).cast("string").alias("root"), "path",
        digest(as_hex(siblings)).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def without_breaks(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` checked against a copy in which the documents with an even crc32 of their id lost their line feeds."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(docs, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
