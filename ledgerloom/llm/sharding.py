"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows of each partition go to each shard is drawn first, with the very
distribution that a uniform permutation of all rows has (row sums: the partitions,
column sums: the shards). Rows are then permuted inside their partition, cut by the
matrix's row, exchanged, and permuted again inside their shard. Spark SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage

#: Rows of a partition that is permuted at once, and of a piece of a shard.
PART_ROWS = 16_384
#: Nodes that one row of the matrix's tree is split into.
FAN_OUT = 64
#: A draw's window, in standard deviations each way; what lies outside weighs less than a double resolves.
REACH = 12
#: Least number of partitions, so that small tables are exchanged as well.
LEAST_PARTS = 8
#: Copies of one row that one task writes out.
COPIES = 100_000


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") * F.lit(2.0**-53)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(pop: Column, good: Column, draws: Column, u: Column) -> Column:
    """The number of good ones among ``draws`` taken from ``pop`` without replacement, by inversion of ``u``.

    Weights follow from their ratios, starting at the window's low end, so nothing is lost to
    factorials of large numbers. All arguments are longs, ``u`` is a double in [0, 1).
    """
    n, k, m = pop.cast("double"), good.cast("double"), draws.cast("double")
    mean = m * k / F.greatest(n, F.lit(1.0))
    spread = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - k / F.greatest(n, F.lit(1.0))) * (n - m) / F.greatest(n - 1, F.lit(1.0)))) * REACH + REACH
    low = F.greatest(F.lit(0).cast("long"), draws - (pop - good), F.floor(mean - spread))
    high = F.least(draws, good, F.ceil(mean + spread))

    def ratio(x: Column) -> Column:
        at = x.cast("double")
        return (k - at) * (m - at) / ((at + 1) * (n - k - m + at + 1))

    def total(xs: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
        return F.aggregate(xs, start, lambda a, x: F.struct((a["w"] * ratio(x)).alias("w"), (a["s"] + a["w"]).alias("s")), lambda a: a["s"])

    def pick(xs: Column, goal: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), xs[0].alias("at"))
        return F.aggregate(
            xs, start,
            lambda a, x: F.struct((a["w"] * ratio(x)).alias("w"), (a["s"] + a["w"]).alias("s"), F.when(a["s"] + a["w"] <= goal, x + 1).otherwise(a["at"]).alias("at")),
            lambda a: F.least(a["at"], F.element_at(xs, -1)),
        )

    drawn = _let(F.sequence(low, high), lambda xs: _let(total(xs) * u, lambda goal: pick(xs, goal)))
    return F.when(low >= high, low).otherwise(drawn)


def one_row(left: Column, size: Column, u) -> Column:
    """How many of ``size`` rows, drawn from the shards' free places ``left``, go to each shard. ``u(j)``: a number per shard."""
    start = F.struct(
        F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x).alias("pop"), size.alias("draws"), F.array().cast("array<long>").alias("out")
    )

    def step(a: Column, j: Column) -> Column:
        good = F.element_at(left, j + 1)
        return _let(hypergeometric(a["pop"], good, a["draws"], u(j)), lambda x: F.struct(
            (a["pop"] - good).alias("pop"), (a["draws"] - x).alias("draws"), F.concat(a["out"], F.array(x)).alias("out")))

    shards = F.sequence(F.lit(0), F.size(left) - 1)
    return F.aggregate(shards, start, step, lambda a: a["out"])


def matrix(sizes: DataFrame, free: list[int], seed: int, parts: int) -> DataFrame:
    """The communication matrix: part, counts (one per shard), for ``sizes`` (part, m).

    Parts are leaves of a tree; the places of a node are dealt to its children in turn, each by a multivariate
    draw from what its elder siblings left. Nodes of one level are independent of each other, so they are
    spread over tasks; a table of P parts takes log P levels.
    """
    depth = max(1, math.ceil(math.log(parts, FAN_OUT) - 1e-9)) if parts > 1 else 1
    spark = sizes.sparkSession
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("node"), F.array(*[F.lit(x).cast("long") for x in free]).alias("places"))
    for level in range(1, depth + 1):
        width = FAN_OUT ** (depth - level)
        child = F.expr(f"part div {width}L")
        sums = sizes.groupBy(child.alias("child")).agg(F.sum("m").alias("m"))
        under = sums.groupBy(F.expr(f"child div {FAN_OUT}L").alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "m"))).alias("kids"))

        def deal(a: Column, kid: Column) -> Column:
            return _let(one_row(a["left"], kid["m"], lambda j: uniform(seed, F.lit(level), kid["child"], j)), lambda x: F.struct(
                F.zip_with(a["left"], x, lambda p, q: p - q).alias("left"), F.concat(a["out"], F.array(F.struct(kid["child"].alias("child"), x.alias("x")))).alias("out")))

        start = F.struct(F.col("places").alias("left"), F.array().cast("array<struct<child:bigint,x:array<bigint>>>").alias("out"))
        dealt = nodes.join(under, "node").repartition("node").select(F.explode(F.aggregate("kids", start, deal, lambda a: a["out"])).alias("d"))
        nodes = cut_lineage(dealt.select(F.col("d.child").alias("node"), F.col("d.x").alias("places")), "shard-matrix")
    return nodes.select(F.col("node").alias("part"), F.col("places").alias("counts"))


def shuffle(rows: DataFrame, shards: int = 16, seed: int = 23, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with shard (0 to ``shards`` - 1) and slot (0, 1, ... in the shard), a uniform permutation of all of them.

    Shard sizes differ by one at most, the first ones being larger. Rows that are equal in all columns are counted first
    and written out as copies, so that a group of them is spread like any others and reruns agree whatever the input's
    splits. Null, empty and very long values are values like others. Empty table: no rows. All columns are kept;
    none may be called shard or slot, and they must be of types that can be grouped by.
    """
    taken = {"shard", "slot"} & set(rows.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made here")
    names = rows.columns
    # Copies of one row come in bundles, so that a row with very many of them is written out by many tasks.
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    bundles = counted.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPIES}L"))))
    first = F.col("_b") * COPIES
    last = F.least(F.col("_n") - 1, first + COPIES - 1)
    copies = bundles.withColumn("_copy", F.explode(F.sequence(first, last))).drop("_n", "_b")
    columns = [F.col(f"`{c}`") for c in names]
    drawn = cut_lineage(copies.withColumns({"_key": F.xxhash64(F.lit(seed), "_copy", *columns), "_second": F.xxhash64(F.lit(seed + 1), "_copy", *columns)}), "shard-rows")

    total = drawn.count()
    parts = max(LEAST_PARTS, -(-total // part_rows))
    part = F.pmod(F.xxhash64(F.lit(seed + 2), "_key", "_second"), F.lit(parts)).alias("_part")
    sizes = cut_lineage(drawn.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("m")), "shard-sizes")
    free = [total // shards + (j < total % shards) for j in range(shards)]
    counts = matrix(sizes, free, seed + 3, parts)

    local = Window.partitionBy("_part").orderBy("_key", "_second", *columns, "_copy")
    bounds = F.aggregate("counts", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    cuts = counts.select(F.col("part").alias("_part"), F.slice(bounds, 2, shards).alias("_cuts"))
    sent = drawn.withColumn("_part", part).withColumn("_at", F.row_number().over(local)).join(cuts, "_part")
    shard = F.size(F.filter("_cuts", lambda c: c < F.col("_at"))).cast("int")

    # A shard is permuted in pieces: the second hash says in which, and inside a piece the order.
    pieces = max(1, -(-total // (shards * part_rows)))
    piece = F.floor(uniform(seed + 4, "_second", "_key") * pieces).cast("long")
    there = cut_lineage(sent.withColumns({"shard": shard, "_piece": piece}).drop("_part", "_at", "_cuts", "_key"), "shard-sent")
    held = there.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("shard", "_piece", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    again = Window.partitionBy("shard", "_piece").orderBy(F.xxhash64(F.lit(seed + 5), "_second"), "_second", *columns, "_copy")
    placed = there.withColumn("_row", F.row_number().over(again)).join(starts, ["shard", "_piece"])
    return placed.select(*columns, "shard", (F.col("_start") + F.col("_row") - 1).alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int = 16, seed: int = 23) -> None:
    """Whole rows, texts included, as Parquet in folders shard=0, shard=1, ...; slot gives the order, and files of a shard hold ranges of it."""
    out = shuffle(rows, shards, seed)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, shards: int = 16, seed: int = 23) -> DataFrame:
    """doc_id, size (bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard: every document in one of ``shards`` shards.

    The law is ``rows``: numbers of documents are at most one apart. Null text: no bytes, like an empty one.
    A document's shard depends on the whole table, so grown_shard is null.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return shuffle(rows, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
