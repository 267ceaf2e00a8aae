"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage, scratch_path

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds``; a null id is in no fold (-1)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int"), F.lit(-1))


def range_sorted(df: DataFrame, order: list[Column], label: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in a global order, cut into ranges that are written once, and the ranges' sizes.

    Adds ``_range`` and ``_row`` (1, 2, ... inside the range). A key with a third of
    the rows is spread over many ranges when ``order`` ends in a unique column. The
    second table has one row per range: ``_range``, ``_before`` (rows of earlier ranges).
    """
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    names = [f"_o{i}" for i in range(len(order))]
    written = cut_lineage(keyed.repartitionByRange(*names).withColumn("_range", F.spark_partition_id()), label)
    inside = Window.partitionBy("_range").orderBy(*names)
    rows = written.withColumn("_row", F.row_number().over(inside)).drop(*names)
    # One row per range of the sort, so as many as there were shuffle partitions.
    sizes = written.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return rows, sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


#: Rows in a block of ``row_blocks`` as a power of two, and bytes of text in a bucket.
BLOCK_BITS, BUCKET = 9, 4 << 20


def row_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` in a table bucketed by ``row_block``, with a number ``row_id`` for each row. Only rows of one input partition share a block, so nothing is shuffled."""
    spark = df.sparkSession
    path = scratch_path(spark, "row-blocks")
    name = "row_blocks_" + path.rsplit("-", 1)[1]
    rows = df.withColumn("row_id", F.monotonically_increasing_id()).withColumn("row_block", F.shiftright("row_id", BLOCK_BITS))
    total = df.select(F.sum(F.octet_length(text))).first()[0] or 0
    # With fewer buckets than shuffles have partitions, Spark would shuffle both sides of a join.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    rows.write.bucketBy(buckets, "row_block").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def from_blocks(blocks: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """``blocks`` of ``row_blocks`` with the columns ``names`` of ``values``, which has each row_id once: they come as one array per block, and the rows stay where they are."""
    cells = values.groupBy(F.shiftright("row_id", BLOCK_BITS).alias("row_block")).agg(F.sort_array(F.collect_list(F.struct("row_id", *names))).alias("_cells"))
    at = F.col("row_id").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    found = blocks.join(cells.hint("shuffle_hash"), "row_block").withColumn("_cell", F.get("_cells", at))
    return found.withColumns({n: F.col("_cell")[n] for n in names}).drop("_cells", "_cell")


#: Bits of a key filter: 16 MB, however many keys there are.
FILTER_BITS = 1 << 27
#: Words of 64 bits in a piece of a key filter; the driver takes in the pieces of one partition at a time.
PIECE_WORDS = 1 << 12


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for every key (a 64-bit hash) of ``column``. Pieces of it are made on the executors; all that come here are ``FILTER_BITS`` bits."""
    k = F.col(column)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))
    words = keys.groupBy(F.shiftright(k.bitwiseAND(FILTER_BITS - 1), 6).alias("at")).agg(F.bit_or(bit).alias("bits"))

    def piece(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["at"].to_numpy(np.int64)
        part = np.zeros(PIECE_WORDS, np.int64)
        part[at % PIECE_WORDS] = rows["bits"].to_numpy(np.int64)
        return pd.DataFrame({"first": [at[0] - at[0] % PIECE_WORDS], "part": [part.tobytes()]})

    pieces = words.groupBy((F.col("at") / PIECE_WORDS).cast("long").alias("_piece")).applyInPandas(piece, "first long, part binary")
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for row in pieces.toLocalIterator():
        out[row["first"] : row["first"] + PIECE_WORDS] = np.frombuffer(row["part"], np.uint64)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that the filter was not made of; more keys than it has bits for make it let others through as well."""
    at = keys.astype(np.int64) & (FILTER_BITS - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b): columns ``node``, ``component`` (its smallest node).

    Smallest labels travel along the edges and then jump to the label of their label,
    so the rounds grow with the logarithm of a component's width. Each round is written
    to the shared folder; a node with very many edges is a key that Spark can split,
    since both sides of each join are plain scans, and its minimum is taken map-side first.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{label}-edges")
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), label)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hop = cut_lineage(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")), label)
        jump = hop.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        new = cut_lineage(hop.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("jump", "component")).alias("component")), label)
        moved = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
