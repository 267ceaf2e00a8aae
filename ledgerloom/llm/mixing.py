"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage

from .common import range_sorted, word_count

SETTLED = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, limit: float = 3.0) -> DataFrame:
    """Target of each source: source, n_docs, source_size, target.

    ``sizes`` has source and size. Sources in code point order, null last, take ``weights``
    in turn and share ``share`` of all sizes; a target stops at ``limit`` times its
    source's size and the excess is shared again by weight. Only scalars reach the driver.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    ranked, before = range_sorted(per, [F.col("source").isNull(), F.col("source")], "mix-sources")
    turn = F.pmod(F.col("_row") + F.col("_before") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    src = cut_lineage(ranked.join(before, "_range").select("source", "n_docs", "source_size", weight.alias("weight")), "mix-weights")
    cap = F.col("source_size") * F.lit(float(limit))
    total, weight_sum = src.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rate, stopped = (share * total / weight_sum if weight_sum else 0.0), 0
    while weight_sum:
        above = cap < F.col("weight") * F.lit(rate)
        n, full, free = src.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == stopped or not free:  # all stopped: every target is its limit
            break
        rate, stopped = max(rate, (share * total - full) / free), n
    return src.select("source", "n_docs", "source_size", F.least(cap, F.col("weight") * F.lit(float(rate))).alias("target"))


def round_block(size: list[int], p: list[float], rng) -> tuple[list[float], int | None]:
    """Pivotal rounding of one block: the carried unit meets the next one and mass (in words) moves between them.

    The move goes either way with the odds that keep both expectations, until one
    probability is 0 or 1; words in the block stay equal. Returns the probabilities and
    the index of the one left fractional, if any.
    """
    p, carry = list(p), None
    for j in range(len(p)):
        if not SETTLED < p[j] < 1 - SETTLED:
            p[j] = float(round(p[j]))
            continue
        if carry is None:
            carry = j
            continue
        i, wi, wj = carry, size[carry], size[j]
        to_i, to_j = min(wi * (1 - p[i]), wj * p[j]), min(wi * p[i], wj * (1 - p[j]))
        move = to_i if rng.random() * (to_i + to_j) < to_j else -to_j
        p[i], p[j] = p[i] + move / wi, p[j] - move / wj
        carry = None
        for k in (i, j):
            if SETTLED < p[k] < 1 - SETTLED:
                carry = k
            else:
                p[k] = float(round(p[k]))
    return p, carry


def _block_rounder(seed: int, level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import random

        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], na_position="last", kind="stable").reset_index(drop=True)
        first = rows.iloc[0]
        rng = random.Random(xxhash.xxh64_intdigest(f"{seed}|{level}|{first['source']!r}|{first['block']}".encode()))
        p, left = round_block(rows["size"].tolist(), rows["p"].tolist(), rng)
        if left is not None and first["blocks"] == 1:  # the root of the source's tree
            p[left] = float(rng.random() < p[left])
        rows["p"] = p
        return rows

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, limit: float = 3.0, seed: int = 17, block: int = 256, keep: tuple[str, ...] = (), size: Column | None = None) -> DataFrame:
    """Copies of each document so that every source's words come to its target.

    Returns doc_id, the columns in ``keep``, source, size, source_size, target, copies, taken (copies times size), one row
    per row of ``docs``. Each source's rate (target over size) splits into whole copies and a fractional one;
    the fractions are rounded by a reduction tree: blocks of about ``block`` documents settle all but
    one of their documents, whose residuals meet in the next level. A source misses its target by less than one document.

    Null text or no word: size 0, nothing taken. Null source: a source of its own, last. Null doc_id: dealt
    like any other. Repeated rows are rounded one by one. Empty table: no rows. Extra columns are ignored.
    Draws depend on ``seed`` and the ids alone, so reruns and retried tasks agree. ``size`` takes word counts that are there already; the text is not read then.
    """
    sizes = cut_lineage(docs.select("doc_id", *keep, "source", (word_count(F.col("text")) if size is None else size).alias("size")), "mix-sizes")
    src = cut_lineage(source_targets(sizes, weights, share, limit), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    to = src.select(F.col("source").alias("_s"), "n_docs", "source_size", "target", rate.alias("rate"))
    rows = sizes.join(to, sizes["source"].eqNullSafe(F.col("_s"))).drop("_s").withColumns({
        "whole": F.floor(F.col("rate") + F.lit(SETTLED)),
        "blocks": F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_docs") / F.lit(block))),
    }).withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))).otherwise(0.0)).drop("rate", "n_docs")
    is_open = (F.col("p") > SETTLED) & (F.col("p") < 1 - SETTLED)
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", "size"), F.lit(seed)), F.col("blocks")))
    level = 0
    done = [rows.where(~is_open)]
    todo = rows.where(is_open)
    while True:
        rounded = cut_lineage(todo.groupBy("source", "block").applyInPandas(_block_rounder(seed, level), rows.schema), "mix-level")
        done.append(rounded.where(~is_open))
        left = rounded.where(is_open)
        if not left.limit(1).count():
            break
        level += 1
        blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("blocks") / F.lit(block)))
        todo = left.withColumn("blocks", blocks).withColumn("block", F.pmod(F.col("block"), F.col("blocks")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = (F.col("whole") + F.round("p")).cast("long")
    return out.select("doc_id", *keep, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
