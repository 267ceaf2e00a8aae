"""N-gram Jaccard join by count vectors.

Shingles are hashed into groups and a document is the point of its group counts. The
overlap of two documents is at most the sum of the coordinate minima of their points, which an
R-tree over the points bounds for whole subtrees; surviving pairs are verified on the shingles.

Dealing. Documents that link differ in at most D = (|A| + |B|) (1 - t) / (1 + t)
shingles. The fine count vector (GROUPS coordinates) is cut into more than D
blocks, so some block of the two is equal; documents with an equal block share a cell. Cells
with two different documents or more are merged by the smallest document in them, and
each merged cell gets its own R-tree. No link can be missed, and documents without a partner meet nobody.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage

from .common import connected, key_filter, may_hold
from .hashing import mix, shingles

_U = np.uint64
#: Coordinates of the dealing vector in a block, coordinates of the R-tree's points, children of a node.
GROUPS, DIMS, FANOUT = 1 << 16, 64, 16
#: Coordinates of the points that pairs out of the R-tree are bounded by once more.
FINE = 1024
#: Documents, and their shingles, that one task joins at once; documents that every task of a larger group gets.
MEMBERS, SHINGLES, PIVOTS = 256, 500_000, 8
#: Members of a cluster whose points one task compares at once, coordinates of the largest points that travel.
COMPANY, WIDEST = 2048, 4096
#: Texts whose sets a task holds at once, cells that it hands on at once.
TEXTS, CELLS = 512, 1 << 17
#: Ratio of the bounds of a size band.
BAND = 1.5


@dataclass(frozen=True)
class Rule:
    """Two sets link when ``den`` times their intersection is at least ``num`` times their union."""

    words: int = 3
    num: int = 90
    den: int = 100

    def most_apart(self, sizes: int) -> int:
        """Largest symmetric difference of linked sets whose sizes add up to ``sizes``."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def least_shared(self, sizes):
        """Smallest intersection of linked sets whose sizes add up to ``sizes``."""
        return -(-sizes * self.num // (self.den + self.num))

    def largest(self, n: int) -> int:
        """Largest size of a set that links with one of ``n``."""
        return n * self.den // self.num

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        """``a`` and ``b`` are sorted and distinct."""
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
        return self.den * both >= self.num * (len(a) + len(b) - both)

    def bands(self, n: int) -> list[tuple[int, int]]:
        """Bands (number, largest size) in which a set of ``n`` can meet a partner: those of all sizes from ``n`` to ``largest(n)``."""
        out, top, low, number = [], self.largest(n), 1, 0
        while low <= top:
            high = max(low, self.largest(low), int(low * BAND))
            if high >= n:
                out.append((number, high))
            low, number = high + 1, number + 1
        return out


def signature(own: np.ndarray) -> int:
    """Stands for a whole set (64 bits)."""
    total = (int(own.sum(dtype=_U)) + len(own) * 0x9E3779B97F4A7C15) % (1 << 64)
    return int(mix(np.array([total], _U)).view(np.int64)[0])


def point(own: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Group counts of a set: its point in the R-tree."""
    return np.bincount((own >> _U(40)).astype(np.int64) % dims, minlength=dims).astype(np.uint32)


def dims_of(n: int) -> int:
    """Coordinates of the point that travels for a set of ``n``: 2 to 4 shingles each, as far as WIDEST goes. With more, unlike sets look alike."""
    return min(WIDEST, max(DIMS, 1 << ((n - 1) // 4).bit_length()))


def packed(own: np.ndarray) -> bytes:
    """The point of a set, in the narrowest integers that hold it."""
    at = point(own, dims_of(len(own)))
    return at.astype(np.min_scalar_type(int(at.max(initial=0)))).tobytes()


def unpacked(raws, sizes: np.ndarray) -> np.ndarray:
    """``packed`` points of sets of these sizes, folded to the coordinates of the smallest: a power of two divides the next one."""
    dims, out = dims_of(int(sizes.min())), []
    for raw, n in zip(raws, sizes.tolist()):
        wide = dims_of(n)
        at = np.frombuffer(raw, f"u{len(raw) // wide}")
        out.append(at if wide == dims else at.reshape(-1, dims).sum(axis=0, dtype=np.uint32))
    points = np.stack(out)
    return points.astype(np.min_scalar_type(int(points.max())))


# A plain dictionary: a cached function could not travel to the executors by value.
_starts: dict[int, np.ndarray] = {}


def _block_starts(blocks: int) -> np.ndarray:
    """Where each of ``blocks`` equal ranges of 64-bit hashes starts."""
    if blocks not in _starts:
        if len(_starts) > 4096:
            _starts.clear()
        _starts[blocks] = np.array([(i << 64) // blocks for i in range(blocks)], _U)
    return _starts[blocks]


def block_keys(own: np.ndarray, rule: Rule) -> np.ndarray:
    """Cells of a set (sorted hashes): per band, a key of the counts in each block.

    With D differences, at least 1 + E of the first D + 1 + E blocks are equal. Blocks without a
    shingle say little, so they are left out unless more than E of them are empty, when both documents keep them.
    """
    n, keys = len(own), []
    weight = mix((own & _U(GROUPS - 1)) + _U(1))  # the group's random weight: a block's key is linear in its counts
    for number, high in rule.bands(n):
        most = rule.most_apart(2 * high)
        lone = (most + 1) * np.exp(-(high / BAND) / (most + 1))
        spare = int(lone + 3 * np.sqrt(lone)) if most else 0
        blocks = most + 1 + spare
        # hashes are sorted, so a block is a run of them
        at = np.searchsorted(own, _block_starts(blocks))
        use = rule.most_apart(n + min(high, rule.largest(n))) + 1 + spare
        sums = np.concatenate([[_U(0)], np.cumsum(weight, dtype=_U)])
        ends = np.append(at[1:], n)[:use]
        total, filled = sums[ends] - sums[at[:use]], ends > at[:use]
        keep = filled if (~filled).sum() <= spare else np.ones(len(filled), bool)
        salt = np.arange(len(total), dtype=_U) * _U(0xA0761D6478BD642F) + _U((number * 0xD6E8FEB86659FD93) % (1 << 64))
        keys.append(mix(mix(total) + salt)[keep])
    return np.concatenate(keys)


class RTree:
    """Points packed into nodes that hold their coordinates' maxima and range of sizes; level 0 are the points."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.array(self._pack(points, np.arange(len(points))), np.int64)
        self.ids = order
        self.high = [points[order]]
        self.low_n, self.high_n = [sizes[order]], [sizes[order]]
        while len(self.high[-1]) > FANOUT:
            cut = np.arange(0, len(self.high[-1]), FANOUT)
            self.high.append(np.maximum.reduceat(self.high[-1], cut))
            self.low_n.append(np.minimum.reduceat(self.low_n[-1], cut))
            self.high_n.append(np.maximum.reduceat(self.high_n[-1], cut))

    def _pack(self, points: np.ndarray, ids: np.ndarray) -> list[int]:
        """Halve along the widest coordinate until a node is full."""
        if len(ids) <= FANOUT:
            return ids.tolist()
        own = points[ids]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        ids = ids[np.argsort(own[:, axis], kind="stable")]
        half = FANOUT * max(1, len(ids) // FANOUT // 2)
        return self._pack(points, ids[:half]) + self._pack(points, ids[half:])

    def search(self, point: np.ndarray, n: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """Points whose bound reaches the overlap that a link needs, and the bounds."""
        at = np.arange(len(self.high[-1]))
        for level in range(len(self.high) - 1, -1, -1):
            bound = np.minimum(self.high[level][at], point).sum(axis=1)
            fits = (bound >= rule.least_shared(n + self.low_n[level][at])) & (self.high_n[level][at] * rule.den >= n * rule.num) & (self.low_n[level][at] * rule.num <= n * rule.den)
            at, bound = at[fits], bound[fits]
            if level:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.high[level - 1])]
        return self.ids[at], bound


def link(sets: list[np.ndarray], labels: list[int], rule: Rule, ask: list[int] | None = None) -> np.ndarray:
    """Component number of each set after adding the links among them.

    ``labels`` are components known before. Only the sets in ``ask`` (default: all) look for partners. A pair already
    connected is not verified, and the pair with the largest bound goes first, so a group of copies costs about one check per document.
    """
    _, comp = np.unique(np.array(labels, np.int64), return_inverse=True)
    sizes = np.array([len(s) for s in sets], np.int64)
    points = np.stack([point(s) for s in sets])
    tree = RTree(points, sizes)
    fine = np.stack([point(s, FINE) for s in sets])
    for i in range(len(sets)) if ask is None else ask:
        near, _ = tree.search(points[i], int(sizes[i]), rule)
        near = near[comp[near] != comp[i]]
        if not len(near):
            continue
        # The same bound on finer groups, where sets of unlike texts hardly meet.
        bound = np.minimum(fine[near], fine[i]).sum(axis=1)
        fits = bound >= rule.least_shared(int(sizes[i]) + sizes[near])
        near = near[fits][np.argsort(-bound[fits], kind="stable")]
        while True:
            near = near[comp[near] != comp[i]]
            if not len(near):
                break
            j, near = near[0], near[1:]
            if rule.links(sets[i], sets[j]):
                comp[comp == comp[j]] = comp[i]
    return comp


def _deal(docs: DataFrame, rule: Rule, among=None) -> DataFrame:
    """The cells of every document; with ``among`` (a broadcast key filter) hardly any but those it was made of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, nodes, seen, size = [], [], set(), 0
            for text in pdf["text"]:
                own = shingles(text, rule.words)
                if len(own) and (node := signature(own)) not in seen:
                    seen.add(node)
                    mine = block_keys(own, rule).view(np.int64)
                    keys.append(mine if among is None else mine[may_hold(among.value, mine)])
                    nodes.append(np.full(len(keys[-1]), node))
                    size += len(keys[-1])
                if size >= CELLS:
                    yield pd.DataFrame({"cell": np.concatenate(keys), "node": np.concatenate(nodes)})
                    keys, nodes, size = [], [], 0
            if keys:
                yield pd.DataFrame({"cell": np.concatenate(keys), "node": np.concatenate(nodes)})

    return docs.select("text").mapInPandas(run, "cell long, node long")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text and the columns of ``wanted`` (a row per doc_id). Few documents are wanted, so a key filter lets the others go before texts move."""
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(wanted.select(F.xxhash64("doc_id").alias("k")), "k"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[may_hold(bits.value, pdf.pop("k").to_numpy(np.int64))]

    kind = dict(docs.dtypes)["doc_id"]
    found = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("k")).mapInPandas(run, f"doc_id {kind}, text string")
    return found.join(wanted, "doc_id")


def _company(rule: Rule):
    """Of rows sorted by cluster, those whose point another member's point comes close enough to. Only the last cluster of a batch is held over."""

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        cluster, sizes = rows["cluster"].to_numpy(), rows["n"].to_numpy(np.int64)
        raws = rows["point"].to_numpy()
        starts = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1]))
        keep = np.zeros(len(rows), bool)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            if e - s == 1:
                continue
            points, own = unpacked(raws[s:e], sizes[s:e]), sizes[s:e]
            if e - s == 2:
                keep[s:e] = int(np.minimum(*points).sum()) >= rule.least_shared(int(own.sum()))
                continue
            tree = RTree(points, own)
            for i in range(e - s):
                keep[s + i] = len(tree.search(points[i], int(own[i]), rule)[0]) > 1  # itself is one
        return rows.loc[keep, ["cluster", "node", "n"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(rows):
                continue
            last = rows["cluster"].to_numpy() == rows["cluster"].iloc[-1]
            held, done = rows[last], rows[~last].reset_index(drop=True)
            if len(done):
                yield close(done)
        if held is not None and len(held):
            yield close(held.reset_index(drop=True))

    return run


def _close_calls(rule: Rule):
    """Of a part of a large cluster and of those outside its largest piece: the askers with a close point of another piece, and those points."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sizes, labels = rows["n"].to_numpy(np.int64), rows["label"].to_numpy()
        points = unpacked(rows["point"], sizes)
        tree, keep = RTree(points, sizes), np.zeros(len(rows), bool)
        for i in np.flatnonzero(rows["ask"].to_numpy(bool)):
            near = tree.search(points[i], int(sizes[i]), rule)[0]
            near = near[labels[near] != labels[i]]
            keep[near] = True
            keep[i] |= len(near) > 0
        return rows.loc[keep, ["cluster", "part", "rest", "node", "label", "ask"]]

    return run


def _joiner(rule: Rule):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        sets = [shingles(t, rule.words) for t in rows["text"]]
        # a doc_id that stands on rows with different texts brings all of them; the node says which one is meant
        own = np.array([signature(s) for s in sets]) == rows["node"].to_numpy()
        own &= ~rows["node"].where(own).duplicated().to_numpy()
        sets, rows = [s for s, ok in zip(sets, own) if ok], rows[own]
        if not sets:
            return pd.DataFrame({"a": [], "b": []})
        nodes, labels = rows["node"].to_numpy(), rows["label"].to_numpy()
        ask = None if rows["ask"].all() else np.flatnonzero(rows["ask"]).tolist()
        comp = link(sets, labels.tolist(), rule, ask)
        first = pd.Series(nodes).groupby(comp).transform("min").to_numpy()
        moved = first != nodes
        return pd.DataFrame({"a": nodes[moved], "b": first[moved]})

    return run


def components(docs: DataFrame, rule: Rule = Rule(), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``keep``, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable by links, the document's own included. Documents with one and the same set are one node, so
    copies cost a hash each. Null, empty or blank text: no shingle, no link, its own component. Null doc_id: the row follows
    rows with the same set; a set that only such rows have links with nothing and has no component. Repeated rows share a component. An empty table gives no
    rows; extra columns are ignored; texts are taken whole. Sets are told apart by 64-bit hashes.
    """
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (batch.iloc[at : at + TEXTS] for batch in batches for at in range(0, len(batch), TEXTS)):
            sets = [shingles(t, rule.words) for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(n_shingles=[len(s) for s in sets], node=[signature(s) for s in sets], point=[packed(s) for s in sets])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep))
    rows = cut_lineage(docs.select("doc_id", *keep, "text").mapInPandas(measure, f"{schema}, n_shingles long, node long, point binary"), "jaccard-sets")

    # Cells of two different documents or more, named after their smallest.
    met = _deal(docs, rule).groupBy("cell").agg(F.min("node").alias("cluster"), F.max("node").alias("_other")).where("cluster < _other").select("cell", "cluster")
    met = cut_lineage(met, "jaccard-cells")
    # Most cells are met by one document alone: the second time round a key filter leaves them out, so that little but real meetings moves.
    among = docs.sparkSession.sparkContext.broadcast(key_filter(met, "cell"))
    dealt = cut_lineage(_deal(docs, rule, among).join(met, "cell").select("cluster", "node").distinct(), "jaccard-dealt")

    # The points of the documents that meet others, and one doc_id to read each of their texts by.
    holder = rows.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.first("point").alias("point"))
    active = cut_lineage(holder.join(dealt.select("node").distinct(), "node", "left_semi"), "jaccard-active")
    members = dealt.join(active.select("node", "n"), "node")
    crowds = cut_lineage(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "jaccard-crowds")
    placed = members.join(crowds, "cluster")

    # Chance meetings end here: only members that some other member's point is close to go on, without any text moved. A cluster too large for one task goes on whole.
    one_task = F.col("members") <= COMPANY
    single = placed.where(one_task).join(active.select("node", "point"), "node").select("cluster", "node", "n", "point")
    close = single.repartition("cluster").sortWithinPartitions("cluster").mapInPandas(_company(rule), "cluster long, node long, n long")
    close = cut_lineage(close.unionByName(placed.where(~one_task).select("cluster", "node", "n")), "jaccard-near")
    one = F.lit(1).cast("long")
    parts = F.greatest(F.ceil(F.col("members") / MEMBERS), F.ceil(F.col("shingles") / SHINGLES))
    sizes = close.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).select("cluster", "members", parts.alias("parts"))
    kept = cut_lineage(close.select("cluster", "node").join(sizes, "cluster"), "jaccard-kept")

    # A document of a group of near copies is in a few clusters. It is joined in the first one only;
    # where that leaves another cluster in pieces, the cluster is looked at again.
    home = kept.join(kept.groupBy("node").agg(F.min("cluster").alias("cluster")), ["node", "cluster"], "left_semi")
    wanted = cut_lineage(active.select("node", "doc_id").join(home, "node"), "jaccard-wanted")
    # Texts of those that are left. Rows of one doc_id are in one task already, so equal ones go without another shuffle.
    read = _texts_of(docs, wanted).dropDuplicates(["doc_id", "node", "text"])
    texts = cut_lineage(read.select("node", "text", "cluster", "members", "parts"), "jaccard-texts")
    chosen = (F.col("parts") > 1) & (F.pmod(F.xxhash64("node", F.lit(3)), F.greatest(one, F.floor(F.col("members") / PIVOTS))) == 0)
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    spread = texts.withColumn("part", F.explode(F.when(chosen, everywhere).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("parts"))))))
    local = spread.select("cluster", "part", "node", "text", F.col("node").alias("label"), F.lit(True).alias("ask"))
    texts = texts.select("node", "text")
    edges = cut_lineage(local.groupBy("cluster", "part").applyInPandas(_joiner(rule), "a long, b long").distinct(), "jaccard-edges")
    labels = connected(edges, "jaccard-components")

    at_home = home.select("node", "cluster", F.lit(True).alias("home"))
    named = kept.where("parts = 1").join(at_home, ["node", "cluster"], "left").join(labels, "node", "left")
    named = cut_lineage(named.select("cluster", "node", "home", F.coalesce("component", "node").alias("label")), "jaccard-again")
    open_ = named.groupBy("cluster").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("home").alias("n"), F.count(F.lit(1)).alias("m")).where("l < h and n < m")
    again = named.join(cut_lineage(open_.select("cluster"), "jaccard-open"), "cluster", "left_semi").drop("home")
    again = again.join(texts, "node").withColumns({"part": F.lit(0).cast("long"), "ask": F.lit(True)})
    found = cut_lineage(again.groupBy("cluster", "part").applyInPandas(_joiner(rule), "a long, b long").distinct(), "jaccard-edges")
    if found.limit(1).count():
        edges = edges.union(found)
        labels = connected(edges, "jaccard-components")

    # Groups of more than one part that are still in pieces: who is outside the largest piece meets every member.
    large = kept.where("parts > 1").select("cluster", "node", "parts")
    if large.limit(1).count():
        named = cut_lineage(large.join(labels, "node", "left").select("cluster", "parts", "node", F.coalesce("component", "node").alias("label")), "jaccard-large")
        pieces = named.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
        whole = pieces.groupBy("cluster").agg(F.max_by("label", "n").alias("main"), F.sum("n").alias("all"), F.max("n").alias("top")).where("all > top")
        rest_parts = F.ceil((F.col("all") - F.col("top")) / MEMBERS)
        whole = cut_lineage(whole.select("cluster", "main", rest_parts.alias("rest_parts")), "jaccard-pieces")
        split = named.join(whole, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        outside = F.col("label") != F.col("main")
        members = split.withColumn("rest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_parts") - 1))).withColumn("ask", F.lit(False))
        rest = split.where(outside).withColumns({"rest": F.pmod(F.xxhash64("node", F.lit(5)), F.col("rest_parts")), "ask": F.lit(True)})
        rest = rest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        cols = ["cluster", "part", "rest", "node", "label", "ask"]
        both = members.select(cols).unionByName(rest.select(cols)).groupBy(*cols[:5]).agg(F.max("ask").alias("ask"))
        near = both.join(active.select("node", "n", "point"), "node").groupBy("cluster", "part", "rest")
        near = cut_lineage(near.applyInPandas(_close_calls(rule), "cluster long, part long, rest long, node long, label long, ask boolean"), "jaccard-close")
        more = near.join(texts, "node").groupBy("cluster", "part", "rest").applyInPandas(_joiner(rule), "a long, b long")
        more = cut_lineage(more.distinct(), "jaccard-more")
        if more.limit(1).count():
            labels = connected(edges.union(more), "jaccard-components")

    # Smallest doc_id of each component, then of each node.
    named = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = cut_lineage(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    of_node = cut_lineage(named.select("node", "component").join(least, "component").select("node", "component_id"), "jaccard-named")
    out = rows.join(of_node, "node", "left")
    return out.select("doc_id", *keep, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
