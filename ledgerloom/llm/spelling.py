"""Spelling variants by a trie over letter-group counts.

A word's path in the trie is how many of its letters fall into group 0, 1, 2, ...; one
inserted, deleted or replaced letter raises at most one count by one and lowers at most
one by one. A search therefore walks down the trie with a surplus and a deficit of one
to spend, and only words at the leaves it reaches are compared letter by letter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage

from .hashing import mix

#: Levels of the trie: a code point's group is its value modulo this.
GROUPS = 16
#: The trie is cut into shards at the first of these levels at which a node holds no more than ``SHARD`` words.
CUTS = (2, 4, 6, 8, 10, 12, 14, 16)
SHARD = 8192
#: Words of a batch that are searched at once.
BATCH = 8192

_U = np.uint64
RUN = r"[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- words

def noisy_runs(docs: DataFrame) -> DataFrame:
    """Every run of letters (word), A-Z lower-cased; a run whose crc32 with its doc_id 97 divides loses a code point."""
    low = F.translate("text", UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(h % 97 == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(runs: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """word, n of the words with at least ``min_length`` code points and ``min_count`` occurrences."""
    return runs.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# --- one task's part of the trie

def group_counts(words: list[str]) -> np.ndarray:
    """Letters of each word in each group."""
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    cells = np.repeat(np.arange(len(words)), lengths) * GROUPS + codes % GROUPS
    return np.bincount(cells, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)


def child(node: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The node reached from ``node`` by ``count`` letters of the next group; the root is 0."""
    return mix(node * _U(31) + count.astype(_U) + _U(1))


class Walkers:
    """Searches on their way down: their node, whose they are, what they may still spend and the letters gained so far.

    ``budget`` is 3 with both unspent; 1 stands for the surplus, 2 for the deficit.
    """

    def __init__(self, node: np.ndarray, budget: np.ndarray, gained: np.ndarray):
        self.node, self.who, self.budget, self.gained = node, np.arange(len(node)), budget, gained

    def step(self, counts: np.ndarray, level: int) -> None:
        """Each goes on with its own count and, at a price, with one letter more or one less."""
        own = counts[self.who, level]
        parts = []
        for change, price in ((0, 0), (1, 1), (-1, 2)):
            can = (self.budget & price == price) & (own + change >= 0)
            parts.append((child(self.node[can], own[can] + change), self.who[can], self.budget[can] - price, self.gained[can] + change))
        self.node, self.who, self.budget, self.gained = map(np.concatenate, zip(*parts))

    def keep(self, which: np.ndarray) -> None:
        self.node, self.who, self.budget, self.gained = self.node[which], self.who[which], self.budget[which], self.gained[which]


def halves(word: str, length: int) -> tuple[int, int]:
    """Hashes of the first and the last half of ``word``, for pairs of which the shorter word has ``length`` letters.

    One edit leaves either the first or the last half of the shorter word as it is.
    """
    h = length // 2
    both = word[:h], word[len(word) - (length - h):]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) << 8 | side << 7 | length & 0x7F for side, x in enumerate(both))


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def _same_start(a: str, b: str) -> bool:
    h = min(len(a), len(b)) // 2
    return a[:h] == b[:h]


class Trie:
    """The words of ``homes`` (word, n, node at ``depth``) below their nodes, and by the halves of words at the leaves."""

    def __init__(self, homes: pd.DataFrame, depth: int):
        self.depth, self.words, self.n = depth, homes["word"].tolist(), homes["n"].to_numpy()
        counts, node = group_counts(self.words), homes["node"].to_numpy(np.int64).view(_U)
        self.levels = []
        for level in range(depth, GROUPS):
            node = child(node, counts[:, level])
            self.levels.append(np.unique(node))
        # For pairs with words at least as long, and with shorter ones.
        half = np.array([h for less in (0, 1) for w in self.words for h in halves(w, len(w) - less)], np.int64).reshape(2, -1, 2)
        keys = mix(node[None, :, None] ^ mix(half.view(_U)))
        owner = np.broadcast_to(np.arange(len(self.words))[None, :, None], keys.shape).ravel()
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.owner = keys.ravel()[order], owner[order]

    def candidates(self, seekers: pd.DataFrame) -> np.ndarray:
        """Pairs (row of ``seekers``, word) that share a leaf in reach and a half."""
        words, side = seekers["word"].to_numpy(), seekers["side"].to_numpy()
        counts = group_counts(words.tolist())
        w = Walkers(seekers["node"].to_numpy(np.int64).view(_U), seekers["budget"].to_numpy(np.int64), seekers["gained"].to_numpy(np.int64))
        for level in range(self.depth, GROUPS):
            w.step(counts, level)
            on = self.levels[level - self.depth]
            w.keep(on[np.minimum(np.searchsorted(on, w.node), len(on) - 1)] == w.node)
        half = np.array([halves(words[i], min(len(words[i]), len(words[i]) + g)) for i, g in zip(w.who.tolist(), w.gained.tolist())], np.int64).reshape(-1, 2)
        pairs = []
        for k in (0, 1):
            use = np.flatnonzero((side[w.who] == 0) | (side[w.who] == k + 1))
            wanted = mix(w.node[use] ^ mix(half[use, k].view(_U)))
            lo, n = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, wanted, "right")
            n = n - lo
            spot = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            pairs.append(np.stack([np.repeat(w.who[use], n), self.owner[spot]], 1))
        return np.unique(np.concatenate(pairs), axis=0)

    def near(self, seekers: pd.DataFrame) -> pd.DataFrame:
        """word, n_near, best_n, best for the seekers that have near words here.

        ``side`` is 1 or 2 where the shard holds a part of a leaf: only pairs with the same first half count, or else with the same last one.
        """
        found = []
        for begin in range(0, len(seekers), BATCH):
            part = seekers.iloc[begin:begin + BATCH]
            words, side = part["word"].tolist(), part["side"].tolist()
            for i, j in self.candidates(part).tolist():
                if one_edit(words[i], self.words[j]) and not (side[i] == 2 and _same_start(words[i], self.words[j])):
                    found.append((words[i], int(self.n[j]), self.words[j]))
        rows = pd.DataFrame(found, columns=["word", "best_n", "best"]).sort_values(["best_n", "best"], ascending=[False, True])
        return rows.groupby("word", sort=False).agg(n_near=("best", "size"), best_n=("best_n", "first"), best=("best", "first")).reset_index()


# --- the distributed trie

def _prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts, node = group_counts(batch["word"].tolist()), np.zeros(len(batch), _U)
        for level in range(GROUPS):
            node = child(node, counts[:, level])
            if level + 1 in CUTS:
                ids, n = np.unique(node.view(np.int64), return_counts=True)
                yield pd.DataFrame({"cut": level + 1, "node": ids, "words": n})


def _router(heavy: dict[int, np.ndarray], split: dict[int, int]):
    """Sends each word home (seeks false) and to every shard that its search can reach (seeks true)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            for begin in range(0, len(big), BATCH):
                words, n = (big[c].to_numpy(t)[begin:begin + BATCH] for c, t in (("word", object), ("n", np.int64)))
                counts, zeros = group_counts(words.tolist()), np.zeros(len(words), np.int64)
                w = Walkers(zeros.view(_U), zeros + 3, zeros)
                for level in range(GROUPS):
                    w.step(counts, level)
                    if level + 1 not in CUTS:
                        continue
                    node = w.node.view(np.int64)
                    there = ~np.isin(node, heavy[level + 1]) | (level + 1 == CUTS[-1])
                    rows = pd.DataFrame({"word": words[w.who].astype(object), "n": n[w.who], "budget": w.budget, "gained": w.gained, "node": node, "depth": level + 1, "side": 0, "seeks": True})[there]
                    in_parts = rows["node"].isin(split) if level + 1 == CUTS[-1] else np.zeros(len(rows), bool)
                    whole = rows[~in_parts]
                    yield whole
                    yield whole[whole["budget"] == 3].assign(seeks=False)
                    if in_parts.any():
                        yield _in_parts(rows[in_parts], split)
                    w.keep(~there)

    return run


def _in_parts(rows: pd.DataFrame, split: dict[int, int]) -> pd.DataFrame:
    """Rows of leaves too large for one task: dealt by the halves of their words."""
    out = []
    for r in rows.itertuples(index=False):
        part = lambda half: int(mix(np.array([r.node ^ (half % split[r.node] << 1 | half >> 7 & 1)], np.int64).view(_U)).view(np.int64)[0])
        for side, half in enumerate(halves(r.word, min(len(r.word), len(r.word) + r.gained))):
            out.append(r._replace(side=side + 1, node=part(half)))
        if r.budget == 3:
            homes = {(side + 1, part(half)) for less in (0, 1) for side, half in enumerate(halves(r.word, len(r.word) - less))}
            out += [r._replace(side=side, node=node, seeks=False) for side, node in homes]
    return pd.DataFrame(out, columns=rows.columns)


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket of shards. Nodes are hashes of whole paths, so shards do not mix."""
    found = [pd.DataFrame({"word": [], "n_near": [], "best_n": [], "best": []}, dtype=object)]
    for _, group in rows.groupby(["depth", "side"]):
        homes = group[~group["seeks"]].reset_index(drop=True)
        seekers = group[group["seeks"] & group["node"].isin(homes["node"])].reset_index(drop=True)
        if len(seekers):
            found.append(Trie(homes, int(homes["depth"].iloc[0])).near(seekers).astype(object))
    return pd.concat(found)


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """The words of ``words`` (word, n; distinct, not null) that have near words: word, n_near, best, best_n.

    Two words are near if one inserted, deleted or replaced code point makes one of the other; best is the near word with the largest
    n, the first in code-point order among equals. The trie is cut where its nodes hold ``shard`` words at most; the nodes
    above the cuts are known to all tasks (each has more words than that, so they are at most len(CUTS) / ``shard`` of the words).
    A pair is found from each side, in the shard where the other word lives, and only counts and the best leave a shard.
    A leaf with more than ``shard`` words (all with equal counts) is dealt by hashes of halves of its words, as one edit leaves one half as it is.
    """
    sizes = words.mapInPandas(_prefixes, "cut int, node long, words long").groupBy("cut", "node").agg(F.sum("words").alias("words"))
    large = sizes.where(F.col("words") > shard).toPandas()
    heavy = {cut: np.sort(large.loc[large["cut"] == cut, "node"].to_numpy(np.int64)) for cut in CUTS}
    split = {int(r.node): -(-int(r.words) // shard) for r in large.itertuples() if r.cut == CUTS[-1]}
    routed = words.mapInPandas(_router(heavy, split), "word string, n long, budget int, gained int, node long, depth int, side int, seeks boolean")
    buckets = max(1, -(-words.count() // shard))
    bucket = F.pmod("node", F.lit(buckets)).alias("bucket")
    found = routed.groupBy("depth", bucket).applyInPandas(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "b.best", (-F.col("b.minus")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the rows of ``forms`` (word, form) that have a form: where following forms ends. No word may lead back to itself.

    Every round each word takes the form of its form, so the rounds grow with the logarithm of the longest chain.
    """
    links = cut_lineage(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut_lineage(links.join(further, "root", "left").select("word", "root", "further"), "spelling-links")
        if not moved.where("further is not null").limit(1).count():
            return moved.select("word", "root")
        links = moved.select("word", F.coalesce("further", "root").alias("root"))


def variants(words: DataFrame, ratio: int = 2, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n for ``words`` (word, n).

    A word's form is its best near word if that occurs at least ``ratio`` (over 1) times as often; root is where forms lead.
    """
    words = cut_lineage(words, "spelling-words")
    near = cut_lineage(near_words(words, shard), "spelling-near")
    has = F.col("best_n") >= ratio * F.col("n")
    forms = cut_lineage(words.join(near, "word", "left").select(
        "word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")
    ), "spelling-forms")
    ends = roots(forms)
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame) -> DataFrame:
    """The spelling variants among the words of ``docs`` (doc_id, text).

    Null, empty and wordless texts give no words; a null doc_id loses no letters. Repeated rows count again. Empty table: no rows.
    Runs of any length are words, so very long ones are compared like others. Further columns are ignored.
    """
    return variants(vocabulary(noisy_runs(docs)))
