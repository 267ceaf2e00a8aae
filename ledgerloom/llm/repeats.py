"""Suffix-array dedup: remove byte strings that also start in an earlier document.

Every window of ``need`` bytes belongs to the smallest gram hash in it, so equal windows of any two documents have
the same one. The windows of a run with one smallest gram form a segment, and segments are dealt by that gram. A segment
whose whole content an earlier document has too goes at once; the first holder of each other content sends
it to a shard, where the suffixes of all contents of a gram are sorted together by external induced sorting
and windows whose neighbours share ``need`` bytes are compared by document. A gram with more contents than a
part of a shard sends none: its windows are compared one by one by their hash, each once per block, so a passage
that stands in very many documents fills no shard.

Documents are written once into blocks of some MB, in a table bucketed by block, so that
later passes join to their block without moving the texts again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage, scratch_path

from .hashing import mix
from .suffixes import sort_suffixes

_U = np.uint64
#: Bytes of a window, bytes of a gram, bytes of a block of documents, bytes worked on at once, bytes of contents in a shard.
NEED, GRAM, BLOCK, PIECE, SHARD = 50, 16, 4 << 20, 1 << 19, 4 << 20
#: A gram whose contents are more than this part of a shard is split into its windows.
HEAVY = 4

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def segments(raw: np.ndarray, ends: np.ndarray, need: int = NEED, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of texts laid end to end: first window, last window, gram hash and content hash of each.

    ``ends`` are the texts' ends in ``raw``. No window reaches over an end. The bytes from the first window to ``need`` after the last are the content.
    """
    n = len(raw) - need + 1
    if n <= 0:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U))
    back = _geometric(_BACK, len(raw) + 1)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE[raw] * _geometric(_BASE, len(raw)), out=total[1:])
    low = mix((total[gram:] - total[:-gram]) * back[: len(raw) - gram + 1])
    span, width = need - gram + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: n], low[span - width : span - width + n])
    inside = np.ones(len(raw) + need, bool)  # windows that cross an end are out
    cross = np.zeros(len(raw) + need + 1, np.int32)
    np.add.at(cross, np.maximum(ends - need + 1, 0), 1)
    np.add.at(cross, ends, -1)
    inside = np.cumsum(cross)[:n] == 0
    change = np.ones(n, bool)
    change[1:] = (low[1:] != low[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    if not len(first):
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U))
    stop = np.flatnonzero(np.append(change[1:] | ~inside[1:], True) & inside)
    content = (total[stop + need] - total[first]) * back[first]
    return first, stop, low[first], mix(content + (stop - first).astype(_U) * _U(0xA0761D6478BD642F))


def block_segments(texts: list[bytes], docs: np.ndarray, need: int = NEED) -> pd.DataFrame:
    """Segments of a block: row (position in the block), first, last (windows in the text), gram, content, doc. A long text is cut into pieces that overlap by a window."""
    out, batch, size = [], [], 0

    def run() -> None:
        nonlocal size
        if batch:
            raw = np.frombuffer(b"".join(b for _, _, b in batch), np.uint8)
            ends = np.cumsum([len(b) for _, _, b in batch])
            first, stop, gram, content = segments(raw, ends, need)
            of = np.searchsorted(ends, first, side="right")
            rows = np.array([r for r, _, _ in batch])
            shift = np.array([base for _, base, _ in batch]) - np.append(0, ends[:-1])
            out.append(pd.DataFrame({
                "row": rows[of], "first": first + shift[of], "last": stop + shift[of], "gram": gram.view(np.int64), "content": content.view(np.int64), "doc": docs[rows[of]],
            }))
            batch.clear()
            size = 0

    for row, text in enumerate(texts):
        if text is None or len(text) < need:
            continue
        for base in range(0, max(1, len(text) - need + 1), PIECE):
            part = text[base : base + PIECE + need - 1]
            batch.append((row, base, part))
            size += len(part)
            if size >= PIECE:
                run()
    run()
    if not out:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "first", "last", "gram", "content", "doc")})
    return pd.concat(out, ignore_index=True)


def in_blocks(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The documents in a table bucketed by block: doc_id, text, the columns in ``keep``, block. Only whole rows of one input partition share a block, so nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, size = TaskContext.get().partitionId() << 24, 0
        for pdf in batches:
            length = pdf["text"].str.len().fillna(0).to_numpy(np.int64)
            number = block + (size + np.cumsum(length)) // BLOCK
            size += int(length.sum())
            yield pdf.assign(block=number)

    spark = docs.sparkSession
    path = scratch_path(spark, "repeat-blocks")
    name = "blocks_" + path.rsplit("-", 1)[1]
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", "text", *keep))
    rows = docs.select("doc_id", "text", *keep).mapInPandas(run, f"{schema}, block long")
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-total // BLOCK))
    rows.write.bucketBy(buckets, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _ids(pdf: pd.DataFrame) -> np.ndarray:
    """Document ids as integers; rows without one hold no text here."""
    return pdf["doc_id"].fillna(0).to_numpy(np.int64)


def _texts(pdf: pd.DataFrame) -> list[bytes | None]:
    """Texts that take part: those of rows with an id."""
    return [None if t is None or none else t.encode("utf-8", "surrogatepass") for t, none in zip(pdf["text"], pdf["doc_id"].isna())]


def _least(own: pd.DataFrame) -> np.ndarray:
    """Smallest document of the block with the same content (so the same gram), for each segment."""
    return own.groupby("content", sort=False)["doc"].transform("min").to_numpy() if len(own) else np.zeros(0, np.int64)


def _offers(need: int):
    """Each content of a block once, with its smallest document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = block_segments(_texts(pdf), _ids(pdf), need)
        least = own.sort_values("doc").drop_duplicates("content")
        size = (least["last"] - least["first"] + need).astype(np.int32)
        return least[["gram", "content", "doc"]].assign(block=pdf["block"].iloc[0], size=size)

    return run


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From offers sorted by gram, content and document: contents that are gone (an earlier document has them whole) and contents to send (their gram has others).

    Only the last row seen, the document that began its content and one row still waiting for a second content of its gram are held.
    """
    gram = content = doc = None
    waiting = None
    for pdf in batches:
        if not len(pdf):
            continue
        g, c, d = (pdf[x].to_numpy() for x in ("gram", "content", "doc"))
        new_g = np.append(gram is None or g[0] != gram, g[1:] != g[:-1])
        new_c = new_g | np.append(content is None or c[0] != content, c[1:] != c[:-1])
        at = np.where(new_c, np.arange(len(g)), -1)
        at = np.maximum.accumulate(at)
        began = np.where(at >= 0, d[at], 0 if doc is None else doc)
        gone = ~new_c & (d > began)
        starts = np.flatnonzero(new_c)
        follows = np.zeros(len(g), bool)  # a second content of the same gram comes later in this batch
        follows[starts[:-1]] = ~new_g[starts[1:]]
        send = (new_c & (~new_g | follows)) | (~new_c & ~gone)
        if waiting is not None and len(starts):
            if not new_g[starts[0]]:
                yield waiting
            waiting = None
        if len(starts) and new_g[starts[-1]]:
            waiting = pdf.iloc[[starts[-1]]].assign(gone=False)
        keep = gone | send
        if keep.any():
            yield pdf[keep].assign(gone=gone[keep])
        gram, content, doc = g[-1], c[-1], began[-1]


def _contents(need: int):
    """The bytes of the contents that a block was asked for."""

    def run(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(asked):
            return pd.DataFrame({"gram": [], "content": [], "doc": [], "block": [], "raw": []})
        docs, texts = _ids(pdf), _texts(pdf)
        wanted = set(asked["doc"])
        texts = [t if d in wanted else None for t, d in zip(texts, docs.tolist())]
        own = block_segments(texts, docs, need).drop_duplicates(["content", "doc"]).merge(asked[["content", "doc", "block"]], on=["content", "doc"])
        raw = [texts[r][f : s + need] for r, f, s in zip(own["row"], own["first"], own["last"])]
        return own[["gram", "content", "doc", "block"]].assign(raw=raw)

    return run


def window_keys(texts: list[bytes | None], own: pd.DataFrame, need: int) -> Iterator[pd.DataFrame]:
    """Every window of the segments ``own`` of ``texts``, some ``PIECE`` bytes at once: row, gram, doc, at (in the text), key (a hash of its bytes)."""
    size = (own["last"] - own["first"] + need).to_numpy(np.int64)
    for _, part in own.groupby(np.cumsum(size) // PIECE, sort=False):
        first, last = part["first"].to_numpy(np.int64), part["last"].to_numpy(np.int64)
        raw = np.frombuffer(b"".join(texts[r][f : e + need] for r, f, e in zip(part["row"].tolist(), first.tolist(), last.tolist())), np.uint8)
        total = np.zeros(len(raw) + 1, _U)
        np.cumsum(_BYTE[raw] * _geometric(_BASE, len(raw)), out=total[1:])
        count = last - first + 1
        of = np.repeat(np.arange(len(part)), count)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        start = inner + np.repeat(np.cumsum(count + need - 1) - (count + need - 1), count)
        key = mix((total[start + need] - total[start]) * _geometric(_BACK, len(raw) + 1)[start]).view(np.int64)
        yield part[["row", "gram", "doc"]].iloc[of].assign(at=first[of] + inner, key=key)


def _windows(need: int):
    """The windows of the heavy contents that a block was asked for, each once: smallest document, and whether others of the block have it."""

    def run(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(asked):
            return pd.DataFrame({"gram": [], "content": [], "doc": [], "block": [], "several": []})
        docs, texts = _ids(pdf), _texts(pdf)
        wanted = set(asked["doc"])
        texts = [t if d in wanted else None for t, d in zip(texts, docs.tolist())]
        own = block_segments(texts, docs, need).drop_duplicates(["content", "doc"]).merge(asked[["content", "doc"]].drop_duplicates(), on=["content", "doc"])
        parts = [w.groupby(["gram", "key"], sort=False)["doc"].agg(["min", "max"]) for w in window_keys(texts, own, need)]
        if not parts:
            return pd.DataFrame({"gram": [], "content": [], "doc": [], "block": [], "several": []})
        found = pd.concat(parts).groupby(level=["gram", "key"], sort=False).agg({"min": "min", "max": "max"}).reset_index()
        return pd.DataFrame({"gram": found["gram"], "content": found["key"], "doc": found["min"], "block": pdf["block"].iloc[0], "several": found["min"] < found["max"]})

    return run


def in_company(contents: list[bytes], grams: np.ndarray, need: int, gram: int = GRAM) -> np.ndarray:
    """Whether each content can share a window with another one of its gram.

    Around a gram in a shared window at least half of the window's other bytes stand before it, or after it, and are shared as well.
    """
    raw = np.frombuffer(b"".join(contents), np.uint8)
    lengths = np.array([len(c) for c in contents], np.int64)
    ends = np.cumsum(lengths)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE[raw] * _geometric(_BASE, len(raw)), out=total[1:])
    back = _geometric(_BACK, len(raw) + 1)
    of = np.repeat(np.arange(len(contents)), lengths)
    low = mix((total[gram:] - total[:-gram]) * back[: len(raw) - gram + 1]).view(np.int64)
    at = np.flatnonzero(low == grams[of[: len(low)]])
    at = at[at + gram <= ends[of[at]]]
    more = -(-(need - gram) // 2)
    before = at[at - more >= (ends - lengths)[of[at]]]
    after = at[at + gram + more <= ends[of[at]]]
    keys = np.concatenate([
        mix((total[before + gram] - total[before - more]) * back[before - more]), ~mix((total[after + gram + more] - total[after]) * back[after]),
    ])
    who = np.concatenate([of[before], of[after]])
    order = np.argsort(keys)
    keys, who = keys[order], who[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    several = np.minimum.reduceat(who, heads) != np.maximum.reduceat(who, heads)
    out = np.zeros(len(contents), bool)
    out[who[np.repeat(several, np.diff(np.append(heads, len(keys))))]] = True
    return out


def _sorted_shard(need: int):
    """Windows of the contents of a shard that an earlier document has: runs from window ``a`` up to ``b`` of a content."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gram", "content", "doc", "block"]).reset_index(drop=True)
        pdf = pdf[in_company(pdf["raw"].tolist(), pdf["gram"].to_numpy(np.int64), need)].reset_index(drop=True)
        if not len(pdf):
            return pd.DataFrame({c: [] for c in ("gram", "content", "doc", "block", "a", "b")})
        lengths = pdf["raw"].str.len().to_numpy(np.int64)
        text = np.frombuffer(b"\0".join(pdf["raw"].tolist()) + b"\0", np.uint8).astype(np.int16) + 2
        cuts = np.cumsum(lengths + 1) - 1
        text[cuts] = 1
        text = np.append(text, np.int16(0))
        order, lcp = sort_suffixes(text, 258, need)
        of = np.repeat(np.arange(len(pdf)), lengths + 1)
        starts = cuts - lengths
        whole = np.zeros(len(text), bool)  # windows that end inside their content
        whole[: len(of)] = np.arange(len(of)) - starts[of] <= (lengths - need)[of]
        at = np.flatnonzero(whole[order])
        low = np.minimum.reduceat(lcp[: at[-1] + 1], np.append(0, at[:-1] + 1))
        places = order[at]
        heads = np.flatnonzero(np.append(True, low[1:] < need))
        docs = pdf["doc"].to_numpy(np.int64)[of[places]]
        least = np.repeat(np.minimum.reduceat(docs, heads), np.diff(np.append(heads, len(docs))))
        gone = np.zeros(len(text) + 1, np.int8)
        gone[places[least < docs]] = 1
        edge = np.diff(np.append(np.int8(0), gone))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # a run ends with its content's windows at the latest, since the last need - 1 places of a content start none
        row = of[a]
        return pdf.loc[row, ["gram", "content", "doc", "block"]].reset_index(drop=True).assign(a=a - starts[row], b=b - starts[row])

    return run


def _cut(need: int, with_text: bool, keep: tuple[str, ...]):
    """Removed bytes of each document of a block."""
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else [])]

    def run(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in ("doc_id", *keep, *names)})
        docs, texts = _ids(pdf), _texts(pdf)
        own = block_segments(texts, docs, need)
        least = _least(own)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        gone_here = own[own["doc"].to_numpy() > least]
        rest = own[own["doc"].to_numpy() <= least]
        keys = told[told["a"] == -1][["content", "doc"]].drop_duplicates()
        for part in (gone_here, rest.merge(keys, on=["content", "doc"])):
            for r, f, s in zip(part["row"].tolist(), part["first"].tolist(), part["last"].tolist()):
                spans[r].append((f, s + need))
        heavy = told[told["a"] == -2].rename(columns={"content": "key", "doc": "least"})[["gram", "key", "least"]].drop_duplicates()
        for windows in window_keys(texts, rest[rest["gram"].isin(heavy["gram"])], need) if len(heavy) else ():
            windows = windows.merge(heavy, on=["gram", "key"])
            for r, w in windows.loc[windows["doc"] > windows["least"], ["row", "at"]].drop_duplicates().itertuples(index=False):
                spans[r].append((w, w + need))
        part = rest.merge(told[told["a"] >= 0][["content", "doc", "a", "b"]].drop_duplicates(), on=["content", "doc"])
        for r, f, a, b in zip(part["row"].tolist(), part["first"].tolist(), part["a"].tolist(), part["b"].tolist()):
            spans[r].append((f + a, f + b - 1 + need))
        out = []
        for text, own_spans in zip(pdf["text"], spans):
            raw = (text or "").encode("utf-8", "surrogatepass")
            kept, at, removed, runs = [], 0, 0, 0
            for s, e in merged(own_spans):
                kept.append(raw[at:s])
                removed, runs, at = removed + e - s, runs + 1, e
            kept.append(raw[at:])
            left = b"".join(kept)
            out.append((len(raw), removed, runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore"))[: len(names)])
        return pd.concat([pdf[["doc_id", *keep]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    return run


def merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Maximal runs covered by ``spans``."""
    start = end = None
    for s, e in sorted(spans):
        if end is None or s > end:
            if end is not None:
                yield start, end
            start, end = s, e
        else:
            end = max(end, e)
    if end is not None:
        yield start, end


def remove_repeats(docs: DataFrame, need: int = NEED, with_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text of every row of ``docs`` (doc_id, text), with the columns in ``keep``.

    A byte goes when a string of ``need`` bytes that covers it also starts in a document with a smaller id; strings are judged on the
    input. kept_text leaves out a character of which a part was removed; kept_sha256 is of the bytes.

    Null text: empty. Texts shorter than ``need``: kept. Null doc_id: has no place in the order, so it neither loses nor removes anything.
    Rows with one doc_id do not remove each other's bytes. An empty table gives no rows; extra columns are ignored; a long text is cut into overlapping pieces.
    """
    kinds = dict(docs.dtypes)
    blocks = in_blocks(docs, keep)
    offers = blocks.groupBy("block").applyInPandas(_offers(need), "gram long, content long, doc long, block long, size int")
    settled = offers.repartition("gram").sortWithinPartitions("gram", "content", "doc").mapInPandas(_settle, "gram long, content long, doc long, block long, size int, gone boolean")
    settled = cut_lineage(settled, "repeat-settled")
    asked = settled.where("not gone").drop("gone")
    # As many rows as heavy parts of a shard fit into the contents at most.
    heavy = cut_lineage(asked.groupBy("gram").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > SHARD // HEAVY).select("gram"), "repeat-heavy")
    split = heavy.limit(1).count() > 0
    light = asked.join(heavy, "gram", "left_anti") if split else asked
    contents = blocks.groupBy("block").cogroup(light.groupBy("block")).applyInPandas(_contents(need), "gram long, content long, doc long, block long, raw binary")
    shards = max(1, -(-(light.agg(F.sum("size")).first()[0] or 0) // SHARD))
    shard = F.pmod(F.xxhash64("gram"), F.lit(shards))
    runs = contents.withColumn("shard", shard).groupBy("shard").applyInPandas(_sorted_shard(need), "gram long, content long, doc long, block long, a long, b long")
    runs = cut_lineage(runs, "repeat-runs")

    def marked(rows: DataFrame, mark: int) -> DataFrame:
        return rows.select("gram", "content", "doc", "block", F.lit(mark).cast("long").alias("a"), F.lit(mark).cast("long").alias("b"))

    told = runs.unionByName(marked(settled.where("gone"), -1))
    if split:
        many = asked.join(heavy, "gram", "left_semi").groupBy("block")
        windows = cut_lineage(blocks.groupBy("block").cogroup(many).applyInPandas(_windows(need), "gram long, content long, doc long, block long, several boolean"), "repeat-windows")
        # A window is one row per block, so no key here has more rows than there are blocks.
        least = windows.groupBy("gram", "content").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n"), F.max("several").alias("several"))
        shared = windows.select("gram", "content", "block").join(least.where("n > 1 or several"), ["gram", "content"])
        told = told.unionByName(marked(shared, -2))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept_text string" if with_text else ""
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_cut(need, with_text, keep), schema)
