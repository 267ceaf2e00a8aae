import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from helpers import as_bag, components, corpus, prose, repeats, shingle_set, words

from ledgerloom.llm import jaccard, suffixes
from ledgerloom.llm import repeats as rp
from ledgerloom.llm.common import connected

DOCS = "doc_id long, text string"


def frame(spark, rows):
    extra = "long, label string, cluster int, block string"  # names that the operators use inside
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], f"{DOCS}, node {extra}")


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_components_match_all_pairs(spark, k, num, den):
    rows = corpus()
    got = jaccard.components(frame(spark, rows), jaccard.Rule(k, num, den)).collect()
    want = components(rows, k, num, den)
    assert len(got) == len(rows)
    sizes = as_bag((i, len(shingle_set(t, k))) for i, t in rows)
    assert as_bag((r.doc_id, r.n_shingles) for r in got) == sizes
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]


def test_large_group_is_split_and_stays_exact(spark, monkeypatch):
    """A chain of near copies over many small parts: neighbours link, ends don't."""
    monkeypatch.setattr(jaccard, "MEMBERS", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rng = random.Random(5)
    text = words(prose(rng, 200))
    rows = []
    for i in range(60):
        if i % 20 == 0:
            text = words(prose(rng, 200))
        text = list(text)
        text[rng.randrange(200)] = f"new{i}"
        rows.append((i * 7 % 61, " ".join(text)))
    got = {r.doc_id: r.component_id for r in jaccard.components(frame(spark, rows), jaccard.Rule(3, 95, 100)).collect()}
    assert got == components(rows, 3, 95, 100)


def test_blocks_share_a_key_for_every_link():
    rng = np.random.default_rng(3)
    for rule in (jaccard.Rule(3, 90, 100), jaccard.Rule(5, 80, 100)):
        for n in [1, 2, 5, 9, 10, 19, 40, 150, 700]:
            for _ in range(40):
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                apart = int(rng.integers(0, rule.most_apart(2 * n) + 1))
                b = np.unique(np.append(a[: len(a) - apart // 2], rng.integers(0, 1 << 63, apart // 2).astype(np.uint64)))
                if len(b) and rule.links(a, b):
                    assert set(jaccard.block_keys(a, rule)) & set(jaccard.block_keys(b, rule))


def test_tree_finds_every_link():
    rng = np.random.default_rng(4)
    rule = jaccard.Rule(3, 80, 100)
    base = [np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64)) for _ in range(5)]
    sets = [np.unique(np.append(b[k:], rng.integers(0, 1 << 63, k).astype(np.uint64))) for b in base for k in range(0, 30, 2)]
    comp = jaccard.link(sets, list(range(len(sets))), rule)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if rule.links(a, b):
                assert comp[i] == comp[j]
    assert len(set(comp)) >= 5


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("seed", range(4))
def test_suffixes_in_order_with_common_prefixes(seed):
    rng = random.Random(seed)
    for _ in range(150):
        n, symbols = rng.randrange(0, 60), rng.choice([2, 3, 5, 20])
        t = [rng.randrange(1, symbols + 1) for _ in range(n)] + [0]
        if rng.random() < 0.3:
            t = (t[:4] * 20)[: n or 1] + [0]
            t = [x or 1 for x in t[:-1]] + [0]
        most = rng.choice([4, 50, 200])
        order, lcp = suffixes.sort_suffixes(np.array(t, np.int64), symbols + 1, most, budget=rng.choice([3, 1 << 20]))
        keys = [tuple(t[i : i + most]) for i in order]
        assert sorted(order.tolist()) == list(range(len(t))) and keys == sorted(keys)
        for i in range(1, len(keys)):
            same = next((d for d, (x, y) in enumerate(zip(keys[i - 1], keys[i])) if x != y), min(len(keys[i]), len(keys[i - 1])))
            assert lcp[i] == same


def test_suffixes_with_many_names(monkeypatch):
    monkeypatch.setattr(suffixes, "SYMBOLS", 1)
    t = np.append(np.tile(np.array([3, 1, 2, 2, 1, 3, 3]), 9), 0)
    order, _ = suffixes.sort_suffixes(t, 4, 20)
    keys = [tuple(t[i : i + 20]) for i in order]
    assert keys == sorted(keys)


@pytest.mark.parametrize("piece,block", [(1 << 20, 8 << 20), (150, 2000)])
def test_repeats_match_brute_force(spark, monkeypatch, piece, block):
    monkeypatch.setattr(rp, "PIECE", piece)
    monkeypatch.setattr(rp, "BLOCK", block)
    rows = corpus(seed=2)
    got = rp.remove_repeats(frame(spark, rows), need=50, keep=("node", "label")).collect()
    want = as_bag((i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in repeats(rows, 50))
    assert as_bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert any(r.n_removed for r in got) and all(r.label == "x" for r in got)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert jaccard.components(none).count() == 0
    assert rp.remove_repeats(none).count() == 0


def test_contents_in_company_hold_every_shared_window():
    rng = random.Random(8)
    need, gram = 50, 16
    for _ in range(40):
        core = bytes(rng.randrange(97, 123) for _ in range(need))
        a = bytes(rng.randrange(97, 123) for _ in range(rng.randrange(20))) + core + b"xyz"
        b = b"12345" + core + bytes(rng.randrange(97, 123) for _ in range(rng.randrange(20)))
        p = rng.randrange(need - gram + 1)
        c = bytes(rng.randrange(97, 123) for _ in range(40)) + core[p : p + gram] + bytes(rng.randrange(97, 123) for _ in range(40))
        raw = np.frombuffer(core[p : p + gram], np.uint8)
        total = np.zeros(gram + 1, np.uint64)
        np.cumsum(rp._BYTE[raw] * rp._geometric(rp._BASE, gram), out=total[1:])
        own = rp.mix(total[gram:] - total[:1]).view(np.int64)[0]
        assert rp.in_company([a, c, b], np.array([own] * 3), need).tolist() == [True, False, True]


def test_a_passage_in_many_documents_fills_no_shard(spark, monkeypatch):
    rng = random.Random(5)
    passage = prose(rng, 40)
    rows = [(i, prose(rng, 12) + " " + passage + " " + prose(rng, 12)) for i in range(400)] + [(400 + i, "ab" * (40 + i % 7) + prose(rng, 9)) for i in range(60)]
    rows += [(7, rows[9][1]), (None, rows[3][1]), (900, rows[8][1])]
    inner, most = rp._sorted_shard, 2 * 8192

    def bounded(need):
        run = inner(need)

        def checked(pdf):
            assert pdf["raw"].str.len().sum() <= most, "a shard is larger than its bound"
            return run(pdf)

        return checked

    monkeypatch.setattr(rp, "SHARD", 8192)
    monkeypatch.setattr(rp, "BLOCK", 20_000)
    monkeypatch.setattr(rp, "_sorted_shard", bounded)
    got = rp.remove_repeats(frame(spark, rows), need=50).collect()
    want = as_bag((i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in repeats(rows, 50))
    assert as_bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_key_filter_holds_every_key(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from ledgerloom.llm import common

    keys = spark.range(50_000).select(F.xxhash64("id").alias("k"))
    bits = common.key_filter(keys.union(keys.limit(1000)), "k")
    own = np.array([r.k for r in keys.collect()])
    want = np.zeros(common.FILTER_BITS // 64, np.uint64)
    at = own & (common.FILTER_BITS - 1)
    np.bitwise_or.at(want, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    assert (bits == want).all() and common.may_hold(bits, own).all()
    others = np.array([r.k for r in spark.range(1_000_000, 1_010_000).select(F.xxhash64("id").alias("k")).collect()])
    assert common.may_hold(bits, others).mean() < 0.01
    assert not common.key_filter(keys.limit(0), "k").any()


def test_points_tell_long_unlike_sets_apart_and_bound_the_overlap():
    """With 64 coordinates for all sizes, sets of some thousand shingles all looked alike, so their texts were moved to be compared."""
    rng = np.random.default_rng(6)
    rule = jaccard.Rule(5, 80, 100)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (30, 260, 2000, 2100, 9000, 9100)]
    sets.append(np.unique(np.append(sets[2][100:], rng.integers(0, 1 << 63, 90).astype(np.uint64))))
    sets.append(np.sort(np.append(sets[0], (np.uint64(1 << 50) + np.arange(300, dtype=np.uint64)))))  # many in one group
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            n = np.array([len(a), len(b)])
            bound = int(np.minimum(*jaccard.unpacked([jaccard.packed(a), jaccard.packed(b)], n)).sum())
            assert bound >= len(np.intersect1d(a, b))
            assert i == j or {i, j} == {2, 6} or bound < rule.least_shared(int(n.sum()))


def test_texts_of_chance_meetings_are_not_moved(spark, monkeypatch):
    """Long unlike documents meet in cells by a passage they share. None of them is close to another one, whether their cluster fits into one part or not."""
    moved = []
    texts_of = jaccard._texts_of
    monkeypatch.setattr(jaccard, "_texts_of", lambda docs, wanted: moved.append(wanted.count()) or texts_of(docs, wanted))
    monkeypatch.setattr(jaccard, "MEMBERS", 8)
    monkeypatch.setattr(jaccard, "block_keys", lambda own, rule: np.array([7], np.uint64))  # everyone meets everyone
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(1500 + i))) for i in range(20)]
    rows += [(50, rows[3][1] + " one more"), (51, rows[3][1] + " another one")]
    found = {r.doc_id: r.component_id for r in jaccard.components(frame(spark, rows), jaccard.Rule(5, 80, 100)).collect()}
    assert found == {i: 3 if i in (50, 51) else i for i, _ in rows}
    assert moved == [3]


def test_cells_are_handed_on_in_small_frames(monkeypatch):
    class Docs:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            return run

    batch = pd.DataFrame({"text": [t for _, t in corpus(5)] * 2})
    whole = pd.concat(jaccard._deal(Docs(), jaccard.Rule())(iter([batch])))
    monkeypatch.setattr(jaccard, "CELLS", 100)
    frames = list(jaccard._deal(Docs(), jaccard.Rule())(iter([batch])))
    assert pd.concat(frames).values.tolist() == whole.values.tolist()
    # Without its last document a frame is below the limit.
    assert len(frames) > 1 and all((f["node"] != f["node"].iloc[-1]).sum() < 100 for f in frames)
