"""Merkle manifest, sharding and spelling variants against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from check_oracle import compare, duck
from helpers import as_bag
from pyspark.sql import functions as F

from ledgerloom.llm import merkle, sharding, spelling
from ledgerloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("name", ["op11_merkle", "op13_spelling"])
def test_same_as_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck(SF).execute(ORACLES[name]).df()
    whole = {c: "float64" for c in want if str(want[c].dtype) == "Int64"}
    assert compare(got.astype(whole), want.astype(whole)) == "ok"


# --- Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def grown(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way_up(levels, i):
    out = []
    for level in levels[:-1]:
        s = i // 3 * 3
        out.append((level[s:i], level[i + 1:s + 3]))
        i //= 3
    return out


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0], leaf_of(r, r[4])))
    trees = [grown([leaf_of(r, r[4]) for r in by[s]]) for s in sources]
    crown = grown([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            path = way_up(trees[k], i) + way_up(crown, k)
            gone = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            at = leaf_of(r, r[4].replace("\n", "") if gone else r[4])
            for left, right in path:
                at = sha(*left, at, *right)
            root = crown[-1][0]
            out.append((r[0], leaf_of(r, r[4]), trees[k][-1][0], root, sha(*(h for p in path for side in p for h in side)), at, at == root))
    return out


def merkle_rows(sources, seed=5):
    rng = random.Random(seed)
    texts = ["", None, "a\nb", "über\n\n", "x" * 100_000 + "\n", "plain", "-", "5:plain"]
    rows = []
    for s, n in sources:
        rows += [(rng.randrange(10_000), s, rng.choice(["en", None]), rng.choice([None, 3]), rng.choice(texts)) for _ in range(n)]
    return rows


@pytest.mark.parametrize("sources", [
    [("a", 1)], [("a", 2)], [("a", 3)], [("a", 4)], [("b", 9), ("a", 10), (None, 1)], [(None, 28), ("ä", 82), ("z", 27), ("", 3)], [(f"s{i:03d}", i % 5 + 1) for i in range(90)],
])
def test_manifest_of_every_tree_shape(spark, sources):
    rows = merkle_rows(sources)
    rows += rows[:1]  # the same row twice
    docs = spark.createDataFrame(rows, DOCS).withColumns({"tree": F.lit(1), "path": F.lit("p"), "leaf": F.lit(2), "_range": F.lit(3)})
    got = [tuple(r) for r in merkle.without_breaks(docs).drop("source", "path").collect()]
    assert as_bag(got) == as_bag(manifest(rows))


def test_manifest_null_ids_and_no_rows(spark):
    rows = [(None, "a", "en", 1, "t\n"), (None, "a", "en", 1, "t\n"), (3, "a", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = [tuple(r) for r in merkle.without_breaks(docs).drop("source", "path").collect()]
    assert as_bag(got) == as_bag(manifest(rows)) and all(r[-1] for r in got)
    assert merkle.without_breaks(docs.limit(0)).count() == 0


def test_source_over_many_ranges(spark):
    """A source with most rows lies in several ranges, and ranges hold several sources."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("source"), F.col("id").alias("doc_id"), F.lit(b"d").alias("digest"), F.lit(0).alias("tie")
    )
    got = merkle.ranked(rows, "source", ["doc_id", "digest", "tie"]).toPandas()
    want = rows.toPandas().sort_values(["source", "doc_id"]).reset_index(drop=True)
    want["lo"] = want.groupby("source").cumcount()
    want["n"] = want.groupby("source")["doc_id"].transform("size")
    want["tree"] = pd.factorize(want["source"], sort=True)[0]
    cols = ["source", "doc_id", "tree", "n", "lo"]
    assert got.sort_values(["source", "doc_id"])[cols].values.tolist() == want[cols].values.tolist()


def test_proof_of_a_changed_text_fails(spark):
    docs = spark.createDataFrame(merkle_rows([("a", 20), ("b", 5)]), DOCS)
    changed = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    for r in merkle.manifest(docs, changed).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.verified == (r.doc_id % 2 == 1 or r.text is None)


# --- sharding

@pytest.mark.parametrize("pop,good,draws", [(100, 30, 20), (10, 5, 5), (1000, 3, 900), (7, 7, 3), (7, 0, 3), (40_000, 20_000, 15_000)])
def test_hypergeometric_draws(spark, pop, good, draws):
    drawn = sharding.hypergeometric(F.lit(pop).cast("long"), F.lit(good).cast("long"), F.lit(draws).cast("long"), sharding.uniform(1, "id"))
    n = 2000 if pop > 10_000 else 20_000
    x = spark.range(n).select(drawn.alias("x")).toPandas()["x"].to_numpy()
    assert x.min() >= max(0, draws - (pop - good)) and x.max() <= min(good, draws)
    mean = draws * good / pop
    var = mean * (1 - good / pop) * (pop - draws) / (pop - 1)
    assert abs(x.mean() - mean) <= 5 * np.sqrt(var / n) + 1e-12
    assert x.var() == pytest.approx(var, rel=0.2, abs=1e-12)


def test_hypergeometric_against_enumeration(spark):
    """Every subset of 4 out of 8, 3 of them good, equally likely."""
    exact = Counter(sum(i < 3 for i in c) for c in itertools.combinations(range(8), 4))
    drawn = sharding.hypergeometric(F.lit(8).cast("long"), F.lit(3).cast("long"), F.lit(4).cast("long"), sharding.uniform(2, "id"))
    got = Counter(r.x for r in spark.range(70_000).select(drawn.alias("x")).collect())
    for x, n in exact.items():
        assert got[x] / 70_000 == pytest.approx(n / 70, abs=0.01)


@pytest.mark.parametrize("parts", [1, 7, 64, 65, 300])
def test_matrix_has_the_given_margins(spark, parts):
    rng = random.Random(parts)
    sizes = [rng.choice([0, 1, 5, 200]) for _ in range(parts)]
    total = sum(sizes)
    free = [total // 5 + (j < total % 5) for j in range(5)]
    m = sharding.matrix(spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "part long, m long"), free, 1, parts).toPandas()
    counts = np.array(m["counts"].tolist())
    assert (counts >= 0).all() and counts.sum(0).tolist() == free
    assert dict(zip(m["part"], counts.sum(1))) == {i: n for i, n in enumerate(sizes) if n}


def shards_hold(got, n, shards=16):
    sizes = [n // shards + (j < n % shards) for j in range(shards)]
    by = got.groupby("shard")["slot"].apply(sorted).to_dict()
    assert by == {j: list(range(m)) for j, m in enumerate(sizes) if m}


def test_shards_of_the_supplied_documents(spark):
    got = QUERIES["op12_sharding"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(docs["doc_id"], docs["text"])]
    assert as_bag(got[["doc_id", "size", "text_crc32"]].itertuples(index=False)) == as_bag(want)
    shards_hold(got, len(docs))
    again = QUERIES["op12_sharding"](spark, SF).toPandas()
    assert as_bag(got[["doc_id", "shard", "slot"]].itertuples(index=False)) == as_bag(again[["doc_id", "shard", "slot"]].itertuples(index=False))


def test_shuffle_does_not_depend_on_splits(spark):
    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 7).alias("x"))
    a, b = (sharding.shuffle(rows.repartition(n), part_rows=64).toPandas() for n in (1, 13))
    assert as_bag(a.itertuples(index=False)) == as_bag(b.itertuples(index=False))
    shards_hold(a, 2000)


def test_shuffle_is_uniform(spark):
    """Every stretch of the input lies in every stretch of every shard as a uniform permutation would put it."""
    n, shards = 60_000, 6
    got = sharding.shuffle(spark.range(n), shards=shards, part_rows=500).toPandas().sort_values("id")
    shards_hold(got, n, shards)
    place = got["shard"].to_numpy() * (n // shards) + got["slot"].to_numpy()
    assert sorted(place) == list(range(n))
    cells = np.histogram2d(got["id"], place, bins=[40, 60])[0]  # 25 rows a cell are expected
    chi2 = ((cells - 25) ** 2 / 25).sum()
    freedom = 39 * 59
    assert abs(chi2 - freedom) < 5 * np.sqrt(2 * freedom)
    assert abs(np.corrcoef(got["id"], place)[0, 1]) < 5 / np.sqrt(n)
    step = np.diff(place)
    assert abs(np.corrcoef(step[:-1], step[1:])[0, 1] + 0.5) < 0.02 and (step == 1).sum() < 10  # neighbours part


def test_sharding_edge_cases(spark):
    schema = "doc_id long, text string, slots int"
    rows = [(1, None, 1), (2, "", 1), (None, "x", 2), (None, None, None), (3, "y" * 300_000, 3)] + [(7, "same", 1)] * 1000
    got = sharding.document_shards(spark.createDataFrame(rows, schema)).toPandas()
    shards_hold(got, len(rows))
    assert as_bag(zip(got["size"], got["text_crc32"])) == as_bag((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sharding.document_shards(spark.createDataFrame([], schema)).count() == 0
    shards_hold(sharding.document_shards(spark.createDataFrame(rows[:3], schema)).toPandas(), 3)
    with pytest.raises(ValueError):
        sharding.shuffle(spark.range(1).withColumn("slot", F.lit(1)))


def test_bundles_of_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 10)
    got = sharding.shuffle(spark.range(3).crossJoin(spark.range(34).select()), shards=4).toPandas()
    shards_hold(got, 102, 4)
    assert Counter(got["id"]) == {0: 34, 1: 34, 2: 34}


def test_written_shards_are_whole(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert as_bag(back.select(docs.columns).collect()) == as_bag(docs.collect())
    shards_hold(back.select("shard", "slot").toPandas(), docs.count(), 5)


# --- spelling variants

def brute_words(rows):
    up, n = str.maketrans(spelling.UPPER, spelling.LOWER), Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(up)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def edit_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and edit_one(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = {}
    for w in words:
        end = w
        while form[end]:
            end = form[end]
        out[w] = (form[w], end, words[w], len(near[w]), form[w] and words[form[w]])
    return out


def variants_of(spark, words, shard=spelling.SHARD):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, shard=shard).collect()}


@pytest.mark.parametrize("shard", [spelling.SHARD, 30, 1])
def test_variants_of_crowded_words(spark, shard):
    """Words of two letters that share counts and halves: leaves over the bound are dealt by halves."""
    rng = random.Random(3)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))): rng.randint(3, 60) for _ in range(500)}
    words |= {"".join(rng.choice("aqzÿÄä") for _ in range(rng.randint(5, 7))): rng.randint(3, 60) for _ in range(200)}
    base = "x" * 300
    words |= {base: 90, base[:-1]: 40, base[:150] + "y" + base[151:]: 9, base + "q": 4}
    assert variants_of(spark, words, shard) == brute_variants(words)


def test_chains_lead_to_the_root(spark):
    words = {"aaaaa" + "b" * i: 3 * 2**i for i in range(12)}
    got = variants_of(spark, words)
    assert got == brute_variants(words) and got["aaaaa"][1] == "aaaaa" + "b" * 11


def test_words_of_documents(spark):
    rows = [(i, "Kaffee kaffee KAFFEE Kafee Straße Strasse strasse ÄRGER ärger x" * 3 + " " + "tresor " * (i % 9)) for i in range(150)]
    rows += [(None, "tresor tresorr Tresorr tresorr"), (5, None), (6, ""), (7, "12 !? 中文"), (8, "lang" * 3000), (8, "lang" * 3000), (8, "lang" * 3000)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    words = {r.word: r.n for r in spelling.vocabulary(spelling.noisy_runs(docs)).collect()}
    assert words == brute_words(rows)
    got = {r.word: tuple(r)[1:] for r in spelling.document_variants(docs).collect()}
    assert got == {w: v for w, v in brute_variants(words).items()}
    assert spelling.document_variants(docs.limit(0)).count() == 0
    assert spelling.document_variants(docs.where("text is null")).count() == 0


def test_one_edit():
    words = ["".join(w) for k in range(5) for w in itertools.product("ab", repeat=k)]
    for a, b in itertools.product(words, words):
        assert spelling.one_edit(a, b) == (a != b and edit_one(a, b))
