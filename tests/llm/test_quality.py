import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import as_bag, corpus, prose, words
from pyspark.sql import functions as F

from ledgerloom.llm import langid, mixing, quality_net, quality_rules
from ledgerloom.llm.common import crc_fold
from ledgerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


# --- language ID

def test_language_on_held_out_documents(spark):
    got = QUERIES["op2_langid"](spark, SF).toPandas()
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    both = got.merge(lang, on="doc_id")
    assert len(both) == len(lang)
    assert (both["held_out"] == both["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = both[both["held_out"] & both["lang"].notna()]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", "fr"), (5, "12 34 !?", None), (None, "the dog", None), (1, "the cat and the dog", "en")],
        "doc_id long, text string, lang string",
    )
    model = langid.fit(docs)
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()]
    assert as_bag(got) == as_bag([(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (1, "en")])
    untaught = langid.fit(docs.where("lang = 'xx'"))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, untaught).collect()} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_mixture_of_two_languages(spark):
    rng = random.Random(1)
    en, xx = [prose(rng, 300) for _ in range(5)], ["".join(chr(0x430 + ord(c) - 97) if c.isalpha() else c for c in prose(rng, 300)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(en)] + [(10 + i, t, "xx") for i, t in enumerate(xx)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    use, w = model.proportions(*langid.gram_counts(en[0] + " " + xx[0][: len(xx[0]) // 3]))
    assert [model.langs[i] for i in use] == ["en", "xx"] and 0.6 < w[0] < 0.9
    assert len(model.proportions(*langid.gram_counts(en[1]))[0]) == 1


def test_long_text_in_pieces(monkeypatch):
    text = prose(random.Random(2), 500)
    whole = dict(zip(*map(np.ndarray.tolist, langid.gram_counts(text))))
    monkeypatch.setattr(langid, "PIECE", 101)
    bins, n = langid.gram_counts(text)
    pieces = dict(zip(bins.tolist(), n.tolist()))
    extra = Counter(pieces) - Counter(whole)
    assert not Counter(whole) - Counter(pieces) and sum(extra.values()) <= 4 * (len(text) // 101 + 1)


def test_long_text_is_counted_like_brute_force():
    text = "Zwölf Boxkämpfer jagen Viktor. " * 100_000  # 3.1 million characters
    padded, found = f" {text.lower()} ", Counter()
    for gram, n in Counter(padded[i : i + 3] for i in range(len(padded) - 2)).items():
        found[int(langid.grams(gram)[0])] += n
    bins, n = langid.gram_counts(text)
    assert dict(zip(bins.tolist(), n.tolist())) == dict(found)


def test_many_noisy_languages(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 40), "en") for i in range(50)] + [(100 + i, "щука и карась " * 5, f"noise{i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.chance.shape == (16_384, 2001) and np.allclose(model.chance.sum(axis=0), 1)
    assert {r.lang_pred for r in langid.predict(docs.where("doc_id < 20"), model).collect()} == {"en"}


def test_set_search_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(40):
        chance = rng.dirichlet(np.full(60, 0.4), size=6).T
        n = rng.multinomial(400, chance @ rng.dirichlet(np.full(6, 0.3)))
        bins = np.flatnonzero(n)
        model = langid.Model(list("abcdef"), chance)
        use, w = model.proportions(bins, n[bins])
        weights = langid.em(chance[bins], n[bins], np.full(6, 1 / 6), 30)
        order, values = np.argsort(-weights, kind="stable"), []
        for k in range(1, 7):
            part, start = chance[np.ix_(bins, order[:k])], weights[order[:k]] + 1e-9
            own = langid.em(part, n[bins], start / start.sum(), 30)
            values.append(float(n[bins] @ np.log(part @ own)) - 0.5 * k * np.log(400))
        assert len(use) == int(np.argmax(values)) + 1 and np.isclose(w.sum(), 1)


# --- quality rules

def brute_rules(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_rules_match_brute_force(spark):
    rows = corpus(seed=3) + [(900, "a b c a b c"), (901, "x\nx\n\n \n \nx #*$%&|<>")]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean")
    got = quality_rules.judge(docs).collect()
    assert as_bag(tuple(r)[:6] for r in got) == as_bag((i, *brute_rules(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_bands_reject_repetition_and_noise():
    import zstandard

    press, rng = zstandard.ZstdCompressor(level=3), random.Random(7)
    good = prose(rng, 900).encode()
    noise = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(5000))
    assert quality_rules.in_bands(good, press)[0]
    assert not quality_rules.in_bands(b"again and again " * 400, press)[0]
    assert not quality_rules.in_bands(noise, press)[0]
    assert not quality_rules.in_bands(good + noise * 2, press)[0]  # the chunks tell


def test_rules_keep_labelled_good_documents(spark):
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    got = QUERIES["op7_quality_rules"](spark, SF).join(good, "doc_id")
    assert got.where("not base_failed and not kept").count() == 0


# --- quality classifier

def test_classifier_on_held_out_documents(spark):
    got = QUERIES["op9_quality_net"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() > 0.9


def test_chunks_cover_the_whole_text():
    for n in [0, 1, 255, 256, 257, 448, 449, 5000]:
        raw = bytes(range(256)) * 20
        rows = quality_net.chunks(raw[:n])
        assert b"".join(bytes(r[: quality_net.HOP]) for r in rows[:-1]) + bytes(rows[-1]).rstrip(b"\0") == raw[:n].rstrip(b"\0")
        assert len(rows) == 1 or (len(rows) - 2) * quality_net.HOP + quality_net.CHUNK < n


def test_score_does_not_depend_on_the_batch():
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(0, 800)) for _ in range(30)] + [None, "", "x" * 200_000]
    p = quality_net.new_params()
    together = quality_net.score_texts(texts, p)
    assert np.allclose(together, [quality_net.score_texts([t], p)[0] for t in texts], atol=1e-5)


def test_gradient_matches_differences():
    rng = random.Random(4)
    docs = [quality_net.chunks(prose(rng, 40).encode()) for _ in range(3)]
    y, weight = np.array([1, 0, 1], np.float32), np.ones(3)
    p = {k: v.astype(np.float64) for k, v in quality_net.new_params().items()}

    def loss(q):
        counts = np.array([len(d) for d in docs])
        doc = quality_net.combine(quality_net.pooled(np.concatenate(docs), q), np.append(0, np.cumsum(counts)[:-1]), counts)
        s = quality_net.probability(doc, q)
        return -np.mean(np.where(y > 0, np.log(s), np.log(1 - s)))

    g = quality_net._gradient(docs, y, weight, p)
    for k in p:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        up, down = ({m: v.copy() for m, v in p.items()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert np.isclose(g[k][at], (loss(up) - loss(down)) / 2e-5, rtol=2e-2, atol=1e-6)


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good"), (1, "good"), (2, None), (None, "bad"), (3, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    blank = quality_net.fit(docs, none, F.lit(True))
    assert {r.score for r in quality_net.score(docs, blank).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0)], none.schema)
    assert all(r.predicted == 1 for r in quality_net.score(docs, quality_net.fit(docs, one, F.lit(True))).collect())
    assert quality_net.score(docs.limit(0), blank).count() == 0


# --- mixing

def targets(sizes):
    """Water filling by hand."""
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    stopped = set()
    while True:
        free = [s for s in order if s not in stopped]
        rate = (total - sum(3 * sizes[s] for s in stopped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if weight[s] * rate > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in stopped else weight[s] * rate for s in order}
        stopped |= over


@pytest.mark.parametrize("block", [4, 256])
def test_mix_meets_its_targets(spark, block):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice([1, 5, 40, 300])) if rng.random() > 0.05 else None, rng.choice(["a", "a", "a", "b", "c", "é", None, "zz"]), 1) for i in range(600)]
    rows += [(None, "x y", "a", 1), (7, "twice here", "b", 1), (7, "twice here", "b", 1), (601, "tiny source", "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mix(docs, block=block).toPandas().astype(object)
    got = got.where(got.notna(), None)
    again = mixing.mix(docs, block=block).toPandas()
    assert as_bag(zip(got["doc_id"], got["taken"])) == as_bag((None if i != i else i, t) for i, t in zip(again["doc_id"], again["taken"]))
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(words(text))
    want = targets(sizes)
    assert (got["taken"] <= 3 * got["size"]).all() and (got["copies"] >= 0).all()
    for source, target in want.items():
        part = got[[s == source for s in got["source"]]]
        assert np.allclose(part["target"].astype(float), target) and (part["source_size"] == sizes[source]).all()
        assert abs(part["taken"].sum() - target) <= part["size"].max()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rounding_keeps_the_expected_copies():
    size, p, n = [5, 3, 8, 2, 9, 4], [0.3, 0.8, 0.5, 0.1, 0.9, 0.4], 4000
    rng, total = random.Random(11), np.zeros(len(p))
    for _ in range(n):
        q, left = mixing.round_block(size, p, rng)
        if left is not None:
            q[left] = float(rng.random() < q[left])
        total += q
    assert np.abs(total / n - p).max() < 0.035


def test_crc_fold(spark):
    got = spark.createDataFrame([(i,) for i in [0, 7, 123456, None]], "doc_id long").select("doc_id", crc_fold(F.col("doc_id"), 5).alias("f")).collect()
    assert [(r.doc_id, r.f) for r in got] == [(i, -1 if i is None else zlib.crc32(str(i).encode()) % 5) for i in [0, 7, 123456, None]]
