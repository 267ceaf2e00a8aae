import importlib
import re
import sys
from collections import Counter
from pathlib import Path

from helpers import components, repeats, words

SF = "/root/testdata/sf0.001"


def test_stages_do_their_work(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    pipe = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipe.STAGES] == ["quality_classifier", "ngram_jaccard", "suffix_dedup", "decontamination", "source_mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    from ledgerloom.session import cut_lineage

    for name, stage in pipe.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = cut_lineage(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        seen[name] = (before, after)
        if name != "source_mixing":
            assert docs.columns == columns
    before, after = seen["ngram_jaccard"]
    want = components(before, 5, 80, 100)
    assert set(after) == {i for i, c in want.items() if i == c}
    before, after = seen["suffix_dedup"]
    kept = {i: raw for i, n, gone, _, raw in repeats(before, 50) if not n or gone < n}
    assert {i: r.text for i, r in after.items()} == {i: raw.decode("utf-8", "ignore") for i, raw in kept.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())
    before, after = seen["source_mixing"]
    assert all(1 <= r.copies <= 3 and r.taken == r.copies * len(words(r.text)) for r in after.values())
    total = sum(len(words(t)) for _, t in before)
    assert abs(sum(r.taken for r in after.values()) - total) < 0.25 * total


def test_classifier_rejects_labelled_junk(spark):
    pipe, folder = importlib.import_module("corpus_pipeline"), "/root/testdata/sf0.01"  # sf0.001 has eight bad documents to learn from
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {r.doc_id for r in pipe.quality_classifier(spark, docs, folder).select("doc_id").collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    bad, good = ({r.doc_id for r in labels if r.quality == q} for q in (0, 1))
    assert len(after & bad) <= 0.2 * len(bad) and len(after & good) >= 0.97 * len(good)


def test_edge_rows_pass_through(spark):
    pipe = importlib.import_module("corpus_pipeline")
    text = "The thing of that and this was on with a plain text of some words."
    rows = [(1, text, "en", "a", 10), (2, text, "en", None, 10), (2, text, "en", None, 10), (None, text, None, "a", None), (None, "another text without a name at all", "en", "b", 3), (5, None, None, None, None), (6, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = {name: sorted((r.doc_id for r in stage(spark, docs, SF).collect()), key=str) for name, stage in pipe.STAGES[1:4]}
    assert ids["ngram_jaccard"] == [1, 5, 6, None]
    assert len(ids["decontamination"]) == len(rows)
    after = {r.doc_id: r for r in pipe.suffix_dedup(spark, docs, SF).collect()}
    assert after[5].text is None and after[5].n_chars is None and (after[6].text, after[6].n_chars) == ("", 0)
    two = docs.union(spark.createDataFrame([(6, "a second text of the same document", "en", "a", 34)], docs.schema))
    assert sorted(r.text for r in pipe.ngram_jaccard(spark, two, SF).collect() if r.doc_id == 6) == ["", "a second text of the same document"]
    for _, stage in pipe.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_mixed_texts_stay_in_their_blocks(spark):
    pipe = importlib.import_module("corpus_pipeline")
    rows = [(i % 700, " ".join(["word"] * (i % 9)), "en", "abc"[i % 3], i % 5) for i in range(1500)] + [(9, "the same row", "en", "a", 1)] * 40 + [(None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pipe.source_mixing(spark, docs, SF)
        moved = [part for part in out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted").split("\n\n") if re.match(r"\(\d+\) \w*Exchange", part)]
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert moved and not any("text#" in part.split("Arguments")[0] for part in moved)
    # What the mix takes of equal rows is all on one of them.
    want = Counter()
    for r in pipe.mixing.mix(docs, keep=("text", "lang", "n_chars")).collect():
        want[r.doc_id, r.text, r.lang, r.source, r.n_chars] += r.copies
    assert {(r.doc_id, r.text, r.lang, r.source, r.n_chars): r.copies for r in got} == {k: n for k, n in want.items() if n} and len(got) == len({r[:5] for r in got})
    assert all(r.taken == r.copies * len(words(r.text)) for r in got)


def test_run_is_registered():
    entry = importlib.import_module("__spark_entry__")
    pipe = importlib.import_module("corpus_pipeline")
    assert entry.queries()["pipeline"] is pipe.run
    assert all(f"op{n}_" in " ".join(entry.queries()) for n in range(1, 11))
