"""Corpus pipeline: reject, deduplicate, decontaminate and mix the documents of a folder.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns
of ``docs``; rows keep their doc_id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, jaccard, mixing, quality_net, repeats
from ledgerloom.llm.common import crc_fold, from_blocks, row_blocks, table, word_count
from ledgerloom.session import cut_lineage, drop_scratch, scratch_scope

#: SQL can't train the classifier, so the stages are tested against brute force instead.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables of the stage that ran last.
_made: list[str] = []


def tidy(stage: Stage) -> Stage:
    """Delete the scratch tables of the stage before, now that its result is written. If ``docs`` still reads them, they stay."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {path.rsplit("/", 1)[1] for path in _made}
        if not any(names & set(file.split("/")) for file in docs.inputFiles()):
            drop_scratch(spark, _made)
            _made.clear()
        with scratch_scope() as made:
            out = stage(spark, docs, sf_dir)
        _made.extend(made)
        return out

    return run


@tidy
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores below 0.3 go. It learns from the labelled documents of folds 1 to 4 of 5."""
    usable = crc_fold(F.col("doc_id"), 5) != 0
    params = quality_net.fit(docs, table(spark, sf_dir, "labels"), usable)
    others = tuple(c for c in docs.columns if c != "doc_id")
    return quality_net.score(docs, params, keep=others).where("predicted = 1").select(docs.columns)


@tidy
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their 5-word shingles, the one with the smallest doc_id stays.

    Rows with one doc_id are one document: of those with one text a single row stays, picked by a hash of all columns. A row without an id goes if a row with an id has its shingles.
    """
    keyed = docs.withColumn("row_key", F.xxhash64("text"))
    found = jaccard.components(keyed, jaccard.Rule(words=5, num=80, den=100), keep=("row_key",))
    first = cut_lineage(found.where("doc_id = component_id").select("doc_id").distinct(), "pipeline-first")
    everything = [F.col(c) for c in docs.columns]
    one = F.min_by(F.struct(*everything), F.xxhash64(*everything)).alias("row")
    kept = keyed.join(first, "doc_id", "left_semi").groupBy("doc_id", "row_key").agg(one).select("row.*")
    nameless = keyed.where("doc_id is null")
    if nameless.limit(1).count():
        alone = found.where("doc_id is null and component_id is null").select("row_key").distinct()
        kept = kept.unionByName(nameless.join(alone, "row_key", "left_semi").drop("row_key"))
    return kept.select(docs.columns)


@tidy
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that also start in an earlier document are cut out; a document of which nothing is left goes. A null text stays null."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    flag = "no_text"
    while flag in docs.columns:
        flag += "_"
    out = repeats.remove_repeats(docs.withColumn(flag, F.col("text").isNull()), need=50, keep=(*keep, flag)).where("n_removed = 0 or n_removed < n_bytes")
    n_chars = F.when(F.col(flag), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.withColumn("text", F.when(~F.col(flag), F.col("kept_text"))).withColumn("n_chars", n_chars).select(docs.columns)


@tidy
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values in its slots, go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), inside=True).select(docs.columns)


@tidy
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their copies (1 to 3) and the words taken.

    Texts are written once, into a table bucketed by block, and stay there: the mix moves numbers, and its copies come back as one array per block.
    """
    keyed = row_blocks(docs.withColumns({"row_key": F.xxhash64(*docs.columns), "row_words": word_count(F.col("text"))}))
    mixed = cut_lineage(mixing.mix(keyed, keep=("row_key", "row_id"), size=F.col("row_words")), "pipeline-mix")
    same = mixed.groupBy("row_key").agg(F.min("row_id").alias("row_id"), F.sum("copies").alias("copies"), F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    if same.where("rows > 1").limit(1).count():  # of repeated rows one has the copies of all, the others none
        mixed = mixed.select("row_id").join(same, "row_id", "left").na.fill(0, ["copies", "taken"])
    return from_blocks(keyed, mixed, ["copies", "taken"]).where("copies > 0").select(*docs.columns, "copies", "taken")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
