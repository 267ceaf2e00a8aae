"""Language ID by multilingual mixture inference.

Every n-gram of a document is taken as drawn from one of a few languages. Expectation
maximisation estimates the proportions; the set of languages is the one with the best
likelihood less a penalty for each language kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of an n-gram, most and fewest hash bins of the n-grams, code points handled at once, most bytes of a model, bins sent to the driver in a row.
ORDER, BINS, LEAST_BINS, PIECE, MODEL_BYTES, SLAB = 3, 1 << 16, 1 << 8, 1 << 20, 256 << 20, 1 << 12


def grams(padded: str, bins: int = BINS) -> np.ndarray:
    """Bin of each trigram of code points."""
    code = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (code[:-2] * np.uint64(0x9E3779B1) + code[1:-1]) * np.uint64(0x85EBCA6B) + code[2:]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) % bins


def gram_counts(text: str, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bins and their counts of the trigrams of a whole text, lower-cased, with a space before and after it.

    Long texts go piece by piece; pieces overlap by two code points, so each trigram is counted once.
    """
    padded = f" {text.lower()} "
    if len(padded) <= PIECE:
        return np.unique(grams(padded, bins), return_counts=True)
    total = np.zeros(bins, np.int64)
    for at in range(0, len(padded) - ORDER + 1, PIECE):
        total += np.bincount(grams(padded[at : at + PIECE + ORDER - 1], bins), minlength=bins)
    found = np.flatnonzero(total)
    return found, total[found]


def learned_counts(docs: DataFrame, bins: int = BINS) -> DataFrame:
    """Trigram counts of each language over all rows of ``docs`` (text, lang): columns lang, bin, n.

    A task adds up its own table of languages by bins first, so one busy language costs no more than another.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: dict[str, np.ndarray] = {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                own = table.setdefault(lang, np.zeros(bins, np.int64))
                found, n = gram_counts(text, bins)
                own[found] += n
        for lang, own in table.items():
            found = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bin": found.astype(np.int32), "n": own[found]})

    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    return rows.mapInPandas(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    chance: np.ndarray  # bins x languages

    def proportions(self, bins: np.ndarray, n: np.ndarray, rounds: int = 30) -> tuple[list[int], np.ndarray]:
        """The chosen languages and their proportions.

        EM over all languages orders them; of the sets of the 1, 2, ... largest, fitted again, the one with the highest
        log likelihood - (k / 2) log(n-grams) wins, the smaller on ties. The search ends only where no larger set can win: the
        likelihood of any mixture is at most that of the fit over all languages plus n-grams * log(largest gradient).
        """
        p, total = self.chance[bins], n.sum()
        weights = em(p, n, np.full(p.shape[1], 1 / p.shape[1]), rounds)
        order = np.argsort(-weights, kind="stable")
        mixed = p @ weights
        most = float(n @ np.log(mixed)) + total * np.log((p.T @ (n / mixed)).max() / total)
        best, choice = -np.inf, None
        for k in range(1, len(order) + 1):
            cost = 0.5 * k * np.log(total)
            if most - cost <= best:
                break
            use = order[:k]
            part = p[:, use]
            w = np.ones(1)
            if k > 1:
                start = weights[use] + 1e-9  # a weight of zero would stay zero
                w = em(part, n, start / start.sum(), rounds)
            value = float(n @ np.log(part @ w)) - cost
            if value > best:
                best, choice = value, (use.tolist(), w)
        return choice

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(c.isalpha() for c in text):
            return "und", 0.0
        use, w = self.proportions(*gram_counts(text, self.chance.shape[0]))
        top = int(np.argmax(w))
        return self.langs[use[top]], float(min(1.0, w[top]))


def em(p: np.ndarray, n: np.ndarray, w: np.ndarray, rounds: int) -> np.ndarray:
    """Mixture weights after up to ``rounds`` EM steps."""
    total = n.sum()
    for _ in range(rounds):
        new = w * (p.T @ (n / (p @ w))) / total
        new /= new.sum()
        if np.abs(new - w).max() < 1e-4:
            return new
        w = new
    return w


def bins_for(languages: int, bins: int = BINS) -> int:
    """Hash bins of a model of so many languages: halved from ``bins`` until it has no more than MODEL_BYTES."""
    while bins > LEAST_BINS and languages * bins * 8 > MODEL_BYTES:
        bins //= 2
    if languages * bins * 8 > MODEL_BYTES:
        raise ValueError(f"more than {MODEL_BYTES // (8 * bins)} distinct lang values")
    return bins


def fit(docs: DataFrame, bins: int = BINS, smooth: float = 0.5) -> Model:
    """Learn from all rows of ``docs`` with text and lang.

    The driver holds one table of languages by bins, at most MODEL_BYTES: more languages have fewer bins each, down to
    LEAST_BINS (131,072 languages; more are refused). Counts come to it a partition at a time, SLAB bins of a language in a row.
    """
    found = docs.where("text is not null and lang is not null").select("lang").distinct().limit(MODEL_BYTES // (8 * LEAST_BINS) + 1)
    langs = sorted(r.lang for r in found.toLocalIterator())
    bins = bins_for(len(langs), bins)
    table = np.full((bins, max(1, len(langs))), smooth)
    at = {x: i for i, x in enumerate(langs)}

    def slab(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["bin"].to_numpy(np.int64)
        first = own[0] - own[0] % SLAB
        part = np.zeros(min(SLAB, bins - first), np.int64)
        part[own - first] = rows["n"].to_numpy(np.int64)
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "first": [first], "part": [part.tobytes()]})

    slabs = learned_counts(docs, bins).groupBy("lang", (F.col("bin") / SLAB).cast("int").alias("_slab")).applyInPandas(slab, "lang string, first int, part binary")
    for row in slabs.toLocalIterator():
        part = np.frombuffer(row["part"], np.int64)
        table[row["first"] : row["first"] + len(part), at[row["lang"]]] += part
    table /= table.sum(axis=0)
    return Model(langs, table)


def predict(docs: DataFrame, model: Model, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    Null, empty or letterless text: ``und`` with score 0; so is every text when nothing was learned. Null doc_id and
    repeated rows are kept as they are, an empty table gives no rows, extra columns are ignored. Equal proportions: the language that sorts first.
    """
    held = F.lit(False) if held_out is None else held_out
    # At most MODEL_BYTES; plain values, since a broadcast class would have to be importable on the executors.
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.chance))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*sent.value)
        for pdf in batches:
            got = [m.predict(t) for t in pdf.pop("text")]
            yield pdf.assign(lang_pred=[g[0] for g in got], score=[g[1] for g in got])

    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return rows.mapInPandas(score, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
