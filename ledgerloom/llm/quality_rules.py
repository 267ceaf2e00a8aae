"""Quality rules: base counts and compression bands."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .common import WORD

# Least and most zstandard ratio (compressed over raw bytes, level 3) of a
# whole text, by its UTF-8 length. Frame overhead makes short texts look incompressible,
# so they have wide bands or none.
BANDS = [
    (64, 0.0, 9.9),
    (128, 0.45, 1.30),
    (256, 0.40, 1.10),
    (512, 0.38, 0.90),
    (1024, 0.36, 0.80),
    (4096, 0.33, 0.72),
    (16384, 0.30, 0.68),
]
#: Band of longer texts, chunk length in bytes, band of a full chunk, share of chunks outside it that rejects.
LONG_BAND, CHUNK, CHUNK_BAND, BAD_SHARE = (0.25, 0.66), 1024, (0.36, 0.72), 0.34

_words, _symbols = re.compile(WORD), "#*$%&|<>"


def repeated_words(words: list[str]) -> int:
    """Words covered by a 3-word window that occurs at least twice, first occurrence included."""
    if len(words) < 4:
        return 0
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    pair = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1]
    _, window, n = np.unique(pair[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    again = n[window] > 1
    covered = np.zeros(len(a), bool)
    for k in range(3):
        covered[k : len(a) - 2 + k] |= again
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if _words.search(line):
            n += line in seen
            seen.add(line)
    return n


def ratio(raw: bytes, press: zstandard.ZstdCompressor) -> float:
    return len(press.compress(raw)) / len(raw)


def in_bands(raw: bytes, press: zstandard.ZstdCompressor) -> tuple[bool, float, float]:
    """Whether a text passes, its whole ratio and the share of its chunks outside the chunk band.

    A text of less than one full chunk is judged as a whole only; a last part shorter than a chunk is covered by a chunk that ends with the text.
    """
    if not raw:
        return True, 0.0, 0.0
    whole = ratio(raw, press)
    low, high = next((band[1:] for band in BANDS if len(raw) < band[0]), LONG_BAND)
    bad = 0.0
    if len(raw) >= CHUNK:
        starts = [*range(0, len(raw) - CHUNK + 1, CHUNK)]
        if starts[-1] + CHUNK < len(raw):
            starts.append(len(raw) - CHUNK)
        out = sum(not CHUNK_BAND[0] <= ratio(raw[s : s + CHUNK], press) <= CHUNK_BAND[1] for s in starts)
        bad = out / len(starts)
    return low <= whole <= high and bad < BAD_SHARE, whole, bad


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every row of ``docs`` (doc_id, text).

    Null or empty text: all counts 0, so base_failed. Null ids and repeated rows are judged row by row; an
    empty table gives no rows; extra columns are ignored; a very long text is compressed whole and chunk by chunk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                text = text or ""
                words = _words.findall(text)
                repeat = repeated_words(words)
                failed = len(words) < 50 or 100 * repeat > 50 * len(words)
                ok, whole, bad = in_bands(text.encode("utf-8", "surrogatepass"), press)
                out.append((
                    len(words), sum(map(len, words)), sum(text.count(c) for c in _symbols), duplicate_lines(text), repeat,
                    failed, ok and not failed, whole, bad,
                ))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "zstd_ratio", "bad_chunk_share"]
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    rows = docs.select("doc_id", "text")
    return rows.mapInPandas(run, (
        f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, zstd_ratio double, bad_chunk_share double"
    ))
