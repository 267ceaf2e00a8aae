"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over chunks that overlap and cover the whole
document, each filter keeps its maximum in a chunk, and the chunks' maxima are combined
(largest, smallest and mean over the chunks) into one probability by a small dense layer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk, bytes between chunk starts, embedding size, filter width, filter step, filters, hidden units.
CHUNK, HOP, EMBED, WIDTH, STEP, FILTERS, HIDDEN = 256, 192, 4, 8, 2, 16, 16
#: Bounds of the training sample: documents of each class, bytes of a document in it.
SAMPLE, SAMPLE_BYTES = 1500, 32_768
#: Training steps.
STEPS = 900
#: Chunks scored at once.
BATCH = 512

Params = dict[str, np.ndarray]


def chunks(raw: bytes) -> np.ndarray:
    """Rows of CHUNK bytes that overlap by CHUNK - HOP and cover ``raw``; the last is filled up with zero bytes."""
    n = max(1, -(-(len(raw) - (CHUNK - HOP)) // HOP))
    flat = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (HOP, 1))


def new_params(seed: int = 5) -> Params:
    rng = np.random.default_rng(seed)
    f = np.float32
    return {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(f),
        "filter": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(f),
        "shift": np.zeros(FILTERS, f),
        "dense": rng.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS, HIDDEN)).astype(f),
        "bias": np.zeros(HIDDEN, f),
        "out": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(f),
        "base": np.zeros(1, f),
    }


def filtered(rows: np.ndarray, p: Params) -> np.ndarray:
    """Every filter at every step of every chunk."""
    x = p["embed"][rows].reshape(len(rows), -1)
    steps = (CHUNK - WIDTH) // STEP + 1
    win = np.lib.stride_tricks.as_strided(x, (len(rows), steps, WIDTH * EMBED), (x.strides[0], STEP * EMBED * x.itemsize, x.itemsize))
    return (win.reshape(-1, WIDTH * EMBED) @ p["filter"]).reshape(len(rows), steps, FILTERS)


def pooled(rows: np.ndarray, p: Params) -> np.ndarray:
    """Maximum of each filter in each chunk."""
    return np.maximum(filtered(rows, p).max(axis=1) + p["shift"], 0)


def combine(chunk: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Largest, smallest and mean of the chunks of each document."""
    return np.concatenate([
        np.maximum.reduceat(chunk, starts), np.minimum.reduceat(chunk, starts), np.add.reduceat(chunk, starts) / counts[:, None],
    ], axis=1)


def probability(doc: np.ndarray, p: Params) -> np.ndarray:
    hidden = np.tanh(doc @ p["dense"] + p["bias"])
    return 1 / (1 + np.exp(-np.clip(hidden @ p["out"] + p["base"], -30, 30)))


def score_texts(texts: list[str | None], p: Params) -> np.ndarray:
    """Probability of each text; a document of any length adds its chunks up batch by batch."""
    scores, waiting, sizes = [], [], []

    def flush() -> None:
        if sizes:
            counts = np.array(sizes)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            chunk = np.concatenate(waiting)
            scores.append(probability(combine(chunk, starts, counts), p))
            waiting.clear()
            sizes.clear()

    rows: list[np.ndarray] = []

    def run() -> None:
        if rows:
            waiting.append(pooled(np.concatenate(rows), p))
            rows.clear()

    held = 0
    for text in texts:
        own = chunks((text or "").encode("utf-8", "surrogatepass"))
        for at in range(0, len(own), BATCH):
            rows.append(own[at : at + BATCH])
            held += len(rows[-1])
            if held >= BATCH:
                run()
                held = 0
        sizes.append(len(own))
    run()
    flush()
    return np.concatenate(scores) if scores else np.zeros(0)


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS, batch: int = 32, rate: float = 4e-3, seed: int = 5) -> Params:
    """Adam on the cross entropy, as many steps for few documents as for many; both classes weigh the same. Only a filter's best place in a chunk gets a gradient."""
    p = new_params(seed)
    y = np.asarray(labels, np.float32)
    share = y.mean()
    if share in (0.0, 1.0):  # one class only: a constant answer
        p["out"][:] = 0
        p["base"][:] = 30 if share else -30
        return p
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    data = [chunks(t.encode("utf-8", "surrogatepass")) for t in texts]
    rng = np.random.default_rng(seed)
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    order = np.zeros(0, np.int64)
    while t < steps:
        if not len(order):
            order = rng.permutation(len(data))
        ids, order = order[:batch], order[batch:]
        g = _gradient([data[i] for i in ids], y[ids], weight[ids], p)
        t += 1
        lr = rate * (1 - 0.9 * t / steps)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return p


def _gradient(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, p: Params) -> Params:
    counts = np.array([len(d) for d in docs])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    rows = np.concatenate(docs)
    h = filtered(rows, p)
    at = h.argmax(axis=1)
    chunk = np.maximum(np.take_along_axis(h, at[:, None], 1)[:, 0] + p["shift"], 0)
    doc = combine(chunk, starts, counts)
    hidden = np.tanh(doc @ p["dense"] + p["bias"])
    out = 1 / (1 + np.exp(-np.clip(hidden @ p["out"] + p["base"], -30, 30)))
    d_out = ((out - y) * weight / len(y)).astype(np.float32)
    g = {"out": hidden.T @ d_out, "base": d_out.sum(keepdims=True)}
    d_hidden = d_out[:, None] * p["out"] * (1 - hidden**2)
    g["dense"], g["bias"] = doc.T @ d_hidden, d_hidden.sum(0)
    d_doc = d_hidden @ p["dense"].T
    top, low, mean = np.split(d_doc, 3, axis=1)
    of = np.repeat(np.arange(len(docs)), counts)
    d_chunk = (mean / counts[:, None])[of]
    for part, best in ((top, np.argmax), (low, np.argmin)):
        for i, (s, n) in enumerate(zip(starts, counts)):
            d_chunk[s + best(chunk[s : s + n], axis=0), np.arange(FILTERS)] += part[i]
    d_chunk = np.where(chunk > 0, d_chunk, 0).astype(np.float32)
    g["shift"] = d_chunk.sum(0)
    # bytes under each filter's best place: chunks x filters x width
    place = at[:, :, None] * STEP + np.arange(WIDTH)
    seen = rows[np.arange(len(rows))[:, None, None], place]
    x = p["embed"][seen].reshape(len(rows), FILTERS, -1)
    g["filter"] = np.einsum("cfw,cf->wf", x, d_chunk)
    d_x = (d_chunk[:, :, None] * p["filter"].T[None]).reshape(-1, EMBED)
    flat = seen.reshape(-1)
    g["embed"] = np.stack([np.bincount(flat, weights=d_x[:, e], minlength=256) for e in range(EMBED)], axis=1).astype(np.float32)
    return g


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, seed: int = 5) -> Params:
    """Train on at most ``sample`` documents of each class, those with the smallest hash of their id among the usable labelled ones of at most SAMPLE_BYTES.

    ``usable`` is a condition on doc_id. With no labelled document the answer is 0.5 everywhere.
    """
    known = labels.where(usable & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sized = docs.select("doc_id", F.octet_length("text").alias("bytes")).where(F.col("bytes") <= SAMPLE_BYTES)
    able = known.join(sized.select("doc_id").distinct(), "doc_id")
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    ids = able.where("quality = 0").orderBy(*order).limit(sample).union(able.where("quality = 1").orderBy(*order).limit(sample))
    picked = ids.collect()  # at most 2 * sample rows of two integers
    if not picked:
        return {k: np.zeros_like(v) for k, v in new_params(seed).items()}
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame(picked, ids.schema))  # the same bound
    rows = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"]).toPandas()
    rows = rows.sort_values("doc_id")
    return train(rows["text"].tolist(), rows["quality"].to_numpy(), seed=seed)


def score(docs: DataFrame, params: Params, held_out: Column | None = None, cut: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; each text is scored whole. ``keep`` names more columns to return.

    Null text counts as empty: one chunk of zero bytes. Null ids and repeated rows are scored row by row, an empty
    table gives no rows, extra columns are ignored.
    """
    held = F.lit(False) if held_out is None else held_out
    sent = docs.sparkSession.sparkContext.broadcast(params)  # a few KB by construction

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = score_texts(pdf["text"].tolist(), sent.value).astype(float)
            yield pdf[kept].assign(score=got, predicted=(got >= cut).astype(np.int32))

    kinds = dict(docs.dtypes)
    kept = ["doc_id", *keep, "held_out"]
    rows = docs.select("doc_id", *keep, *([] if "text" in keep else ["text"]), held.alias("held_out"))
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept[:-1]])
    return rows.mapInPandas(run, f"{schema}, held_out boolean, score double, predicted int")
