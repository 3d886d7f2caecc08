"""Text quality: random-indexing word vectors, pooled per document, into a calibrated two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gearwatch.llm.common import BATCH_BYTES, bounded_batches, free_names, without_clashes
from gearwatch.llm.neural import Adam, sigmoid, temperature
from gearwatch.llm.words import MARKS, batches, words
from gearwatch.session import materialise

#: Words share this many vectors by hash; each vector has this many dimensions, and an index vector this many signs.
WORDS, DIMS, SIGNS = 8192, 32, 4
#: Neighbours on either side that count as context.
REACH = 2
#: The network is fitted on at most about this many labelled rows, drawn by a hash of the text.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE = 32, 60, 128, 3e-3
#: Of the labelled rows one in this many sets the temperature instead of the weights.
CALIBRATE = 5
OUTPUTS = ("score", "predicted")
TOKENS = 1 << 17


def index_vectors() -> np.ndarray:
    """The fixed sparse ternary vector of each word; the last row, for no word, is zero."""
    rng = np.random.Generator(np.random.PCG64(7))
    out = np.zeros((WORDS + 1, DIMS), np.int16)
    for row in out[:WORDS]:
        row[rng.permutation(DIMS)[:SIGNS]] = rng.choice([-1, 1], SIGNS)
    return out


def token_runs(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, words of a run of texts, index of each word's text); marks are words too."""
    for first, _, buf, starts in batches(texts):
        begin, _, h = words(buf, MARKS)
        yield first, (h >> np.uint64(51)).astype(np.int64) % WORDS, np.searchsorted(starts, begin, "right") - 1


def context_sums(texts: DataFrame) -> DataFrame:
    """One row for each word that occurs, over all texts: (word, n, d0 .. ): occurrences and summed index vectors of neighbours."""
    names = [f"d{i}" for i in range(DIMS)]
    schema = "word int, n long, " + ", ".join(f"{n} long" for n in names)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, total, seen = index_vectors(), np.zeros((WORDS, DIMS), np.int64), np.zeros(WORDS, np.int64)
        for frame in frames:
            for _, word, owner in token_runs(frame["text"].tolist()):
                # Empty places between texts keep the last word of one text from the first of the next.
                spread = np.full(len(word) + REACH * (int(owner[-1]) + 2 if len(owner) else 0), WORDS, np.int64)
                spread[np.arange(len(word)) + REACH * (owner + 1)] = word
                for at in range(0, len(spread), TOKENS):
                    low, high = max(0, at - REACH), min(len(spread), at + TOKENS + REACH)
                    part = spread[low:high]
                    vec = index[part]
                    context = np.zeros_like(vec)
                    for s in range(1, REACH + 1):
                        context[s:] += vec[:-s]
                        context[:-s] += vec[s:]
                    inner = slice(at - low, at - low + min(TOKENS, len(spread) - at))
                    part, context = part[inner], context[inner]
                    order = np.argsort(part.astype(np.uint16), kind="stable")
                    own = part[order]
                    heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    sums = np.add.reduceat(context[order], heads, axis=0, dtype=np.int64)
                    real = own[heads] < WORDS
                    total[own[heads][real]] += sums[real]
                    seen[own[heads][real]] += np.diff(np.r_[heads, len(own)])[real]
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"word": at.astype(np.int32), "n": seen[at]} | {n: total[at, i] for i, n in enumerate(names)})

    parts = bounded_batches(texts).mapInPandas(count, schema)
    return parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ["n", *names]])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit vectors of all ``WORDS`` words (and a zero row); the driver gets at most ``WORDS`` rows."""
    rows = context_sums(texts).toPandas()
    out = np.zeros((WORDS + 1, DIMS), np.float32)
    if len(rows):
        sums = rows[[f"d{i}" for i in range(DIMS)]].to_numpy(np.float64)
        sums -= sums.sum(0) / rows["n"].sum() * rows["n"].to_numpy()[:, None]  # what every word has beside it says little
        out[rows["word"].to_numpy(int)] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return out


def pool_texts(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the word vectors of each whole text."""
    out = np.zeros((len(texts), 2 * DIMS), np.float32)
    for first, word, owner in token_runs(texts):
        if not len(word):
            continue
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        n = np.diff(np.r_[heads, len(owner)])[:, None]
        total, square = np.zeros((2, len(heads), DIMS))
        group = np.cumsum(np.r_[0, owner[1:] != owner[:-1]])
        for at in range(0, len(word), TOKENS):
            part, own = vectors[word[at : at + TOKENS]], group[at : at + TOKENS]
            local = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total[own[local]] += np.add.reduceat(part, local, axis=0, dtype=np.float64)
            square[own[local]] += np.add.reduceat(part * part, local, axis=0, dtype=np.float64)
        mean = total / n
        rows = first + owner[heads]
        out[rows, :DIMS], out[rows, DIMS:] = mean, np.sqrt(np.maximum(square / n - mean * mean, 0))
    return out


def pooled(docs: DataFrame, vectors: np.ndarray, text_column: str, keep: list[str], feature: str) -> DataFrame:
    """``keep`` columns and the pooled word vectors of each whole text as little-endian floats."""

    @F.pandas_udf("binary")
    def pool(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([r.tobytes() for r in pool_texts(series.tolist(), vectors).astype("<f4")], index=series.index)

    return bounded_batches(docs).select(*keep, pool(F.col(text_column)).alias(feature))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.params
        hidden = np.maximum((x - self.mean) / self.scale @ p["w1"] + p["b1"], 0)
        return hidden @ p["w2"] + p["b2"][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> QualityModel:
    """Two layers by Adam on balanced log loss, then one temperature on the rows set aside for it.

    Without rows of both labels the answer is their share for every text (one half without rows).
    """
    x, y = x.astype(np.float64), y.astype(np.float64)
    rng = np.random.default_rng(seed)
    w = {"w1": rng.normal(0, (2 / (2 * DIMS)) ** 0.5, (2 * DIMS, HIDDEN)), "b1": np.zeros(HIDDEN),
         "w2": rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), "b2": np.zeros(1)}
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(2 * DIMS), np.ones(2 * DIMS))
    model = QualityModel(mean, scale, w, 1.0)
    if len(np.unique(y)) < 2:
        w["w2"][:] = 0
        w["b2"][:] = 0 if not len(y) else (6 if y[0] else -6)
        return model
    order = rng.permutation(len(x))
    aside, rest = order[: len(x) // CALIBRATE], order[len(x) // CALIBRATE :]
    if len(np.unique(y[rest])) < 2:
        rest = order
    share = y[rest].mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5  # halfway to equal weight of the labels
    z = (x - mean) / scale
    adam = Adam(w, RATE)
    for _ in range(EPOCHS):
        rng.shuffle(rest)
        for at in range(0, len(rest), BATCH):
            i = rest[at : at + BATCH]
            hidden = np.maximum(z[i] @ w["w1"] + w["b1"], 0)
            d = (sigmoid(hidden @ w["w2"] + w["b2"][0]) - y[i]) * weight[i] / len(i)
            back = np.outer(d, w["w2"]) * (hidden > 0)
            adam.step({"w1": z[i].T @ back + 1e-4 * w["w1"], "b1": back.sum(0), "w2": hidden.T @ d + 1e-4 * w["w2"], "b2": d.sum(keepdims=True)})
    model.temperature = temperature(model.logits(x[aside]), y[aside])
    return model


def features(docs: DataFrame, vectors: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, feature, draw) of every row, stored once: what scores and the draw of a sample are made from."""
    rows = docs.select(id_column, text_column, F.xxhash64(id_column, text_column).alias("draw"))
    return materialise(pooled(rows, vectors, text_column, [id_column, "draw"], "feature"), "quality-features")


def fit_on(rows: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", label_column: str = "quality",
           sample: int = SAMPLE) -> QualityModel:
    """The network for the labelled rows of ``features`` whose ids ``learn`` allows, at most about ``sample`` of them.

    Rows are drawn by a hash of id and text, so equal or null texts of many ids are drawn one by one. Null labels are not
    learned from; of repeated labels of one id the larger counts.
    """
    known = labels.groupBy(id_column).agg(F.max(label_column).cast("int").alias("y")).filter(F.col("y").isNotNull() & learn)
    labelled = rows.join(known, id_column)
    grain = 1 << 30
    share = min(grain, grain * sample // max(labelled.count(), 1) + 1)
    learned = labelled.filter(F.pmod("draw", F.lit(grain)) < share).select("draw", "feature", "y").toPandas()
    learned = learned.sort_values(["draw", "y"])  # at most about ``sample`` rows
    x = np.stack([np.frombuffer(f, "<f4") for f in learned["feature"]]) if len(learned) else np.zeros((0, 2 * DIMS))
    return fit(x, learned["y"].to_numpy())


def fit_sampled(docs: DataFrame, vectors: np.ndarray, labels: DataFrame, learn: Column, id_column: str = "doc_id",
                text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """As ``fit_on`` over ``features``, for a caller that needs no features of the other rows: the same rows are drawn, by ids
    and hashes alone, and only their texts are pooled."""
    keyed = docs.select(id_column, F.xxhash64(id_column, text_column).alias("draw"))
    known = labels.groupBy(id_column).agg(F.max(label_column).cast("int").alias("y")).filter(F.col("y").isNotNull() & learn)
    labelled = materialise(keyed.join(known, id_column).select("draw", "y"), "quality-draws")
    grain = 1 << 30
    share = min(grain, grain * sample // max(labelled.count(), 1) + 1)
    chosen = labelled.filter(F.pmod("draw", F.lit(grain)) < share).groupBy("draw", "y").agg(F.count(F.lit(1)).alias("n"))
    texts = docs.select(text_column, F.xxhash64(id_column, text_column).alias("draw")).join(F.broadcast(chosen), "draw")  # about ``sample`` rows
    learned = pooled(texts.dropDuplicates(["draw", "y"]), vectors, text_column, ["draw", "y", "n"], "feature").toPandas()
    learned = learned.sort_values(["draw", "y"])
    learned = learned.loc[learned.index.repeat(learned["n"])]
    x = np.stack([np.frombuffer(f, "<f4") for f in learned["feature"]]) if len(learned) else np.zeros((0, 2 * DIMS))
    return fit(x, learned["y"].to_numpy())


def with_scores(rows: DataFrame, model: QualityModel, feature: str = "feature", score: str = "score",
                predicted: str = "predicted") -> DataFrame:
    """``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (score >= 0.5) in place of the features."""

    @F.pandas_udf("double")
    def rate(found: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(found), "<f4").reshape(len(found), 2 * DIMS)
        return pd.Series(model.score(x), index=found.index)

    scored = rows.withColumn(score, rate(feature)).drop(feature)
    return scored.withColumn(predicted, (F.col(score) >= 0.5).cast("int"))


def score_quality(docs: DataFrame, vectors: np.ndarray, model: QualityModel, text_column: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``score`` and ``predicted``.

    Null and empty texts are scored as texts without words. Repeated rows get the same score. An empty table gives an
    empty result; columns named like a result are replaced.
    """
    docs = without_clashes(docs, OUTPUTS, (text_column,))
    feature = free_names(docs, "_feature")[0]
    return with_scores(pooled(docs, vectors, text_column, docs.columns, feature), model, feature)


def drop_rejected(docs: DataFrame, vectors: np.ndarray, model: QualityModel, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least one half, with all their own columns."""
    score = free_names(docs, "_score")[0]

    @F.pandas_udf("double")
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(model.score(pool_texts(series.tolist(), vectors)), index=series.index, dtype=float)

    scored = bounded_batches(docs, BATCH_BYTES).withColumn(score, rate(F.col(text_column)))
    return scored.filter(F.col(score) >= 0.5).select(*docs.columns)
