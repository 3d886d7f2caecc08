"""Language of a text: the nearest of several centroids per language in a space of weighted character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gearwatch.llm.common import bounded_batches, free_names, smallest_draws, without_clashes

DIMS, ORDERS, CLUSTERS = 8192, (1, 2, 3), 4
#: Centroids are fitted on at most this many distinct texts of each language, drawn by a hash of the text.
SAMPLE = 512
#: A text is rejected when its cosine is below this share of its language's training texts, less the slack.
REJECT_SHARE, REJECT_SLACK = 0.01, 0.05
UNKNOWN = "und"
OUTPUTS = ("lang_pred", "nearest", "rejected", "score")
#: What a text must hold to have a language.
LETTER = r"\p{L}"
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


#: Which characters are letters.
IS_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_counts(texts: Sequence[str]) -> np.ndarray:
    """Hashed counts (texts x ``DIMS``) of the character n-grams of lower-case texts, taken in slices of a million.

    Anything but a letter counts as a space; an n-gram has one space at most and is not a space alone.
    """
    out = np.zeros((len(texts), DIMS), np.float32)
    group: list[tuple[int, str]] = []
    size = 0

    def count() -> None:
        chars = np.frombuffer("".join(t for _, t in group).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        letter = IS_LETTER[chars]
        chars[~letter] = 32
        marks = np.concatenate([[0], np.cumsum(~letter)])
        owner = np.repeat(np.arange(len(group)), [len(t) for _, t in group])
        cells, total = len(group) * DIMS, None
        for n in ORDERS:
            m = len(chars) - n + 1
            if m <= 0:
                continue
            code = np.full(m, n, np.uint64)
            for j in range(n):
                code = (code + chars[j : j + m]) * FACTORS[j]
            code ^= code >> np.uint64(29)
            cell = (code * FACTORS[0] >> np.uint64(64 - 13)).astype(np.int64) + owner[:m] * DIMS
            cell = cell[(owner[:m] == owner[n - 1 :]) & (marks[n:] - marks[:-n] <= (n > 1))]
            got = np.bincount(cell, minlength=cells)
            total = got if total is None else total + got
        if total is not None:
            np.add.at(out, [i for i, _ in group], total.reshape(-1, DIMS).astype(np.float32))
        group.clear()

    step, lap = 1 << 20, max(ORDERS) - 1
    for i, text in enumerate(texts):
        text = (text or "").lower()
        for at in range(0, max(1, len(text)), step):
            part = text[max(0, at - lap) : at + step]
            group.append((i, part))
            size += len(part)
            if size >= step or len(group) == 64:
                count()
                size = 0
    if group:
        count()
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray
    names: list[str]

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts) * self.idf)

    def predict(self, texts: Sequence[str]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Nearest language, cosine and whether the text is too far from it."""
        if not self.names:
            return [None] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = self.vectors(gram_counts(texts)) @ self.centroids.T
        best = cosine.argmax(1)
        top = np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(float)
        lang = self.owner[best]
        return [self.names[i] for i in lang], top, top < self.radius[lang]


def cluster(vectors: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means from spread-out first centres; empty clusters are left out."""
    chosen = [int((vectors @ unit(vectors.mean(0, keepdims=True))[0]).argmax())]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int((vectors @ vectors[chosen].T).max(1).argmin()))
    centres = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(1)
        centres = unit(np.stack([vectors[own == i].mean(0) for i in range(len(centres)) if (own == i).any()]))
    return centres


def document_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram occurs, over all rows of ``texts``; the driver gets ``DIMS`` rows."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(DIMS + 1, np.int64)
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame["text"].iloc[at : at + 256].tolist()
                total[:DIMS] += (gram_counts(part) > 0).sum(0)
                total[DIMS] += len(part)
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "n": total[cells]})

    rows = bounded_batches(texts).mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIMS + 1, np.int64)
    out[rows["cell"].to_numpy(int)] = rows["n"].to_numpy(int)
    return out[:DIMS], int(out[DIMS])


def fit(train: DataFrame, text_column: str = "text", lang_column: str = "lang", clusters: int = CLUSTERS,
        sample: int = SAMPLE) -> LanguageModel:
    """Inverse document frequencies of all training rows, and centroids of ``sample`` distinct texts per language (or all it has).

    Rows with a null language or without a letter are not learned from. No row left gives a model without languages.
    """
    rows = train.select(F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).withColumn("draw", F.xxhash64("text"))
    seen, n = document_counts(rows.select("text"))
    if not n:
        return LanguageModel(np.zeros(DIMS, np.float32), np.zeros((0, DIMS)), np.zeros(0, int), np.zeros(0), [])
    idf = (1 + np.log((1 + n) / (1 + seen))).astype(np.float32)
    chosen = smallest_draws(rows, "lang", "draw", sample)
    drawn = rows.join(F.broadcast(chosen), ["lang", "draw"]).dropDuplicates(["lang", "draw"])  # ``sample`` rows per language

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                counts = gram_counts(part["text"].tolist())
                cells = [np.flatnonzero(c).astype("<u2") for c in counts]
                yield pd.DataFrame({"lang": part["lang"].array, "draw": part["draw"].array, "cells": [c.tobytes() for c in cells],
                                    "n": [counts[i, c].astype("<f4").tobytes() for i, c in enumerate(cells)]})

    vectors = drawn.select("lang", "draw", "text").mapInPandas(pack, "lang string, draw long, cells binary, n binary")
    learned = vectors.toPandas().sort_values(["lang", "draw"])  # at most ``sample`` rows for each language
    centroids, owner, radius, names = [], [], [], sorted(learned["lang"].unique())
    for i, name in enumerate(names):
        part = learned[learned["lang"] == name]
        x = np.zeros((len(part), DIMS), np.float32)
        for r, (cells, values) in enumerate(zip(part["cells"], part["n"], strict=True)):
            x[r, np.frombuffer(cells, "<u2")] = np.frombuffer(values, "<f4")
        x = unit(np.log1p(x) * idf)
        own = cluster(x, clusters)
        centroids.append(own)
        owner += [i] * len(own)
        radius.append(float(np.quantile((x @ own.T).max(1), REJECT_SHARE)) - REJECT_SLACK)
    return LanguageModel(idf, np.concatenate(centroids).astype(np.float32), np.array(owner), np.array(radius), names)


def identify(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``lang_pred``, ``nearest``, ``rejected`` and ``score`` (cosine, 0 to 1).

    ``lang_pred`` is the nearest language, or ``und`` if the text is rejected for its distance, null, or without a
    letter; ``nearest`` is null in the last two cases and otherwise a language even if rejected. Whole texts count.
    Repeated rows get the same answer; an empty table gives an empty result; columns named like a result are replaced.
    """
    docs = without_clashes(docs, OUTPUTS, (text_column,))
    found, text = free_names(docs, "_found", "_text")

    @F.pandas_udf("nearest string, score double, rejected boolean")
    def nearest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            out = []
            for at in range(0, len(series), 256):
                part = series.iloc[at : at + 256].tolist()
                names, score, far = model.predict(part)
                out.append(pd.DataFrame({"nearest": np.array(names, object), "score": score, "rejected": far}))
            yield pd.concat(out) if out else pd.DataFrame({"nearest": [], "score": [], "rejected": []})

    rows = bounded_batches(docs).withColumn(found, nearest(F.col(text_column)))
    has = F.coalesce(F.col(text_column).rlike(LETTER), F.lit(False))
    near, far = F.when(has, F.col(f"{found}.nearest")), F.col(f"{found}.rejected") | ~has
    return rows.select(*docs.columns, F.when(far | near.isNull(), UNKNOWN).otherwise(near).alias("lang_pred"), near.alias("nearest"),
                       far.alias("rejected"), F.when(has, F.col(f"{found}.score")).otherwise(0.0).alias("score"))
