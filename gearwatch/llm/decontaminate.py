"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact similarity of multisets."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gearwatch.llm.common import bounded_batches, set_aside, without_clashes
from gearwatch.llm.words import BASE, batches, grams, mix, words

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprint bits, and the distance that is searched in full. Fingerprints are of sets whose elements all weigh the
#: same (see ``elements``), so at the similarity above two of them differ in about 19 of 128 bits, give or take 4,
#: whatever the items are; the radius leaves four deviations.
BITS, RADIUS = 128, 36
#: Words of benchmark text that one pass over the documents is compared with; a larger benchmark takes more passes.
SLICE_WORDS = 2_000_000
OUTPUTS = ("contaminated", "items", "n_passages", "similarity")
PAIRS = 1 << 21
FILTER = 1 << 20


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles; of the whole sequence if it is shorter."""
    return grams(hashes, min(SHINGLE, max(1, len(hashes))))


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of the fingerprint of each shingle."""
    bits = np.concatenate([mix(shingles + np.uint64(i + 1)).view(np.uint8).reshape(-1, 8) for i in range(BITS // 64)], 1)
    return np.unpackbits(bits, axis=1).astype(np.int64) * 2 - 1


def elements(shingles: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The element that each place adds to a sliding window of ``m`` shingles when it enters, and takes out when it leaves.

    The j-th occurrence of a shingle in a window is an element of its own, so a window is a set without weights, and the
    Jaccard similarity of two such sets is that of the multisets.
    """
    n, place = len(shingles), np.arange(len(shingles))
    group = np.unique(shingles, return_inverse=True)[1] * n
    ordered = np.sort(group + place)
    at = np.searchsorted(ordered, group + place)
    enters = at - np.searchsorted(ordered, group + np.maximum(place - m + 1, 0))
    leaves = np.searchsorted(ordered, group + np.minimum(place + m - 1, n - 1), "right") - at - 1
    return shingles + enters.astype(np.uint64) * BASE, shingles + leaves.astype(np.uint64) * BASE


def window_prints(shingles: np.ndarray, m: int) -> np.ndarray:
    """Fingerprint of each window of ``m`` shingles."""
    enters, leaves = elements(shingles, m)
    come = signs(enters)
    go = come if np.array_equal(enters, leaves) else signs(leaves)
    sums = np.cumsum(come, 0)[m - 1 :]
    sums[1:] -= np.cumsum(go, 0)[: len(shingles) - m]
    return packed(sums)


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as words of 64 bits."""
    return np.packbits(sums > 0, axis=1).view(np.uint64)


class Index:
    """Fingerprints of the items of one length, in ``RADIUS`` + 1 blocks of bits.

    Two fingerprints at most ``RADIUS`` bits apart agree in one block at least, so looking up every block of a window
    finds all items inside the radius.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        edges = np.linspace(0, BITS, RADIUS + 2).round().astype(int)
        self.blocks = list(zip(edges[:-1], edges[1:], strict=True))
        self.keys = self.block_keys(prints)
        self.tables = [defaultdict(list) for _ in self.blocks]
        for b, table in enumerate(self.tables):
            for i, key in enumerate(self.keys[:, b]):
                table[int(key)].append(i)

    def block_keys(self, prints: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1)
        return np.stack([bits[:, a:b] @ (1 << np.arange(b - a)) for a, b in self.blocks], 1)

    def near(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, items) at most ``RADIUS`` bits apart, a bounded number of candidates at a time."""
        step = max(1, PAIRS // len(self.prints))
        for at in range(0, len(prints), step):
            part = prints[at : at + step]
            found = np.zeros((len(part), len(self.prints)), bool)
            for key, table in zip(self.block_keys(part).T, self.tables, strict=True):
                for value, items in table.items():
                    rows = np.flatnonzero(key == value)
                    if len(rows):
                        found[np.ix_(rows, items)] = True
            window, item = np.nonzero(found)
            apart = np.bitwise_count(part[window] ^ self.prints[item]).sum(1)
            yield window[apart <= RADIUS] + at, item[apart <= RADIUS]


class Benchmark:
    """The items of one slice, by their number of words: counts, fingerprints, and a filter of their shingles."""

    def __init__(self, items: list[tuple[int, str | None]]):
        sets: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for first, _, buf, starts in batches([t for _, t in items], lower=True):
            begin, _, h = words(buf)
            bounds = np.searchsorted(begin, starts)
            for i in range(len(starts) - 1):
                own = h[bounds[i] : bounds[i + 1]]
                if len(own):
                    sets[len(own)].append((items[first + i][0], shingles_of(own)))
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *[s for own in sets.values() for _, s in own]]))
        self.filter = np.zeros(FILTER, bool)
        self.filter[(self.known & np.uint64(FILTER - 1)).astype(np.int64)] = True
        self.lengths = {}
        for n, own in sets.items():
            counts = [self.counted(s) for _, s in own]
            prints = np.concatenate([window_prints(s, len(s)) for _, s in own])
            shared = np.zeros(len(self.known), bool)
            for _, s in own:
                shared[np.searchsorted(self.known, s)] = True
            self.lengths[n] = ([i for i, _ in own], counts, Index(prints), shared)

    def counted(self, shingles: np.ndarray) -> dict[int, int]:
        values, n = np.unique(shingles, return_counts=True)
        return dict(zip(values.tolist(), n.tolist(), strict=True))

    def similarity(self, window: dict[int, int], item: dict[int, int]) -> float:
        """Jaccard of multisets: sum of the lesser counts over sum of the greater ones."""
        both = sum(min(v, item[k]) for k, v in window.items() if k in item)
        return both / (sum(window.values()) + sum(item.values()) - both)

    def passages(self, hashes: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of each place of a text that is like an item."""
        if not len(hashes) or not len(self.known):
            return []
        by_length = {k: grams(hashes, k) for k in {min(SHINGLE, n) for n in self.lengths}}
        hits = {}
        for k, s in by_length.items():
            maybe = np.flatnonzero(self.filter[(s & np.uint64(FILTER - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.known, s[maybe]), len(self.known) - 1)
            real = self.known[at] == s[maybe]
            hits[k] = maybe[real], at[real]
        out = []
        for n, (items, counts, index, shared) in self.lengths.items():
            k = min(SHINGLE, n)
            place, number = hits[k]
            place = place[shared[number]]
            size = min(n, len(hashes))  # a text shorter than the item is a window as a whole
            m, last = size - k + 1, len(hashes) - size
            if not len(place) or m / (n - k + 1) < SIMILARITY:  # the similarity is at most the ratio of the sizes
                continue
            # Windows without a shingle of an item of this length have similarity 0 to all of them.
            step = np.zeros(last + 2, np.int64)
            np.add.at(step, np.clip(place - m + 1, 0, last + 1), 1)
            np.add.at(step, np.minimum(place, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(step[:-1]) > 0)
            out += self.matches(by_length[k], starts, m, size, items, counts, index)
        return out

    def matches(self, s, starts, m, n, items, counts, index) -> list[tuple[int, int, int, float]]:
        best: dict[int, list] = defaultdict(list)
        for a in range(0, len(starts), 4096):
            part = starts[a : a + 4096]
            for run in np.split(part, np.flatnonzero(np.diff(part) != 1) + 1):
                own = s[run[0] : run[-1] + m]
                for window, item in index.near(window_prints(own, m)):
                    for w, i in zip(window.tolist(), item.tolist(), strict=True):
                        value = self.similarity(self.counted(own[w : w + m]), counts[i])
                        if value >= SIMILARITY:
                            best[i].append((int(run[0]) + w, value))
        out = []
        for i, found in best.items():
            found.sort()
            held = found[0]
            for place in found[1:]:
                if place[0] < held[0] + n:  # windows that overlap are one passage; the likest stands for it
                    held = max(held, place, key=lambda x: (x[1], -x[0]))
                else:
                    out.append((items[i], held[0], n, held[1]))
                    held = place
            out.append((items[i], held[0], n, held[1]))
        return out


def slices(items: DataFrame, item_column: str, text_column: str, bound: int) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark in parts of about ``bound`` words, one at a time."""
    size = items.agg(F.sum(F.octet_length(text_column)).alias("n")).first()["n"] or 0
    parts = int(size // (bound * 4)) + 1
    rows = items.select(F.col(item_column).cast("long").alias("i"), F.col(text_column).alias("t"))
    for part in range(parts):
        own = rows.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == part) if parts > 1 else rows
        yield sorted((r["i"], r["t"]) for r in own.filter("i IS NOT NULL AND t IS NOT NULL").collect())


def finder(benchmark: Benchmark):
    """A function of a text column that gives the passages of each text."""

    @F.pandas_udf("array<struct<item: long, first: long, words: long, similarity: double>>")
    def passages(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            out = []
            for _, _, buf, starts in batches(series.tolist(), lower=True):
                begin, _, h = words(buf)
                bounds = np.searchsorted(begin, starts)
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    out.append([dict(zip(("item", "first", "words", "similarity"), p, strict=True)) for p in benchmark.passages(h[a:b])])
            yield pd.Series(out, index=series.index, dtype=object)

    return passages


def find_passages(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
                  item_text: str = "text", bound: int = SLICE_WORDS) -> DataFrame:
    """(row columns without the text, passages): every row of ``docs`` with its passages that are like an item.

    A passage is (item, first word, words, similarity). Each item of n words is compared with every n-word window that
    shares a shingle with an item of that length: windows inside the Hamming radius of its fingerprint are verified by
    Jaccard similarity of the multisets of shingles, whatever other items hold. Words are lower-cased runs without white
    space. The benchmark reaches the tasks in slices of about ``bound`` words.

    Null and empty texts have no passages; items without words match nothing; equal items match both. A text shorter
    than an item is compared with it as a whole. Repeated rows get the same passages.
    """
    columns = [finder(Benchmark(part))(F.col(text_column)) for part in slices(items, item_column, item_text, bound)]
    return bounded_batches(docs).withColumn("passages", F.array_sort(F.concat(*columns)) if len(columns) > 1 else F.array_sort(columns[0]))


def mark_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``contaminated``, the sorted distinct ``items``, ``n_passages`` and best ``similarity`` (null: none).

    Columns of ``docs`` with the name of a result column are replaced; an empty table gives an empty result.
    """
    docs = without_clashes(docs, (*OUTPUTS, "passages"), (id_column, text_column))
    found = find_passages(docs, items, id_column, text_column)
    return found.select(
        *docs.columns,
        (F.size("passages") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.col("passages.item"))).alias("items"),
        F.size("passages").cast("long").alias("n_passages"),
        F.array_max(F.col("passages.similarity")).alias("similarity"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, with their own columns."""
    rows, own = set_aside(docs, (*OUTPUTS, "passages"), (id_column, text_column))
    return mark_contaminated(rows, items, id_column, text_column).filter(~F.col("contaminated")).select(*own)
