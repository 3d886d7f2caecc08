"""Near duplicates: SetSketch registers, banded; likelihood estimates; links verified on full shingle sets; components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from gearwatch.llm.common import bounded_batches
from gearwatch.llm.words import BASE, batches, grams, mix, words
from gearwatch.session import materialise

#: A link: PARTS * intersection >= SHARE * union of the sets of SHINGLE-word shingles.
SHINGLE, SHARE, PARTS = 5, 80, 100
#: Registers per set, and registers per band. Equal registers are about as likely as the similarity, so a pair at 0.8
#: meets in none of the 32 bands with probability (1 - 0.8 ** 4) ** 32, under one in ten million.
REGISTERS, BAND = 128, 4
#: Spacing of the register values, rate of the exponential values, largest register (two bytes).
SPACING, RATE, LIMIT = 1.005, 20.0, 65_535
#: Pairs whose estimate is this far below the threshold are not compared in full: over five deviations of the estimate.
MARGIN = 0.2
#: Rows of a cluster that are compared with each other in one go.
BLOCK = 256
OUTPUTS = ("n_shingles", "component_id", "kept")

_RNG = np.random.Generator(np.random.PCG64(99))
FACTORS = _RNG.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each text; of all its words if they are fewer."""
    for first, last, buf, starts in batches(texts, lower=True):
        begin, _, h = words(buf)
        bounds = np.searchsorted(begin, starts)
        for i in range(last - first):
            own = h[bounds[i] : bounds[i + 1]]
            if 0 < len(own) < k:
                own = mix(np.array([np.bitwise_xor.reduce(own * np.arange(1, 2 * len(own), 2, dtype=np.uint64)) + np.uint64(len(own))]))
                yield own
            else:
                yield np.unique(grams(own, k))


def registers(shingles: np.ndarray) -> np.ndarray:
    """For each register the least of exponential values, on a logarithmic scale and truncated to 0 .. ``LIMIT``.

    Registers of a union are the greatest of those of its parts.
    """
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * FACTORS + SHIFTS
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(0), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(SPACING)) + LIMIT // 8, 0, LIMIT).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Likeliest similarity of each pair from how many registers are greater, smaller and equal, and the set sizes."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - above - below
    u = size_a / (size_a + size_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[:, None] * top
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (SPACING - 1) / SPACING) / np.log(SPACING)
    more, less = np.clip(chance(u - v * grid), 1e-9, 1), np.clip(chance(v - u * grid), 1e-9, 1)
    same = np.clip(1 - more - less, 1e-9, 1)
    fit = above * np.log(more) + below * np.log(less) + equal * np.log(same)
    return grid[fit.argmax(0), np.arange(len(u))]


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that stand for a whole sorted set."""
    twist = np.arange(1, 2 * len(shingles) + 1, 2, dtype=np.uint64)
    return (int(np.bitwise_xor.reduce(mix(shingles * twist)).view(np.int64)) if len(shingles) else 0,
            int(mix(np.cumsum(shingles * twist + BASE, dtype=np.uint64)[-1:])[0].view(np.int64)) if len(shingles) else 0)


def sketches(docs: DataFrame, k: int, id_column: str, text_column: str) -> DataFrame:
    """(id, n, d1, d2, registers) of every row: size, digest and sketch of its set; no sketch for an empty set."""

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at : at + 1024]
                rows = [(len(s), *digest(s), registers(s).tobytes() if len(s) else None) for s in shingle_sets(part["text"].tolist(), k)]
                yield pd.DataFrame({"id": part["id"].array} | dict(zip(("n", "d1", "d2", "registers"), zip(*rows, strict=True), strict=True)))

    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))  # null ids stay null
    found = bounded_batches(rows).mapInPandas(sketch, "id string, n long, d1 long, d2 long, registers binary")
    return found.withColumn("id", F.col("id").cast(kind))


def bands(sets: DataFrame, width: int = BAND) -> DataFrame:
    """(key, id): one key for each band of registers of each set."""

    @F.pandas_udf("array<long>")
    def keys(found: pd.Series) -> pd.Series:
        r = np.frombuffer(b"".join(found), "<u2").reshape(len(found), -1, width).astype(np.uint64)
        h = np.zeros(r.shape[:2], np.uint64) + np.arange(1, r.shape[1] + 1, dtype=np.uint64)
        for j in range(width):
            h = mix(h * BASE + r[:, :, j])
        return pd.Series(list(h.view(np.int64)), index=found.index)

    return sets.select(F.explode(keys("registers")).alias("key"), "id")


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose sizes allow a link and whose estimate is not far below it."""

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                a, b = (np.frombuffer(b"".join(frame[c]), "<u2").reshape(len(frame), -1) for c in ("ra", "rb"))
                guess = estimate(a, b, frame["na"].to_numpy(float), frame["nb"].to_numpy(float))
                yield frame.loc[guess >= SHARE / PARTS - MARGIN, ["a", "b"]]

    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    kind = dict(sets.dtypes)["id"]
    return both.filter(PARTS * small >= SHARE * large).mapInPandas(keep, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold, exactly."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = []
            for x, y in zip(frame["sa"], frame["sb"], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(PARTS * both >= SHARE * (len(x) + len(y) - both))
            yield frame.loc[good, ["a", "b"]]

    side = lambda c: full.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}"))
    kind = dict(full.dtypes)["id"]
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(check, f"a {kind}, b {kind}")


def full_sets(docs: DataFrame, ids: DataFrame, k: int, id_column: str, text_column: str) -> DataFrame:
    """(id, shingles) of the rows of ``docs`` whose id is wanted, one row for each id."""
    kind = dict(docs.dtypes)[id_column]

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512]
                yield pd.DataFrame({"id": part["id"].array, "shingles": [s.tobytes() for s in shingle_sets(part["text"].tolist(), k)]})

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(ids, "id")
    return bounded_batches(rows).dropDuplicates(["id"]).mapInPandas(build, f"id {kind}, shingles binary")


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b), a <= b, that lead to the same components: each row keeps its link to the smallest of its leaders, and its
    other leaders are linked with that one instead. Rows of a large group have the same leaders, so these links are few."""
    least = F.min("a").over(W.partitionBy("b"))  # a row has at most one leader for each band
    moved = links.select("a", "b", least.alias("m"))
    own = moved.select(F.col("m").alias("a"), "b")
    return own.unionByName(moved.filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id of the links (a, b): the smallest id that links lead to.

    Each round takes the least label among neighbours, then the label of the label, until none changes.
    """
    links = materialise(thinned(links), "near-forest")
    both = materialise(links.union(links.select("b", "a")).toDF("id", "other").distinct(), "near-edges")
    labels = materialise(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "near-labels")
    while True:
        other = labels.select(F.col("id").alias("other"), F.col("component").alias("near"))
        least = both.join(other, "other").groupBy("id").agg(F.min("near").alias("near"))
        step = materialise(
            labels.join(least, "id").select("id", "component", F.least("component", "near").alias("next")), "near-labels")
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("beyond"))
        step = materialise(step.join(jump, "next").select("id", "component", F.least("next", "beyond").alias("next")), "near-labels")
        changed = step.filter("next != component").limit(1).count()
        labels = step.select("id", F.col("next").alias("component"))
        if not changed:
            return labels


def grouped(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of one key at a time, from rows sorted by the keys."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        mark = frame[keys].to_numpy()
        heads = [0, *(np.flatnonzero((mark[1:] != mark[:-1]).any(1)) + 1), len(frame)]
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            if held and (held[-1][keys].to_numpy()[-1] != mark[a]).any():
                yield pd.concat(held)
                held = []
            held.append(frame.iloc[a:b])
    if held:
        yield pd.concat(held)


def across(members: DataFrame, sets: DataFrame, full: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): verified links between different components of one cluster, from ``members`` (cluster, id, component).

    A cluster holds all rows that buckets lead to from one of them. It is cut into blocks of about ``block`` rows and
    every two blocks meet once, so a cluster of any size is compared in full by many tasks. Pairs that share a band
    and have a likely estimate are compared on their full sets inside the task; a link leaves it only if it joins two
    components that no other link of the task has joined.
    """
    kind = dict(sets.dtypes)["id"]
    parts = materialise(members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")), "near-clusters")
    rows = members.join(parts, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.join(sets.select("id", "n", "registers"), "id").join(full, "id")
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns(
        {"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def links(frame: pd.DataFrame) -> list[tuple]:
        ids, n, own = (frame[c].to_numpy() for c in ("id", "n", "own"))
        root = {c: c for c in frame["component"].tolist()}
        comp = frame["component"].tolist()
        full_sets = [np.frombuffer(x, "<u8") for x in frame["shingles"]]
        r = np.frombuffer(b"".join(frame["registers"]), "<u2").reshape(len(frame), -1)
        h = np.zeros((len(frame), r.shape[1] // BAND), np.uint64)
        for j in range(BAND):
            h = mix(h * BASE + r.reshape(len(frame), -1, BAND)[:, :, j].astype(np.uint64))
        same, out = frame["low"].iloc[0] == frame["high"].iloc[0], []

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for i in range(len(frame)):
            j = np.arange(i + 1, len(frame))
            j = j[(own[j] != own[i]) | same]
            j = j[PARTS * np.minimum(n[j], n[i]) >= SHARE * np.maximum(n[j], n[i])]
            mine = top(comp[i])
            j = j[[top(comp[x]) != mine for x in j]] if len(j) else j
            j = j[(h[j] == h[i]).any(1)]
            if not len(j):
                continue
            guess = estimate(np.broadcast_to(r[i], (len(j), r.shape[1])), r[j], np.full(len(j), float(n[i])), n[j].astype(float))
            for x in j[guess >= SHARE / PARTS - MARGIN].tolist():
                if top(comp[x]) != top(comp[i]):
                    both = len(np.intersect1d(full_sets[i], full_sets[x], assume_unique=True))
                    if PARTS * both >= SHARE * (n[i] + n[x] - both):
                        root[top(comp[x])] = top(comp[i])
                        out.append((min(ids[i], ids[x]), max(ids[i], ids[x])))
        return out

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in grouped(frames, ["cluster", "low", "high"]):
            yield pd.DataFrame(links(frame), columns=["a", "b"])

    dealt = spread.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "id")
    return dealt.mapInPandas(each, f"a {kind}, b {kind}")


def mark_near_duplicates(docs: DataFrame, k: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs`` (columns named like a result are not returned).

    Rows with one set are one class, whose smallest id stands for it. Classes that share a band are candidates. First
    each class is compared with the smallest of its bucket, which settles groups of near copies without pairing them;
    what buckets with several components lead to is then compared in full, block by block. Links are verified on the
    full sets; ``component_id`` is the smallest id that links lead to, and that row is kept.

    A row without words has an empty set and is linked with nothing; so is a row with a null id, which is kept.
    Repeated rows with one id share its fate. An empty table gives an empty result.
    """
    all_rows = materialise(sketches(docs, k, id_column, text_column), "near-sketches")
    real = all_rows.filter("n > 0 AND id IS NOT NULL")
    classes = materialise(real.groupBy("d1", "d2", "n", "registers").agg(F.min("id").alias("id")), "near-classes")
    met = bands(classes)
    leaders = materialise(
        met.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size"), "near-buckets")
    members = materialise(met.join(leaders, "key"), "near-members")
    star = members.filter("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    star = materialise(likely(star, classes), "near-pairs")
    ids = members.select("id").distinct()
    full = materialise(full_sets(docs, ids, k, id_column, text_column), "near-sets")
    links = materialise(verified(star, full), "near-links")
    first = components(links)

    placed = members.select("key", "id").join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    placed = materialise(placed, "near-members")
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("id").alias("first")).filter("x != y")
    rest = materialise(placed.join(materialise(mixed.select("key", "first"), "near-mixed"), "key"), "near-rest")
    more = None
    if rest.limit(1).count():
        clusters = components(rest.select(F.col("first").alias("a"), F.col("id").alias("b"))).withColumnRenamed("component", "cluster")
        open_rows = rest.select("id", "component").distinct().join(clusters, "id")
        more = materialise(across(open_rows, classes, full), "near-links")
    final = components(links.union(more)) if more is not None and more.limit(1).count() else first

    named = classes.join(final, "id", "left").select("d1", "d2", "n", F.coalesce("component", "id").alias("component"))
    named = materialise(named, "near-classes")
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("id"))
    return all_rows.join(named, ["d1", "d2", "n"], "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id stays for its component, with their own columns; null ids stay too."""
    marks = materialise(mark_near_duplicates(docs, k, id_column, text_column), "near-marks")
    gone = marks.filter(~F.col("kept")).select(id_column).distinct()
    return docs.join(gone, id_column, "left_anti").select(*docs.columns)
