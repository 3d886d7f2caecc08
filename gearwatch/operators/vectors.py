"""Nearest vectors: exact at any size by blocks as rows of one shuffle, or among the buckets of random projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from gearwatch.operators.series import numbered
from gearwatch.session import materialise

#: Queries that a task holds at most and the bytes that they may take, corpus rows that it compares with them in one go, and
#: queries of one product of matrices.
GROUP_ROWS, GROUP_BYTES, STEP_ROWS, BLOCK_ROWS = 32_768, 64 << 20, 1024, 512
#: Candidates that wait for being merged with the best rows so far, and those that are measured again in one go.
PENDING_ROWS, EXACT_ROWS = 100_000, 65_536
#: Bytes of the vectors of a stored block, and the largest norm whose square is safe in single precision.
STORED_BYTES, SINGLE_NORM = 4 << 20, 1e15
#: Rows of a strip of vectors of few numbers.
STRIP_ROWS = 2048
#: Corpus rows of a bucket that one task compares, and rows that an index is fitted on at most.
BUCKET_ROWS, FIT_ROWS = 50_000, 2000
#: Queries whose buckets are put in order at once.
PROBE_ROWS = 512


def best_rows(frame: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The ``keep`` highest scores per query, smaller id first on equal scores."""
    frame = frame.sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable")
    return frame[frame.groupby("q").cumcount() < keep]


def matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors])


class Best:
    """The best rows so far of a group of queries, fed with slices of the corpus; memory depends on the group only."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int, floor: float | None, metric: str, exclude_self: bool):
        self.ids, self.vectors, self.keep, self.floor, self.metric, self.exclude_self = ids, vectors, keep, floor, metric, exclude_self
        self.norm = np.linalg.norm(vectors, axis=1)
        self.found: pd.DataFrame | None = None  # queries stand in it by their place in the group
        self.waiting: list[pd.DataFrame] = []
        self.limit = np.where(self._usable(self.norm), -np.inf, np.inf)  # scores below it are no longer of use
        self.rough: np.ndarray | None = None  # single precision is enough to tell what is far
        if metric == "euclid" and self.norm[self._usable(self.norm)].max(initial=0.0) < SINGLE_NORM:
            with np.errstate(over="ignore"):
                self.rough = np.column_stack([vectors, np.ones(len(ids))]).astype(np.float32)
        elif metric == "cosine":
            self.rough = self._unit(vectors, self.norm)
        self.code, known = pd.factorize(ids)
        self.known = pd.Index(known)

    def _usable(self, size: np.ndarray) -> np.ndarray:
        return np.isfinite(size) & (size > 0) if self.metric == "cosine" else np.isfinite(size)

    def _unit(self, vectors: np.ndarray, size: np.ndarray) -> np.ndarray:
        fit = self._usable(size)
        return np.where(fit[:, None], vectors / np.where(fit, size, 1.0)[:, None], 0).astype(np.float32)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        size = np.linalg.norm(vectors, axis=1)
        fit = self._usable(size)
        if not fit.all():
            ids, vectors, size = ids[fit], vectors[fit], size[fit]
        if not len(ids):
            return
        code = self.known.get_indexer(ids) if self.exclude_self else None
        rough = None
        if self.metric == "cosine":
            # A floor alone bounds little, so the first rows are compared in full.
            rough = None if self.found is None else self._unit(vectors, size)
        elif self.rough is not None and size.max() < SINGLE_NORM:
            rough = np.column_stack([vectors, -(size**2) / 2]).astype(np.float32)
        for at in range(0, len(self.ids), BLOCK_ROWS):
            block = slice(at, at + BLOCK_ROWS)
            if rough is not None and not np.isneginf(self._least(block)).any():
                i, j = self._within(block, rough, size)
                if code is not None:
                    other = self.code[block][i] != code[j]
                    i, j = i[other], j[other]
                self._take(block, i, j, ids, vectors, size)
            else:
                self._compare(block, ids, vectors, size, code)
        # Limits are worth most at once: without them every pair is measured in full.
        unbounded = self.rough is not None and (np.isneginf(self._least(slice(None))).any() or self.found is None)
        if unbounded or sum(map(len, self.waiting)) >= max(PENDING_ROWS, 0 if self.found is None else len(self.found)):
            self.merge()

    def _least(self, block: slice) -> np.ndarray:
        return self.limit[block] if self.floor is None else np.maximum(self.limit[block], self.floor)

    def _within(self, block: slice, rough: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may be as near as the limits ask, in single precision by q.v - v.v / 2 or by the cosine: one product and one comparison.

        The slack covers the rounding of the numbers, of the sums and of the limit, so no pair within the limit is lost.
        """
        norm, top, unit = self.norm[block], size.max(), float(np.finfo(np.float32).eps)
        if self.metric == "cosine":
            cut = self._least(block) - 2e-9 - unit * (rough.shape[1] + 8)
            hit = np.flatnonzero(self.rough[block] @ rough.T >= cut.astype(np.float32)[:, None])
            return np.divmod(hit, len(rough))
        with np.errstate(invalid="ignore", over="ignore"):
            cut = (norm**2 - (2e-9 - self._least(block)) ** 2) / 2 - unit * (rough.shape[1] + 8) * (norm * top + top**2)
            cut -= 4 * unit * np.abs(cut) + 1e-30
            hit = np.flatnonzero(self.rough[block] @ rough.T >= cut.astype(np.float32)[:, None])
        return np.divmod(hit, len(rough))

    def _take(self, block: slice, i: np.ndarray, j: np.ndarray, ids: np.ndarray, vectors: np.ndarray, size: np.ndarray) -> None:
        """Measure the pairs in full and keep those that the limits still ask for."""
        own, least = self.vectors[block], self._least(block)
        for at in range(0, len(i), EXACT_ROWS):
            a, b = i[at : at + EXACT_ROWS], j[at : at + EXACT_ROWS]
            if self.metric == "cosine":
                value = np.round(np.einsum("nd,nd->n", own[a], vectors[b]) / self.norm[block][a] / size[b], 9)
            else:
                value = -np.round(np.linalg.norm(own[a] - vectors[b], axis=1), 9)
            near = value >= least[a]
            if near.any():
                self.waiting.append(pd.DataFrame({"q": a[near] + block.start, "id": ids[b[near]], "score": value[near]}))

    def _compare(self, block: slice, ids: np.ndarray, vectors: np.ndarray, size: np.ndarray, code: np.ndarray | None) -> None:
        own, norm = self.vectors[block], self.norm[block]
        score = own @ vectors.T
        if self.metric == "cosine":
            with np.errstate(divide="ignore", invalid="ignore"):
                score /= norm[:, None]
                score /= size
            slack = 2e-9  # what is near the limit is rounded before it is judged
        else:
            square = norm[:, None] ** 2 + size**2
            score *= -2
            score += square
            score = -np.sqrt(np.maximum(score, 0, out=score), out=score)
            # Sums of products are rough where vectors are near each other; what may be among the best is measured again.
            slack = 2e-9 + np.sqrt(1e-14 * np.nanmax(square, initial=0.0) * vectors.shape[1])
        if code is not None:
            score[self.code[block][:, None] == code] = np.nan
        score[np.isnan(score)] = -np.inf
        score[~self._usable(norm)] = -np.inf
        cut = self.limit[block]
        if score.shape[1] > self.keep and not np.isfinite(cut).all():
            cut = np.maximum(cut, np.partition(score, -self.keep, axis=1)[:, -self.keep])
        if self.floor is not None:
            cut = np.maximum(cut, self.floor)
        i, j = np.nonzero((score >= (cut - 2 * slack)[:, None]) & (score > -np.inf))
        if self.metric == "cosine":
            value = np.round(score[i, j], 9)
        else:
            return self._take(block, i, j, ids, vectors, size)
        near = value >= self._least(block)[i]
        if near.any():
            self.waiting.append(pd.DataFrame({"q": i[near] + block.start, "id": ids[j[near]], "score": value[near]}))

    def merge(self) -> None:
        if not self.waiting:
            return
        self.found = best_rows(pd.concat([*([] if self.found is None else [self.found]), *self.waiting]), self.keep)
        self.waiting = []
        own = self.found.groupby("q")["score"].agg(["min", "size"])
        full = own["min"][own["size"] >= self.keep]
        self.limit[full.index] = full.to_numpy()

    def result(self) -> Iterator[pd.DataFrame]:
        self.merge()
        if self.found is not None:
            yield self.found.assign(q=self.ids[self.found["q"]])


def _comparer(keep: int, floor: float | None, metric: str, exclude_self: bool):
    """The best rows of each cell (g, s), whose queries (side 0) come before its corpus rows (side 1)."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held, best = None, [], None
        for frame in frames:
            for (g, s, side), part in frame.groupby(["g", "s", "side"], sort=True):
                if (g, s) != cell:
                    if best is not None:
                        yield from best.result()
                    cell, held, best = (g, s), [], None
                if side == 0:
                    held.append((part["q"].to_numpy(), matrix(part["v"])))
                    continue
                if best is None:
                    if not held:
                        continue  # no query in this cell
                    best = Best(np.concatenate([q for q, _ in held]), np.concatenate([v for _, v in held]), keep, floor, metric, exclude_self)
                    held = []
                for at in range(0, len(part), STEP_ROWS):
                    some = part.iloc[at : at + STEP_ROWS]
                    best.add(some["id"].to_numpy(), matrix(some["v"]))
        if best is not None:
            yield from best.result()

    return compare


def stored_blocks(rows: DataFrame, key: str, width: int, single: bool, names: tuple[str, str, str]) -> DataFrame:
    """``names`` (number, ids, bytes): the rows (key, v) in blocks whose vectors of ``width`` take ``STORED_BYTES`` at most, written once."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    most = max(1, STORED_BYTES // ((4 if single else 8) * max(width, 1)))
    size = min(most, max(STEP_ROWS, math.ceil(n / (2 * cores))))  # few rows make small blocks, so that all cores have some
    kind = "<f4" if single else "<f8"

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def block(ids: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({names[0]: [number], names[1]: [ids], names[2]: [vectors.tobytes()]})

        for frame in frames:
            if not len(frame):
                continue
            held.append((frame[key].to_numpy(), matrix(frame["v"]).astype(kind)))
            n += len(frame)
            if n < size:
                continue
            ids, vectors = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
            for at in range(0, n - size + 1, size):
                yield block(ids[at : at + size], vectors[at : at + size])
                number += 1
            at = n - n % size
            held, n = [(ids[at:], vectors[at:])], n - at
        if n:
            yield block(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))

    files = min(math.ceil(n / size), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select(key, "v").repartition(max(1, files), key)
    return materialise(dealt.mapInPandas(pack, f"{names[0]} long, {names[1]} array<{dict(rows.dtypes)[key]}>, {names[2]} binary"), "vector-blocks")


def _block_comparer(keep: int, floor: float | None, metric: str, exclude_self: bool, single: bool):
    """The best rows of each block of queries (a, q, x) among the blocks of the corpus (b, id, y) that it is paired with."""

    def opened(ids: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        vectors = np.frombuffer(raw, "<f4" if single else "<f8").astype(np.float64)
        return ids, vectors.reshape(len(ids), len(vectors) // len(ids))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[int, Best] = {}
        last, ids, vectors = None, None, None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.a not in groups:
                    groups[row.a] = Best(*opened(row.q, row.x), keep, floor, metric, exclude_self)
                if row.b != last:
                    last, (ids, vectors) = row.b, opened(row.id, row.y)
                for at in range(0, len(ids), STEP_ROWS):
                    groups[row.a].add(ids[at : at + STEP_ROWS], vectors[at : at + STEP_ROWS])
        for best in groups.values():
            yield from best.result()

    return compare


def search(corpus: DataFrame, queries: DataFrame, keep: int, floor: float | None = None, metric: str = "cosine",
           exclude_self: bool = False, tasks: int | None = None) -> DataFrame:
    """The best ``keep`` rows of ``corpus`` (id, v) for each of ``queries`` (q, v), as (q, id, score, rank).

    Scores are cosine similarity or, with another ``metric``, minus the Euclidean distance; both are rounded to nine places,
    and the smaller id comes first on equal scores. Rows without a vector, and for the cosine vectors of length 0, match
    nothing. Ids of queries are unique.

    Queries are dealt to groups of about ``GROUP_ROWS`` (fewer if their vectors are wide). One group of at most ``STORED_BYTES``
    meets the corpus as rows of one shuffle: every slice of the corpus in one task, which holds the group and streams the slice.
    With more both sides are written once as blocks, and a task reads some blocks of queries and streams the blocks of a slice past them: no copy of
    a vector is shuffled, so the disk follows the rows, though the work is still queries times corpus. Nothing passes through
    the driver but counts and a width.
    """
    asked = queries.filter(F.col("v").isNotNull() & F.col("q").isNotNull())
    known = corpus.filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    q_type, id_type = dict(queries.dtypes)["q"], dict(corpus.dtypes)["id"]
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    groups = max(1, math.ceil(n / max(1, min(GROUP_ROWS, GROUP_BYTES // (8 * max(width or 1, 1))))))
    # Single precision stays so until a task compares: half the bytes to move.
    single = all(dict(df.dtypes)["v"] == "array<float>" for df in (corpus, queries))
    vector = F.col("v") if single else F.transform("v", lambda c: c.cast("double"))
    order = W.partitionBy("q").orderBy(F.desc("score"), "id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    if groups > 1 or 8 * n * width > STORED_BYTES:
        left = stored_blocks(asked.select("q", vector.alias("v")), "q", width, single, ("a", "q", "x"))
        right = stored_blocks(known.select("id", vector.alias("v")), "id", width, single, ("b", "id", "y"))
        wanted = tasks or 4 * corpus.sparkSession.sparkContext.defaultParallelism
        right = right.coalesce(max(1, math.ceil(wanted / max(1, left.rdd.getNumPartitions()))))
        pairs = right.crossJoin(left.hint("shuffle_replicate_nl")).select("a", "q", "x", "b", "id", "y")
        return ranked(pairs.mapInPandas(_block_comparer(keep, floor, metric, exclude_self, single), f"q {q_type}, id {id_type}, score double"))
    tasks = tasks or int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, math.ceil(tasks / groups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    nothing = lambda kind: F.lit(None).cast(kind)
    left = asked.select(F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("g"), every(slices).alias("s"),
                        F.lit(0).alias("side"), "q", nothing(id_type).alias("id"), vector.alias("v"))
    right = known.select(every(groups).alias("g"), F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("s"),
                         F.lit(1).alias("side"), nothing(q_type).alias("q"), "id", vector.alias("v"))
    dealt = left.unionByName(right).repartition(groups * slices, "g", "s").sortWithinPartitions("g", "s", "side")

    return ranked(dealt.mapInPandas(_comparer(keep, floor, metric, exclude_self), f"q {q_type}, id {id_type}, score double"))


def near_in_strips(rows: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nearest other rows of each of ``rows`` (id, v), as ``search`` by Euclidean distance gives them, for vectors of
    few numbers.

    The rows are ordered by the number with most values and cut into strips of ``STRIP_ROWS``. A row meets its own strip first;
    the distance of its last neighbour there bounds what it can still find, and it goes on only to the strips within that
    distance. The work follows the rows times the strips that a bound reaches: few for spread values, all of them, as in
    ``search``, where most rows share one value.
    """
    known = rows.filter(F.col("v").isNotNull() & F.col("id").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c.cast("double"))))
    known = known.select("id", F.transform("v", lambda c: c.cast("double")).alias("v"))
    kind, width = dict(rows.dtypes)["id"], known.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return search(rows, rows.withColumnRenamed("id", "q"), keep, metric="euclid", exclude_self=True)
    values = known.agg(*[F.approx_count_distinct(F.get("v", F.lit(i))) for i in range(width)]).first()
    ordered = known.withColumn("_x", F.get("v", F.lit(values.index(max(values)))))
    strip = F.floor((F.col("_at") - 1) / STRIP_ROWS).cast("int")
    placed = materialise(numbered(ordered, ["_x", "id", "v"], "_at").select("id", "v", "_x", strip.alias("g")), "strips")

    def met(asked: DataFrame) -> DataFrame:
        nothing = F.lit(None).cast(kind)
        left = asked.select("g", F.lit(0).alias("s"), F.lit(0).alias("side"), "q", nothing.alias("id"), "v")
        right = placed.select("g", F.lit(0).alias("s"), F.lit(1).alias("side"), nothing.alias("q"), "id", "v")
        dealt = left.unionByName(right).repartition("g").sortWithinPartitions("g", "s", "side")
        return dealt.mapInPandas(_comparer(keep, None, "euclid", True), f"q {kind}, id {kind}, score double")

    own = materialise(met(placed.withColumnRenamed("id", "q")), "strip-own")
    bound = own.groupBy("q").agg(F.when(F.count("*") >= keep, -F.min("score")).alias("_r"))
    ends = placed.groupBy("g").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    # Distances are rounded, so a strip is reached a little earlier than they say.
    reach = F.coalesce(F.col("_r"), F.lit(math.inf)) * (1 + 1e-9) + 1e-8
    bounded = placed.withColumnRenamed("id", "q").join(bound, "q", "left").join(F.broadcast(ends), "g")  # one row for each strip
    # The rows next to a strip share its end value when that is frequent, so an end itself counts as reached.
    leaving = bounded.filter((F.col("_x") - reach <= F.col("_low")) | (F.col("_x") + reach >= F.col("_high")))
    other = ends.select(F.col("g").alias("_g"), F.col("_low").alias("_l"), F.col("_high").alias("_h"))
    onward = leaving.join(F.broadcast(other), (F.col("_g") != F.col("g")) & (F.col("_l") <= F.col("_x") + reach) & (F.col("_h") >= F.col("_x") - reach))
    found = own.unionByName(met(onward.select(F.col("_g").alias("g"), "q", "v")))
    order = W.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


class ProjectionIndex:
    """Random hyperplanes in ``tables`` tables: the signs of ``bits`` projections name the bucket of a vector.

    A query looks at ``probes`` buckets of each table, those whose signs it would have if its least certain projections
    were on the other side. ``fit`` finds the number of probes; every corpus row stands in one bucket of each table, and
    rows that share a bucket are compared exactly, so scores are true and only neighbours in other buckets are missed.
    """

    def __init__(self, dim: int, bits: int, tables: int, probes: int = 1, seed: int = 7):
        self.dim, self.bits, self.tables, self.probes = dim, bits, tables, probes
        self.planes = np.random.default_rng(seed).standard_normal((tables, dim, bits))

    def _projected(self, vectors: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tdb->ntb", vectors, self.planes)

    def _number(self, signs: np.ndarray) -> np.ndarray:
        """Bucket of each table, numbered over all tables."""
        return signs @ (1 << np.arange(self.bits)) + (np.arange(self.tables) << self.bits)

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket that each vector stands in."""
        return self._number(self._projected(vectors) > 0)

    def probed(self, vectors: np.ndarray, probes: int | None = None) -> np.ndarray:
        """(rows, tables, probes): the buckets that a query looks at, the likeliest first.

        The cost of a bucket is the sum of squared distances to the planes that lie between it and the query.
        """
        crossed = (np.arange(1 << self.bits)[:, None] >> np.arange(self.bits)) & 1
        out = np.empty((len(vectors), self.tables, probes or self.probes), np.int64)
        for at in range(0, len(vectors), PROBE_ROWS):
            projected = self._projected(vectors[at : at + PROBE_ROWS])
            for t in range(self.tables):
                cost = projected[:, t] ** 2 @ crossed.T
                order = np.argsort(cost, axis=1, kind="stable")[:, : out.shape[2]]
                own = (projected[:, t] > 0) @ (1 << np.arange(self.bits))
                out[at : at + PROBE_ROWS, t] = (own[:, None] ^ order) + (t << self.bits)
        return out

    @classmethod
    def fit(cls, sample: np.ndarray, bits: int, tables: int = 4, keep: int = 10, recall: float = 0.95, seed: int = 7) -> ProjectionIndex:
        """The index whose probes find ``recall`` of the ``keep`` nearest of ``sample`` for a tenth of its rows.

        All buckets of a table are the whole corpus, so some number of probes always reaches it. Where neighbours are
        hardly nearer than other rows, as in random vectors, that is a large share of all buckets.
        """
        index = cls(sample.shape[1], bits, tables, seed=seed)
        unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
        asked = unit[:: max(1, min(10, len(unit)))]
        near = np.argsort(-(asked @ unit.T), axis=1, kind="stable")[:, :keep]
        order, home = index.probed(asked, 1 << bits), index.buckets(unit)
        # Place, in the order of each query, of the bucket that a neighbour stands in; the best table counts.
        place = (order[:, None, :, :] == home[near][:, :, :, None]).argmax(3).min(2)
        index.probes = int(np.sort(place, axis=None)[min(place.size - 1, int(np.ceil(recall * place.size)) - 1)]) + 1
        return index


def fit_index(corpus: DataFrame, keep: int = 10, recall: float = 0.95, tables: int = 4, bits: int | None = None,
              fit_rows: int = FIT_ROWS, seed: int = 7) -> ProjectionIndex:
    """An index for ``corpus`` (id, v), fitted on the ``fit_rows`` rows (the documented bound) with the smallest hash of their id.

    ``bits`` grows with the rows of the corpus, between 4 and 12, so that a bucket keeps about the same number of them.
    The true neighbours of a query are nearer than those inside the sample, so the fitted probes find more of them.
    """
    known = corpus.filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    rows = known.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(fit_rows).select("v").collect()
    if not rows:
        return ProjectionIndex(1, 4, tables, seed=seed)  # there is nothing to find
    bits = bits or int(np.clip(np.log2(max(known.count() / 200, 1)), 4, 12))
    return ProjectionIndex.fit(matrix([r["v"] for r in rows]), bits, tables, keep, recall, seed)


def index_search(index: ProjectionIndex, corpus: DataFrame, queries: DataFrame, keep: int, floor: float | None = None,
                 exclude_self: bool = False) -> DataFrame:
    """The best ``keep`` rows by cosine among those that share a probed bucket, as (q, id, score, rank) like ``search``.

    Every row of the corpus is indexed. Rows without a vector match nothing. The corpus is copied once per table, a query
    once per probed bucket. A bucket with more than ``BUCKET_ROWS`` rows is cut into slices and one with more than
    ``GROUP_ROWS`` queries into groups, each pair of them a task's work, so no bucket is too large and none is capped;
    sizes of buckets are at most tables * 2 ** bits rows.
    """
    q_type, id_type = dict(queries.dtypes)["q"], dict(corpus.dtypes)["id"]
    vector = F.transform("v", lambda c: c.cast("double"))
    rows = corpus.filter(F.col("v").isNotNull() & F.col("id").isNotNull()).select("id", vector.alias("v"))
    asked = queries.filter(F.col("v").isNotNull() & F.col("q").isNotNull()).select("q", vector.alias("v"))

    @F.pandas_udf("array<long>")
    def home(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(index.buckets(matrix(vectors))) if len(vectors) else [], index=vectors.index, dtype=object)

    @F.pandas_udf("array<long>")
    def looked_at(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], index=vectors.index, dtype=object)
        return pd.Series(list(index.probed(matrix(vectors)).reshape(len(vectors), -1)), index=vectors.index, dtype=object)

    spread = rows.withColumn("g", F.explode(home("v")))
    probes = asked.withColumn("g", F.explode(looked_at("v")))
    slices = spread.groupBy("g").agg(F.ceil(F.count("*") / F.lit(BUCKET_ROWS)).cast("int").alias("slices"))
    groups = probes.groupBy("g").agg(F.ceil(F.count("*") / F.lit(GROUP_ROWS)).cast("int").alias("groups"))
    sizes = F.broadcast(slices.join(groups, "g"))  # at most tables * 2 ** bits rows
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    nothing = lambda kind: F.lit(None).cast(kind)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = probes.join(sizes, "g").select("g", every("slices").alias("a"), own("q", "groups").alias("b"), "groups",
                                          F.lit(0).alias("side"), "q", nothing(id_type).alias("id"), "v")
    right = spread.join(sizes, "g").select("g", own("id", "slices").alias("a"), every("groups").alias("b"), "groups",
                                           F.lit(1).alias("side"), nothing(q_type).alias("q"), "id", "v")
    cells = left.unionByName(right).select("g", (F.col("a") * F.col("groups") + F.col("b")).alias("s"), "side", "q", "id", "v")
    dealt = cells.repartition("g", "s").sortWithinPartitions("g", "s", "side")
    found = dealt.mapInPandas(_comparer(keep, floor, "cosine", exclude_self), f"q {q_type}, id {id_type}, score double")
    order = W.partitionBy("q").orderBy(F.desc("score"), "id")
    once = found.groupBy("q", "id").agg(F.max("score").alias("score"))  # a pair may meet in several tables
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (queries, neighbours, found, recall): which of the ``exact`` neighbours (q, id) an index has found."""
    hits = exact.select("q", "id").join(found.select("q", "id", F.lit(1).alias("hit")), ["q", "id"], "left")
    return hits.agg(F.count_distinct("q").alias("queries"), F.count("*").alias("neighbours"), F.count("hit").alias("found"),
                    F.try_divide(F.count("hit"), F.count("*")).alias("recall"))
