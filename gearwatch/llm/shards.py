"""Shards of nearly equal bytes: a minimax contiguous partition of groups that must stay together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gearwatch.llm.common import SALTS, free_names, running_totals, salted_totals, without_clashes
from gearwatch.session import materialise

OUTPUTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Cells that one look at the group ends returns to the driver, at every input size.
CELLS = 65_536


class Ends:
    """What the driver knows about the sorted group ends: some of them, and which gaps may hide more."""

    def __init__(self, total: int):
        self.known = np.array([0, total], np.int64)
        self.open = np.array([True])

    def split(self, gap: int, found: pd.DataFrame) -> tuple[list[int], list[bool]]:
        """Ends inside one gap, and for each the openness of the gap before it; then that of the last gap."""
        ends, opens = [], [False]
        for low, high, n in zip(found["low"], found["high"], found["n"], strict=True):
            ends.append(int(low))
            if high > low:
                opens.append(bool(n > 2))
                ends.append(int(high))
            opens.append(False)
        return ends, opens

    def refine(self, gaps: np.ndarray, found: pd.DataFrame) -> None:
        known, opened, by_gap = [int(self.known[0])], [], dict(list(found.groupby("gap")))
        chosen = set(gaps.tolist())
        for i in range(len(self.open)):
            if i in chosen and i in by_gap:
                ends, opens = self.split(i, by_gap[i].sort_values("low"))
                for end, o in zip(ends, opens, strict=False):
                    if end != known[-1] and end != self.known[i + 1]:
                        known.append(end)
                        opened.append(o)
                opened.append(opens[-1] if len(opens) > len(ends) else False)
            else:
                opened.append(bool(self.open[i]) and i not in chosen)
            known.append(int(self.known[i + 1]))
        self.known, self.open = np.array(known, np.int64), np.array(opened, bool)

    def walk(self, segments: list[tuple[int, int]], shards: int, capacity: int, hopeful: bool) -> tuple[bool, list[int]]:
        """Fill shards greedily up to ``capacity``; a hidden end counts as present when ``hopeful``."""
        cuts = []
        for begin, stop in segments:
            at = begin
            while at < stop:
                target = min(at + capacity, stop)
                i = int(np.searchsorted(self.known, target, "right")) - 1
                cut = int(self.known[i])
                if hopeful and cut < target and i < len(self.open) and self.open[i]:
                    cut = target
                if cut <= at or len(cuts) == shards:
                    return False, cuts
                cuts.append(cut)
                at = cut
        return True, cuts

    def smallest(self, segments: list[tuple[int, int]], shards: int, hopeful: bool) -> int:
        low, high = 1, max(b - a for a, b in segments)
        while low < high:
            middle = (low + high) // 2
            if self.walk(segments, shards, middle, hopeful)[0]:
                high = middle
            else:
                low = middle + 1
        return low


def look(ends: DataFrame, bounds: np.ndarray, gaps: np.ndarray) -> pd.DataFrame:
    """Least and largest group end and their number in equal cells of the given gaps: at most ``CELLS`` rows or so."""
    low, high = bounds[gaps], bounds[gaps + 1]
    width = -(-(high - low) // max(16, CELLS // len(gaps)))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            end = frame["end"].to_numpy(np.int64)
            i = np.searchsorted(low, end, "left") - 1
            inside = (i >= 0) & (end < high[np.maximum(i, 0)])
            end, i = end[inside], i[inside]
            part = pd.DataFrame({"gap": gaps[i], "cell": (end - low[i]) // width[i], "end": end})
            yield part.groupby(["gap", "cell"])["end"].agg(low="min", high="max", n="count").reset_index()

    parts = ends.select("end").mapInPandas(count, "gap long, cell long, low long, high long, n long")
    return parts.groupBy("gap", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toPandas()


def stretches(giants: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
    """What lies between groups that have a shard of their own."""
    at, out = 0, []
    for begin, end in [*sorted(giants), (total, total)]:
        if begin > at:
            out.append((at, begin))
        at = end
    return out


def narrow(known: Ends, ends: DataFrame, low: list[int], high: list[int]) -> None:
    """Look into the open gaps between two lists of cuts, or into any open ones if there are none."""
    low = low + [low[-1] if low else 0] * (len(high) - len(low))
    chosen = np.zeros(len(known.open), bool)
    for a, b in zip(low, high, strict=False):
        i, j = np.searchsorted(known.known, [min(a, b), max(a, b)], "right") - 1
        chosen[max(0, i) : min(j, len(chosen) - 1) + 1] = True
    gaps = np.flatnonzero(chosen & known.open)[:CELLS // 16]
    if not len(gaps):
        gaps = np.flatnonzero(known.open)[:CELLS // 16]
    known.refine(gaps, look(ends, known.known, gaps))


def best_cuts(known: Ends, ends: DataFrame, segments: list[tuple[int, int]], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity for ``segments`` and its cuts."""
    while True:
        best, sure = known.smallest(segments, shards, True), known.smallest(segments, shards, False)
        if best == sure or not known.open.any():
            return sure, known.walk(segments, shards, sure, False)[1]
        narrow(known, ends, known.walk(segments, shards, best, False)[1], known.walk(segments, shards, sure, True)[1])


def fits(known: Ends, ends: DataFrame, segments: list[tuple[int, int]], shards: int, capacity: int) -> bool:
    """Whether ``shards`` shards of at most ``capacity`` hold ``segments``, none of them parts of two."""
    while True:
        (sure, low), (hopeful, high) = [known.walk(segments, shards, capacity, h) for h in (False, True)]
        if sure or not hopeful:
            return sure
        narrow(known, ends, low, high)


def minimax_cuts(ends: DataFrame, shards: int) -> list[int]:
    """Ascending shard ends over groups (``end``, ``size``) that lie one after the other.

    The smallest capacity over the whole sequence is found by binary search, each try filling shards greedily. A group
    larger than an even share of what is left then takes a shard of its own if what lies between such groups still fits
    that capacity; the stretches are filled up to the smallest capacity that holds them, so the largest shard does not
    grow. The driver holds least and largest ends of at most ``CELLS`` cells at a time; only gaps that a cut may fall
    into are looked at again.
    """
    facts = ends.agg(F.max("end").alias("total")).first()
    if not facts or not facts["total"]:
        return []
    total = facts["total"]
    large = [(r["end"] - r["size"], r["end"]) for r in ends.orderBy(F.desc("size"), "end").limit(shards).collect()]  # at most one for each shard
    known = Ends(total)
    known.known = np.unique(np.array([0, total, *[x for g in large for x in g]], np.int64))
    known.open = ~np.isin(known.known[:-1], [begin for begin, _ in large])
    segments, giants, left, rest = [(0, total)], [], shards, total
    capacity, cuts = best_cuts(known, ends, segments, shards)
    for begin, end in large:
        between = stretches([*giants, (begin, end)], total)
        if (end - begin) * left > rest and len(between) < left and fits(known, ends, between, left - 1, capacity):
            giants, segments, left, rest = [*giants, (begin, end)], between, left - 1, rest - (end - begin)
    if giants:
        cuts = best_cuts(known, ends, segments, left)[1] if segments else []
    return sorted({*cuts, *[e for _, e in giants]})


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    Rows with equal texts form a group that stays together; groups are ordered by their smallest id and cut into at
    most ``shards`` contiguous shards whose largest size is as small as possible. ``slot`` counts the rows of a shard
    from 0. ``grown_shard`` is null, as the law is ``bytes``.

    A null text has size ``ROW_BYTES`` and crc 0; null texts form a group of their own. Null ids come first. Repeated
    rows are rows of one group. An empty table gives an empty result. Columns named like a result are replaced.
    """
    docs = without_clashes(docs, OUTPUTS, (id_column, text_column))
    digest, salt, leader, last, one, first = free_names(docs, "_digest", "_salt", "_leader", "_last", "_one", "_first")
    text = F.coalesce(F.col(text_column), F.lit(""))
    keep = [c for c in docs.columns if c != text_column]
    rows = docs.select(
        *keep,
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(1).cast("long").alias(one),
        F.coalesce(F.sha2(F.col(text_column), 256), F.lit("null")).alias(digest),
        F.pmod(F.xxhash64(F.col(id_column)), F.lit(SALTS)).cast("int").alias(salt),
    )
    rows = materialise(rows, "shard-rows")
    groups = salted_totals(rows, [digest], salt, {leader: F.min(id_column), last: F.max(id_column)},
                           {leader: F.min, last: F.max})
    placed = running_totals(rows.join(groups, [digest, salt]), [leader, digest, id_column], ["size", one], "shard-order")
    ends = materialise(
        placed.groupBy(digest).agg(F.max("end_size").alias("end"), F.sum("size").alias("size")).select("end", "size"),
        "shard-ends")
    cuts = minimax_cuts(ends, shards)
    shard = sum([(F.col("end_size") > c).cast("int") for c in cuts[:-1]], F.lit(0))
    numbered = placed.withColumn("shard", shard)
    starts = numbered.groupBy("shard").agg(F.min(f"end_{one}").alias(first))
    return numbered.join(F.broadcast(starts), "shard").select(  # one row for each shard
        *keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col(f"end_{one}") - F.col(first)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
