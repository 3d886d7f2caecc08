"""Repeated passages: confirmed recurring word windows in sharded Aho-Corasick automata, located in all documents."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gearwatch.llm.common import bounded_batches
from gearwatch.llm.words import batches, grams, mix, words
from gearwatch.session import materialise

#: Consecutive words that make a passage, and words of the phrases that documents are first compared by.
WINDOW, PHRASE = 50, 12
#: Windows in one automaton (about 50 nodes each), and segments that one task streams through it.
PATTERNS, SEGMENTS = 16_000, 20_000
#: Code points of words in an automaton; the surrogates are left out, and 1 is a word that no pattern has.
FIRST_CODE, GAP, GAP_SIZE = 2, 0xD800, 0x800


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the least phrase of each window, the leftmost of equal ones.

    It depends on the words of the window alone, so one passage has one anchor wherever it stands.
    """
    phrase = min(PHRASE, window)
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(hashes, phrase)
    width = window - phrase + 1
    place = np.lib.stride_tricks.sliding_window_view(g, width).argmin(1) + np.arange(len(g) - width + 1)
    return place, g[place]


def documents_words(texts: list[str | None]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, bytes, word starts, word ends, word hashes) of each text; places count from the start of the bytes."""
    for first, last, buf, starts in batches(texts):
        begin, end, h = words(buf)
        bounds = np.searchsorted(begin, starts)
        raw = buf.tobytes()
        for i in range(last - first):
            a, b = bounds[i], bounds[i + 1]
            yield first + i, raw, begin[a:b], end[a:b], h[a:b]


def phrase_table(rows: DataFrame, window: int) -> DataFrame:
    """(id, anchor): the distinct anchors of each document."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512]
                ids, found = part["id"].to_numpy(), []
                for i, _, _, _, h in documents_words(part["text"].tolist()):
                    place, g = anchors(h, window)
                    own = np.unique(g[np.r_[True, place[1:] != place[:-1]]]) if len(place) else g
                    found.append((i, own))
                yield pd.DataFrame({"id": np.repeat(ids[[i for i, _ in found]], [len(g) for _, g in found]),
                                    "anchor": np.concatenate([g for _, g in found]).view(np.int64)})

    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(find, f"id {kind}, anchor long")


def segments(rows: DataFrame, window: int) -> DataFrame:
    """(id, parts): for each run of windows with one recurring anchor, that anchor, its first word and its words.

    ``rows`` holds (id, text, anchors): documents with the recurring anchors among theirs.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 128):
                part, out = frame.iloc[at : at + 128], []
                ids, wanted = part["id"].tolist(), part["anchors"].tolist()
                for i, raw, begin, end, h in documents_words(part["text"].tolist()):
                    place, g = anchors(h, window)
                    if not len(place):
                        continue
                    heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                    stops = np.r_[heads[1:], len(place)]
                    own, own_parts = g[heads].view(np.int64), []
                    for k in np.flatnonzero(np.isin(own, np.asarray(wanted[i], np.int64))):
                        a, b = heads[k], stops[k] + window - 1
                        own_parts.append({"anchor": int(own[k]), "start": int(a), "text": b" ".join(raw[begin[a] : end[b - 1]].split())})
                    out.append((ids[i], own_parts))
                yield pd.DataFrame(out, columns=["id", "parts"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(cut, f"id {kind}, parts array<struct<anchor: long, start: long, text: binary>>")


def window_hashes(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place in it of every window of the texts, all texts at once."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    begin, _, h = words(buf)
    owner = np.searchsorted(starts, begin, "right") - 1
    first = np.searchsorted(owner, np.arange(len(texts)))
    g = grams(h, window).view(np.int64)
    inside = np.flatnonzero(owner[: len(g)] == owner[window - 1 :]) if len(g) else np.zeros(0, np.int64)
    return g[inside], owner[inside], inside - first[owner[inside]]


def documents_of(frame: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    for at in range(0, len(frame), size):
        yield frame.iloc[at : at + size]


def recurring_windows(found: DataFrame, window: int) -> DataFrame:
    """(hash, first): windows of the segments that stand in two documents or more, and the least id of these."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in documents_of(frame, 256):
                texts = [(i, p["text"]) for i, parts in zip(part["id"], part["parts"], strict=True) for p in parts]
                h, owner, _ = window_hashes([t for _, t in texts], window)
                yield pd.DataFrame({"id": np.array([i for i, _ in texts], part["id"].dtype)[owner], "hash": h})

    kind = dict(found.dtypes)["id"]
    rows = found.mapInPandas(each, f"id {kind}, hash long")
    ends = rows.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return ends.filter("first < last").select("hash", "first")


def patterns(found: DataFrame, recurring: DataFrame, window: int) -> DataFrame:
    """(anchor, first, text, n): stretches of a document whose ``n`` windows all recur and have it as their first."""
    owned = recurring.groupBy(F.col("first").alias("id")).agg(F.collect_list("hash").alias("hashes"))  # windows of one document

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in documents_of(frame, 256):
                flat = [(row, i, p) for row, (i, parts) in enumerate(zip(part["id"], part["parts"], strict=True)) for p in parts]
                h, owner, place = window_hashes([p["text"] for _, _, p in flat], window)
                # A window is known by its document's row in this batch and its hash.
                row = np.array([r for r, _, _ in flat], np.uint64)[owner]
                known = [np.asarray(x, np.int64).view(np.uint64) for x in part["hashes"]]
                wanted = np.concatenate([mix(x + mix(np.full(len(x), r, np.uint64))) for r, x in enumerate(known)])
                good = np.isin(mix(h.view(np.uint64) + mix(row)), wanted)
                own, at = owner[good], place[good]
                heads = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]) if len(own) else np.zeros(0, np.int64)
                out = []
                for a, b in zip(heads, np.r_[heads[1:], len(own)], strict=True):
                    _, first, p = flat[own[a]]
                    out.append((p["anchor"], first, b" ".join(p["text"].split()[at[a] : at[b - 1] + window]), int(b - a)))
                yield pd.DataFrame(out, columns=["anchor", "first", "text", "n"])

    kind = dict(found.dtypes)["id"]
    return found.join(owned, "id").select("id", "parts", "hashes").mapInPandas(cut, f"anchor long, first {kind}, text binary, n long")


class Automaton:
    """Windows as strings of one character per word, each with the id of the first document that has it."""

    def __init__(self, window: int):
        self.window, self.codes, self.machine = window, {}, ahocorasick.Automaton()

    def text(self, own: list[bytes], new: bool = False) -> str:
        codes = self.codes
        if new:
            for w in own:
                if w not in codes:
                    n = len(codes) + FIRST_CODE
                    codes[w] = chr(n if n < GAP else n + GAP_SIZE)
        return "".join([codes.get(w, "\x01") for w in own])

    def add(self, text: bytes, first: int) -> None:
        own = self.text(text.split(), True)
        for i in range(len(own) - self.window + 1):
            self.machine.add_word(own[i : i + self.window], first)  # a window has one first document

    def finish(self) -> None:
        self.machine.make_automaton()

    def repeats(self, text: bytes, own_id: int) -> list[tuple[int, int]]:
        """Word ranges covered by windows that a document with a smaller id has too."""
        out: list[list[int]] = []
        if not len(self.machine):
            return []
        for end, first in self.machine.iter(self.text(text.split())):
            if first < own_id:
                begin = end - self.window + 1
                if out and begin <= out[-1][1]:
                    out[-1][1] = end + 1
                else:
                    out.append([begin, end + 1])
        return [(a, b) for a, b in out]


def locate(found: DataFrame, recurring: DataFrame, window: int) -> DataFrame:
    """(id, begin, end): ranges of words of each document that an earlier document has too.

    Patterns and segments with the same anchor meet in a shard. A shard with many patterns has several automata, and
    its segments visit each; one with many segments is streamed by several tasks with a copy of the automaton each.
    """
    known = materialise(patterns(found, recurring, window), "repeat-patterns")
    total = known.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = int(2 * total // PATTERNS) + 1  # about half full, so few need a second automaton
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard")
    # A segment may as well stand for its copies: only anchors that have a pattern matter.
    wanted = materialise(known.select("anchor").distinct(), "repeat-wanted")
    texts = found.select("id", F.inline("parts")).join(wanted, "anchor").select(shard, "id", "start", "text")
    load = known.select(shard, "n", F.lit(0).alias("m")).union(texts.select("shard", F.lit(0), F.lit(1)))
    plan = load.groupBy("shard").agg((F.floor(F.sum("n") / PATTERNS) + 1).cast("int").alias("parts"),
                                     (F.floor(F.sum("m") / SEGMENTS) + 1).cast("int").alias("copies"))
    plan = materialise(plan, "repeat-plan")
    number = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    machines = (known.select(shard, "first", "text").join(plan, "shard")
                .withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int")).withColumn("copy", number("copies"))
                .select("shard", "part", "copy", F.lit(0).alias("kind"), F.col("first").alias("id"), F.lit(0).cast("long").alias("start"), "text"))
    streams = (texts.join(plan, "shard").withColumn("copy", F.pmod(F.xxhash64("id", "start"), F.col("copies")).cast("int"))
               .withColumn("part", number("parts"))
               .select("shard", "part", "copy", F.lit(1).alias("kind"), "id", "start", "text"))
    dealt = machines.union(streams).repartition("shard", "part", "copy").sortWithinPartitions("shard", "part", "copy", "kind")

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark, machine, ready = None, Automaton(window), False
        for frame in frames:
            out = []
            for s, p, c, kind, own, start, text in frame.itertuples(index=False):
                if (s, p, c) != mark:
                    mark, machine, ready = (s, p, c), Automaton(window), False
                if kind == 0:
                    machine.add(text, own)
                    continue
                if not ready:
                    machine.finish()
                    ready = True
                out += [(own, start + a, start + b) for a, b in machine.repeats(text, own)]
            yield pd.DataFrame(out, columns=["id", "begin", "end"])

    kind = dict(found.dtypes)["id"]
    return dealt.mapInPandas(stream, f"id {kind}, begin long, end long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept_text) for every row of ``docs``; ``spans`` are the removed ranges of words.

    Words are runs without white space, unchanged. A word goes when a window of ``window`` consecutive words covers it
    whose word sequence also starts in a row with a smaller id; the input decides, not what is left of it. Kept words
    are joined by one space.

    Anchors (a phrase picked by hash from each window) find documents that may share a window; their windows are
    counted by hash, and those of two documents or more become patterns of the automata that locate every occurrence.

    A null text has no words. A row with a null id repeats nothing and is repeated by nothing. Rows with one id do not
    repeat each other, and share the spans found for the id where these fit. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    real = bounded_batches(rows).filter("id IS NOT NULL")
    table = materialise(phrase_table(real, window), "repeat-phrases")
    ends = table.groupBy("anchor").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x < y").select("anchor")
    shared = materialise(ends, "repeat-anchors")
    own = table.join(shared, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors"))  # anchors of one document
    found = materialise(segments(real.join(materialise(own, "repeat-hits"), "id"), window), "repeat-segments")
    recurring = materialise(recurring_windows(found, window), "repeat-windows")
    gone = locate(found, recurring, window)
    spans = gone.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # ranges of one document
    joined = rows.join(materialise(spans, "repeat-spans"), "id", "left")
    kind = dict(rows.dtypes)["id"]

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text, ranges in frame[["id", "text", "spans"]].itertuples(index=False):
                own = text.encode("utf-8", "surrogatepass").split()
                covered = np.zeros(len(own) + 1, np.int64)
                for r in ranges if ranges is not None else ():
                    if r["end"] <= len(own):
                        covered[r["begin"]] += 1
                        covered[r["end"]] -= 1
                covered = np.cumsum(covered[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
                kept = own if not len(edges) else [w for w, c in zip(own, covered, strict=True) if not c]
                out.append((doc, len(own), len(own) - len(kept), [{"begin": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)],
                            b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "spans", "kept_text"])

    texts = joined.withColumn("id", F.col("id").cast("string"))  # null ids stay null
    schema = "id string, n_words long, n_removed long, spans array<struct<begin: long, end: long>>, kept_text string"
    return texts.mapInPandas(keep, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_column)
