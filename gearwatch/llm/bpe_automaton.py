"""Byte-pair encoding as a deterministic automaton: merges compiled one by one, words read by table-driven transitions.

The automaton reads tokens. It begins with one state, in which every single symbol may follow and leads back. Each merge
(u, v), in order, is a gadget: the state behind u gets a copy without the arc v, to which all arcs u now lead, and wherever
u may follow, the merged token uv may follow as well, leading where v led. So a sequence of tokens has a path exactly if no
merge was left undone, and every word has exactly one path. Where an arc leads depends on its label alone; a copied state
is stored as what it was copied from and the arc it lost, so the automaton is as large as the list of merges.

To read words symbol by symbol, the pending beginnings of arcs are followed side by side (``Reader``); such sets of places
are the rows of a transition table that fills as words need them.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gearwatch.llm.common import BATCH_BYTES, bounded_batches, free_names, without_clashes
from gearwatch.llm.tokens import byte_letters

OUTPUTS = ("ids", "n_tokens", "decoded", "numbers")
#: Rows of the transition table, and pieces, that a Python worker remembers before it starts anew.
PLACES, MEMORY = 100_000, 300_000
NEVER = 1 << 60
# The normaliser and the splitter that a vocabulary file must have.
RULES = [
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
]
#: Text of printable ASCII, Latin letters, spaces and line feeds splits in Python as it does in the library.
PLAIN = re.compile(r"[ -~\nÀ-ÖØ-öø-ÿ]*")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \na-z0-9ß-öø-ÿ]+")
LETTERS = byte_letters()
BYTES = {ord(letter): byte for byte, letter in LETTERS.items()}


class Automaton:
    """States and arcs of a list of merges; tokens are numbers, ``labels`` their texts."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocabulary.values(), default=-1) + 1
        self.labels = [""] * size
        for text, number in vocabulary.items():
            self.labels[number] = text
        #: Merge that made a token (-1: a symbol), and its left part.
        self.rank, self.left = [-1] * size, [-1] * size
        #: State behind each arc, now and when the token was made.
        self.behind, self.entry = [0] * size, [0] * size
        #: Copied states: the token whose arcs lead there and the merge that made the copy. ``lost[u, v]``: when the state behind u lost v.
        self.owner, self.since, self.lost = [-1], [-1], {}
        #: Tokens that no sequence of merges gives.
        self.unmade: set[int] = set()
        made = {vocabulary[a + b] for a, b in merges}
        ready = set(vocabulary.values()) - made
        for turn, (a, b) in enumerate(merges):
            u, v, uv = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if u not in ready or v not in ready or uv in ready:
                raise ValueError(f"merge {turn} uses a token that is not made yet, or makes one again")
            ready.add(uv)
            self.gadget(turn, u, v, uv)

    def gadget(self, turn: int, u: int, v: int, uv: int) -> None:
        """One merge: uv leads where v leads, and the state behind u loses the arc v."""
        self.rank[uv], self.left[uv] = turn, u
        self.behind[uv] = self.entry[uv] = self.behind[v]
        if self.follows(self.behind[u], v):
            self.behind[u] = len(self.owner)
            self.owner.append(u)
            self.since.append(turn)
            self.lost[u, v] = turn
        else:  # v never stands behind u any more, so no arc of uv is made
            self.unmade.add(uv)

    def lost_at(self, state: int, token: int) -> float:
        """When a state, or one that it was copied from, lost the arc of a token; infinity if it never had to."""
        while state:
            u = self.owner[state]
            turn = self.lost.get((u, token), NEVER)
            if turn <= self.since[state]:
                return turn
            state = self.entry[u]
        return NEVER

    def follows(self, state: int, token: int) -> bool:
        """Whether a state has an arc for a token.

        It has unless it lost the token, or a left part of it before the merge that made the token from that part: the gadget of
        a merge gives the merged token only to states that have its left part.
        """
        limit = NEVER - 1
        while token >= 0:
            if token in self.unmade or self.lost_at(state, token) <= limit:
                return False
            limit, token = self.rank[token], self.left[token]
        return True


class Reader:
    """Tokens of words, symbol by symbol, through a table of transitions.

    A place is the set of all (node, state): the symbols since some end of a token, as a node of the tree of all labels, and
    the state there. Reading a symbol moves every node down; exactly one of them completes an arc that its state has, and this
    token is the last one of what was read so far. Equal sets are one row of the table.
    """

    def __init__(self, automaton: Automaton, suffix: str, places: int = PLACES):
        self.automaton, self.suffix, self.bound = automaton, suffix, places
        self.length = [0] * len(automaton.labels)
        self.symbol = {t: i for i, t in enumerate(automaton.labels) if automaton.rank[i] < 0 and len(t.removesuffix(suffix) or t) == 1}
        self.shift = max(1, len(automaton.labels)).bit_length()
        self.tree: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for number, label in enumerate(automaton.labels):
            at, symbols = 0, self.symbols(label.removesuffix(suffix) if suffix else label, bool(suffix) and label.endswith(suffix))
            if symbols is None:
                continue  # no word leads to it, as to the names of special tokens
            self.length[number] = len(symbols)
            for s in symbols:
                self.inner[at] = True
                key = at << self.shift | s
                if key not in self.tree:
                    self.tree[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                at = self.tree[key]
            self.token[at] = number
        self.forget()

    def forget(self) -> None:
        #: Each row holds node << 32 | state, the longest beginning first.
        self.rows: list[tuple[int, ...]] = [(0,)]
        self.number: dict[tuple[int, ...], int] = {(0,): 0}
        self.table: dict[int, int] = {}
        self.may: dict[int, bool] = {}

    def symbols(self, word: str, ends: bool = True) -> list[int] | None:
        """Symbols of a word; its last one carries the mark of the end."""
        try:
            out = [self.symbol[c] for c in word]
            if ends and self.suffix:
                out[-1] = self.symbol[word[-1] + self.suffix]
            return out
        except (KeyError, IndexError):
            return None

    def step(self, place: int, symbol: int) -> int:
        """A new entry of the table: the next place and the token that ends there."""
        ahead, last, tree, shift, may = [], -1, self.tree, self.shift, self.may
        for pending in self.rows[place]:
            child = tree.get(pending >> 32 << shift | symbol)
            if child is None:
                continue
            if last < 0:  # only one of them completes an arc
                token, state = self.token[child], pending & 0xFFFFFFFF
                if token >= 0:
                    key = state << shift | token
                    if key not in may:
                        may[key] = self.automaton.follows(state, token)
                    if may[key]:
                        last = token
            if self.inner[child]:
                ahead.append(child << 32 | pending & 0xFFFFFFFF)
        ahead.append(self.automaton.behind[last])
        row = tuple(ahead)
        number = self.number.setdefault(row, len(self.rows))
        if number == len(self.rows):
            self.rows.append(row)
        entry = self.table[place << shift | symbol] = number << shift | last
        return entry

    def read(self, word: str) -> list[int]:
        """Tokens of one word."""
        if len(self.rows) > self.bound:
            self.forget()
        place, ends, shift, table = 0, [], self.shift, self.table
        low = (1 << shift) - 1
        for s in self.symbols(word):
            entry = table.get(place << shift | s)
            if entry is None:
                entry = self.step(place, s)
            ends.append(entry & low)
            place = entry >> shift
        out, at = [], len(ends)
        while at:
            out.append(ends[at - 1])
            at -= self.length[ends[at - 1]]
        return out[::-1]


class Codec:
    """Ids of whole texts and back, for a vocabulary file of the tokenizers library with byte symbols and end-of-word marks.

    Special tokens are found in the text as it is; the rest is normalised and split as the file says, by the library unless it
    is printable ASCII. Texts are cut at spaces and line feeds, which no rule of the file reaches across, and what stands
    between is remembered.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        parts = json.loads(tokenizer.to_str())
        model, special = parts["model"], parts["added_tokens"]
        if model["type"] != "BPE" or model["dropout"] or model["ignore_merges"] or parts["decoder"] or [parts["normalizer"], parts["pre_tokenizer"]] != RULES:
            raise ValueError(f"{path} is no lower-case byte vocabulary with merges, as this operator reads it")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError(f"{path} has special tokens that take more than their own name")
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.suffix = model["end_of_word_suffix"] or ""
        self.reader = Reader(Automaton(model["vocab"], [tuple(m) for m in model["merges"]]), self.suffix)
        self.special = {t["content"]: t["id"] for t in special}
        self.names = re.compile("(" + ("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or "(?!)") + ")")
        self.labels = label_list(path)
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was remembered before the last new start

    @classmethod
    def shared(cls, path: str) -> Codec:
        """The codec of this process, which later tasks of the same worker find with what it remembers."""
        if path not in SHARED:
            SHARED[path] = cls(path)
        return SHARED[path]

    def split(self, text: str) -> list[str]:
        """Pieces of a text without special tokens."""
        if PLAIN.fullmatch(text):
            return PIECES.findall(text.lower())
        out = []
        for word in text.replace("\n", " ").split(" "):
            if PLAIN.fullmatch(word):
                out += PIECES.findall(word.lower())
            else:
                found = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(word))
                out += [p.translate(BYTES).encode("latin-1").decode() for p, _ in found]
        return out

    def learn(self, piece: str) -> None:
        """Make sure that the ids of a piece are known."""
        ids = self.older.get(piece)
        if ids is None:
            letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(LETTERS)
            ids = array("I", self.reader.read(letters)).tobytes()
        self.pieces[piece] = ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers; null counts as empty."""
        if len(self.pieces) > MEMORY:
            self.older, self.pieces = self.pieces, {}
        out, pieces = [], self.pieces
        for part in self.names.split(text) if text else ():
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
                continue
            run = self.split(part)
            for piece in run:
                if piece not in pieces:
                    self.learn(piece)
            out += map(pieces.__getitem__, run)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return decode_ids(ids, self.labels)


def decode_ids(ids: bytes, labels: list[str]) -> str:
    """The labels of the ids, one space between two."""
    return " ".join(map(labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def numbers_of(ids: bytes) -> str:
    return " ".join(map(str, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def label_list(path: str) -> list[str]:
    """The label of every id of a vocabulary file, special tokens included."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    known = {number: text for text, number in parts["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parts["added_tokens"]}
    return [known.get(i, "") for i in range(max(known, default=-1) + 1)]


SHARED: dict[str, Codec] = {}


def encode(docs: DataFrame, vocabulary: str, text_column: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``ids`` (little-endian 32-bit numbers of the whole text) and ``n_tokens``.

    A null or empty text has no ids. Names of special tokens in a text give their ids, as the library does by default. Repeated
    rows get the same ids; an empty table gives an empty result; columns named like a result are replaced.
    """
    docs = without_clashes(docs, OUTPUTS[:2], (text_column,))

    @F.pandas_udf("binary")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec.shared(vocabulary)
        for series in texts:
            yield pd.Series([codec.encode(t) for t in series], index=series.index, dtype=object)

    rows = bounded_batches(docs, BATCH_BYTES).withColumn("ids", ids(F.col(text_column)))
    return rows.withColumn("n_tokens", F.floor(F.octet_length("ids") / 4).cast("long"))


def decode(rows: DataFrame, vocabulary: str, ids_column: str = "ids") -> DataFrame:
    """Every row with ``decoded``: the labels of its ids, special tokens too, one space between two; null ids give null."""
    rows = without_clashes(rows, OUTPUTS[2:3], (ids_column,))

    @F.pandas_udf("string")
    def labels(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = label_list(vocabulary)
        for part in series:
            yield pd.Series([None if v is None else decode_ids(v, known) for v in part], index=part.index, dtype=object)

    return bounded_batches(rows, BATCH_BYTES).withColumn("decoded", labels(F.col(ids_column)))


def round_trip(docs: DataFrame, vocabulary: str, text_column: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with ``n_tokens``, ``numbers`` (the ids as decimal numbers, one space between two)
    and ``decoded``: ``encode`` and then ``decode``, without handing the ids back and forth between them."""
    docs = without_clashes(docs, OUTPUTS[1:], (text_column,))
    found = free_names(docs, "_found")[0]

    @F.pandas_udf("n_tokens long, numbers string, decoded string")
    def coded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec.shared(vocabulary)
        for series in texts:
            ids = [codec.encode(t) for t in series]
            yield pd.DataFrame({"n_tokens": [len(v) // 4 for v in ids], "numbers": [numbers_of(v) for v in ids],
                                "decoded": [codec.decode(v) for v in ids]})

    rows = bounded_batches(docs, BATCH_BYTES).withColumn(found, coded(F.col(text_column)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_column], f"{found}.*")
