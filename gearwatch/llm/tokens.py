"""Token ids of whole texts through the tokenizers library, word by word with a bounded cache."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    import numpy as np
    import pandas as pd
    import pyarrow as pa

#: Distinct pieces that a Python worker remembers one by one; pieces not used for that long are forgotten.
CACHE = 200_000
#: Distinct words that it remembers as columns, and how many ids one of them has; the half found least often and longer ones are forgotten.
WORDS, LONG = 600_000, 32

#: Characters of texts that are cut into words at once, and words whose ids are put together at once.
RUN, PUT = 1 << 23, 1 << 18
#: What Python's ``\s`` takes, for Arrow, and texts that begin or end with it, hold two of it side by side or are empty.
BLANK = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNEVEN = rf"\A{BLANK}|{BLANK}\z|{BLANK}{BLANK}|\A\z"
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Marks of ASCII, and the first character beyond the Latin letters whose class all versions of Unicode agree on.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BEYOND = "ɐ"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian bytes.

    A byte-level vocabulary splits a text into words, numbers, marks and spaces before it merges bytes, so the ids of
    a text are those of its pieces, one after the other; a text with the name of a special token goes through the tokenizer
    as a whole. Any other text is cut at single spaces and line feeds that stand
    between two other characters; a piece of letters, or of letters before marks, goes straight to the merges, any
    other piece through the whole tokenizer; pieces seen before are looked up, each distinct one once for a run of
    texts. Vocabularies of another kind, and ``exact``, encode whole texts.
    """

    def __init__(self, path: str, dtype: str = "<u4", exact: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from tokenizers import Tokenizer

        self.pa, self.pc, self.np, self.dtype = pa, pc, np, np.dtype(dtype)
        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        before = parts["pre_tokenizer"] or {}
        by_bytes = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.exact = exact or not by_bytes or parts["normalizer"] is not None or parts["model"]["type"] != "BPE"
        self.special = [t["content"] for t in parts["added_tokens"]]  # their names in a text are their ids
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.line = self.whole(["\n"])[0]
        self.known: dict[bool, dict[str, bytes]] = {False: {}, True: {}}  # without and with a space before the piece
        self.older: dict[bool, dict[str, bytes]] = {False: {}, True: {}}
        # columns of words with the white space before them: ids one after the other, where a word's begin, how many, how often found
        self.words, self.ids = pa.array([], pa.large_string()), np.zeros(0, self.dtype)
        self.place, self.size, self.found = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    @classmethod
    def shared(cls, path: str, dtype: str) -> Encoder:
        """The encoder of this process, which later tasks of the same worker find with what it remembers."""
        key = (path, dtype)
        if key not in SHARED:
            SHARED[key] = cls(path, dtype)
        return SHARED[key]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def merged(self, piece: str) -> bytes:
        """Ids of a piece that the vocabulary does not split."""
        if piece.isascii() and piece.isprintable():
            text = piece.replace(" ", self.letters[32])
        else:
            text = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.dtype.char, [t.id for t in self.model.tokenize(text)]).tobytes()

    def learn(self, words: Iterable[str], space: bool) -> None:
        """Make sure that the pieces are known."""
        known, older, plain, lead = self.known[space], self.older[space], self.known[False], " " if space else ""
        odd = []
        for w in words:
            if w in known:
                continue
            if w in older:
                known[w] = older[w]
                continue
            stem = w.rstrip(MARKS)
            if not w or stem and not (stem.isalpha() and (stem.isascii() or max(stem) < BEYOND)):
                odd.append(w)
            elif not stem:
                known[w] = self.merged(lead + w)
            else:
                if stem not in known:
                    known[stem] = self.merged(lead + stem)
                if len(stem) < len(w):
                    marks = w[len(stem) :]
                    if marks not in plain:
                        plain[marks] = self.merged(marks)
                    known[w] = known[stem] + plain[marks]
        if odd:
            known.update(zip(odd, self.whole([lead + w for w in odd]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.exact:
            return self.whole(texts)
        out, run, size = [], [], 0
        for t in texts:
            if run and size + len(t) > RUN:
                out += self.encode_run(run)
                run, size = [], 0
            run.append(t)
            size += len(t)
        return out + self.encode_run(run) if run else out

    def encode_run(self, texts: list[str]) -> list[bytes]:
        for space in (False, True):
            if len(self.known[space]) > CACHE // 2:
                self.older[space], self.known[space] = self.known[space], {}
        column = self.pa.array(texts, self.pa.large_string())
        uneven = self.pc.match_substring_regex(column, UNEVEN).to_pylist()
        kinds = [any(name in t for name in self.special) or odd and None for t, odd in zip(texts, uneven, strict=True)]
        even = iter(self.even([t for t, kind in zip(texts, kinds, strict=True) if kind is False]))
        return [next(even) if kind is False else self.whole([t])[0] if kind else self.cut(t) for t, kind in zip(texts, kinds, strict=True)]

    def cut(self, text: str) -> bytes:
        """Ids of a text with white space side by side or at an end."""
        first, *rest = SAFE_SPACE.split(text)
        self.learn([first], False)
        self.learn(rest, True)
        return self.known[False][first] + b"".join(map(self.known[True].__getitem__, rest))

    def even(self, texts: list[str]) -> list[bytes]:
        """Ids of texts with single spaces and line feeds between words only."""
        if not texts:
            return []
        np, pc = self.np, self.pc
        column = self.pa.array(["\n" + t for t in texts], self.pa.large_string())
        pieces = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")  # lines begin with a line feed, texts with an empty piece
        coded = pieces.flatten().dictionary_encode()
        number = self.numbers(coded.dictionary)[coded.indices.to_numpy()]
        del coded
        raw = b"".join([self.together(number[at : at + PUT]) for at in range(0, len(number), PUT)])
        # each text begins with the line feed put before it
        ends = np.cumsum(self.size[number], dtype=np.int64) * self.dtype.itemsize
        bounds = np.r_[0, ends][pieces.offsets.to_numpy()]
        return [raw[a + len(self.line) : b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def together(self, number: np.ndarray) -> bytes:
        """Ids of words one after the other."""
        np, n = self.np, self.size[number]
        ends = np.cumsum(n, dtype=np.int32)
        return self.ids[np.repeat(self.place[number] - (ends - n), n) + np.arange(ends[-1], dtype=np.int32)].tobytes()

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Where the columns have each of the distinct ``words``, after those they lack are put in."""
        np = self.np
        if len(self.words) > WORDS or len(self.ids) > WORDS * LONG:
            self.forget()
        number = self.pc.fill_null(self.pc.index_in(words, value_set=self.words), -1).to_numpy().copy()
        lacking = np.flatnonzero(number < 0)
        self.found[number[number >= 0]] += 1
        new = words.take(self.pa.array(lacking))
        names = new.to_numpy(zero_copy_only=False).tolist()
        self.learn([w[1:] for w in names if w[:1] == "\n"], False)
        self.learn([w for w in names if w and w[0] != "\n"], True)
        first, rest = self.known[False], self.known[True]
        ids = [(self.line + first[w[1:]] if w[0] == "\n" else rest[w]) if w else b"" for w in names]
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // self.dtype.itemsize
        number[lacking] = np.arange(len(self.words), len(self.words) + len(names))
        self.words = self.pa.concat_arrays([self.words, new])
        self.place = np.r_[self.place, len(self.ids) + np.cumsum(size, dtype=np.int32) - size]
        self.size, self.found = np.r_[self.size, size], np.r_[self.found, np.zeros(len(names), np.int32)]
        self.ids = np.r_[self.ids, np.frombuffer(b"".join(ids), self.dtype)]
        return number

    def forget(self) -> None:
        """Make room in the columns."""
        np = self.np
        kept = np.sort(np.argsort(-self.found, kind="stable")[: WORDS // 2])
        kept = kept[self.size[kept] <= LONG]
        n = self.size[kept]
        begin = np.cumsum(n, dtype=np.int32) - n
        self.ids = self.ids[np.repeat(self.place[kept] - begin, n) + np.arange(n.sum())]
        self.words, self.place, self.size, self.found = self.words.take(self.pa.array(kept)), begin, n, self.found[kept] // 2


SHARED: dict[tuple[str, str], Encoder] = {}


def runs(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    """Columns id and text of frames, put together until the texts have about as many characters as an encoder takes at once."""
    names, texts, size = [], [], 0
    for frame in frames:
        more = frame["text"].tolist()
        names, texts, size = names + frame["id"].tolist(), texts + more, size + sum(map(len, more))
        if size > RUN // 2:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts
