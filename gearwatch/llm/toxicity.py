"""Toxicity: a bidirectional gated recurrent network with attention pooling over characters and words, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gearwatch.llm.common import bounded_batches, free_names, smallest_draws, without_clashes
from gearwatch.llm.neural import Adam, sigmoid, temperature

#: A window has this many words; the next one starts this many words later.
WINDOW, STRIDE = 32, 16
#: Characters of a word that the character network reads; a longer word is read as overlapping pieces of this length.
LETTERS, OVERLAP = 16, 4
CHARS, CHAR_DIM, CHAR_HIDDEN, WORD_DIM, WORD_HIDDEN = 512, 8, 8, 8, 8
BUCKETS = 1 << 14
#: Character n-grams of these lengths carry how much likelier they are under label 1.
GRAMS = (3, 5)
#: Deviations that chance alone gives to some of many buckets.
NOISE = 2.5
#: The networks are fitted on at most about this many texts of each label, drawn by a hash of the text.
SAMPLE = 1500
ROUNDS, BATCH, RATE, CALIBRATE = 14, 64, 1e-2, 5
#: Words that are encoded at once.
WORD_BATCH = 8192
#: Distinct words whose vectors a task remembers before it starts anew.
CACHE = 200_000
OUTPUTS = ("score", "predicted")
PUNCTUATION = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII marks."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(PUNCTUATION).split()


# ---- gated recurrent layer, one direction -------------------------------------------------------------------------

def gru_init(rng: np.random.Generator, inputs: int, hidden: int, name: str) -> dict[str, np.ndarray]:
    return {
        f"{name}.w": rng.normal(0, inputs**-0.5, (inputs, 3 * hidden)).astype(np.float32),
        f"{name}.u": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32),
        f"{name}.b": np.r_[np.full(hidden, -1.0), np.zeros(2 * hidden)].astype(np.float32),
    }


def gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gru(p: dict[str, np.ndarray], name: str, projected: np.ndarray, mask: np.ndarray, back: bool, tape: list | None = None) -> np.ndarray:
    """States (steps, rows, hidden) for inputs already multiplied by ``w``; masked steps keep the state before them."""
    steps, rows, width = projected.shape
    h, u, hidden = np.zeros((rows, width // 3), np.float32), p[f"{name}.u"], width // 3
    u_gates, u_new = np.ascontiguousarray(u[:, : 2 * hidden]), np.ascontiguousarray(u[:, 2 * hidden :])
    out = np.empty((steps, rows, hidden), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        x, m = projected[t], mask[t][:, None]
        g = gate(x[:, : 2 * hidden] + h @ u_gates)
        z, r = g[:, :hidden], g[:, hidden:]
        n = np.tanh(x[:, 2 * hidden :] + (r * h) @ u_new)
        new = h + m * z * (n - h)
        if tape is not None:
            tape.append((t, h, z, r, n, m))
        out[t] = h = new
    return out


def gru_back(p: dict[str, np.ndarray], name: str, tape: list, grad_out: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
    """Gradient of the projected inputs; adds that of ``u`` to ``grads``."""
    hidden = grad_out.shape[2]
    u = p[f"{name}.u"]
    d_projected = np.zeros((*grad_out.shape[:2], 3 * hidden), np.float32)
    dh = np.zeros(grad_out.shape[1:], np.float32)
    for t, h, z, r, n, m in reversed(tape):
        dh = dh + grad_out[t]
        dn = dh * m * z * (1 - n * n)
        dz = dh * m * (n - h) * z * (1 - z)
        drh = dn @ u[:, 2 * hidden :].T
        dr = drh * h * r * (1 - r)
        gates = np.concatenate([dz, dr], 1)
        d_projected[t] = np.concatenate([gates, dn], 1)
        grads[f"{name}.u"][:, : 2 * hidden] += h.T @ gates
        grads[f"{name}.u"][:, 2 * hidden :] += (r * h).T @ dn
        dh = dh * (1 - m * z) + drh * r + gates @ u[:, : 2 * hidden].T
    return d_projected


# ---- bidirectional layer with attention pooling -------------------------------------------------------------------

class Encoder:
    """Both directions over a sequence, pooled by attention into one vector of twice the hidden width."""

    def __init__(self, name: str):
        self.name = name

    def init(self, rng: np.random.Generator, inputs: int, hidden: int) -> dict[str, np.ndarray]:
        n = self.name
        return (gru_init(rng, inputs, hidden, f"{n}.f") | gru_init(rng, inputs, hidden, f"{n}.g")
                | {f"{n}.a": rng.normal(0, 0.3, (2 * hidden, 1)).astype(np.float32)})

    def forward(self, p, x: np.ndarray | tuple[np.ndarray, np.ndarray], mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """x: (steps, rows, inputs), or both projections of it when they were looked up."""
        n = self.name
        pf, pg = x if isinstance(x, tuple) else (x @ p[f"{n}.f.w"] + p[f"{n}.f.b"], x @ p[f"{n}.g.w"] + p[f"{n}.g.b"])
        tf, tg = ([], []) if tape is not None else (None, None)
        h = np.concatenate([gru(p, f"{n}.f", pf, mask, False, tf), gru(p, f"{n}.g", pg, mask, True, tg)], 2)
        e = np.where(mask > 0, (h @ p[f"{n}.a"])[..., 0], -1e9)
        w = np.exp(e - e.max(0))
        w = w * mask
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = np.einsum("trh,tr->rh", h, w)
        if tape is not None:
            tape.update(x=x, mask=mask, h=h, w=w, tf=tf, tg=tg)
        return pooled

    def backward(self, p, tape: dict, d_pooled: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        n, h, w, x = self.name, tape["h"], tape["w"], tape["x"]
        hidden = h.shape[2] // 2
        dw = np.einsum("trh,rh->tr", h, d_pooled)
        de = w * (dw - (w * dw).sum(0))
        dh = w[..., None] * d_pooled + de[..., None] * p[f"{n}.a"][:, 0]
        grads[f"{n}.a"][:, 0] += np.einsum("trh,tr->h", h, de)
        dx = np.zeros_like(x)
        for side, part, own in (("f", dh[..., :hidden], tape["tf"]), ("g", dh[..., hidden:], tape["tg"])):
            d = gru_back(p, f"{n}.{side}", own, part, grads)
            grads[f"{n}.{side}.w"] += np.einsum("tri,trk->ik", x, d)
            grads[f"{n}.{side}.b"] += d.sum((0, 1))
            dx += d @ p[f"{n}.{side}.w"].T
        return dx


CHAR_NET, WORD_NET = Encoder("char"), Encoder("word")


def fnv(words: list[bytes]) -> np.ndarray:
    """Bucket of each word by an FNV hash over its bytes, all words at once."""
    width = max(map(len, words), default=0)
    if width > 64:  # few words are that long
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            h = 2166136261
            for b in w:
                h = (h ^ b) * 16777619 & 0xFFFFFFFF
            out[i] = h
        return (out ^ out >> 15) % BUCKETS
    grid = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    length = np.array([len(w) for w in words])
    h = np.full(len(words), 2166136261, np.uint64)
    for j in range(width):
        h = np.where(j < length, (h ^ grid[:, j]) * np.uint64(16777619) & np.uint64(0xFFFFFFFF), h)
    h = h.astype(np.int64)
    return (h ^ h >> 15) % BUCKETS


def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Characters (pieces x ``LETTERS``, 0: none) of all words with their edges, and the word of each piece."""
    rows, owner = [], []
    for i, word in enumerate(words):
        chars = np.frombuffer(("^" + word.decode("utf-8", "replace") + "$").encode("utf-32-le"), np.uint32)
        at = 0
        while True:
            rows.append(chars[at : at + LETTERS])
            owner.append(i)
            if at + LETTERS >= len(chars):
                break
            at += LETTERS - OVERLAP
    length = np.array([len(r) for r in rows])
    grid = np.zeros((len(rows), LETTERS), np.int64)
    grid[np.repeat(np.arange(len(rows)), length), np.arange(length.sum()) - np.repeat(length.cumsum() - length, length)] = np.concatenate(rows)
    grid = np.where(grid > 0, grid % (CHARS - 1) + 1, 0)
    return grid, np.array(owner)


def gram_cells(grid: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n characters that end at each place; -1 where fewer stand there."""
    out = np.full(grid.shape, -1, np.int64)
    if grid.shape[1] >= n:
        code = np.zeros((len(grid), grid.shape[1] - n + 1), np.int64)
        for j in range(n):
            code = (code * 1_000_003 + grid[:, j : j + code.shape[1]]) & 0x7FFFFFFF
        code = (code ^ code >> 13) * 7919 + n
        out[:, n - 1 :] = np.where(grid[:, n - 1 :] > 0, code % BUCKETS, -1)
    return out


@dataclass
class ToxicityModel:
    params: dict[str, np.ndarray]
    word_odds: np.ndarray
    gram_odds: dict[int, np.ndarray]
    temperature: float = 1.0
    memory: dict[bytes, int] = field(default_factory=dict, repr=False)
    rows: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memory", "rows")} | {"memory": {}, "rows": []}

    def char_inputs(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odds = [np.where(c >= 0, self.gram_odds[n][c], 0) for n in GRAMS for c in [gram_cells(grid, n)]]
        x = np.concatenate([self.params["letters"][grid], np.stack(odds, 2)], 2).astype(np.float32)
        return x.transpose(1, 0, 2), (grid > 0).T.astype(np.float32)

    def word_vectors(self, words: list[bytes]) -> np.ndarray:
        """Inputs of the word network: what the characters say, the word's own vector and its odds."""
        own = fnv(words)
        chars = np.zeros((len(words), 2 * CHAR_HIDDEN), np.float32)
        for at in range(0, len(words), WORD_BATCH):
            grid, owner = pieces(words[at : at + WORD_BATCH])
            width = max(4, int((grid > 0).sum(1).max()))
            x, mask = self.char_inputs(grid[:, :width])
            pooled = CHAR_NET.forward(self.params, x, mask)
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            chars[at : at + WORD_BATCH] = np.maximum.reduceat(pooled, heads, axis=0)
        return np.concatenate([chars, self.params["words"][own], self.word_odds[own][:, None]], 1).astype(np.float32)

    def window_logits(self, projections: tuple[np.ndarray, np.ndarray], ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        pooled = WORD_NET.forward(self.params, (projections[0][ids], projections[1][ids]), mask)
        return pooled @ self.params["out.w"] + self.params["out.b"][0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The highest of the windows of each whole text; a text without words is one empty window."""
        cut, known = [split_words(t) for t in texts], {b"": 0}
        numbers = [np.array([known.setdefault(w, len(known)) for w in c] or [0]) for c in cut]
        p, table = self.params, self.lookup(list(known))
        projections = tuple(table @ p[f"word.{s}.w"] + p[f"word.{s}.b"] for s in "fg")
        flat, first = np.concatenate([*numbers, np.zeros(WINDOW, np.int64)]), np.cumsum([0, *map(len, numbers)])
        starts, owner = window_starts([len(n) for n in numbers])
        size = np.minimum(WINDOW, np.diff(first)[owner] - starts)
        begin = first[owner] + starts
        best = np.full(len(texts), -np.inf)
        for at in range(0, len(begin), 2048):
            place = begin[at : at + 2048] + np.arange(WINDOW)[:, None]
            mask = (np.arange(WINDOW)[:, None] < size[at : at + 2048]).astype(np.float32)
            mask[0] = 1
            logits = self.window_logits(projections, flat[place], mask)
            np.maximum.at(best, owner[at : at + 2048], logits)
        return sigmoid(best / self.temperature)

    def forget(self) -> None:
        self.memory.clear()
        self.rows.clear()

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """Vectors of distinct words; those of earlier calls are remembered, up to ``CACHE`` words."""
        if len(self.memory) > CACHE:
            self.forget()
        new = [w for w in words if w not in self.memory]
        if new:
            at = sum(map(len, self.rows))
            self.rows.append(self.word_vectors(new))
            self.memory.update(zip(new, range(at, at + len(new)), strict=True))
        if len(self.rows) > 1:
            self.rows[:] = [np.concatenate(self.rows)]
        return self.rows[0][[self.memory[w] for w in words]]


def window_starts(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Start inside its text and text of every window; together they cover each text, overlapping by half."""
    n = np.array([max(1, -(-(x - WINDOW) // STRIDE) + 1) for x in lengths], np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    return (np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)) * STRIDE, owner


def odds(cells: list[np.ndarray], y: np.ndarray, buckets: int) -> np.ndarray:
    """How many deviations a bucket's share of texts with label 1 lies off what chance gives, beyond ``NOISE`` and scaled down."""
    seen, hits = np.zeros(buckets), np.zeros(buckets)
    for c, label in zip(cells, y, strict=True):
        u = np.unique(c)
        seen[u] += 1
        hits[u] += label
    share = y.mean()
    z = (hits - share * seen) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    return np.where(seen >= 3, np.clip((z - np.clip(z, -NOISE, NOISE)) / 3, -1, 3), 0).astype(np.float32)


def fit(texts: list[str], y: np.ndarray, seed: int = 5) -> ToxicityModel:
    """Fits on windows: a text with label 0 gives any of its windows, one with label 1 the window that scores highest so far.

    One text in ``CALIBRATE`` sets the temperature. Without texts of both labels every score is their share.
    """
    y = np.asarray(y, np.float64)
    rng = np.random.default_rng(seed)
    p = {"letters": rng.normal(0, 0.3, (CHARS, CHAR_DIM)).astype(np.float32), "words": np.zeros((BUCKETS, WORD_DIM), np.float32),
         "out.w": rng.normal(0, 0.3, 2 * WORD_HIDDEN).astype(np.float32), "out.b": np.zeros(1, np.float32)}
    p |= CHAR_NET.init(rng, CHAR_DIM + len(GRAMS), CHAR_HIDDEN) | WORD_NET.init(rng, 2 * CHAR_HIDDEN + WORD_DIM + 1, WORD_HIDDEN)
    model = ToxicityModel(p, np.zeros(BUCKETS, np.float32), {n: np.zeros(BUCKETS, np.float32) for n in GRAMS})
    if len(np.unique(y)) < 2:
        p["out.w"][:] = 0
        p["out.b"][:] = 0 if not len(y) else (6 if y[0] else -6)
        return model
    cut = [split_words(t) or [b""] for t in texts]
    vocabulary = list({w for c in cut for w in c})
    number = {w: i for i, w in enumerate(vocabulary)}
    ids = [np.array([number[w] for w in c]) for c in cut]
    bucket = fnv(vocabulary)
    grid, piece_word = pieces(vocabulary)
    piece_first = np.searchsorted(piece_word, np.arange(len(vocabulary) + 1))
    by_gram = {}
    for n in GRAMS:
        cells = gram_cells(grid, n)
        by_word = [cells[a:b][cells[a:b] >= 0] for a, b in zip(piece_first[:-1], piece_first[1:], strict=True)]
        by_gram[n] = [np.concatenate([by_word[w] for w in np.unique(i)]) for i in ids]

    def count_odds(chosen: np.ndarray) -> None:
        model.word_odds = odds([bucket[ids[i]] for i in chosen], y[chosen], BUCKETS)
        for n in GRAMS:
            model.gram_odds[n] = odds([by_gram[n][i] for i in chosen], y[chosen], BUCKETS)

    order = rng.permutation(len(y))
    aside, rest = order[: len(y) // CALIBRATE], order[len(y) // CALIBRATE :]
    if len(np.unique(y[rest])) < 2:
        aside, rest = order[:0], order  # a label of so few texts is needed for the weights
    count_odds(order)
    share = y[rest].mean()
    adam = Adam(p, RATE)
    for turn in range(ROUNDS):
        adam.rate = RATE * (1 - turn / ROUNDS) + 1e-3
        chosen = choose_windows(model, ids, rest, y, vocabulary, rng, turn)
        rng.shuffle(chosen)
        for at in range(0, len(chosen), BATCH):
            part = chosen[at : at + BATCH]
            labels = y[[d for d, _ in part]]
            weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
            adam.step(gradients(model, [ids[d][s : s + WINDOW] for d, s in part], labels, weight, vocabulary, bucket, grid, piece_first))
    if len(aside):
        count_odds(rest)  # those that the texts set aside had no part in
        model.forget()
        held = np.clip(model.score([texts[i] for i in aside]), 1e-7, 1 - 1e-7)
        model.temperature = temperature(np.log(held / (1 - held)), y[aside])
        count_odds(order)
    model.forget()
    return model


def choose_windows(model, ids, docs, y, vocabulary, rng, turn) -> list[tuple[int, int]]:
    """(text, start) of one window of each text: the most suspicious one by odds at first, by the network later."""
    out = []
    model.forget()
    table = model.lookup(vocabulary) if turn >= 2 else None
    p = model.params
    projections = tuple(table @ p[f"word.{s}.w"] + p[f"word.{s}.b"] for s in "fg") if table is not None else None
    starts, owner = window_starts([len(ids[d]) for d in docs])
    if projections is None:
        word = model.word_odds[fnv(vocabulary)]
        value = np.array([word[ids[docs[o]][s : s + WINDOW]].max() for s, o in zip(starts, owner, strict=True)])
    else:
        flat = np.concatenate([*[ids[d] for d in docs], np.zeros(WINDOW, np.int64)])
        first = np.cumsum([0, *[len(ids[d]) for d in docs]])
        size = np.minimum(WINDOW, np.diff(first)[owner] - starts)
        begin, value = first[owner] + starts, np.zeros(len(starts))
        for at in range(0, len(begin), 2048):
            place = begin[at : at + 2048] + np.arange(WINDOW)[:, None]
            mask = (np.arange(WINDOW)[:, None] < size[at : at + 2048]).astype(np.float32)
            value[at : at + 2048] = model.window_logits(projections, flat[place], mask)
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    stops = np.r_[heads[1:], len(owner)]
    for d, a, b in zip(docs, heads, stops, strict=True):
        out.append((d, int(starts[a + int(value[a:b].argmax())])))  # also of clean texts: what looks most like label 1
        if not y[d] and b - a > 1:
            out.append((d, int(starts[int(rng.integers(a, b))])))
    return out


def gradients(model, windows, labels, weight, vocabulary, bucket, grid, piece_first) -> dict[str, np.ndarray]:
    """Of the mean weighted log loss, through word network, characters and word vectors."""
    p = model.params
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    words, local = np.unique(np.concatenate(windows), return_inverse=True)
    length = np.array([len(w) for w in windows])
    index = np.zeros((WINDOW, len(windows)), np.int64)
    step = np.arange(length.sum()) - np.repeat(length.cumsum() - length, length)
    index[step, np.repeat(np.arange(len(windows)), length)] = local
    mask = (np.arange(WINDOW)[:, None] < length).astype(np.float32)
    # A word's first piece stands for it here; only words over LETTERS characters have more.
    piece = piece_first[words]
    own = grid[piece]
    width = max(4, int((own > 0).sum(1).max()))
    x, char_mask = model.char_inputs(own[:, :width])
    char_tape: dict = {}
    chars = CHAR_NET.forward(p, x, char_mask, char_tape)
    table = np.concatenate([chars, p["words"][bucket[words]], model.word_odds[bucket[words]][:, None]], 1)
    tape: dict = {}
    pooled = WORD_NET.forward(p, table[index], mask, tape)
    logits = pooled @ p["out.w"] + p["out.b"][0]
    d = ((sigmoid(logits) - labels) * weight / len(labels)).astype(np.float32)
    grads["out.w"] += pooled.T @ d
    grads["out.b"] += d.sum()
    dx = WORD_NET.backward(p, tape, np.outer(d, p["out.w"]).astype(np.float32), grads) * mask[..., None]
    d_table = np.zeros_like(table)
    np.add.at(d_table, index.ravel(), dx.reshape(-1, dx.shape[2]))
    np.add.at(grads["words"], bucket[words], d_table[:, 2 * CHAR_HIDDEN : -1])
    d_chars = CHAR_NET.backward(p, char_tape, d_table[:, : 2 * CHAR_HIDDEN], grads)
    np.add.at(grads["letters"], own[:, :width].T, d_chars[..., :CHAR_DIM])
    for k, v in p.items():
        if k not in ("words", "letters"):
            grads[k] += 1e-4 * v
    return grads


def fit_on(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text",
           label_column: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """The networks for labelled rows whose ids ``learn`` allows, at most ``sample`` distinct texts of each label.

    Null labels are not learned from; of repeated labels of one id the larger counts.
    """
    known = labels.groupBy(id_column).agg(F.max(label_column).cast("int").alias("y")).filter(F.col("y").isNotNull() & learn)
    text = F.coalesce(F.col(text_column), F.lit(""))
    # Only ids and hashes meet the labels; texts are fetched for the chosen hashes, a table of bounded size.
    hashed = docs.select(id_column, F.xxhash64(text).alias("draw")).join(known, id_column).select("y", "draw")
    chosen = smallest_draws(hashed, "y", "draw", sample)
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("draw")).join(F.broadcast(chosen), "draw")
    learned = texts.dropDuplicates(["draw", "y"]).toPandas().sort_values(["draw", "y"])
    return fit(learned["text"].tolist(), learned["y"].to_numpy())


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_column: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (score >= 0.5).

    All overlapping windows of the whole text are scored and the highest counts. Null and empty texts are one empty
    window. Repeated rows get the same score. An empty table gives an empty result; columns named like a result are
    replaced.
    """
    docs = without_clashes(docs, OUTPUTS, (text_column,))
    found = free_names(docs, "_found")[0]

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            out, part, size = [], [], 0
            for text in series:
                part.append(text)
                size += len(text or "")
                if size > 1 << 21:
                    out.append(model.score(part))
                    part, size = [], 0
            if part:
                out.append(model.score(part))
            yield pd.Series(np.concatenate(out) if out else [], index=series.index, dtype=float)

    rows = bounded_batches(docs).withColumn(found, score(F.col(text_column))).withColumnRenamed(found, "score")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
