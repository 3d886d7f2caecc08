"""Blocks of token ids under an adaptive range coder; strips of many blocks are coded in step, one numpy lane each.

A block stands for itself, and its header holds what a reader needs. Its strips of ``STRIP`` ids share the order-0
frequencies; the models that adapt start anew in each.

    magic 4 bytes | mode u1 | ids u4 | distinct ids u4 | code words u4 | crc32 of the ids as little-endian u4 | tables | code

Tables are the distinct ids in ascending order as differences, then how often each occurs, then the code words of each
strip, as base-128 numbers. The code is words of 32 bits, strip by strip. Mode 0 stores the ids plainly as u4 where coding
would not save anything.

Order 2 and order 1 each predict the id that came last after the same context, with a trust: how often in a row they
were right, up to ``TRUST``. The two trusts, and whether both name the same id, pick the counts of how often order 2,
order 1 or neither was right so far; the order-0 frequencies of the block code an id that neither has predicted.

The reader has to follow the models id by id. The writer knows all ids of a block, so it finds what the models say
before each id by sorting the block by strip and context, and only the arithmetic goes in step.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

MAGIC, HEADER = b"CMR2", struct.Struct("<4sBIIII")
#: Ids per block, which is 2 to the power of PLACE at most, ids per strip, and blocks that are coded in step.
BLOCK, PLACE, STRIP, LANES = 8192, 13, 2048, 1024
#: Slots of the order-2 predictions, and the total of order-0 frequencies, as powers of two.
SLOTS_2, TOTAL_0 = 10, 14
#: The largest trust, and the states that pick the counts.
TRUST, STATES = 3, 32
#: Counts before the first id: order 2 was right, one of both was, all; how the choices of order 2, order 1 and neither raise them.
FIRST, MORE = 2 | 3 << 16 | 5 << 32, (1 | 1 << 16 | 1 << 32, 1 << 16 | 1 << 32, 1 << 32)
#: The coder has 64 bits: a word of 32 leaves when the range falls below BOTTOM. Steps that are laid out at once.
WORD, BOTTOM, STEPS = np.uint64(32), np.uint64(1 << 32), 32
U = np.uint64


def varints(values: np.ndarray) -> bytes:
    """Base-128 numbers, low groups first."""
    values, width = values.astype(np.int64), np.ones(len(values), np.int64)
    for j in range(1, 5):
        width += values >= 1 << 7 * j
    place = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    out[place] = (values & 127) | (width > 1) * 128
    for j in range(1, int(width.max(initial=1))):
        at = np.flatnonzero(width > j)
        out[place[at] + j] = (values[at] >> 7 * j & 127) | (width[at] > j + 1) * 128
    return out.tobytes()


def read_varints(raw: bytes, n: int) -> tuple[np.ndarray, int]:
    """``n`` numbers and how many bytes they took."""
    if not n:
        return np.zeros(0, np.int64), 0
    buf = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(buf[: 5 * n] < 128)[:n]
    begins = np.r_[0, ends[:-1] + 1]
    out = np.zeros(n, np.int64)
    for j in range(int((ends - begins).max()) + 1):
        has = ends - begins >= j
        out[has] |= (buf[begins[has] + j].astype(np.int64) & 127) << (7 * j)
    return out, int(ends[-1]) + 1


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to the order-0 total; the first one takes what is left over."""
    out = counts.astype(np.int64) * (1 << TOTAL_0) // max(int(counts.sum()), 1)
    if len(out):
        out[0] += (1 << TOTAL_0) - out.sum()
    return out


def slots_2(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Where order 2 keeps its prediction after the ids ``before`` and ``last``."""
    return (last * 1223 + before) & ((1 << SLOTS_2) - 1)


def by_place(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a block in ascending order and their places in it; equal keys stay in order."""
    both = np.sort(keys.astype(np.uint32) << np.uint32(PLACE) | np.arange(len(keys), dtype=np.uint32))
    return both >> np.uint32(PLACE), (both & np.uint32((1 << PLACE) - 1)).astype(np.intp)


def predictions(context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What a table by ``context`` holds before each of ``ids``, as four times the id and the trust: as ``decode_lanes`` does id by id."""
    key, place = by_place(context)
    seen = np.zeros(len(ids), bool)
    seen[1:] = key[1:] == key[:-1]
    follower = ids[place]
    guess = np.zeros_like(ids)
    guess[1:] = follower[:-1]
    guess *= seen
    once = seen  # the guess before, of the same context, was right
    once[1:] &= (guess == follower)[:-1]
    twice, thrice = once.copy(), once.copy()
    twice[1:] &= once[:-1]
    twice[:1] = thrice[:2] = False
    thrice[2:] &= twice[1:-1]
    out = np.empty_like(ids)
    out[place] = guess * 4 + (once.view(np.uint8) + twice.view(np.uint8) + thrice.view(np.uint8))
    return out


def counts_before(state: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """One row for each id: the counts that its state has before it, 16 bits each."""
    key, place = by_place(state)
    sizes = np.bincount(state)
    more = np.array(MORE, np.int64).take(chosen[place])
    held = np.cumsum(more) - more
    held -= np.repeat(held.take(np.cumsum(sizes) - sizes, mode="clip"), sizes) - FIRST
    out = np.empty(len(state), "<i8")
    out[place] = held
    return out.view("<u2").reshape(-1, 4)


def encode_blocks(blocks: Sequence[np.ndarray]) -> list[bytes]:
    """One coded block for each array of at most ``BLOCK`` ids."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        for i, raw in zip(part, encode_lanes([np.asarray(blocks[i], np.int64) for i in part]), strict=True):
            out[i] = raw
    return out


def encode_lanes(blocks: list[np.ndarray]) -> list[bytes]:
    """Blocks from longest to shortest, their strips in step."""
    strips = -(-len(blocks[0]) // STRIP)
    tables, laid = [], np.zeros((5, len(blocks), strips * STRIP), np.uint16)
    strip = np.repeat(np.arange(strips, dtype=np.int32), STRIP)
    for i, ids in enumerate(blocks):
        values, local, counts = numbered(ids)
        tables.append((len(values), np.r_[np.diff(values, prepend=0), counts]))
        n = len(ids)
        if not n:
            continue
        last, before = np.zeros(n, np.int32), np.zeros(n, np.int32)
        last[1:], before[2:] = local[:-1], local[:-2]
        last[::STRIP] = before[::STRIP] = before[1::STRIP] = 0
        entry2 = predictions(slots_2(last, before) | strip[:n] << SLOTS_2, local)
        entry1 = predictions(last | strip[:n] << PLACE, local)
        id2, id1 = entry2 >> 2, entry1 >> 2
        state = (entry2 & 3) * 4 + (entry1 & 3) + 16 * (id1 == id2) + STATES * strip[:n]
        not_2 = local != id2
        none = not_2 & (local != id1)
        held, f = counts_before(state, not_2.view(np.int8) + none.view(np.int8)), frequencies(counts)
        begin, total = np.where(none, held[:, 1], held[:, 0] * not_2), held[:, 2]
        laid[0, i, :n], laid[2, i, :n] = begin, total
        laid[1, i, :n] = np.where(none, total, np.where(not_2, held[:, 1], held[:, 0])) - begin
        laid[3, i, :n] = (np.cumsum(f) - f).astype(np.uint16)[local] * none
        laid[4, i, :n] = f.astype(np.uint16)[local] * none
    sizes = np.clip(np.array([[len(b)] for b in blocks]) - np.arange(strips) * STRIP, 0, STRIP)
    codes = written(laid.reshape(5, -1, STRIP), sizes.ravel())
    out = []
    for i, (ids, (n, table)) in enumerate(zip(blocks, tables, strict=True)):
        own = codes[i * strips : i * strips + -(-len(ids) // STRIP)]
        plain, code = ids.astype("<u4").tobytes(), b"".join(own)
        head = varints(np.r_[table, [len(c) // 4 for c in own]])
        coded, crc = len(head) + len(code) < len(plain), zlib.crc32(plain)
        start = HEADER.pack(MAGIC, int(coded), len(ids), n, len(code) // 4, crc)
        out.append(start + (head + code if coded else plain))
    return out


def numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids in ascending order, each id's number among them, and how often each occurs."""
    ordered = np.sort(ids.astype(np.uint32))
    other = np.ones(len(ids), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=other[1:])
    first = other.nonzero()[0]
    values, counts = ordered[first].astype(np.int64), np.diff(first, append=len(ids))
    if not len(ids) or values[-1] >> 17:
        return values, np.searchsorted(values, ids).astype(np.int32), counts
    number = np.empty(values[-1] + 1, np.int32)
    number[values] = np.arange(len(values))
    return values, number[ids], counts


def written(laid: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The code of each lane: ``laid`` has begin, size and total of its choices, begin and size of ids under order 0, else zeros."""
    _, lanes, longest = laid.shape
    order, room = np.argsort(-sizes, kind="stable"), longest + 4
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    first = order * room + 1  # a word before each lane's own takes no carry, as no code reaches 1
    words, n, sizes = np.zeros(lanes * room, np.uint64), first.copy(), sizes[order]
    m = lanes
    for t in range(longest):
        if m and sizes[m - 1] <= t:
            m = int((sizes > t).sum())
        if not m:
            break
        if t % STEPS == 0:
            chunk = laid[:, order[:m], t : t + STEPS].transpose(2, 0, 1).astype(np.uint64, order="C")
        begin, size, total, begin_0, size_0 = chunk[t % STEPS, :, :m]
        span, own = rng[:m], size_0 > 0
        unit = span // total
        shift = begin * unit
        span = size * unit
        unit = span >> U(TOTAL_0)
        shift += begin_0 * unit
        span = np.where(own, size_0 * unit, span)
        old = low[:m]
        new = old + shift
        over = new < old
        if np.count_nonzero(over):
            words[n[:m][over] - 1] += U(1)
        at = (span < BOTTOM).nonzero()[0]
        if len(at):
            top, where = new[at], n[at]
            words[where] = top >> WORD
            n[at] = where + 1
            new[at] = top << WORD
            span[at] <<= WORD
        low[:m], rng[:m] = new, span
    words[n], words[n + 1] = low >> WORD, low & (BOTTOM - U(1))
    while len(over := np.flatnonzero(words >= BOTTOM)):
        words[over] -= BOTTOM
        words[over - 1] += U(1)
    ends, words = np.empty_like(n), words.astype("<u4")
    ends[order] = n + 2
    return [words[lane * room + 1 : end].tobytes() for lane, end in enumerate(ends.tolist())]


def decode_blocks(raws: Sequence[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block that is cut short or altered is an error."""
    out: list[np.ndarray | None] = [None] * len(raws)
    coded = []
    for i, raw in enumerate(raws):
        magic, mode, n, distinct, code_words, crc = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a block of ids")
        if mode:
            coded.append((n, i, distinct, code_words, crc))
        else:
            out[i] = checked(np.frombuffer(raw, "<u4", n, HEADER.size), crc)
    coded.sort(key=lambda x: -x[0])
    for at in range(0, len(coded), LANES):
        part = coded[at : at + LANES]
        for (_, i, _, _, crc), ids in zip(part, decode_lanes(part, raws), strict=True):
            out[i] = checked(ids, crc)
    return out


def checked(ids: np.ndarray, crc: int) -> np.ndarray:
    if zlib.crc32(ids) != crc:
        raise ValueError("a block of ids does not have the checksum of its header")
    return ids


def decode_lanes(part: list[tuple[int, int, int, int, int]], raws: Sequence[bytes]) -> list[np.ndarray]:
    """Blocks from longest to shortest, their strips in step."""
    width = max(p[2] for p in part)
    values, codes, lengths, sizes, block = [], [], [], [], []
    cells, slots = np.zeros((len(part), width), np.uint32), np.zeros((len(part), 1 << TOTAL_0), np.uint16)
    for row, (n, i, distinct, code_words, _) in enumerate(part):
        strips = -(-n // STRIP)
        body = raws[i][HEADER.size :]
        table, used = read_varints(body, 2 * distinct + strips)
        values.append(np.cumsum(table[:distinct]).astype("<u4"))
        f = frequencies(table[distinct : 2 * distinct])
        cells[row, :distinct] = (np.cumsum(f) - f) << 16 | f
        slots[row] = np.repeat(np.arange(distinct, dtype=np.uint16), f)
        codes.append(np.frombuffer(body[used : used + 4 * code_words], "<u4"))
        lengths += table[2 * distinct :].tolist()
        sizes += [min(STRIP, n - at) for at in range(0, n, STRIP)]
        block += [row] * strips
    words = np.concatenate([*codes, np.zeros(2, np.uint32)]).astype(np.uint32)
    last_word, sizes, lanes = len(words) - 1, np.array(sizes), len(sizes)
    order = np.argsort(-sizes, kind="stable")
    n, sizes, block = (np.cumsum(lengths) - lengths)[order], sizes[order], np.array(block)[order]
    code = words[n].astype(np.uint64) << WORD | words[n + 1]
    n += 2
    cells, slots = cells.ravel(), slots.ravel()
    lane = np.arange(lanes, dtype=np.int64)
    base1, base2, base_mix, base_cell, base_slot = lane * width, lane << SLOTS_2, lane * STATES, block * width, block << TOTAL_0
    table1, table2 = np.zeros(lanes * width, np.int32), np.zeros(lanes << SLOTS_2, np.int32)
    counts, more, field = np.full(lanes * STATES, FIRST, np.uint64), np.array(MORE, np.uint64), U(0xFFFF)
    last, before, rng = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.full(lanes, (1 << 64) - 1, np.uint64)
    local, m = np.zeros((sizes[0], lanes), np.uint16), lanes
    top, nothing = U((1 << TOTAL_0) - 1), U(0)
    for t in range(sizes[0]):
        if sizes[m - 1] <= t:
            m = int((sizes > t).sum())
            last, before, rng, code, n = last[:m], before[:m], rng[:m], code[:m], n[:m]
            base1, base2, base_mix = base1[:m], base2[:m], base_mix[:m]
        at1, at2 = base1 + last, base2 + slots_2(last, before)
        entry1, entry2 = table1.take(at1), table2.take(at2)
        id1, id2, trust1, trust2 = entry1 >> 2, entry2 >> 2, entry1 & 3, entry2 & 3
        state = base_mix + (trust2 * 4 + trust1 + 16 * (id1 == id2))
        held = counts.take(state)
        total = held >> WORD
        unit = rng // total
        a, b = (held & field) * unit, (held >> U(16) & field) * unit
        not_2, none = code >= a, code >= b
        begin = np.where(none, b, np.where(not_2, a, nothing))
        rng = np.where(none, total * unit, np.where(not_2, b, a)) - begin
        code = code - begin
        ids = np.where(not_2, id1, id2)
        new = none.nonzero()[0]
        if len(new):
            unit, rest = rng.take(new) >> U(TOTAL_0), code.take(new)
            own = slots.take(base_slot.take(new) + np.minimum(rest // unit, top).astype(np.int64))
            cell = cells.take(base_cell.take(new) + own).astype(np.uint64)
            code[new] = rest - (cell >> U(16)) * unit
            rng[new] = (cell & field) * unit
            ids[new] = own
        small = (rng < BOTTOM).nonzero()[0]
        if len(small):
            place = n.take(small)
            code[small] = code.take(small) << WORD | words.take(np.minimum(place, last_word))
            rng[small] = rng.take(small) << WORD
            n[small] = place + 1
        local[t, :m] = ids
        fresh = ids << 2
        table1[at1] = np.where(id1 == ids, entry1 + (trust1 < TRUST), fresh)
        table2[at2] = np.where(id2 == ids, entry2 + (trust2 < TRUST), fresh)
        counts[state] = held + more.take(not_2.view(np.int8) + none.view(np.int8))
        before, last = last, ids.astype(np.int64)
    strips = np.empty((lanes, sizes[0]), np.uint16)
    strips[order] = local.T
    found, at = [], 0
    for v, (n, *_) in zip(values, part, strict=True):
        end = at + -(-n // STRIP)
        found.append(v.take(strips[at:end].ravel()[:n]))
        at = end
    return found
