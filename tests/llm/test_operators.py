"""Each operator on awkward rows and on no rows, against plain versions of what it promises."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gearwatch.llm import (
    decontaminate,
    exact_dedup,
    language,
    near_dedup,
    packing,
    quality,
    range_coder,
    shards,
    substring_dedup,
    token_files,
    tokens,
    toxicity,
)
from gearwatch.llm.tokens import Encoder
from gearwatch.session import scratch_path
from tests.llm.conftest import edge_rows, prose

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(r[0], r[1]) for r in edge_rows()]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(VOCABULARY)
    return t


def plain_ids(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- exact dedup ------------------------------------------------------------------------------------------------

def test_exact_dedup(edges):
    got = exact_dedup.mark_exact_duplicates(edges).select("doc_id", *exact_dedup.OUTPUTS).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    want = Counter()
    for t, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] if m[2] is not None else 0))[2]
        sha = hashlib.sha256(t.encode()).hexdigest()
        first = True
        for _, _, i in sorted(members, key=lambda m: (m[0], m[1], m[2] or 0)):
            want[(i, keep, len(members), i == keep and first, sha)] += 1
            first = first and i != keep
    assert Counter(tuple(r) for r in got) == want


def test_exact_dedup_keeps_columns(edges, nothing):
    kept = exact_dedup.drop_exact_duplicates(edges)
    assert kept.columns == edges.columns
    assert kept.filter("kept = 'k'").count() > 5
    assert exact_dedup.drop_exact_duplicates(nothing).count() == 0


# ---- shards -----------------------------------------------------------------------------------------------------

def least_capacity(sizes, n):
    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= n
    low, high = 1, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("n", [1, 3, 24])
def test_shards(edges, n):
    got = shards.shard_by_bytes(edges, n).select("doc_id", *shards.OUTPUTS).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS)
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t].append((i, len((t or "").encode()) + 8))
    at = {}
    for r in got:
        at.setdefault(r["shard"], []).append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in at.values())
    order = sorted(groups.values(), key=lambda g: min((i for i, _ in g if i is not None), default=-(2**63)))
    best = least_capacity([sum(s for _, s in g) for g in order], n)
    assert max(sum(r["size"] for r in rows) for rows in at.values()) == best
    placed = defaultdict(set)
    for r in got:
        placed[(r["text_crc32"], r["size"])].add(r["shard"])
    assert all(len(s) == 1 for k, s in placed.items() if k[1] > 8)


def test_shards_of_nothing(nothing):
    assert shards.shard_by_bytes(nothing).count() == 0


def test_cuts_stay_best_with_few_cells(spark, monkeypatch):
    monkeypatch.setattr(shards, "CELLS", 64)
    rng = np.random.default_rng(3)
    sizes = (rng.pareto(1.3, 900) * 100 + 8).astype(int)
    ends = spark.createDataFrame([(int(e), int(s)) for e, s in zip(sizes.cumsum(), sizes, strict=True)], "end long, size long")
    cuts = shards.minimax_cuts(ends, 24)
    assert np.diff([0, *cuts]).max() == least_capacity(sizes.tolist(), 24) and set(cuts) <= set(sizes.cumsum().tolist())


@pytest.mark.parametrize(("hot", "share", "gap"), [(10, 0.044, 3), (3, 0.044, 3), (6, 0.054, 3), (1, 0.3, 40), (23, 0.042, 2), (24, 0.04, 0)])
def test_hot_groups_do_not_raise_the_capacity(spark, monkeypatch, hot, share, gap):
    monkeypatch.setattr(shards, "CELLS", 256)
    total, rng = 25_000, np.random.default_rng(hot)
    sizes = []
    for _ in range(hot):
        sizes += [*rng.integers(8, 12, gap).tolist(), int(share * total)]
    while sum(sizes) < total - 20:
        sizes.append(int(rng.integers(8, 20)))
    sizes = np.array(sizes)
    ends = spark.createDataFrame([(int(e), int(s)) for e, s in zip(sizes.cumsum(), sizes, strict=True)], "end long, size long")
    cuts = shards.minimax_cuts(ends, 24)
    assert len(cuts) <= 24 and cuts[-1] == sizes.sum() and set(cuts) <= set(sizes.cumsum().tolist())
    assert np.diff([0, *cuts]).max() == least_capacity(sizes.tolist(), 24)
    if hot == 1:  # alone in its shard, so the others are even
        others = np.sort(np.diff([0, *cuts]))[:-1]
        assert np.diff([0, *cuts]).max() == int(share * total) and others.max() <= 0.7 * total / 22


# ---- tokens, packing, files -------------------------------------------------------------------------------------

def test_pieces_of_words_give_the_ids_of_the_text(tokenizer):
    texts = [t or "" for _, t in ROWS] + [" lead", "trail ", "a  b", "a \n b\nc", "\n", "a\n\nb c", "can't won't 's x", "\ta\t b"]
    want = [plain_ids(tokenizer, t, 0)[:-1] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(VOCABULARY).encode(texts)] == want


def test_packing(edges, tokenizer):
    width = 64
    got = packing.pack(edges, VOCABULARY, width).collect()
    streams = defaultdict(dict)
    docs = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        streams[r["sequence_id"]][r["offset"]] = ids
        docs[r["doc_id"]].append((r["sequence_id"], r["offset"], r["start"], r["doc_tokens"], ids))
    whole = []
    for k in range(len(streams)):
        at = 0
        for offset in sorted(streams[k]):
            assert offset == at
            at += len(streams[k][offset])
            whole += streams[k][offset]
        assert at == width or k == len(streams) - 1
    found = Counter()
    for i, pieces in docs.items():
        ids = []
        for _, _, start, total, part in sorted(pieces):
            if start == 0 and ids:
                found[(i, tuple(ids))] += 1
                ids = []
            assert start == len(ids) and total >= start + len(part)
            ids += part
        found[(i, tuple(ids))] += 1
    assert found == Counter((i, tuple(plain_ids(tokenizer, t, 1))) for i, t in ROWS)


def test_packing_nothing(nothing):
    assert packing.piece_digests(packing.pack(nothing, VOCABULARY)).count() == 0


def test_token_files(spark, edges, tokenizer):
    path = scratch_path(spark, "files")
    token_files.write_tokens(edges, path, VOCABULARY)
    got = token_files.read_tokens(spark, path).collect()
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4"))) for r in got) == Counter(
        (i, tuple(plain_ids(tokenizer, t, 2))) for i, t in ROWS)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_token_files_of_nothing(spark, nothing):
    path = scratch_path(spark, "files")
    token_files.write_tokens(nothing, path, VOCABULARY)
    assert token_files.read_tokens(spark, path).count() == 0


def test_range_coder_round_trip():
    rng = np.random.default_rng(1)
    blocks = [np.zeros(0, int), np.array([5]), np.array([2**31] * 9), rng.integers(0, 50257, 8192), rng.zipf(1.3, 8192) % 50257,
              np.repeat(3, 8192), rng.integers(0, 9, 777), np.tile(np.arange(500), 16)]
    raws = range_coder.encode_blocks(blocks)
    for a, b in zip(blocks, range_coder.decode_blocks(raws), strict=True):
        assert np.array_equal(a, b)
    assert len(raws[5]) < 100 and len(raws[7]) < 4 * 8000 / 8


def test_range_coder_codes_the_strips_of_a_block_in_step(monkeypatch):
    """A step costs the same for few lanes as for many, so a block takes as many steps as a strip has ids, not one for each id."""
    steps, slots = [], range_coder.slots_2
    raws = range_coder.encode_blocks(blocks := [np.random.default_rng(k).zipf(1.3, 8192) % 50257 for k in range(3)])
    monkeypatch.setattr(range_coder, "slots_2", lambda *x: steps.append(1) or slots(*x))
    for a, b in zip(blocks, range_coder.decode_blocks(raws), strict=True):
        assert np.array_equal(a, b)
    assert len(steps) == range_coder.STRIP <= 8192 // 4


def test_range_coder_strips_of_any_length():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 40, n) for n in (0, 1, 2, 3, 2047, 2048, 2049, 2050, 4096, 6145, 8191, 8192)] + [np.tile([7, 7, 9, 0], 1500)]
    for a, b in zip(blocks, range_coder.decode_blocks(range_coder.encode_blocks(blocks)), strict=True):
        assert np.array_equal(a, b)


def test_encoder_looks_known_words_up_as_columns(tokenizer, monkeypatch):
    """A word goes through the merges once, and not again while the columns hold it, however many other words a run has."""
    monkeypatch.setattr(tokens, "CACHE", 4)
    encoder, texts = Encoder(VOCABULARY), [" ".join(f"{a}{b}" for a in "abcdefgh" for b in "stuvwxyz")] * 3
    want, merged = plain_ids(tokenizer, texts[0], 2)[:-1], []
    monkeypatch.setattr(encoder, "merged", lambda piece, merge=encoder.merged: merged.append(piece) or merge(piece))
    for _ in range(4):
        assert all(np.frombuffer(raw, "<u4").tolist() == want for raw in encoder.encode(texts))
    assert len(merged) == len(set(merged)) == 64


def test_encoder_that_forgets_gives_the_ids_of_whole_texts(tokenizer, monkeypatch):
    for name, most in (("CACHE", 40), ("WORDS", 30), ("LONG", 4), ("RUN", 300), ("PUT", 7)):
        monkeypatch.setattr(tokens, name, most)
    rng, encoder = np.random.default_rng(4), Encoder(VOCABULARY)
    bits = ["a", "word", "\u00dcn\u00ef", " ", " ", "\n", "  ", "\t", "\x1c", "\x85", "\xa0", "\u2003", "12", "!?", "<|endoftext|>", "x.", "'s",
            "\u65e5\u672c", "\u200b", "e\u0301", "\x00", "\r\n", "\u0250", "\U0001f600", "of course", "long" * 20]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(2000)]
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == plain_ids(tokenizer, text, 2)[:-1], text


def test_range_coder_blocks_stand_alone_and_are_checked():
    rng = np.random.default_rng(2)
    blocks = [rng.zipf(1.4, 3000) % 1000 for _ in range(5)]
    raws = range_coder.encode_blocks(blocks)
    assert range_coder.encode_blocks([blocks[3]])[0] == raws[3]
    assert np.array_equal(range_coder.decode_blocks([raws[3]])[0], blocks[3])
    broken = bytearray(raws[2])
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode_blocks([bytes(broken)])


# ---- substring dedup --------------------------------------------------------------------------------------------

def plain_repeats(rows, window):
    first = {}
    cut = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in cut:
        for s in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, w in cut:
        gone = set()
        for s in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


@pytest.mark.parametrize(("window", "patterns", "segments"), [(50, 16_000, 20_000), (50, 20, 2), (9, 50, 3)])
def test_substring_dedup(spark, edges, monkeypatch, window, patterns, segments):
    monkeypatch.setattr(substring_dedup, "PATTERNS", patterns)
    monkeypatch.setattr(substring_dedup, "SEGMENTS", segments)
    once = edges.filter("doc_id IS NULL OR doc_id != 15")  # one id with two texts has no plain meaning
    got = substring_dedup.remove_repeats(once, window).collect()
    want = plain_repeats([r for r in ROWS if r[0] != 15], window)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == want
    assert all(sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_substring_dedup_of_nothing(nothing):
    assert substring_dedup.remove_repeats(nothing).count() == 0


# ---- near dedup -------------------------------------------------------------------------------------------------

def plain_components(rows, k):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = [i for i in sets if i is not None]
    for _ in ids:
        before = dict(label)
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = min(label[a], label[b])
        if before == label:
            break
    return Counter((i, len(s), label[i], i is None or label[i] == i) for i, s in sets.items())


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup(spark, edges, k):
    once = edges.filter("doc_id IS NOT NULL AND doc_id NOT IN (15, 16)")
    got = near_dedup.mark_near_duplicates(once, k).collect()
    want = plain_components([r for r in ROWS if r[0] not in (15, 16, None)], k)
    assert Counter(tuple(r) for r in got) == want


def test_near_dedup_chain_of_copies(spark):
    """Each copy differs more from the first: links lead along the chain although its ends are no pair."""
    words, rows = prose(8, 200).split(), []
    for i in range(30):
        words = [*words]
        words[(i * 37) % 200] = f"new{i}"
        rows.append((100 - i, " ".join(words)))
    rows += [(200 + i, prose(50 + i, 120)) for i in range(20)]
    got = near_dedup.mark_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert Counter(tuple(r) for r in got) == plain_components(rows, 4)


@pytest.mark.parametrize("block", [7, 256])
def test_clusters_are_compared_in_full(spark, monkeypatch, block):
    """Near copies of a text that is not there itself: some pairs are links, most are just below."""
    base, rows = prose(9, 120).split(), []
    for i in range(60):
        own = list(base)
        for j in range(3):
            own[(i * 5 + 41 * j + (i % 4)) % 120] = f"z{i}y{j}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, prose(60 + i, 90)) for i in range(10)]
    monkeypatch.setattr(near_dedup.across, "__defaults__", (block,))
    got = near_dedup.mark_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert Counter(tuple(r) for r in got) == plain_components(rows, 4)


def test_links_across_components(spark):
    rows = [(i, prose(9, 150) + f" {prose(900 + i, 12)}") for i in range(40)]
    sets = near_dedup.sketches(spark.createDataFrame(rows, "id long, text string"), 4, "id", "text").cache()
    full = near_dedup.full_sets(spark.createDataFrame(rows, "doc_id long, text string"), sets.select("id"), 4, "doc_id", "text")
    members = sets.select(F.lit(0).cast("long").alias("cluster"), "id", F.col("id").alias("component"))
    got = near_dedup.across(members, sets, full, block=7).select("a", "b").collect()
    assert len({x for r in got for x in r}) == 40 and len(got) < 40 * 6


def test_near_dedup_odd_rows(edges, nothing):
    marks = near_dedup.mark_near_duplicates(edges)
    assert marks.count() == len(ROWS)
    assert marks.filter("doc_id IS NULL AND NOT kept").count() == 0
    kept = near_dedup.drop_near_duplicates(edges)
    assert kept.columns == edges.columns and 0 < kept.count() < len(ROWS)
    assert near_dedup.drop_near_duplicates(nothing).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 2**63, 3000, dtype=np.uint64) for _ in range(2))
    ra, rb = (near_dedup.registers(x) for x in (a, b))
    assert np.array_equal(near_dedup.registers(np.concatenate([a, b])), np.maximum(ra, rb))
    other = np.concatenate([a[:2700], b[:300]])
    guess = near_dedup.estimate(ra[None].astype(int), near_dedup.registers(other)[None].astype(int), np.array([3000.0]), np.array([3000.0]))
    assert abs(guess[0] - 2700 / 3300) < 0.12


# ---- decontamination --------------------------------------------------------------------------------------------

ITEMS = [(1, prose(30, 30)), (2, prose(31, 15)), (3, None), (4, ""), (5, "two words"), (6, prose(30, 30)), (7, prose(32, 57))]


def plain_contamination(rows):
    cut = lambda t: WORD.findall((t or "").lower())
    grams = lambda w: Counter(tuple(w[s : s + 5]) for s in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    items = {i: cut(t) for i, t in ITEMS if cut(t)}
    often = Counter(g for w in items.values() for g in grams(w))
    weight = lambda g: max(1, round(4096 / (often[g] or 1) ** 0.5))
    out = []
    for i, t in rows:
        w, found = cut(t), {}
        for item, own in items.items():
            a = grams(own)
            for s in range(len(w) - len(own) + 1):
                b = grams(w[s : s + len(own)])
                if a.keys() & b.keys():
                    low = sum(min(a[g], b[g]) * weight(g) for g in a)
                    value = low / (sum(n * weight(g) for g, n in a.items()) + sum(n * weight(g) for g, n in b.items()) - low)
                    if value >= 0.8:
                        found[item] = max(found.get(item, 0), value)
        out.append((i, bool(found), tuple(sorted(found)), round(max(found.values()), 9) if found else None))
    return Counter(out)


def test_decontamination(spark):
    rows = [
        (1, prose(40, 50) + " " + ITEMS[0][1] + " " + prose(41, 50)), (2, ITEMS[1][1].upper()), (3, "so two words here"), (4, "two words"),
        (5, prose(42, 300)), (6, None), (7, ""), (8, " ".join(ITEMS[0][1].split()[:20])), (9, " ".join(ITEMS[6][1].split()[1:]) + " more"),
        (10, " ".join(ITEMS[6][1].split()[:28] + ["odd"] + ITEMS[6][1].split()[29:])), (None, ITEMS[1][1]), (11, ITEMS[1][1]), (11, ITEMS[1][1]),
        (12, prose(43, 20_000, 3000) + " " + ITEMS[0][1]), (13, ITEMS[0][1] + " " + ITEMS[0][1]),
    ]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, items int, similarity string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.mark_contaminated(docs, items).collect()
    assert Counter((r["doc_id"], r["contaminated"], tuple(r["items"]), round(r["similarity"], 9) if r["similarity"] else None) for r in got) == plain_contamination(rows)
    assert {r["doc_id"]: r["n_passages"] for r in got}[13] == 4  # two places, items 1 and 6
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.filter("similarity = 'x'").count() == kept.count() > 0


def test_decontamination_in_slices_and_without_rows(spark, edges, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, t in ITEMS], "doc_id long, text string")
    one = decontaminate.find_passages(docs, items).select("doc_id", "passages").collect()
    many = decontaminate.find_passages(docs, items, bound=20).select("doc_id", "passages").collect()
    assert Counter(map(str, one)) == Counter(map(str, many)) and any(r["passages"] for r in one)
    assert decontaminate.mark_contaminated(edges, items).count() == len(ROWS)
    assert decontaminate.mark_contaminated(nothing, items).count() == 0
    assert decontaminate.mark_contaminated(edges, items.limit(0)).filter("contaminated").count() == 0


def changed(text, *places):
    return " ".join(f"odd{i}" if i in places else w for i, w in enumerate(text.split()))


def plain_similarity(a, b):
    x, y = [Counter(tuple(w[s : s + 5]) for s in range(len(w) - 4)) for w in (a.lower().split(), b.lower().split())]
    return (x & y).total() / (x | y).total()


def test_near_copies_of_repeated_and_templated_items(spark):
    """One rule for all items: how often a shingle is in the benchmark does not move the threshold."""
    short, long, frame = prose(50, 54), prose(51, 104), prose(52, 40)
    items = [short] * 4 + [long] * 16 + [frame + " " + prose(60 + i, 20) for i in range(16)]
    docs = [changed(short, 27), changed(long, 52), changed(items[20], 50), changed(items[20], 59, 20), changed(short, 25, 40)]
    # Half of the words are one phrase again and again, and the changed words are one word again and again.
    items.append(" ".join(["to be or not"] * 13) + " " + prose(53, 52))
    docs.append(" ".join([*items[-1].split()[:-9], *["so"] * 9]))
    want = {d: {i for i, t in enumerate(items) if plain_similarity(text, t) >= 0.8} for d, text in enumerate(docs)}
    assert [bool(want[d]) for d in range(6)] == [True, True, True, True, False, True]
    got = decontaminate.mark_contaminated(
        spark.createDataFrame(list(enumerate(f"{prose(70, 30)} {t} {prose(71, 30)}" for t in docs)), "doc_id long, text string"),
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {r["doc_id"]: set(r["items"]) for r in got} == want


def test_texts_shorter_than_an_item(spark):
    item = prose(54, 59)
    w = item.split()
    texts = [" ".join(w[:-1]), " ".join(w[1:]), " ".join(w[5:-6]), " ".join(w[5:-7]), " ".join(w[:30] + w[31:]), " ".join(w[:3]), "two", "two words"]
    got = decontaminate.find_passages(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
        spark.createDataFrame([(1, item), (2, "two words")], "item_id long, text string")).collect()
    found = {r["doc_id"]: [(p["item"], p["first"], p["words"], p["similarity"]) for p in r["passages"]] for r in got}
    want = {d: [(1, 0, len(t.split()), plain_similarity(t, item))] if plain_similarity(t, item) >= 0.8 else [] for d, t in enumerate(texts)}
    assert found == want | {7: [(2, 0, 2, 1.0)]} and [bool(want[d]) for d in range(6)] == [True, True, True, False, True, False]


def test_window_fingerprints_are_those_of_numbered_sets():
    s = np.random.default_rng(6).integers(0, 9, 60).astype(np.uint64)
    for m in (1, 7, 60):
        alone = np.concatenate([decontaminate.window_prints(s[a : a + m], m) for a in range(len(s) - m + 1)])
        shuffled = np.concatenate([decontaminate.window_prints(np.sort(s[a : a + m]), m) for a in range(len(s) - m + 1)])
        assert (decontaminate.window_prints(s, m) == alone).all() and (alone == shuffled).all()


def test_fingerprints_at_the_threshold_stay_inside_the_radius():
    """Pairs at 0.8 whose items share all shingles with others, or hold one shingle many times."""
    rng, missed = np.random.default_rng(7), 0
    for _ in range(300):
        common, left, right = rng.integers(0, 2**63, 80, dtype=np.uint64), *rng.integers(0, 2**63, (2, 10), dtype=np.uint64)
        right[:] = right[0]
        prints = [decontaminate.window_prints(np.concatenate([common, x]), 90) for x in (left, right)]
        missed += int(np.bitwise_count(prints[0] ^ prints[1]).sum() > decontaminate.RADIUS)
    assert missed <= 1


def test_hamming_index_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**63, (60, 2), dtype=np.uint64)
    bits = np.unpackbits(prints.view(np.uint8).reshape(60, -1), axis=1)
    queries = []
    for i in range(60):
        q = bits[i].copy()
        q[rng.permutation(128)[: i % 45]] ^= 1
        queries.append(np.packbits(q))
    queries = np.stack(queries).view(np.uint64)
    want = {(a, b) for a in range(60) for b in range(60) if np.bitwise_count(queries[a] ^ prints[b]).sum() <= decontaminate.RADIUS}
    got = {(int(a), int(b)) for w, i in decontaminate.Index(prints).near(queries) for a, b in zip(w, i, strict=True)}
    assert got == want


# ---- classifiers ------------------------------------------------------------------------------------------------

def test_language_of_odd_rows(edges, nothing):
    model = language.fit(edges)
    assert model.names == ["en"]
    got = {(r["doc_id"], r["text"]): r for r in language.identify(edges, model).collect()}
    for (_, text), r in got.items():
        letters = any(c.isalpha() for c in text or "")
        assert (r["nearest"] == "en") == letters and 0 <= r["score"] <= 1
        assert letters or r["lang_pred"] == "und"
    assert language.identify(nothing, model).count() == 0
    none = language.identify(edges, language.fit(nothing))
    assert none.filter("lang_pred != 'und' OR nearest IS NOT NULL").count() == 0


def test_long_text_counts_like_its_parts():
    text = prose(7, 300_000)
    whole = language.gram_counts([text, "abc"])
    chars = Counter(c for c in text.lower() if c.isalpha())
    assert len(text) > 1 << 20 and whole[0].sum() > 2 * sum(chars.values())
    single = language.gram_counts([c for c in chars])
    assert single.sum() == len(chars)


def test_language_far_from_all_is_rejected(spark):
    rows = [(i, prose(i, 60).replace("w", "the ").replace("x", "ing "), "en") for i in range(30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    far = spark.createDataFrame([(1, "ключ слово дело время жизнь день рука работа"), (2, rows[0][1])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(far, model).collect()}
    assert got[1]["rejected"] and got[1]["lang_pred"] == "und" and got[1]["nearest"] == "en"
    assert not got[2]["rejected"] and got[2]["lang_pred"] == "en"


def test_quality_of_odd_rows(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (3, 1), (9, 1), (11, 0), (12, 0), (14, 0), (14, None), (99, 1), (None, 1)], "doc_id long, quality int")
    vectors = quality.word_vectors(edges.select("text"))
    rows = quality.features(edges, vectors)
    model = quality.fit_on(rows, labels, F.lit(True))
    got = quality.with_scores(rows, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by_text = {}
    for r in quality.score_quality(edges, vectors, model).collect():
        assert by_text.setdefault(r["text"], r["score"]) == pytest.approx(r["score"], abs=1e-9)
    kept = quality.drop_rejected(edges, vectors, model)
    assert kept.columns == edges.columns and kept.filter("score = 's'").count() > 0
    none = quality.features(nothing, quality.word_vectors(nothing.select("text")))
    assert quality.with_scores(none, quality.fit_on(none, labels, F.lit(True))).count() == 0


def test_context_sums_equal_a_plain_count(spark):
    texts = ["the cat sat on the mat", "", None, "a", "the cat"]
    got = {r["word"]: (r["n"], [r[f"d{i}"] for i in range(quality.DIMS)]) for r in quality.context_sums(
        spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    index, want = quality.index_vectors(), {}
    for t in texts:
        runs = [w for _, w, _ in quality.token_runs([t])]
        own = runs[0].tolist() if runs else []
        for i, w in enumerate(own):
            n, v = want.get(w, (0, np.zeros(quality.DIMS, int)))
            near = [own[j] for j in range(max(0, i - 2), min(len(own), i + 3)) if j != i]
            want[w] = (n + 1, v + sum((index[x].astype(int) for x in near), np.zeros(quality.DIMS, int)))
    assert got == {k: (n, v.tolist()) for k, (n, v) in want.items()}


def test_toxicity_gradients_match_differences():
    rng = np.random.default_rng(6)
    p = toxicity.CHAR_NET.init(rng, 3, 4)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    x, mask, up = rng.normal(size=(5, 2, 3)), np.ones((5, 2)), rng.normal(size=(2, 8))
    mask[3:, 1] = 0
    tape = {}
    toxicity.CHAR_NET.forward(p, x, mask, tape)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    dx = toxicity.CHAR_NET.backward(p, tape, up, grads)
    loss = lambda: float((toxicity.CHAR_NET.forward(p, x, mask) * up).sum())
    for target, grad in [(x, dx), *[(p[k], grads[k]) for k in p]]:
        for at in [tuple(rng.integers(0, s) for s in target.shape) for _ in range(4)]:
            old, eps = target[at], 1e-3
            target[at] = old + eps
            high = loss()
            target[at] = old - eps
            low = loss()
            target[at] = old
            assert abs((high - low) / (2 * eps) - grad[at]) < 2e-3 + 2e-2 * abs(grad[at])


def test_windows_cover_every_word():
    for n in [0, 1, 31, 32, 33, 48, 49, 1000]:
        starts, _ = toxicity.window_starts([n])
        covered = set().union(*[range(s, s + toxicity.WINDOW) for s in starts.tolist()])
        assert set(range(n)) <= covered and (len(starts) == 1 or starts[-1] < n)


def test_toxicity_finds_one_word_anywhere(spark):
    bad = ["grumf", "Zortle!", "GRUMF,"]
    rows = [(i, prose(i, 90) if i % 2 else " ".join([prose(i, 60), bad[i % 3], prose(i + 500, 30)]), 1 - i % 2) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels, F.col("doc_id") % 3 > 0)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert sum(got[i] == y for i, _, y in held) >= 0.95 * len(held)
    far = spark.createDataFrame([(1, prose(77, 5000) + " grumf " + prose(78, 5000)), (2, prose(79, 5000)), (3, None), (4, "")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(far, model).collect()}
    assert scores[1] > 0.5 > scores[2] and scores[3] == scores[4] < 0.5


def test_toxicity_of_odd_rows(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 0), (9, None), (11, 1)], "doc_id long, toxic int")
    model = toxicity.fit_on(edges, labels, F.lit(True))
    scored = toxicity.score_toxicity(edges, model)
    assert scored.count() == len(ROWS) and scored.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.score_toxicity(nothing, toxicity.fit_on(nothing, labels.limit(0), F.lit(True))).count() == 0


def test_quality_sample_is_bounded_with_equal_texts(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 4 = 0 THEN 'some copy of a text' WHEN id % 4 = 1 THEN concat('text ', id) END AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    taken = []
    monkeypatch.setattr(quality, "fit", lambda x, y: taken.append((len(x), y.sum())))
    quality.fit_on(quality.features(docs, quality.word_vectors(docs.select("text"))), labels, F.lit(True), sample=400)
    assert 320 <= taken[0][0] <= 480 and 0.4 <= taken[0][1] / taken[0][0] <= 0.6


def test_thinned_links_lead_to_the_same_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(x) + 50 * g, int(y) + 50 * g) for g in range(4) for x, y in rng.integers(0, 40, (400, 2)) if x < y]
    links = spark.createDataFrame(pairs, "a long, b long")
    want = {i: i for p in pairs for i in p}
    for _ in want:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert near_dedup.thinned(links).count() < len(pairs)
    assert {r["id"]: r["component"] for r in near_dedup.components(links).collect()} == want
    leaders = [(a, b) for b in range(100, 2000) for a in (b % 7, 10 + b % 5, 20 + b % 3)]
    assert near_dedup.thinned(spark.createDataFrame(leaders, "a long, b long")).count() < 1900 + 100
