"""Merkle manifest, embedding whitening and the byte-pair automaton against plain versions."""

import hashlib
import random
import string
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gearwatch.llm import bpe_automaton, merkle, whitening
from gearwatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 16 * 16
        out.append((level[start:i], level[i + 1 : start + 16]))
        i //= 16
    return out


def plain_manifest(rows, tampered):
    """rows: dicts in the columns of documents; what op11 returns for each, as a list of tuples."""
    leaf = lambda r: sha(*[framed(r[c]) for c in merkle.COLUMNS])
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf(tampered(r)), r["doc_id"]))
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda x: x[:3])
        trees[k] = plain_levels([x[2] for x in groups[k]])
    top = plain_levels([trees[k][-1][0] for k in keys])
    out = []
    for t, k in enumerate(keys):
        for i, (_, _, own, shown, doc) in enumerate(groups[k]):
            path = plain_path(trees[k], i) + plain_path(top, t)
            node = shown
            for left, right in path:
                node = sha(*left, node, *right)
            proof = sha(*[d for left, right in path for d in left + right])
            out.append((doc, own, trees[k][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def lowered(r):
    if r["text"] is None or r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5:
        return r
    return r | {"text": r["text"].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))}


def by_text(rows):
    return sorted(rows, key=str)


def presented():
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                  F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    return {"text": text}


def as_rows(df):
    got = df.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("p"), "folded_root", "verified")
    return [tuple(r) for r in got.collect()]


def test_manifest_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").astype(object).where(lambda d: d.notna(), None)
    got = [tuple(r) for r in QUERIES["op11_merkle"](spark, SF).collect()]
    assert by_text(got) == by_text(plain_manifest(docs.to_dict("records"), lowered))
    assert 0 < sum(not r[-1] for r in got) < len(got) / 5


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [256], [257], [300, 1, 17], [4100, 5], [1] * 40])
def test_manifest_of_any_shape(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [{"doc_id": rng.randrange(10**6), "source": f"s{k}" if k else None, "lang": None, "n_chars": i, "text": f"Text {i}"}
            for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert by_text(as_rows(merkle.prove(docs, presented=presented()))) == by_text(plain_manifest(rows, lowered))


def test_manifest_of_edge_rows(spark, edges, nothing):
    rows = [{c: r[c] for c in merkle.COLUMNS} for r in edges.collect()]
    assert by_text(as_rows(merkle.prove(edges, presented=presented()))) == by_text(plain_manifest(rows, lowered))
    assert merkle.prove(nothing).count() == 0


def test_log_addresses():
    """The closed form against a log that is written node by node."""
    for m in (1, 2, 15, 16, 17, 31, 200, 255, 256):
        height = 0 if m == 1 else 1 if m <= 16 else 2
        log, pending = [], [0] * 3
        for i in range(m):
            log.append((0, i))
            for h in range(1, height + 1):
                if (i + 1) % 16**h == 0 or i == m - 1:
                    log.append((h, pending[h]))
                    pending[h] += 1
        for place, (h, j) in enumerate(log):
            last = min((j + 1) * 16**h, m) - 1
            assert place == last + last // 16 + last // 256 + h


def plain_whitening(vectors):
    """ids -> (deviation, coordinates) with numpy's own eigenvectors."""
    x = {k: [int(np.floor(256 * float(c))) for c in v] for k, v in vectors.items()}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit, float) - np.array([s / n for s in sums])
    cov = y.T @ y / n
    e, p = np.linalg.eigh(cov)
    e, p = e[::-1][:4], p[:, ::-1][:, :4]
    out = {k: (sum((n * c - s) ** 2 for c, s in zip(v, sums)), (np.array(v) - np.array([s / n for s in sums])) @ p / np.sqrt(e)) for k, v in x.items()}
    return n, e / np.trace(cov), out


def test_whitening_query(spark):
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    n, share, want = plain_whitening(dict(zip(table["vec_id"], table["embedding"])))
    got = QUERIES["op12_whitening"](spark, SF).toPandas()
    assert len(got) == 4 * len(table) and (got["n"] == n).all()
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    for k, part in got.groupby("component"):
        part = part.sort_values("vec_id")
        np.testing.assert_allclose(part["explained"], share[k - 1], rtol=1e-9)
        assert part["deviation"].tolist() == [want[i][0] for i in part["vec_id"]]
        mine, plain = part["whitened"].to_numpy(), np.array([want[i][1][k - 1] for i in part["vec_id"]])
        np.testing.assert_allclose(mine * np.sign(mine @ plain), plain, atol=1e-7)


@pytest.mark.parametrize("case", ["random", "equal", "split", "rank", "diagonal", "one", "near", "wide"])
def test_leading_eigen(case):
    rng = np.random.default_rng(3)
    d = 64
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    spectrum = {"random": rng.uniform(1, 9, d), "equal": np.r_[5, 5, 5, 5, np.ones(d - 4)], "rank": np.r_[7, 3, np.zeros(d - 2)],
                "near": 3 + 1e-9 * np.arange(d), "wide": 10.0 ** np.linspace(6, -6, d)}.get(case)
    if case == "diagonal":
        a = np.diag([1.0, 4, 4, 2, 0, 9])
    elif case == "split":
        a = np.kron(np.eye(4), np.array([[2.0, 1], [1, 2]]))
    elif case == "one":
        a = np.array([[3.0]])
    else:
        a = (q * spectrum) @ q.T
        a = (a + a.T) / 2
    values, vectors = whitening.leading_eigen(a, 4)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][: len(values)]
    assert len(values) == (2 if case == "rank" else min(4, len(a)))
    np.testing.assert_allclose(values, want, rtol=1e-12, atol=1e-13 * want[0])
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    np.testing.assert_allclose(a @ vectors, vectors * values, atol=1e-11 * np.abs(a).max())


def test_sturm_counts():
    rng = np.random.default_rng(4)
    d, e = rng.normal(size=30), rng.normal(size=29)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    at = rng.uniform(-4, 4, 50)
    assert whitening.sturm_count(d, e, at).tolist() == [int((np.linalg.eigvalsh(t) < x).sum()) for x in at]


def test_whitening_of_odd_rows(spark):
    rng = random.Random(9)
    good = {i: [rng.uniform(-2, 2) for _ in range(3)] for i in range(40)}
    rows = [(i, v, "x") for i, v in good.items()] + [(0, good[0], "again"), (100, None, ""), (101, [1.0, None, 2.0], ""),
            (102, [1.0, float("nan"), 0.0], ""), (103, [float("inf"), 0.0, 0.0], ""), (104, [], ""), (105, [1.0, 2.0], ""), (None, good[1], "")]
    schema = "vec_id long, embedding array<double>, whitened string"
    table = spark.createDataFrame(rows, schema).repartition(4)
    got = whitening.whiten(table).toPandas()
    n, share, want = plain_whitening(good)
    assert len(got) == 3 * 42 and got["n"].eq(n).all() and got["identity_error"].max() < 1e-9
    known = got[got["vec_id"].notna()]
    assert known["deviation"].tolist() == [want[int(i)][0] for i in known["vec_id"]]
    assert whitening.whiten(table.limit(0)).count() == 0
    alone = spark.createDataFrame(rows[:1] + rows[40:41], schema)
    assert whitening.whiten(alone).count() == 0
    huge = spark.createDataFrame([(1, [1e12, 0.0], ""), (2, [-1e12, 3.0], "")], schema)
    far = whitening.whiten(huge).toPandas()
    assert far["component"].tolist() == [1, 1] and far["deviation"].isna().all() and far["identity_error"].max() < 1e-9


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_bpe_query(spark, library):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = QUERIES["op13_bpe"](spark, SF).toPandas().sort_values("doc_id")
    want = []
    for i, t in sorted(zip(docs["doc_id"], docs["text"])):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert list(got.itertuples(index=False, name=None)) == want


def test_bpe_of_odd_texts(library):
    codec, rng = bpe_automaton.Codec(PATH), random.Random(12)
    letters = "aaaeeehinot'' \t\n\r\x0b\x1c\x85\xa0.!_-09é́½²ΣσςİßŒ日本語🙂‍<|>©Ⅳ"
    texts = ["", " ", "<|endoftext|>", "a <|startoftext|>b<|endoftext|>", "aaa aaaa aaaaa hahahaha", "o" * 3000, "don't 'tis 're!'s"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(t)
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def plain_merges(word, merges):
    rank, parts = {m: i for i, m in enumerate(merges)}, list(word)
    while True:
        pairs = [(rank.get(p, len(rank)), i) for i, p in enumerate(zip(parts, parts[1:]))]
        if not pairs or min(pairs)[0] == len(rank):
            return parts
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_small_automata():
    """Random merge lists over two letters: each word has one path, and it is what merging gives."""
    rng = random.Random(5)
    for _ in range(60):
        tokens, merges = ["a", "b"], []
        while len(merges) < 9:
            pair = (rng.choice(tokens), rng.choice(tokens))
            if "".join(pair) not in tokens:
                merges.append(pair)
                tokens.append("".join(pair))
        automaton = bpe_automaton.Automaton({t: i for i, t in enumerate(tokens)}, merges)
        reader = bpe_automaton.Reader(automaton, "", places=30)
        for _ in range(60):
            word = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))
            path = reader.read(word)
            assert [tokens[t] for t in path] == plain_merges(word, merges)
            state, ways = 0, []

            def walk(state, at, so_far):
                if at == len(word):
                    ways.append(so_far)
                for t, label in enumerate(tokens):
                    if word.startswith(label, at) and automaton.follows(state, t):
                        walk(automaton.behind[t], at + len(label), [*so_far, t])

            walk(state, 0, [])
            assert ways == [path]


def test_bpe_of_edge_rows(spark, edges, nothing, library):
    rows = bpe_automaton.decode(bpe_automaton.encode(edges, PATH), PATH)
    for r in rows.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert set(edges.columns) - {"ids"} <= set(rows.columns)
    assert bpe_automaton.encode(nothing, PATH).count() == 0
    both = bpe_automaton.round_trip(edges, PATH)
    assert set(both.columns) == set(edges.columns) - {"text"} | {"n_tokens", "numbers", "decoded"}
    want = [(r["n_tokens"], " ".join(map(str, np.frombuffer(r["ids"], "<u4"))), r["decoded"]) for r in rows.collect()]
    assert sorted(tuple(r) for r in both.select("n_tokens", "numbers", "decoded").collect()) == sorted(want)
    with pytest.raises(ValueError, match="vocabulary"):
        bpe_automaton.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError, match="merge 0"):
        bpe_automaton.Automaton({"a": 0, "ab": 1, "b": 2, "abb": 3}, [("ab", "b"), ("a", "b")])
