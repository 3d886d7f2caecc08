"""The registered queries against their SQL, brute force or held-out labels, and the pipeline stage by stage."""

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gearwatch.llm import near_dedup
from gearwatch.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect
from tests.llm.conftest import SCHEMA, edge_rows
from tests.llm.test_operators import WORD, least_capacity, plain_components

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def table():
    return {n: pd.read_parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "benchmark")}


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_language(spark, table):
    got = QUERIES["op1_language"](spark, SF).toPandas().merge(table["documents"], on="doc_id")
    assert len(got) == len(table["documents"])
    assert (got["held_out"] == [fold(i, 5) == 0 for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and set(got["lang_pred"]) <= {*table["documents"]["lang"], "und"}
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() >= 0.97


@pytest.mark.parametrize(("name", "label", "n", "rest", "least"), [("op2_quality", "quality", 3, 1, 0.97), ("op6_toxicity", "toxic", 5, 0, 0.9)])
def test_classifiers(spark, table, name, label, n, rest, least):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) == len(table["documents"]) and got["score"].between(0, 1).all()
    assert (got["held_out"] == [fold(i, n) == rest for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    held = got[got["held_out"]].merge(table["labels"], on="doc_id")
    assert (held["predicted"] == held[label]).mean() >= least


def test_shards(spark, table):
    got = QUERIES["op3_shards"](spark, SF).toPandas()
    docs = table["documents"].assign(size=table["documents"]["text"].str.encode("utf-8").str.len() + 8)
    groups = docs.groupby("text").agg(first=("doc_id", "min"), size=("size", "sum")).sort_values("first")
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == len(docs) and sizes.max() == least_capacity(groups["size"].tolist(), 24)
    assert (got.merge(docs[["doc_id", "text"]], on="doc_id").groupby("text")["shard"].nunique() == 1).all()


def test_packing_and_token_files(spark, table, tokenizer):
    docs = table["documents"].sort_values("doc_id")
    ids = {i: e.ids for i, e in zip(docs["doc_id"], tokenizer.encode_batch(docs["text"].tolist(), add_special_tokens=False), strict=True)}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    files = QUERIES["op7_token_files"](spark, SF).toPandas().sort_values("doc_id")
    start = 0
    for row in files.itertuples():
        own = [*ids[row.doc_id], 2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(own), crc(own))
        start += len(own)
    pieces = QUERIES["op5_packing"](spark, SF).toPandas()
    for row in pieces.itertuples():
        own = [*ids[row.doc_id], 1]
        assert row.doc_tokens == len(own) and row.ids_crc32 == crc(own[row.start : row.start + row.length])
    assert pieces["length"].sum() == sum(len(x) + 1 for x in ids.values())
    ordered = pieces.sort_values(["sequence_id", "offset"])
    place = ordered["sequence_id"] * 2048 + ordered["offset"]
    assert (place.to_numpy() == np.r_[0, ordered["length"].cumsum().to_numpy()[:-1]]).all()
    assert ((ordered["offset"] + ordered["length"]) <= 2048).all()


def test_decontamination(spark, table):
    """Word shingles are enough here: passages in the tables are whole items, whose windows then are equal to them."""
    got = QUERIES["op4_decontamination"](spark, SF).toPandas().set_index("doc_id")
    cut = lambda t: " ".join(WORD.findall(t.lower()))
    items = {i: f" {cut(t)} " for i, t in zip(table["benchmark"]["item_id"], table["benchmark"]["text"], strict=True)}
    for row in table["documents"].itertuples():
        text = f" {cut(row.text)} "
        whole = {i for i, t in items.items() if t in text}
        assert whole <= set(got.loc[row.doc_id, "items"])
        five = {tuple(w[s : s + 5]) for w in [text.split()] for s in range(len(w) - 4)}
        for i in got.loc[row.doc_id, "items"]:
            own = items[i].split()
            grams = {tuple(own[s : s + 5]) for s in range(len(own) - 4)}
            assert len(grams & five) >= 0.8 * len(grams)
    assert got["contaminated"].sum() > 0


def test_pipeline_stages(spark, table, tokenizer, tmp_path):
    """Each stage on what the one before it kept, against a plain version."""
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == list(table["documents"].columns)
    before = table["documents"].merge(table["labels"], on="doc_id")
    stays = before["doc_id"].isin(kept["quality"]["doc_id"])
    assert (stays == (before["quality"] == 1)).mean() > 0.97
    norm = kept["quality"]["text"].str.replace(r"[\x20\x09-\x0D]", "", regex=True)
    assert len(kept["exact_dedup"]) == norm.nunique()
    rows = list(zip(kept["exact_dedup"]["doc_id"], kept["exact_dedup"]["text"], strict=True))
    marks = near_dedup.mark_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    plain = plain_components_by_index(rows, 5)
    assert {r["doc_id"]: r["component_id"] for r in marks} == plain
    assert sorted(kept["near_dedup"]["doc_id"]) == sorted({*plain.values()})
    cut = lambda t: " ".join(WORD.findall(t.lower()))
    items = [f" {cut(t)} " for t in table["benchmark"]["text"]]
    dirty = {r.doc_id for r in kept["near_dedup"].itertuples() if any(t in f" {cut(r.text)} " for t in items)}
    gone = {*kept["near_dedup"]["doc_id"]} - {*kept["decontamination"]["doc_id"]}
    assert dirty <= gone and len(gone) <= len(dirty) + 3
    ids = [len(e.ids) + 1 for e in tokenizer.encode_batch(kept["decontamination"]["text"].tolist(), add_special_tokens=False)]
    assert kept["packing"]["length"].sum() == sum(ids)
    assert kept["packing"]["sequence_id"].max() == (sum(ids) - 1) // 2048


def plain_components_by_index(rows, k):
    """Links between rows that share a shingle, compared in full."""
    sets, where = {}, {}
    for i, t in rows:
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        for g in sets[i]:
            where.setdefault(g, []).append(i)
    both = Counter((a, b) for own in where.values() for a in own for b in own if a < b)
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {i: root(i) for i in sets}


def test_pipeline_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    for rows in (docs, docs.limit(0)):
        held = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            held = stage(spark, held, SF)
            assert held.columns == rows.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() >= rows.count()
        assert held.filter(F.col("kept") == "k").count() == held.filter("kept IS NOT NULL").count()


def test_run_has_the_rows_of_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and got.groupBy("sequence_id", "offset").count().filter("count > 1").count() == 0


def test_plain_versions_agree():
    rows = [(i, t) for i, t in {r[0]: r[1] for r in edge_rows()}.items() if i is not None]
    assert {r[0]: r[2] for r in plain_components(rows, 5)} == plain_components_by_index([(i, t or "") for i, t in rows], 5)
