"""Scores of the three classifiers against plain loops, and labels whose rows are copies of few texts."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gearwatch.llm import language, quality, toxicity
from tests.llm.conftest import prose

MASK = (1 << 64) - 1


def texts_of(n):
    return [prose(i, 40 + i % 30, 300 if i % 2 else 90) + (" schön größe über" if i % 3 else " the and of") for i in range(n)]


def plain_grams(text):
    """Hashed n-gram counts of one text, character by character."""
    chars = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    out = Counter()
    for n in language.ORDERS:
        for i in range(len(chars) - n + 1):
            gram = chars[i : i + n]
            if gram.count(" ") > (n > 1):
                continue
            code = n
            for j, c in enumerate(gram):
                code = (code + ord(c)) * int(language.FACTORS[j]) & MASK
            code ^= code >> 29
            out[(code * int(language.FACTORS[0]) & MASK) >> 51] += 1
    return out


def test_language_scores(spark):
    texts = texts_of(60)
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    counts = [plain_grams(t) for t in texts]
    seen = Counter(c for own in counts for c in own)
    for i, own in enumerate(counts[:10]):
        vector = {c: math.log1p(k) * (1 + math.log((1 + len(texts)) / (1 + seen[c]))) for c, k in own.items()}
        size = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v / size * float(centre[c]) for c, v in vector.items()) for centre in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        name, score, _ = (x[0] for x in model.predict([texts[i]]))
        assert name == model.names[model.owner[best]] and abs(score - cosines[best]) < 1e-5


def test_language_is_learned_from_copies(spark):
    rare, common = texts_of(8), [f"{prose(900 + i, 30)} the" for i in range(600)]
    rows = [(i, rare[i % 8], "de") for i in range(16_000)] + [(20_000 + i, t, "en") for i, t in enumerate(common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.names == ["de", "en"]
    got = language.identify(docs.filter("doc_id < 8"), model).collect()
    assert {r["nearest"] for r in got} == {"de"}


def test_marks_that_look_like_letters_or_numbers(spark):
    docs = spark.createDataFrame([(1, "½ ²"), (2, "Ⅳ ①"), (3, "🙂👍"), (4, "abc"), (5, "日本")], "doc_id long, text string")
    model = language.fit(spark.createDataFrame([("abc def", "en")], "text string, lang string"))
    got = {r["doc_id"]: r["nearest"] for r in language.identify(docs, model).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "en", 5: "en"}


def plain_gru(p, name, inputs, back):
    hidden = p[f"{name}.u"].shape[0]
    h, out = np.zeros(hidden), [None] * len(inputs)
    for t in reversed(range(len(inputs))) if back else range(len(inputs)):
        x = inputs[t] @ p[f"{name}.w"] + p[f"{name}.b"]
        rec = h @ p[f"{name}.u"][:, : 2 * hidden]
        z = 1 / (1 + np.exp(-(x[:hidden] + rec[:hidden])))
        r = 1 / (1 + np.exp(-(x[hidden : 2 * hidden] + rec[hidden:])))
        n = np.tanh(x[2 * hidden :] + (r * h) @ p[f"{name}.u"][:, 2 * hidden :])
        h = (1 - z) * h + z * n
        out[t] = h
    return out


def plain_pool(p, name, inputs):
    states = [np.concatenate(pair) for pair in zip(plain_gru(p, f"{name}.f", inputs, False), plain_gru(p, f"{name}.g", inputs, True))]
    e = np.array([float(s @ p[f"{name}.a"][:, 0]) for s in states])
    w = np.exp(e - e.max())
    return sum(a * s for a, s in zip(w / w.sum(), states))


def plain_toxicity(model, text):
    p, logits = model.params, []
    words = toxicity.split_words(text) or [b""]
    vectors = []
    for word in words:
        pooled = []
        grid, _ = toxicity.pieces([word])
        for piece in grid:
            k = int((piece > 0).sum())
            cells = {n: toxicity.gram_cells(piece[None, :], n)[0] for n in toxicity.GRAMS}
            rows = [np.concatenate([p["letters"][piece[t]], [model.gram_odds[n][cells[n][t]] if cells[n][t] >= 0 else 0 for n in toxicity.GRAMS]])
                    for t in range(k)]
            pooled.append(plain_pool(p, "char", rows))
        bucket = toxicity.fnv([word])[0]
        vectors.append(np.concatenate([np.max(pooled, 0), p["words"][bucket], [model.word_odds[bucket]]]))
    for start in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        logits.append(float(plain_pool(p, "word", vectors[start : start + toxicity.WINDOW]) @ p["out.w"] + p["out.b"][0]))
    return 1 / (1 + math.exp(-max(logits) / model.temperature))


def test_toxicity_scores():
    texts = [t + (" vilestword" if i % 4 == 0 else "") for i, t in enumerate(texts_of(60))]
    model = toxicity.fit(texts, np.array([i % 4 == 0 for i in range(60)]))
    probes = [*texts[:6], "one", "", "pneumonoultramicroscopicsilicovolcanoconiosis vilestword", prose(5, 100)]
    np.testing.assert_allclose(model.score(probes), [plain_toxicity(model, t) for t in probes], atol=2e-4)


def test_toxicity_is_learned_from_copies(spark):
    bad = [f"{t} vilestword kill" for t in texts_of(8)]
    rows = [(i, bad[i % 8]) for i in range(16_000)] + [(20_000 + i, prose(700 + i, 40)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 20_000).cast("int").alias("toxic"))
    got = toxicity.score_toxicity(docs, toxicity.fit_on(docs, labels, F.lit(True))).groupBy((F.col("doc_id") < 20_000).alias("bad")).agg(
        F.avg("predicted").alias("share")).collect()
    share = {r["bad"]: r["share"] for r in got}
    assert share[True] > 0.9 and share[False] < 0.1
    one = spark.createDataFrame([(i, "only this") for i in range(3000)] + [(5000 + i, prose(i, 40)) for i in range(300)], "doc_id long, text string")
    marks = one.select("doc_id", (F.col("doc_id") < 5000).cast("int").alias("toxic"))
    got = toxicity.score_toxicity(one, toxicity.fit_on(one, marks, F.lit(True))).groupBy("predicted").count().collect()
    assert {r["predicted"]: r["count"] for r in got}.get(1, 0) >= 2900


def test_quality_scores(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts_of(30))], "doc_id long, text string")
    vectors = quality.word_vectors(docs.select("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    stored = quality.fit_on(quality.features(docs, vectors), labels, F.lit(True))
    model = quality.fit_sampled(docs, vectors, labels, F.lit(True))
    for name, value in stored.params.items():
        np.testing.assert_array_equal(value, model.params[name])
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, vectors, model).collect()}
    for i, text in enumerate(texts_of(30)[:8]):
        words = [vectors[w] for _, word, _ in quality.token_runs([text]) for w in word]
        mean = [sum(float(w[d]) for w in words) / len(words) for d in range(quality.DIMS)]
        dev = [math.sqrt(max(0.0, sum(float(w[d]) ** 2 for w in words) / len(words) - mean[d] ** 2)) for d in range(quality.DIMS)]
        x = [(v - m) / s for v, m, s in zip(mean + dev, model.mean, model.scale, strict=True)]
        hidden = [max(0.0, sum(x[a] * model.params["w1"][a, b] for a in range(len(x))) + model.params["b1"][b]) for b in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, model.params["w2"], strict=True)) + model.params["b2"][0]
        assert abs(got[i] - 1 / (1 + math.exp(-logit / model.temperature))) < 1e-4
    kept = quality.drop_rejected(docs.withColumn("extra", F.lit("x")), vectors, model)
    assert kept.columns == ["doc_id", "text", "extra"] and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}
