"""The layouts for hot keys, crowded groups and many queries give the same rows as the plain ones."""

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from gearwatch.catalog import detection as det, features, streaming as st
from gearwatch.catalog.base import SENSORS, errors, failures, maint, r6, scored, table, telemetry
from gearwatch.functions import boxes as B
from gearwatch.operators import asof, detection, prefix, prepare, retrieval, series, vectors
from gearwatch.streaming import jobs


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    a, b = a.select(cols), b.select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


KEY, ORDER = ["machineID"], ["datetime", "event_id"]


@pytest.fixture(scope="module")
def skewed(spark, sf):
    """Half of all readings belong to one machine, many of them at one instant."""
    tel = telemetry(spark, sf)
    hot = F.when(F.col("event_id") % 2 == 0, F.lit(1).cast("long")).otherwise(F.col("machineID"))
    tied = F.when(F.col("event_id") % 5 == 0, F.to_timestamp(F.lit("2024-01-10 00:00:00"))).otherwise(F.col("datetime"))
    return tel.withColumns({"machineID": hot, "datetime": tied}).persist()


def test_row_features(skewed):
    plain = series.sensor_features(skewed, SENSORS, KEY, ORDER, None)
    same(plain, series.sensor_features(skewed, SENSORS, KEY, ORDER, 37))


def test_history(spark, sf, skewed):
    def run(limit):
        return asof.add_history(skewed, errors(spark, sf), maint(spark, sf), failures(spark, sf), ["error", "view"], ["purchase", "click"], hot_rows=limit)

    same(run(None), run(37))


def test_feature_table(spark, sf):
    same(features.flagship(spark, sf, None), features.flagship(spark, sf, 20))


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof(spark, sf, skewed, direction):
    right = skewed.filter("volt > 30").select("machineID", "datetime", F.col("event_id").alias("r"))

    def run(limit):
        return asof.asof_join(skewed, right, "datetime", KEY, ["r"], direction, tiebreak=["r"], hot_rows=limit)

    same(run(None), run(41))


def test_fill_and_positions(skewed):
    holes = skewed.withColumn("rotate", F.when(F.col("rotate") > 80, F.col("rotate")))
    same(series.fill_gaps(holes, ["rotate"], 5, KEY, ORDER, None), series.fill_gaps(holes, ["rotate"], 5, KEY, ORDER, 29))
    same(series.row_positions(skewed, [], ORDER, hot_rows=None), series.row_positions(skewed, [], ORDER, hot_rows=50))


def test_prefix_sums(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.pow(F.col("id") % 977, F.lit(3))).alias("v"), F.lit(1).alias("n"))
    unique = rows.groupBy("g", "v").agg(F.sum("n").alias("n"))
    got = prefix.prefix_sums(unique, "v", ["n"], ["g"], rows=300)
    want = unique.withColumn("cum_n", F.sum("n").over(W.partitionBy("g").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    same(got.select("g", "v", "n", "cum_n"), want)
    assert {r[0] for r in got.filter("g = 1").select("all_n").collect()} == {1667}


def test_running_totals_keep_groups_without_a_name(spark):
    df = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, 3), ("a", 1.0, 5)], "g string, v double, n int")
    rows = {(r["g"], r["v"], r["cum_n"], r["all_n"]) for r in prefix.prefix_sums(df, "v", ["n"], ["g"], rows=1).collect()}
    assert rows == {(None, 1.0, 2, 5), (None, 2.0, 5, 5), ("a", 1.0, 5, 5)}
    assert prefix.prefix_sums(df.filter("n > 9"), "v", ["n"], ["g"]).collect() == []


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = [float(v) for v in np.where(rng.random(3000) < 0.4, 7.0, rng.normal(size=3000))]
    df = spark.createDataFrame([(v,) for v in data] + [(None,)], "x double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.937, "e": 1.0}
    row = prefix.quantiles(df, "x", probs).first()
    for name, p in probs.items():
        assert abs(row[name] - np.quantile(data, p)) < 1e-12


def best_by_key(labels, dets, keys, floor, strict=False, by_conf=False):
    """Every detection beside every label of its group."""
    left = labels.select(*keys, "label_id", F.col("cls").alias("l_cls"), *[F.col(c).alias(f"l_{c}") for c in detection.BOX])
    right = dets.withColumnsRenamed({c: f"d_{c}" for c in detection.BOX})
    pairs = right.join(left, keys, "left").withColumn("iou", B.iou(B.corners("l_"), B.corners("d_")))
    ok = F.col("iou") > floor if strict else F.col("iou") >= floor
    best = F.max_by(F.struct("label_id", "l_cls", "iou"), F.when(ok, F.struct(F.col("iou"), -F.col("label_id")))).alias("b")
    found = pairs.groupBy("image_id", "det_id").agg(best).select("image_id", "det_id", "b.*")
    return dets.join(found, ["image_id", "det_id"])


def test_copies_of_a_box_are_judged_alike_at_every_size(spark):
    """One label under two equal boxes: the smaller id wins, however many other boxes the image has."""
    for others in (200, 300):
        lb = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0)], "image_id long, label_id long, cls int, x1 double, y1 double, x2 double, y2 double")
        far = [(1, 10 + i, 0, 1000.0 + 20 * i, 0.0, 1010.0 + 20 * i, 10.0, 0.3) for i in range(others)]
        dt = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 2, 1, 0.0, 0.0, 10.0, 10.0, 0.9), *far],
                                   "image_id long, det_id long, cls int, x1 double, y1 double, x2 double, y2 double, conf double")
        got = {(r["predicted"], r["actual"]): r["n"] for r in detection.confusion(lb, dt).collect()}
        assert got == {(0, 0): 1, (1, None): 1, (0, None): others}


def test_crowded_images_use_the_grid(spark, sf, monkeypatch):
    lb, dt = det.labels(spark, sf), det.detections(spark, sf)
    one = F.lit(1).cast("long")
    lb, dt = lb.withColumn("image_id", one), dt.withColumn("image_id", one)
    lb = lb.groupBy("image_id", "label_id").agg(*[F.first(c).alias(c) for c in ("cls", *detection.BOX)])
    dt = dt.groupBy("image_id", "det_id").agg(*[F.first(c).alias(c) for c in ("cls", *detection.BOX, "conf")])
    lb, dt = lb.filter("label_id % 3 = 0").persist(), dt.filter("det_id % 3 = 0").persist()
    grid = detection.match(lb, dt)
    matrix = detection.confusion(lb, dt)
    with monkeypatch.context() as m:
        m.setattr(detection, "best_labels", best_by_key)
        same(grid, detection.match(lb, dt))
        same(matrix, detection.confusion(lb, dt))


def test_nearest_in_blocks(spark, sf, monkeypatch):
    e = table(spark, sf, "embeddings")
    corpus, asked = e.withColumnRenamed("vec_id", "chunk_id"), e.withColumnRenamed("vec_id", "question_id")
    plain = retrieval.nearest(corpus, asked, 4).persist()
    with monkeypatch.context() as m:
        m.setattr(vectors, "GROUP_ROWS", 100)
        m.setattr(vectors, "STEP_ROWS", 16)
        same(plain, retrieval.nearest(corpus, asked, 4))
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in e.collect()}
    m = np.array(list(v.values()))
    for q in list(v)[:20]:
        cos = np.round(m @ v[q] / np.linalg.norm(m, axis=1) / np.linalg.norm(v[q]), 9)
        want = [list(v)[j] for j in np.lexsort((list(v), -cos))[:4]]
        assert [r["chunk_id"] for r in plain.filter(F.col("question_id") == q).orderBy("rank").collect()] == want


def test_search_plan_reads_the_corpus_once_and_sends_nothing_to_the_driver(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = e.withColumnRenamed("vec_id", "question_id").withColumn("question_id", F.explode(F.array("question_id", F.col("question_id") + 10**6)))
    text = retrieval.nearest(e.withColumnRenamed("vec_id", "chunk_id"), asked, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") == 2 and "LocalRelation" not in text and "Join" not in text


def test_nearest_keeps_ties_by_id(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3000)], "chunk_id int, embedding array<float>").repartition(7)
    asked = spark.createDataFrame([(1, [2.0, 0.0])], "question_id int, embedding array<float>")
    assert [r["chunk_id"] for r in retrieval.nearest(corpus, asked, 4).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_neighbours_and_oversample(spark, sf, monkeypatch):
    df = scored(spark, sf)
    out = prepare.oversample(df, SENSORS, "event_id").persist()
    sizes = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert sizes[0] == sizes[1]
    box = df.filter("y = 1").agg(F.min("volt"), F.max("volt")).first()
    made = out.filter("synthetic").agg(F.min("volt"), F.max("volt")).first()
    assert box[0] <= made[0] and made[1] <= box[1]
    same(out, prepare.oversample(df.repartition(5), SENSORS, "event_id"))
    with monkeypatch.context() as m:
        m.setattr(vectors, "GROUP_ROWS", 50)
        near = prepare.neighbours(df, SENSORS, "event_id", 3)
        assert near.filter("neighbour = event_id").count() == 0
        assert near.select("event_id").distinct().count() == df.count()


def test_neighbours_are_exact_at_every_size(spark, sf, monkeypatch):
    df = scored(spark, sf).filter("event_id % 2 = 0")
    rows = df.select("event_id", *SENSORS).collect()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    gap = np.round(np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(2)), 9)
    np.fill_diagonal(gap, np.inf)
    want = {(int(ids[i]), r + 1, int(ids[j])) for i in range(len(ids)) for r, j in enumerate(np.lexsort((ids, gap[i]))[:4])}
    for block in (50, 10_000):
        monkeypatch.setattr(vectors, "GROUP_ROWS", block)
        assert {tuple(r) for r in prepare.neighbours(df, SENSORS, "event_id", 4).collect()} == want


@pytest.fixture(scope="module")
def crowd(spark):
    """1500 vectors around 30 centres and 500 equal ones, a null id and a null vector; every fiftieth id asks."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    m = np.concatenate([centres[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, 16)), np.repeat(centres[:1], 500, 0)])
    rows = [(i, v) for i, v in enumerate(m.tolist())] + [(None, m[0].tolist()), (5000, None)]
    return spark.createDataFrame(rows, "id long, v array<double>").persist(), m


def test_projection_index_finds_the_neighbours(crowd):
    corpus, m = crowd
    asked = corpus.filter("id % 50 = 0").withColumnRenamed("id", "q")
    index = vectors.fit_index(corpus, bits=6)
    assert index.probes < 32  # neighbours that are near need few of the 64 buckets
    found = vectors.index_search(index, corpus, asked, 10)
    exact = vectors.search(corpus, asked, 10)
    got = vectors.recall(found, exact).first()
    assert (got["queries"], got["neighbours"]) == (40, 400) and got["recall"] >= 0.9
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for r in found.collect():
        assert abs(r["score"] - unit[r["q"]] @ unit[r["id"]]) < 1e-8 and r["rank"] <= 10


def test_projection_index_of_all_buckets_is_exact(crowd):
    corpus, _ = crowd
    asked = corpus.filter("id % 50 = 0").withColumnRenamed("id", "q")
    index = vectors.ProjectionIndex(16, 3, 2, probes=8)
    same(vectors.index_search(index, corpus, asked, 7, 0.2, True), vectors.search(corpus, asked, 7, 0.2, exclude_self=True))


def test_crowded_buckets_are_cut(crowd, monkeypatch):
    corpus, _ = crowd
    asked = corpus.filter("id % 50 = 0").withColumnRenamed("id", "q")
    index = vectors.fit_index(corpus, bits=4)
    whole = vectors.index_search(index, corpus, asked, 10)
    monkeypatch.setattr(vectors, "BUCKET_ROWS", 60)
    monkeypatch.setattr(vectors, "GROUP_ROWS", 7)
    same(whole, vectors.index_search(index, corpus, asked, 10))


def test_projection_index_of_nothing(crowd):
    corpus, _ = crowd
    none = corpus.filter("id < 0")
    asked = corpus.filter("id = 0").withColumnRenamed("id", "q")
    assert vectors.index_search(vectors.fit_index(none), none, asked, 3).collect() == []
    assert vectors.index_search(vectors.fit_index(corpus), corpus, asked.filter("q > 0"), 3).collect() == []


def test_time_features_of_a_busy_machine(skewed):
    wide = series.time_features(skewed, ["volt"], [3, 24], KEY, bucket_hours=24 * 400)
    cut = series.time_features(skewed, ["volt"], [3, 24], KEY, bucket_hours=48)
    r = lambda df: df.select("event_id", *[F.round(c, 6).alias(c) for c in df.columns if c.startswith("volt_tm") or c.startswith("volt_ts")])
    same(r(wide), r(cut))


def test_rate_limit_by_hand(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    calls = [(i, "k", t0 + timedelta(milliseconds=30 * i)) for i in range(31)] + [(31, "k", t0 + timedelta(seconds=61))]
    df = spark.createDataFrame(calls, "n int, key string, datetime timestamp")
    verdicts = [r["allowed"] for r in jobs.rate_limit(df, tie=["n"]).orderBy("n").collect()]
    assert verdicts == [True] * 30 + [False, True]
    assert st is not None


def test_search_copies_the_corpus_for_large_groups_only(spark, monkeypatch):
    """5000 queries of two numbers are one group, so the corpus is dealt once and stays in single precision."""
    def received(*_):
        def count(frames):
            for f in frames:
                rows = f[f["side"] == 1]
                assert all(v.dtype == np.float32 for v in rows["v"])
                yield f.iloc[:0][["q", "id"]].reindex(range(len(rows))).assign(q=rows["id"].to_numpy(), id=0, score=1.0)
        return count

    corpus = spark.range(50).select("id", F.array(F.lit(1.0).cast("float"), F.col("id").cast("float")).alias("v"))
    asked = spark.range(5000).select(F.col("id").alias("q"), F.array(F.lit(1.0).cast("float"), F.col("id").cast("float")).alias("v"))
    monkeypatch.setattr(vectors, "_comparer", received)
    assert vectors.search(corpus, asked, 10**6).count() == 50


def test_search_in_blocks(spark, monkeypatch):
    """Small blocks and frequent merges give the rows of one block; repeated, null and zero vectors included."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-2, 3, (150, 3)))] + [(200, None), (201, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    for metric, floor in (("cosine", 0.3), ("euclid", None)):
        with monkeypatch.context() as m:
            whole = vectors.search(df, df.withColumnRenamed("id", "q"), 4, floor, metric, True, tasks=1).collect()
            for name, value in (("BLOCK_ROWS", 7), ("PENDING_ROWS", 1), ("STEP_ROWS", 5), ("GROUP_BYTES", 24 * 40)):
                m.setattr(vectors, name, value)
            assert sorted(vectors.search(df, df.withColumnRenamed("id", "q"), 4, floor, metric, True).collect()) == sorted(whole)


@pytest.mark.parametrize("values", [3, 40])
def test_strips_find_all_neighbours(spark, monkeypatch, values):
    """Rows in strips have the neighbours that all pairs give, with many equal values, repeated points, nulls and short strips."""
    rng = np.random.default_rng(values)
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.integers(0, values, (160, 2)) / 4)] + [(900, None), (901, [None, 1.0]), (902, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    monkeypatch.setattr(vectors, "STRIP_ROWS", 9)
    same(prepare.near_rows(df, 4, 2), prepare.near_rows(df, 4))


def crowd_of_boxes(spark, n, images, seed):
    rng = np.random.default_rng(seed)
    xy, wh = rng.integers(0, 40, (n, 2)), rng.integers(0, 30, (n, 2))
    rows = [(int(rng.integers(images)) if i % 50 else None, i, int(rng.integers(3)), *[float(v) for v in (*xy[i], *(xy[i] + wh[i]))], float(rng.integers(1, 20)) / 20)
            for i in range(n)]
    return spark.createDataFrame(rows + rows[:20], "image_id long, det_id long, cls int, x1 double, y1 double, x2 double, y2 double, conf double")


@pytest.mark.parametrize("limit", [0, 45])
def test_crowded_and_calm_images_agree(spark, monkeypatch, limit):
    """Without the grid, with the grid for some images, and with it for all: the same matches, also for repeated rows and null images."""
    dets = crowd_of_boxes(spark, 300, 6, 1)
    labels = crowd_of_boxes(spark, 250, 6, 2).withColumnRenamed("det_id", "label_id").drop("conf")
    scored = dets.withColumnRenamed("det_id", "pred_id").filter("image_id IS NOT NULL").dropDuplicates()
    runs = [lambda: detection.match(labels, dets), lambda: detection.confusion(labels, dets), lambda: detection.iou_pairs(labels, dets, ["image_id"], 0.4),
            lambda: detection.suppress(scored), lambda: detection.suppress(scored, merge=True, agnostic=True)]
    for run in runs:
        with monkeypatch.context() as m:
            m.setattr(detection, "CROWD_ROWS", 10**9)
            calm = r6(run()).persist()
            m.setattr(detection, "CROWD_ROWS", limit)
            same(calm, r6(run()))


def test_boxes_with_nulls(spark):
    """A detection without an id takes no label, and boxes without an image or a corner are not kept."""
    nothing = crowd_of_boxes(spark, 40, 2, 5).filter("image_id = 0 AND x2 > x1 AND y2 > y1").dropDuplicates()
    dets = nothing.withColumn("det_id", F.when(F.col("det_id") % 2 == 0, F.col("det_id")))
    labels = nothing.withColumnRenamed("det_id", "label_id").drop("conf")
    hits = detection.match(labels, dets)
    assert hits.filter("det_id IS NULL AND tp0 = 1").count() == 0 and hits.filter("tp0 = 1").count() > 0
    scored = nothing.withColumnRenamed("det_id", "pred_id")
    odd = scored.withColumn("image_id", F.lit(None).cast("long")).unionByName(scored.withColumns({"y1": F.lit(None).cast("double"), "y2": F.lit(None).cast("double")}))
    assert detection.suppress(odd).count() == 0


def test_images_are_dealt_once(spark):
    """Labels and detections go through one exchange each; every later step finds its rows there."""
    import contextlib
    import io
    dets, labels = crowd_of_boxes(spark, 60, 6, 1), crowd_of_boxes(spark, 50, 6, 2).withColumnRenamed("det_id", "label_id").drop("conf")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as text:
            detection.match(labels, dets).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.getvalue().count("Exchange hashpartitioning") == 2


def test_masks_in_slices(spark, monkeypatch):
    """Masks of one group compared in full, in slices, and reduced to the best label, against NumPy."""
    rng = np.random.default_rng(4)
    masks = rng.integers(0, 2, (90, 12))
    masks[5], masks[17] = 0, masks[3]
    rows = [(1, i, [int(v) for v in m]) for i, m in enumerate(masks)] + [(1, 90, [1, None] * 6), (2, 91, [1] * 12), (None, 92, [1] * 12), (1, 93, [1] * 5), (1, 94, None)]
    df = spark.createDataFrame(rows, "image_id long, id long, mask array<tinyint>")
    labels, dets = df.withColumnRenamed("id", "label_id"), df.withColumnRenamed("id", "det_id").withColumn("conf", F.lit(0.5))
    inter = masks @ masks.T
    iou = inter / (masks.sum(1)[:, None] + masks.sum(1) - inter + B.EPS)
    want = {(i, j, round(iou[i, j], 9)) for i in range(90) for j in range(90) if iou[i, j] >= 0.5}
    want |= {(i, i, round(n / (n + B.EPS), 9)) for i, n in ((91, 12), (93, 5))}
    best = {}
    for i, j, v in sorted(want):
        if j not in best or v > best[j][1]:
            best[j] = (i, v)
    for rows_, step in ((4096, 1024), (13, 7)):
        monkeypatch.setattr(detection, "MASK_ROWS", rows_)
        monkeypatch.setattr(detection, "MASK_STEP", step)
        got = detection.mask_pairs(labels, dets, ["image_id"])
        assert {(r["l_label_id"], r["d_det_id"], round(r["iou"], 9)) for r in got.collect()} == want and "d_conf" in got.columns
        few = detection.mask_pairs(labels, dets, ["image_id"], best=True).collect()
        top = {}
        for r in sorted(few, key=lambda r: r["l_label_id"]):
            if r["d_det_id"] not in top or round(r["iou"], 9) > top[r["d_det_id"]][1]:
                top[r["d_det_id"]] = (r["l_label_id"], round(r["iou"], 9))
        assert top == best and (rows_ < 90 or len(few) == len(best))


@pytest.mark.parametrize("head_values", [100_000, 7])
def test_lookup_index_holds_only_what_is_asked(spark, monkeypatch, head_values):
    from gearwatch.operators import registry

    rows = [(i, str(i * 37 % 400), f"SN-{i * 7919 % 100_000}-Site {i % 11}") for i in range(300)] + [(7, "12", "SN-12-Site 3")]
    table = spark.createDataFrame(rows, "id long, machine_id string, serial_number string")
    asked = ["1", "12", "79", "791", "site 3", "-site 10", "9-site 10", "n-7919-site 1", "no such number anywhere", "-", "400", ""]
    written, write = {}, registry.materialise
    monkeypatch.setattr(registry, "materialise", lambda df, name: written.setdefault(name, write(df, name)))
    needles = spark.createDataFrame([(a,) for a in asked + asked], "needle string")
    got = registry._substring_hits(table, ["machine_id", "serial_number"], needles, 3, head_values)
    want = []
    for a in filter(None, asked):
        for k, c in ((1, "machine_id"), (2, "serial_number")):
            ids = sorted(r[0] for r in rows if a in r[k].lower())[:3]
            want += [(a, c, i, n) for n, i in enumerate(ids, 1)]
    assert sorted(tuple(r) for r in got.select("needle", "column_name", "id", "nth").collect()) == sorted(want)
    assert written["lookup-index"].count() < 300  # a row per value and piece before


@pytest.mark.parametrize("scale", [1.0, 1e-25, 1e18])
def test_groups_of_queries_meet_the_corpus_without_shuffling_vectors(spark, monkeypatch, scale):
    """Wide vectors with copies, an outlier, nulls and repeated ids: blocks are stored once, and the neighbours are those of all pairs."""
    rng = np.random.default_rng(11)
    m = rng.normal(size=(160, 12)) * scale
    m[40:60], m[60] = m[20], m[60] * 1e6
    rows = [(i, v) for i, v in enumerate(m.tolist())] + [(7, m[90].tolist()), (900, None), (901, [None, *m[0, 1:].tolist()]), (902, [float("nan")] * 12)]
    corpus = spark.createDataFrame(rows, "id long, v array<double>")
    asked = corpus.filter("id <> 7").withColumnRenamed("id", "q")
    for name, value in (("GROUP_ROWS", 40), ("STORED_BYTES", 96 * 30), ("STEP_ROWS", 16), ("BLOCK_ROWS", 8), ("PENDING_ROWS", 1), ("EXACT_ROWS", 9)):
        monkeypatch.setattr(vectors, name, value)
    found = vectors.search(corpus, asked, 4, metric="euclid", exclude_self=True)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "RepartitionByExpression" not in plan and "REPARTITION" not in plan
    ids, all_v = np.array([*range(160), 7]), np.concatenate([m, m[90:91]])
    want = set()
    for i in {*range(160)} - {7}:
        far = np.round(np.linalg.norm(all_v - m[i], axis=1), 9)
        far[ids == i] = np.inf
        want |= {(i, int(ids[j]), r + 1) for r, j in enumerate(np.lexsort((ids, far))[:4])}
    assert {(r["q"], r["id"], r["rank"]) for r in found.collect()} == want
