"""Source and sink queries: each writes the given tables in a format to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch import schemas as S
from gearwatch.catalog import detection as det
from gearwatch.catalog.base import TEL, errors, failures, machines, maint, query, table, telemetry
from gearwatch.operators import dataset, registry, report
from gearwatch.session import scratch_path
from gearwatch.sources import annotations as A, tables as IO


def _raw(spark, d):
    """The five raw tables in their canonical columns."""
    tel = telemetry(spark, d).select("datetime", F.col("machineID").cast("int").alias("machineID"), "volt", "rotate",
                                     (F.col("volt") / 2).alias("pressure"), (F.col("rotate") / 4).alias("vibration"))
    cast = F.col("machineID").cast("int").alias("machineID")
    return {
        "telemetry": tel,
        "errors": errors(spark, d).select("datetime", cast, "errorID"),
        "maint": maint(spark, d).select("datetime", cast, "comp"),
        "failures": failures(spark, d).select("datetime", cast, "failure"),
        "machines": machines(spark, d).select(cast, "model", F.col("age").cast("int").alias("age")),
    }


def _write_raw(spark, d, fmt):
    folder = scratch_path(spark, f"raw-{fmt}")
    for name, df in _raw(spark, d).items():
        out = df.withColumn("datetime", F.date_format("datetime", IO.TIMESTAMP_FORMAT)) if fmt == "csv" and "datetime" in df.columns else df
        writer = out.write.option("header", True) if fmt == "csv" else out.write
        writer.format(fmt).save(f"{folder}/{name}.{fmt}")
    return folder


@query("a1_load_csv", f"""WITH {TEL} SELECT CAST(machineID AS INT) AS "machineID", strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, volt, rotate, volt / 2 AS pressure, rotate / 4 AS vibration FROM tel""")
def load_csv(spark, d):
    loaded = IO.load_tables(spark, _write_raw(spark, d, "csv"), "csv")["telemetry"]
    return loaded.withColumn("t", F.date_format("datetime", IO.TIMESTAMP_FORMAT)).drop("datetime")


@query("a1_load_parquet", """SELECT CAST(user_id AS INT) AS "machineID", event_type AS "errorID" FROM events WHERE event_type IN ('error', 'view')""")
def load_parquet(spark, d):
    return IO.load_tables(spark, _write_raw(spark, d, "parquet"), "parquet")["errors"].drop("datetime")


@query("a2_expected_files", """SELECT name, complete FROM (VALUES ('events.parquet', true), ('orders.parquet', true), ('absent.parquet', false)) t(name, complete)""")
def expected_files(spark, d):
    return IO.expected_files(spark, d, ["events.parquet", "orders.parquet", "absent.parquet"]).select("name", "complete")


@query("a5_write_by_month", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice FROM orders")
def write_by_month(spark, d):
    path = scratch_path(spark, "by-month")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    IO.write_table(orders, path, ts="o_orderdate", order=["o_orderkey"])
    return spark.read.parquet(path).select("o_orderkey", F.col("month").cast("string").alias("month"), "o_totalprice")


def _problem_lines(spark, d):
    """Documents as JSON lines, with blank lines and broken lines between them."""
    docs = table(spark, d, "documents")
    good = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("raw_text"),
                              F.array("lang", "source").alias("solutions")))
    line = F.when(F.col("doc_id") % 10 == 3, "").when(F.col("doc_id") % 10 == 7, F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "title"'))).otherwise(good)
    path = scratch_path(spark, "problems")
    docs.select(line.alias("value")).write.text(path)
    return path


@query("a6_read_jsonl", "SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, lang AS first_solution, CAST(length(text) AS INT) AS chars FROM documents WHERE doc_id % 10 NOT IN (3, 7)")
def read_jsonl(spark, d):
    good, _ = IO.read_jsonl(spark, _problem_lines(spark, d))
    return good.select("id", "title", F.get("solutions", F.lit(0)).alias("first_solution"), F.length("raw_text").alias("chars"))


@query("a6_rejected_lines", """SELECT '{"id": ' || doc_id || ', "title"' AS line FROM documents WHERE doc_id % 10 = 7""")
def rejected_lines(spark, d):
    return IO.read_jsonl(spark, _problem_lines(spark, d))[1]


@query("a7_scoring_input", """SELECT CAST(user_id AS INT) AS "machineID", value AS volt, CASE WHEN event_type = 'error' THEN 'model1' ELSE event_type END AS model, CAST(18 AS INT) AS age FROM events""")
def scoring_input(spark, d):
    path = scratch_path(spark, "scoring")
    table(spark, d, "events").select(F.col("user_id").alias("machineID"), F.col("value").alias("volt"),
                                     F.when(F.col("event_type") != "error", F.col("event_type")).alias("model")).write.option("header", True).csv(path)
    return IO.read_scoring_input(spark, path)


@query("a8_write_chunks", """WITH t AS (SELECT count(*) AS total, count(*) FILTER (doc_id % 4 <> 0 AND length(text) > 0) AS ok FROM documents)
 SELECT CAST(doc_id AS INT) AS chunk_index, CASE WHEN lang = 'en' THEN source ELSE 'chunk_' || doc_id END AS source, round(ok * 100.0 / total, 6) AS success_pct FROM documents, t WHERE doc_id % 4 <> 0 AND length(text) > 0""")
def write_chunks(spark, d):
    path = scratch_path(spark, "chunks")
    rows = table(spark, d, "documents").select(
        F.col("doc_id").cast("int").alias("chunk_index"), F.col("text").alias("content"), F.when(F.col("lang") == "en", F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 4 != 0, F.array(F.col("n_chars").cast("float"))).alias("embedding"))
    counts = IO.write_chunks(rows, path)
    return spark.read.parquet(path).select("chunk_index", "source", F.round(F.lit(float(counts["success_pct"])), 6).alias("success_pct"))


@query("a10_registry_parquet", "SELECT o_orderkey AS id, o_orderpriority AS model FROM orders WHERE o_orderstatus = 'F'")
def registry_parquet(spark, d):
    path = scratch_path(spark, "registry")
    from gearwatch.catalog.registry import machines as rows

    given = rows(spark, d)
    have = {"id": F.col("id"), "machine_id": F.col("machine_id").cast("int"), "price": F.col("price").cast("decimal(18,2)")}
    full = [(have.get(f.name, F.col(f.name) if f.name in given.columns else F.lit(None))).cast(f.dataType).alias(f.name) for f in S.REGISTRY.fields]
    given.select(*full).write.parquet(path)
    return IO.read_registry(spark, path).filter("status = 'Active'").select("id", "model")


@query("a13_export_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS model FROM orders")
def export_csv(spark, d):
    path = scratch_path(spark, "export")
    IO.export_csv(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("model")), path)
    return spark.read.option("header", True).csv(path)


@query("a12_export_report", "SELECT event_id, value AS volt FROM events ORDER BY ts, event_id LIMIT 10000")
def export_report(spark, d):
    folder = scratch_path(spark, "report")
    tel = telemetry(spark, d)
    summary, data = report.export_tables(tel, ["datetime", "event_id"], report.dataset_card(tel))
    IO.export_report(summary, data.select("event_id", "volt"), folder)
    return spark.read.schema("event_id bigint, volt double").option("header", True).csv(f"{folder}/Data")


@query("a14_write_detections", f"""WITH {det.BOXES} SELECT CAST(image_id AS VARCHAR) AS "Image Name", CASE cls WHEN 0 THEN 'crack' WHEN 1 THEN 'dent' ELSE 'rust' END AS "Prediction", printf('%.2f', conf) AS "Confidence" FROM dt""")
def write_detections(spark, d):
    path = scratch_path(spark, "detections")
    A.write_detections(det.detections(spark, d), path, det.NAMES)
    return spark.read.option("header", True).csv(path)


@query("a15_read_label_files", f"""WITH {det.BOXES} SELECT CAST(cls AS VARCHAR) AS image_id, cls, count(*) AS n, round(sum((x1 + x2) / 2 / 200), 3) AS sx FROM bx GROUP BY cls""")
def read_label_files(spark, d):
    path = scratch_path(spark, "labels")
    b = det.base_boxes(spark, d)
    x, y, w, h = det._norm()
    text = F.concat_ws(" ", *[c.cast("string") for c in (F.col("cls"), x, y, w, h)])
    b.select(F.col("cls").alias("image"), text.alias("value")).write.partitionBy("image").text(path)
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"image=(\d+)", 1).alias("image_id"), "value")
    rows = A.labels_from_fields(A.parse_label_lines(lines))
    return rows.groupBy("image_id", "cls").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sx"))


@query("a16_write_labels", f"""WITH {det.BOXES} SELECT cls AS image_id, printf('%g %g %g %g %g', cls::DOUBLE, (x1 + x2) / 2 / 200, (y1 + y2) / 2 / 200, (x2 - x1) / 200, (y2 - y1) / 200) AS value FROM lb""")
def write_labels(spark, d):
    path = scratch_path(spark, "label-lines")
    A.write_labels(det.labels(spark, d).withColumn("image_id", F.col("cls")), path, F.lit(det.FRAME), F.lit(det.FRAME))
    return spark.read.text(path).select(F.col("image_id").cast("int").alias("image_id"), "value")


@query("a17_write_detection_json", f"WITH {det.BOXES} SELECT image_id, CASE cls WHEN 0 THEN 18 WHEN 1 THEN 19 ELSE 20 END AS category_id, round(conf, 5) AS score FROM dt")
def write_detection_json(spark, d):
    path = scratch_path(spark, "detection-json")
    dataset.to_detection_json(det.detections(spark, d), {0: 18, 1: 19, 2: 20}).write.json(path)
    return spark.read.schema("image_id bigint, category_id int, bbox array<double>, score double").json(path).drop("bbox")


@query("a18_list_from_file", "SELECT '/data/' || page_id || '.jpg' AS path FROM pages")
def list_from_file(spark, d):
    path = scratch_path(spark, "list")
    table(spark, d, "pages").select(F.concat(F.lit("./"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("value")).write.text(path)
    return A.list_from_file(spark, path, "/data")


@query("a20_read_history", "SELECT CAST(o_orderkey AS DOUBLE) AS epoch, round(o_totalprice, 2) AS loss FROM orders")
def read_history(spark, d):
    path = scratch_path(spark, "history")
    table(spark, d, "orders").select(F.format_string("%20d", F.col("o_orderkey")).alias("               epoch"),
                                     F.format_string("%20.2f", F.col("o_totalprice")).alias("                loss")).write.option("header", True).csv(path)
    return A.read_history(spark, path)


@query("a9_a11_upsert_twice", """WITH ch AS (SELECT p_partkey AS id, p_name AS note FROM part) SELECT id, note FROM ch UNION ALL
 SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT id FROM ch)""")
def upsert_twice(spark, d):
    target = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("note"))
    changes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("note"))
    return registry.upsert(registry.upsert(target, changes), changes)
