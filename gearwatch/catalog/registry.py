"""Registry, change-set, dashboard, call-metric and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch.catalog.base import query, r6, table
from gearwatch.functions import text as X, tiers
from gearwatch.operators import prefix, registry

AS_OF = "1998-06-15 12:00:00"


def machines(spark, d):
    """Registry rows: an order is a machine, its customer and nation describe it."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    day = F.to_date("o_orderdate")
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("machine_id"),
            F.concat(F.lit("SN-"), F.col("o_orderkey").cast("string")).alias("serial_number"),
            F.col("o_orderpriority").alias("model"),
            F.col("c_mktsegment").alias("manufacturer"),
            F.col("n_name").alias("location"),
            F.when(F.col("o_orderstatus") == "F", "Active").when(F.col("o_orderstatus") == "O", "Maintenance")
            .otherwise("Inactive").alias("status"),
            F.when(F.col("c_nationkey") < 12, "USD").otherwise("EUR").alias("currency"),
            F.col("o_totalprice").alias("price"),
            day.alias("purchase_date"),
            F.date_add(day, 90).alias("next_maintenance"),
            F.date_add(day, 30).alias("last_oil_date"),
            (F.col("o_custkey") % 180).cast("int").alias("oil_interval_days"),
        )
    )


REG = """reg AS (SELECT o_orderkey AS id, o_custkey AS machine_id, 'SN-' || o_orderkey AS serial_number, o_orderpriority AS model,
 c_mktsegment AS manufacturer, n_name AS location, CASE o_orderstatus WHEN 'F' THEN 'Active' WHEN 'O' THEN 'Maintenance' ELSE 'Inactive' END AS status,
 CASE WHEN c_nationkey < 12 THEN 'USD' ELSE 'EUR' END AS currency, o_totalprice AS price, CAST(o_orderdate AS DATE) AS purchase_date,
 CAST(o_orderdate AS DATE) + 90 AS next_maintenance, CAST(o_orderdate AS DATE) + 30 AS last_oil_date, CAST(o_custkey % 180 AS INT) AS oil_interval_days
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query("a9_upsert", """WITH ch AS (SELECT l_orderkey AS id, 'changed ' || l_linenumber AS note FROM lineitem
 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1),
 ch2 AS (SELECT id * 2 AS id, note FROM ch)
 SELECT id, note FROM ch2 UNION ALL SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT id FROM ch2)""")
def upsert(spark, d):
    target = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("note"))
    changes = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 2).alias("id"), F.concat(F.lit("changed "), F.col("l_linenumber").cast("string")).alias("note"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"))
    return registry.upsert(target, changes, "id", "seq")


@query("a9_problem_defaults", """SELECT CASE WHEN doc_id % 3 = 0 THEN 'doc' || doc_id ELSE 'problem_' || row_number() OVER (ORDER BY doc_id) END AS id,
 CASE WHEN lang = 'en' THEN source ELSE '' END AS title, n_chars FROM documents""")
def problem_defaults(spark, d):
    docs = table(spark, d, "documents").select(
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("id"),
        F.when(F.col("lang") == "en", F.col("source")).alias("title"), "n_chars", "doc_id")
    return registry.problem_defaults(docs, ["doc_id"]).select("id", "title", "n_chars")


@query("a10_registry_scan", f"WITH {REG} SELECT id, model, status FROM reg WHERE status = 'Active' AND model ILIKE '%urgent%' ORDER BY id LIMIT 200")
def registry_scan(spark, d):
    df = machines(spark, d).filter((F.col("status") == "Active") & F.col("model").ilike("%urgent%"))
    return df.select("id", "model", "status").orderBy("id").limit(200)


@query("a11_apply_changes", f"""WITH {REG},
 ch AS (SELECT l_orderkey + CASE WHEN l_linenumber > 6 THEN 100000000 ELSE 0 END AS id,
   CASE WHEN l_linenumber > 6 THEN 'insert' WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'delete' ELSE 'update' END AS op,
   row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS seq,
   CASE WHEN l_linestatus = 'F' THEN '' ELSE 'loc' || l_linenumber END AS location, CASE WHEN l_quantity > 25 THEN l_extendedprice END AS price FROM lineitem),
 d AS (SELECT id, max(CASE WHEN op = 'delete' THEN seq END) AS del FROM ch GROUP BY id),
 f AS (SELECT ch.id, bool_or(op = 'insert') AS ins, arg_max(nullif(location, ''), seq) FILTER (nullif(location, '') IS NOT NULL) AS location,
   arg_max(price, seq) FILTER (price IS NOT NULL) AS price FROM ch JOIN d USING (id) WHERE del IS NULL OR seq > del GROUP BY ch.id)
 SELECT reg.id, coalesce(f.location, reg.location) AS location, round(coalesce(f.price, reg.price), 6) AS price FROM reg LEFT JOIN d USING (id) LEFT JOIN f USING (id) WHERE d.del IS NULL
 UNION ALL SELECT f.id, f.location, round(f.price, 6) FROM f WHERE ins AND (f.id NOT IN (SELECT id FROM reg) OR (SELECT del FROM d WHERE d.id = f.id) IS NOT NULL)""")
def apply_changes(spark, d):
    target = machines(spark, d).select("id", "location", "price")
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("seq")
    new = F.col("l_linenumber") > 6
    changes = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") + F.when(new, 100000000).otherwise(0)).alias("id"),
        F.when(new, "insert").when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), "delete").otherwise("update").alias("op"),
        seq,
        F.when(F.col("l_linestatus") == "F", "").otherwise(F.concat(F.lit("loc"), F.col("l_linenumber").cast("string"))).alias("location"),
        F.when(F.col("l_quantity") > 25, F.col("l_extendedprice")).alias("price"))
    return r6(registry.apply_changes(target, changes))


@query("b5_filter_in", f"WITH {REG} SELECT id, status, location FROM reg WHERE status IN ('Active', 'Inactive') AND location IN ('FRANCE', 'GERMANY', 'NATION_3', 'NATION_7')")
def filter_in(spark, d):
    picked = tiers.filter_in(machines(spark, d), {
        "status": ["Active", "Inactive"], "location": ["FRANCE", "GERMANY", "NATION_3", "NATION_7"], "manufacturer": []})
    return picked.select("id", "status", "location")


@query("b6h_maintenance_urgency", f"""WITH {REG}, x AS (SELECT id, CAST(floor(date_diff('second', TIMESTAMP '{AS_OF}', CAST(next_maintenance AS TIMESTAMP)) / 86400.0) AS INT) AS days FROM reg)
 SELECT id, days, CASE WHEN days < 0 THEN 'Overdue' WHEN days <= 7 THEN 'Critical' WHEN days <= 30 THEN 'Soon' ELSE 'Scheduled' END AS urgency FROM x""")
def maintenance_urgency(spark, d):
    days = tiers.whole_days(F.col("next_maintenance").cast("timestamp"), F.lit(AS_OF).cast("timestamp"))
    df = machines(spark, d).select("id", days.alias("days"))
    return df.withColumn("urgency", tiers.maintenance_urgency(F.col("days")))


@query("h3_maintenance_timeline", f"""WITH {REG}, x AS (SELECT * FROM reg ORDER BY next_maintenance, id LIMIT 20)
 SELECT id, machine_id, status, CAST(floor(date_diff('second', TIMESTAMP '{AS_OF}', CAST(next_maintenance AS TIMESTAMP)) / 86400.0) AS INT) AS days_until, 'Overdue' AS urgency FROM x""")
def maintenance_timeline(spark, d):
    return registry.maintenance_timeline(machines(spark, d), AS_OF)


@query("b6i_d21_age_counts", f"""WITH {REG}, y AS (SELECT floor(date_diff('second', CAST(purchase_date AS TIMESTAMP), TIMESTAMP '{AS_OF}') / 86400.0) / 365.25 AS y FROM reg),
 b AS (SELECT CASE WHEN y <= 0 THEN NULL WHEN y <= 1 THEN '< 1 year' WHEN y <= 3 THEN '1-3 years' WHEN y <= 5 THEN '3-5 years' WHEN y <= 10 THEN '5-10 years' WHEN y <= 100 THEN '> 10 years' END AS age_bin FROM y)
 SELECT age_bin, count(*) AS n FROM b WHERE age_bin IS NOT NULL GROUP BY 1""")
def age_counts(spark, d):
    return registry.age_counts(machines(spark, d), AS_OF)


@query("b11_require", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def require(spark, d):
    return tiers.require(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_custkey"], ["c_acctbal"])


@query("d20_fleet_kpis", f"""WITH {REG} SELECT count(*) AS total, count(*) FILTER (status = 'Active') AS active,
 round(count(*) FILTER (status = 'Active') * 100.0 / count(*), 6) AS active_pct,
 count(*) FILTER (CAST(next_maintenance AS TIMESTAMP) <= TIMESTAMP '{AS_OF}' + INTERVAL 7 DAY) AS maintenance_due,
 count(*) FILTER (CAST(last_oil_date + oil_interval_days AS TIMESTAMP) <= TIMESTAMP '{AS_OF}' + INTERVAL 7 DAY) AS oil_due,
 round(CAST(sum(CAST(price AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total_value FROM reg""")
def fleet_kpis(spark, d):
    df = machines(spark, d).withColumn("price", F.col("price").cast("decimal(18,2)"))
    return r6(registry.fleet_kpis(df, AS_OF).withColumn("total_value", F.col("total_value").cast("double")))


@query("d20_value_by_currency", f"WITH {REG} SELECT currency, round(CAST(sum(CAST(price AS DECIMAL(18, 2))) AS DOUBLE), 2) AS total_value FROM reg GROUP BY currency")
def value_by_currency(spark, d):
    df = machines(spark, d).withColumn("price", F.col("price").cast("decimal(18,2)"))
    return r6(registry.value_by_currency(df).withColumn("total_value", F.col("total_value").cast("double")))


@query("d21_by_status", f"WITH {REG} SELECT status, count(*) AS n FROM reg GROUP BY 1")
def by_status(spark, d):
    return registry.counts_by(machines(spark, d), "status")


@query("d21_by_location", f"WITH {REG} SELECT location, count(*) AS n FROM reg GROUP BY 1")
def by_location(spark, d):
    return registry.counts_by(machines(spark, d), "location")


@query("d21_top_manufacturers", f"WITH {REG} SELECT manufacturer, count(*) AS n FROM reg GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top_manufacturers(spark, d):
    return registry.counts_by(machines(spark, d), "manufacturer", 10)


@query("d21_mean_price", f"WITH {REG} SELECT manufacturer, round(avg(price), 4) AS mean_price FROM reg WHERE price > 0 GROUP BY 1 ORDER BY avg(price) DESC, 1 LIMIT 10")
def mean_price(spark, d):
    return registry.mean_price_by(machines(spark, d)).withColumn("mean_price", F.round("mean_price", 4))


@query("d10_price_histogram", """WITH v AS (SELECT o_totalprice AS x FROM orders WHERE o_totalprice > 0), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
 SELECT least(CAST(floor((x - lo) / ((hi - lo) / 20)) AS INT), 19) AS bin, count(*) AS n FROM v, e GROUP BY 1""")
def price_histogram(spark, d):
    priced = tiers.require(machines(spark, d), [], ["price"])
    return prefix.histogram(priced, "price", 20).filter("n > 0").select("bin", "n")


@query("d35_filter_values", f"WITH {REG} SELECT DISTINCT 'status' AS column_name, status AS value FROM reg UNION ALL SELECT DISTINCT 'manufacturer', manufacturer FROM reg UNION ALL SELECT DISTINCT 'location', location FROM reg")
def filter_values(spark, d):
    return registry.filter_values(machines(spark, d), ["status", "manufacturer", "location"])


@query("d35_machine_label", f"WITH {REG} SELECT id, 'ID: ' || machine_id || ' - ' || model || ' (' || serial_number || ')' AS label FROM reg")
def machine_label(spark, d):
    return registry.machine_label(machines(spark, d))


def calls(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        F.col("event_type").alias("function"), F.col("value").alias("duration"), (k < 90).alias("success"),
        k.alias("tokens"), F.when(F.col("user_id") % 2 == 0, "claude-large").otherwise("small").alias("model"))


_CALLS = """calls AS (SELECT event_type AS function, value AS duration, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS tokens,
 CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) < 90 AS success, CASE WHEN user_id % 2 = 0 THEN 'claude-large' ELSE 'small' END AS model FROM events)"""


@query("d22_call_metrics", f"""WITH {_CALLS} SELECT function, count(*) AS count, round(avg(duration), 3) AS avg, round(min(duration), 3) AS min, round(max(duration), 3) AS max,
 round(sum(duration), 3) AS total, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS error_count FROM calls GROUP BY function""")
def call_metrics(spark, d):
    return registry.call_metrics(calls(spark, d))


@query("d22_call_costs", f"WITH {_CALLS} SELECT model, round(sum(tokens / 1000.0 * CASE WHEN model LIKE '%claude%' THEN 0.003 ELSE 0.001 END), 6) AS cost FROM calls GROUP BY model")
def call_costs(spark, d):
    return r6(registry.call_costs(calls(spark, d)))


@query("d22_call_summary", f"""WITH {_CALLS} SELECT count(*) AS total_function_calls, count(*) FILTER (NOT success) AS total_errors,
 round((count(*) - count(*) FILTER (NOT success)) * 100.0 / count(*), 1) AS success_rate, count(DISTINCT function) AS tracked_functions FROM calls""")
def call_summary(spark, d):
    return registry.call_summary(calls(spark, d))


def questions(spark, d):
    """Questions that name machines (from conversations) and bare place names (from nations)."""
    conv = table(spark, d, "conversations").filter("role = 'user'").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("question_id"),
        F.concat(F.lit("machine id #"), F.col("conv_id").cast("string"), F.lit(" "), F.col("text")).alias("text"))
    nation = table(spark, d, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("question_id"), F.col("n_name").alias("text"))
    return conv.unionByName(nation)


_IDS = r"""list_distinct(list_concat(list_concat(regexp_extract_all(lower(text), 'machine[\s\p{Z}]+(?:id[\s\p{Z}]+)?#?(\p{Nd}+)', 1), regexp_extract_all(lower(text), 'ماكينة[\s\p{Z}]+(?:رقم[\s\p{Z}]+)?(\p{Nd}+)', 1)),
 list_concat(regexp_extract_all(lower(text), '#(\p{Nd}+)', 1), regexp_extract_all(lower(text), '\b(\p{Nd}{3,})\b', 1))))"""
_FOREIGN = f"'{X.FOREIGN_IDS}'"
_SAFE = r"left(regexp_replace(text, '[^\p{L}\p{N}_\s\p{Z}\x{0600}-\x{06FF}-]', '', 'g'), 200)"
_QUESTIONS = f"""q AS (SELECT 'c' || conv_id || '-' || turn AS question_id, 'machine id #' || conv_id || ' ' || text AS text FROM conversations WHERE role = 'user'
 UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation)"""
_BRANCHES = f"""m AS (SELECT question_id, unnest({_IDS}) AS mid FROM q), s AS (SELECT question_id, trim({_SAFE}) AS safe FROM q),
 mm AS (SELECT DISTINCT mid FROM m),
 pm AS (SELECT mid, id, 1 AS branch FROM mm JOIN reg ON contains(CAST(machine_id AS VARCHAR), mid) QUALIFY row_number() OVER (PARTITION BY mid ORDER BY id) <= 3),
 ps AS (SELECT mid, id, 2 AS branch FROM mm JOIN reg ON contains(lower(serial_number), mid) QUALIFY row_number() OVER (PARTITION BY mid ORDER BY id) <= 3),
 b AS (SELECT question_id, id, 0 AS branch FROM m JOIN reg ON CAST(machine_id AS VARCHAR) = mid
   UNION ALL SELECT question_id, id, branch FROM m JOIN pm USING (mid) UNION ALL SELECT question_id, id, branch FROM m JOIN ps USING (mid) """ + " ".join(
    f"""UNION ALL SELECT question_id, id, {i} FROM (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY id) AS rn FROM s JOIN reg
   ON contains(lower(CAST({c} AS VARCHAR)), lower(safe)) WHERE length(safe) > 0) WHERE rn <= 5""" for i, c in enumerate(registry.KEYWORD_COLUMNS, 3)) + ")"


@query("c6_g1_registry_lookup", f"WITH {REG}, {_QUESTIONS}, {_BRANCHES} SELECT question_id, id, CAST(min(branch) AS INT) AS branch FROM b GROUP BY 1, 2")
def registry_lookup(spark, d):
    return registry.lookup(machines(spark, d), questions(spark, d))
