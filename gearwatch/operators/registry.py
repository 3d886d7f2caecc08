"""Machine registry: change sets, upserts, dashboards, call metrics, and keyword lookup for many questions at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gearwatch.functions import text as X, tiers
from gearwatch.operators.series import numbered
from gearwatch.session import materialise


def newest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the last row per key; a plain aggregate, so copies combine before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*").select(*df.columns)


def upsert(target: DataFrame, changes: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Changed rows replace target rows of the same key and new keys are added; the later change wins."""
    new = newest_by_key(changes, key, order) if order else changes
    new = new.select(*target.columns)
    return target.join(new, key, "left_anti").unionByName(new)


def problem_defaults(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Default id ``problem_<position>``, empty text and empty lists for missing fields."""
    placed = numbered(df, list(order))
    cols = {}
    for name, kind in df.dtypes:
        if name == "id":
            cols[name] = F.coalesce(F.nullif(F.col(name), F.lit("")), F.concat(F.lit("problem_"), F.col("_pos").cast("string")))
        elif kind == "string":
            cols[name] = F.coalesce(F.col(name), F.lit(""))
        elif kind.startswith("array"):
            cols[name] = F.coalesce(F.col(name), F.array().cast(kind))
    return placed.withColumns(cols).drop("_pos")


def _given(name: str, kind: str) -> Column:
    """A field of a change counts when it is neither null nor empty text."""
    return F.nullif(F.col(name), F.lit("")) if kind == "string" else F.col(name)


def apply_changes(target: DataFrame, changes: DataFrame, key: str = "id", op: str = "op", seq: str = "seq") -> DataFrame:
    """Apply insert / update / delete rows in ``seq`` order.

    Null and empty fields never overwrite. An update of an unknown id does nothing, a delete forgets everything
    before it. Changes fold per id in one aggregate; the target is joined once.
    """
    fields = [(c, t) for c, t in target.dtypes if c != key]
    last = lambda kind: F.max(F.when(F.col(op) == kind, F.col(seq)))
    newest = lambda c, t: F.max_by(F.struct(F.col(seq).alias("s"), _given(c, t).alias("v")), F.when(_given(c, t).isNotNull(), F.col(seq)))
    folded = changes.groupBy(key).agg(last("delete").alias("_del"), last("insert").alias("_at"), *[newest(c, t).alias(f"_n_{c}") for c, t in fields])
    live = lambda s: F.coalesce(s > F.col("_del"), s.isNotNull())
    plan = folded.select(key, "_del", live(F.col("_at")).alias("_ins"), *[
        F.when(live(F.col(f"_n_{c}.s")), F.col(f"_n_{c}.v")).alias(f"_n_{c}") for c, _ in fields])
    rows = target.withColumn("_old", F.lit(True)).join(plan, key, "full")
    wiped = F.col("_del").isNotNull()
    kept = (F.col("_old") & ~F.coalesce(wiped, F.lit(False))) | F.coalesce(F.col("_ins"), F.lit(False))
    merged = [F.coalesce(F.col(f"_n_{c}"), F.when(~F.coalesce(wiped, F.lit(False)), F.col(c))).alias(c) for c, _ in fields]
    return rows.filter(kept).select(key, *merged).select(*target.columns)


def fleet_kpis(df: DataFrame, as_of: str) -> DataFrame:
    """Totals, active share, maintenance and oil changes due within seven days, total value."""
    limit = F.lit(as_of).cast("timestamp") + F.expr("INTERVAL 7 DAYS")
    oil = F.date_add("last_oil_date", F.col("oil_interval_days")).cast("timestamp")
    active = F.count_if(F.col("status") == "Active")
    return df.agg(
        F.count("*").alias("total"),
        active.alias("active"),
        F.coalesce(F.try_divide(active * 100.0, F.count("*")), F.lit(0.0)).alias("active_pct"),
        F.count_if(F.col("next_maintenance").cast("timestamp") <= limit).alias("maintenance_due"),
        F.count_if(oil <= limit).alias("oil_due"),
        F.coalesce(F.sum("price"), F.lit(0)).alias("total_value"),
    )


def value_by_currency(df: DataFrame) -> DataFrame:
    """D20 option: total value per currency."""
    return df.groupBy("currency").agg(F.sum("price").alias("total_value"))


def maintenance_timeline(df: DataFrame, as_of: str, n: int = 20) -> DataFrame:
    """B6h + H3: the next n maintenance items by date with their urgency."""
    days = tiers.whole_days(F.col("next_maintenance").cast("timestamp"), F.lit(as_of).cast("timestamp"))
    known = tiers.require(df, ["machine_id", "next_maintenance", "status"])
    items = known.orderBy("next_maintenance", "id").limit(n).withColumn("days_until", days)
    return items.select("id", "machine_id", "status", "days_until", tiers.maintenance_urgency(F.col("days_until")).alias("urgency"))


def counts_by(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Machines per value of a column, largest first."""
    out = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), column).limit(top) if top else out


def mean_price_by(df: DataFrame, column: str = "manufacturer", top: int = 10) -> DataFrame:
    """Mean price per manufacturer over positive prices."""
    priced = tiers.require(df, [column], ["price"]).withColumn("price", F.col("price").cast("double"))
    return priced.groupBy(column).agg(F.avg("price").alias("mean_price")).orderBy(F.desc("mean_price"), column).limit(top)


def age_counts(df: DataFrame, as_of: str) -> DataFrame:
    """B6i + D21: machines per asset-age bin."""
    days = tiers.whole_days(F.lit(as_of).cast("timestamp"), F.col("purchase_date").cast("timestamp"))
    binned = tiers.require(df, ["purchase_date"]).withColumn("age_bin", tiers.asset_age(days / F.lit(365.25)))
    return binned.filter(F.col("age_bin").isNotNull()).groupBy("age_bin").agg(F.count("*").alias("n"))


def filter_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column as rows (column_name, value)."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot([], list(columns), "column_name", "value").filter("value IS NOT NULL").distinct()


def machine_label(df: DataFrame) -> DataFrame:
    """Display text of a machine."""
    label = F.format_string("ID: %s - %s (%s)", F.col("machine_id").cast("string"),
                            F.coalesce("model", F.lit("Unknown")), F.coalesce("serial_number", F.lit("N/A")))
    return df.select("id", label.alias("label"))


# Price per thousand tokens.
MODEL_RATES = {"claude": 0.003}
OTHER_RATE = 0.001


def call_metrics(calls: DataFrame) -> DataFrame:
    """Durations (three decimals), successes and errors per function."""
    r3 = [F.round(f(F.col("duration")), 3).alias(n) for n, f in
          (("avg", F.avg), ("min", F.min), ("max", F.max), ("total", F.sum))]
    return calls.groupBy("function").agg(
        F.count("*").alias("count"), *r3,
        F.count_if(F.col("success")).alias("success_count"), F.count_if(~F.col("success")).alias("error_count"),
    )


def call_costs(calls: DataFrame) -> DataFrame:
    """Cost per model from token counts."""
    rate = F.lit(OTHER_RATE)
    for part, price in MODEL_RATES.items():
        rate = F.when(F.contains(F.lower("model"), F.lit(part)), F.lit(price)).otherwise(rate)
    return calls.groupBy("model").agg(F.sum(F.col("tokens") / 1000 * rate).alias("cost"))


def call_summary(calls: DataFrame) -> DataFrame:
    """Calls, errors, success rate text and tracked functions."""
    rate = (F.count("*") - F.count_if(~F.col("success"))) * 100.0 / F.count("*")
    return calls.agg(
        F.count("*").alias("total_function_calls"),
        F.count_if(~F.col("success")).alias("total_errors"),
        F.when(F.count("*") > 0, F.round(rate, 1)).alias("success_rate"),
        F.count_distinct("function").alias("tracked_functions"),
    )


# Columns and limits of the lookup branches.
KEYWORD_COLUMNS = ["model", "manufacturer", "location", "machine_id", "serial_number"]
KEYWORD_LIMIT = 5
PARTIAL_LIMIT = 3
#: Longest piece of a text in the index of the lookup, and how many values of a column with the smallest ids are asked first.
GRAM, HEAD_VALUES = 8, 100_000


def _pieces(df: DataFrame, text: str, sizes: str, name: str) -> DataFrame:
    """A row per place of ``text`` and length in the array ``sizes`` with the piece there; a piece may repeat."""
    at = F.sequence(F.lit(1), F.length(text) - F.col("_n") + 1)
    cut = df.withColumn("_n", F.explode(sizes)).filter(F.col("_n") <= F.length(text)).withColumn("_at", F.explode(at))
    return cut.withColumn(name, F.substr(text, F.col("_at"), F.col("_n"))).drop("_n", "_at", sizes)


def _substring_hits(registry: DataFrame, columns: Sequence[str], needles: DataFrame, limit: int, head_values: int = HEAD_VALUES) -> DataFrame:
    """Registry ids whose column contains the needle (case-insensitive), ``limit`` smallest per needle with their rank.

    Works on distinct values: each keeps its ``limit`` smallest ids, which is all a needle can ever need from it. Values are cut
    into pieces as long as a needle, up to ``GRAM`` characters: a needle of that length is the piece. The ``head_values`` of a
    column with the smallest ids are asked first; a needle with ``limit`` hits there is done, and the others are looked for in the
    rest. A needle beyond ``GRAM`` meets the values that share its rarest piece, and ``contains`` confirms.
    """
    long = registry.select("id", *[F.lower(F.col(c).cast("string")).alias(c) for c in columns]).unpivot(
        ["id"], list(columns), "column_name", "value").filter("value <> ''")
    by_value = W.partitionBy("column_name", "value").orderBy("id")
    few = materialise(long.withColumn("_rn", F.row_number().over(by_value)).filter(F.col("_rn") <= limit), "lookup-ids")
    values = few.filter("_rn = 1").select("column_name", "value", F.col("id").alias("_first"))
    sizes = {r["column_name"]: r for r in values.groupBy("column_name").agg(F.count("*").alias("n"), F.max(F.length("value")).alias("widest")).collect()}
    size, widest = F.length("needle"), max((r["widest"] for r in sizes.values()), default=0)
    asked = materialise(needles.select("needle").filter("needle <> ''").distinct().filter(size <= widest), "lookup-needles")
    short, wide = asked.filter(size <= GRAM), asked.filter(size > GRAM)
    # The smallest ids of a needle lie in the values whose own smallest ids come first.
    early = W.partitionBy("needle", "column_name").orderBy("_first", "value")

    def first(found: DataFrame) -> DataFrame:
        return found.withColumn("_nth", F.row_number().over(early)).filter(F.col("_nth") <= limit).drop("_nth")

    # Values of a column up to ``cuts`` come before all others; columns with few values have no others.
    large = {c: head_values / r["n"] for c, r in sizes.items() if r["n"] > head_values}
    cuts = values.agg(*[F.percentile_approx(F.when(F.col("column_name") == c, F.col("_first")), p).alias(c) for c, p in large.items()]).first() if large else {}
    rest = F.lit(False)
    for c in large:
        rest |= (F.col("column_name") == c) & F.coalesce(F.col("_first") > F.lit(cuts[c]), F.lit(False))
    order = ["needle", "column_name", "_first", "value"]
    head = _pieces(values.filter(~rest).withColumn("_sizes", short.agg(F.collect_set(size)).scalar()), "value", "_sizes", "needle")
    found = [first(head.join(short, "needle").select(*order).distinct())]
    if large:
        found = [materialise(found[0], "lookup-head")]
        done = found[0].groupBy("needle", "column_name").agg(F.count("*").alias("n")).filter(F.col("n") >= limit).drop("n")
        both = short.withColumn("column_name", F.explode(F.array(*[F.lit(c) for c in large]))).join(done, ["needle", "column_name"], "left_anti")
        open_ = materialise(both, "lookup-open")
        lengths = open_.groupBy("column_name").agg(F.collect_set(size).alias("_sizes"))
        cut = _pieces(values.filter(rest).join(F.broadcast(lengths), "column_name"), "value", "_sizes", "needle")  # a row per column
        found.append(first(cut.join(open_, ["needle", "column_name"]).select(*order).distinct()))
        found = [first(found[0].unionByName(found[1]))]
    own = _pieces(wide.withColumn("_sizes", F.array(F.lit(GRAM))), "needle", "_sizes", "gram").distinct()
    grams = _pieces(values.withColumn("_sizes", wide.agg(F.collect_set(F.lit(GRAM))).scalar()), "value", "_sizes", "gram")
    postings = materialise(grams.join(own.select("gram").distinct(), "gram", "left_semi").distinct(), "lookup-index")
    often = postings.groupBy("gram").agg(F.count("*").alias("_often"))
    rarest = own.join(often, "gram", "left").groupBy("needle").agg(
        F.min_by("gram", F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "gram")).alias("gram"))
    found.append(first(rarest.join(postings, "gram").filter(F.contains("value", "needle"))).select(*order))
    hits = found[0].unionByName(found[1]).join(few, ["column_name", "value"]).select("needle", "column_name", "id")
    ranked = W.partitionBy("needle", "column_name").orderBy("id")
    return hits.withColumn("nth", F.row_number().over(ranked)).filter(F.col("nth") <= limit)


def lookup(registry: DataFrame, questions: DataFrame) -> DataFrame:
    """C6 + G1: registry rows for every question (question_id, text), as (question_id, id, branch).

    Branches in order: exact machine id, id contains (3), serial contains (3), then the whole sanitised question
    inside each of five columns (5 each). The first branch that finds an id keeps it. ``LIKE`` wildcards in the
    question are literal here, and limits take the smallest ids.
    """
    q = questions.select("question_id", X.machine_ids(F.col("text")).alias("mids"),
                         F.lower(X.strip(X.sanitise(F.col("text")))).alias("safe"))
    words = q.filter(F.length("safe") > 0).select("question_id", F.col("safe").alias("needle"), F.lit(False).alias("_id"))
    mids = q.select("question_id", F.explode("mids").alias("needle"), F.lit(True).alias("_id"))
    asked = materialise(mids.unionByName(words), "lookup-asked")
    exact = asked.filter("_id").join(registry.select("id", F.col("machine_id").cast("string").alias("needle")), "needle").select(
        "question_id", "id", F.lit(0).alias("branch"))
    hits = _substring_hits(registry, KEYWORD_COLUMNS, asked, max(KEYWORD_LIMIT, PARTIAL_LIMIT))
    place = F.array_position(F.array(*[F.lit(c) for c in KEYWORD_COLUMNS]), F.col("column_name")).cast("int")
    by_id = F.when(F.col("column_name") == "machine_id", 1).when(F.col("column_name") == "serial_number", 2)
    branch = F.when(F.col("_id"), F.when(F.col("nth") <= PARTIAL_LIMIT, by_id)).when(F.col("nth") <= KEYWORD_LIMIT, place + 2)
    near = asked.join(hits, "needle").select("question_id", "id", branch.alias("branch")).filter("branch IS NOT NULL")
    found = exact.unionByName(near)
    return found.groupBy("question_id", "id").agg(F.min("branch").alias("branch"))
