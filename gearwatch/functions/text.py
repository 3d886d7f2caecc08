"""Text expressions: chunking, counts, language, greetings, ids, sanitising, composition. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Patterns and limits.
ARABIC = r"[؀-ۿ]"
ARABIC_SHARE = 0.3
GREETINGS = [
    r"^\s*(ازيك|إزيك|ازاى|إزاى|ايه|أيه|يا|هاى|سلام|مرحبا|صباح|مساء)\s*",
    r"^\s*(اخبارك|أخبارك|عامل|حالك)\s*",
    r"^\s*(hi|hello|hey|yo|sup|greetings|morning|evening)\s*",
    r"^\s*(how are you|whats up|what's up)\s*",
]
MACHINE_IDS = [r"machine\s+(?:id\s+)?#?(\d+)", r"ماكينة\s+(?:رقم\s+)?(\d+)", r"#(\d+)", r"\b(\d{3,})\b"]
UNICODE = "(?U)"  # digits, white space and word edges of every script
# A text with digits and spaces of other scripts, for trying the patterns.
FOREIGN_IDS = " ماكينة رقم ٥٦ machine id\u00a077"
QUERY_LIMIT = 200
EDGE_SPACE = r"^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$"
UNSAFE = r"[^\p{L}\p{N}_\s\p{Z}؀-ۿ-]"


def strip(text: Column) -> Column:
    """Remove every kind of white space at both ends (plain trim removes blanks only)."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def chunk_count(length: Column, size: int, overlap: int) -> Column:
    """Number of chunks of a text of the given length."""
    step = size - overlap
    return (
        F.when(length == 0, 0)
        .when(length <= size, 1)
        .otherwise(F.ceil((length - size) / F.lit(step)) + 1)
        .cast("int")
    )


def chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Array of stripped chunks of ``size`` characters that share ``overlap`` characters; empty text gives none."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    n = chunk_count(F.length(text), size, overlap)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: strip(F.substring(text, i * (size - overlap) + 1, F.lit(size))))


def explode_chunks(df: DataFrame, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """One row per chunk with its index."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(chunks(F.col(text), size, overlap)).alias("chunk_index", "content"))


def word_count(text: Column) -> Column:
    """Words separated by white space."""
    s = strip(text)
    return F.when(F.length(s) == 0, 0).otherwise(F.size(F.split(s, r"[\s\p{Z}]+")))


def char_count(text: Column) -> Column:
    """T2."""
    return F.length(text)


def compose_problem(title: Column, summary: Column, description: Column, solutions: Column) -> Column:
    """Text to embed for a problem record; empty parts are left out."""
    first = F.array_join(F.slice(solutions, 1, 3), " | ")
    solution = F.when(F.size(F.coalesce(solutions, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Solution: "), first))
    parts = [F.nullif(c, F.lit("")) for c in (title, summary, description)]
    return F.concat_ws(" \n ", *parts, solution)


def language(text: Column) -> Column:
    """Ar when more than 30 % of the characters are Arabic, else en."""
    share = F.regexp_count(text, F.lit(ARABIC)) / F.greatest(F.length(text), F.lit(1))
    return F.when(share > ARABIC_SHARE, "ar").otherwise("en")


def is_greeting(text: Column) -> Column:
    """Starts with a greeting (a prefix test, so a longer word that starts like one also counts)."""
    low = strip(F.lower(text))
    hit = low.rlike(GREETINGS[0])
    for pattern in GREETINGS[1:]:
        hit = hit | low.rlike(pattern)
    return hit


def machine_ids(text: Column) -> Column:
    """Distinct ids named in the text, digits only, sorted."""
    low = F.lower(text)
    found = F.concat(*[F.regexp_extract_all(low, F.lit(UNICODE + p), 1) for p in MACHINE_IDS])
    return F.array_sort(F.array_distinct(found))


def sanitise(text: Column) -> Column:
    """Keep letters, digits, underscore, white space, Arabic and hyphen; at most 200 characters."""
    return F.left(F.regexp_replace(text, UNSAFE, ""), F.lit(QUERY_LIMIT))


def cache_key(text: Column) -> Column:
    """Hash used to recognise a repeated query."""
    return F.md5(text)


def register_sql(spark: SparkSession) -> None:
    """Make the text expressions callable from SQL as temporary functions.

    ``chunk_text(text, size, overlap)`` and ``text_language(text)`` give values; ``chunk_rows(text, size, overlap)`` is a table
    function for ``LATERAL``, one row per chunk.
    """
    n = "CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= s THEN 1 ELSE CAST(ceil((length(t) - s) / (s - o)) AS INT) + 1 END"
    trim = "'" + EDGE_SPACE.replace("\\", "\\\\") + "'"
    cut = (f"CASE WHEN length(t) = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE transform(sequence(0, {n} - 1), "
           f"i -> regexp_replace(substring(t, i * (s - o) + 1, s), {trim}, '')) END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION chunk_text(t STRING, s INT, o INT) RETURNS ARRAY<STRING> RETURN {cut}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION chunk_rows(t STRING, s INT, o INT) RETURNS TABLE(chunk_index INT, content STRING) "
        f"RETURN SELECT posexplode({cut}) AS (chunk_index, content)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION text_language(t STRING) RETURNS STRING RETURN "
        r"CASE WHEN regexp_count(t, '[\\u0600-\\u06FF]') / greatest(length(t), 1) > 0.3 THEN 'ar' ELSE 'en' END"
    )
