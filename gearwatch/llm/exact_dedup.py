"""Exact duplicates: texts that are equal without white space, combined so that no hot group meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from gearwatch.llm.common import SALTS, SPACE, free_names, set_aside, without_clashes

OUTPUTS = ("keep_id", "group_size", "kept", "text_sha256")
#: More than any shifted 64-bit id; text length times this plus the shifted id orders rows in one number.
SHIFT = "100000000000000000000"
LARGEST = "9223372036854775807"


def mark_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                          salts: int = SALTS) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of its group.

    Rows are equal when their texts are identical without white space. The row with the most code points stays, then
    the one with the smallest id. Three steps compare the full content: each task combines its own rows, the rows of
    one (digest, salt) are merged, and the winners of the salts are combined for each (digest, content). Rows then
    look up their winner by digest, salt and a second fingerprint; should two contents ever agree in all of these,
    the job stops with an error and merges nothing.

    A null text counts as empty; all empty texts are one group. A null id comes after every other id of its length.
    Of rows that repeat an id inside a group, one is kept. An empty table gives an empty result. Columns of ``docs``
    with the name of a result column are replaced.
    """
    docs = without_clashes(docs, OUTPUTS, (id_column, text_column))
    norm, digest, salt, check, size, rank, other, n, turn = free_names(
        docs, "_norm", "_digest", "_salt", "_check", "_size", "_rank", "_other", "_n", "_turn")
    text, row_id = F.coalesce(F.col(text_column), F.lit("")), F.col(id_column).cast("long")
    rows = docs.withColumn(norm, F.regexp_replace(text, f"{SPACE}+", "")).withColumns({
        digest: F.sha2(F.col(norm), 256),
        salt: F.pmod(F.xxhash64(F.col(id_column)), F.lit(salts)).cast("int"),
        check: F.xxhash64(F.col(norm)),
        size: F.char_length(text),
    })
    shifted = F.coalesce(F.expr(f"{LARGEST}BD") - row_id.cast("decimal(20,0)"), F.expr("-1BD")) + F.expr("1BD")
    ranked = rows.select(digest, norm, salt, check, (
        F.col(size).cast("decimal(10,0)") * F.expr(f"{SHIFT}BD") + shifted).cast("decimal(38,0)").alias(rank))

    merged = ranked.groupBy(digest, norm, salt, check).agg(F.max(rank).alias(rank), F.count(F.lit(1)).alias(n))
    merged = merged.repartition(digest)  # one exchange for both windows; a digest has at most one row per salt here
    same = W.partitionBy(digest, norm)
    clash = F.max(norm).over(W.partitionBy(digest, check)) != F.min(norm).over(W.partitionBy(digest, check))
    winners = merged.select(
        digest, salt, check,
        F.max(rank).over(same).alias(rank), F.sum(n).over(same).alias(n), clash.alias(other),
    )
    winners = winners.withColumn(n, F.when(F.col(other), F.raise_error(F.lit("two contents with one digest")).cast("long"))
                                 .otherwise(F.col(n))).drop(other)
    place = F.col(rank) % F.expr(f"{SHIFT}BD") - F.expr("1BD")
    keep = F.when(place >= 0, (F.expr(f"{LARGEST}BD") - place).cast("long"))
    first = F.row_number().over(W.partitionBy(digest, salt, check, F.col(id_column)).orderBy(F.col(size).desc()))
    return (
        rows.drop(norm).join(winners, [digest, salt, check])
        .withColumn(turn, first)
        .select(*docs.columns, keep.alias("keep_id"), F.col(n).alias("group_size"),
                (row_id.eqNullSafe(keep) & (F.col(turn) == 1)).alias("kept"), F.col(digest).alias("text_sha256"))
    )


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    rows, own = set_aside(docs, OUTPUTS, (id_column, text_column))
    return mark_exact_duplicates(rows, id_column, text_column).filter("kept").select(*own)
