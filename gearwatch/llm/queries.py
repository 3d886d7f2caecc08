"""The registered queries of this subpackage and their SQL, kept apart from those of the catalog."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gearwatch.llm import (
    bpe_automaton,
    decontaminate,
    exact_dedup,
    language,
    merkle,
    near_dedup,
    packing,
    quality,
    shards,
    substring_dedup,
    token_files,
    toxicity,
    whitening,
)
from gearwatch.llm.common import crc_mod
from gearwatch.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; learned from the rows whose crc32 of the id is no multiple of 5."""
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 5) == 0
    model = language.fit(docs.filter(~held_out))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.coalesce("nearest", F.lit(language.UNKNOWN)).alias("lang_pred"),
                        "score", "rejected")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; labels are learned from where the crc32 of the id modulo 3 is not 1."""
    docs, held_out = documents(spark, sf_dir), crc_mod("doc_id", 3) == 1
    rows = quality.features(docs, quality.word_vectors(docs.select("text")))
    model = quality.fit_on(rows, documents(spark, sf_dir, "labels"), ~held_out)
    return quality.with_scores(rows, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes, groups of equal texts together."""
    return shards.shard_by_bytes(documents(spark, sf_dir)).select("doc_id", *shards.OUTPUTS)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold a passage like an item of the benchmark, and which items."""
    found = decontaminate.mark_contaminated(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *decontaminate.OUTPUTS)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return packing.piece_digests(packing.pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels are learned from where the crc32 of the id is no multiple of 5."""
    docs, held_out = documents(spark, sf_dir), crc_mod("doc_id", 5) == 0
    model = toxicity.fit_on(docs, documents(spark, sf_dir, "labels"), ~held_out)
    found = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as coded blocks of ids in files of the shared folder, read back."""
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path(VOCABULARY))
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words that a document with a smaller id has too."""
    found = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document under links of 0.8 between sets of four-word shingles."""
    return near_dedup.mark_near_duplicates(documents(spark, sf_dir), 4).select("doc_id", *near_dedup.OUTPUTS)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each group of equal texts stays."""
    return exact_dedup.mark_exact_duplicates(documents(spark, sf_dir)).select("doc_id", *exact_dedup.OUTPUTS)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents in a manifest of their table, checked for rows of which a fifth had their text lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.when(crc_mod("doc_id", 5) == 0, F.translate("text", upper, lower)).otherwise(F.col("text"))
    found = merkle.prove(documents(spark, sf_dir), presented={"text": text})
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of all embeddings along the leading components of their distinct vectors."""
    return whitening.whiten(documents(spark, sf_dir, "embeddings"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of what the ids decode to."""
    found = bpe_automaton.round_trip(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(WORD_VOCABULARY))
    return found.select("doc_id", "n_tokens", F.sha2("numbers", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_language, op2_quality, op3_shards, op4_decontamination, op5_packing, op6_toxicity, op7_token_files,
    op8_substring_dedup, op9_near_dedup, op10_exact_dedup, op11_merkle, op12_whitening, op13_bpe,
)}

ORACLES = {
    "op10_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
k AS (SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY n) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM k""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
keyed AS (SELECT doc_id, s, array_to_string(w[s : s + 49], ' ') AS k FROM win),
gone AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS f FROM keyed) WHERE f < doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM gone),
rows_ AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT r.doc_id, count(*) AS n, string_agg(r.word, ' ' ORDER BY r.i) AS t FROM rows_ r ANTI JOIN covered c ON r.doc_id = c.doc_id AND r.i = c.i GROUP BY r.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS c FROM e UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, d.doc_id = coalesce(m.c, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
