"""Chunking, text analysis, retrieval and context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gearwatch.catalog import registry as cat
from gearwatch.catalog.base import query, r6, table
from gearwatch.functions import text as X
from gearwatch.operators import registry, retrieval, vectors
from gearwatch.session import materialise

_STRIP = r"regexp_replace({x}, '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g')"
_CHUNKS = f"""ch AS (SELECT doc_id, text, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 800 THEN 1
 ELSE CAST(ceil((length(text) - 800) / 600.0) AS BIGINT) + 1 END)) AS i FROM documents),
 chunks AS (SELECT doc_id, CAST(i AS INT) AS chunk_index, {_STRIP.format(x="substring(text, CAST(i AS BIGINT) * 600 + 1, 800)")} AS content FROM ch)"""


def chunks(spark, d):
    return X.explode_chunks(table(spark, d, "documents").select("doc_id", "text"), "text", 800, 200)


@query("t1_chunks", f"WITH {_CHUNKS} SELECT doc_id, chunk_index, content FROM chunks")
def chunk_text(spark, d):
    return chunks(spark, d)


@query("t2_word_counts", rf"""WITH s AS (SELECT doc_id, text, {_STRIP.format(x="text")} AS s FROM documents)
 SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(CASE WHEN length(s) = 0 THEN 0 ELSE len(regexp_split_to_array(s, '[\s\p{{Z}}]+')) END AS INT) AS words FROM s""")
def word_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.char_count(t).alias("chars"), X.word_count(t).alias("words"))


@query("t3_compose", r"""SELECT doc_id, concat_ws(E' \n ', nullif(source, ''), CASE WHEN lang <> 'en' THEN lang END, text,
 CASE WHEN doc_id % 2 = 0 THEN 'Solution: ' || source || ' | ' || lang || ' | c' END) AS composed FROM documents""")
def compose(spark, d):
    solutions = F.when(F.col("doc_id") % 2 == 0, F.array("source", "lang", F.lit("c"), F.lit("d")))
    return table(spark, d, "documents").select("doc_id", X.compose_problem(
        F.col("source"), F.when(F.col("lang") != "en", F.col("lang")).otherwise(""), F.col("text"), solutions).alias("composed"))


@query("t7_language", """SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[\\x{0600}-\\x{06FF}]')) / greatest(length(text), 1) > 0.3 THEN 'ar' ELSE 'en' END AS language FROM (
 SELECT doc_id, CASE WHEN lang = 'de' THEN repeat('سلام ', CAST(length(text) // 4 AS INT)) || text ELSE text END AS text FROM documents)""".replace("\\\\", "\\"))
def language(spark, d):
    t = F.when(F.col("lang") == "de", F.concat(F.expr("repeat('سلام ', cast(length(text) div 4 as int))"), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.language(t).alias("language"))


_GREET = " OR ".join(f"regexp_matches(lower(trim(text)), '{p}')" for p in (
    r"^\s*(ازيك|إزيك|ازاى|إزاى|ايه|أيه|يا|هاى|سلام|مرحبا|صباح|مساء)\s*", r"^\s*(اخبارك|أخبارك|عامل|حالك)\s*",
    r"^\s*(hi|hello|hey|yo|sup|greetings|morning|evening)\s*", r"^\s*(how are you|whats up|what''s up)\s*"))


@query("t8_greetings", f"SELECT conv_id, turn, ({_GREET}) AS is_greeting FROM conversations")
def greetings(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.is_greeting(F.col("text")).alias("is_greeting"))


@query("t9_machine_ids", f"WITH t AS (SELECT page_id, html || {cat._FOREIGN} AS text FROM pages) SELECT page_id, array_to_string(list_sort({cat._IDS}), ',') AS ids FROM t")
def machine_ids(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(X.machine_ids(F.concat("html", F.lit(X.FOREIGN_IDS))), ",").alias("ids"))


@query("t10_sanitise", f"SELECT conv_id, turn, {cat._SAFE} AS safe_text FROM conversations")
def sanitise(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.sanitise(F.col("text")).alias("safe_text"))


@query("h_hash_cache_key", "SELECT conv_id, turn, md5(text) AS cache_key FROM conversations")
def cache_key(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.cache_key(F.col("text")).alias("cache_key"))


@query("t5_cosine_similarity", """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return r6(e.join(nxt, "vec_id").select("vec_id", retrieval.cosine(F.col("embedding"), F.col("other")).alias("sim")))


@query("c7_t6_h4_dynamic_top_k", """WITH p AS (SELECT a.vec_id AS question_id, b.vec_id AS chunk_id,
 round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a, embeddings b),
 k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank, count(*) OVER (PARTITION BY question_id) AS n FROM p WHERE score >= 0.15)
 SELECT question_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM k WHERE rank <= CASE WHEN n > 5 THEN 7 ELSE 5 END""")
def dynamic_top_k(spark, d):
    e = table(spark, d, "embeddings")
    corpus, asked = e.withColumnRenamed("vec_id", "chunk_id"), e.withColumnRenamed("vec_id", "question_id")
    return r6(retrieval.dynamic_top_k(corpus, asked, 5))


def _asked(spark, d):
    """Every vector, and as queries those whose id is divisible by 50."""
    corpus = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return corpus, corpus.filter("id % 50 = 0").withColumnRenamed("id", "q")


@query("c7_projection_index")
def projection_index(spark, d):
    """Ten nearest vectors of each query among the buckets of an index over all rows."""
    corpus, asked = _asked(spark, d)
    found = vectors.index_search(vectors.fit_index(corpus), corpus, asked, 10, exclude_self=True)
    return r6(found.select(F.col("q").alias("question_id"), F.col("id").alias("chunk_id"), "score", "rank"))


@query("c7_projection_recall", """SELECT count(DISTINCT vec_id) AS queries, CAST(least(10, (SELECT count(*) - 1 FROM embeddings)) AS BIGINT) * count(*) AS neighbours, true AS reached
 FROM embeddings WHERE vec_id % 50 = 0""")
def projection_recall(spark, d):
    """Whether the index finds nine tenths of the true neighbours."""
    corpus, asked = _asked(spark, d)
    exact = vectors.search(corpus, asked, 10, exclude_self=True)
    found = vectors.index_search(vectors.fit_index(corpus), corpus, asked, 10, exclude_self=True)
    return vectors.recall(found, exact).select("queries", "neighbours", (F.col("recall") >= 0.9).alias("reached"))


def _scored_chunks(spark, d):
    """Chunks of all documents scored against all user questions with the default encoder."""
    corpus = chunks(spark, d).withColumn("chunk_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    encoder = retrieval.fit_encoder(corpus)
    # Written once: the search counts the vectors before it deals them to blocks.
    vectors = materialise(retrieval.encode(encoder, corpus).select("chunk_id", "embedding"), "chunk-vectors")
    asked = retrieval.encode(encoder, cat.questions(spark, d), "text").select("question_id", "embedding")
    return corpus, retrieval.dynamic_top_k(vectors, asked, 5)


@query("t4_encode_chunks")
def encode_chunks(spark, d):
    corpus = chunks(spark, d)
    return retrieval.encode(retrieval.fit_encoder(corpus), corpus).select("doc_id", "chunk_index", "embedding")


@query("t6_question_chunks")
def question_chunks(spark, d):
    return _scored_chunks(spark, d)[1]


def _top_by_doc(spark, d):
    """Stand-in ranking that SQL can state: the chunks of the document a question's number points at."""
    docs = chunks(spark, d)
    conv = table(spark, d, "conversations").filter("role = 'user'").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("question_id"),
        F.col("conv_id").alias("doc_id"))
    return conv.join(docs, "doc_id").select("question_id", (F.col("chunk_index") + 1).alias("rank"), "content")


_HITS = f"""{cat.REG}, {cat._QUESTIONS}, {cat._BRANCHES}, hits AS (SELECT question_id, id, min(branch) AS branch FROM b GROUP BY 1, 2), {_CHUNKS},
 top AS (SELECT 'c' || conv_id || '-' || turn AS question_id, chunk_index + 1 AS rank, content FROM conversations JOIN chunks ON doc_id = conv_id WHERE role = 'user')"""


@query("t11_route", f"""WITH {_HITS}, a AS (SELECT q.question_id, ({_GREET}) AS g, len({cat._IDS}) AS ids,
  (SELECT count(*) FROM hits h WHERE h.question_id = q.question_id) AS db, (SELECT count(*) FROM top t WHERE t.question_id = q.question_id) AS pdf FROM q)
 SELECT question_id, CASE WHEN g THEN 'casual_greeting' WHEN db > 0 AND ids > 0 THEN 'machine_specific' WHEN pdf > 0 THEN 'technical_manual' ELSE 'general_knowledge' END AS query_type,
 CASE WHEN g THEN 0 ELSE db END AS db_results, CASE WHEN g THEN 0 ELSE pdf END AS pdf_chunks FROM a""")
def route(spark, d):
    asked = retrieval.analyse(cat.questions(spark, d))
    hits = registry.lookup(cat.machines(spark, d), cat.questions(spark, d))
    routed = retrieval.route(asked, hits, _top_by_doc(spark, d))
    return routed.select("question_id", "query_type", "db_results", "pdf_chunks")


@query("t12_context", f"""WITH {_HITS},
 rk AS (SELECT h.question_id, reg.*, row_number() OVER (PARTITION BY h.question_id ORDER BY branch, id) AS rank FROM hits h JOIN reg USING (id)),
 rt AS (SELECT question_id, string_agg('Machine ' || rank || E':\\n  - machine_id: ' || machine_id || E'\\n  - model: ' || model || E'\\n  - manufacturer: ' || manufacturer
  || E'\\n  - location: ' || location || E'\\n  - status: ' || status || E'\\n  - serial_number: ' || serial_number, E'\\n' ORDER BY rank) AS registry_text FROM rk WHERE rank <= 10 GROUP BY 1),
 mt AS (SELECT question_id, string_agg('[Manual Section ' || rank || E']\\n' || left(content, 500), E'\\n' ORDER BY rank) AS manual_text FROM top WHERE rank <= 7 GROUP BY 1)
 SELECT q.question_id, rt.registry_text, mt.manual_text FROM q LEFT JOIN rt USING (question_id) LEFT JOIN mt USING (question_id)""")
def context(spark, d):
    from pyspark.sql import Window as W

    asked, reg = cat.questions(spark, d), cat.machines(spark, d)
    hits = registry.lookup(reg, asked)
    ranked = hits.join(reg, "id").withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy("branch", "id")))
    fields = ["machine_id", "model", "manufacturer", "location", "status", "serial_number"]
    return retrieval.assemble_context(asked.select("question_id"), ranked, _top_by_doc(spark, d), fields)


@query("t13_query_log_metrics", """WITH l AS (SELECT role AS query_type, turn AS db_results, conv_id % 5 AS pdf_chunks, length(text) / 100.0 AS processing_time, conv_id % 3 = 0 AS cached FROM conversations)
 SELECT query_type, count(*) AS queries, CAST(sum(db_results) AS BIGINT) AS db_results, CAST(sum(pdf_chunks) AS BIGINT) AS pdf_chunks, round(avg(processing_time), 6) AS avg_processing_time,
 round(count(*) FILTER (cached) * 100.0 / count(*), 6) AS cache_hit_pct FROM l GROUP BY 1""")
def query_log_metrics(spark, d):
    log = table(spark, d, "conversations").select(
        F.col("role").alias("query_type"), F.col("turn").alias("db_results"), (F.col("conv_id") % 5).alias("pdf_chunks"),
        (F.length("text") / 100).alias("processing_time"), (F.col("conv_id") % 3 == 0).alias("cached"))
    return r6(retrieval.query_log_metrics(log))


@query("m_sql_chunk_rows", f"""WITH {_CHUNKS} SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, content FROM chunks""")
def sql_chunk_rows(spark, d):
    X.register_sql(spark)
    table(spark, d, "documents").createOrReplaceTempView("gearwatch_documents")
    return spark.sql("SELECT doc_id, chunk_index, content FROM gearwatch_documents, LATERAL chunk_rows(text, 800, 200) WHERE length(text) > 0")


@query("m_sql_language", "SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[\\x{600}-\\x{6FF}]')) / greatest(length(text), 1) > 0.3 THEN 'ar' ELSE 'en' END AS language FROM documents WHERE text IS NOT NULL")
def sql_language(spark, d):
    X.register_sql(spark)
    table(spark, d, "documents").createOrReplaceTempView("gearwatch_documents")
    return spark.sql("SELECT doc_id, text_language(text) AS language FROM gearwatch_documents WHERE text IS NOT NULL")


@query("m_sql_chunk_function", f"""WITH {_CHUNKS} SELECT doc_id, count(*) AS chunks, md5(string_agg(content, '|' ORDER BY chunk_index)) AS content_md5
 FROM chunks GROUP BY doc_id""")
def sql_chunk_function(spark, d):
    X.register_sql(spark)
    table(spark, d, "documents").createOrReplaceTempView("gearwatch_documents")
    return spark.sql("""SELECT doc_id, cast(size(c) AS bigint) AS chunks, md5(array_join(c, '|')) AS content_md5
 FROM (SELECT doc_id, chunk_text(text, 800, 200) AS c FROM gearwatch_documents WHERE length(text) > 0)""")
