"""Queries searching chunks for questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import text as X
from tarmac.operators import retrieval as R
from tarmac.plans.registry import query
from tarmac.plans.traffic import r6
from tarmac.sources import samples as S

TOK = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[0-9A-Za-z가-힣_]+')), lambda t: length(t) >= 2)"
COMPACT = "regexp_replace(lower({0}), '[ \\t\\n\\r\\f\\x0b]+', '', 'g')"


def questions(spark, sf):
    return S.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def kb(spark, sf):
    return S.chunks(spark, sf).withColumn("keywords", F.array("domain", "document_type"))


SQL_KW = S.SQL_CHUNKS + f""",
q AS (SELECT item_id AS question_id, text AS question, {TOK.format('text')} AS qt, {COMPACT.format('text')} AS qc FROM benchmark),
c AS (SELECT *, {TOK.format('chunk_text')} AS ct, {COMPACT.format('chunk_text')} AS cc FROM chunks),
kw AS (SELECT question_id, chunk_id,
    least(1.5, round(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, ct)) / len(qt) * 0.7 ELSE 0.0 END
      + CASE WHEN length(qc) >= 4 AND contains(cc, qc) THEN 0.3 ELSE 0.0 END
      + CASE WHEN contains(lower(question), lower(domain)) THEN 0.25 ELSE 0.0 END
      + CASE WHEN contains(lower(question), lower(document_type)) THEN 0.25 ELSE 0.0 END, 12)) AS score FROM q, c)"""


@query("keyword_search", f"""
WITH {SQL_KW},
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM kw WHERE score > 0)
SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def keyword_search(spark, sf):
    return R.keyword_search(kb(spark, sf), questions(spark, sf), 5).withColumn("score", F.round("score", 6))


def embeddings(spark, sf):
    e = S.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                    F.concat(F.lit("m"), F.col("label") % 3).alias("embedding_model"),
                    (F.col("label") % 2 == 0).alias("is_current"), "label")


def label_vectors(spark, sf):
    """One query vector per label: the mean of its embeddings."""
    e = embeddings(spark, sf).select("label", F.posexplode("embedding").alias("i", "v"))
    m = e.groupBy("label", "i").agg(F.avg("v").alias("v"))
    arr = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])
    return m.groupBy(F.col("label").cast("long").alias("question_id")).agg(arr.alias("vector"))


SQL_COS = """
em AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v, 'm' || label % 3 AS embedding_model,
              label % 2 = 0 AS is_current, label FROM embeddings),
ex AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM em),
mx AS (SELECT label, i, avg(x) AS x FROM ex GROUP BY 1, 2),
qv AS (SELECT CAST(label AS BIGINT) AS question_id, list(x ORDER BY i) AS qv FROM mx GROUP BY 1),
cs AS (SELECT question_id, chunk_id, embedding_model, is_current, round(list_cosine_similarity(qv, v), 9) AS score FROM qv, em)"""


@query("vector_search", f"""
WITH {SQL_COS},
mm AS (SELECT embedding_model FROM em GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM cs
      WHERE is_current AND embedding_model = (SELECT embedding_model FROM mm))
SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def vector_search(spark, sf):
    e = embeddings(spark, sf)
    same = e.where("is_current").join(F.broadcast(R.modal_model(e)), "embedding_model")
    return R.vector_search(same, label_vectors(spark, sf), 5).withColumn("score", F.round("score", 6))


@query("dense_search", f"""
WITH {SQL_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM cs)
SELECT question_id, chunk_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10""")
def dense_search(spark, sf):
    return R.vector_search(embeddings(spark, sf), label_vectors(spark, sf), 10).withColumn(
        "score", F.round("score", 4))


@query("hybrid_search", f"""
WITH {SQL_KW}, {SQL_COS},
mm AS (SELECT embedding_model FROM em GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
ce AS (SELECT chunk_id, v FROM em WHERE is_current AND embedding_model = (SELECT embedding_model FROM mm)),
s AS (SELECT kw.question_id, kw.chunk_id, kw.score AS kw,
             CASE WHEN v IS NULL THEN -2.0 ELSE round(list_cosine_similarity(qv, v), 9) END AS cos
      FROM kw JOIN qv ON qv.question_id = kw.question_id % 10 LEFT JOIN ce USING (chunk_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY kw DESC, chunk_id) - 1 AS rk,
             row_number() OVER (PARTITION BY question_id ORDER BY cos DESC, chunk_id) - 1 AS rv FROM s),
f AS (SELECT *, 1.0 / (60 + rv + 1) + 1.0 / (60 + rk + 1) AS score FROM r WHERE kw > 0 OR cos >= 0.25),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM f)
SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM o WHERE rank <= 5""")
def hybrid_search(spark, sf):
    c = R.with_embeddings(kb(spark, sf), embeddings(spark, sf))
    v = label_vectors(spark, sf).withColumnRenamed("question_id", "label")
    q = questions(spark, sf).withColumn("label", F.col("question_id") % 10).join(F.broadcast(v), "label", "left")
    return R.hybrid_search(c, q, 5).select("question_id", "chunk_id", r6("score"), "rank")


SQL_TFIDF = """
tq AS (SELECT question_id, term, count(*) AS tf FROM (SELECT question_id, unnest(regexp_extract_all(lower(question),
         '[\\p{L}\\p{N}_]{2,}')) AS term FROM tfq) GROUP BY 1, 2),
td AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(chunk_text),
         '[\\p{L}\\p{N}_]{2,}')) AS term FROM tfd) GROUP BY 1, 2),
id AS (SELECT term, ln((1.0 + (SELECT count(*) FROM tfd)) / (1.0 + count(*))) + 1 AS idf FROM td GROUP BY 1),
dw AS (SELECT chunk_id, td.term, tf * idf AS w FROM td JOIN id USING (term)),
dn AS (SELECT chunk_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY 1),
qw AS (SELECT question_id, tq.term, tf * idf AS w FROM tq JOIN id USING (term)),
qn AS (SELECT question_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY 1),
dt AS (SELECT question_id, chunk_id, sum(dw.w * qw.w) AS d FROM qw JOIN dw USING (term) GROUP BY 1, 2),
ts AS (SELECT q.question_id, c.chunk_id, round(coalesce(d / dn.n / qn.n, 0.0), 9) AS score FROM tfq q CROSS JOIN tfd c
       LEFT JOIN dt ON dt.question_id = q.question_id AND dt.chunk_id = c.chunk_id
       LEFT JOIN dn ON dn.chunk_id = c.chunk_id LEFT JOIN qn ON qn.question_id = q.question_id),
tr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM ts)"""


@query("tfidf_search", f"""
WITH tfq AS (SELECT item_id AS question_id, text AS question FROM benchmark),
tfd AS (SELECT doc_id AS chunk_id, text AS chunk_text FROM documents), {SQL_TFIDF}
SELECT question_id, chunk_id, round(score, 4) AS score, rank FROM tr WHERE rank <= 3""")
def tfidf_search(spark, sf):
    return R.tfidf_search(S.chunks(spark, sf), questions(spark, sf), 3).withColumn("score", F.round("score", 4))


@query("similar_chain", f"""
WITH {SQL_KW.replace('FROM benchmark)', 'FROM qq)').replace('q AS (SELECT item_id AS question_id, text AS question',
     "qq AS (SELECT item_id AS question_id, text FROM benchmark UNION ALL SELECT 1000000 + min(p_partkey), p_name FROM part GROUP BY p_name)," + chr(10) + "q AS (SELECT question_id, text AS question", 1)},
tfq AS (SELECT question_id, question FROM q),
tfd AS (SELECT p_partkey AS chunk_id, concat_ws(' ', p_name, p_brand, p_type) AS chunk_text FROM part), {SQL_TFIDF},
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM kw WHERE score > 0.55)
SELECT question_id, chunk_id, 'knowledge_base' AS source, rank FROM k WHERE rank <= 3
UNION ALL SELECT question_id, chunk_id, 'archive', rank FROM tr WHERE rank <= 3
  AND question_id NOT IN (SELECT question_id FROM k)""")
def similar_chain(spark, sf):
    """Similar cases from the knowledge base, else from the archive of records."""
    p = S.table(spark, sf, "part")
    q = questions(spark, sf).unionByName(p.groupBy(F.col("p_name").alias("question")).agg(
        (F.min("p_partkey") + 1_000_000).alias("question_id")))
    first = R.keyword_search(kb(spark, sf), q, 3).where("score > 0.55")
    records = p.select(F.col("p_partkey").alias("chunk_id"),
                       X.joined(" ", "p_name", "p_brand", "p_type").alias("chunk_text"))
    second = R.tfidf_search(records, q, 3)
    cols = ["question_id", "chunk_id", "source", "rank"]
    return R.first_source(first.withColumn("source", F.lit("knowledge_base")).select(*cols),
                          second.withColumn("source", F.lit("archive")).select(*cols))


@query("chunk_catalog", f"""
WITH {S.SQL_CHUNKS}, {SQL_COS},
mm AS (SELECT embedding_model FROM em GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
j AS (SELECT c.*, e.v FROM chunks c LEFT JOIN (SELECT * FROM em WHERE is_current
        AND embedding_model = (SELECT embedding_model FROM mm)) e USING (chunk_id))
SELECT domain, count(*) AS chunks, count(v) AS vector_rows, count(DISTINCT document_type) AS types,
       (SELECT embedding_model FROM mm) AS model, (SELECT count(*) = count(DISTINCT doc_id) FROM documents) AS unique_ids
FROM j GROUP BY 1""")
def chunk_catalog(spark, sf):
    e = embeddings(spark, sf)
    c = S.chunks(spark, sf)
    j = R.with_embeddings(c, e)
    return (j.groupBy("domain").agg(
        F.count("*").alias("chunks"), F.count("embedding").alias("vector_rows"),
        F.count_distinct("document_type").alias("types"))
        .join(R.modal_model(e).withColumnRenamed("embedding_model", "model"))
        .join(R.is_unique(c, "chunk_id").withColumnRenamed("is_unique", "unique_ids")))


@query("chunk_documents", f"""
WITH {S.SQL_CHUNKS}, {SQL_COS},
mm AS (SELECT embedding_model FROM em GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT c.chunk_id, c.domain, l.quality, l.toxic, e.v IS NOT NULL AS has_vector FROM chunks c
LEFT JOIN labels l ON l.doc_id = c.chunk_id
LEFT JOIN em e ON e.chunk_id = c.chunk_id AND is_current AND embedding_model = (SELECT embedding_model FROM mm)""")
def chunk_documents(spark, sf):
    """Every chunk with its document's columns and whether it has a current vector of the chosen model."""
    c = S.chunks(spark, sf).withColumn("doc_id", F.col("chunk_id"))
    j = R.with_embeddings(R.with_documents(c, S.table(spark, sf, "labels"), "doc_id"), embeddings(spark, sf))
    return j.select("chunk_id", "domain", "quality", "toxic", F.col("embedding").isNotNull().alias("has_vector"))


@query("token_overlap", f"""
WITH d AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS k, text FROM documents)
SELECT doc_id, round(len(list_intersect(qt, {TOK.format('d.text')})) / len(qt), 6) AS share
FROM d JOIN (SELECT item_id AS k, {TOK.format('text')} AS qt FROM benchmark) b USING (k)""")
def token_overlap(spark, sf):
    """Share of a question's tokens found in the document it is asked of."""
    b = questions(spark, sf)
    n = b.agg(F.count("*").alias("n"))
    d = S.chunks(spark, sf).join(F.broadcast(n)).withColumn("question_id", F.col("chunk_id") % F.col("n"))
    q = b.select("question_id", X.tokens("question").alias("qt"), "question")
    j = d.join(q, "question_id")
    return j.select(F.col("chunk_id").alias("doc_id"),
                    r6(X.overlap_share(F.col("qt"), X.tokens("chunk_text")), "share"))


@query("doc_excerpts", f"""
WITH b AS (SELECT item_id AS k, text AS question FROM benchmark),
d AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS k, text FROM documents),
p AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(question, '[0-9A-Za-z가-힣_]+'),
        lambda t: instr(lower(text), lower(t))), lambda x: x > 0)[1] AS pos0 FROM d JOIN b USING (k))
SELECT doc_id, md5(trim(replace(substr(text, CAST(greatest(1, coalesce(pos0 - 80, 1)) AS BIGINT), 300), chr(10), ' '))) AS excerpt_md5 FROM p""")
def doc_excerpts(spark, sf):
    b = questions(spark, sf)
    n = b.agg(F.count("*").alias("n"))
    d = S.chunks(spark, sf).join(F.broadcast(n)).withColumn("question_id", F.col("chunk_id") % F.col("n"))
    j = d.join(b, "question_id")
    return j.select(F.col("chunk_id").alias("doc_id"),
                    F.md5(X.excerpt("chunk_text", "question")).alias("excerpt_md5"))
