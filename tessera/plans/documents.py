"""Queries over documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import clean_text, tokenize
from tessera.functions.udfs import html_text
from tessera.operators import documents as doc
from tessera.operators import retrieval as ret
from tessera.operators.chunking import chunk_coverage, chunk_documents
from tessera.session import scratch_path, table


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select("chunk_id", "doc_id", "section_title", "text").dropDuplicates(["chunk_id"])


def doc_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", clean_text(F.col("text")).alias("clean_text"))


def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_documents(table(spark, sf, "documents").select("doc_id", "text", "document_type"))


def doc_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's own chunks checked against it."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "document_type")
    return chunk_coverage(chunk_documents(docs), docs)


def doc_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return doc.length_summary(table(spark, sf, "documents"), F.length("text"), "document_type")


def doc_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return doc.corpus_estimate(table(spark, sf, "documents"), F.col("text"), "document_type")


def doc_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Announcements and reports as one corpus; rows that can't be taken, by reason."""
    d = table(spark, sf, "documents").select("document_id", "document_type", "company_id", "title", "published_date", "tags", "text")
    parts = [d.where(F.col("document_type") == k) for k in ("announcement", "research_report")]
    _, bad = doc.build_documents(*parts)
    return bad.groupBy("document_type", "reason").agg(F.count(F.lit(1)).alias("n"))


def doc_corpus(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("document_id", "document_type", "company_id", "title", "published_date", "tags", "text")
    good, _ = doc.build_documents(*[d.where(F.col("document_type") == k) for k in ("announcement", "research_report")])
    return good.select("document_id", "document_type", "title", F.length("text").cast("bigint").alias("n_chars"))


def doc_embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with their document's headers, as given to an embedding model."""
    d = table(spark, sf, "documents").select("doc_id", "document_type", "company_id", "title")
    j = _chunks(spark, sf).join(d, "doc_id")
    return j.select("chunk_id", doc.embedding_text(F.col("document_type"), F.col("company_id"), F.col("title"), F.col("section_title"), F.col("text")).alias("input"))


def doc_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency and occurrences of every token."""
    index = ret.postings(_chunks(spark, sf))
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(tokenize(F.col("title")), " ").alias("tokens"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "heldout_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))


def doc_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return ret.bm25_top(_chunks(spark, sf), _questions(spark, sf), 8)


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "embeddings")
    return v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v, q = _vectors(spark, sf)
    return ret.vector_scores(v, q, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def doc_vectors_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Only vectors of even labels are searched: the filter comes before the scoring."""
    v, q = _vectors(spark, sf)
    return ret.vector_scores(v.where("label % 2 = 0"), q, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def doc_store(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with their documents' attributes and a dense number."""
    d = table(spark, sf, "documents").select("doc_id", "document_type", "company_id", "title", "published_date", "publisher")
    return doc.corpus_store(_chunks(spark, sf), d).select("chunk_id", "doc_id", "document_type", "company_id", "title", "published_date", "publisher", "section_title", "vector_row")


def doc_index_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents have chunks."""
    return doc.index_coverage(table(spark, sf, "documents"), table(spark, sf, "chunks"), "doc_id")


def doc_bm25_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same answers as ``doc_bm25`` from an index that is stored first."""
    path = scratch_path(spark)
    ret.write_index(_chunks(spark, sf), path)
    return ret.search_index(spark, path, _questions(spark, sf), 8)


def doc_hybrid_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Rankings of chunks by BM25 and by cosine of hashed vectors merged by reciprocal ranks, two chunks a document."""
    chunks, q = _chunks(spark, sf), _questions(spark, sf)
    v = ret.hashed_vectors(chunks)
    w = ret.hashed_vectors(q, id_col="query_id", text_col="query").withColumnRenamed("embedding", "query_vector")
    near = ret.vector_scores(v, w, 50, id_col="chunk_id").where("score > 0")
    hits = ret.rrf_merge(ret.bm25_top(chunks, q, 50), near).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    return ret.cap_per_document(hits, 2, 8).select("query_id", "chunk_id", "doc_id", "rank", "score")


def doc_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Two rankings of chunks (by the question and by its first half) merged by reciprocal ranks, two chunks a document."""
    chunks = _chunks(spark, sf)
    q = _questions(spark, sf)
    half = q.withColumn("query", F.expr("substring(query, 1, cast(length(query) / 2 as int))"))
    a, b = (ret.bm25_top(chunks, x, 50) for x in (q, half))
    hits = ret.rrf_merge(a, b).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    return ret.cap_per_document(hits, 2, 8).select("query_id", "chunk_id", "doc_id", "rank", "score")


def doc_html(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text of all documents."""
    return table(spark, sf, "documents").select("doc_id", html_text("text").alias("visible"))


_CH = "c AS (SELECT DISTINCT ON (chunk_id) chunk_id, doc_id, section_title, text FROM chunks)"
_RUNS = "regexp_extract_all(lower({0}), '([a-z0-9_.]+|[一-鿿]+)')"
_GRAMS = "CASE WHEN regexp_matches(run, '^[一-鿿]') THEN list_transform(generate_series(1, greatest(length(run) - 1, 1)), lambda i: substr(run, i, 2)) ELSE [run] END"
_TOK = f"tok AS (SELECT chunk_id, unnest({_GRAMS}) AS term FROM (SELECT chunk_id, unnest({_RUNS.format('text')}) AS run FROM c))"
_POST = "post AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), dl AS (SELECT chunk_id, count(*) AS doc_len FROM tok GROUP BY 1), st AS (SELECT count(*) AS n, sum(doc_len) / count(*) AS avgdl FROM dl), dfr AS (SELECT term, count(*) AS df FROM post GROUP BY 1)"


def _bm(tag: str, text: str) -> str:
    return f"""q{tag} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_GRAMS}) AS term FROM (SELECT item_id AS query_id, unnest({_RUNS.format(text)}) AS run FROM heldout_items)) GROUP BY 1, 2),
w{tag} AS (SELECT query_id, term, qtf * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS weight FROM q{tag} JOIN dfr USING (term), st),
s{tag} AS (SELECT query_id, chunk_id, CAST(round(sum(CAST(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl)) AS DECIMAL(38,15))), 9) AS DOUBLE) AS score FROM w{tag} JOIN post USING (term) JOIN dl USING (chunk_id), st GROUP BY 1, 2),
r{tag} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM s{tag})"""


def _vec(where: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(qv, embedding::DOUBLE[]), 9) AS score FROM q, embeddings WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10"""


def _clean(c: str) -> str:
    s = f"regexp_replace({c}, '\\x{{FEFF}}', '', 'g')"
    for a, b in ((r"\r\n?", "chr(10)"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "''"), (r"[ \t\x{00A0}\x{3000}]+", "' '"), (r" ?\n ?", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (r"^\s+|\s+$", "''")):
        s = f"regexp_replace({s}, '{a}', {b}, 'g')"
    return s


_REASON = f"""CASE WHEN document_id IS NULL THEN 'missing_id' WHEN title IS NULL OR trim(title) = '' THEN 'missing_title' WHEN published_date IS NULL THEN 'invalid_date' WHEN text IS NULL OR trim(text) = '' THEN 'missing_text' WHEN length({_clean("text")}) < 50 THEN 'text_too_short' END"""

SQL = {
    "doc_clean": f"SELECT doc_id, {_clean('text')} AS clean_text FROM documents",
    "doc_lengths": """WITH o AS (SELECT document_type, CAST(length(text) AS BIGINT) AS x, row_number() OVER (PARTITION BY document_type ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY document_type) AS n FROM documents WHERE text IS NOT NULL)
SELECT document_type, max(n) AS n, min(x) AS min_len, max(x) FILTER (WHERE i = round_even((n - 1) * 0.5, 0)) AS p50, max(x) FILTER (WHERE i = round_even((n - 1) * 0.95, 0)) AS p95, max(x) AS max_len, round(sum(x) / max(n), 1) AS mean_len FROM o GROUP BY 1""",
    "doc_estimate": """WITH a AS (SELECT document_type, count(*) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars, max(length(text)) AS longest, CAST(sum(length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g'))) AS BIGINT) AS n_cjk, CAST(sum(length(text) - length(regexp_replace(text, '[A-Za-z0-9]', '', 'g'))) AS BIGINT) AS n_latin FROM documents GROUP BY 1)
SELECT *, CAST(ceil(round(n_cjk * 0.6 + n_latin * 0.2 + (n_chars - n_cjk - n_latin) * 0.2, 6)) AS BIGINT) AS tokens_low, CAST(ceil(round(n_cjk * 1.0 + n_latin * 0.25 + (n_chars - n_cjk - n_latin) * 0.5, 6)) AS BIGINT) AS tokens_mid, CAST(ceil(round(n_cjk * 1.5 + n_latin * 0.4 + (n_chars - n_cjk - n_latin) * 1.0, 6)) AS BIGINT) AS tokens_high FROM a""",
    "doc_rejects": f"SELECT document_type, {_REASON} AS reason, count(*) AS n FROM documents WHERE document_type IN ('announcement', 'research_report') AND {_REASON} IS NOT NULL GROUP BY 1, 2",
    "doc_corpus": f"SELECT document_id, document_type, {_clean('title')} AS title, CAST(length({_clean('text')}) AS BIGINT) AS n_chars FROM documents WHERE document_type IN ('announcement', 'research_report') AND {_REASON} IS NULL",
    "doc_embedding_text": f"""WITH {_CH} SELECT chunk_id, concat_ws(chr(10), CASE WHEN trim(document_type) <> '' THEN 'type: ' || document_type END, CASE WHEN trim(company_id) <> '' THEN 'company: ' || company_id END, CASE WHEN trim(title) <> '' THEN 'title: ' || title END, CASE WHEN trim(section_title) <> '' THEN 'section: ' || section_title END, c.text) AS input FROM c JOIN documents d USING (doc_id)""",
    "doc_term_stats": f"WITH {_CH}, {_TOK}, post AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY 1",
    "doc_tokens": f"SELECT doc_id, array_to_string(flatten(list_transform({_RUNS.format('coalesce(title, $$$$)')}, lambda run: {_GRAMS})), ' ') AS tokens FROM documents",
    "doc_bm25": f"WITH {_CH}, {_TOK}, {_POST}, {_bm('1', 'question')} SELECT query_id, chunk_id, rank, CASE WHEN best <> 0 THEN round(score / best, 6) ELSE 0 END AS score FROM r1 WHERE rank <= 8",
    "doc_store": f"WITH {_CH} SELECT chunk_id, doc_id, document_type, company_id, title, published_date, publisher, section_title, row_number() OVER (ORDER BY chunk_id) - 1 AS vector_row FROM c JOIN documents d USING (doc_id) WHERE chunk_id IS NOT NULL",
    "doc_index_coverage": """WITH b AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM chunks WHERE doc_id IS NOT NULL) AS has FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)), a AS (SELECT count(*) AS n_wanted, count(*) FILTER (has) AS n_indexed FROM b)
SELECT *, n_wanted - n_indexed AS n_missing, round(n_indexed / n_wanted, 6) AS coverage, CASE WHEN n_wanted > n_indexed THEN (n_wanted - n_indexed) || ' of ' || n_wanted || ' are not in the index' END AS warning FROM a""",
    "doc_bm25_index": f"WITH {_CH}, {_TOK}, {_POST}, {_bm('1', 'question')} SELECT query_id, chunk_id, rank, CASE WHEN best <> 0 THEN round(score / best, 6) ELSE 0 END AS score FROM r1 WHERE rank <= 8",
    "doc_hybrid_vectors": f"""WITH {_CH}, {_TOK}, {_POST}, {_bm('1', 'question')},
hx AS (SELECT chunk_id, term, CAST(concat('0x', substr(md5(term), 1, 4)) AS INT) % 64 AS j, CASE WHEN CAST(concat('0x', substr(md5(term), 5, 1)) AS INT) % 2 = 0 THEN 1 ELSE -1 END AS sign, tf FROM post),
cv AS (SELECT chunk_id, j, sum(tf * sign)::DOUBLE AS x FROM hx GROUP BY 1, 2), cn AS (SELECT chunk_id, sqrt(sum(x * x)) AS norm FROM cv GROUP BY 1),
qv AS (SELECT query_id, CAST(concat('0x', substr(md5(term), 1, 4)) AS INT) % 64 AS j, sum(qtf * CASE WHEN CAST(concat('0x', substr(md5(term), 5, 1)) AS INT) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS y FROM q1 GROUP BY 1, 2), qn AS (SELECT query_id, sqrt(sum(y * y)) AS norm FROM qv GROUP BY 1),
sv AS (SELECT query_id, chunk_id, sum(x * y) AS dot FROM qv JOIN cv USING (j) GROUP BY 1, 2), cs AS (SELECT query_id, chunk_id, round(dot / nullif(qn.norm * cn.norm, 0), 9) AS score FROM sv JOIN qn USING (query_id) JOIN cn USING (chunk_id)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cs WHERE score > 0),
m AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, round((coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0)) / (2.0::DOUBLE / 61), 9) AS score FROM (SELECT * FROM r1 WHERE rank <= 50) a FULL JOIN (SELECT * FROM r2 WHERE rank <= 50) b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
d AS (SELECT m.*, c.doc_id, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) AS k FROM m JOIN c USING (chunk_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM d WHERE k <= 2)
SELECT query_id, chunk_id, doc_id, rank, score FROM f WHERE rank <= 8""",
    "doc_vectors": _vec("TRUE"),
    "doc_vectors_filtered": _vec("label % 2 = 0"),
    "doc_hybrid": f"""WITH {_CH}, {_TOK}, {_POST}, {_bm('1', 'question')}, {_bm('2', 'substr(question, 1, length(question) // 2)')},
m AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, round((coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0)) / (2.0::DOUBLE / 61), 9) AS score FROM (SELECT * FROM r1 WHERE rank <= 50) a FULL JOIN (SELECT * FROM r2 WHERE rank <= 50) b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
d AS (SELECT m.*, c.doc_id, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) AS k FROM m JOIN c USING (chunk_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM d WHERE k <= 2)
SELECT query_id, chunk_id, doc_id, rank, score FROM f WHERE rank <= 8""",
}
QUERIES = {k: globals()[k] for k in [*SQL, "doc_chunks", "doc_coverage", "doc_html"]}
