"""Lexical, vector and hybrid retrieval over chunks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.columns import l2_normalize, tokenize
from tessera.session import materialize

K1, B, RRF_K = 1.2, 0.75, 60


def postings(chunks: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, doc_len): the inverted index; aggregated within a chunk before anything is shuffled by term."""
    t = chunks.select(id_col, tokenize(F.col(text_col)).alias("tokens")).where(F.size("tokens") > 0)
    return t.select(id_col, F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term")).groupBy(id_col, "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, *, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """(query_id, chunk_id, score): every chunk that shares a token with a query; statistics over all chunks.

    Only postings of query terms are kept before the index is joined (the terms of the queries decide, a semi-join), so
    the tokens of other terms never leave their task. A query token given twice counts twice. idf is ln((N - n + 0.5) /
    (n + 0.5)), 1e-6 where that is not positive.
    """
    asked = queries.select(query_id, F.explode(tokenize(F.col(query_text))).alias("term")).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf"))
    terms = asked.select("term").distinct()
    tokens = chunks.select("chunk_id", tokenize(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    n_docs, total = tokens.agg(F.count(F.lit(1)), F.sum(F.size("tokens"))).first()
    if not n_docs:
        return queries.select(query_id, F.lit("").alias("chunk_id"), F.lit(0.0).alias("score")).limit(0)
    hits = tokens.select("chunk_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term")).join(terms, "term", "left_semi").groupBy("chunk_id", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))
    hits = materialize(hits)
    df = document_frequency(hits)
    raw = F.log((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "term").select(query_id, "term", (F.when(raw > 0, raw).otherwise(1e-6) * F.col("qtf")).alias("weight"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(total / n_docs))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / norm
    # sums of decimals don't depend on the order of their parts
    return weights.join(hits, "term").groupBy(query_id, "chunk_id").agg(F.round(F.sum(part.cast("decimal(38,15)")), 9).cast("double").alias("score"))


def write_index(chunks: DataFrame, path: str, *, id_col: str = "chunk_id", text_col: str = "text", buckets: int = 64) -> None:
    """Store the inverted index below ``path``: postings by buckets of terms, sorted by term within a file, so that a search
    reads the buckets and row groups of its terms only; document frequencies; and one row of totals.

    The text is tokenised once; a frequent term is spread over several files by a hash of the chunk.
    """
    spark = chunks.sparkSession
    index = postings(chunks, id_col=id_col, text_col=text_col).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    spread = index.repartition("bucket", F.pmod(F.xxhash64(id_col), F.lit(8))).sortWithinPartitions("bucket", "term", id_col)
    spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.schema(spread.schema).parquet(f"{path}/postings")  # the schema of an empty index can't be read
    document_frequency(stored).write.mode("overwrite").parquet(f"{path}/terms")
    lengths = stored.groupBy(id_col).agg(F.max("doc_len").alias("doc_len"))
    lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_len").alias("total"), F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, *, id_col: str = "chunk_id", query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """(query_id, chunk_id, rank, score): the best k chunks of every query from a stored index, as ``bm25_top`` gives them.
    No text is read; the postings are filtered by the buckets of the asked terms at the scan and joined by term."""
    n_docs, total, buckets = spark.read.parquet(f"{path}/totals").select("n_docs", "total", "buckets").first()
    if not n_docs:
        return queries.select(F.col(query_id).alias("query_id"), F.lit("").alias(id_col), F.lit(1).cast("bigint").alias("rank"), F.lit(0.0).alias("score")).limit(0)
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    raw = F.log((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = materialize(asked.join(spark.read.parquet(f"{path}/terms"), "term").select("query_id", "term", (F.when(raw > 0, raw).otherwise(1e-6) * F.col("qtf")).alias("weight")))
    # at most as many as there are buckets
    wanted = [r[0] for r in weights.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()]
    hits = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(wanted)).select(id_col, "term", "tf", "doc_len")
    norm = F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(float(total) / n_docs))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / norm
    scores = weights.join(hits, "term").groupBy("query_id", id_col).agg(F.round(F.sum(part.cast("decimal(38,15)")), 9).cast("double").alias("score"))
    return top_k(scores, k, query_id="query_id", id_col=id_col)


def hashed_vectors(rows: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text", dims: int = 64) -> DataFrame:
    """(id, embedding): how often a text's tokens fall on each of ``dims`` places, with a sign, both from the token's MD5; for
    texts where no embedding model is at hand. Texts without tokens are left out; ids are expected to be unique."""
    digits = lambda a, n: F.conv(F.substring(F.md5("term"), a, n), 16, 10).cast("int")
    counted = postings(rows, id_col=id_col, text_col=text_col)
    placed = counted.select(id_col, F.pmod(digits(1, 4), F.lit(dims)).alias("at"), (F.col("tf") * (1 - 2 * F.pmod(digits(5, 1), F.lit(2)))).alias("x"))
    return placed.groupBy(id_col).agg(F.array(*[F.sum(F.when(F.col("at") == d, F.col("x")).otherwise(0)).cast("float") for d in range(dims)]).alias("embedding"))


class Best:
    """The best k of each of n queries in a stream of hits: score first, then the lesser id."""

    def __init__(self, k: int, n: int):
        import numpy as np

        self.np, self.k, self.most = np, k, 4 * k * max(1, n) + 10_000
        self.floor = np.full(n, -np.inf)
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, query, score, ids) -> None:
        keep = score >= self.floor[query]
        if keep.any():
            self.parts.append((query[keep], score[keep], ids[keep]))
            self.size += int(keep.sum())
            if self.size > self.most:
                self.rows()

    def rows(self) -> tuple:
        """(query, score, id) kept so far."""
        np = self.np
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        q, s, i = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.floor[q[last]] = s[last]
        keep = place < self.k
        self.parts = [(q[keep], s[keep], i[keep])]
        self.size = int(keep.sum())
        return self.parts[0]


_RUNS = re.compile(r"[a-z0-9_.]+|[一-鿿]+")


def token_list(text: str) -> list[str]:
    """The tokens of ``functions.columns.tokenize``."""
    out: list[str] = []
    for run in _RUNS.findall(text.lower()):
        if run[0] < "一" or len(run) == 1:
            out.append(run)
        else:
            out += [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def bm25_top(chunks: DataFrame, queries: DataFrame, k: int, *, query_id: str = "query_id", query_text: str = "query", block: int = 4096, rows_at_once: int = 512) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best k chunks of every query, as ``bm25_scores`` ranked would give them.

    Terms that all queries share make every chunk a candidate of every query; as rows these pairs would be queries times
    chunks. Here the weights of a block of queries go out as one table (the proven bound of the broadcast), every task
    scores its chunks against the block and keeps its own best k a query over all its batches, which alone are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    asked = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.explode(tokenize(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    mark = "\x00"  # counts the chunks and their tokens in the same pass
    terms = asked.select("term").distinct()
    seen = chunks.select(tokenize(F.col("text")).alias("t")).where(F.size("t") > 0).select(F.size("t").alias("len"), F.explode(F.array_append(F.array_distinct("t"), F.lit(mark))).alias("term"))
    wanted = terms.unionByName(terms.sparkSession.createDataFrame([(mark,)], "term string"))
    stats = materialize(seen.join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("len").alias("total")))
    head = stats.where(F.col("term") == mark).first()
    kind, out_type = chunks.schema["chunk_id"].dataType.simpleString(), to_arrow_type(chunks.schema["chunk_id"].dataType)
    if head is None:
        return queries.sparkSession.createDataFrame([], f"query_id bigint, chunk_id {kind}, score double, rank bigint")
    n_docs, mean = float(head.df), head.total / head.df
    raw = F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(stats, "term").select("query_id", "term", (F.when(raw > 0, raw).otherwise(1e-6) * F.col("qtf")).alias("weight"))
    n_blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(n_blocks):
        rows = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).collect()
        ids = sorted({r.query_id for r in rows})
        at = {q: i for i, q in enumerate(ids)}
        table: dict[str, list[tuple[int, float]]] = {}
        for r in sorted(rows, key=lambda r: (r.term, r.query_id)):
            table.setdefault(r.term, []).append((at[r.query_id], r.weight))
        packed = {t: (np.array([i for i, _ in v]), np.array([w for _, w in v])) for t, v in table.items()}
        shared = chunks.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), packed))

        def run(batches, shared=shared):
            ids, packed = shared.value
            if not len(ids):
                return
            best = Best(k, len(ids))
            for batch in batches:
                names, texts = batch.column(0), batch.column(1).to_pylist()
                for lo in range(0, len(texts), rows_at_once):
                    part = texts[lo : lo + rows_at_once]
                    s = np.zeros((len(part), len(ids)))
                    for i, t in enumerate(part):
                        tokens = token_list(t or "")
                        norm = K1 * (1 - B + B * len(tokens) / mean)
                        counts: dict[str, int] = {}
                        for x in tokens:
                            if x in packed:
                                counts[x] = counts.get(x, 0) + 1
                        for x in sorted(counts):
                            where, w = packed[x]
                            s[i, where] += w * (counts[x] * (K1 + 1) / (counts[x] + norm))
                    s = np.round(s, 9)
                    i, q = np.nonzero((s >= best.floor) & (s > 0))
                    best.add(q, s[i, q], np.array(names.slice(lo, len(part)).to_pylist())[i])
            q, score, name = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(name.tolist(), out_type), pa.array(score)], ["query_id", "chunk_id", "score"])

        one = chunks.select("chunk_id", "text").mapInArrow(run, f"query_id bigint, chunk_id {kind}, score double")
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    ranked = out.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranked.select("query_id", "chunk_id", "rank", F.when(best != 0, F.round(F.col("score") / best, 6)).otherwise(0.0).alias("score"))


def top_k(scores: DataFrame, k: int, *, query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """The best k of each query with rank and score over the best score; ties by id."""
    w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), id_col)
    r = scores.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
    best = F.max("score").over(Window.partitionBy(query_id))
    return r.select(query_id, id_col, F.col("rank").cast("bigint").alias("rank"), F.when(best != 0, F.round(F.col("score") / best, 6)).otherwise(0.0).alias("score"))


def vector_scores(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector", block: int = 4096) -> DataFrame:
    """(query_id, id, score): the best k by cosine of every stated query against all vectors.

    Queries go out in blocks of ``block`` as one matrix, so the broadcast has a proven bound; each task multiplies its rows
    with the matrix and keeps its own best k a query, which alone are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    kind, out_type = vectors.schema[id_col].dataType.simpleString(), to_arrow_type(vectors.schema[id_col].dataType)
    wanted = queries.select(query_id, l2_normalize(F.col(query_vector)).alias("v")).where("v IS NOT NULL")
    n_blocks = max(1, -(-wanted.count() // block))
    out = None
    for b in range(n_blocks):
        part = wanted.where(F.pmod(F.xxhash64(query_id), F.lit(n_blocks)) == b).orderBy(query_id).collect()
        ids = [r[0] for r in part]
        matrix = spark.sparkContext.broadcast((ids, np.array([r[1] for r in part], np.float64).reshape(len(part), -1)))

        def run(batches, matrix=matrix):
            ids, q = matrix.value
            best = Best(k, len(ids))
            for batch in batches:
                col = batch.column(1)
                keep = [i for i, v in enumerate(col.to_pylist()) if v is not None and len(v) == q.shape[1]]
                if not keep or not len(q):
                    continue
                v = np.array([col[i].as_py() for i in keep], np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                s = np.round(q @ (v / np.where(norm == 0, 1, norm)).T, 9)
                rows, cols = np.nonzero(s >= best.floor[:, None])
                if len(rows) > 4 * k * len(q):  # of one batch only its own best count
                    n = min(k, s.shape[1])
                    rows, cols = np.nonzero(s >= np.maximum(best.floor, np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n])[:, None])
                best.add(rows, s[rows, cols], np.array(batch.column(0).to_pylist())[np.array(keep)[cols]])
            rows, score, name = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in rows], pa.int64()), pa.array(name.tolist(), out_type), pa.array(score)], ["query_id", id_col, "score"])

        one = vectors.select(id_col, vector_col).mapInArrow(run, f"query_id bigint, `{id_col}` {kind}, score double")
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_col)
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def rrf_merge(a: DataFrame, b: DataFrame, *, query_id: str = "query_id", id_col: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, rank_a, rank_b): reciprocal ranks of two rankers added, scaled so that first in both is 1."""
    j = a.select(query_id, id_col, F.col("rank").alias("rank_a")).join(b.select(query_id, id_col, F.col("rank").alias("rank_b")), [query_id, id_col], "full_outer")
    one = lambda r: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(r)), F.lit(0.0))
    return j.select(query_id, id_col, F.round((one("rank_a") + one("rank_b")) / F.lit(2.0 / (k + 1)), 9).alias("score"), "rank_a", "rank_b")


def cap_per_document(hits: DataFrame, most: int, k: int, *, query_id: str = "query_id", id_col: str = "chunk_id", doc_col: str = "doc_id") -> DataFrame:
    """At most ``most`` hits of a document, then the best k of a query."""
    order = [F.col("score").desc(), id_col]
    capped = hits.withColumn("in_doc", F.row_number().over(Window.partitionBy(query_id, doc_col).orderBy(*order))).where(F.col("in_doc") <= most)
    return capped.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k).drop("in_doc")
