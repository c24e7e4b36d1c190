"""Documents: union of sources with reasons of rejection, quality counters, estimates and texts for embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import CJK, clean_tags, clean_text
from tessera.session import materialize, parallelism

MIN_TEXT = 50


def reject_reason(doc_id: Column, title: Column, day: Column, text: Column, least: int = MIN_TEXT) -> Column:
    """The first check that fails, or null."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return F.when(doc_id.isNull(), "missing_id").when(blank(title), "missing_title").when(day.isNull(), "invalid_date").when(blank(text), "missing_text").when(F.length(clean_text(text)) < least, "text_too_short")


def build_documents(*sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): cleaned rows of all sources (document_id, document_type, company_id, title, published_date, tags,
    text) and the others with their reason. An id given twice is kept once, the least row by content."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    marked = rows.withColumn("reason", reject_reason(F.col("document_id"), F.col("title"), F.col("published_date"), F.col("text")))
    good = marked.where("reason IS NULL").drop("reason").withColumns({"text": clean_text(F.col("text")), "title": clean_text(F.col("title")), "tags": F.coalesce(clean_tags(F.col("tags")), F.array().cast("array<string>"))})
    w = Window.partitionBy("document_id").orderBy(F.xxhash64("title", "text"))
    return good.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n"), marked.where("reason IS NOT NULL")


def length_summary(rows: DataFrame, length: Column, *groups: str) -> DataFrame:
    """count, min, p50, p95, max and mean of a length per group; a percentile is the element at round-half-even((n - 1) f).

    The element is found from counts per length, which are as few as there are lengths.
    """
    counts = rows.select(*groups, length.cast("bigint").alias("x")).where("x IS NOT NULL").groupBy(*groups, "x").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*groups).orderBy("x")
    c = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*groups)))
    at = lambda f: F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * F.lit(f)), F.col("x")))
    return c.groupBy(*groups).agg(F.max("n").alias("n"), F.min("x").alias("min_len"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("x").alias("max_len"), F.round(F.sum(F.col("x") * F.col("c")) / F.max("n"), 1).alias("mean_len"))


def corpus_estimate(rows: DataFrame, text: Column, *groups: str) -> DataFrame:
    """Characters by class and a range of token estimates per group."""
    cjk, latin = F.regexp_count(text, F.lit(f"[{CJK}]")), F.regexp_count(text, F.lit("[A-Za-z0-9]"))
    agg = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.length(text)).alias("n_chars"), F.max(F.length(text)).alias("longest"), F.sum(cjk).alias("n_cjk"), F.sum(latin).alias("n_latin"))
    other = F.col("n_chars") - F.col("n_cjk") - F.col("n_latin")
    est = lambda a, b, c: F.ceil(F.round(F.col("n_cjk") * a + F.col("n_latin") * b + other * c, 6)).cast("bigint")
    return agg.select("*", est(0.6, 0.2, 0.2).alias("tokens_low"), est(1.0, 0.25, 0.5).alias("tokens_mid"), est(1.5, 0.4, 1.0).alias("tokens_high"))


def embedding_text(kind: Column, company: Column, title: Column, section: Column, body: Column) -> Column:
    """Labelled header lines and the body; absent parts leave no line."""
    line = lambda label, c: F.when(c.isNotNull() & (F.trim(c) != ""), F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("\n", line("type", kind), line("company", company), line("title", title), line("section", section), body)


def filename_metadata(path: Column) -> Column:
    """company, date and type of a path ``.../company_date_type.ext``; a part that is absent comes from the parent folder or
    is 1970-01-01 (date) or unknown."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    parent = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    parts = F.split(stem, "_")
    day = F.try_to_date(F.try_element_at(parts, F.lit(2)), "yyyy-MM-dd")
    company = F.when(F.size(parts) >= 2, parts[0]).otherwise(F.nullif(parent, F.lit("")))
    return F.struct(company.alias("company_id"), F.coalesce(day, F.lit("1970-01-01").cast("date")).alias("published_date"), F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("unknown")).alias("document_type"))


# --- the stored corpus --------------------------------------------------------------------------------------------

def dense_index(rows: DataFrame, key: str, out: str = "vector_row") -> DataFrame:
    """``rows`` numbered from 0 without gaps in the order of a unique key.

    Rows are split into ranges of the key and written; the ranges' sizes (as many rows as there are partitions) give each
    range its first number, so no task numbers all rows. Rows with a null key come first, equal keys in any order.
    """
    ranged = materialize(rows.repartitionByRange(parallelism(rows.sparkSession), key).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    first = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__p").orderBy(F.col(key).asc_nulls_first()))
    return ranged.join(F.broadcast(first), "__p").withColumn(out, F.col("__first") + within - 1).drop("__p", "__first")


def corpus_store(chunks: DataFrame, documents: DataFrame, *, doc_col: str = "doc_id") -> DataFrame:
    """Chunks with what is known of their documents and a dense ``vector_row`` by chunk_id. Repeated chunks count once; those
    without a document are left out; columns that both sides have are the chunk's."""
    once = chunks.where("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"])
    extra = [c for c in documents.columns if c == doc_col or c not in chunks.columns]
    return dense_index(once.join(documents.select(*extra).dropDuplicates([doc_col]), doc_col), "chunk_id")


def check_store(store: DataFrame) -> DataFrame:
    """One row: chunks, distinct vector rows, the greatest one, and whether they are the numbers from 0 on."""
    a = store.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("vector_row").alias("n_rows"), F.max("vector_row").alias("last_row"))
    return a.withColumn("dense", (F.col("n_chunks") == F.col("n_rows")) & (F.coalesce("last_row", F.lit(-1)) == F.col("n_chunks") - 1))


def index_coverage(wanted: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """One row: keys wanted, keys of them that the index has, those it lacks, the share, and a warning where some lack."""
    both = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(indexed.select(key, F.lit(1).alias("__in")).distinct(), key, "left")
    a = both.agg(F.count(F.lit(1)).alias("n_wanted"), F.count("__in").alias("n_indexed"))
    a = a.withColumn("n_missing", F.col("n_wanted") - F.col("n_indexed")).withColumn("coverage", F.when(F.col("n_wanted") > 0, F.round(F.col("n_indexed") / F.col("n_wanted"), 6)))
    return a.withColumn("warning", F.when(F.col("n_missing") > 0, F.concat(F.col("n_missing").cast("string"), F.lit(" of "), F.col("n_wanted").cast("string"), F.lit(" are not in the index"))))


def check_embedding(manifest: dict, *, model: str, dimension: int, mode: str | None = None) -> None:
    """Refuse queries whose embedding isn't the index's; what the manifest doesn't state isn't checked."""
    for name, stated, given in (("model", manifest.get("model"), model), ("dimension", manifest.get("dimension"), dimension), ("api_mode", manifest.get("api_mode"), mode)):
        if stated and given and str(stated) != str(given):
            raise ValueError(f"embedding {name} {given!r} isn't the index's {stated!r}")
