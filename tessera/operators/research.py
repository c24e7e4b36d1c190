"""Research reports: claims from sections, their place in chunks, and claim queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import compact, grams, jaccard, split_items
from tessera.functions.udfs import sections

# Words of stances, topics of risks, exchange codes.
POSITIVE_RATINGS, NEGATIVE_RATINGS = ("买入", "增持", "推荐", "强烈推荐"), ("卖出", "减持", "回避")
POSITIVE_WORDS, NEGATIVE_WORDS = ("增长", "改善", "提升", "向好", "高增", "超预期"), ("下降", "承压", "低于预期", "风险", "放缓")
RISK_TOPICS = ("政策", "需求", "价格", "竞争", "项目", "汇率", "原材料", "减值", "现金流")
EXCHANGES = {"XSHG": ".SH", "XSHE": ".SZ", "XBSE": ".BJ", "XBEI": ".BJ"}
MIN_OVERLAP = 0.25


def rating_stance(rating: Column) -> Column:
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: rating.contains(w))
    return F.when(has(POSITIVE_RATINGS), "positive").when(has(NEGATIVE_RATINGS), "negative").otherwise("neutral")


def infer_stance(text: Column) -> Column:
    """More words of one kind than of the other."""
    count = lambda words: sum((text.contains(w).cast("int") for w in words), F.lit(0))
    p, n = count(POSITIVE_WORDS), count(NEGATIVE_WORDS)
    return F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")


def risk_topic(text: Column) -> Column:
    out = None
    for t in RISK_TOPICS:
        out = F.when(text.contains(t), t) if out is None else out.when(text.contains(t), t)
    return out.otherwise("风险提示")


def split_authors(authors: Column) -> Column:
    return split_items(authors, "[,，、;/]")


def build_views(reports: DataFrame) -> DataFrame:
    """Report rows with their company id, stance of the rating and ``reject_reason`` (invalid_identity, invalid_date,
    missing_content or null). Both codes of the Beijing exchange are taken."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    suffix = F.create_map(*[F.lit(x) for p in EXCHANGES.items() for x in p])[F.upper(F.trim("exchange_code"))]
    reason = F.when(blank("report_id") | ~F.coalesce(F.trim("sec_code").rlike(r"^\d{6}$"), F.lit(False)) | suffix.isNull(), "invalid_identity").when(F.try_to_date(F.col("publish_date").cast("string"), "yyyy-MM-dd").isNull(), "invalid_date").when(blank("org_name") | blank("title") | blank("abstract"), "missing_content")
    return reports.select("*", F.concat(F.trim("sec_code"), suffix).alias("company_id"), F.concat(F.lit("VIEW-"), F.trim("report_id")).alias("view_id"), split_authors(F.col("author")).alias("authors"), rating_stance(F.coalesce("rating_org", F.lit(""))).alias("rating_stance"), reason.alias("reject_reason"))


# Where risks are split, and what of their ends doesn't count.
RISK_SPLIT = r"[；;。]|[、，,](?=[^0-9])"
RISK_ENDS = r"^[ ：:，,。；;]+|[ ：:，,。；;]+$"


def extract_claims(docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, claim_type, topic, stance, claim_text, source_span, extraction_method, confidence) of reports (id, title, text, and
    where the source has them rating_org and rating_change).

    All in columns: sections as a map, claims as an array of structs, exploded once; of claims of one type with the same text
    the first one counts. Reports are expected to have one row each.
    """
    text, title = F.coalesce(F.trim("text"), F.lit("")), F.coalesce(F.trim("title"), F.lit(""))
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in docs.columns else F.lit(None).cast("string")
    rating, change = given("rating_org"), given("rating_change")
    d = docs.select(id_col, text.alias("text"), title.alias("title"), rating.alias("rating"), change.alias("change"), sections(F.col("text")).alias("s"))
    rating, change, section = F.col("rating"), F.col("change"), lambda *names: F.coalesce(*[F.col("s")[n] for n in names])
    spans = [F.concat(F.lit("维持“"), rating, F.lit("”评级")), F.concat(F.lit('维持"'), rating, F.lit('"评级')), F.concat(rating, F.lit("评级"))]
    rated = F.coalesce(*[F.when(F.contains(F.col("text"), x), x) for x in spans], rating)
    judged = F.coalesce(F.nullif(F.trim(F.regexp_replace(F.col("title"), r"^.*?[：:]\s*", "")), F.lit("")), F.nullif(F.col("title"), F.lit("")))
    forecast, event = section("盈利预测与投资评级", "盈利预测"), section("事件", "事件概述")
    risks = F.slice(F.filter(F.transform(F.split(section("风险提示"), RISK_SPLIT), lambda x: F.regexp_replace(x, RISK_ENDS, "")), lambda x: F.length(x).between(4, 200)), 1, 20)

    def claim(kind: str, topic: Column, stance: Column, said: Column, span: Column, method: str, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("claim_type"), topic.alias("topic"), stance.alias("stance"), F.substring(said, 1, 500).alias("claim_text"), F.substring(span, 1, 1500).alias("source_span"), F.lit(method).alias("extraction_method"), F.lit(confidence).alias("confidence"))

    neutral = F.lit("neutral")
    one = lambda c: F.array_compact(F.array(F.when(c["claim_text"].isNotNull() & c["source_span"].isNotNull(), c)))
    every = F.concat(
        one(claim("investment_rating", F.lit("投资评级"), rating_stance(rating), F.concat(F.coalesce(F.concat(change, F.lit("，")), F.lit("")), rating, F.lit("评级")), rated, "metadata", 1.0)),
        one(claim("earnings_forecast", F.lit("盈利预测"), neutral, compact(forecast), forecast, "section_rule", 1.0)),
        F.coalesce(F.transform(risks, lambda x: claim("risk_opinion", risk_topic(x), F.lit("negative"), x, x, "section_rule", 1.0)), F.array()),
        one(claim("analyst_judgment", F.lit("核心判断"), infer_stance(judged), judged, F.col("title"), "title_rule", 0.9)),
        one(claim("cited_fact", F.lit("研报引用事实"), neutral, compact(event), event, "section_rule", 0.8)),
    )
    key = lambda x: F.concat(x["claim_type"], F.lit("|"), compact(x["claim_text"]))
    keyed = d.select(id_col, every.alias("claims")).withColumn("keys", F.transform("claims", key))
    once = F.filter("claims", lambda x, i: F.array_position(F.col("keys"), key(x)) == i + 1)
    return keyed.select(id_col, F.inline(once))


def locate_chunks(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(claim_id, chunk_id): the first chunk of the claim's document that has its span, else the one with the most bigrams in
    common, at least ``MIN_OVERLAP``; claims without one are left out. claims: claim_id, doc_id, source_span."""
    c = claims.select("claim_id", "doc_id", "source_span", compact(F.col("source_span")).alias("needle")).where("needle <> ''").dropDuplicates(["claim_id"])
    k = chunks.select("doc_id", "chunk_id", "text", compact(F.col("text")).alias("hay")).dropDuplicates(["chunk_id"])
    j = c.join(k, "doc_id")
    inside = F.col("text").contains(F.col("source_span")) | F.col("hay").contains(F.col("needle"))
    score = F.when(inside, F.lit(2.0)).otherwise(F.round(jaccard(F.array_distinct(grams(F.col("needle"))), F.array_distinct(grams(F.col("hay")))), 9))
    best = j.select("claim_id", "chunk_id", score.alias("score")).where(F.col("score") >= MIN_OVERLAP)
    return best.groupBy("claim_id").agg(F.min_by("chunk_id", F.struct(-F.col("score"), F.col("chunk_id"))).alias("chunk_id"), (F.max("score") == 2.0).alias("contained"))


def query_claims(claims: DataFrame, *, company_ids: Sequence[str] | None = None, start: str | None = None, end: str | None = None, institutions: Sequence[str] | None = None, types: Sequence[str] | None = None, topics: Sequence[str] | None = None, cutoff: str | None = None) -> DataFrame:
    q = claims
    for col, values in (("company_id", company_ids), ("institution", institutions), ("claim_type", types)):
        if values:
            q = q.where(F.col(col).isin(list(values)))
    if start:
        q = q.where(F.col("publish_date") >= F.lit(start).cast("date"))
    if end or cutoff:
        q = q.where(F.col("publish_date") <= F.lit(min(x for x in (end, cutoff) if x)).cast("date"))
    if topics:
        q = q.where(F.exists(F.array(*map(F.lit, topics)), lambda t: F.contains(F.col("topic"), t) | F.contains(F.col("claim_text"), t)))
    return q
