"""Queries over research claims and over names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import legal_core_name, normalize_name
from tessera.operators import entities as ent
from tessera.operators import research as res
from tessera.functions.udfs import SECTION_LABELS
from tessera.session import table


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "research_claims").dropDuplicates(["claim_id"])


def res_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with their report's title: a lookup of many claims in one document each."""
    q = res.query_claims(_claims(spark, sf), start="2021-01-01", end="2022-12-31", types=["risk_opinion", "earnings_forecast"], topics=["需求", "价格"])
    d = table(spark, sf, "documents").select(F.col("document_id").alias("source_document_id"), "title")
    return q.join(d, "source_document_id", "left").select("claim_id", "company_id", "institution", "publish_date", "title")


def res_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest 50 claims, as the operation returns them."""
    return _claims(spark, sf).orderBy(F.col("publish_date").desc(), "claim_id").limit(50).select("claim_id", "publish_date")


def res_types(spark: SparkSession, sf: str) -> DataFrame:
    return _claims(spark, sf).groupBy("company_id", "claim_type", "stance").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def res_stances(spark: SparkSession, sf: str) -> DataFrame:
    """Stance and topic by the words of the claim."""
    c = F.col("claim_text")
    return _claims(spark, sf).select("claim_id", res.infer_stance(c).alias("word_stance"), res.risk_topic(c).alias("word_topic"))


def res_located(spark: SparkSession, sf: str) -> DataFrame:
    c = _claims(spark, sf).select("claim_id", F.regexp_extract("source_document_id", r"(\d+)$", 1).cast("bigint").alias("doc_id"), "source_span")
    return res.locate_chunks(c, table(spark, sf, "chunks").select("doc_id", "chunk_id", "text"))


def res_extracted(spark: SparkSession, sf: str) -> DataFrame:
    return res.extract_claims(table(spark, sf, "documents").where("document_type = 'research_report'").select("doc_id", "title", "text"))


def ent_universe(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    return ent.company_universe(
        (t("listed_company_entities"), "companies", "company_id", "canonical_name", None),
        (t("financial_metrics"), "financial", "company_id", None, "announcement_date"),
        (t("holder_records"), "holders", "target_company_id", None, "announcement_date"),
        (t("event_records"), "events", "company_id", None, "announcement_date"),
        (t("research_claims"), "research", "company_id", None, "publish_date"),
        (t("documents"), "documents", "company_id", None, "published_date"),
    )


def _alias_index(spark: SparkSession, sf: str) -> DataFrame:
    return ent.alias_index(table(spark, sf, "listed_company_entities"), table(spark, sf, "entity_aliases"), table(spark, sf, "documents").select("company_id", "title"))


def ent_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return _alias_index(spark, sf)


def ent_normalized(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "entity_aliases").select("alias").distinct()
    return a.select("alias", normalize_name(F.col("alias")).alias("normal"), legal_core_name(F.col("alias")).alias("core"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    holders = table(spark, sf, "holder_entities").where("entity_type = 'COMPANY'").select("holder_entity_id", "name")
    companies = table(spark, sf, "listed_company_entities").select("company_id", F.col("canonical_name").alias("name"), F.lit(False).alias("is_legal"))
    stated = table(spark, sf, "entity_aliases").where("alias_type IN ('LEGAL_NAME', 'SECURITY_NAME')").join(companies.select(F.col("company_id").alias("entity_id")), "entity_id", "left_semi").select(F.col("entity_id").alias("company_id"), F.col("alias").alias("name"), (F.col("alias_type") == "LEGAL_NAME").alias("is_legal"))
    return ent.link_holders(holders, companies.unionByName(stated))


def ent_links(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf)


def ent_methods(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).groupBy("match_method").agg(F.count(F.lit(1)).alias("n"))


def ent_audit(spark: SparkSession, sf: str) -> DataFrame:
    holders = table(spark, sf, "holder_entities").where("entity_type = 'COMPANY'").select("holder_entity_id", "name")
    companies = table(spark, sf, "listed_company_entities").select("company_id", F.col("canonical_name").alias("name"))
    aliases = table(spark, sf, "entity_aliases")
    every = lambda names, i: names.unionByName(aliases.select(F.col("entity_id").alias(i), F.col("alias").alias("name")).join(names.select(i), i, "left_semi")).distinct()
    return ent.audit_unlinked(every(holders, "holder_entity_id"), every(companies, "company_id"), _links(spark, sf).where("linked"))


def ent_resolved(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "documents").select(F.split("title", "[:：]")[0].alias("term")).where("term <> ''").union(table(spark, sf, "listed_company_entities").select(F.split("company_id", r"\.")[0]))
    return ent.resolve_companies(terms, _alias_index(spark, sf))


def ent_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Names of listed companies in questions."""
    q = table(spark, sf, "evaluation_cases").select("case_id", "question").distinct()
    names = _alias_index(spark, sf).select("alias")
    return ent.names_in_texts(q, names, id_col="case_id", text_col="question")


_C = "c AS (SELECT DISTINCT ON (claim_id) * FROM research_claims)"


def _count(words) -> str:
    return " + ".join(f"CAST(contains(claim_text, '{w}') AS INT)" for w in words)


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + " "


def _norm(c: str) -> str:
    return f"translate(regexp_replace(upper(translate(coalesce({c}, ''), '{_WIDE}', '{_NARROW}')), '\\s', '', 'g'), '·•・,，。.:：;；()（）[]【】', '')"


_SUFFIX = "(集团股份有限公司|股份有限公司|集团有限公司|有限责任公司|有限公司|股份公司)"


def _core(c: str) -> str:
    return f"CASE WHEN regexp_matches({_norm(c)}, '.{_SUFFIX}$') THEN regexp_replace({_norm(c)}, '^(.+?){_SUFFIX}$', '\\1') ELSE {_norm(c)} END"


_LINKS = f"""WITH h AS (SELECT DISTINCT holder_entity_id, {_norm("name")} AS norm, {_core("name")} AS core FROM holder_entities WHERE entity_type = 'COMPANY' AND {_norm("name")} <> ''),
names AS (SELECT company_id, canonical_name AS name, false AS is_legal FROM listed_company_entities UNION SELECT entity_id, alias, alias_type = 'LEGAL_NAME' FROM entity_aliases WHERE alias_type IN ('LEGAL_NAME', 'SECURITY_NAME') AND entity_id IN (SELECT company_id FROM listed_company_entities)),
c AS (SELECT DISTINCT company_id, is_legal, {_norm("name")} AS norm, {_core("name")} AS core FROM names WHERE {_norm("name")} <> ''),
l0 AS (SELECT DISTINCT holder_entity_id, company_id FROM h JOIN c USING (norm) WHERE is_legal), l AS (SELECT *, count(*) OVER (PARTITION BY holder_entity_id) AS n FROM l0),
r1 AS (SELECT * FROM h WHERE holder_entity_id NOT IN (SELECT holder_entity_id FROM l)),
x0 AS (SELECT DISTINCT holder_entity_id, company_id FROM r1 JOIN c USING (norm)), x AS (SELECT *, count(*) OVER (PARTITION BY holder_entity_id) AS n FROM x0),
r2 AS (SELECT * FROM r1 WHERE holder_entity_id NOT IN (SELECT holder_entity_id FROM x)),
oc AS (SELECT core, count(DISTINCT company_id) AS nc, min(company_id) AS sole FROM c GROUP BY 1), oh AS (SELECT core, count(DISTINCT holder_entity_id) AS nh FROM h GROUP BY 1),
u AS (SELECT holder_entity_id, min(sole) AS company_id FROM r2 JOIN oc USING (core) JOIN oh USING (core) WHERE nc = 1 AND nh = 1 GROUP BY 1 HAVING count(DISTINCT sole) = 1),
v AS (SELECT DISTINCT holder_entity_id, company_id FROM r2 JOIN c USING (core) WHERE holder_entity_id NOT IN (SELECT holder_entity_id FROM u)),
links AS (SELECT holder_entity_id, company_id, CASE WHEN n = 1 THEN 'exact_legal_name' ELSE 'ambiguous_exact_legal_name' END AS match_method, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.7 END AS confidence, n = 1 AS linked FROM l
UNION ALL SELECT holder_entity_id, company_id, CASE WHEN n = 1 THEN 'exact_normalized_name' ELSE 'ambiguous_exact_normalized_name' END, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.6 END, n = 1 FROM x
UNION ALL SELECT holder_entity_id, company_id, 'unique_legal_core', 0.95, true FROM u UNION ALL SELECT holder_entity_id, company_id, 'ambiguous_legal_core', 0.5, false FROM v)"""
_ALIAS = r"""WITH al AS (SELECT alias, company_id, min(source) AS s FROM (
  SELECT upper(regexp_replace(canonical_name, '\s', '', 'g')) AS alias, company_id, '0 company_profile' AS source FROM listed_company_entities UNION ALL SELECT company_id, company_id, '1 code' FROM listed_company_entities
  UNION ALL SELECT upper(regexp_replace(alias, '\s', '', 'g')), entity_id, '2 ' || source FROM entity_aliases WHERE entity_id IN (SELECT company_id FROM listed_company_entities)
  UNION ALL SELECT upper(regexp_replace(h, '\s', '', 'g')), company_id, '3 title' FROM (SELECT company_id, trim(regexp_extract(title, '^([^:：]*)[:：]', 1)) AS h FROM documents) WHERE length(h) BETWEEN 2 AND 12 AND regexp_matches(h, '[一-鿿]') AND company_id IS NOT NULL)
  WHERE alias <> '' GROUP BY 1, 2)"""
_KEY = r"CASE WHEN regexp_matches(upper(trim(term)), '^6\d{5}$') THEN upper(trim(term)) || '.SH' WHEN regexp_matches(upper(trim(term)), '^[03]\d{5}$') THEN upper(trim(term)) || '.SZ' WHEN regexp_matches(upper(trim(term)), '^[489]\d{5}$') THEN upper(trim(term)) || '.BJ' WHEN regexp_matches(upper(trim(term)), '^\d{6}\.(SH|SZ|BJ)$') THEN upper(trim(term)) ELSE upper(regexp_replace(term, '\s', '', 'g')) END"

_LABELS = "|".join(SECTION_LABELS)


def _grams(c: str) -> str:
    return f"list_distinct(list_transform(generate_series(1, greatest(length({c}) - 1, 1)), lambda i: substr({c}, i, 2)))"


def _one(kind: str, topic: str, stance: str, said: str, span: str, method: str, confidence: str, n: int) -> str:
    return f"SELECT doc_id, {n} AS n, '{kind}' AS claim_type, {topic} AS topic, {stance} AS stance, {said} AS said, {span} AS span, '{method}' AS extraction_method, {confidence}::DOUBLE AS confidence FROM f"


def _words(words: tuple[str, ...], col: str) -> str:
    return " + ".join(f"CAST(contains({col}, '{w}') AS INT)" for w in words)


_EXTRACTED = f"""WITH d AS (SELECT doc_id, coalesce(trim(text, ' '), '') AS text, coalesce(trim(title, ' '), '') AS title FROM documents WHERE document_type = 'research_report'),
p AS (SELECT *, string_split(regexp_replace(text, '({_LABELS})\\s*[：:]', chr(1) || '\\1' || chr(2), 'g'), chr(1))[2:] AS parts FROM d),
s AS (SELECT doc_id, k, string_split(parts[k], chr(2))[1] AS label, regexp_replace(string_split(parts[k], chr(2))[2], '^[\\s\\x{{3000}}\\x{{a0}}]+|[\\s\\x{{3000}}\\x{{a0}}]+$', '', 'g') AS body FROM p, generate_series(1, len(parts)) AS g(k)),
first AS (SELECT DISTINCT ON (doc_id, label) doc_id, label, body FROM s WHERE body <> '' ORDER BY doc_id, label, k),
m AS (SELECT doc_id, map(list(label), list(body)) AS sec FROM first GROUP BY doc_id),
f AS (SELECT d.doc_id, d.title, coalesce(sec['盈利预测与投资评级'], sec['盈利预测']) AS forecast, coalesce(sec['事件'], sec['事件概述']) AS event, sec['风险提示'] AS risk,
  coalesce(nullif(trim(regexp_replace(d.title, '^.*?[：:]\\s*', ''), ' '), ''), nullif(d.title, '')) AS judged FROM d LEFT JOIN m USING (doc_id)),
ri AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(risk, '[；;。]', chr(1), 'g'), '[、，,]([^0-9])', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_replace(x, '^[ ：:，,。；;]+|[ ：:，,。；;]+$', '', 'g')), lambda x: length(x) BETWEEN 4 AND 200)[1:20] AS items FROM f),
rr AS (SELECT doc_id, 100 + k AS n, items[k] AS said FROM ri, generate_series(1, len(items)) AS g(k)),
c AS ({_one("earnings_forecast", "'盈利预测'", "'neutral'", "regexp_replace(forecast, '\\s+', '', 'g')", "forecast", "section_rule", "1.0", 1)}
UNION ALL SELECT doc_id, n, 'risk_opinion', {" ".join(["CASE", *[f"WHEN contains(said, '{t}') THEN '{t}'" for t in res.RISK_TOPICS], "ELSE '风险提示' END"])}, 'negative', said, said, 'section_rule', 1.0::DOUBLE FROM rr
UNION ALL {_one("analyst_judgment", "'核心判断'", f"CASE WHEN {_words(res.POSITIVE_WORDS, 'judged')} > {_words(res.NEGATIVE_WORDS, 'judged')} THEN 'positive' WHEN {_words(res.NEGATIVE_WORDS, 'judged')} > {_words(res.POSITIVE_WORDS, 'judged')} THEN 'negative' ELSE 'neutral' END", "judged", "title", "title_rule", "0.9", 200)}
UNION ALL {_one("cited_fact", "'研报引用事实'", "'neutral'", "regexp_replace(event, '\\s+', '', 'g')", "event", "section_rule", "0.8", 201)})
SELECT DISTINCT ON (doc_id, claim_type, key) doc_id, claim_type, topic, stance, claim_text, source_span, extraction_method, confidence
FROM (SELECT *, substr(said, 1, 500) AS claim_text, substr(span, 1, 1500) AS source_span, regexp_replace(substr(said, 1, 500), '\\s+', '', 'g') AS key FROM c WHERE said IS NOT NULL AND span IS NOT NULL) ORDER BY doc_id, claim_type, key, n"""

SQL = {
    "res_located": f"""WITH {_C}, n AS (SELECT claim_id, CAST(nullif(regexp_extract(source_document_id, '(\\d+)$', 1), '') AS BIGINT) AS doc_id, source_span, regexp_replace(coalesce(source_span, ''), '\\s+', '', 'g') AS needle FROM c),
k AS (SELECT DISTINCT ON (chunk_id) doc_id, chunk_id, text, regexp_replace(coalesce(text, ''), '\\s+', '', 'g') AS hay FROM chunks),
j AS (SELECT claim_id, chunk_id, contains(text, source_span) OR contains(hay, needle) AS inside, {_grams("needle")} AS a, {_grams("hay")} AS b FROM n JOIN k USING (doc_id) WHERE needle <> ''),
s AS (SELECT claim_id, chunk_id, CASE WHEN inside THEN 2.0 ELSE round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 9) END AS score FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, chunk_id) AS rn FROM s WHERE score >= {res.MIN_OVERLAP})
SELECT claim_id, chunk_id, score = 2.0 AS contained FROM r WHERE rn = 1""",
    "res_extracted": _EXTRACTED,
    "res_claims": f"WITH {_C} SELECT claim_id, c.company_id, institution, publish_date, title FROM c LEFT JOIN documents d ON d.document_id = c.source_document_id WHERE publish_date BETWEEN DATE '2021-01-01' AND DATE '2022-12-31' AND claim_type IN ('risk_opinion', 'earnings_forecast') AND (contains(topic, '需求') OR contains(topic, '价格') OR contains(claim_text, '需求') OR contains(claim_text, '价格'))",
    "res_latest": f"WITH {_C} SELECT claim_id, publish_date FROM c ORDER BY publish_date DESC, claim_id LIMIT 50",
    "res_types": f"WITH {_C} SELECT company_id, claim_type, stance, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM c GROUP BY 1, 2, 3",
    "res_stances": f"""WITH {_C}, s AS (SELECT claim_id, {_count(res.POSITIVE_WORDS)} AS p, {_count(res.NEGATIVE_WORDS)} AS m, claim_text FROM c)
SELECT claim_id, CASE WHEN p > m THEN 'positive' WHEN m > p THEN 'negative' ELSE 'neutral' END AS word_stance, CASE {" ".join(f"WHEN contains(claim_text, '{t}') THEN '{t}'" for t in res.RISK_TOPICS)} ELSE '风险提示' END AS word_topic FROM s""",
    "ent_universe": r"""WITH u AS (SELECT company_id AS id, 'companies' AS source, canonical_name AS name, CAST(NULL AS DATE) AS day FROM listed_company_entities UNION ALL SELECT company_id, 'financial', NULL, announcement_date FROM financial_metrics UNION ALL SELECT target_company_id, 'holders', NULL, announcement_date FROM holder_records
UNION ALL SELECT company_id, 'events', NULL, announcement_date FROM event_records UNION ALL SELECT company_id, 'research', NULL, publish_date FROM research_claims UNION ALL SELECT company_id, 'documents', NULL, published_date FROM documents),
k AS (SELECT upper(trim(id)) AS company_id, source, name, day FROM u WHERE trim(id) <> '')
SELECT company_id, CASE WHEN regexp_matches(company_id, '^(6\d{5}\.SH|[03]\d{5}\.SZ|[489]\d{5}\.BJ)$') THEN 'a_share' WHEN regexp_matches(company_id, '^\d{6}\.(SH|SZ|BJ)$') THEN 'exchange_mismatch' ELSE 'nonstandard' END AS code_class,
  array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(DISTINCT name) AS n_names, min(day) AS first_date, max(day) AS last_date FROM k GROUP BY 1""",
    "ent_aliases": _ALIAS + " SELECT alias, company_id, substr(s, 3) AS source FROM al",
    "ent_normalized": f"SELECT DISTINCT alias, {_norm('alias')} AS normal, {_core('alias')} AS core FROM entity_aliases",
    "ent_links": _LINKS + " SELECT * FROM links",
    "ent_methods": _LINKS + " SELECT match_method, count(*) AS n FROM links GROUP BY 1",
    "ent_resolved": _ALIAS
    + rf""", t AS (SELECT DISTINCT term FROM (SELECT regexp_split_to_array(title, '[:：]')[1] AS term FROM documents UNION SELECT split_part(company_id, '.', 1) FROM listed_company_entities) WHERE term <> ''),
g AS (SELECT term, count(DISTINCT company_id) AS n, min(company_id) AS id FROM t JOIN al ON alias = {_KEY} GROUP BY 1)
SELECT term, CASE WHEN n = 1 THEN id END AS company_id, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM t LEFT JOIN g USING (term)""",
}
QUERIES = {k: globals()[k] for k in [*SQL, "ent_audit", "ent_mentions"]}
