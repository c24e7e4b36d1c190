"""Queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.leakage import leaked_documents, remove_leaks, stock_wording
from tessera.llm.lexicon import learn
from tessera.llm.matching import _entities, accepted, match_entities
from tessera.llm.names import Lexicon
from tessera.llm.packing import CAPACITY, pack_documents
from tessera.llm.pii import find_pii, pii_counts, redact
from tessera.llm.variants import gazetteer, link_variants, variant_pairs
from tessera.session import table


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How well the containers are filled."""
    by = pack_documents(table(spark, sf, "documents")).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return by.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count(F.lit(1)) * CAPACITY), 6).alias("fill_rate"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_documents(table(spark, sf, "documents"), table(spark, sf, "heldout_items"))


def p7_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return remove_leaks(table(spark, sf, "documents"), table(spark, sf, "heldout_items"))


def p7_stock(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of held-out passages that count as stock wording."""
    return stock_wording(table(spark, sf, "documents"), table(spark, sf, "heldout_items"))


def _lexicon(spark: SparkSession, sf: str) -> Lexicon:
    """Places and words of the organisations' names in the tables of entities."""
    companies, holders = table(spark, sf, "listed_company_entities"), table(spark, sf, "holder_entities")
    places = gazetteer(holders.select("registered_place"), companies.select("registered_place"))
    names = companies.select(F.col("company_id").alias("id"), F.col("canonical_name").alias("name"))
    names = names.union(holders.where("entity_type = 'COMPANY'").select("holder_entity_id", "name")).union(table(spark, sf, "entity_aliases").select("entity_id", "alias"))
    return learn(names, places)


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    aliases = table(spark, sf, "entity_aliases").select("entity_id", "alias").distinct()
    attributes = {"place": "registered_place", "since": "established_on", "person": "legal_representative"}
    companies = _entities(table(spark, sf, "listed_company_entities"), "company_id", ["canonical_name"], aliases, **attributes)
    holders = _entities(table(spark, sf, "holder_entities").where("entity_type = 'COMPANY'"), "holder_entity_id", ["name"], aliases, **attributes)
    return match_entities(companies, holders, _lexicon(spark, sf))


def p1_confidences(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate pair with its marginal."""
    return _matches(spark, sf).select("company_id", "holder_entity_id", F.round("confidence", 4).alias("confidence"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(_matches(spark, sf), "NOT contains(holder_entity_id, '_UNRESOLVED:')").select("company_id", "holder_entity_id")


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    return link_variants(
        table(spark, sf, "holder_records"),
        id_col="holder_entity_id",
        name_cols=["holder_name", "holder_aname"],
        person="holder_category = 'PERSON'",
        scope="target_company_id",
        list_cols=["holder_end_date", "announcement_date"],
        ratio="holding_ratio",
        lexicon=_lexicon(spark, sf),
        aliases=table(spark, sf, "entity_aliases").select("entity_id", "alias"),
        coded="NOT contains(id, '_UNRESOLVED:')",
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return variant_pairs(_variants(spark, sf))


def p5_entities(spark: SparkSession, sf: str) -> DataFrame:
    """One row per id and scope with its class and the number of ids in it."""
    c = _variants(spark, sf).select("scope", "person", "id", "component").distinct()
    size = c.groupBy("component").agg(F.count(F.lit(1)).alias("n_ids"))
    return c.join(size, "component").select("scope", "person", F.col("id").alias("holder_entity_id"), F.col("component").alias("entity_class"), "n_ids")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_pii(table(spark, sf, "documents")).select("doc_id", "pii_type", "char_start")


def p8_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redact(table(spark, sf, "documents"))


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pii_counts(find_pii(table(spark, sf, "documents")))


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted, "p8_counts": p8_counts, "p1_found": p1_found, "p1_confidences": p1_confidences, "p5_found": p5_found, "p5_entities": p5_entities, "p6_containers": p6_containers, "p6_fill": p6_fill, "p7_found": p7_found, "p7_cleaned": p7_cleaned, "p7_stock": p7_stock}
SQL: dict[str, str] = {}
