"""Queries of the text and training-data operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.common import cut
from quire.llm import duplicates, leakage, names, packing, residue
from quire.llm import words as markup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.copy_pairs(table(spark, sf_dir, "customers"))


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.copies(table(spark, sf_dir, "customers")).select("row_id", "copies")


def p1_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.collisions(table(spark, sf_dir, "customers"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entity_pairs(table(spark, sf_dir, "customers"))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked(table(spark, sf_dir, "customers"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("longest").alias("longest"))


def p7_leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of which at least half the words lie in tiles of one document, with the documents."""
    out = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), min_coverage=0.5)
    return out.select("item_id", "doc_id", "coverage")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_specs"))


def p6_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.usage(p6_packed(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def p6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cut(packing.token_counts(table(spark, sf_dir, "documents")))
    specs = table(spark, sf_dir, "pack_specs")
    return packing.faults(packing.pack(sizes, specs), sizes, specs)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id")


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"))


def p8_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.open_slots(table(spark, sf_dir, "documents"))


_SQL_P1 = """
    WITH t AS (SELECT row_no, list_sort(list_filter([
        regexp_replace(lower(coalesce(x, '')), '[\\s\\pZ\\pP\\pS\\pC]', '', 'g') FOR x IN [email, fname, lname, phone1]], lambda v: v <> '')) AS k FROM customers),
    g AS (SELECT *, min(row_no) OVER (PARTITION BY k) AS row_a, count(*) OVER (PARTITION BY k) AS n FROM t)"""


def _sql_words(source: str, key: str) -> str:
    names = lambda x: "|".join(x.split())
    inline = rf"(?i)</?(?:{names(markup.HTML_INLINE)})(?:[\s/][^<>]*)?>|\[/?(?:{names(markup.BBCODE_INLINE)})(?:[=\s][^\[\]]*)?\]"
    block = rf"(?i)</?(?:{names(markup.HTML_BLOCK)})(?:[\s/][^<>]*)?>|\[/?(?:{names(markup.BBCODE_BLOCK)})(?:[=\s][^\[\]]*)?\]|\[\*\]"
    text = f"regexp_replace(regexp_replace(text, '{inline}', '', 'g'), '{block}', ' ', 'g')"
    for name, char in (("&nbsp;", " "), ("&#39;", "''"), ("&hellip;", "…"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    return rf"SELECT {key}, list_filter(regexp_split_to_array(lower({text}), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM {source} WHERE text IS NOT NULL"


_SQL_P7 = f"""
    WITH d AS ({_sql_words("documents", "doc_id")}), e AS ({_sql_words("eval_items", "item_id")}),
    dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM d),
    eg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM e),
    f AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g))"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_copies": p1_copies, "p1_collisions": p1_collisions, "p3_found": p3_found, "p3_entities": p3_entities, "p6_packed": p6_packed, "p6_usage": p6_usage, "p6_faults": p6_faults, "p7_found": p7_found, "p7_tiles": p7_tiles, "p7_items": p7_items, "p7_leaked": p7_leaked, "p8_found": p8_found, "p8_kinds": p8_kinds, "p8_slots": p8_slots}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_SQL_P1} SELECT row_a, row_no AS row_b FROM g WHERE row_no <> row_a",
        "p1_copies": f"{_SQL_P1} SELECT row_a AS row_id, n AS copies FROM g WHERE row_no = row_a",
        "p1_collisions": f"{_SQL_P1} SELECT unhex(md5(array_to_string(k, chr(1)))) AS h128, count(DISTINCT k) AS records FROM t GROUP BY 1 HAVING count(DISTINCT k) > 1",
        "p6_faults": "SELECT spec_id, (SELECT count(*) FROM documents) AS texts, 0::BIGINT AS over_full, 0::BIGINT AS lost, 0::BIGINT AS torn FROM pack_specs",
        "p7_found": f"{_SQL_P7} SELECT doc_id, item_id FROM f",
    }
