"""Queries of the llm operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.core import nz
from mergeloom.llm.addresses import same_building
from mergeloom.llm.groups import group_records
from mergeloom.llm.linkage import LEGAL_WORDS, Vocabulary, link
from mergeloom.llm.leaks import leaked, without_leaks
from mergeloom.llm.mixing import mix
from mergeloom.llm.spans import shared_share, sharing_classes, sharing_pairs
from mergeloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


# Short forms and synonyms in names of dental offices, and titles that carry no name.
DENTAL = Vocabulary(
    drop=(*LEGAL_WORDS, "dds", "dmd", "maxillofacial"),
    long_forms={
        "fam": "family", "assoc": "associates", "assocs": "associates", "assc": "associates", "ctr": "center", "centre": "center", "grp": "group",
        "ortho": "orthodontics", "perio": "periodontics", "endo": "endodontics", "dent": "dental", "dentist": "dental", "mgmt": "management", "svcs": "services", "pediatrics": "pediatric",
        "srgy": "surgery", "surg": "surgery", "dentistry": "dental", "aesthetic": "cosmetic", "children": "pediatric", "childrens": "pediatric",
    },
)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, source_id, npi, confidence, levels): offices and deal targets with their firms, estimated together."""
    firms = table(spark, sf_dir, "practices").filter(F.col("entity_type").isin("organization", "2"))
    offices = table(spark, sf_dir, "dso_locations").select(
        F.concat(F.lit("dso_locations:"), "id").alias("id"), F.col("location_name").alias("name"), "phone", "address", "city", "state", "zip"
    )
    targets = table(spark, sf_dir, "deals").select(
        F.concat(F.lit("deals:"), "id").alias("id"), F.col("target_name").alias("name"), F.col("target_city").alias("city"),
        F.col("target_state").alias("state"), F.col("target_zip").alias("zip"),
    )
    places = {c: c for c in ("phone", "address", "zip", "city", "state")}
    found = link(
        offices.unionByName(targets, allowMissingColumns=True), {"id": "id", "names": ["name"]} | places,
        firms, {"id": "npi", "names": ["practice_name", "doing_business_as"]} | places, accept=0.4, vocabulary=DENTAL,
    )
    part = F.split("left_id", ":")
    return found.select(part[0].alias("source_table"), part[1].cast("bigint").alias("source_id"), F.col("right_id").alias("npi"), "confidence", "name_level", "phone_level", "address_level", "place_level")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("source_table", "source_id", "npi").distinct()


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their confidence and the agreement of each field."""
    return _matches(spark, sf_dir)


#: Group ids that stand for no group (fixed values of the data).
NO_GROUP = ["n/a", "mc_0000"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = table(spark, sf_dir, "practice_signals").filter("npi is not null")
    records = signals.select("npi").distinct()
    ends = table(spark, sf_dir, "practice_links").select(F.trim("npi_a").alias("u"), F.trim("npi_b").alias("v")).filter("u <> v")
    links = ends.join(records.toDF("u"), "u", "left_semi").join(records.toDF("v"), "v", "left_semi").select("u", "v")
    ids = [signals.select(F.concat(F.lit(f"{c}:"), F.lower(nz(c))).alias("group"), "npi", F.lower(nz(c)).alias("id")) for c in ("stealth_dso_cluster_id", "micro_cluster_id")]
    groups = ids[0].unionByName(ids[1]).filter(F.col("id").isNotNull() & ~F.col("id").isin(NO_GROUP))
    return group_records(links, "u", "v", groups, "group", "npi").toDF("group_npi", "npi")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_building(table(spark, sf_dir, "practices"), "npi", "address", "city", "state", "zip")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items: in how many documents, and the longest run of words found."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left after removing the affected ones."""
    return without_leaks(table(spark, sf_dir, "documents"), "doc_id", _leaks(spark, sf_dir)).select("doc_id", "source", "n_chars")


#: Domains of the sources, the upper level of the mixing tree.
DOMAINS = {
    "gdn": "deals", "pesp": "deals", "beckers": "deals", "press_wire": "deals", "newsletter": "deals", "dossier": "research",
    "zip_overview": "research", "registry_note": "research", "website": "web", "job_board": "web",
}


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source", table(spark, sf_dir, "mix_targets"), DOMAINS)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharing_pairs(table(spark, sf_dir, "documents"), "doc_id", "text", 240)


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_share(table(spark, sf_dir, "documents"), "doc_id", "text", 240)


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of documents with a stretch in common, as membership."""
    return sharing_classes(table(spark, sf_dir, "documents"), "doc_id", "text", 240)


def queries() -> dict[str, Query]:
    return {
        "p3_found": p3_found,
        "p3_matches": p3_matches,
        "p5_found": p5_found,
        "p6_found": p6_found,
        "p8_found": p8_found,
        "p8_items": p8_items,
        "p8_clean": p8_clean,
        "p9_mix": p9_mix,
        "p9_shares": p9_shares,
        "p10_found": p10_found,
        "p10_shared": p10_shared,
        "p10_classes": p10_classes,
    }


_P5_SQL = """with recursive s as (select distinct npi from practice_signals where npi is not null),
 k as (select 's' || lower(trim(stealth_dso_cluster_id)) g, npi from practice_signals where lower(trim(coalesce(stealth_dso_cluster_id, ''))) not in ('', 'n/a', 'mc_0000') union select 'm' || lower(trim(micro_cluster_id)), npi from practice_signals where lower(trim(coalesce(micro_cluster_id, ''))) not in ('', 'n/a', 'mc_0000')),
 m as (select g, min(npi) a from k group by 1), e as (select trim(npi_a) a, trim(npi_b) b from practice_links where trim(npi_a) in (select npi from s) and trim(npi_b) in (select npi from s) union select m.a, k.npi from k join m using (g)),
 f as (select a, b from e where a <> b union select b, a from e where a <> b), r(v, c) as (select a, a from f union select f.b, r.c from r join f on r.v = f.a)
select min(c) group_npi, v npi from r group by v"""

_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_GRAMS = "select {1} id, array_to_string(w[i : i + 11], ' ') g from (select {1}, " + _WORDS + " w from {2}), unnest(range(1, len(w) - 10)) t(i)"
_LEAKS = f"with d as ({_GRAMS.format('text', 'doc_id', 'documents')}), q as ({_GRAMS.format('text', 'item_id', 'eval_items')}), l as (select distinct d.id doc_id, q.id item_id from d join q using (g)) "

#: Runs of item words in a document: places of common 12-word passages that go on together.
_RUNS = _LEAKS[: _LEAKS.index(", l as")].replace(" id, array_to_string", " id, i, array_to_string") + """, m as (select d.id doc_id, q.id item_id, d.i, d.i - q.i diagonal from d join q using (g)),
 s as (select *, i - row_number() over (partition by doc_id, item_id, diagonal order by i) island from m), r as (select doc_id, item_id, count(*) + 11 n_words from s group by doc_id, item_id, diagonal, island) """

_WINDOWS = """with w as (select distinct doc_id, i, hash(substr(text, i, 240)) h from documents, unnest(range(1, length(text) - 238)) t(i)), r as (select h from w group by 1 having min(doc_id) <> max(doc_id)), k as (select doc_id, i, h from w semi join r using (h)) """


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that have an exact result and a short one; p3, p6, p9 and the rest of p10 are tested against planted cases and brute force."""
    return {
        "p5_found": _P5_SQL,
        "p8_found": _LEAKS + "select doc_id, item_id from l",
        "p8_items": _RUNS + "select item_id, count(distinct doc_id) n_docs, max(n_words) longest from r group by item_id",
        "p8_clean": _LEAKS + "select doc_id, source, n_chars from documents where doc_id not in (select doc_id from l)",
        "p10_found": _WINDOWS + "select distinct a.doc_id doc_id_a, b.doc_id doc_id_b from k a join k b on a.h = b.h where a.doc_id < b.doc_id",
    }
