"""Queries of the general data-copy, history, snapshot and spatial operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.core import digits, zip5
from mergeloom.operators.history import value_history
from mergeloom.operators.reconcile import count_mismatches, diff_copies
from mergeloom.operators.snapshots import changed_values, snapshot_changes
from mergeloom.operators.spatial import near_pairs
from mergeloom.plans.registry import query
from mergeloom.session import table

COPY_FIELDS = [
    "practice_name", "doing_business_as", "address", "city", "state", "zip", "phone", "ownership_status", "affiliated_dso",
    "estimated_revenue", "buyability_score", "last_updated",
]


_TEXTS = ["practice_name", "doing_business_as", "address", "city", "state", "zip", "phone", "ownership_status", "affiliated_dso"]
_PAIR = "(select * replace (trim(npi) as npi) from practices where nullif(trim(npi),'') is not null) a join (select * replace (trim(npi) as npi) from practices_replica where nullif(trim(npi),'') is not null) b using (npi)"
P1_FOUND_SQL = " union ".join(
    [f"select npi record_key, 'differs' diff_kind, '{f}' field_name from {_PAIR} where nullif(trim(a.{f}),'') is distinct from nullif(trim(b.{f}),'')" for f in _TEXTS]
    + [f"select npi, 'differs', '{f}' from {_PAIR} where (a.{f} is null) <> (b.{f} is null) or abs(a.{f} - b.{f}) > 0.000001" for f in ("estimated_revenue", "buyability_score")]
    + [
        f"select npi, 'differs', 'last_updated' from {_PAIR} where a.last_updated is distinct from b.last_updated",
        "select trim(npi), 'missing_in_replica', '' from practices where trim(npi) not in (select trim(npi) from practices_replica where npi is not null)",
        "select trim(npi), 'missing_in_source', '' from practices_replica where trim(npi) not in (select trim(npi) from practices where npi is not null)",
        "select table_name, 'count_mismatch', 'rows_synced' from sync_metadata left join (select 'practices/' || import_batch_id t, count(distinct nullif(trim(npi),'')) n from practices_replica group by 1) on t = table_name where rows_synced is not null and table_name is not null and rows_synced <> coalesce(n, 0)",
    ]
)

_P2 = """with e as (select npi, lower(trim(field_changed)) field_changed, nullif(trim(old_value),'') o, trim(new_value) n, coalesce(change_date, created_at::date) d, created_at, id from practice_changes where nullif(trim(new_value),'') is not null and coalesce(change_date, created_at::date) is not null),
 f as (select npi, field_changed, o from (select *, row_number() over (partition by npi, field_changed order by d, created_at nulls first, id) rn from e) where rn = 1),
 l as (select *, row_number() over (partition by npi, field_changed, d order by created_at desc nulls last, id desc) rn from e),
 u as (select npi, field_changed, date '0001-01-01' d, o v from f where o is not null union all select npi, field_changed, d, n from l where rn = 1),
 w as (select *, lag(v) over (partition by npi, field_changed order by d) pv from u), k as (select * from w where pv is null or pv <> v),
 z as (select npi, field_changed, case when d = date '0001-01-01' then '0001-01-01' else strftime(d, '%Y-%m-%d') end valid_from, coalesce(strftime(lead(d) over (partition by npi, field_changed order by d), '%Y-%m-%d'), '9999-12-31') valid_to, v "value" from k)
"""
P2_FOUND_SQL = _P2 + "select distinct npi, field_changed, valid_from, valid_to from z"
P2_VERSIONS_SQL = _P2 + 'select distinct npi, field_changed, valid_from, valid_to, "value" from z'

_NORMAL = {f: f"nullif(lower(trim(regexp_replace({f}, ' +', ' ', 'g'))), '')" for f in ("practice_name", "address", "city", "state", "taxonomy_code")} | {
    "zip": "lower(left(nullif(trim(zip),''), 5))",
    "phone": "nullif(regexp_replace(regexp_replace(phone, '[^0-9]', '', 'g'), '^1([0-9]{10})$', '\\1'), '')",
}
_P4 = f"""with r as (select npi, snapshot_date, {", ".join(f"{v} as f_{k}" for k, v in _NORMAL.items())}, row_number() over (partition by npi, snapshot_date order by last_updated desc nulls last, loaded_at desc nulls last) rn from practice_snapshots where npi is not null and snapshot_date is not null),
 k as (select * from r where rn = 1), dd as (select snapshot_date a, lead(snapshot_date) over (order by snapshot_date) b from (select distinct snapshot_date from k)),
 o as (select k.*, b from k join dd on snapshot_date = a where b is not null), n as (select k.*, snapshot_date b from k where snapshot_date <> (select min(a) from dd))
"""
_UNEQUAL = [f"o.f_{k} is distinct from n.f_{k}" for k in _NORMAL]
P4_FOUND_SQL = _P4 + f"""select coalesce(o.npi, n.npi) npi, strftime(coalesce(o.b, n.b), '%Y-%m-%d') snapshot_date, case when o.npi is null then 'added' when n.npi is null then 'removed' else 'changed' end change_kind
 from o full join n on o.npi = n.npi and o.b = n.b where o.npi is null or n.npi is null or {" or ".join(_UNEQUAL)}"""
P4_VALUES_SQL = _P4 + " union all ".join(
    f"select n.npi, strftime(n.b, '%Y-%m-%d') snapshot_date, '{k}' field_name, o.f_{k} old_value, n.f_{k} new_value from o join n on o.npi = n.npi and o.b = n.b where o.f_{k} is distinct from n.f_{k}" for k in _NORMAL
)

P7_FOUND_SQL = """with a as (select npi, latitude la, longitude lo, floor(latitude/0.004)::int g from practices where abs(latitude) <= 90 and abs(longitude) <= 180 and not (latitude = 0 and longitude = 0)),
 b as (select npi, la, lo, g + dx g from a, (select unnest([-1, 0, 1]) dx))
select distinct a.npi npi_a, b.npi npi_b from a join b using (g) where a.npi < b.npi and 2*3958.8*asin(sqrt(pow(sin(radians(a.la-b.la)/2),2)+cos(radians(a.la))*cos(radians(b.la))*pow(sin(radians(a.lo-b.lo)/2),2))) <= 0.25"""


@query(P1_FOUND_SQL)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    replica = table(spark, sf_dir, "practices_replica")
    rows = diff_copies(table(spark, sf_dir, "practices"), replica, "npi", COPY_FIELDS)
    counts = count_mismatches(table(spark, sf_dir, "sync_metadata"), replica, "npi", "import_batch_id", "table_name", "rows_synced", "practices/")
    return rows.unionByName(counts).distinct()


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_history(table(spark, sf_dir, "practice_changes"), "npi", "field_changed", "old_value", "new_value", "change_date", "created_at", "id")


def _days(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in cols})


@query(P2_FOUND_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(_history(spark, sf_dir), "valid_from", "valid_to").select("npi", "field_changed", "valid_from", "valid_to").distinct()


@query(P2_VERSIONS_SQL)
def p2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with its value."""
    return _days(_history(spark, sf_dir), "valid_from", "valid_to").distinct()


def _text(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, " +", " "))), F.lit(""))


def _phone(c: Column) -> Column:
    d = digits(c)
    return F.nullif(F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d), F.lit(""))


SNAPSHOT_FIELDS = {f: _text for f in ("practice_name", "address", "city", "state", "taxonomy_code")} | {"zip": lambda c: F.lower(zip5(c)), "phone": _phone}


@query(P4_FOUND_SQL)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snapshot_changes(table(spark, sf_dir, "practice_snapshots"), "npi", "snapshot_date", SNAPSHOT_FIELDS, ["last_updated", "loaded_at"])
    return _days(found, "snapshot_date")


@query(P4_VALUES_SQL)
def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new value of each changed field."""
    found = changed_values(table(spark, sf_dir, "practice_snapshots"), "npi", "snapshot_date", SNAPSHOT_FIELDS, ["last_updated", "loaded_at"])
    return _days(found, "snapshot_date")


@query(P7_FOUND_SQL)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(table(spark, sf_dir, "practices"), "npi", "latitude", "longitude", 0.25)
