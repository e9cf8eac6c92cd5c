"""Queries that keep tables in step: composite keys, scoped replacement, watermarks, backfills, seeds, opinions, accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions import text as X
from mergeloom.functions.address import street_key, xref_key
from mergeloom.functions.core import nz, phone10, zip5
from mergeloom.operators import merge as M
from mergeloom.operators.matching import longest_pattern
from mergeloom.plans.linking import PHONE_SQL, STREET_SQL, ZIP_SQL
from mergeloom.plans.registry import query
from mergeloom.session import table

C = F.col
_S, _Z = STREET_SQL.format("address"), ZIP_SQL.format("zip")
_R = "(select * from (select trim(npi) npi, * exclude (npi), row_number() over (partition by trim(npi) order by updated_at desc nulls last, id) rn from practices_replica) where rn=1)"


def _replica(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "practices_replica").withColumn("npi", F.trim("npi"))
    return M.keep_first(r, ["npi"], [F.desc_nulls_last("updated_at"), F.asc("id")])


_YEAR = "select year(deal_date) y, upper(trim(target_state)) st, specialty, {0} from deals where deal_date is not null and nullif(trim(target_state),'') is not null and specialty is not null and {1} group by 1,2,3"


@query(f"""with o as ({_YEAR.format('max(deal_size_mm) size_mm, max(num_locations) places', "source<>'pitchbook'")}), n as ({_YEAR.format('max(deal_size_mm) size_mm, null::int places', "source='pitchbook'")})
 select coalesce(o.y,n.y)::bigint y, coalesce(o.st,n.st) st, coalesce(o.specialty,n.specialty) specialty, coalesce(n.size_mm,o.size_mm) size_mm, coalesce(n.places,o.places)::double places from o full join n on o.y=n.y and o.st=n.st and o.specialty=n.specialty""")
def upsert_composite(spark: SparkSession, d: str) -> DataFrame:
    """Yearly figures of one source written over those of the others by year, state and specialty, where they are known."""
    e = table(spark, d, "deals").withColumns({"y": F.year("deal_date").cast("bigint"), "st": F.upper(nz("target_state"))}).filter("y is not null and st is not null and specialty is not null")
    size, places = F.max("deal_size_mm").alias("size_mm"), F.max("num_locations").cast("double").alias("places")
    by = ["y", "st", "specialty"]
    return M.upsert(e.filter("source <> 'pitchbook'").groupBy(*by).agg(size, places), e.filter("source = 'pitchbook'").groupBy(*by).agg(size), by)


@query(f"""with w as (select {_Z} z from practices group by 1 having count(*)>=20) select npi, practice_name, 'kept' origin from {_R} where {_Z} is null or {_Z} not in (select z from w where z is not null) union all select npi, practice_name, 'replaced' from practices where {_Z} in (select z from w) and (data_source is null or data_source<>'nppes' or taxonomy_code like '1223%')""")
def scoped_replace(spark: SparkSession, d: str) -> DataFrame:
    """The copy with its rows in busy ZIPs replaced by the source's, of which only the admitted ones come in; all others stay."""
    p = table(spark, d, "practices").withColumn("z", zip5("zip"))
    scope = p.groupBy("z").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20 and z is not null").select("z")
    old = _replica(spark, d).withColumn("z", zip5("zip"))
    new = p.filter(C("data_source").isNull() | (C("data_source") != "nppes") | C("taxonomy_code").startswith("1223"))
    return M.scoped_replace(old.select("npi", "practice_name", "z", F.lit("kept").alias("origin")), new.select("npi", "practice_name", "z", F.lit("replaced").alias("origin")), scope, "z").drop("z")


@query(f"""select p.npi, case when p.practice_name is distinct from r.practice_name then 'practice_name' end a, case when p.phone is distinct from r.phone then 'phone' end b, p.practice_name, p.phone from practices p join {_R} r using (npi) where p.practice_name is distinct from r.practice_name or p.phone is distinct from r.phone""")
def column_sync(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the copy of which one of two columns must be written again, and which."""
    p = table(spark, d, "practices")
    out = M.changed_columns(_replica(spark, d), p, "npi", ["practice_name", "phone"])
    return out.select("npi", F.when(F.array_contains("changed", "practice_name"), "practice_name").alias("a"), F.when(F.array_contains("changed", "phone"), "phone").alias("b"), "practice_name", "phone")


@query("""with s as (select source, max(id) last_id, count(*) n from deals group by 1), b as (select source, max(id) done from (select *, row_number() over (partition by source order by id) rn from deals) where rn<=50 group by 1) select source, done last_value, n - least(n, 50) left_over from s join b using (source)""")
def watermark_store(spark: SparkSession, d: str) -> DataFrame:
    """Watermarks of each source after a first batch of fifty rows, and how many rows lie beyond them."""
    e = table(spark, d, "deals")
    store = M.advance(None, M.next_batch(e, None, "source", "id", 50), "source", "id")
    beyond = e.join(store, "source").groupBy("source", "last_value").agg(F.count_if(C("id") > C("last_value")).alias("left_over"))
    return beyond.select("source", "last_value", "left_over")


@query("""select id, 'file_'||(id%3)::varchar file from (select *, row_number() over (partition by platform_company, target_name, deal_date order by id%3, id) rn from deals) where rn=1""")
def combine_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows of several files, the first of each key by file and place in it."""
    e = table(spark, d, "deals").withColumn("file", F.concat(F.lit("file_"), (C("id") % 3).cast("string")))
    return M.combine([(e.filter(C("id") % 3 == i), F.col("id")) for i in range(3)], ["platform_company", "target_name", "deal_date"]).select("id", "file")


@query("""with c as (select case when deal_type is null then 'open' else 'typed' end status, count(*) n from deals group by 1) select status, n, sum(n) over ()::bigint total, sum(n) over () = (select count(*) from deals) balanced from c""")
def queue_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Rows by status against the whole: the parts must add up."""
    return M.accounting(table(spark, d, "deals"), F.when(C("deal_type").isNull(), "open").otherwise("typed"))


@query(f"""with f as (select trim(npi) npi, practice_name from practices_replica), k as (select npi, min(practice_name) n from f group by 1) select p.npi, coalesce(nullif(trim(p.provider_last_name),''), nullif(regexp_extract(trim(regexp_replace(regexp_replace(trim(regexp_replace(k.n,'\\s+',' ','g')),'^(Dr|DR|dr)\\.? ',''),'[, ]+(DDS|DMD|dds|dmd|Jr|JR|MD)\\.?$','')),'([A-Za-z''-]+)$',1),'')) surname from practices p left join k using (npi) where entity_type in ('individual','1')""")
def surname_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Missing surnames from another table's names, by the last word."""
    names = table(spark, d, "practices_replica").groupBy(F.trim("npi").alias("npi")).agg(F.min("practice_name").alias("n"))
    p = table(spark, d, "practices").filter(C("entity_type").isin("individual", "1")).select("npi", nz("provider_last_name").alias("l"))
    return p.join(names, "npi", "left").select("npi", F.coalesce("l", X.surname(C("n"))).alias("surname"))


@query(f"select p.npi, coalesce(r.city, p.city) city, coalesce(r.phone, p.phone) phone from practices p left join {_R} r using (npi)")
def column_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Columns taken over from a larger table, only for keys that are there already and never by null."""
    r = _replica(spark, d).select("npi", C("city").alias("c"), C("phone").alias("ph"))
    return table(spark, d, "practices").select("npi", "city", "phone").join(r, "npi", "left").select("npi", F.coalesce("c", "city").alias("city"), F.coalesce("ph", "phone").alias("phone"))


@query("""select id, case when t like '%buyout%' or t like '%lbo%' then 'buyout' when t like '%add%' then 'add-on' when t like '%growth%' then 'growth' when t like '%recap%' then 'recapitalization' when t is null then null else 'other' end mapped, nullif(trim(split_part(pe_sponsor,',',1)),'') lead, case when t like '%add%' then platform_company else target_name end buyer from (select *, lower(trim(deal_type)) t from deals)""")
def deal_type_map(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of deal by the first key they contain, the first of several sponsors, and which party buys."""
    t = F.lower(F.trim("deal_type"))
    mapped = F.when(t.contains("buyout") | t.contains("lbo"), "buyout").when(t.contains("add"), "add-on").when(t.contains("growth"), "growth").when(t.contains("recap"), "recapitalization").when(t.isNotNull(), "other")
    buyer = F.when(t.contains("add"), C("platform_company")).otherwise(C("target_name"))
    return table(spark, d, "deals").select("id", mapped.alias("mapped"), nz(F.split("pe_sponsor", ",")[0]).alias("lead"), buyer.alias("buyer"))


@query(f"""with b as (select distinct lower(trim(platform_company)) p from deals where trim(platform_company)<>''), h as (select npi, {_S} s, {_Z} z, p, row_number() over (partition by npi order by len(p) desc, p) rn from practices, b where contains(lower(coalesce(doing_business_as,'')||' '||coalesce(practice_name,'')), p)) select p as brand, count(distinct s||'|'||coalesce(z,'')) addresses, array_to_string(list_sort(list(npi)),',') npis from h where rn=1 group by 1""")
def brand_mining(spark: SparkSession, d: str) -> DataFrame:
    """Brands found in names with their different addresses and the registrations at them."""
    p = table(spark, d, "practices").select("npi", F.concat(F.coalesce("doing_business_as", F.lit("")), F.lit(" "), F.coalesce("practice_name", F.lit(""))).alias("t"), F.concat(street_key(C("address")), F.lit("|"), F.coalesce(zip5("zip"), F.lit(""))).alias("a"))
    hit = longest_pattern(p, "t", table(spark, d, "deals"), "platform_company", "npi").filter("pattern is not null")
    return p.join(hit, "npi").groupBy(C("pattern").alias("brand")).agg(F.countDistinct("a").alias("addresses"), F.array_join(F.array_sort(F.collect_list("npi")), ",").alias("npis"))


@query(f"""with a as (select {_S}||'|'||coalesce({_Z},'') k, location_name n, nullif(trim(phone),'') ph, 0 pr, id::varchar i from dso_locations where {_S} is not null union all select {_S}||'|'||coalesce({_Z},''), practice_name, nullif(trim(phone),''), 1, npi from practices where {_S} is not null and affiliated_dso is not null union all select {_S}||'|'||coalesce({_Z},''), practice_name, nullif(trim(phone),''), 2, npi from practices where {_S} is not null and parent_company is not null)
 select k as place, arg_min(n, (pr, i)) filter (n is not null) name, arg_min(ph, (pr, i)) filter (ph is not null) phone, min(pr) provenance, count(*) n from a group by 1""")
def seed_merge(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of three provenances by place: the first provenance's name, gaps in telephones filled from the others."""
    def seeds(t: DataFrame, name: str, key: str, pr: int) -> DataFrame:
        place = F.concat(street_key(C("address")), F.lit("|"), F.coalesce(zip5("zip"), F.lit("")))
        return t.select(place.alias("place"), C(name).alias("name"), nz("phone").alias("phone"), F.struct(F.lit(pr).alias("pr"), C(key).cast("string").alias("i")).alias("o")).filter("place is not null")

    p = table(spark, d, "practices")
    a = seeds(table(spark, d, "dso_locations"), "location_name", "id", 0).unionByName(seeds(p.filter("affiliated_dso is not null"), "practice_name", "npi", 1)).unionByName(seeds(p.filter("parent_company is not null"), "practice_name", "npi", 2))
    return a.groupBy("place").agg(M.first_known("name", C("o")).alias("name"), M.first_known("phone", C("o")).alias("phone"), F.min("o.pr").alias("provenance"), F.count(F.lit(1)).alias("n"))


@query(f"""with k as (select npi, coalesce(nullif(regexp_extract(address,'^ *([0-9]+)',1),''),'')||'|'||coalesce({_Z}||'|','')||left(regexp_replace({_S},'[^A-Z]','','g'),6) k, ownership_status in ('dso_affiliated','pe_backed') c from practices where nullif(trim(address),'') is not null) select npi from k where not coalesce(c,false) and k is not null and k not in (select k from k where c and k is not null)""")
def without_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose address key no corporate row has."""
    p = table(spark, d, "practices").filter(nz("address").isNotNull()).select("npi", xref_key(C("address"), C("zip")).alias("k"), F.coalesce(C("ownership_status").isin("dso_affiliated", "pe_backed"), F.lit(False)).alias("c")).filter("k is not null")
    return p.filter("not c").join(p.filter("c").select("k"), "k", "left_anti").select("npi")


@query(f"""with a as (select lower(trim(provider_last_name)) o, {_S} s, {_Z} z, npi from practices where nullif(trim(provider_last_name),'') is not null and {_S} is not null) select o official, count(distinct s||'|'||coalesce(z,'')) places, count(distinct npi) registrations from a group by 1 having count(distinct s||'|'||coalesce(z,''))>=2""")
def official_reach(spark: SparkSession, d: str) -> DataFrame:
    """People (by surname) at two places or more."""
    a = table(spark, d, "practices").select(F.lower(nz("provider_last_name")).alias("official"), F.concat(street_key(C("address")), F.lit("|"), F.coalesce(zip5("zip"), F.lit(""))).alias("p"), "npi").filter("official is not null and p is not null")
    return a.groupBy("official").agg(F.countDistinct("p").alias("places"), F.countDistinct("npi").alias("registrations")).filter("places >= 2")


@query("""with e as (select lower(trim(affiliated_dso)) b, 'registry' src, 1 conf from practices where nullif(trim(affiliated_dso),'') is not null union all select lower(trim(dso_name)), 'offices', 2 from dso_locations where nullif(trim(dso_name),'') is not null union all select lower(trim(platform_company)), 'deals', 3 from deals where nullif(trim(platform_company),'') is not null) select b as brand, max(conf) confidence, arg_max(src, conf) best, array_to_string(list_sort(list_distinct(list(src))),'+') sources from e group by 1""")
def brand_confirmation(spark: SparkSession, d: str) -> DataFrame:
    """Brands with the strongest source that confirms them and all sources."""
    one = lambda t, c, s, n: table(spark, d, t).select(F.lower(nz(c)).alias("brand"), F.lit(s).alias("src"), F.lit(n).alias("conf")).filter("brand is not null")
    e = one("practices", "affiliated_dso", "registry", 1).unionByName(one("dso_locations", "dso_name", "offices", 2)).unionByName(one("deals", "platform_company", "deals", 3))
    return e.groupBy("brand").agg(F.max("conf").alias("confidence"), F.max_by("src", "conf").alias("best"), F.array_join(F.array_sort(F.collect_set("src")), "+").alias("sources"))


@query(r"""select id, case when regexp_matches(u,'^(?i)https?://[a-z0-9-]+(\.[a-z0-9-]+)+([/:?#].*)?$') then u end url from (select id, case when id%2=0 then 'www.'||regexp_replace(trim(source_url),'^https?://','') when lower(trim(source_url)) like 'www.%' then 'https://'||trim(source_url) else trim(source_url) end v, case when lower(v) like 'www.%' then 'https://'||v else v end u from deals)""")
def url_repair(spark: SparkSession, d: str) -> DataFrame:
    """Addresses without scheme repaired, what is no address left out."""
    written = F.when(C("id") % 2 == 0, F.concat(F.lit("www."), F.regexp_replace(F.trim("source_url"), "^https?://", ""))).otherwise(C("source_url"))
    return table(spark, d, "deals").select("id", X.http_url(written).alias("url"))


_BUCKET = "case when nullif(trim(phone),'') is null then 'no telephone' when ownership_status in ('dso_affiliated','pe_backed') then 'held' when coalesce(buyability_score,0)>=70 then 'first' else 'later' end"


@query(f"select {_BUCKET} bucket, count(*) n, min(npi) first_npi from practices group by 1")
def disposition_buckets(spark: SparkSession, d: str) -> DataFrame:
    """All rows in exactly one bucket each, by the first rule that holds."""
    bucket = F.when(nz("phone").isNull(), "no telephone").when(C("ownership_status").isin("dso_affiliated", "pe_backed"), "held").when(C("buyability_score") >= 70, "first").otherwise("later")
    return table(spark, d, "practices").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("npi").alias("first_npi"))


@query("""with n as (select affiliated_dso g, case when count(*)>=100 then 'release' else 'hold' end decision from practices where affiliated_dso is not null group by 1) select npi, decision from practices p join n on n.g=p.affiliated_dso where decision='release' or ownership_status='pe_backed'""")
def network_release(spark: SparkSession, d: str) -> DataFrame:
    """A decision for each network, and the rows that pass by it or by their own state."""
    p = table(spark, d, "practices").filter("affiliated_dso is not null").select("npi", C("affiliated_dso").alias("g"), "ownership_status")
    n = p.groupBy("g").agg(F.when(F.count(F.lit(1)) >= 100, "release").otherwise("hold").alias("decision"))
    return p.join(n, "g").filter((C("decision") == "release") | (C("ownership_status") == "pe_backed")).select("npi", "decision")


@query(f"""select coalesce(r.npi, p.npi) npi, case when r.npi is null then 'inserted' when p.npi is null then 'kept' when r.ownership_status is null or r.ownership_status in ('unknown','independent') then 'replaced' else 'protected' end outcome, case when r.npi is null or (p.npi is not null and (r.ownership_status is null or r.ownership_status in ('unknown','independent'))) then p.ownership_status else r.ownership_status end status from {_R} r full join practices p on p.npi=r.npi""")
def manifest_merge(spark: SparkSession, d: str) -> DataFrame:
    """A wave merged into a list: new keys come in, old ones are replaced only where their state allows it."""
    return M.merge_by_state(_replica(spark, d).select("npi", "ownership_status"), table(spark, d, "practices").select("npi", "ownership_status"), "npi", "ownership_status", ["unknown", "independent"]).select("npi", "outcome", C("ownership_status").alias("status"))


@query(f"""with k as (select lower(trim(affiliated_dso)) g, npi, ownership_status o, {_Z} z from practices where affiliated_dso is not null), s as (select g, count(*) n, count(distinct z) zips from k group by 1) select npi, k.g cluster, case when o in ('dso_affiliated','pe_backed') then 'confirmed' when zips>=3 then 'review first' else 'review' end queue from k join s using (g)""")
def cluster_queue(spark: SparkSession, d: str) -> DataFrame:
    """Members of clusters with the queue they belong to."""
    k = table(spark, d, "practices").filter("affiliated_dso is not null").select(F.lower(F.trim("affiliated_dso")).alias("cluster"), "npi", C("ownership_status").alias("o"), zip5("zip").alias("z"))
    s = k.groupBy("cluster").agg(F.countDistinct("z").alias("zips"))
    return k.join(s, "cluster").select("npi", "cluster", F.when(C("o").isin("dso_affiliated", "pe_backed"), "confirmed").when(C("zips") >= 3, "review first").otherwise("review").alias("queue"))


@query("""with a as (select source, unnest(generate_series(timestamp '2024-01-01', timestamp '2024-12-01', interval 1 month))::date m from (select distinct source from deals)), o as (select source, date_trunc('month', deal_date)::date m, count(*) n from deals group by 1,2) select a.source, strftime(a.m,'%Y-%m') as "month", coalesce(n,0) n, n is null gap from a left join o using (source, m)""")
def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    """For each source every month of a year with its number of rows, gaps marked."""
    e = table(spark, d, "deals").select("source", F.trunc("deal_date", "month").alias("m"))
    every = e.select("source").distinct().select("source", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-12-01").cast("date"), F.expr("interval 1 month"))).alias("m"))
    n = e.groupBy("source", "m").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, ["source", "m"], "left").select("source", F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), C("n").isNull().alias("gap"))


@query("select 'deals' t, max(id)+1 next_value from deals union all select 'practices', max(id)+1 from practices")
def next_ids(spark: SparkSession, d: str) -> DataFrame:
    """The first free number of each table."""
    one = lambda t: table(spark, d, t).agg((F.max("id") + 1).alias("next_value")).select(F.lit(t).alias("t"), "next_value")
    return one("deals").unionByName(one("practices"))


@query(f"""with o as (select distinct {_S} s, {_Z} z from dso_locations where {_S} is not null and {_Z} is not null) select npi from practices p semi join o on o.s={STREET_SQL.format('p.address')} and o.z={ZIP_SQL.format('p.zip')}""")
def exact_address_join(spark: SparkSession, d: str) -> DataFrame:
    """Practices at the street and ZIP of some office."""
    on = lambda t: table(spark, d, t).withColumns({"s": street_key(C("address")), "z": zip5("zip")}).filter("s is not null and z is not null")
    return on("practices").join(on("dso_locations").select("s", "z"), ["s", "z"], "left_semi").select("npi")


@query(f"""with l as (select {_S} s, {_Z} z, array_to_string(list_sort(list(npi)),',') npis from practices where {_S} is not null and {_Z} is not null group by 1,2), x as (select s, z, unnest(string_split(npis,',')) npi from l) select x.s street, x.z zip5, array_to_string(list_sort(list_distinct(list(upper(nullif(trim(p.provider_last_name),''))) filter (nullif(trim(p.provider_last_name),'') is not null)),',') surnames from x join practices p using (npi) group by 1,2""".replace("list_distinct(list(upper(nullif(trim(p.provider_last_name),''))) filter (nullif(trim(p.provider_last_name),'') is not null)", "list_distinct(coalesce(list(upper(nullif(trim(p.provider_last_name),''))) filter (nullif(trim(p.provider_last_name),'') is not null), []))"))
def listed_surnames(spark: SparkSession, d: str) -> DataFrame:
    """Surnames of a place's people, looked up through the place's list of keys."""
    p = table(spark, d, "practices")
    places = p.withColumns({"street": street_key(C("address")), "zip5": zip5("zip")}).filter("street is not null and zip5 is not null").groupBy("street", "zip5").agg(F.to_json(F.array_sort(F.collect_list("npi"))).alias("npis"))
    x = places.select("street", "zip5", F.explode(F.from_json("npis", "array<string>")).alias("npi"))
    return x.join(p.select("npi", F.upper(nz("provider_last_name")).alias("l")), "npi").groupBy("street", "zip5").agg(F.array_join(F.array_sort(F.collect_set("l")), ",").alias("surnames"))


@query(f"""with e as (select trim(npi) npi, 'copy' src, 1 w from practices_replica where ownership_status in ('dso_affiliated','pe_backed') union all select npi, 'signals', 2 from practice_signals where stealth_dso_flag union all select npi, 'changes', 3 from practice_changes where lower(trim(field_changed))='ownership_status') select npi, count(*) evidence, max(w) strongest, array_to_string(list_sort(list_distinct(list(src))),'+') sources from e where npi is not null group by 1""")
def evidence_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of evidence of three tables united by key."""
    one = lambda t, cond, s, w: table(spark, d, t).filter(cond).select(F.trim("npi").alias("npi"), F.lit(s).alias("src"), F.lit(w).alias("w"))
    e = one("practices_replica", C("ownership_status").isin("dso_affiliated", "pe_backed"), "copy", 1).unionByName(one("practice_signals", C("stealth_dso_flag"), "signals", 2)).unionByName(one("practice_changes", F.lower(F.trim("field_changed")) == "ownership_status", "changes", 3))
    return e.filter("npi is not null").groupBy("npi").agg(F.count(F.lit(1)).alias("evidence"), F.max("w").alias("strongest"), F.array_join(F.array_sort(F.collect_set("src")), "+").alias("sources"))


@query(f"""with a as (select npi, old.practice_name o, p.practice_name n, old.address oa, p.address na, old.affiliated_dso og, p.affiliated_dso ng from practices p join {_R} old using (npi)) select npi, case when og is distinct from ng and ng is not null and og is not null then 'acquisition' when o<>n then 'name_change' when oa<>na then 'relocation' end change_type from a where (og is distinct from ng and ng is not null and og is not null) or o<>n or oa<>na""")
def typed_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes from the copy to the source, one kind each: of group, name or address, in this order."""
    r = _replica(spark, d).select("npi", C("practice_name").alias("o"), C("address").alias("oa"), C("affiliated_dso").alias("og"))
    kind = F.when(C("og") != C("affiliated_dso"), "acquisition").when(C("o") != C("practice_name"), "name_change").when(C("oa") != C("address"), "relocation")
    return table(spark, d, "practices").join(r, "npi").select("npi", kind.alias("change_type")).filter("change_type is not null")
