"""Queries of clusters with evidence, duplicates, roll-ups by ZIP, and survivorship at the grain of places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergeloom.functions import text as X
from mergeloom.functions.address import street_core, street_key
from mergeloom.functions.core import nz, phone10, zip5
from mergeloom.functions.parse import ein
from mergeloom.operators.graph import cluster_summaries, connected_components
from mergeloom.operators.merge import first_known
from mergeloom.operators.spatial import containing_regions, placed
from mergeloom.plans.linking import PHONE_SQL, STREET_SQL, ZIP_SQL
from mergeloom.plans.registry import query
from mergeloom.session import table

C = F.col
_S, _Z, _PH = STREET_SQL.format("address"), ZIP_SQL.format("zip"), PHONE_SQL.format("phone")
_ORG = "entity_type in ('organization','2')"
_EIN = "case when len(x)=9 and list_max(list_transform(range(0,10), lambda i: 9-len(replace(x,i::varchar,''))))<6 and x not in ('123456789','987654321') then x end"
_E = f"e as (select *, {_EIN} e from (select *, regexp_replace(coalesce(ein,''),'[^0-9]','','g') x from practices))"


def _org() -> Column:
    return C("entity_type").isin("organization", "2")


@query(f"with {_E}, g as (select e, count(distinct npi) members, array_to_string(list_sort(list_distinct(list(npi))),',') npis from e where e is not null group by 1) select e ein, members, npis from g where members>=2")
def shared_eins(spark: SparkSession, d: str) -> DataFrame:
    """Employer numbers of two or more registrations with the list of these; an employer's list is bounded by its firms."""
    p = table(spark, d, "practices").select("npi", ein(C("ein")).alias("ein")).filter("ein is not null")
    g = p.groupBy("ein").agg(F.countDistinct("npi").alias("members"), F.array_join(F.array_sort(F.collect_set("npi")), ",").alias("npis"))
    return g.filter("members >= 2")


@query(f"""with r as (select npi, {_PH} ph, upper(trim(city))||'|'||{_S} place, {_Z} z, case when entity_type in ('individual','1') then nullif(upper(trim(provider_last_name)),'') end ln, entity_type in ('individual','1') one from practices), f as (select ph, count(distinct place) buildings, count(distinct npi) npis, count(distinct z) zips, count(case when one then 1 end) people from r where ph is not null group by 1),
 l as (select ph, max(n) top from (select ph, ln, count(*) n from r where ln is not null and ph is not null group by 1,2) group by 1) select f.ph phone, buildings, npis, zips, people, coalesce(top,0) dominant_surname from f left join l using (ph) where buildings>=3 and npis<50""")
def shared_phone_profile(spark: SparkSession, d: str) -> DataFrame:
    """Telephones used at three buildings or more by fewer than fifty registrations, and how many people share the commonest surname."""
    one = C("entity_type").isin("individual", "1")
    r = table(spark, d, "practices").select(
        "npi", phone10("phone").alias("phone"), F.concat(F.upper(F.trim("city")), F.lit("|"), street_key(C("address"))).alias("place"), zip5("zip").alias("z"), one.alias("one"), F.when(one, F.upper(nz("provider_last_name"))).alias("ln")
    ).filter("phone is not null")
    f = r.groupBy("phone").agg(F.countDistinct("place").alias("buildings"), F.countDistinct("npi").alias("npis"), F.countDistinct("z").alias("zips"), F.count_if("one").alias("people"))
    top = r.filter("ln is not null").groupBy("phone", "ln").agg(F.count(F.lit(1)).alias("n")).groupBy("phone").agg(F.max("n").alias("top"))
    return f.filter("buildings >= 3 and npis < 50").join(top, "phone", "left").select("phone", "buildings", "npis", "zips", "people", F.coalesce("top", F.lit(0).cast("bigint")).alias("dominant_surname"))


@query(f"""with r as (select npi, {_S} s, {_Z} z, upper(nullif(trim(provider_last_name),'')) ln from practices where {_S} is not null), g as (select s, z, ln, count(*) n from r where ln is not null group by 1,2,3 having count(*)>=2) select r.npi, r.ln surname, g.n from r join g on r.s=g.s and r.z is not distinct from g.z and r.ln=g.ln""")
def family_signal(spark: SparkSession, d: str) -> DataFrame:
    """People who share a surname with another at their address."""
    r = table(spark, d, "practices").select("npi", street_key(C("address")).alias("s"), zip5("zip").alias("z"), F.upper(nz("provider_last_name")).alias("ln")).filter("s is not null and ln is not null")
    g = r.groupBy("s", "z", "ln").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return r.alias("r").join(g.alias("g"), (C("r.s") == C("g.s")) & C("r.z").eqNullSafe(C("g.z")) & (C("r.ln") == C("g.ln"))).select("npi", C("r.ln").alias("surname"), "n")


_KINDS_SQL = f"""k as (select 'ein' kind, e "key", npi from e where e is not null union all select 'parent', lower(nullif(trim(parent_company),'')), npi from e union all select 'group', lower(nullif(trim(affiliated_dso),'')), npi from e union all select 'phone', {_PH}, npi from e
 union all select 'site', nullif(regexp_extract(lower(trim(website)),'^https?://(www\\.)?([^/:?#]+)',2),''), npi from e union all select 'address', {_S}||'|'||{_Z}, npi from e), f as (select npi, {_Z} z, {_S} s, coalesce(entity_classification,'unknown') c, ownership_status o from practices)"""


@query(f"""with {_E}, {_KINDS_SQL}, j as (select distinct k.kind, k."key", f.* from k join f using (npi) where k."key" is not null), g as (select kind, "key", count(*) members, count(distinct z) zips, count(distinct s) streets, count(case when o='independent' then 1 end) independent from j group by 1,2),
 h as (select kind, "key", array_to_string(list_sort(list(c||':'||n)),',') classes from (select kind, "key", c, count(*) n from j group by 1,2,3) group by 1,2)
 select kind, "key" as cluster_key, members, zips, streets, independent, classes, case when zips>=3 then 'strong' when zips=2 then 'medium' else 'weak' end strength from g join h using (kind, "key") where members between 2 and 50""")
def cluster_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Clusters over six kinds of keys with members, places, histogram of classes, those still independent, and strength."""
    p = table(spark, d, "practices").select("*", zip5("zip").alias("z"), street_key(C("address")).alias("s"))
    keys = {"ein": ein(C("ein")), "parent": F.lower(nz("parent_company")), "group": F.lower(nz("affiliated_dso")), "phone": phone10("phone"), "site": X.host(C("website")), "address": F.concat("s", F.lit("|"), "z")}
    out = cluster_summaries(p, keys, "npi", "z", "s", F.coalesce("entity_classification", F.lit("unknown")), C("ownership_status") == "independent", 2, 50)
    strength = F.when(C("places") >= 3, "strong").when(C("places") == 2, "medium").otherwise("weak")
    return out.select("kind", "cluster_key", "members", C("places").alias("zips"), C("spots").alias("streets"), C("flagged").alias("independent"), "classes", strength.alias("strength"))


_GENERIC = "greatest((select count(*) from practices)*0.02, 20)"
_W = "list_distinct(regexp_extract_all(lower(practice_name),'[a-z0-9]+'))"
_BRANDS_SQL = f"""w as (select npi, unnest({_W}) w from practices), sw as (select w from w group by 1 having count(*) > {_GENERIC}), x as (select npi, z, unnest(ws) w, generate_subscripts(ws, 1) i from (select npi, {_Z} z, regexp_extract_all(lower(practice_name),'[a-z0-9]+') ws from practices)), n as (select npi, any_value(z) z, string_agg(w, ' ' order by i) b from x where len(w)>1 and w not in (select w from sw) group by 1)"""


def _brands(p: DataFrame) -> DataFrame:
    """(npi, b, z): names without words of more than 2 % of all names (and more than 20), which at most some hundred words can be."""
    words = F.regexp_extract_all(F.lower("practice_name"), F.lit("([a-z0-9]+)"), F.lit(1))
    n = p.select("npi", zip5("zip").alias("z"), F.posexplode(words).alias("i", "w"))
    counts = n.select("npi", "w").distinct().groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    total = p.agg(F.greatest(F.count(F.lit(1)) * 0.02, F.lit(20))).scalar()
    generic = counts.filter(C("k") > total).select("w")
    kept = n.filter(F.length("w") > 1).join(generic, "w", "left_anti").groupBy("npi", "z").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("x"))
    return kept.select("npi", F.array_join("x.w", " ").alias("b"), "z")


@query(f"with {_BRANDS_SQL} select b as cluster_key, count(distinct npi) members, count(distinct z) places from n where b<>'' group by 1 having count(distinct npi)>=2 and count(distinct z)>=2")
def name_chains(spark: SparkSession, d: str) -> DataFrame:
    """Names used in two ZIPs or more, without the words that very many names have; these are found in the data."""
    g = _brands(table(spark, d, "practices")).filter("b is not null").groupBy(C("b").alias("cluster_key")).agg(F.countDistinct("npi").alias("members"), F.countDistinct("z").alias("places"))
    return g.filter("members >= 2 and places >= 2")


@query(f"""with {_E}, {_BRANDS_SQL}, c as (select b, count(distinct npi) members, count(distinct z) zips from n where b<>'' group by 1 having count(distinct z)>=2), k1 as (select n.b, count(distinct e.e) eins, max(k) shared_ein from n join e using (npi) left join (select n.b, e.e, count(*) k from n join e using (npi) where e.e is not null group by 1,2) y on y.b=n.b and y.e=e.e group by 1), q as (select n.b, max(k) parents from n join practices p using (npi) join (select n.b, lower(trim(p.parent_company)) o, count(*) k from n join practices p using (npi) where nullif(trim(p.parent_company),'') is not null group by 1,2) y on y.b=n.b and y.o=lower(trim(p.parent_company)) group by 1)
 select c.b brand, members, zips, eins, coalesce(shared_ein,0)>=2 same_ein, coalesce(parents,0)>=2 same_parent from c left join k1 using (b) left join q using (b)""")
def brand_corroboration(spark: SparkSession, d: str) -> DataFrame:
    """Chains of one name and whether an employer number or a parent company that members share confirms them."""
    p = table(spark, d, "practices")
    n = _brands(p).filter("b is not null").join(p.select("npi", ein(C("ein")).alias("e"), F.lower(nz("parent_company")).alias("o")), "npi")
    c = n.groupBy("b").agg(F.countDistinct("npi").alias("members"), F.countDistinct("z").alias("zips"), F.countDistinct("e").alias("eins")).filter("zips >= 2")
    twice = lambda k, name: n.filter(C(k).isNotNull()).groupBy("b", k).agg(F.count(F.lit(1)).alias("n")).groupBy("b").agg((F.max("n") >= 2).alias(name))
    no = F.lit(False)
    return c.join(twice("e", "same_ein"), "b", "left").join(twice("o", "same_parent"), "b", "left").select(C("b").alias("brand"), "members", "zips", "eins", F.coalesce("same_ein", no).alias("same_ein"), F.coalesce("same_parent", no).alias("same_parent"))


@query(f"""with r as (select npi, nullif(regexp_extract(lower(trim(website)),'^https?://(www\\.)?([^/:?#]+)',2),'') h, {_Z} z, list_distinct(regexp_extract_all(lower(practice_name),'[a-z0-9]+')) ws from practices), g as (select h, count(distinct npi) members, count(distinct z) zips from r where h is not null group by 1 having count(distinct npi)>=2), w as (select h, max(n) top from (select h, w, count(distinct npi) n from (select h, npi, unnest(ws) w from r where h is not null) group by 1,2) group by 1)
 select h as host, members, zips, round(top*1.0/members,4) cohesion from g join w using (h)""")
def site_cohesion(spark: SparkSession, d: str) -> DataFrame:
    """Sites of several registrations and the share of them that have the commonest word of their names in common."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("practice_name"), F.lit("([a-z0-9]+)"), F.lit(1)))
    r = table(spark, d, "practices").select("npi", X.host(C("website")).alias("host"), zip5("zip").alias("z"), words.alias("ws")).filter("host is not null")
    g = r.groupBy("host").agg(F.countDistinct("npi").alias("members"), F.countDistinct("z").alias("zips")).filter("members >= 2")
    w = r.select("host", "npi", F.explode("ws").alias("w")).groupBy("host", "w").agg(F.countDistinct("npi").alias("n")).groupBy("host").agg(F.max("n").alias("top"))
    return g.join(w, "host").select("host", "members", "zips", F.round(C("top") / C("members"), 4).alias("cohesion"))


_DUP = f"""{_E}, d as (select npi, {_Z} z, {_PH} ph, e, array_to_string(list_slice(string_split({_S},' '),1,3),' ') core from e), g as (select distinct min(npi) over (partition by z, core, ph) a, npi b from d where z is not null and core<>'' and ph is not null union select distinct min(npi) over (partition by z, core, e), npi from d where z is not null and core<>'' and e is not null)"""


@query(f"with recursive {_DUP}, f as (select a, b from g where a<>b union select b, a from g where a<>b), r(v,c) as (select a, a from f union select f.b, r.c from r join f on r.v=f.a) select v npi, min(c) duplicate_of from r group by v")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one building (ZIP and first words of the street) linked by telephone or employer number, in groups."""
    x = table(spark, d, "practices").select("npi", zip5("zip").alias("z"), phone10("phone").alias("ph"), ein(C("ein")).alias("e"), street_core(C("address")).alias("core")).filter("z is not null and core is not null")

    def edges(k: str) -> DataFrame:
        some = x.filter(C(k).isNotNull())
        hub = some.groupBy("z", "core", k).agg(F.min("npi").alias("hub"))
        return some.join(hub, ["z", "core", k]).filter("npi <> hub").select("hub", "npi")

    return connected_components(edges("ph").unionByName(edges("e")), "hub", "npi").toDF("npi", "duplicate_of")


@query(f"""with a as (select npi, {_Z} z, {_PH} ph, array_to_string(list_slice(string_split({_S},' '),1,3),' ') c, {_S} s, lower(trim(address)) raw from practices), g as (select z, ph, c, count(*) n, count(distinct s) keys, count(distinct raw) spellings from a where z is not null and ph is not null and c<>'' group by 1,2,3 having count(*)>1)
 select z, ph, c, n, case when keys>1 then 'normaliser miss' when spellings>1 then 'suite variant' else 'exact' end kind from g""")
def duplicate_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Why rows of one building and telephone stand apart: unequal street keys, other suites, or not at all."""
    a = table(spark, d, "practices").select(zip5("zip").alias("z"), phone10("phone").alias("ph"), street_core(C("address")).alias("c"), street_key(C("address")).alias("s"), F.lower(F.trim("address")).alias("raw")).filter("z is not null and ph is not null and c is not null")
    g = a.groupBy("z", "ph", "c").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("keys"), F.countDistinct("raw").alias("spellings")).filter("n > 1")
    return g.select("z", "ph", "c", "n", F.when(C("keys") > 1, "normaliser miss").when(C("spellings") > 1, "suite variant").otherwise("exact").alias("kind"))


@query(f"""with p as (select npi, {_S} s, {_Z} z, case when ownership_status in ('dso_affiliated','pe_backed') then 0 when {_ORG} then 1 else 2 end o from practices where {_S} is not null and {_Z} is not null), k as (select s, z, arg_min(npi, (o, npi)) keeper, min(o) least, count(*) n from p group by 1,2 having count(*)>1) select p.npi, k.keeper canonical, k.least=0 corporate from p join k using (s, z) where p.npi<>k.keeper""")
def duplicate_locations(spark: SparkSession, d: str) -> DataFrame:
    """Rows marked as repeats of their place's canonical row: a corporate one first, a firm second, the least key last."""
    rank = F.when(C("ownership_status").isin("dso_affiliated", "pe_backed"), 0).when(_org(), 1).otherwise(2)
    p = table(spark, d, "practices").select("npi", street_key(C("address")).alias("s"), zip5("zip").alias("z"), rank.alias("o")).filter("s is not null and z is not null")
    k = p.groupBy("s", "z").agg(F.min(F.struct("o", "npi")).alias("k"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return p.join(k, ["s", "z"]).filter("npi <> k.npi").select("npi", C("k.npi").alias("canonical"), (C("k.o") == 0).alias("corporate"))


@query(f"""select {ZIP_SQL.format('zip_code')} z, count(*) practices, count(case when stealth_dso_flag then 1 end) stealth, count(case when micro_cluster_flag then 1 end) micro, count(distinct nullif(lower(trim(stealth_dso_cluster_id)),'')) stealth_ids, count(distinct nullif(lower(trim(micro_cluster_id)),'')) micro_ids, sum(micro_cluster_size)::double size_sum, max(micro_cluster_size)::double size_max from practice_signals where {ZIP_SQL.format('zip_code')} is not null group by 1""")
def zip_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of a ZIP: flags, different ids, sum and greatest of known sizes (null if none is known)."""
    s = table(spark, d, "practice_signals").withColumn("z", zip5("zip_code")).filter("z is not null")
    ids = lambda c: F.countDistinct(F.lower(nz(c)))
    return s.groupBy("z").agg(
        F.count(F.lit(1)).alias("practices"), F.count_if(F.coalesce("stealth_dso_flag", F.lit(False))).alias("stealth"), F.count_if(F.coalesce("micro_cluster_flag", F.lit(False))).alias("micro"),
        ids("stealth_dso_cluster_id").alias("stealth_ids"), ids("micro_cluster_id").alias("micro_ids"), F.sum("micro_cluster_size").cast("double").alias("size_sum"), F.max("micro_cluster_size").cast("double").alias("size_max"),
    )


@query(f"""with a as (select distinct {_Z} z, {_S} s, nullif(trim(affiliated_dso),'') g from practices where {_Z} is not null and {_S} is not null), t as (select z, count(distinct s) n from a group by 1), x as (select z, g, count(distinct s) k from a where g is not null group by 1,2) select z, g as platform, k as addresses, round(k*100.0/n,2) share from x join t using (z) where k*100.0/n>=20""")
def platform_share(spark: SparkSession, d: str) -> DataFrame:
    """Platforms with a fifth or more of the different addresses of a ZIP."""
    a = table(spark, d, "practices").select(zip5("zip").alias("z"), street_key(C("address")).alias("s"), nz("affiliated_dso").alias("platform")).filter("z is not null and s is not null")
    t = a.groupBy("z").agg(F.countDistinct("s").alias("n"))
    x = a.filter("platform is not null").groupBy("z", "platform").agg(F.countDistinct("s").alias("addresses"))
    return x.join(t, "z").withColumn("share", C("addresses") * 100 / C("n")).filter("share >= 20").select("z", "platform", "addresses", F.round("share", 2).alias("share"))


@query(f"""select {ZIP_SQL.format('target_zip')} z, count(*) deals, count(case when deal_date >= date '2023-02-01' then 1 end) recent from deals where {ZIP_SQL.format('target_zip')} is not null group by 1""")
def deals_per_zip(spark: SparkSession, d: str) -> DataFrame:
    """Deals of each ZIP, all and those of the last 24 months before 2025-02-01."""
    e = table(spark, d, "deals").select(zip5("target_zip").alias("z"), C("deal_date").cast("date").alias("t")).filter("z is not null")
    return e.groupBy("z").agg(F.count(F.lit(1)).alias("deals"), F.count_if(F.coalesce(C("t") >= F.lit("2023-02-01").cast("date"), F.lit(False))).alias("recent"))


@query(f"""with s as (select npi, left(nullif(trim(zip_code),''),5) z, coalesce(entity_classification,'unknown') c, buyability_score b from practice_signals where buyability_score is not null), r as (select npi, case when count(*) over (partition by z,c)>=2 then round((rank() over (partition by z,c order by b)-1)*100.0/greatest(count(*) over (partition by z,c)-1,1),1) end p from s) select npi, coalesce(p>=90,false) top_peer from r""")
def peer_flag(spark: SparkSession, d: str) -> DataFrame:
    """Those in the top tenth of their peers of ZIP and class."""
    from mergeloom.plans.reporting import pct_rank_peer

    return pct_rank_peer(spark, d).select("npi", F.coalesce(C("zip_class_pct") >= 90, F.lit(False)).alias("top_peer"))


@query("select * from (select platform_company, id, deal_date::varchar as \"day\" from deals where deal_date is not null order by deals.deal_date desc, id desc limit 25) order by \"day\", id")
def newest_25(spark: SparkSession, d: str) -> DataFrame:
    """The newest 25 deals in ascending order; the limit is the feature."""
    e = table(spark, d, "deals").filter("deal_date is not null").withColumn("t", C("deal_date").cast("date"))
    return e.orderBy(F.desc("t"), F.desc("id")).limit(25).orderBy("t", "id").select("platform_company", "id", F.date_format("t", "yyyy-MM-dd").alias("day"))


_TITLE = "array_to_string(list_transform(string_split(trim(regexp_replace({0},'\\s+',' ','g')),' '), lambda w: upper(w[1:1])||lower(w[2:])),' ')"
_PERSON = "(regexp_matches(practice_name,'(DDS|DMD|dds|dmd)\\.?$|^(Dr|DR|dr)\\.? ') and not regexp_matches(lower(practice_name),'dental|dentistry|care|group|clinic|center|studio|associates|smile|ortho|&'))"


@query(f"""with p as (select *, {_S} s, {_Z} z, lower(trim(city)) ct, {_ORG} org, coalesce(updated_at, timestamp '1900-01-01') u, coalesce(enumeration_date, date '1900-01-01') en, nullif(trim(doing_business_as),'') dba, nullif(trim(practice_name),'') pn from practices where {_S} is not null),
 g as (select s, z, ct, count(case when not org then 1 end) people, count(case when org then 1 end) orgs from (select s, z, first_value(ct) over (partition by s, z order by npi) ct, org from p) group by 1,2,3),
 m as (select a.s, a.z, coalesce((select b.z from g b where b.s=a.s and b.ct=a.ct and b.z<>a.z and b.people>0 order by b.people desc, b.z limit 1), a.z) tz from g a where a.people=0 and a.z is not null),
 q as (select p.*, coalesce(m.tz, p.z) gz from p left join m on m.s=p.s and m.z=p.z)
 select s as street, gz as zip5, count(*) n, arg_max(npi, (u, npi)) filter (org) org_npi,
 coalesce(arg_max(coalesce(pn, dba), (u, npi)) filter (org), arg_min(dba, npi) filter (not org and dba is not null), arg_min(pn, npi) filter (not org and pn is not null and not coalesce({_PERSON.replace('practice_name', 'pn')}, false)), arg_min({_TITLE.format('trim(provider_last_name)')}, (en, npi)) filter (not org and nullif(trim(provider_last_name),'') is not null)||' Dental') name,
 array_to_string(list_sort(list_distinct(list(npi))),',') npis, max(employee_count)::double staff, arg_min(latitude, (case when org then 0 else 1 end, npi)) filter (abs(latitude)<=90 and abs(longitude)<=180 and not (latitude=0 and longitude=0)) lat from q group by 1,2""")
def place_survivorship(spark: SparkSession, d: str) -> DataFrame:
    """One row per place. A place of firms only joins the sibling of its street and city with most people (then least ZIP).

    Its name is the newest firm's, else the first trade name, else the first name that is no person's, else the surname of
    the oldest registration with 'Dental'; coordinates are the first valid ones, firms before people; keys are listed.
    """
    p = table(spark, d, "practices").withColumn("s", street_key(C("address"))).withColumn("z", zip5("zip")).filter("s is not null")
    p = p.withColumns({"ct": F.lower(F.trim("city")), "org": F.coalesce(_org(), F.lit(False)), "u": F.coalesce("updated_at", F.lit("1900-01-01").cast("timestamp_ntz")), "en": F.coalesce("enumeration_date", F.lit("1900-01-01").cast("date"))})
    g = p.groupBy("s", "z").agg(F.min_by("ct", "npi").alias("ct"), F.count_if(~C("org")).alias("people"))
    best = g.filter("people > 0 and z is not null").groupBy("s", "ct").agg(F.min(F.struct((-C("people")).alias("x"), "z")).alias("b"))
    moved = g.filter("people = 0 and z is not null").join(best, ["s", "ct"]).select("s", "z", C("b.z").alias("tz"))
    q = p.join(moved, ["s", "z"], "left").withColumn("gz", F.coalesce("tz", "z"))
    dba, pn, last = nz("doing_business_as"), nz("practice_name"), nz("provider_last_name")
    order = F.struct("u", "npi")
    business = ~C("org") & pn.isNotNull() & ~F.coalesce(X.is_person(C("practice_name")), F.lit(False))
    name = F.coalesce(
        F.max_by(F.coalesce(pn, dba), F.when(C("org") & F.coalesce(pn, dba).isNotNull(), order)), F.min_by(dba, F.when(~C("org") & dba.isNotNull(), C("npi"))), F.min_by(pn, F.when(business, C("npi"))),
        F.concat(F.min_by(X.title_case(last, [], []), F.when(~C("org") & last.isNotNull(), F.struct("en", "npi"))), F.lit(" Dental")),
    )
    lat = F.min_by("latitude", F.when(placed(C("latitude"), C("longitude")), F.struct(F.when(C("org"), 0).otherwise(1).alias("o"), "npi")))
    out = q.groupBy("s", "gz").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("npi", F.when(C("org"), order)).alias("org_npi"), name.alias("name"), F.array_join(F.array_sort(F.collect_set("npi")), ",").alias("npis"),
        F.max("employee_count").cast("double").alias("staff"), lat.alias("lat"),
    )
    return out.withColumnsRenamed({"s": "street", "gz": "zip5"})


@query(f"""with z as (select {_Z} z, avg(latitude) la, avg(longitude) lo from practices where {_Z} is not null and abs(latitude)<=90 and abs(longitude)<=180 and not (latitude=0 and longitude=0) group by 1) select p.npi, z.z region from practices p join z on latitude > z.la-0.03 and latitude < z.la+0.03 and abs(latitude-z.la)/0.03+abs(longitude-z.lo)/0.04 < 1 where abs(latitude)<=90 and abs(longitude)<=180 and not (latitude=0 and longitude=0)""")
def p7_regions(spark: SparkSession, d: str) -> DataFrame:
    """The ZIPs whose region, a diamond around the ZIP's centre, contains a practice."""
    p = table(spark, d, "practices")
    z = p.filter(placed(C("latitude"), C("longitude"))).groupBy(zip5("zip").alias("region")).agg(F.avg("latitude").alias("la"), F.avg("longitude").alias("lo")).filter("region is not null")
    corner = lambda y, x: F.struct((C("la") + y).alias("lat"), (C("lo") + x).alias("lon"))
    rings = z.select("region", F.array(corner(0.03, 0.0), corner(0.0, 0.04), corner(-0.03, 0.0), corner(0.0, -0.04)).alias("ring"))
    return containing_regions(p, "npi", "latitude", "longitude", rings, "region", "ring")
