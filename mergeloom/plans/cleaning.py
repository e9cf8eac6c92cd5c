"""Queries of the scalar functions, extraction, rule and quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions import address as A
from mergeloom.functions import parse as P
from mergeloom.functions import text as X
from mergeloom.functions.core import nz, phone10, zip5
from mergeloom.operators.cascade import cascade, invariants, reject_reasons
from mergeloom.operators.spatial import haversine
from mergeloom.plans.linking import PHONE_SQL, PLAIN_WORDS, STREET_SQL, ZIP_SQL
from mergeloom.plans.registry import query
from mergeloom.session import table

C = F.col
_LONGS = "map {'st':'street','ave':'avenue','blvd':'boulevard','rd':'road','dr':'drive','ln':'lane','ct':'court','cir':'circle','pl':'place','sq':'square','ter':'terrace','pkwy':'parkway','hwy':'highway','n':'north','s':'south','e':'east','w':'west','ne':'northeast','nw':'northwest','se':'southeast','sw':'southwest'}"
_STOPS = ",".join(f"'{w}'" for w in PLAIN_WORDS)


@query(f"""select npi, {STREET_SQL.format('address')} street, nullif(array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(lower(nullif(trim(address),'')),'[.,]','','g'),' +',' ','g')),' '), lambda w: coalesce({_LONGS}[w], w)),' '),'') long_form,
 array_to_string(list_slice(string_split({STREET_SQL.format('address')},' '),1,3),' ') core, nullif(regexp_extract(address,'^ *([0-9]+)',1),'') house, left(sha1(concat_ws('|',{STREET_SQL.format('address')},{ZIP_SQL.format('zip')})),16) place_id from practices""")
def address_norm(spark: SparkSession, d: str) -> DataFrame:
    """Three named normalisers, the house number and the place id."""
    a = C("address")
    return table(spark, d, "practices").select(
        "npi", A.street_key(a).alias("street"), A.long_street(a).alias("long_form"), A.street_core(a).alias("core"), A.house_number(a).alias("house"), A.location_id(a, C("zip")).alias("place_id")
    )


@query(f"""with a as (select {STREET_SQL.format('address')} k, lower(nullif(trim(address),'')) r, {ZIP_SQL.format('zip')} z from practices) select z, count(distinct r) spellings, count(distinct k) places from a where r is not null group by 1 having count(distinct r)<>count(distinct k)""")
def normaliser_gain(spark: SparkSession, d: str) -> DataFrame:
    """How many spellings per ZIP the street key merges."""
    a = table(spark, d, "practices").select(A.street_key(C("address")).alias("k"), F.lower(nz("address")).alias("r"), zip5("zip").alias("z")).filter("r is not null")
    return a.groupBy("z").agg(F.countDistinct("r").alias("spellings"), F.countDistinct("k").alias("places")).filter("spellings <> places")


@query(f"""select npi, nullif(array_to_string(list_filter(regexp_extract_all(lower(practice_name),'[a-z0-9]+'), lambda w: len(w)>1 and not list_contains([{_STOPS}],w)),' '),'') brand, left(regexp_replace(regexp_replace(lower(practice_name),'[^a-z0-9]+','-','g'),'^-|-$','','g'),80) slug,
 array_to_string(list_transform(list_zip(string_split(trim(regexp_replace(practice_name,'\\s+',' ','g')),' '), range(len(string_split(trim(regexp_replace(practice_name,'\\s+',' ','g')),' ')))), lambda x: case when upper(x[1]) in ('DDS','DMD','LLC','PC') then upper(x[1]) when x[2]>0 and lower(x[1]) in ('of','and','at','the') then lower(x[1]) else upper(x[1][1:1])||lower(x[1][2:]) end),' ') titled from practices where practice_name is not null""")
def name_norm(spark: SparkSession, d: str) -> DataFrame:
    n = C("practice_name")
    return table(spark, d, "practices").filter("practice_name is not null").select("npi", X.brand_key(n, PLAIN_WORDS).alias("brand"), X.slug(n).alias("slug"), X.title_case(n, ["DDS", "DMD", "LLC", "PC"], ["of", "and", "at", "the"]).alias("titled"))


@query(f"""select npi, {PHONE_SQL.format('phone')} phone, case when {PHONE_SQL.format('phone')} is not null then '('||left({PHONE_SQL.format('phone')},3)||') '||substr({PHONE_SQL.format('phone')},4,3)||'-'||substr({PHONE_SQL.format('phone')},7,4) end shown, {ZIP_SQL.format('zip')} zip5,
 case when upper(trim(state)) in ({",".join(f"'{v}'" for v in P.STATES.values())}) then upper(trim(state)) {" ".join(f"when lower(trim(state))='{k}' then '{v}'" for k, v in P.STATES.items())} end st from practices""")
def phone_zip_state(spark: SparkSession, d: str) -> DataFrame:
    ten = phone10("phone")
    shown = F.when(ten.isNotNull(), F.concat(F.lit("("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4)))
    return table(spark, d, "practices").select("npi", ten.alias("phone"), shown.alias("shown"), zip5("zip").alias("zip5"), P.state_code(C("state")).alias("st"))


@query("""with v as (select id, round(deal_size_mm,1) x from deals where deal_size_mm is not null) select id, case id % 4 when 0 then floor(x*1e6) when 1 then floor(floor(x)*1e6/2) when 2 then floor((floor(x)*1e6+(floor(x)+4)*1e6)/2) else floor(x*1e3*1e3) end::double dollars from v""")
def money_parse(spark: SparkSession, d: str) -> DataFrame:
    """Deal sizes written in four ways, by id ('$3.5 million', 'less than $3M', '3M-7M', '3,500.0K'), and read back."""
    x = F.round("deal_size_mm", 1)
    whole = F.floor(x).cast("string")
    thousands = F.concat((x * 1000).cast("decimal(18,1)").cast("string"), F.lit("K"))
    written = (
        F.when(C("id") % 4 == 0, F.concat(F.lit("$"), x.cast("string"), F.lit(" million"))).when(C("id") % 4 == 1, F.concat(F.lit("less than $"), whole, F.lit("M")))
        .when(C("id") % 4 == 2, F.concat(whole, F.lit("M-"), (F.floor(x) + 4).cast("string"), F.lit("M"))).otherwise(thousands)
    )
    return table(spark, d, "deals").filter("deal_size_mm is not null").select("id", P.money(written).cast("double").alias("dollars"))


@query("""select id, strftime(deal_date,'%Y-%m-%d') as "day" from deals where deal_date is not null""")
def date_multi_parse(spark: SparkSession, d: str) -> DataFrame:
    """Days written in one of five formats, by id, and read back."""
    forms = ["yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy"]
    written = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        written = F.when(C("id") % 5 == i, F.date_format("deal_date", f)).otherwise(written)
    return table(spark, d, "deals").filter("deal_date is not null").select("id", F.date_format(P.any_date(written), "yyyy-MM-dd").alias("day"))


@query("""select event_id, cast(json_extract(props,'$.k') as bigint)::double k, round(case when value between 0 and 1 then value*100 else value end,6) pct from events""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """A number from a JSON column, and a fraction or percentage as percentage."""
    e = table(spark, d, "events")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").cast("double").alias("k"), F.round(F.when(C("value").between(0, 1), C("value") * 100).otherwise(C("value")), 6).alias("pct"))


@query(f"""with e as (select npi, regexp_replace(coalesce(ein,''),'[^0-9]','','g') x from practices) select npi, case when len(x)=9 and list_max(list_transform(range(0,10), lambda i: 9-len(replace(x,i::varchar,''))))<6 and x not in ('123456789','987654321') then x end ein from e""")
def ein_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "practices").select("npi", P.ein(C("ein")).alias("ein"))


@query("""select id, nullif(regexp_extract(lower(trim(source_url)),'^https?://(www\\.)?([^/:?#]+)',2),'') host, sha1(coalesce(source_url,'')) h1, md5(coalesce(source_url,'')) h2 from deals""")
def url_host_hash(spark: SparkSession, d: str) -> DataFrame:
    raw = F.coalesce("source_url", F.lit("")).cast("binary")
    return table(spark, d, "deals").select("id", X.host(C("source_url")).alias("host"), F.sha1(raw).alias("h1"), F.md5(raw).alias("h2"))


@query("""with p as (select npi, latitude la, longitude lo from practices where abs(latitude)<=90 and abs(longitude)<=180) select npi, round(2*3958.8*asin(sqrt(least(1,pow(sin(radians(la-40)/2),2)+cos(radians(la))*cos(radians(40))*pow(sin(radians(lo+100)/2),2)))),4) miles from p""")
def haversine_miles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "practices").filter((F.abs("latitude") <= 90) & (F.abs("longitude") <= 180))
    return p.select("npi", F.round(haversine(C("latitude"), C("longitude"), F.lit(40.0), F.lit(-100.0)), 4).alias("miles"))


@query("""select doc_id from documents where regexp_matches(text, '[‘’“”–—áéíóúñü]')""")
def curly_marks(spark: SparkSession, d: str) -> DataFrame:
    """Texts with marks or letters beyond plain ASCII that a cleaning step would change."""
    return table(spark, d, "documents").filter(C("text").rlike("[‘’“”–—áéíóúñü]")).select("doc_id")


@query("""select doc_id, source from documents where regexp_matches(lower(text),'(^|[^a-z0-9])(lease|operatories|rota)([^a-z0-9]|$)')""")
def relevant_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold one of several words as a whole."""
    return table(spark, d, "documents").filter(F.lower("text").rlike(X.any_word(["lease", "operatories", "rota"]))).select("doc_id", "source")


_GUARD = "regexp_replace(text, '\\b(Dr|Mr|Mrs|Ms|St|Inc|Ltd|Co|Jr|Sr|No|[A-Z])\\.', '\\1' || chr(1), 'g')"


@query(f"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace({_GUARD}, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x<>'') xs from documents) select doc_id, i - 1 as "no", xs[i] sentence from s, unnest(range(1, len(xs) + 1)) t(i)""")
def deal_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the news texts in order."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(C("text"))).alias("no", "sentence"))


@query("""select id, nullif(regexp_extract(raw_text,' backed by ([A-Z][A-Za-z ]+),',1),'') backer, nullif(regexp_extract(raw_text,'[, ]([A-Z]{2})[).]',1),'') st, case when regexp_matches(raw_text,'acquired') then 'buyout' when regexp_matches(raw_text,' added ') then 'add-on' when regexp_matches(raw_text,'joined|now part of') then 'affiliation' else 'unknown' end kind from deals where raw_text is not null""")
def deal_text_fields(spark: SparkSession, d: str) -> DataFrame:
    """Backer, state and kind of deal from a sentence, the first rule that holds."""
    t = C("raw_text")
    rules = [(t.contains("acquired"), "buyout", "verb acquired", 90), (t.contains(" added "), "add-on", "verb added", 90), (t.rlike("joined|now part of"), "affiliation", "joined", 80)]
    kind = cascade(rules, ("unknown", "no verb", 0))
    part = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return table(spark, d, "deals").filter("raw_text is not null").select("id", part(" backed by ([A-Z][A-Za-z ]+),").alias("backer"), part("[, ]([A-Z]{2})[).]").alias("st"), kind["label"].alias("kind"))


@query("""select d.id, trim(u.s) st from deals d, unnest(string_split(coalesce(upper(target_state),''),',')) u(s)""")
def states_exploded(spark: SparkSession, d: str) -> DataFrame:
    """One row per state of a deal; a deal without state keeps one empty row."""
    return table(spark, d, "deals").select("id", F.explode_outer(F.split(F.coalesce(F.upper("target_state"), F.lit("")), ",")).alias("st")).select("id", F.trim("st").alias("st"))


_CHECKS = {"no_phone": "nullif(trim(phone),'') is null", "bad_zip": f"not regexp_matches(coalesce({ZIP_SQL.format('zip')},''),'^[0-9]{{5}}$')", "no_address": "nullif(trim(address),'') is null", "bad_place": "latitude is null or abs(latitude)>90 or abs(longitude)>180"}


@query("select npi, array_to_string(list_filter([" + ",".join(f"case when coalesce({c},false) then '{n}' end" for n, c in _CHECKS.items()) + "], lambda x: x is not null),'+') reasons from practices")
def admission(spark: SparkSession, d: str) -> DataFrame:
    """All reasons for which a row would be refused."""
    checks = {"no_phone": nz("phone").isNull(), "bad_zip": ~F.coalesce(zip5("zip"), F.lit("")).rlike("^[0-9]{5}$"), "no_address": nz("address").isNull(), "bad_place": C("latitude").isNull() | (F.abs("latitude") > 90) | (F.abs("longitude") > 180)}
    return table(spark, d, "practices").select("npi", F.array_join(reject_reasons(checks), "+").alias("reasons"))


@query("""select 'npi_ten_digits' check_name, count(case when not regexp_matches(npi,'^[0-9]{10}$') then 1 end) found, case when count(case when not regexp_matches(npi,'^[0-9]{10}$') then 1 end)>0 then 'FAIL' else 'PASS' end status from practices
 union all select 'group_without_status', count(case when affiliated_dso is not null and ownership_status='independent' then 1 end), case when count(case when affiliated_dso is not null and ownership_status='independent' then 1 end)>0 then 'WARN' else 'PASS' end from practices
 union all select 'firms_present', count(case when entity_type in ('organization','2') then 1 end), case when count(case when entity_type in ('organization','2') then 1 end)<100 then 'FAIL' else 'PASS' end from practices""")
def invariant_checks(spark: SparkSession, d: str) -> DataFrame:
    return invariants(
        table(spark, d, "practices"),
        [
            ("npi_ten_digits", ~C("npi").rlike("^[0-9]{10}$"), None, 0, "FAIL"),
            ("group_without_status", C("affiliated_dso").isNotNull() & (C("ownership_status") == "independent"), None, 0, "WARN"),
            ("firms_present", C("entity_type").isin("organization", "2"), 100, None, "FAIL"),
        ],
    )


@query(f"""with a as (select {ZIP_SQL.format('zip')} z, count(*) n from practices group by 1), b as (select {ZIP_SQL.format('zip_code')} z, count(*) n from practice_signals group by 1) select coalesce(a.z,b.z) z, coalesce(a.n,0) n_practices, coalesce(b.n,0) n_signals from a full join b on a.z is not distinct from b.z where coalesce(a.n,0)<>coalesce(b.n,0)""")
def denominator_equality(spark: SparkSession, d: str) -> DataFrame:
    """ZIPs whose row counts disagree between two tables."""
    a = table(spark, d, "practices").groupBy(zip5("zip").alias("z")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "practice_signals").groupBy(zip5("zip_code").alias("z")).agg(F.count(F.lit(1)).alias("m"))
    j = a.alias("a").join(b.alias("b"), C("a.z").eqNullSafe(C("b.z")), "full").select(F.coalesce("a.z", "b.z").alias("z"), F.coalesce("n", F.lit(0)).alias("n_practices"), F.coalesce("m", F.lit(0)).alias("n_signals"))
    return j.filter("n_practices <> n_signals")


@query(f"""with a as (select {ZIP_SQL.format('zip')} z, {PHONE_SQL.format('phone')} ph, array_to_string(list_slice(string_split({STREET_SQL.format('address')},' '),1,3),' ') c, {STREET_SQL.format('address')} s from practices) select z, ph, c, count(*) n, count(distinct s) spellings from a where z is not null and ph is not null and c is not null group by 1,2,3 having count(*)>1""")
def duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    """Rows that share ZIP, telephone and the first words of the street."""
    a = table(spark, d, "practices").select(zip5("zip").alias("z"), phone10("phone").alias("ph"), A.street_core(C("address")).alias("c"), A.street_key(C("address")).alias("s")).dropna(subset=["z", "ph", "c"])
    return a.groupBy("z", "ph", "c").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("spellings")).filter("n > 1")


@query("""select t, n from (select 'practices' t, count(*) n from practices union all select 'practices_replica', count(*) from practices_replica union all select 'practice_signals', count(*) from practice_signals)""")
def count_verification(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("practices", "practices_replica", "practice_signals"):
        one = table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("select link_id from practice_links where trim(npi_a) not in (select npi from practices) or trim(npi_b) not in (select npi from practices) or npi_a is null or npi_b is null")
def orphan_links(spark: SparkSession, d: str) -> DataFrame:
    """Links with an end that no practice has."""
    p = table(spark, d, "practices").select("npi")
    links = table(spark, d, "practice_links")
    ends = links.select("link_id", F.explode(F.array(F.trim("npi_a"), F.trim("npi_b"))).alias("npi"))
    return ends.join(p, "npi", "left_anti").select("link_id").distinct()


@query("select user_id, count(*) n, round(sum(value),4) total, max(case event_type when 'purchase' then 1 else 0 end)::bigint bought from events group by 1")
def user_activity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max(F.when(C("event_type") == "purchase", 1).otherwise(0)).cast("bigint").alias("bought"))


@query("""select l_returnflag, l_linestatus, cast(sum(l_quantity) as double) sum_qty, round(sum(l_extendedprice*(1-l_discount)),2) revenue, count(*) n from lineitem where l_shipdate<=timestamp '1998-09-02' group by 1,2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter(C("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""select n_name, r_name, count(distinct c_custkey) customers, count(o_orderkey) orders, round(coalesce(sum(o_totalprice),0),2) total from nation join region on n_regionkey=r_regionkey left join customer on c_nationkey=n_nationkey left join orders on o_custkey=c_custkey group by 1,2""")
def market_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Order volumes summed per customer before the join, so that the join carries one row per customer."""
    per = table(spark, d, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("k"), F.sum("o_totalprice").alias("s"))
    c = table(spark, d, "customer").select("c_custkey", C("c_nationkey").alias("n_nationkey")).join(per, "c_custkey", "left")
    g = c.groupBy("n_nationkey").agg(F.count("c_custkey").alias("customers"), F.sum("k").alias("orders"), F.sum("s").alias("total"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    n = table(spark, d, "nation").join(table(spark, d, "region"), C("n_regionkey") == C("r_regionkey")).join(g, "n_nationkey", "left")
    return n.select("n_name", "r_name", zero("customers").alias("customers"), zero("orders").alias("orders"), F.round(zero("total"), 2).alias("total"))
