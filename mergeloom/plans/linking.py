"""Queries of the matching, clustering, merging and change-capture operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.address import house_number, location_id, street_key, xref_key
from mergeloom.functions.core import digits, nz, phone10, zip5
from mergeloom.functions.fuzzy import ratio, token_sort
from mergeloom.functions.text import host
from mergeloom.operators.graph import clusters_by_key, connected_components, propagate
from mergeloom.operators.matching import band_pairs, fuzzy_match, longest_pattern
from mergeloom.operators.merge import change_events, collapse, first_known, keep_first, pull, upsert
from mergeloom.operators.spatial import near_pairs, near_places, placed
from mergeloom.plans.registry import query
from mergeloom.session import table

#: The same normalisers in SQL.
_UP = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(nullif(trim({0}),'')),'[.]','','g'),'[ ,]+(SUITE|STE|UNIT|APT|ROOM|RM|FLOOR|FL|BLDG|#)[ .#]*[A-Z0-9-]*.*$',''),'[^A-Z0-9 ]',' ','g'),' +',' ','g'))"
_SHORTS = "map {{'STREET':'ST','AVENUE':'AVE','BOULEVARD':'BLVD','ROAD':'RD','DRIVE':'DR','LANE':'LN','COURT':'CT','CIRCLE':'CIR','PLACE':'PL','SQUARE':'SQ','TERRACE':'TER','PARKWAY':'PKWY','HIGHWAY':'HWY','NORTH':'N','SOUTH':'S','EAST':'E','WEST':'W','NORTHEAST':'NE','NORTHWEST':'NW','SOUTHEAST':'SE','SOUTHWEST':'SW'}}"
STREET_SQL = "nullif(array_to_string(list_transform(string_split(" + _UP + ",' '), lambda w: coalesce(" + _SHORTS + "[w], w)),' '),'')"
ZIP_SQL = "left(nullif(trim({0}),''),5)"
PHONE_SQL = "nullif(regexp_extract(regexp_replace(coalesce({0},''),'[^0-9]','','g'),'^1?([0-9]{{10}})$',1),'')"
#: Longest common subsequence of two texts in SQL.
LCS_SQL = """list_reduce(string_split({0},''), lambda prev,ca: list_reduce(range(1,len({1})+1), lambda cur,j: list_append(cur, greatest(prev[j+1], cur[j], prev[j] + case when substr({1},j,1)=ca then 1 else 0 end)), [0::bigint]), list_transform(range(0,len({1})+1), lambda x: 0::bigint))[-1]"""
RATIO_SQL = "(200.0*" + LCS_SQL + "/(len({0})+len({1})))"
TOKEN_SQL = "array_to_string(list_sort(list_filter(regexp_split_to_array(trim({0}),'\\s+'), lambda w: w<>'')),' ')"

_P = f"select npi, {STREET_SQL.format('address')} s, {ZIP_SQL.format('zip')} z, nullif(regexp_extract(address,'^ *([0-9]+)',1),'') h from practices"
_O = f"select id, {STREET_SQL.format('address')} s, {ZIP_SQL.format('zip')} z, nullif(regexp_extract(address,'^ *([0-9]+)',1),'') h from dso_locations"


def _streets(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    return table(spark, d, name).select(key, street_key(F.col("address")).alias("s"), zip5("zip").alias("z"), house_number(F.col("address")).alias("h"))


def _scored(where: str, pick: str) -> str:
    return f"""with p as ({_P}), o as ({_O}), c as (select o.id, p.npi, o.s os, p.s ps from o join p on o.z=p.z and o.h=p.h where levenshtein(o.s,p.s) <= floor(0.15*(len(o.s)+len(p.s)))),
 r as (select id, npi, {RATIO_SQL.format('os', 'ps')} score from c), q as (select *, row_number() over (partition by id order by {pick}) rn from r where {where}) select id, npi, round(score,4) score from q where rn=1"""


@query(_scored("score >= 85", "score desc, npi"))
def fuzzy_block_best(spark: SparkSession, d: str) -> DataFrame:
    """Offices with the practice of most similar street in their ZIP, house number equal."""
    out = fuzzy_match(_streets(spark, d, "dso_locations", "id"), _streets(spark, d, "practices", "npi"), ["z", "h"], "s", "s", "id", "npi", 85)
    return out.withColumn("score", F.round("score", 4))


@query(_scored("score > 90", "npi"))
def fuzzy_block_first(spark: SparkSession, d: str) -> DataFrame:
    """The first practice, not the best, strictly above the threshold."""
    out = fuzzy_match(_streets(spark, d, "dso_locations", "id"), _streets(spark, d, "practices", "npi"), ["z", "h"], "s", "s", "id", "npi", 90, first=True, strict=True)
    return out.withColumn("score", F.round("score", 4))


@query(f"""select distinct a.npi, a.practice_name old_name, trim(b.practice_name) new_name, round({RATIO_SQL.format("lower(a.practice_name)", "lower(trim(b.practice_name))")},4) r, round({RATIO_SQL.format(TOKEN_SQL.format("lower(a.practice_name)"), TOKEN_SQL.format("lower(trim(b.practice_name))"))},4) ts
  from practices a join practices_replica b on a.npi=trim(b.npi) where lower(a.practice_name)<>lower(trim(b.practice_name)) and len(trim(a.practice_name))>0 and len(trim(b.practice_name))>0""")
def name_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Indel ratio and token-sort ratio of names that changed between the copies."""
    b = table(spark, d, "practices_replica").select(F.trim("npi").alias("npi"), F.trim("practice_name").alias("new_name"))
    a = table(spark, d, "practices").select("npi", F.col("practice_name").alias("old_name"))
    x, y = F.lower("old_name"), F.lower("new_name")
    pairs = a.join(b, "npi").filter((x != y) & (F.length(F.trim("old_name")) > 0) & (F.length("new_name") > 0)).distinct()
    return pairs.select("npi", "old_name", "new_name", F.round(ratio(x, y), 4).alias("r"), F.round(ratio(token_sort(x), token_sort(y)), 4).alias("ts"))


@query("""with b as (select distinct lower(trim(platform_company)) p from deals where trim(platform_company)<>''), m as (select npi, p, row_number() over (partition by npi order by len(p) desc, p) rn from practices, b where contains(lower(practice_name), p)) select x.npi, m.p pattern from practices x left join m on m.npi=x.npi and rn=1""")
def brand_contains_longest(spark: SparkSession, d: str) -> DataFrame:
    return longest_pattern(table(spark, d, "practices"), "practice_name", table(spark, d, "deals"), "platform_company", "npi")


@query("""select a.id id_a, b.id id_b from deals a join deals b on lower(trim(a.target_name))=lower(trim(b.target_name)) and upper(trim(a.target_state))=upper(trim(b.target_state)) and a.id<b.id and trim(a.target_name)<>'' where abs(datediff('day',a.deal_date,b.deal_date))<=60""")
def band_join_60d(spark: SparkSession, d: str) -> DataFrame:
    """The same target reported twice within sixty days."""
    e = table(spark, d, "deals").withColumn("t", F.lower(nz("target_name"))).withColumn("st", F.upper(F.trim("target_state"))).filter("t is not null")
    return band_pairs(e, ["t", "st"], "deal_date", 60, "id")


def _near_sql(where: str) -> str:
    return f"""v as (select npi, latitude la, longitude lo, floor(latitude/0.004)::int g from practices where abs(latitude)<=90 and abs(longitude)<=180 and not (latitude=0 and longitude=0) and {where}), w as (select npi, la, lo, g+dx g from v, (select unnest([-1,0,1]) dx)),
 e as (select distinct a.npi a, b.npi b from v a join w b using (g) where a.npi<>b.npi and 2*3958.8*asin(sqrt(pow(sin(radians(a.la-b.la)/2),2)+cos(radians(a.la))*cos(radians(b.la))*pow(sin(radians(a.lo-b.lo)/2),2)))<=0.25)"""


@query(f"""with recursive {_near_sql("entity_type in ('organization','2')")}, r(v,c) as (select a, a from e union select e.b, r.c from r join e on r.v=e.a), k as (select v, min(c) c from r group by 1), s as (select c, count(*) n from k group by 1)
 select v npi, c as component, n from k join s using (c) where n>=3""")
def spatial_micro(spark: SparkSession, d: str) -> DataFrame:
    """Groups of at least three firms linked by distances of a quarter mile."""
    p = table(spark, d, "practices").filter(F.col("entity_type").isin("organization", "2"))
    k = connected_components(near_pairs(p, "npi", "latitude", "longitude", 0.25), "npi_a", "npi_b")
    sizes = k.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return k.join(sizes, "component").select(F.col("vertex").alias("npi"), "component", "n")


@query("""with recursive e as (select trim(npi_a) a, trim(npi_b) b from practice_links where trim(npi_a)<>trim(npi_b)), f as (select a,b from e union select b,a from e), r(v,c) as (select a, a from f union select f.b, r.c from r join f on r.v=f.a) select v as vertex, min(c) component from r group by 1""")
def cc_linkage(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "practice_links").select(F.trim("npi_a").alias("a"), F.trim("npi_b").alias("b"))
    return connected_components(links, "a", "b")


@query("""with c as (select upper(trim(state)) st, lower(trim(city)) ct, avg(latitude) la, avg(longitude) lo from practices where abs(latitude)<=90 and abs(longitude)<=180 and not (latitude=0 and longitude=0) group by 1,2), z as (select left(nullif(trim(zip),''),5) z, avg(latitude) la, avg(longitude) lo from practices where abs(latitude)<=90 and abs(longitude)<=180 and not (latitude=0 and longitude=0) group by 1)
 select d.id, round(coalesce(z.la,c.la),6) lat, round(coalesce(z.lo,c.lo),6) lon from deals d left join z on z.z=left(nullif(trim(target_zip),''),5) left join c on c.st=upper(trim(target_state)) and c.ct=lower(trim(target_city))""")
def centroid_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Deals placed at the centre of their ZIP, else of their city."""
    p = table(spark, d, "practices").filter(placed(F.col("latitude"), F.col("longitude")))
    mean = (F.avg("latitude").alias("la"), F.avg("longitude").alias("lo"))
    z = p.groupBy(zip5("zip").alias("z")).agg(*mean).toDF("z", "zla", "zlo")
    c = p.groupBy(F.upper(F.trim("state")).alias("st"), F.lower(F.trim("city")).alias("ct")).agg(*mean).toDF("st", "ct", "cla", "clo")
    e = table(spark, d, "deals").select("id", zip5("target_zip").alias("z"), F.upper(F.trim("target_state")).alias("st"), F.lower(F.trim("target_city")).alias("ct"))
    return e.join(z, "z", "left").join(c, ["st", "ct"], "left").select("id", F.round(F.coalesce("zla", "cla"), 6).alias("lat"), F.round(F.coalesce("zlo", "clo"), 6).alias("lon"))


@query("""with z as (select left(nullif(trim(zip),''),5) z, avg(latitude) la, avg(longitude) lo from practices where abs(latitude)<=90 and abs(longitude)<=180 and not (latitude=0 and longitude=0) group by 1), e as (select id, la, lo, upper(nullif(trim(target_state),'')) st from deals join z on z.z=left(nullif(trim(target_zip),''),5)),
 p as (select npi, latitude la, longitude lo, upper(nullif(trim(state),'')) st from practices where abs(latitude)<=90 and abs(longitude)<=180 and not (latitude=0 and longitude=0))
 select npi, count(*) deals_near from p join e on abs(p.la-e.la)<0.03 and 2*3958.8*asin(sqrt(pow(sin(radians(p.la-e.la)/2),2)+cos(radians(p.la))*cos(radians(e.la))*pow(sin(radians(p.lo-e.lo)/2),2)))<=2 and coalesce(p.st=e.st,true) group by 1""")
def catchment_2mi(spark: SparkSession, d: str) -> DataFrame:
    """Deals within two miles of each practice, by the centres of their ZIPs; states must agree where both are known."""
    p = table(spark, d, "practices").filter(placed(F.col("latitude"), F.col("longitude")))
    z = p.groupBy(zip5("zip").alias("z")).agg(F.avg("latitude").alias("ela"), F.avg("longitude").alias("elo"))
    state = lambda c: F.upper(nz(c))
    # Deals of one ZIP share its centre: they are counted first and meet practices once per centre.
    e = table(spark, d, "deals").select(zip5("target_zip").alias("z"), state("target_state").alias("est")).groupBy("z", "est").agg(F.count(F.lit(1)).alias("k"))
    near = near_places(p, "npi", "latitude", "longitude", z.join(e.select("z").distinct(), "z", "left_semi"), "z", "ela", "elo", 2)
    near = near.join(p.select("npi", state("state").alias("st")), "npi").join(e, "z").filter("st is null or est is null or st = est")
    return near.groupBy("npi").agg(F.sum("k").alias("deals_near"))


@query("""with e as (select vec_id, embedding v from embeddings), q as (select * from e where vec_id % 50 = 0), s as (select q.vec_id qid, e.vec_id hit, list_cosine_similarity(q.v::double[], e.v::double[]) c from q, e where q.vec_id<>e.vec_id) select qid, hit, round(c,5) c from (select *, row_number() over (partition by qid order by round(c,5) desc, hit) rn from s) where rn<=5""")
def embedding_cosine_top5(spark: SparkSession, d: str) -> DataFrame:
    """Queries are all vectors whose id is divisible by 50, held in bounded blocks; each scans all vectors once."""
    from mergeloom.operators.vectors import nearest

    e = table(spark, d, "embeddings")
    return nearest(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)


def _zip_features(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "practices").withColumn("z", zip5("zip")).filter("z is not null")
    return p.groupBy("z").agg(
        F.count(F.lit(1)).cast("double").alias("f0"), F.coalesce(F.avg("num_providers"), F.lit(0.0)).alias("f1"), F.coalesce(F.avg("buyability_score"), F.lit(0.0)).alias("f2"),
        (F.count_if(F.col("ownership_status").isin("dso_affiliated", "pe_backed")) / F.count(F.lit(1))).alias("f3"),
    )


@query("""with z as (select left(nullif(trim(zip),''),5) z, count(*)::double f0, coalesce(avg(num_providers),0) f1, coalesce(avg(buyability_score),0) f2, count(case when ownership_status in ('dso_affiliated','pe_backed') then 1 end)/count(*) f3 from practices where left(nullif(trim(zip),''),5) is not null group by 1),
 s as (select z, (f0-avg(f0) over())/coalesce(nullif(stddev_pop(f0) over(),0),1) a, (f1-avg(f1) over())/coalesce(nullif(stddev_pop(f1) over(),0),1) b, (f2-avg(f2) over())/coalesce(nullif(stddev_pop(f2) over(),0),1) c, (f3-avg(f3) over())/coalesce(nullif(stddev_pop(f3) over(),0),1) e, f3 from z),
 m as (select x.z, y.z mirror, (x.a*y.a+x.b*y.b+x.c*y.c+x.e*y.e)/(sqrt(x.a*x.a+x.b*x.b+x.c*x.c+x.e*x.e)*sqrt(y.a*y.a+y.b*y.b+y.c*y.c+y.e*y.e)) cos from s x, s y where x.z<>y.z)
 select z, mirror, round(cos,4) cos from (select *, row_number() over (partition by z order by round(cos,4) desc, mirror) rn from m where round(cos,4)>=0.9) where rn<=5""")
def mirror_pairs(spark: SparkSession, d: str) -> DataFrame:
    """For each ZIP the five most similar profiles by cosine of z-scores; there are at most 100,000 ZIPs."""
    from mergeloom.operators.vectors import nearest

    f = _zip_features(spark, d)
    stats = f.agg(F.struct(*[g(f"f{i}").alias(f"{n}{i}") for i in range(4) for g, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).alias("q"))
    f = f.withColumn("q", stats.scalar())
    v = F.array(*[(F.col(f"f{i}") - F.col(f"q.m{i}")) / F.when(F.col(f"q.s{i}") == 0, 1.0).otherwise(F.col(f"q.s{i}")) for i in range(4)])
    z = f.select("z", v.alias("v"))
    return nearest(z, z, "z", "v", 5, 0.9, digits=4).toDF("z", "mirror", "cos")


def _cluster_sql(key: str, least_members: int, least_places: int) -> str:
    return f"with k as (select {key} cluster_key, npi, {ZIP_SQL.format('zip')} z from practices) select cluster_key, count(distinct npi) members, count(distinct z) places from k where cluster_key is not null group by 1 having count(distinct npi)>={least_members} and count(distinct z)>={least_places}"


@query(_cluster_sql("case when regexp_matches(regexp_replace(coalesce(ein,''),'[^0-9]','','g'),'^[0-9]{9}$') then regexp_replace(ein,'[^0-9]','','g') end", 2, 2))
def clusters_by_ein(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "practices")
    return clusters_by_key(p, F.when(F.length(digits("ein")) == 9, digits("ein")), "npi", zip5("zip"), 2, 2)


@query(_cluster_sql("nullif(lower(trim(parent_company)),'')", 3, 3))
def clusters_by_parent(spark: SparkSession, d: str) -> DataFrame:
    return clusters_by_key(table(spark, d, "practices"), F.lower("parent_company"), "npi", zip5("zip"), 3, 3)


@query(_cluster_sql(PHONE_SQL.format("phone"), 2, 1) + " and count(distinct npi)<=50")
def clusters_by_phone(spark: SparkSession, d: str) -> DataFrame:
    """Shared telephones; over-broad ones are answering services."""
    return clusters_by_key(table(spark, d, "practices"), phone10("phone"), "npi", zip5("zip"), 2, 1, 50)


@query(_cluster_sql("nullif(regexp_extract(lower(trim(website)),'^https?://(www\\.)?([^/:?#]+)',2),'')", 2, 2))
def clusters_by_site(spark: SparkSession, d: str) -> DataFrame:
    return clusters_by_key(table(spark, d, "practices"), host(F.col("website")), "npi", zip5("zip"), 2, 2)


# Words of names of firms that this library's own queries treat as telling nothing.
PLAIN_WORDS = ["dental", "dentistry", "family", "llc", "inc", "pc", "the", "and", "of", "at"]


@query("""with p as (select npi, nullif(trim(ein),'') k, nullif(affiliated_dso,'') a from practices), f as (select k, a from (select *, row_number() over (partition by k order by npi) rn from p where k is not null and a is not null) where rn=1) select p.npi, coalesce(p.a, f.a) affiliated_dso from p left join f using (k)""")
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Affiliations carried over to the rows that share an employer number, one hop."""
    p = table(spark, d, "practices").select("npi", "ein", F.nullif("affiliated_dso", F.lit("")).alias("affiliated_dso"))
    return propagate(p, F.col("ein"), "affiliated_dso", "npi", [""]).select("npi", "affiliated_dso")


@query(f"""with p as (select *, {STREET_SQL.format('address')} s, {ZIP_SQL.format('zip')} z from practices), k as (select *, left(sha1(s||coalesce('|'||z,'')),16) loc from p where s is not null)
 select loc, z, count(*) n, arg_min(coalesce(nullif(doing_business_as,''),practice_name), case when entity_type in ('organization','2') then '0' else '1' end||npi) display_name, max(employee_count)::double max_employee_count, min(year_established)::double min_year_established, array_to_string(list_sort(list_distinct(list(taxonomy_code))),',') taxonomies, arg_min(phone, npi) filter (nullif(trim(phone),'') is not null) phone from k group by 1,2""")
def location_collapse(spark: SparkSession, d: str) -> DataFrame:
    """One row per street and ZIP: firm's name first, extremes, first known telephone, set of taxonomies."""
    p = table(spark, d, "practices").withColumn("s", street_key(F.col("address"))).withColumn("z", zip5("zip")).filter("s is not null")
    p = p.withColumn("loc", location_id(F.col("address"), F.col("zip"))).withColumn("phone", F.when(nz("phone").isNotNull(), F.col("phone")))
    order = F.concat(F.when(F.col("entity_type").isin("organization", "2"), "0").otherwise("1"), F.col("npi"))
    p = p.withColumn("display_name", F.coalesce(F.nullif("doing_business_as", F.lit("")), "practice_name"))
    names = p.groupBy("loc", "z").agg(first_known("display_name", order).alias("display_name"))
    rest = collapse(p, ["loc", "z"], F.col("npi"), ["phone"], ["employee_count"], ["year_established"], {"taxonomies": "taxonomy_code"})
    return rest.alias("r").join(names.alias("n"), (F.col("r.loc") == F.col("n.loc")) & F.col("r.z").eqNullSafe(F.col("n.z"))).select("r.*", "display_name").withColumns({c: F.col(c).cast("double") for c in ("max_employee_count", "min_year_established")})


@query(f"""with p as (select {ZIP_SQL.format('zip')} z, lower(trim(city)) c, {STREET_SQL.format('address')} s, entity_type in ('organization','2') org from practices where {ZIP_SQL.format('zip')} is not null), g as (select z, c, coalesce(s,'') s, count(*) n, max(org::int) o from p group by 1,2,3)
 select z, cast(sum(case when s='' or n>=50 or o=0 then n else 1 end) as bigint) doors, count(*) addresses from g group by 1""")
def collapsed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Doors per ZIP: rows at one street count once if a firm is among them, each for itself otherwise."""
    p = table(spark, d, "practices").select(zip5("zip").alias("z"), F.lower(F.trim("city")).alias("c"), F.coalesce(street_key(F.col("address")), F.lit("")).alias("s"), F.col("entity_type").isin("organization", "2").alias("org")).filter("z is not null")
    g = p.groupBy("z", "c", "s").agg(F.count(F.lit(1)).alias("n"), F.max("org").alias("o"))
    return g.groupBy("z").agg(F.sum(F.when((F.col("s") == "") | (F.col("n") >= 50) | ~F.coalesce("o", F.lit(False)), F.col("n")).otherwise(1)).alias("doors"), F.count(F.lit(1)).alias("addresses"))


@query(f"""with a as (select npi, {STREET_SQL.format('address')} s, {ZIP_SQL.format('zip')} z, nullif(trim(phone),'') ph, nullif(trim(ein),'') e, nullif(trim(website),'') w from practices),
 x as (select s, z, arg_min(e, npi) filter (e is not null) e, arg_min(w, npi) filter (w is not null) w from a where s is not null and z is not null group by 1,2), y as (select ph, arg_min(e, npi) filter (e is not null) e, arg_min(w, npi) filter (w is not null) w from a where ph is not null group by 1)
 select a.npi, coalesce(a.e, x.e, y.e) ein, coalesce(a.w, x.w, y.w) website from a left join x on x.s=a.s and x.z=a.z left join y on y.ph=a.ph""")
def two_key_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Gaps filled from rows at the same street first, from rows with the same telephone second."""
    a = table(spark, d, "practices").select("npi", street_key(F.col("address")).alias("s"), zip5("zip").alias("z"), nz("phone").alias("ph"), nz("ein").alias("e"), nz("website").alias("w"))
    by = lambda keys, n: a.dropna(subset=keys).groupBy(*keys).agg(first_known("e", F.col("npi")).alias(f"e{n}"), first_known("w", F.col("npi")).alias(f"w{n}"))
    out = a.join(by(["s", "z"], 1), ["s", "z"], "left").join(by(["ph"], 2), "ph", "left")
    return out.select("npi", F.coalesce("e", "e1", "e2").alias("ein"), F.coalesce("w", "w1", "w2").alias("website"))


@query(f"""with p as (select npi, {STREET_SQL.format('address')} s, {ZIP_SQL.format('zip')} z, entity_classification c from practices), l as (select s, z, list(npi) npis, arg_min(c, npi) filter (c is not null) c from p where s is not null group by 1,2), u as (select unnest(npis) npi, c from l) select npi, c as class_name from u where c is not null""")
def bridge_backprop(spark: SparkSession, d: str) -> DataFrame:
    """A place's class carried back to all registrations at it."""
    p = table(spark, d, "practices").select("npi", street_key(F.col("address")).alias("s"), zip5("zip").alias("z"), "entity_classification").filter("s is not null")
    places = p.groupBy("s", "z").agg(first_known("entity_classification", F.col("npi")).alias("class_name")).filter("class_name is not null")
    return p.alias("p").join(places.alias("l"), (F.col("p.s") == F.col("l.s")) & F.col("p.z").eqNullSafe(F.col("l.z"))).select("npi", "class_name")


_R = "(select * from (select trim(npi) npi, * exclude (npi), row_number() over (partition by trim(npi) order by updated_at desc nulls last, id) rn from practices_replica) where rn=1)"


def _replica(spark: SparkSession, d: str) -> DataFrame:
    """The newest row per key of the serving copy."""
    r = table(spark, d, "practices_replica").withColumn("npi", F.trim("npi"))
    return keep_first(r, ["npi"], [F.desc_nulls_last("updated_at"), F.asc("id")])


CHANGE_FIELDS = ["practice_name", "address", "city", "phone", "ownership_status", "affiliated_dso"]


@query(" union all ".join(f"select a.npi, '{f}' field_changed, b.{f} old_value, a.{f} new_value from practices a join {_R} b using (npi) where a.{f}<>b.{f}" for f in CHANGE_FIELDS))
def row_diff_events(spark: SparkSession, d: str) -> DataFrame:
    """Change events from the serving copy to the source; a null on either side is no event."""
    return change_events(_replica(spark, d), table(spark, d, "practices"), "npi", CHANGE_FIELDS)


@query("""with w as (select max(id) - 500 last_id, max(updated_at) - interval 30 day last_sync from practices) select npi, id from practices, w where id > last_id or (id <= last_id and updated_at > last_sync)""")
def watermark_pull(spark: SparkSession, d: str) -> DataFrame:
    """New ids and late updates past a watermark."""
    p = table(spark, d, "practices")
    last_id, last_sync = p.agg(F.max("id") - 500).scalar(), p.agg(F.max("updated_at") - F.expr("interval 30 days")).scalar()
    return pull(p, "id", last_id, "updated_at", last_sync).select("npi", "id")


@query(f"""select coalesce(p.npi, r.npi) npi, coalesce(r.practice_name, p.practice_name) practice_name, coalesce(r.city, p.city) city, case when p.npi is null or p.ownership_status is null or p.ownership_status='unknown' then coalesce(r.ownership_status, p.ownership_status) else p.ownership_status end ownership_status from practices p full join {_R} r on p.npi=r.npi""")
def upsert_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Non-null values of the copy overwrite; a known ownership stays."""
    cols = ["npi", "practice_name", "city", "ownership_status"]
    return upsert(table(spark, d, "practices").select(*cols), _replica(spark, d).select(*cols), "npi", {"ownership_status": ["unknown"]})


@query("""select npi, strftime(change_date,'%Y-%m-%d') as "day", lower(trim(field_changed)) f, trim(new_value) v, min(id) id from practice_changes where change_date is not null group by 1,2,3,4""")
def duplicate_events(spark: SparkSession, d: str) -> DataFrame:
    """One event per key, day, field and value: the first written."""
    c = table(spark, d, "practice_changes").filter("change_date is not null")
    return c.groupBy("npi", F.date_format("change_date", "yyyy-MM-dd").alias("day"), F.lower(F.trim("field_changed")).alias("f"), F.trim("new_value").alias("v")).agg(F.min("id").alias("id"))


@query(f"""select npi, coalesce(nullif(regexp_extract(address,'^ *([0-9]+)',1),''),'')||'|'||coalesce({ZIP_SQL.format('zip')}||'|','')||left(regexp_replace({STREET_SQL.format('address')},'[^A-Z]','','g'),6) k from practices where nullif(trim(address),'') is not null""")
def cross_keys(spark: SparkSession, d: str) -> DataFrame:
    """Composite keys for exact cross-reference of addresses."""
    return table(spark, d, "practices").filter(nz("address").isNotNull()).select("npi", xref_key(F.col("address"), F.col("zip")).alias("k"))


@query("""with o as (select npi, 'signals' who, entity_classification c from practice_signals where entity_classification is not null union all select npi, 'registry', entity_classification from practices where entity_classification is not null),
 r as (select npi, c, who, case c when 'dso_regional' then 0 when 'org_only_npi' then 1 when 'large_group' then 2 else 3 end pr from o) select npi, arg_min(c, pr||c||who) class_name, count(*) opinions from r group by 1""")
def opinions_by_priority(spark: SparkSession, d: str) -> DataFrame:
    """Opinions of several sources; the one of least priority number wins."""
    one = lambda t, who: table(spark, d, t).filter("entity_classification is not null").select("npi", F.lit(who).alias("who"), F.col("entity_classification").alias("c"))
    o = one("practice_signals", "signals").unionByName(one("practices", "registry"))
    pr = F.when(F.col("c") == "dso_regional", "0").when(F.col("c") == "org_only_npi", "1").when(F.col("c") == "large_group", "2").otherwise("3")
    return o.groupBy("npi").agg(F.min_by("c", F.concat(pr, "c", "who")).alias("class_name"), F.count(F.lit(1)).alias("opinions"))
