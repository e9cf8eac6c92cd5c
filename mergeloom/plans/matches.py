"""Queries of the fuzzy joins: by ZIP with token-sorted texts, street before name, telephone first, by state, by date bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.core import nz, phone10, zip5
from mergeloom.functions.fuzzy import ratio, token_sort
from mergeloom.functions.address import house_number
from mergeloom.functions.text import host
from mergeloom.operators.graph import connected_components
from mergeloom.operators.matching import band_pairs, fuzzy_match, ranked_match, similar_texts, weighed_match
from mergeloom.operators.merge import first_known, insert_if_absent
from mergeloom.plans.linking import PHONE_SQL, RATIO_SQL, TOKEN_SQL, ZIP_SQL
from mergeloom.plans.registry import query
from mergeloom.session import Scratch, table

C = F.col
_HOUSE = "nullif(regexp_extract(address,'^ *([0-9]+)',1),'')"
_TOK = lambda c: f"nullif({TOKEN_SQL.format(f'lower({c})')},'')"
_P = f"p as (select npi, {ZIP_SQL.format('zip')} z, {_HOUSE} h, {_TOK('address')} a, {_TOK('practice_name')} n, {_TOK('doing_business_as')} d, {PHONE_SQL.format('phone')} ph from practices)"
_O = f"o as (select id, {ZIP_SQL.format('zip')} z, {_HOUSE} h, {_TOK('address')} a, {_TOK('location_name')} n, {PHONE_SQL.format('phone')} ph from dso_locations)"


def _near(x: str, y: str, least: int) -> str:
    """Score of two texts where it can reach `least`, else null."""
    return f"case when levenshtein({x},{y}) <= floor({(100 - least) / 100}*(len({x})+len({y}))) then {RATIO_SQL.format(x, y)} end"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def of(name: str, key: str, title: str) -> DataFrame:
        tok = lambda c: F.nullif(token_sort(F.lower(c)), F.lit("")) if c else F.lit(None).cast("string")
        dba = "doing_business_as" if name == "practices" else None
        return table(spark, d, name).select(key, zip5("zip").alias("z"), house_number(C("address")).alias("h"), tok("address").alias("a"), tok(title).alias("n"), tok(dba).alias("d"), phone10("phone").alias("ph"))

    return of("practices", "npi", "practice_name"), of("dso_locations", "id", "location_name")


def _by_address(pick: str, least: int, key: str) -> str:
    other = "id" if key == "npi" else "npi"
    return f"with {_P}, {_O}, s as (select p.npi, o.id, {_near('p.a', 'o.a', least)} score from p join o using (z)) select {key}, {other}, round(score,4) score from (select *, row_number() over (partition by {key} order by {pick}) rn from s where score >= {least}) where rn=1"


@query(_by_address("score desc, id", 85, "npi"))
def zip_token_best(spark: SparkSession, d: str) -> DataFrame:
    """Practices with the office of their ZIP whose address is most similar by sorted words."""
    p, o = _sides(spark, d)
    return fuzzy_match(p, o, ["z"], "a", "a", "npi", "id", 85).withColumn("score", F.round("score", 4))


@query(_by_address("score desc, npi", 88, "id"))
def seed_match_88(spark: SparkSession, d: str) -> DataFrame:
    """Offices of a seed list with the practice of their ZIP of most similar address, from 88 on."""
    p, o = _sides(spark, d)
    return fuzzy_match(o, p, ["z"], "a", "a", "id", "npi", 88).withColumn("score", F.round("score", 4))


@query(_by_address("id", 92, "npi").replace(", round(score,4) score", "", 1))
def each_once_92(spark: SparkSession, d: str) -> DataFrame:
    """Exact or nearly exact addresses in a ZIP; each practice is taken once, by the first office in order."""
    p, o = _sides(spark, d)
    return fuzzy_match(p, o, ["z"], "a", "a", "npi", "id", 92, first=True).select("npi", "id")


@query(f"""with {_P}, {_O}, s as (select o.id, p.npi, {_near('o.a', 'p.a', 80)} sa, {_near('o.n', 'p.n', 75)} sn from o join p using (z) where o.h is null or p.h is null or o.h=p.h),
 r as (select id, npi, 'address' how, sa score, 0 tier from s where sa>=80 union all select id, npi, 'name', sn, 1 from s where sn>=75) select id, npi, how, round(score,4) score from (select *, row_number() over (partition by id order by tier, score desc, npi) rn from r) where rn=1""")
def street_then_name(spark: SparkSession, d: str) -> DataFrame:
    """Offices matched in their ZIP by address where the house numbers do not contradict, by name where no address does."""
    p, o = _sides(spark, d)
    return ranked_match(o, p, ["z"], "id", "npi", [("address", [("a", "a")], 80, 0), ("name", [("n", "n")], 75, 1)], "h")


@query(f"""with {_P}, {_O}, f as (select o.id, min(p.npi) npi from o join p on o.z=p.z and o.ph=p.ph group by 1), s as (select o.id, p.npi, {_near('o.a', 'p.a', 85)} sa, {_near('o.n', 'p.n', 80)} sn, {_near('o.n', 'p.d', 80)} sd from o join p using (z)),
 r as (select id, npi, 'phone' how, 100.0 score, 0 tier, 0 k from f union all select id, npi, 'address', sa, 1, 0 from s where sa>=85 union all select id, npi, 'name', greatest(coalesce(sn,0),coalesce(sd,0)), 1, 1 from s where greatest(coalesce(sn,0),coalesce(sd,0))>=80)
 select id, npi, how, round(score,4) score from (select *, row_number() over (partition by id order by tier, score desc, k, npi) rn from r) where rn=1""")
def door_match(spark: SparkSession, d: str) -> DataFrame:
    """Offices matched in their ZIP by an equal telephone, else by the best of address (85) and name or trade name (80)."""
    p, o = _sides(spark, d)
    phones = o.select("id", "z", "ph").join(p.select("npi", "z", "ph"), ["z", "ph"]).groupBy("id").agg(F.min("npi").alias("npi"))
    # Written once, as it is used twice.
    phones = Scratch(spark).cut(phones)
    rest = o.join(phones.select("id"), "id", "left_anti")
    return phones.select("id", "npi", F.lit("phone").alias("how"), F.lit(100.0).alias("score")).unionByName(ranked_match(rest, p, ["z"], "id", "npi", [("address", [("a", "a")], 85, 0), ("name", [("n", "n"), ("n", "d")], 80, 0)]))


@query(f"""with {_P}, {_O}, s as (select o.id, p.npi, {RATIO_SQL.format('o.n', 'p.n')} sn, {_near('o.a', 'p.a', 80)} sa from o join p using (z) where o.n is not null and p.n is not null and (levenshtein(o.n,p.n) <= floor(0.25*(len(o.n)+len(p.n))) or levenshtein(o.a,p.a) <= floor(0.2*(len(o.a)+len(p.a))))),
 r as (select id, npi, case when sa>=80 then 0.6*sa+0.4*sn when sn>=75 then sn end w from s) select id, npi, round(w,4) score from (select *, row_number() over (partition by id order by round(w,4) desc, npi) rn from r where w>=50) where rn=1""")
def weighted_match(spark: SparkSession, d: str) -> DataFrame:
    """Address and name weighed 6 to 4 where the address reaches 80, else the name alone from 75 on; the best from 50 on."""
    p, o = _sides(spark, d)
    return weighed_match(o, p, ["z"], "id", "npi", ("a", 80, 0.6), ("n", 75, 0.4), 50)


_STATE = "upper(trim({0}))"


@query(f"""with t as (select id, {_STATE.format('target_state')} st, {_TOK('target_name')} n from deals), p as (select npi, {_STATE.format('state')} st, unnest([{_TOK('practice_name')}, {_TOK('doing_business_as')}]) n from practices),
 s as (select id, npi, {_near('t.n', 'p.n', 92)} score from t join p using (st) where t.n is not null and p.n is not null) select id, npi, round(score,4) score from (select id, npi, score, row_number() over (partition by id order by score desc, npi) rn from s where score>=92) where rn=1""")
def state_name_92(spark: SparkSession, d: str) -> DataFrame:
    """Deal targets with the practice of their state of most similar name or trade name, from 92 on."""
    t = table(spark, d, "deals").select("id", F.upper(F.trim("target_state")).alias("st"), F.nullif(token_sort(F.lower("target_name")), F.lit("")).alias("n"))
    names = F.explode(F.array("practice_name", "doing_business_as"))
    p = table(spark, d, "practices").select("npi", F.upper(F.trim("state")).alias("st"), names.alias("x")).select("npi", "st", F.nullif(token_sort(F.lower("x")), F.lit("")).alias("n"))
    found = similar_texts(t, p, "st", "n", "n", "id", "npi", 92)
    best = found.groupBy("id").agg(F.min(F.struct((-C("score")).alias("x"), "npi")).alias("b"))
    return best.select("id", "b.npi", F.round(-C("b.x"), 4).alias("score"))


@query(f"""with b as (select distinct lower(trim(platform_company)) p from deals where trim(platform_company)<>''), a as (select npi, lower(nullif(trim(affiliated_dso),'')) a from practices), x as (select distinct a from a where a is not null),
 h as (select a, p, contains(a,p) c, {_near('a', 'p', 90)} s from x, b), m as (select a, p from (select a, p, row_number() over (partition by a order by case when c then 0 else 1 end, case when c then -len(p) else -s end, p) rn from h where c or s>=90) where rn=1) select a.npi, m.p as brand from a join m on m.a = a.a""")
def affiliation_brand(spark: SparkSession, d: str) -> DataFrame:
    """The brand an affiliation stands for: the longest brand it contains, else the most similar from 90 on."""
    from mergeloom.operators.matching import longest_pattern

    brands = table(spark, d, "deals").select(F.lower(nz("platform_company")).alias("p")).filter("p is not null").distinct()
    p = table(spark, d, "practices").select("npi", F.lower(nz("affiliated_dso")).alias("a")).filter("a is not null")
    x = p.select("a").distinct()
    inside = longest_pattern(x.withColumn("k", C("a")), "a", brands, "p", "k").toDF("a", "p")
    near = similar_texts(inside.filter("p is null").select("a", F.lit("").alias("st")), brands.withColumn("st", F.lit("")), "st", "a", "p", "a", "p", 90)
    near = near.groupBy("a").agg(F.min(F.struct((-C("score")).alias("x"), "p")).alias("b")).select("a", C("b.p").alias("brand"))
    return p.join(inside.filter("p is not null").select("a", C("p").alias("brand")).unionByName(near), "a").select("npi", "brand")


@query(f"""with b as (select distinct lower(trim(platform_company)) p from deals where trim(platform_company)<>''), x as (select distinct lower(trim(affiliated_dso)) g from practices where trim(affiliated_dso)<>'') select g, p from x, b where contains(g,p) or contains(p,g)""")
def contained_either_way(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of group and brand of which one name contains the other, joined by the trigrams of the shorter."""
    from mergeloom.operators.matching import containing_texts

    brands = table(spark, d, "deals").select(F.lower(nz("platform_company")).alias("p")).filter("p is not null").distinct()
    groups = table(spark, d, "practices").select(F.lower(nz("affiliated_dso")).alias("g")).filter("g is not null").distinct()
    return containing_texts(groups, "g", brands, "p").unionByName(containing_texts(brands, "p", groups, "g").select("g", "p")).distinct()


_HOST = "nullif(regexp_extract(lower(trim({0})),'^https?://(www\\.)?([^/:?#]+)',2),'')"
_PAIRS = f"""d as (select id, left(lower(platform_company),4) k, lower(platform_company) p, lower(target_name) t, deal_date, upper(target_state) st, lower(pe_sponsor) sp, {_HOST.format('source_url')} h from deals where platform_company<>'' and target_name<>'' and deal_date is not null),
 j as (select a.id id_a, b.id id_b, coalesce(nullif(a.st,'')=nullif(b.st,''),false) or coalesce(nullif(a.sp,'')=nullif(b.sp,''),false) or coalesce(a.h=b.h,false) ok from d a join d b on a.k=b.k and a.id<b.id where abs(datediff('day',a.deal_date,b.deal_date))<=60 and coalesce({_near('a.p', 'b.p', 85)},0)>85 and coalesce({_near('a.t', 'b.t', 80)},0)>80)"""


def _deal_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(id_a, id_b, ok): deals alike by platform and target within sixty days, confirmed by state, sponsor or host."""
    from mergeloom.functions.fuzzy import may_reach

    some = lambda c: F.nullif(c, F.lit(""))
    e = table(spark, d, "deals").select(
        "id", "deal_date", F.lower(some("platform_company")).alias("p"), F.lower(some("target_name")).alias("t"), F.upper(some("target_state")).alias("st"), F.lower(some("pe_sponsor")).alias("sp"), host(C("source_url")).alias("h")
    ).filter("p is not null and t is not null and deal_date is not null").withColumn("k", F.substring("p", 1, 4))
    near = band_pairs(e, ["k"], "deal_date", 60, "id", ["p", "t", "st", "sp", "h"], lambda a, b: may_reach(a("t"), b("t"), 80) & may_reach(a("p"), b("p"), 85))
    ok = lambda c: F.coalesce(C(f"{c}_a") == C(f"{c}_b"), F.lit(False))
    near = near.filter((ratio("p_a", "p_b") > 85) & (ratio("t_a", "t_b") > 80))
    return near.select("id_a", "id_b", (ok("st") | ok("sp") | ok("h")).alias("ok"))


@query(f"with {_PAIRS} select id_a, id_b, case when ok then 'merge' else 'review' end verdict from j")
def deal_fuzzy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Deals that are probably the same: to be merged if state, sponsor or host confirms it, else to be reviewed."""
    return _deal_pairs(spark, d).select("id_a", "id_b", F.when(C("ok"), "merge").otherwise("review").alias("verdict"))


@query(f"""with recursive {_PAIRS}, e as (select id_a a, id_b b from j where ok union select id_b, id_a from j where ok),
 r(v,c) as (select a, a from e union select e.b, r.c from r join e on r.v=e.a), k as (select v, min(c) c from r group by 1),
 g as (select d.*, coalesce(k.c, d.id) c, (deal_size_mm is not null)::int+(ebitda_multiple is not null)::int+(num_locations is not null)::int+(pe_sponsor is not null)::int+(source_url is not null)::int f from deals d left join k on k.v=d.id),
 o as (select *, row_number() over (partition by c order by f desc, id) rn from g)
 select c as group_id, min(case when rn=1 then id end) keeper, count(*) members, arg_min(deal_size_mm, rn) filter (deal_size_mm is not null) deal_size_mm, arg_min(pe_sponsor, rn) filter (pe_sponsor is not null) pe_sponsor, array_to_string(list_sort(list_distinct(flatten(list(string_split(source,'+'))))),'+') sources from o group by 1""")
def deal_dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed repeated deals merged: the most complete row is kept, its gaps are filled from the others, sources are united."""
    e = table(spark, d, "deals")
    groups = connected_components(_deal_pairs(spark, d).filter("ok"), "id_a", "id_b").toDF("id", "c")
    known = F.size(F.array_compact(F.array(*[F.col(c).cast("string") for c in ("deal_size_mm", "ebitda_multiple", "num_locations", "pe_sponsor", "source_url")])))
    g = e.join(groups, "id", "left").withColumn("group_id", F.coalesce("c", "id")).withColumn("o", F.struct((-known).alias("f"), "id"))
    sources = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("source", r"\+"))))), "+")
    return g.groupBy("group_id").agg(
        F.min_by("id", "o").alias("keeper"), F.count(F.lit(1)).alias("members"), first_known("deal_size_mm", C("o")).alias("deal_size_mm"), first_known("pe_sponsor", C("o")).alias("pe_sponsor"), sources.alias("sources")
    )


@query("""with o as (select * from deals where source<>'pitchbook'), f as (select * from deals n where source='pitchbook' and nullif(trim(target_name),'') is not null and not exists (select 1 from o where o.platform_company=n.platform_company and o.target_name=n.target_name and o.deal_date=n.deal_date))
 select id from (select *, row_number() over (partition by platform_company, target_name, deal_date order by id) rn from f) where rn=1 or platform_company is null or deal_date is null""")
def insert_absent_deals(spark: SparkSession, d: str) -> DataFrame:
    """Deals of one source that the others lack; one without a target is refused, one without platform or day is no repeat."""
    e = table(spark, d, "deals")
    new = e.filter((C("source") == "pitchbook") & nz("target_name").isNotNull())
    return insert_if_absent(e.filter("source <> 'pitchbook'"), new, ["platform_company", "target_name", "deal_date"], [F.asc("id")]).select("id")
