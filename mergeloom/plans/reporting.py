"""Reporting queries: filters, joins, aggregates, windows, top-k and set operations over the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergeloom.functions.core import nz, zip5
from mergeloom.functions.text import sorted_set
from mergeloom.operators.cascade import fill_rates
from mergeloom.operators.matching import latest
from mergeloom.operators.merge import only_in
from mergeloom.operators.ordering import batches
from mergeloom.plans.registry import query
from mergeloom.session import table

#: The day that relative periods count from.
RUN_DATE = "2025-02-01"
Z = "left(nullif(trim(zip),''),5)"


def _month(c: str) -> Column:
    return F.date_format(c, "yyyy-MM")


def _deals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "deals").withColumn("deal_date", F.col("deal_date").cast("date"))


@query(f"""select {Z} zip5, count(*) n, count(case when ownership_status='independent' then 1 end) independent, count(case when ownership_status in ('dso_affiliated','pe_backed') then 1 end) consolidated,
  round(100.0*count(case when ownership_status in ('dso_affiliated','pe_backed') then 1 end)/count(*),2) consolidated_pct from practices where {Z} is not null group by 1""")
def zip_ownership_mix(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "practices").withColumn("zip5", zip5("zip")).filter("zip5 is not null")
    held = F.count_if(F.col("ownership_status").isin("dso_affiliated", "pe_backed"))
    return p.groupBy("zip5").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ownership_status") == "independent").alias("independent"), held.alias("consolidated"), F.round(held * 100.0 / F.count(F.lit(1)), 2).alias("consolidated_pct")
    )


@query("select strftime(deal_date,'%Y-%m') m, count(*) n, round(coalesce(sum(deal_size_mm),0),2) size_mm from deals where deal_date is not null group by 1")
def monthly_volume(spark: SparkSession, d: str) -> DataFrame:
    return _deals(spark, d).filter("deal_date is not null").groupBy(_month("deal_date").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("deal_size_mm"), F.lit(0.0)), 2).alias("size_mm"))


@query("select npi, practice_name, city from practices where upper(trim(state))='GA' and enumeration_date >= date '2015-01-01'")
def new_in_state(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "practices").filter((F.upper(F.trim("state")) == "GA") & (F.col("enumeration_date") >= F.to_date(F.lit("2015-01-01")))).select("npi", "practice_name", "city")


@query(f"""select c.id, c.npi, lower(trim(field_changed)) field_name, p.practice_name, {Z} zip5 from practice_changes c join practices p on c.npi=p.npi where c.change_date >= date '2024-11-03' and c.change_date <= date '{RUN_DATE}'""")
def recent_changes_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "practice_changes").filter(F.col("change_date").between(F.date_sub(F.to_date(F.lit(RUN_DATE)), 90), F.to_date(F.lit(RUN_DATE))))
    return c.join(table(spark, d, "practices"), "npi").select(c["id"], "npi", F.lower(F.trim("field_changed")).alias("field_name"), "practice_name", zip5("zip").alias("zip5"))


@query(f"""select {Z} zip5, count(case when ein is not null then 1 end) enriched, count(case when website is not null then 1 end) with_site, count(*) n from practices where {Z} is not null group by 1 having count(*) >= 10""")
def enrichment_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "practices").withColumn("zip5", zip5("zip")).filter("zip5 is not null")
    return p.groupBy("zip5").agg(F.count("ein").alias("enriched"), F.count("website").alias("with_site"), F.count(F.lit(1)).alias("n")).filter("n >= 10")


@query("""select pe_sponsor, count(*) deals, count(distinct lower(platform_company)) platforms, round(100.0*count(*)/(select count(*) from deals where pe_sponsor is not null),2) share_pct from deals where pe_sponsor is not null group by 1 order by 2 desc, 1 limit 15""")
def deals_by_sponsor(spark: SparkSession, d: str) -> DataFrame:
    g = _deals(spark, d).filter("pe_sponsor is not null").groupBy("pe_sponsor").agg(F.count(F.lit(1)).alias("deals"), F.countDistinct(F.lower("platform_company")).alias("platforms"))
    total = g.agg(F.sum("deals")).scalar()
    return g.select("pe_sponsor", "deals", "platforms", F.round(F.col("deals") * 100.0 / total, 2).alias("share_pct")).orderBy(F.desc("deals"), "pe_sponsor").limit(15)


@query("""select upper(trim(state)) st, affiliated_dso, count(*) n from practices where affiliated_dso is not null and nullif(trim(state),'') is not null group by 1,2""")
def group_share_by_state(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "practices").filter(F.col("affiliated_dso").isNotNull() & nz("state").isNotNull())
    return p.groupBy(F.upper(F.trim("state")).alias("st"), "affiliated_dso").agg(F.count(F.lit(1)).alias("n"))


@query("""select year(deal_date)||'Q'||quarter(deal_date) q, deal_type, count(*) n, round(avg(ebitda_multiple),3) multiple from deals where deal_date is not null group by 1,2""")
def deals_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.year("deal_date").cast("string"), F.lit("Q"), F.quarter("deal_date").cast("string"))
    return _deals(spark, d).filter("deal_date is not null").groupBy(q.alias("q"), "deal_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ebitda_multiple"), 3).alias("multiple"))


@query(f"""select npi, strftime(change_date,'%Y-%m-%d') as "day", old_value, new_value from practice_changes where change_type='name_change' and change_date >= date '2024-11-03' and change_date <= date '{RUN_DATE}'""")
def name_changes_90d(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("change_date")
    c = table(spark, d, "practice_changes").filter((F.col("change_type") == "name_change") & day.between(F.date_sub(F.to_date(F.lit(RUN_DATE)), 90), F.to_date(F.lit(RUN_DATE))))
    return c.select("npi", F.date_format("change_date", "yyyy-MM-dd").alias("day"), "old_value", "new_value")


@query("""select (select count(*) from deals) n, (select count(distinct source) from deals) sources, (select round(avg(deal_size_mm),3) from deals) avg_size, (select count(distinct platform_company) from deals) platforms, (select strftime(max(deal_date),'%Y-%m-%d') from deals) last_day""")
def deal_stats(spark: SparkSession, d: str) -> DataFrame:
    return _deals(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.round(F.avg("deal_size_mm"), 3).alias("avg_size"), F.countDistinct("platform_company").alias("platforms"), F.date_format(F.max("deal_date"), "yyyy-MM-dd").alias("last_day")
    )


def facets(df: DataFrame, date: str, span: tuple[str | None, str | None], lists: dict[str, list[str]]) -> DataFrame:
    """Rows within the dates and in every non-empty list; an empty list or open end does not filter."""
    for end, keep in zip(span, (F.col(date) >= F.lit(span[0]).cast("date"), F.col(date) <= F.lit(span[1]).cast("date")), strict=True):
        df = df.filter(keep) if end else df
    for c, values in lists.items():
        df = df.filter(F.col(c).isin(values)) if values else df
    return df


@query("""select id, platform_company, specialty from deals where deal_date >= date '2022-01-01' and deal_date <= date '2023-12-31' and deal_type in ('add-on','buyout') and specialty in ('general','orthodontics','oral_surgery')""")
def multi_facet_filter(spark: SparkSession, d: str) -> DataFrame:
    out = facets(_deals(spark, d), "deal_date", ("2022-01-01", "2023-12-31"), {"deal_type": ["add-on", "buyout"], "specialty": ["general", "orthodontics", "oral_surgery"], "source": []})
    return out.select("id", "platform_company", "specialty")


@query("""select npi from practices where (contains(lower(practice_name),'smile') or contains(lower(doing_business_as),'smile') or contains(lower(city),'smile') or contains(lower(address),'smile')) and ownership_status is not null""")
def directory_search(spark: SparkSession, d: str) -> DataFrame:
    hit = F.lit(False)
    for c in ("practice_name", "doing_business_as", "city", "address"):
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit("smile")), F.lit(False))
    return table(spark, d, "practices").filter(hit & F.col("ownership_status").isNotNull()).select("npi")


@query("""select id from deals where contains(lower(concat_ws(' ',platform_company,pe_sponsor,target_name,target_city,target_state,deal_type,specialty,notes,raw_text)),'fenmark')""")
def whole_row_search(spark: SparkSession, d: str) -> DataFrame:
    cols = ["platform_company", "pe_sponsor", "target_name", "target_city", "target_state", "deal_type", "specialty", "notes", "raw_text"]
    return _deals(spark, d).filter(F.contains(F.lower(F.concat_ws(" ", *cols)), F.lit("fenmark"))).select("id")


@query("select npi from practices where npi not in (select npi from practice_changes where npi is not null)")
def anti_unchanged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "practices").join(table(spark, d, "practice_changes").select("npi"), "npi", "left_anti").select("npi")


@query(f"select npi from practices where {Z} in (select left(nullif(trim(zip),''),5) from dso_locations)")
def semi_office_zips(spark: SparkSession, d: str) -> DataFrame:
    offices = table(spark, d, "dso_locations").select(zip5("zip").alias("zip5"))
    return table(spark, d, "practices").withColumn("zip5", zip5("zip")).join(offices, "zip5", "left_semi").select("npi")


@query("""with m as (select strftime(deal_date,'%Y-%m') m, count(*) n from deals where deal_date is not null group by 1) select m, n, round(avg(n) over (order by m rows between 5 preceding and current row),4) mean6 from m""")
def rolling6(spark: SparkSession, d: str) -> DataFrame:
    # One row per month: the window runs over a few hundred rows at most.
    m = _deals(spark, d).filter("deal_date is not null").groupBy(_month("deal_date").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("mean6", F.round(F.avg("n").over(Window.partitionBy(F.lit(1)).orderBy("m").rowsBetween(-5, 0)), 4))


@query("""select platform_company, count(case when year(deal_date)=2024 then 1 end) this_year, count(case when year(deal_date)=2023 and dayofyear(deal_date)<=200 then 1 end) last_ytd, count(case when year(deal_date)=2024 and dayofyear(deal_date)<=200 then 1 end) this_ytd from deals group by 1""")
def ytd_yoy(spark: SparkSession, d: str) -> DataFrame:
    y, n = F.year("deal_date"), F.dayofyear("deal_date") <= 200
    c = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    return _deals(spark, d).groupBy("platform_company").agg(c(y == 2024).alias("this_year"), c((y == 2023) & n).alias("last_ytd"), c((y == 2024) & n).alias("this_ytd"))


@query("""with q as (select platform_company, year(deal_date)*4+quarter(deal_date) q, count(*) n from deals where deal_date is not null group by 1,2) select platform_company, q::bigint q, n, (n - lag(n) over (partition by platform_company order by q))::double delta from q""")
def qoq_delta(spark: SparkSession, d: str) -> DataFrame:
    q = _deals(spark, d).filter("deal_date is not null").groupBy("platform_company", (F.year("deal_date") * 4 + F.quarter("deal_date")).cast("bigint").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    return q.withColumn("delta", (F.col("n") - F.lag("n").over(Window.partitionBy("platform_company").orderBy("q"))).cast("double"))


@query(f"""with s as (select npi, left(nullif(trim(zip_code),''),5) z, coalesce(entity_classification,'unknown') c, buyability_score b from practice_signals where buyability_score is not null)
  select npi, case when count(*) over (partition by z,c) >= 2 then round((rank() over (partition by z,c order by b)-1)*100.0/greatest(count(*) over (partition by z,c)-1,1),1) end zip_class_pct, case when count(*) over (partition by c) >= 2 then round((rank() over (partition by c order by b)-1)*100.0/greatest(count(*) over (partition by c)-1,1),1) end class_pct from s""")
def pct_rank_peer(spark: SparkSession, d: str) -> DataFrame:
    """Percentile among peers, none below two peers.

    Ranks come from the distinct scores of a group and their counts (a few hundred values of half points), so that no
    task has to sort all members of a hot group.
    """
    s = table(spark, d, "practice_signals").filter("buyability_score is not null").select("npi", zip5("zip_code").alias("z"), F.coalesce("entity_classification", F.lit("unknown")).alias("c"), F.col("buyability_score").alias("b"))

    def ranked(by: list[str], name: str) -> DataFrame:
        n = s.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("n"))
        below = F.sum("n").over(Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
        total = F.sum("n").over(Window.partitionBy(*by))
        rank = F.when(total >= 2, F.round(F.coalesce(below, F.lit(0)) * 100 / F.greatest(total - 1, F.lit(1)), 1))
        return n.select(*[F.col(k).alias(f"{name}_{k}") for k in by], F.col("b").alias(f"{name}_b"), rank.alias(name))

    one, two = ranked(["z", "c"], "zip_class_pct"), ranked(["c"], "class_pct")
    out = s.join(one, s.z.eqNullSafe(one.zip_class_pct_z) & (s.c == one.zip_class_pct_c) & (s.b == one.zip_class_pct_b))
    return out.join(two, (s.c == two.class_pct_c) & (s.b == two.class_pct_b)).select("npi", "zip_class_pct", "class_pct")


@query("""with c as (select *, coalesce(change_date, created_at::date) dd from practice_changes) select npi, id, strftime(dd,'%Y-%m-%d') as "day" from (select *, row_number() over (partition by npi order by dd desc nulls last, id) rn from c) where rn=1""")
def latest_change(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "practice_changes").withColumn("dd", F.coalesce("change_date", F.col("created_at").cast("date")))
    return latest(c, ["npi"], [F.desc_nulls_last("dd"), F.asc("id")]).select("npi", "id", F.date_format("dd", "yyyy-MM-dd").alias("day"))


@query("""select platform_company, id, deal_size_mm from (select *, row_number() over (partition by platform_company order by deal_size_mm desc nulls last, deal_date desc nulls last, id) rn from deals) where rn<=5""")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("platform_company").orderBy(F.desc_nulls_last("deal_size_mm"), F.desc_nulls_last("deal_date"), "id")
    return _deals(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("platform_company", "id", "deal_size_mm")


@query(f"""with g as (select {Z} z, trim(upper(address)) a, count(case when entity_type in ('individual','1') then 1 end) m from practices where nullif(trim(address),'') is not null group by 1,2) select p.npi, greatest(g.m,1) providers from practices p join g on left(nullif(trim(p.zip),''),5) is not distinct from g.z and trim(upper(p.address))=g.a""")
def group_size_broadcast(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "practices").filter(nz("address").isNotNull()).select("npi", zip5("zip").alias("z"), F.trim(F.upper("address")).alias("a"), F.col("entity_type").isin("individual", "1").alias("one"))
    g = p.groupBy("z", "a").agg(F.count_if("one").alias("m"))
    return p.alias("p").join(g.alias("g"), F.col("p.z").eqNullSafe(F.col("g.z")) & (F.col("p.a") == F.col("g.a"))).select("npi", F.greatest("m", F.lit(1)).alias("providers"))


@query("""with g as (select affiliated_dso, count(*) size, min(npi) first from practices where affiliated_dso is not null group by 1) select 'gr_'||lpad(cast(row_number() over (order by size desc, first) as varchar),4,'0') cluster_no, affiliated_dso, size from g""")
def cluster_numbering(spark: SparkSession, d: str) -> DataFrame:
    # One row per group name; names are a curated list.
    g = table(spark, d, "practices").filter("affiliated_dso is not null").groupBy("affiliated_dso").agg(F.count(F.lit(1)).alias("size"), F.min("npi").alias("first"))
    n = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("size"), "first"))
    return g.select(F.concat(F.lit("gr_"), F.lpad(n.cast("string"), 4, "0")).alias("cluster_no"), "affiliated_dso", "size")


@query("""select c.specialty, count(d.id) n from (values ('general'),('orthodontics'),('oral_surgery'),('pediatric'),('none_such')) c(specialty) left join deals d on d.specialty=c.specialty group by 1""")
def counts_in_fixed_order(spark: SparkSession, d: str) -> DataFrame:
    cats = spark.createDataFrame([(x,) for x in ("general", "orthodontics", "oral_surgery", "pediatric", "none_such")], "specialty string")
    g = _deals(spark, d).groupBy("specialty").agg(F.count("id").alias("n"))
    return cats.join(g, "specialty", "left").select("specialty", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query(f"""select upper(trim(state)) st, {Z} zip5, count(*) n, cast(coalesce(sum(num_providers),0) as bigint) providers from practices group by rollup(upper(trim(state)), {Z})""")
def rollup_state_zip(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "practices").select(F.upper(F.trim("state")).alias("st"), zip5("zip").alias("zip5"), "num_providers")
    return p.rollup("st", "zip5").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("num_providers"), F.lit(0)).cast("bigint").alias("providers"))


RATED = ["practice_name", "doing_business_as", "address", "phone", "ein", "website", "latitude", "year_established"]
_rates = " union all ".join(
    f"select '{c}' column_name, count({f'nullif(trim({c}),chr(32)[1:0])' if c not in ('latitude', 'year_established') else c}) known, round(count({f'nullif(trim({c}),chr(32)[1:0])' if c not in ('latitude', 'year_established') else c})*1.0/greatest(count(*),1),4) share from practices"
    for c in RATED
).replace("chr(32)[1:0]", "''")


@query(_rates)
def fill_rate(spark: SparkSession, d: str) -> DataFrame:
    return fill_rates(table(spark, d, "practices"), RATED)


@query(f"""select case when datediff('day', last_updated, date '{RUN_DATE}') <= 365 then 'fresh' when datediff('day', last_updated, date '{RUN_DATE}') <= 730 then 'stale' when last_updated is null then 'unknown' else 'old' end bucket, count(*) n from practices group by 1""")
def freshness_buckets(spark: SparkSession, d: str) -> DataFrame:
    age = F.datediff(F.to_date(F.lit(RUN_DATE)), "last_updated")
    return table(spark, d, "practices").groupBy(F.when(age <= 365, "fresh").when(age <= 730, "stale").when(F.col("last_updated").isNull(), "unknown").otherwise("old").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""select npi from practices order by md5(npi||'7'), npi limit 50""")
def sample_for_review(spark: SparkSession, d: str) -> DataFrame:
    """A fixed sample of 50 rows by seeded hash; the limit is the feature."""
    return table(spark, d, "practices").select("npi").orderBy(F.md5(F.concat("npi", F.lit("7")).cast("binary")), "npi").limit(50)


@query("""with o as (select distinct source, date_trunc('month',deal_date)::date m from deals where deal_date is not null), s as (select source, min(m) a, max(m) b from o group by 1), a as (select source, unnest(generate_series(a::timestamp, b::timestamp, interval 1 month))::date m from s)
  select a.source, strftime(a.m,'%Y-%m') missing from a anti join o using (source, m)""")
def missing_months(spark: SparkSession, d: str) -> DataFrame:
    o = _deals(spark, d).filter("deal_date is not null").select("source", F.trunc("deal_date", "month").alias("m")).distinct()
    every = o.groupBy("source").agg(F.min("m").alias("a"), F.max("m").alias("b")).select("source", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    return every.join(o, ["source", "m"], "left_anti").select("source", F.date_format("m", "yyyy-MM").alias("missing"))


@query("""select npi, 'ghost' kind from (select distinct trim(npi) npi from practices_replica) where npi not in (select npi from practices) union all select npi, 'missing' from practices where npi not in (select trim(npi) from practices_replica)""")
def set_ghost_rows(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "practices").select("npi"), table(spark, d, "practices_replica").select(F.trim("npi").alias("npi"))
    return only_in(b, a, ["npi"]).withColumn("kind", F.lit("ghost")).unionByName(only_in(a, b, ["npi"]).withColumn("kind", F.lit("missing")))


@query(f"select {Z} zip5 from practices where {Z} is not null intersect select left(nullif(trim(zip),''),5) from dso_locations")
def set_zip_intersect(spark: SparkSession, d: str) -> DataFrame:
    zips = lambda t: table(spark, d, t).select(zip5("zip").alias("zip5")).filter("zip5 is not null")
    return zips("practices").intersect(zips("dso_locations"))


@query("""select p.ownership_status old_status, r.ownership_status new_status, count(*) n from practices p join practices_replica r on p.npi=trim(r.npi) group by 1,2""")
def transition_counts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "practices_replica").select(F.trim("npi").alias("npi"), F.col("ownership_status").alias("new_status"))
    return table(spark, d, "practices").select("npi", F.col("ownership_status").alias("old_status")).join(r, "npi").groupBy("old_status", "new_status").agg(F.count(F.lit(1)).alias("n"))


@query("""select source, count(*) n, strftime(min(deal_date),'%Y-%m-%d') first_day, strftime(max(deal_date),'%Y-%m-%d') last_day, count(case when target_name is null or trim(target_name)='' then 1 end) blank_targets from deals group by 1""")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _deals(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("deal_date"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("deal_date"), "yyyy-MM-dd").alias("last_day"), F.count_if(nz("target_name").isNull()).alias("blank_targets"))


@query("""with p as (select platform_company, specialty, count(*) n, min(id) i from deals where specialty is not null group by 1,2), m as (select platform_company, specialty from (select *, row_number() over (partition by platform_company order by n desc, i) rn from p) where rn=1),
  s as (select platform_company, pe_sponsor from (select *, row_number() over (partition by platform_company order by deal_date desc nulls last, id desc) rn from deals where pe_sponsor is not null) where rn=1)
  select d.platform_company, m.specialty, s.pe_sponsor, d.n, d.states from (select platform_company, count(*) n, array_to_string(list_sort(list_distinct(list(upper(trim(target_state))))),',') states from deals group by 1) d left join m using (platform_company) left join s using (platform_company)""")
def platform_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Per platform: most frequent specialty (first seen on ties), most recent known sponsor, sorted states."""
    e = _deals(spark, d)
    by = e.filter("specialty is not null").groupBy("platform_company", "specialty").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("i"))
    mode = by.groupBy("platform_company").agg(F.max_by("specialty", F.struct("k", (-F.col("i")).alias("i"))).alias("specialty"))
    rest = e.groupBy("platform_company").agg(
        F.max_by("pe_sponsor", F.when(F.col("pe_sponsor").isNotNull(), F.struct("deal_date", "id"))).alias("pe_sponsor"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.upper(F.trim("target_state")))), ",").alias("states")
    )
    return rest.join(mode, "platform_company", "left").select("platform_company", "specialty", "pe_sponsor", "n", "states")


@query("""select source, array_to_string(list_sort(list_distinct(string_split(source,'+'))),'+') canon, count(*) n from deals group by 1,2""")
def joined_set_sources(spark: SparkSession, d: str) -> DataFrame:
    return _deals(spark, d).groupBy("source", sorted_set(F.col("source"), "+").alias("canon")).agg(F.count(F.lit(1)).alias("n"))


@query("""select id, npi, cast(floor((row_number() over (order by npi, id)-1)/250) as bigint) batch_no from practices""")
def batch_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 250 rows in key order."""
    return batches(table(spark, d, "practices").select("id", "npi"), [F.asc("npi"), F.asc("id")], 250)
