"""Queries that combine several operators: record linkage by typed edges, networks, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergeloom.functions.address import street_key
from mergeloom.functions.core import nz, phone10, zip5
from mergeloom.functions.nested import path, self_named
from mergeloom.operators.graph import connected_components

from mergeloom.plans.linking import PHONE_SQL, STREET_SQL, ZIP_SQL
from mergeloom.plans.registry import query
from mergeloom.session import table

C = F.col
_REACH = ", f as (select a, b from e where a <> b union select b, a from e where a <> b), r(v, c) as (select a, a from f union select f.b, r.c from r join f on r.v = f.a), k as (select v, min(c) c from r group by 1)"
_N = f"n as (select npi, {STREET_SQL.format('address')} s, {ZIP_SQL.format('zip')} z, {PHONE_SQL.format('phone')} p, nullif(trim(ein),'') e, nullif(lower(trim(parent_company)),'') o from practices)"


def _stars(rows: DataFrame, key: list[str], kind: str) -> DataFrame:
    """Edges from each member of a key to its least member; the degree of a hub is spread by the components operator."""
    known = rows.dropna(subset=key)
    hub = known.groupBy(*key).agg(F.min("npi").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return known.join(hub, key).filter("npi <> hub").select(C("hub").alias("a"), C("npi").alias("b"), F.lit(kind).alias("kind"))


def _practices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "practices").select(
        "npi", street_key(C("address")).alias("s"), zip5("zip").alias("z"), phone10("phone").alias("p"), nz("ein").alias("e"), F.lower(nz("parent_company")).alias("o")
    )


@query(f"""with recursive {_N}, h as (select p, z from n where p is not null and z is not null group by 1,2 having count(distinct s) between 1 and 5),
 e as (select min(npi) over (partition by s, z) a, npi b from n where s is not null and z is not null union select min(npi) over (partition by p, z), npi from n semi join h using (p, z)){_REACH} select v npi, c door from k""")
def door_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Registrations of one door: same street and ZIP, or a telephone used at five streets of the ZIP at most."""
    n = _practices(spark, d)
    few = n.dropna(subset=["p", "z"]).groupBy("p", "z").agg(F.countDistinct("s").alias("k")).filter("k between 1 and 5").select("p", "z")
    edges = _stars(n, ["s", "z"], "street").unionByName(_stars(n.join(few, ["p", "z"], "left_semi"), ["p", "z"], "phone"))
    return connected_components(edges, "a", "b").toDF("npi", "door")


@query(f"""with recursive {_N}, t as (select distinct min(npi) over (partition by e) a, npi b, 'ein' kind from n where e is not null union select distinct min(npi) over (partition by o), npi, 'parent' from n where o is not null union select distinct min(npi) over (partition by p), npi, 'phone' from n semi join (select p from n where p is not null group by 1 having count(*) between 2 and 20) using (p)),
 e as (select a, b from t){_REACH} select k.c as network, count(distinct k.v) members, array_to_string(list_sort(list_distinct(list(t.kind))),'+') kinds from k join t on t.b = k.v and t.a <> t.b group by 1 having count(distinct k.v) >= 2""")
def ownership_census(spark: SparkSession, d: str) -> DataFrame:
    """Networks over shared employer numbers, parents and telephones, with the kinds of links each has (hubs not counted as members)."""
    n = _practices(spark, d)
    shared = n.filter("p is not null").groupBy("p").agg(F.count(F.lit(1)).alias("k")).filter("k between 2 and 20").select("p")
    edges = _stars(n, ["e"], "ein").unionByName(_stars(n, ["o"], "parent")).unionByName(_stars(n.join(shared, "p", "left_semi"), ["p"], "phone"))
    groups = connected_components(edges, "a", "b").toDF("b", "network")
    g = edges.join(groups, "b").groupBy("network").agg(F.countDistinct("b").alias("members"), F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kinds"))
    return g.filter("members >= 2")


@query(f"""with a as (select npi, affiliated_dso g, {ZIP_SQL.format('zip')} z from practices where affiliated_dso is not null union all select npi, lower(trim(stealth_dso_cluster_id)), left(nullif(trim(zip_code),''),5) from practice_signals where lower(trim(coalesce(stealth_dso_cluster_id,''))) not in ('','n/a')),
 s as (select g, count(distinct z) zips, count(distinct npi) size from a group by 1) select npi, g as best_cluster, zips, size from (select a.npi, a.g, zips, size, row_number() over (partition by a.npi order by zips desc, size desc, a.g) rn from a join s using (g)) where rn=1""")
def best_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Of all groups of a member the one with most ZIPs, then members, then the least name."""
    p = table(spark, d, "practices").filter("affiliated_dso is not null").select("npi", C("affiliated_dso").alias("g"), zip5("zip").alias("z"))
    s = table(spark, d, "practice_signals").select("npi", F.lower(nz("stealth_dso_cluster_id")).alias("g"), zip5("zip_code").alias("z")).filter("g is not null and g <> 'n/a'")
    a = p.unionByName(s)
    sizes = a.groupBy("g").agg(F.countDistinct("z").alias("zips"), F.countDistinct("npi").alias("size"))
    best = a.join(sizes, "g").groupBy("npi").agg(F.min(F.struct((-C("zips")).alias("x"), (-C("size")).alias("y"), "g")).alias("b"))
    return best.select("npi", C("b.g").alias("best_cluster"), (-C("b.x")).alias("zips"), (-C("b.y")).alias("size"))


_B = "select distinct {0} k, {1} z, nullif(lower(trim(practice_name)),'') n from practice_snapshots where snapshot_date=(select {2}(snapshot_date) from practice_snapshots) and {0} is not null and {1} is not null"
_SK, _SZ = STREET_SQL.format("address"), ZIP_SQL.format("zip")


@query(f"""with a as ({_B.format(_SK, _SZ, 'min')}), b as ({_B.format(_SK, _SZ, 'max')}), x as (select k, z, min(n) n from a group by 1,2), y as (select k, z, min(n) n from b group by 1,2), c as (select distinct z from b)
 select coalesce(x.k,y.k) street, coalesce(x.z,y.z) zip5, case when x.k is null then 'new' when y.k is null then 'closed' else 'renamed' end kind from x full join y on x.k=y.k and x.z=y.z where (x.k is null or y.k is null or x.n<>y.n) and coalesce(x.z,y.z) in (select z from c)""")
def batch_changes(spark: SparkSession, d: str) -> DataFrame:
    """Streets new, closed or renamed from the first to the last delivery, only in ZIPs the last one covers."""
    s = table(spark, d, "practice_snapshots").select("snapshot_date", street_key(C("address")).alias("k"), zip5("zip").alias("z"), F.lower(nz("practice_name")).alias("n")).dropna(subset=["k", "z"])
    ends = table(spark, d, "practice_snapshots").agg(F.min("snapshot_date").alias("lo"), F.max("snapshot_date").alias("hi"))
    at = lambda e: s.join(F.broadcast(ends), C("snapshot_date") == C(e), "left_semi")
    x, y = (at(e).groupBy("k", "z").agg(F.min("n").alias(f"n_{e}"), F.lit(True).alias(f"in_{e}")) for e in ("lo", "hi"))
    both = x.join(y, ["k", "z"], "full").join(y.select("z").distinct(), "z", "left_semi")
    kind = F.when(C("in_lo").isNull(), "new").when(C("in_hi").isNull(), "closed").when(C("n_lo") != C("n_hi"), "renamed")
    return both.select(C("k").alias("street"), C("z").alias("zip5"), kind.alias("kind")).filter("kind is not null")


@query("""with t as (select specialty from (select specialty, count(*) n from deals where specialty is not null group by 1 order by n desc, specialty limit 3)) select strftime(deal_date,'%Y') y, specialty, count(*) n from deals semi join t using (specialty) where deal_date is not null group by 1,2""")
def top_then_filter(spark: SparkSession, d: str) -> DataFrame:
    """Yearly counts of the three most frequent specialties."""
    e = table(spark, d, "deals").filter("specialty is not null")
    top = e.groupBy("specialty").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "specialty").limit(3)
    return e.join(top.select("specialty"), "specialty", "left_semi").filter("deal_date is not null").groupBy(F.date_format("deal_date", "yyyy").alias("y"), "specialty").agg(F.count(F.lit(1)).alias("n"))


@query("""select npi, case when trim(ownership_status)='unknown' then 0 when ownership_status='independent' then 1 else 2 end pr, strftime(last_updated,'%Y-%m-%d') upd from practices order by pr, last_updated desc nulls last, npi limit 40""")
def priority_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first forty rows by priority, newest first; the limit is the feature."""
    pr = F.when(F.trim("ownership_status") == "unknown", 0).when(C("ownership_status") == "independent", 1).otherwise(2)
    p = table(spark, d, "practices").withColumn("pr", pr).orderBy("pr", F.desc_nulls_last("last_updated"), "npi").limit(40)
    return p.select("npi", "pr", F.date_format("last_updated", "yyyy-MM-dd").alias("upd"))


@query(f"""select {ZIP_SQL.format('zip')} zip5, arg_min(npi, case when entity_type in ('organization','2') then '0' else '1' end||npi) npi from practices where {ZIP_SQL.format('zip')} is not null group by 1""")
def one_per_zip(spark: SparkSession, d: str) -> DataFrame:
    """One pick per ZIP: the first firm, else the first dentist."""
    order = F.concat(F.when(C("entity_type").isin("organization", "2"), "0").otherwise("1"), C("npi"))
    return table(spark, d, "practices").withColumn("zip5", zip5("zip")).filter("zip5 is not null").groupBy("zip5").agg(F.min_by("npi", order).alias("npi"))


@query("""select npi, parent_company, contains(lower(trim(practice_name)),lower(trim(parent_company))) or contains(lower(trim(parent_company)),lower(trim(practice_name))) or len(list_filter(regexp_extract_all(lower(trim(parent_company)),'[a-z0-9]+'), lambda w: not list_contains(regexp_extract_all(lower(trim(practice_name)),'[a-z0-9]+'),w)))=0 own from practices where parent_company is not null and practice_name is not null""")
def self_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parents that are only the firm itself."""
    p = table(spark, d, "practices").filter("parent_company is not null and practice_name is not null")
    return p.select("npi", "parent_company", self_named(C("parent_company"), C("practice_name")).alias("own"))


@query("""with v as (select user_id, cast(json_extract(props,'$.k') as bigint) k, ts, event_id from events where ts is not null) select user_id, arg_max(k, ts::varchar||lpad(event_id::varchar,12,'0'))::double last_k, max(k)::double most from v group by 1""")
def last_state(spark: SparkSession, d: str) -> DataFrame:
    """The newest entry per source of an event log, from a JSON column."""
    e = table(spark, d, "events").filter("ts is not null").withColumn("k", path(C("props"), "$.k", "bigint"))
    return e.groupBy("user_id").agg(F.max_by("k", F.when(C("k").isNotNull(), F.struct("ts", "event_id"))).cast("double").alias("last_k"), F.max("k").cast("double").alias("most"))


@query("""select a.npi, a.n_changes, round((rank() over (order by a.n_changes)-1)*100.0/greatest((select count(*) from (select distinct npi from practice_changes))-1,1),2) pct from (select npi, count(*) n_changes from practice_changes group by 1) a""")
def change_rank(spark: SparkSession, d: str) -> DataFrame:
    """Percentile of each entity by its number of changes, through the distinct numbers."""
    g = table(spark, d, "practice_changes").groupBy("npi").agg(F.count(F.lit(1)).alias("n_changes"))
    h = g.groupBy("n_changes").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy(F.lit(1))
    below = F.coalesce(F.sum("n").over(one.orderBy("n_changes").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = h.select("n_changes", F.round(below * 100 / F.greatest(F.sum("n").over(one) - 1, F.lit(1)), 2).alias("pct"))
    return g.join(h, "n_changes").select("npi", "n_changes", "pct")


@query(f"""with x as (select npi, lower(trim(parent_company)) pk, {ZIP_SQL.format('zip')} z from practices where parent_company is not null) select a.platform, a.n, coalesce(b.members,0) members, coalesce(b.zips,0) zips from (select lower(trim(platform_company)) platform, count(*) n from deals group by 1) a left join (select pk, count(distinct npi) members, count(distinct z) zips from x group by 1) b on b.pk=a.platform""")
def platform_reach(spark: SparkSession, d: str) -> DataFrame:
    """Deals of each platform beside the registrations that name it as parent."""
    a = table(spark, d, "deals").groupBy(F.lower(F.trim("platform_company")).alias("platform")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "practices").filter("parent_company is not null").groupBy(F.lower(F.trim("parent_company")).alias("platform")).agg(F.countDistinct("npi").alias("members"), F.countDistinct(zip5("zip")).alias("zips"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return a.join(b, "platform", "left").select("platform", "n", zero("members"), zero("zips"))


@query(f"""with p as (select {ZIP_SQL.format('zip')} z, upper(trim(state)) st, npi from practices where {ZIP_SQL.format('zip')} is not null), m as (select z, st, count(*) n, min(npi) f from p where st<>'' group by 1,2), s as (select z, arg_min(st, lpad((1000000000-n)::varchar,10,'0')||f) st from m group by 1) select p.npi, coalesce(nullif(p.st,''), s.st) st from p left join s using (z)""")
def state_from_zip(spark: SparkSession, d: str) -> DataFrame:
    """Missing states filled with the most frequent state of the ZIP."""
    p = table(spark, d, "practices").select("npi", zip5("zip").alias("z"), F.upper(nz("state")).alias("st")).filter("z is not null")
    m = p.filter("st is not null").groupBy("z", "st").agg(F.count(F.lit(1)).alias("n"), F.min("npi").alias("f"))
    s = m.groupBy("z").agg(F.min_by("st", F.struct((-C("n")).alias("n"), "f")).alias("most"))
    return p.join(s, "z", "left").select("npi", F.coalesce("st", "most").alias("st"))


@query(f"""with k as (select {STREET_SQL.format('address')} s, {ZIP_SQL.format('zip')} z, npi, phone, website, entity_type in ('organization','2') org, employee_count from practices), g as (select s, z, max(org::int) org, count(case when not org then 1 end) people, count(nullif(trim(phone),'')) phones, count(nullif(trim(website),'')) sites, max(employee_count) staff from k where s is not null group by 1,2)
 select s as street, z as zip5, org=0 and people<=1 and phones=0 and sites=0 and coalesce(staff,0)<=1 silent from g""")
def silent_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses without firm, telephone, site or staff and with one person at most."""
    org = C("entity_type").isin("organization", "2")
    k = table(spark, d, "practices").withColumn("s", street_key(C("address"))).withColumn("z", zip5("zip")).filter("s is not null")
    g = k.groupBy("s", "z").agg(F.max(org).alias("org"), F.count_if(~org).alias("people"), F.count(nz("phone")).alias("phones"), F.count(nz("website")).alias("sites"), F.max("employee_count").alias("staff"))
    silent = ~C("org") & (C("people") <= 1) & (C("phones") == 0) & (C("sites") == 0) & (F.coalesce("staff", F.lit(0)) <= 1)
    return g.select(C("s").alias("street"), C("z").alias("zip5"), silent.alias("silent"))


@query(f"""with p as (select npi, website, nullif(trim(doing_business_as),'') d, nullif(trim(parent_company),'') o, nullif(trim(affiliated_dso),'') a from practices) select npi, coalesce(a, o, d) label, array_to_string(list_filter([case when a is not null then 'group' end, case when o is not null then 'parent' end, case when d is not null then 'trade name' end], lambda x: x is not null), '+') known from p""")
def platform_label(spark: SparkSession, d: str) -> DataFrame:
    """The first non-blank of several columns, and which of them are known."""
    p = table(spark, d, "practices")
    cols = {"group": nz("affiliated_dso"), "parent": nz("parent_company"), "trade name": nz("doing_business_as")}
    return p.select("npi", F.coalesce(*cols.values()).alias("label"), F.array_join(F.array_compact(F.array(*[F.when(c.isNotNull(), n) for n, c in cols.items()])), "+").alias("known"))


@query("""with d as (select o_custkey, o_orderkey, o_orderdate, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders) select c_custkey, strftime(d.o_orderdate,'%Y-%m-%d') last_day, d.o_totalprice from customer join d on d.o_custkey=c_custkey and rn=1""")
def latest_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Each customer with its newest order."""
    last = table(spark, d, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("o_totalprice"), F.max("o_orderdate").alias("t"))
    return table(spark, d, "customer").select("c_custkey").join(last, "c_custkey").select("c_custkey", F.date_format("t", "yyyy-MM-dd").alias("last_day"), "o_totalprice")
