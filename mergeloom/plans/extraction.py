"""Queries that read deals out of sentences, and people and addresses out of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions import address as A
from mergeloom.functions import deals as D
from mergeloom.functions import nested as N
from mergeloom.functions import text as X
from mergeloom.functions.core import nz
from mergeloom.functions.parse import STATES
from mergeloom.operators.matching import longest_pattern
from mergeloom.plans.registry import query
from mergeloom.session import Scratch, table

C = F.col
_Q = lambda p: p.replace("'", "''")


def _ladder(text: str, patterns: list[str], low: bool = False) -> str:
    t = f"lower({text})" if low else text
    return "coalesce(" + ",".join(f"nullif(regexp_extract({t},'{_Q(p)}',1),'')" for p in patterns) + ")"


def _words(ws: list[str]) -> str:
    return "[" + ",".join(f"'{w}'" for w in ws) + "]"


def _rules(text: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    return "case when " + text + " is null then null " + " ".join(f"when regexp_matches(lower({text}),'{_Q(p)}') then '{n}'" for n, p in rules) + f" else '{otherwise}' end"


_BARE = "regexp_replace(lower({0}),'[.,;]+$','')"
_SPLIT = "list_filter(regexp_split_to_array(regexp_replace(trim({0}),'[.,;]+$',''),' +'), lambda w: w<>'')"
_CUT = f"list_slice(ws, 1, coalesce(list_min(list_transform(list_filter(range(1,len(ws)+1), lambda i: list_contains({_words(D.STOPS)}, {_BARE.format('ws[i]')})), lambda i: i-1)), len(ws)))"
_TRIM = f"list_slice(ks, 1, coalesce(list_max(list_filter(range(1,len(ks)+1), lambda i: not list_contains({_words(D.LEFTOVERS)}, lower(ks[i])))), 0))"
_TARGET_SQL = (
    "with t as (select id, platform_company p, k, nullif(regexp_extract(raw_text, pat, 1),'') raw from deals, (values "
    + ",".join(f"({i},'{_Q(p)}')" for i, p in enumerate(D.TARGETS))
    + f") v(k, pat)), a as (select *, {_SPLIT.format('raw')} ws from t where raw is not null), b as (select *, {_CUT} ks from a), c as (select *, regexp_replace(array_to_string({_TRIM},' '),'[.,;]+$','') name from b),"
    + f" x as (select id, name, row_number() over (partition by id order by k) rn from c where name<>'' and not list_contains({_words(D.NO_TARGET)}, lower(name)) and lower(name)<>coalesce(lower(trim(p)),''))"
)


@query(_TARGET_SQL + " select d.id, x.name target from deals d left join x on x.id=d.id and rn=1 where raw_text is not null")
def deal_target(spark: SparkSession, d: str) -> DataFrame:
    """The practice a sentence says was acquired."""
    return table(spark, d, "deals").filter("raw_text is not null").select("id", D.target(C("raw_text"), C("platform_company")).alias("target"))


_NAMED = "[" + ",".join(f"case when regexp_matches(lower(raw_text),'\\b{n}\\b') then '{c}' end" for n, c in STATES.items()) + "]"
_STATES_SQL = f"array_to_string(list_sort(list_distinct(list_filter(list_concat(list_concat(list_filter(regexp_extract_all(raw_text,'\\b([A-Z]{{2}})\\b',1), lambda c: list_contains({_words(list(STATES.values()))}, c) and c not in ('OR','IN','ME')), {_NAMED}), case when regexp_matches(raw_text,'\\bOR\\b( *,| *and\\b| *-)') then ['OR'] else [] end), lambda c: c is not null))),',')"


@query(f"""select id, coalesce(regexp_matches(lower(raw_text),'{_Q(D.DEAL_VERBS)}') and len(raw_text)>=40, false) is_deal, case when regexp_matches(lower(raw_text),'{_Q(D.CREDIT)}') then 'credit' when regexp_matches(lower(raw_text),'{_Q(D.ABROAD)}') then 'abroad' end off_topic,
 trim({_ladder('raw_text', D.SPONSORS)}) sponsor, {_STATES_SQL} states, {_rules('raw_text', D.SPECIALTIES, 'general')} specialty, {_rules('raw_text', D.KINDS, 'add-on')} kind from deals where raw_text is not null""")
def deal_fields(spark: SparkSession, d: str) -> DataFrame:
    """Whether a sentence is about a deal, its sponsor, states, specialty and kind."""
    t = C("raw_text")
    return table(spark, d, "deals").filter("raw_text is not null").select(
        "id", D.is_deal(t).alias("is_deal"), D.off_topic(t).alias("off_topic"), D.sponsor(t).alias("sponsor"), D.states(t).alias("states"), D.specialty(t).alias("specialty"), D.kind(t).alias("kind")
    )


@query("""with b as (select distinct lower(trim(platform_company)) p from deals where trim(platform_company)<>''), h as (select id, p, row_number() over (partition by id order by len(p) desc, p) rn from deals, b where contains(lower(raw_text), p))
 select d.id, coalesce(h.p, lower(nullif(trim(regexp_extract(raw_text,'^((?:[A-Z][A-Za-z''&.-]*)(?: (?:&|of|[A-Z][A-Za-z''&.-]*))*)',1)),''))) platform, case when h.p is null then 'walk' else 'dictionary' end how from deals d left join h on h.id=d.id and rn=1 where raw_text is not null""")
def deal_platform(spark: SparkSession, d: str) -> DataFrame:
    """The platform of a sentence: the longest known one, else the capitalised words it begins with."""
    e = table(spark, d, "deals")
    hit = longest_pattern(e.filter("raw_text is not null"), "raw_text", e, "platform_company", "id")
    out = e.filter("raw_text is not null").select("id", F.lower(D.leading_name(C("raw_text"))).alias("walk")).join(hit, "id")
    return out.select("id", F.coalesce("pattern", "walk").alias("platform"), F.when(C("pattern").isNull(), "walk").otherwise("dictionary").alias("how"))


_LOC_LIST = "[" + ",".join(f"try_cast(nullif(regexp_extract(lower(text),'{_Q(p)}',1),'') as int)" for p in D.LOCATIONS) + "]"


@query(f"""select doc_id, list_filter({_LOC_LIST}, lambda n: n between 1 and 2000)[1] places from documents where text is not null""")
def document_places(spark: SparkSession, d: str) -> DataFrame:
    """The number of places a text speaks of."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", D.locations(C("text")).alias("places"))


_MONTH = f"\\b({'|'.join(D.MONTHS)}) ([12][0-9]{{3}})\\b"


@query(f"""select doc_id, case when regexp_extract(lower(text),'{_MONTH}',2)<>'' then regexp_extract(lower(text),'{_MONTH}',2)||'-'||lpad(list_position({_words(D.MONTHS)}, regexp_extract(lower(text),'{_MONTH}',1))::varchar,2,'0') end as "month" from documents where text is not null""")
def document_month(spark: SparkSession, d: str) -> DataFrame:
    """The first month with a year that a text names."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.date_format(D.month_named(C("text")), "yyyy-MM").alias("month"))


@query("""with u as (select source, regexp_extract(source_url,'/([12][0-9]{3}/(?:0[1-9]|1[0-2]))/',1) m from deals), h as (select source, replace(m,'/','-') m, count(*) n from u where m<>'' group by 1,2) select source, m as "month", n from h""")
def months_in_links(spark: SparkSession, d: str) -> DataFrame:
    """Months that the links of each source cover, with the number of links."""
    e = table(spark, d, "deals").select("source", F.explode(D.months_covered(C("source_url"))).alias("m"))
    return e.groupBy("source", F.date_format("m", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


_T = _TARGET_SQL + ", y as (select d.id, d.platform_company p, d.deal_date dd, x.name from deals d join x on x.id=d.id and rn=1 where nullif(trim(d.target_name),'') is null)"


@query(_T + " select id, name target from (select *, row_number() over (partition by p, name, dd order by id) k from y where len(name) between 3 and 80 and not regexp_matches(lower(name),'^(an? |the |undisclosed)') and not exists (select 1 from deals o where o.platform_company=y.p and o.target_name=y.name and o.deal_date=y.dd)) where k=1 or p is null or dd is null")
def target_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Targets read again from the text where they are missing, without junk and without making two deals the same."""
    from mergeloom.operators.merge import insert_if_absent

    e = table(spark, d, "deals")
    # Written once: the long expression would be repeated in every condition on it.
    found = Scratch(spark).cut(e.filter(nz("target_name").isNull() & C("raw_text").isNotNull()).select("id", "platform_company", "deal_date", D.target(C("raw_text"), C("platform_company")).alias("target_name")))
    found = found.filter(F.length("target_name").between(3, 80) & ~F.lower("target_name").rlike("^(an? |the |undisclosed)"))
    old = e.select("platform_company", "target_name", "deal_date")
    return insert_if_absent(old, found, ["platform_company", "target_name", "deal_date"], [F.asc("id")]).select("id", C("target_name").alias("target"))


_MARKERS = [" SUITE ", " UNIT ", " APT ", " FLOOR ", " FL ", " #", "#"]
_cut = "upper(address)"
for _m in _MARKERS:
    _cut = f"split_part({_cut},'{_m}',1)"
_U = "trim(regexp_replace(regexp_replace(upper({0}),'[^A-Z0-9 ]',' ','g'),' +',' ','g'))"


@query(f"""select npi, trim({_cut}) by_marker, {_U.format("regexp_replace(upper(address),'[ ,]+(SUITE|STE|UNIT|APT|ROOM|RM|FLOOR|FL|BLDG|#).*$','')")} importer, {_U.format('address')} letters_digits, regexp_replace(lower(trim(address)),'[^a-z0-9]','','g') squeezed,
 regexp_extract(upper(trim(address)),'^([0-9]+ +[A-Z0-9]+)',1) number_word, array_to_string(list_sort(list_distinct(string_split({_U.format('address')},' '))),' ') sorted_words, lower(trim(address))||'|'||coalesce(left(nullif(trim(zip),''),5),'') raw_key from practices where nullif(trim(address),'') is not null""")
def address_variants(spark: SparkSession, d: str) -> DataFrame:
    """Further named normalisers of addresses, which group rows differently."""
    a = C("address")
    return table(spark, d, "practices").filter(nz("address").isNotNull()).select(
        "npi", A.before_markers(a, _MARKERS).alias("by_marker"), A.without_suite(a).alias("importer"), A.letters_digits(a).alias("letters_digits"), A.squeezed(a).alias("squeezed"),
        A.number_word(a).alias("number_word"), A.sorted_words(a).alias("sorted_words"), A.raw_key(a, C("zip")).alias("raw_key"),
    )


_ADDR = "^ *([0-9]+[^,]*), *([^,]+), *([A-Z]{2}) +([0-9]{5})"


@query(f"""with a as (select npi, trim(address)||', '||trim(city)||', '||upper(trim(state))||' '||trim(zip) whole from practices where address is not null and city is not null and state is not null and zip is not null)
 select npi, nullif(regexp_extract(whole,'{_ADDR}',1),'') street, nullif(regexp_extract(whole,'{_ADDR}',2),'') town, nullif(regexp_extract(whole,'{_ADDR}',3),'') st, nullif(regexp_extract(whole,'{_ADDR}',4),'') zip5 from a""")
def address_parts(spark: SparkSession, d: str) -> DataFrame:
    """Street, town, state and ZIP out of one line."""
    whole = F.concat(F.trim("address"), F.lit(", "), F.trim("city"), F.lit(", "), F.upper(F.trim("state")), F.lit(" "), F.trim("zip"))
    p = table(spark, d, "practices").withColumn("whole", whole).filter("whole is not null")
    return p.select("npi", A.one_line(C("whole")).alias("x")).select("npi", "x.*")


@query(r"""with n as (select npi, trim(regexp_replace(practice_name,'\s+',' ','g')) n, provider_last_name l from practices where practice_name is not null), b as (select *, trim(regexp_replace(regexp_replace(n,'^(Dr|DR|dr)\.? ',''),'[, ]+(DDS|DMD|dds|dmd|Jr|JR|MD)\.?$','')) b from n)
 select npi, regexp_matches(n,'(DDS|DMD|dds|dmd)\.?$|^(Dr|DR|dr)\.? ') and not regexp_matches(lower(n),'dental|dentistry|care|group|clinic|center|studio|associates|smile|ortho|&') person, coalesce(nullif(trim(l),''), nullif(regexp_extract(b,'([A-Za-z''-]+)$',1),'')) surname from b""")
def people_names(spark: SparkSession, d: str) -> DataFrame:
    """Whether a name is a person's, and the surname: the known one, else the last word without titles."""
    p = table(spark, d, "practices").filter("practice_name is not null")
    return p.select("npi", X.is_person(C("practice_name")).alias("person"), F.coalesce(nz("provider_last_name"), X.surname(C("practice_name"))).alias("surname"))


@query("""select id, case when x>5000 then x/1000 when x>0 then x end size_mm, case when m>0 and m<100 then round(m,1) end multiple, case when num_locations is not null then num_locations when x>0 then floor(x)::int end n from (select *, case id%3 when 0 then deal_size_mm*1000 when 1 then deal_size_mm else -deal_size_mm end x, case id%2 when 0 then ebitda_multiple else ebitda_multiple*100 end m from deals where deal_size_mm between 6 and 4999)""")
def deal_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and multiples within their bounds, and a number with another to fall back on; written out and read back."""
    e = table(spark, d, "deals").filter("deal_size_mm between 6 and 4999")
    x = F.when(C("id") % 3 == 0, C("deal_size_mm") * 1000).when(C("id") % 3 == 1, C("deal_size_mm")).otherwise(-C("deal_size_mm"))
    m = F.when(C("id") % 2 == 0, C("ebitda_multiple")).otherwise(C("ebitda_multiple") * 100)
    band = F.when(x > 0, F.concat(F.floor(x).cast("string"), F.lit(" to 9999")))
    return e.select("id", D.size_mm(F.concat(F.lit("$"), x.cast("string"))).alias("size_mm"), D.multiple(F.concat(m.cast("string"), F.lit("x"))).alias("multiple"), D.staff(C("num_locations"), band).alias("n"))


@query("""select npi, 2025 - year_established age, coalesce(nullif(trim(parent_company),''),'') || case when contains(coalesce(parent_company,''),'[seen]') then '' else ' [seen]' end note from practices""")
def ages_and_notes(spark: SparkSession, d: str) -> DataFrame:
    """Years since the foundation, and a note that a marker is added to once."""
    p = table(spark, d, "practices")
    return p.select("npi", (F.lit(2025) - C("year_established")).alias("age"), X.with_note(F.coalesce(nz("parent_company"), F.lit("")), F.lit(" [seen]"), "[seen]").alias("note"))


@query("""select event_id, to_json({'id': event_id, 'kind': event_type, 'k': cast(json_extract(props,'$.k') as bigint)})::varchar doc from events""")
def serialised(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON documents, nulls kept."""
    e = table(spark, d, "events")
    doc = F.struct(C("event_id").alias("id"), C("event_type").alias("kind"), N.path(C("props"), "$.k", "bigint").alias("k"))
    return e.select("event_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


@query("""with e as (select user_id, cast(json_extract(props,'$.k') as bigint) k, event_type, ts, event_id from events where ts is not null), g as (select user_id, arg_max(k, (ts, event_id)) filter (k is not null) k, arg_max(event_type, (ts, event_id)) last, list_sort(list_distinct(list(event_type))) kinds from e group by 1) select user_id, k::double k, last, array_to_string(kinds,',') kinds from g""")
def merged_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents of an entity merged into one: the newest known value of a field, lists united; flattened to columns."""
    e = table(spark, d, "events").filter("ts is not null")
    docs = e.select("user_id", F.struct("ts", "event_id").alias("o"), F.to_json(F.struct(N.path(C("props"), "$.k", "bigint").alias("k"), C("event_type").alias("last"), F.array("event_type").alias("kinds"))).alias("doc"))
    merged = N.merge_documents(docs, "user_id", "o", "doc")
    m = C("doc")
    return merged.select("user_id", N.path(m, "$.k", "bigint").cast("double").alias("k"), N.path(m, "$.last").alias("last"), F.array_join(F.array_sort(F.from_json(F.get_json_object(m, "$.kinds"), "array<string>")), ",").alias("kinds"))
