"""Fields of a deal from a sentence about it. Each function is a Column expression; what cannot be found is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mergeloom.functions.parse import STATES

# What may stand in a name, and the phrases around targets and sponsors, in the order they are tried.
NAME = r"[A-Z][A-Za-z0-9 '’&.-]{3,60}?"
TARGETS = [
    rf"({NAME}) was acquired by ",
    rf"({NAME})(?: \([^)]*\))? (?:has )?joined ",
    rf"({NAME}) is now part of ",
    rf"({NAME}) affiliated with ",
    rf"acqui(?:red|sition of):? ({NAME})(?: in | from | to |,|;|\.$|\. )",
    rf"added ({NAME})(?: of | in | to |,|;|\.$|\. )",
    rf"(?:partnered|partnership) with:? ({NAME})(?: in |,|;|\(|\.$|\. )",
    rf"(?:welcomed|merged with|addition of) ({NAME})(?: in | to | as |,|;|\.$|\. )",
]
# Words that end a name, words that may be left over before them, and words that are no name.
STOPS = ["which", "located", "headquartered", "based", "situated", "operating", "serving", "providing", "offering", "established", "that", "where", "while", "after", "since", "led", "owned", "founded", "managed", "run", "operated"]
LEFTOVERS = ["is", "was", "are", "were", "has", "have", "had", "been", "being", "will", "would", "by", "dr", "dr.", "mr.", "ms."]
NO_TARGET = ["the", "a", "an", "its", "their", "several", "multiple", "two", "three", "four", "five", "dr", "new"]
SPONSORS = [r"backed by ([A-Z][A-Za-z &]+?)(?:,|\.|;| added| has|\))", r"\(([A-Z][A-Za-z &]+ (?:Capital|Partners|Equity|Group))\)", r"(?:investment from|portfolio company of|owned by) ([A-Z][A-Za-z &]+?)(?:,|\.|;)"]
# Specialties and kinds of deal by the first pattern found.
SPECIALTIES = [
    ("oral_surgery", r"oral surgery|maxillofacial|oms\b"), ("orthodontics", "orthodont"), ("endodontics", "endodont"), ("periodontics", "periodont"),
    ("pediatric", r"pediatric dent|pedo|children.s dentistry"), ("prosthodontics", "prosthodont"), ("multi_specialty", r"multi[- ]?specialty|multi[- ]?disciplin"),
]
KINDS = [
    ("recapitalization", r"\brecapital|\brecap\b"), ("de_novo", r"\bde novo\b|\bgrand opening\b|\bnew office\b|\bnew location\b|\bopen(s|ed)?\b"), ("buyout", r"\bnew platform\b|\bbuyout\b"),
    ("growth", r"\bgrowth\b|\bexpansion capital\b|\binvestment in\b"), ("partnership", r"\bpartnership\b|\bpartnered\b|\baffilia"),
]
LOCATIONS = [r"([0-9]+)[- ]location", r"([0-9]+) +(?:new +)?(?:dental +|partner +)?(?:locations|offices|practices|clinics)", r"operates +([0-9]+)"]
DEAL_VERBS = r"\bacquir|\baffilia|\bpartner|\bmerge|\bsale to\b|\bsold\b|\bwelcom|\bjoined\b|\bopen(ed|ing)\b|\bnew (location|office|practice)|\badded\b|\bexpand|\bcompleted\b|\bannounced\b|\binvest|\bbacked\b|\brecap|\bnow part of\b"
# Words of news that is no deal: debt and ratings, and abroad.
CREDIT = r"\b(credit facility|term loan|refinanc\w*|moody's|s&p global|debt rating|downgrade\w*)\b"
ABROAD = r"\b(uk|united kingdom|australia|canada|germany|brazil|europe)\b"


def _first(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def is_deal(text: Column) -> Column:
    """Whether a text speaks of a deal: a verb of dealing and at least forty characters."""
    return F.coalesce(F.lower(text).rlike(DEAL_VERBS) & (F.length(text) >= 40), F.lit(False))


def off_topic(text: Column) -> Column:
    """'credit' or 'abroad' for news that is no deal here, else null."""
    return F.when(F.lower(text).rlike(CREDIT), "credit").when(F.lower(text).rlike(ABROAD), "abroad")


def trimmed_name(raw: Column) -> Column:
    """A name up to the first word that begins a clause, without what is left over before it; null if nothing remains."""
    bare = lambda w: F.regexp_replace(F.lower(w), "[.,;]+$", "")
    within = lambda w, words: F.array_contains(F.array(*[F.lit(x) for x in words]), w)
    words = F.filter(F.split(F.regexp_replace(F.trim(raw), "[.,;]+$", ""), " +"), lambda w: w != "")
    # Number of words before the first stop word, and of those up to the last one that is no leftover.
    upto = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(False).alias("off")), lambda s, w: F.struct((s["n"] + F.when(~s["off"] & ~within(bare(w), STOPS), 1).otherwise(0)).alias("n"), (s["off"] | within(bare(w), STOPS)).alias("off")))["n"]
    kept = F.slice(words, F.lit(1), upto)
    last = F.aggregate(F.transform(kept, lambda w, i: F.when(within(F.lower(w), LEFTOVERS), 0).otherwise(i + 1)), F.lit(0), lambda s, x: F.greatest(s, x))
    return F.nullif(F.regexp_replace(F.array_join(F.slice(kept, F.lit(1), last), " "), "[.,;]+$", ""), F.lit(""))


def target(text: Column, platform: Column) -> Column:
    """The first name that one of the phrases gives and that is neither the platform nor a mere article or number."""
    found = F.array(*[trimmed_name(F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for p in TARGETS])
    ok = lambda x: x.isNotNull() & ~F.lower(x).isin(NO_TARGET) & (F.lower(x) != F.coalesce(F.lower(F.trim(platform)), F.lit("")))
    return F.try_element_at(F.filter(found, ok), F.lit(1))


def sponsor(text: Column) -> Column:
    return F.trim(_first(text, SPONSORS))


def states(text: Column) -> Column:
    """Codes of the states named, sorted and joined by commas, '' if none.

    IN and ME count only if the state's name is there too, OR only with its name or before a comma, 'and' or a dash.
    """
    codes = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2})\b"), F.lit(1)), lambda c: c.isin(list(STATES.values())))
    low = F.lower(text)
    named = F.array_compact(F.array(*[F.when(low.rlike(rf"\b{name}\b"), code) for name, code in STATES.items()]))
    plain = F.array_except(codes, F.array(*[F.lit(c) for c in ("OR", "IN", "ME")]))
    oregon = F.when(text.rlike(r"\bOR\b( *,| *and\b| *-)"), F.array(F.lit("OR"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.array_sort(F.array_distinct(F.concat(plain, named, oregon))), ",")


def _by_pattern(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    out = None
    for label, pattern in rules:
        hit = F.lower(text).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.when(text.isNotNull(), out.otherwise(otherwise))


def specialty(text: Column) -> Column:
    return _by_pattern(text, SPECIALTIES, "general")


def kind(text: Column) -> Column:
    return _by_pattern(text, KINDS, "add-on")


def locations(text: Column) -> Column:
    """A number of places between 1 and 2000, by the first phrase that gives one."""
    numbers = F.array(*[F.nullif(F.regexp_extract(F.lower(text), p, 1), F.lit("")).try_cast("int") for p in LOCATIONS])
    return F.try_element_at(F.filter(numbers, lambda n: (n >= 1) & (n <= 2000)), F.lit(1))


def leading_name(text: Column) -> Column:
    """The run of capitalised words (with & and of between them) at the beginning of a text."""
    return F.nullif(F.trim(F.regexp_extract(text, r"^((?:[A-Z][A-Za-z'&.-]*)(?: (?:&|of|[A-Z][A-Za-z'&.-]*))*)", 1)), F.lit(""))


# Names of months.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def month_named(text: Column) -> Column:
    """The first day of the first month that a text names with its year."""
    pattern = rf"\b({'|'.join(MONTHS)}) ([12][0-9]{{3}})\b"
    low = F.lower(text)
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(low, pattern, 1)).cast("int")
    return F.when(at > 0, F.make_date(F.regexp_extract(low, pattern, 2).try_cast("int"), at, F.lit(1)))


def months_covered(title: Column) -> Column:
    """First days of the months that a title or address covers: a month, a quarter ('Q3 2024'), a year in review, '/2024/07/'."""
    low = F.lower(title)
    year = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit("")).try_cast("int")
    span = lambda first, n: F.sequence(first, F.add_months(first, n - 1), F.expr("interval 1 month"))
    quarter = F.nullif(F.regexp_extract(low, r"\bq([1-4])[ -]*[12][0-9]{3}", 1), F.lit("")).try_cast("int")
    q_year = year(r"\bq[1-4][ -]*([12][0-9]{3})")
    path = F.make_date(year(r"/([12][0-9]{3})/(?:0[1-9]|1[0-2])/"), F.nullif(F.regexp_extract(low, r"/[12][0-9]{3}/(0[1-9]|1[0-2])/", 1), F.lit("")).try_cast("int"), F.lit(1))
    review = F.coalesce(year(r"year[ -]in[ -]review[^0-9]*([12][0-9]{3})"), year(r"([12][0-9]{3})[^0-9]*year[ -]in[ -]review"))
    one = F.coalesce(month_named(F.regexp_replace(low, "-", " ")), path)
    return (
        F.when(review.isNotNull(), span(F.make_date(review, F.lit(1), F.lit(1)), 12)).when(quarter.isNotNull(), span(F.make_date(q_year, quarter * 3 - 2, F.lit(1)), 3))
        .when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<date>"))
    )


def size_mm(text: Column) -> Column:
    """Millions: numbers above 5,000 are thousands of them written out; what is not positive is null."""
    x = F.regexp_replace(text.cast("string"), "[$, ]", "").try_cast("double")
    return F.when(x > 5000, x / 1000).when(x > 0, x)


def multiple(text: Column) -> Column:
    """A multiple between 0 and 100, to one decimal."""
    x = F.regexp_replace(F.lower(text.cast("string")), "[x, ]", "").try_cast("double")
    return F.when((x > 0) & (x < 100), F.round(x, 1))


def staff(actual: Column, band: Column) -> Column:
    """Number of staff: the actual one, else the first number of a band ('10 to 19')."""
    number = lambda c: F.nullif(F.regexp_extract(F.regexp_replace(c.cast("string"), ",", ""), "([0-9]+)", 1), F.lit("")).try_cast("int")
    return F.coalesce(number(actual), number(band))
