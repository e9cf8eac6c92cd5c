from pathlib import Path

import pytest
from conftest import rows

from mergeloom.llm.mixing import TOKENIZER, budgets, encoder, fill, mix

DOCS = "id bigint, text string, lang string, src string, leaf string, n bigint"
DOMAINS = {"a": "x", "b": "x", "c": "y"}


def test_fill_and_tree():
    assert fill(10, {"p": 0, "q": 0}, {"p": 1, "q": 1}, {"p": 2, "q": 100}) == {"p": 2, "q": 8}
    leaves = [(("x", "en", "a"), 0.4, 10.0), (("x", "en", "b"), 0.2, 100.0), (("y", "en", "c"), 0.4, 100.0)]
    got = budgets(leaves, 100)
    assert {k[2]: round(v, 6) for k, v in got.items()} == {"a": 10, "b": 50, "c": 40}  # a's shortage stays in its domain
    short = budgets([(("x", "en", "a"), 0.6, 10.0), (("y", "en", "c"), 0.4, 100.0)], 100)
    assert {k[2]: round(v, 6) for k, v in short.items()} == {"a": 10, "c": 90}  # then it goes up the tree


def test_a_weight_of_zero_gets_nothing():
    leaves = [(("d", "en", "a"), 0.5, 100.0), (("d", "en", "z"), 0.0, 1000.0), (("d", "en", "y"), 0.1, 300.0), (("e", "en", "b"), 0.4, 1000.0)]
    assert {k[2]: round(v, 6) for k, v in budgets(leaves, 1000).items()} == {"a": 100, "z": 0, "y": 300, "b": 600}
    assert {k[2]: round(v, 6) for k, v in budgets([(("d", "en", "a"), 0.5, 100.0), (("d", "en", "z"), 0.0, 1000.0)], 1000).items()} == {"a": 100, "z": 0}


def test_zero_target_with_records(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.0, 9), ("c", 0.5, 1)], "source string, target_share double, max_repeats int")
    table = {r.source: r.mixed_tokens for r in mix(docs(spark), "id", "text", "lang", "src", targets, DOMAINS, total=5000)[1].collect()}
    assert table["b"] == 0 and table["a"] > 1000 and table["c"] > 0


def docs(spark):
    text = "the quick brown fox jumps over the lazy dog "
    data = [(i, text * (1 + i % 4), "en" if i % 3 else "es", "A " if i % 2 else "b", "", 1) for i in range(120)] + [(500 + i, text, None, "c", "", 1) for i in range(5)]
    return spark.createDataFrame(data + [(900, None, "en", "a", "", 1), (901, "", "en", "a", "", 1), (902, text, "en", None, "", 1), (903, text, "en", "other", "", 1), (None, text, "en", "a", "", 1)], DOCS)


TARGETS = [("a", 0.5, 2), ("b", 0.2, 1), ("c", 0.3, 3), ("gone", 0.0, 4)]


def test_mixture_keeps_budgets_and_repeats(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixture, shares = mix(docs(spark), "id", "text", "lang", "src", targets, DOMAINS)
    e = encoder(Path(TOKENIZER).read_bytes())
    size = {r.id: len(e.encode_ordinary(r.text or "")) for r in docs(spark).collect()}
    got = mixture.collect()
    assert {r.id for r in got}.isdisjoint({None, 900, 901, 902, 903}) and len({r.id for r in got}) == len(got)
    most = {s: m for s, _, m in TARGETS}
    assert all(r.n_tokens == size[r.id] and 1 <= r.repeats <= most[r.source] for r in got)
    table = {r.source: r for r in shares.collect()}
    for s in "abc":
        assert table[s].mixed_tokens == sum(r.n_tokens * r.repeats for r in got if r.source == s)
    total = sum(size[i] for i in size if i is not None and i not in (900, 901, 902, 903))
    assert table["c"].mixed_tokens == 3 * sum(size[500 + i] for i in range(5))  # short: all it may give
    want_b = min(0.2 * total + 0, table["b"].available_tokens)
    assert table["b"].mixed_tokens <= table["b"].available_tokens and table["b"].mixed_tokens >= want_b - 200
    assert total - 400 <= sum(r.mixed_tokens for r in table.values()) <= total
    assert table["gone"].mixed_tokens == 0 and abs(sum(r.share for r in table.values()) - 1) < 1e-4


def test_same_seed_same_mixture_and_empty(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    one, two = (rows(mix(docs(spark), "id", "text", "lang", "src", targets, DOMAINS, total=1500)[0]) for _ in range(2))
    assert one == two and sum(r[2] * r[3] for r in one) <= 1500
    mixture, shares = mix(spark.createDataFrame([], DOCS), "id", "text", "lang", "src", targets, DOMAINS)
    assert rows(mixture) == [] and all(r.mixed_tokens == 0 for r in shares.collect())


def test_absent_source_gives_way_to_its_domain(spark):
    targets = spark.createDataFrame([("a", 0.3, 2), ("gone", 0.3, 2), ("b", 0.4, 2)], "source string, target_share double, max_repeats int")
    table = {r.source: r.mixed_tokens for r in mix(docs(spark), "id", "text", "lang", "src", targets, {"a": "x", "gone": "x", "b": "y"}, total=1000)[1].collect()}
    assert table["gone"] == 0 and 500 < table["a"] <= 600 and 300 < table["b"] <= 400


@pytest.mark.parametrize("text", ["Hello, world's end! 123", "¿Qué tal?  años\n\n", "  spaces   and\ttabs "])
def test_tokenizer_round_trip(text):
    e = encoder(Path(TOKENIZER).read_bytes())
    assert e.decode(e.encode_ordinary(text)) == text
