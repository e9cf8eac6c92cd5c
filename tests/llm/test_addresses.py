import pytest
from conftest import rows

from mergeloom.llm.addresses import one_edit, parse_address, same_building


@pytest.mark.parametrize(
    "text,want",
    [
        ("10-12 N. Main St., Ste 4", ("10", "N", "MAIN", "ST", "4")),
        ("Oak Health Center, 549 NORTH CHESTNUT SQUARE STE. 346", ("549", "N", "CHESTNUT", "SQ", "346")),
        ("#B, 68 1st Street", ("68", "", "1TH", "ST", "B")),
        ("31 TWELFTH WEST RM 398", ("31", "W", "12TH", "", "398")),
        ("5 e st rt 66", ("5", "E", "STATE ROUTE 66", "", "")),
        ("7 Co Rd 9 # 3", ("7", "", "COUNTY ROAD 9", "", "3")),
        ("309 ST JUNIPER DR.", ("309", "", "SAINT JUNIPER", "DR", "")),
        ("12 Elm Ave, 2nd Floor", ("12", "", "ELM", "AVE", "FL2")),
        ("922 KINGSLEY ST REAR", ("922", "", "KINGSLEY", "ST", "REAR")),
        ("12 North St", ("12", "", "NORTH", "ST", "")),
        ("", ("", "", "", "", "")),
        (None, ("", "", "", "", "")),
    ],
)
def test_parse(text, want):
    assert parse_address(text) == want


def test_one_edit():
    assert all(one_edit(a, b) for a, b in [("abc", "abc"), ("abc", "abxc"), ("abc", "ab"), ("abc", "axc"), ("abc", "acb"), ("", "a")])
    assert not any(one_edit(a, b) for a, b in [("abc", "bca"), ("abcd", "ab"), ("abc", "xyc")])


SCHEMA = "npi string, address string, city string, state string, zip string, id bigint, name string"
ADDRESSES = [
    ("a1", "10 N Chestnut St Ste 4", "Fairford", "GA", "69481"),
    ("a2", "10 NORTH CHESTNUT STREET", "fairford", "GA", "69481-1234"),
    ("a3", "Oak Plaza, 10-14 N Chesntut St, #9", "Fairfrod", None, None),
    ("a4", "10 Chestnut", None, "GA", "69481"),
    ("b1", "10 S Chestnut St", "Fairford", "GA", "69481"),
    ("c1", "10 N Chestnut Ave", "Fairford", "GA", "69481"),
    ("d1", "12 N Chestnut St", "Fairford", "GA", "69481"),
    ("e1", "10 N Chestnut St", "Redton", "GA", "11111"),
    ("f1", "10 N Chestnut St", "Fairford", "GA", "69418"),
    ("g1", "5 Highway 60", "Redton", "GA", "11111"),
    ("g2", "5 HWY. 60, Rm 2", "Redton", "GA", "11111"),
    ("g3", "5 Highway 66", "Redton", "GA", "11111"),
    ("n1", None, "Redton", "GA", "11111"),
    ("n2", "  ", "Redton", "GA", "11111"),
    (None, "5 Highway 60", "Redton", "GA", "11111"),
    ("a1", "10 N Chestnut St Ste 4", "Fairford", "GA", "69481"),
]


def test_buildings(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in ADDRESSES], SCHEMA)
    found = set(rows(same_building(df, "npi", "address", "city", "state", "zip")))
    same = {"a1", "a2", "a3", "f1"}
    assert {p for p in found if set(p) <= same} == {(a, b) for a in same for b in same if a < b}
    assert ("g1", "g2") in found and not any("g3" in p or "e1" in p or "d1" in p for p in found)
    assert {("a1", "b1"), ("a1", "c1"), ("b1", "c1")}.isdisjoint(found)
    assert {("a1", "a4"), ("a4", "b1"), ("a4", "c1")} <= found  # parts that are not given do not count


def test_hot_building_and_empty(spark):
    df = spark.createDataFrame([(f"h{i:03}", f"10 N Chestnut St Ste {i}" + " " * (i % 2), "Fairford", "GA", "69481", 1, "") for i in range(60)], SCHEMA)
    assert same_building(df, "npi", "address", "city", "state", "zip").count() == 60 * 59 // 2
    assert rows(same_building(spark.createDataFrame([], SCHEMA), "npi", "address", "city", "state", "zip")) == []
