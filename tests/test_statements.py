"""The statement language, with strict bounds turned into inclusive ones."""

import pytest

from tidemark.functions.times import literal_ns
from tidemark.model import MAX_NS, MIN_NS
from tidemark.plans.statements import Delete, Insert, Select, decode, parse

SELECTS = {
    "select depth from harbour;": Select("harbour", "depth"),
    "select flow from pump_7 limit 6;": Select("pump_7", "flow", limit=6),
    "select flow from pump_7 where time > 40 and time < 90;": Select("pump_7", "flow", 41, 89),
    "select flow from pump_7 where time > 12;": Select("pump_7", "flow", lo=13),
    "select flow from pump_7 where time < 77;": Select("pump_7", "flow", hi=76),
    "  SELECT flow FROM limitless  ": Select("limitless", "flow"),
    "select v from k where time>5 and time>9 limit 0 ASC": Select("k", "v", lo=10, limit=0, ascending=True),
    "select v from k limit 3 desc": Select("k", "v", limit=3),
}


@pytest.mark.parametrize("text", SELECTS)
def test_select(text):
    assert parse(text) == SELECTS[text]


def test_defaults():
    s = parse("select v from k")
    assert (s.lo, s.hi, s.limit, s.ascending) == (MIN_NS + 2, MAX_NS - 1, 10, False)


@pytest.mark.parametrize("text", ["select from data;", "select a, b from k", "select * from k", "select v from k where value > 3", "update k", "", "select v from k limit x", "insert into k;", "insert into k a=", "delete k"])
def test_unreadable(text):
    with pytest.raises(ValueError):
        parse(text)


def test_insert():
    assert parse('insert into pump_7 note="abc", turns=31, time=86400;') == Insert("pump_7", {"note": "abc", "turns": 31}, {"note": "String", "turns": "Integer"}, 86400)
    assert parse("insert into pump_7 bar=2.25, on=false, time=-5;") == Insert("pump_7", {"bar": 2.25, "on": False}, {"bar": "Float", "on": "Boolean"}, -5)
    assert parse(r'insert into notes line="up\ndown", by="me", time=3;').fields == {"line": "up\ndown", "by": "me"}
    assert parse('insert into k a="x,y=z", b=5u').fields == {"a": "x,y=z", "b": 5}
    assert parse("insert into k a=1").ts_ns is None


def test_delete():
    assert parse("delete from pump_7 where time > 86400 and time < 90000;") == Delete("pump_7", 86401, 89999)
    assert parse("delete from notes where time > 333;") == Delete("notes", 334, MAX_NS)
    assert parse("delete from pump_7 where time < 4096;") == Delete("pump_7", MIN_NS, 4095)
    assert parse("delete from harbour;") == Delete("harbour", MIN_NS, MAX_NS)
    assert parse(f"delete from k where time > {MAX_NS}").lo == MAX_NS


@pytest.mark.parametrize(
    ("text", "kind"),
    [("18446744073709551615u", "Unsigned"), ("18446744073709551616u", "String"), ("9223372036854775808", "Float"), ("-5", "Integer"), ("1e3", "Float"), ("nan", "Float"), ("abc", "String"), ("u", "String"), ("TRUE", "String"), ('"5"', "String")],
)
def test_types(text, kind):
    assert decode(text)[1] == kind


def test_times():
    assert literal_ns("1970-01-01T00:00:00.000000001Z") == 1
    assert literal_ns("2024-01-05T00:00:00+05:30") == 1_704_412_800 * 10**9 - 19_800 * 10**9
    assert literal_ns("1969-12-31 23:59:59.5") == -500_000_000
    assert literal_ns("-7") == -7
    for wrong in ("", "2024-01-05", "2024-13-05T00:00:00Z", "x"):
        with pytest.raises(ValueError):
            literal_ns(wrong)
