import hashlib

import pytest
from pyspark.sql import functions as F

from weir.functions import match, values
from weir.functions.match import AnyOf, Matcher, MatchKind, Rule, Text, Url, begins, contains, ends, exact, regex
from weir.sources.readers import rows

FEED = r"^ftps?://files\.[a-z]+/(pub|drop)/[^/]+\.csv$"


@pytest.mark.parametrize(
    "condition, yes, no",
    [
        (exact("abc"), ["abc"], ["abc1", "ABC"]),
        (begins("abc"), ["abc", "abc1"], ["1abc", "Abc"]),
        (ends("abc"), ["abc", "1abc"], ["abc1"]),
        (contains("abc"), ["abc", "abc1", "1abc"], ["abd", "ABC"]),
        (regex(".*ab[cd].*"), ["abc", "abc1", "1abc", "abd", "ABD"], ["abef"]),
        (regex("é"), ["É"], ["e"]),
        (Url(FEED, MatchKind.REGEX, exclude_param=True), ["ftp://files.home/pub/day.csv?from=7", "FTPS://files.home/drop/x.csv#row=3", "ftp://files.away/pub/y.csv"], ["ftp://files.home/pub/day.csvx", "ftp://files.home/lost/day.csv?from=7"]),
        (Url(FEED, MatchKind.REGEX), ["ftp://files.away/pub/y.csv"], ["ftp://files.home/pub/day.csv?from=7", "FTPS://files.home/drop/x.csv#row=3", "ftp://files.home/pub/day.csvx"]),
        (Url("HTTP://A", MatchKind.BEGINS), ["http://a/b", "HTTP://a"], ["xhttp://a"]),
        (Url("http://a", MatchKind.BEGINS, ignore_case=False), ["http://a/b"], ["HTTP://a"]),
        (Url("/X", MatchKind.ENDS, exclude_param=True), [" \t/a/x?q=/y\n", "/a/x#/z"], ["/a/y?/x"]),
        (Url("/a", exclude_param=True), ["/A?b"], ["/ab"]),
        (match.NOTHING, [], ["", "a"]),
        (AnyOf([contains("1"), contains("2")]), ["432", "1"], ["3"]),
        (contains("1") | ends("3"), ["1x", "x3"], ["3x"]),
        (AnyOf([]), [], ["a"]),
    ],
)
def test_conditions(spark, condition, yes, no):
    df = rows(spark, [(x,) for x in [*yes, *no, None]], "v string")
    assert [r[0] for r in df.select(condition.matches("v")).collect()] == [True] * len(yes) + [False] * (len(no) + 1)


def test_patterns_are_needed():
    for kind in (Text, Url):
        with pytest.raises(TypeError):
            kind(None)


def one(spark, value, column):
    return rows(spark, [(value,)], "v string").select(column.alias("x")).first().x


def test_exact_condition(spark):
    c = AnyOf([contains("1"), contains("2"), contains("3")])
    assert one(spark, "432", c.exact("v")) == 1 and one(spark, "123", c.exact("v")) == 0 and one(spark, "9", c.exact("v")) is None
    m = Matcher([Rule(k, x) for k, x in enumerate((Url("1", MatchKind.CONTAINS), Url("2", MatchKind.CONTAINS), AnyOf([Url("x"), Url("3", MatchKind.ENDS)])), 1)])
    assert one(spark, "9873", m.first("v")) == 3
    assert tuple(one(spark, "9873", m.first_exact("v"))) == (2, 1)
    assert one(spark, "zz", m.first_exact("v")) is None
    assert one(spark, "zz", m.first_or("v", -1)) == -1
    assert one(spark, "zz", m.first_or("v", F.length("v"))) == 2
    assert one(spark, "123", m.every("v")) == [1, 2, 3] and one(spark, None, m.every("v")) == []
    assert one(spark, "2", m.index("v")) == 1 and m[0].result == 1 and len(m) == 3
    assert Matcher([]).explode(rows(spark, [("a",)], "v string"), "v").count() == 0


def test_values(spark):
    df = rows(spark, [("k=1", None), ("é=2", "x")], "kv string, o string")
    got = df.select(values.key_of("kv"), values.int_value_of("kv"), values.or_default("o", "-"), values.md5_key("kv"), values.binary_key("kv")).collect()
    assert [tuple(r)[:3] for r in got] == [("k", 1, "-"), ("é", 2, "x")]
    assert got[0][3] == hashlib.md5(b"k=1").hexdigest()
    assert bytes(got[1][4]) == "é=2".encode()
    assert rows(spark, [("a|5",)], "kv string").select(values.int_value_of("kv", "|")).first()[0] == 5
    people = rows(spark, [("{Name: 'aaron', Age: 20}",), ("{Age: 80}",)], "line string").select(values.json_fields("line", "Name string, Age int").alias("p")).collect()
    assert [tuple(r.p) for r in people] == [("aaron", 20), (None, 80)]
    with pytest.raises(Exception, match="MALFORMED"):
        rows(spark, [("{nonsense",)], "line string").select(values.json_fields("line", "Name string")).collect()
    ids = spark.range(5).select(values.row_id().alias("u"), values.bytes_hash(values.binary_key("id")).alias("h")).collect()
    assert len({r.u for r in ids}) == 5 and len({r.h for r in ids}) == 5
