import pytest
from pyspark.sql import functions as F

from weir.errors import RoutingError
from weir.functions import values
from weir.operators.fan import Broadcaster, Dispatcher, link_to_all, union
from weir.operators.recorder import count_entities
from weir.operators.router import Router
from weir.operators.stage import Stage, as_stage, consume, filtered, flat_map, from_batches, map_columns, merge
from weir.sources.readers import rows


def ints(spark, n):
    return spark.range(n).select(F.col("id").cast("int").alias("v"))


def test_mod_three(spark):
    r = Router(ints(spark, 10000)).link("v % 3 = 1", name="a").link("v % 3 = 2", name="b").left_to_null()
    assert (r.branch("a").count(), r.branch("b").count(), r.garbage().count()) == (3333, 3333, 3334)
    t = Router(ints(spark, 10000)).transform_link(map_columns(v="v % 3"), "v % 3 = 1", name="a").transform_link(map_columns(v="v % 3"), "v % 3 = 2", name="b").left_to_null()
    assert [[x.v for x in t.branch(k).distinct().collect()] for k in "ab"] == [[1], [2]]


def test_left_to(spark):
    r = Router(ints(spark, 10)).link("v % 3 = 0", name="a").link("v % 3 = 1", name="b").left_to("rest")
    assert {k: sorted(x.v for x in df.collect()) for k, df in r.branches().items()} == {"a": [0, 3, 6, 9], "b": [1, 4, 7], "rest": [2, 5, 8]}


def mixed(spark):
    return rows(spark, [("int", None, i) for i in range(50)] + [("string", str(i), None) for i in range(50)] + [("other", None, None)], "kind string, s string, i int")


def test_subtypes(spark):
    r = Router(mixed(spark)).subtype_link("string").subtype_link("int", map_columns(i="i + 1")).left_to_null()
    assert r.branch("string").count() == 50 and r.branch("int").agg(F.max("i")).first()[0] == 50
    assert [tuple(x) for x in count_entities(r.garbage(), "kind").collect()] == [("other", 1)]


def test_left_to_error_fails_every_action(spark):
    r = Router(mixed(spark)).subtype_link("string").subtype_link("int").left_to_error()
    for act in (lambda: r.branch("int").count(), lambda: r.branch("string").collect(), lambda: r.routed().select(F.lit(1)).count()):
        with pytest.raises(Exception, match="a row was left"):
            act()
    ok = Router(mixed(spark).filter("kind <> 'other'")).subtype_link("string").subtype_link("int").left_to_error()
    assert ok.branch("int").count() == 50


def test_null_predicates_are_false_and_first_match_wins(spark):
    df = rows(spark, [(None,), (1,), (5,), (9,)], "v int")
    r = Router(df).link("v > 4", name="big").link("v > 0", name="some").left_to()
    assert {x.v: x.route for x in r.routed().collect()} == {None: "left", 1: "some", 5: "big", 9: "big"}
    assert [x.v for x in r.branch("left").collect()] == [None]


def test_unconditional_link_leaves_nothing(spark):
    assert Router(ints(spark, 3)).link(name="all").left_to("rest").branch("rest").count() == 0


def test_frozen_and_open_tables(spark):
    r = Router(ints(spark, 3)).link("v = 1", name="one")
    with pytest.raises(RoutingError):
        r.branch("one")
    r.left_to_null()
    for verb in (lambda: r.link("v = 2"), lambda: r.transform_link(lambda d: d, "v = 2"), lambda: r.subtype_link("x"), lambda: r.left_to_error()):
        with pytest.raises(RoutingError):
            verb()
    with pytest.raises(RoutingError):
        r.branch("nobody")
    with pytest.raises(RoutingError):
        Router(ints(spark, 3)).link("v = 1", name="x").link("v = 2", name="x")


def test_broadcast(spark):
    df = ints(spark, 1000)
    sums = link_to_all(df, *(lambda d: d.agg(F.sum("v")).first()[0] for _ in range(3)), copy=lambda d: d.select("v"))
    assert sums == [499500] * 3
    with pytest.raises(ValueError):
        Broadcaster(df).link(lambda d: d, "v = 1")


def test_dispatch(spark, tmp_path):
    df = rows(spark, [("Error", "a"), ("error", "b"), ("Warn", "c"), (None, "d"), ("Info", "e")], "level string, message string")
    made = []
    out = Dispatcher(df, "level", F.lower).run(lambda k: made.append(k) or (lambda d: d.count()))
    assert out == {None: 1, "error": 2, "info": 1, "warn": 1} and sorted(map(str, made)) == sorted(map(str, out))
    Dispatcher(df, "level", F.lower).by_path(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("child").count().count() == 4
    one = Dispatcher(df, "level").by_group(lambda pdf: pdf[["message"]].head(1), "message string")
    assert one.count() == 5


def test_union_keeps_bags_and_names(spark):
    a, b = rows(spark, [(1, "x")], "i int, s string"), rows(spark, [("x", 1)], "s string, i int")
    assert [tuple(r) for r in union(a, b).collect()] == [(1, "x")] * 2
    with pytest.raises(ValueError):
        union()


def test_stages(spark):
    lines = rows(spark, [("a=1 b=2 a=5",), ("c=6 b=8",)], "line string")
    parse = merge(flat_map(F.split("line", " "), "kv"), map_columns(k=values.key_of("kv"), v=values.int_value_of("kv")))
    assert {r.k: r["sum(v)"] for r in parse(lines).groupBy("k").agg(F.sum("v")).collect()} == {"a": 6, "b": 10, "c": 6}
    bad = rows(spark, [("a=1",), ("a=badstring",)], "line string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        parse(bad).agg(F.sum("v")).collect()
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        parse(rows(spark, [("novalue",)], "line string")).agg(F.sum("v")).collect()
    assert parse.name == "flat_map > map" and as_stage(parse) is parse
    doubled = from_batches(lambda pdf: pdf.assign(v=pdf.v * 2), "v int", "double")
    assert [r.v for r in Stage("one", filtered("v = 1")).then(doubled)(ints(spark, 3)).collect()] == [2]
    assert flat_map(F.array().cast("array<int>"))(ints(spark, 3)).count() == 0
    assert consume(lambda d: None, "sink").__name__ == "sink"
    with pytest.raises(ValueError):
        merge()


def test_filters_reach_the_scan(spark, capsys):
    from tests.conftest import SF
    from weir.plans import catalogue

    for name, pushed in (("link_predicate", "GreaterThan(o_totalprice"), ("match_exact", "EqualTo(event_type,click"), ("match_begins_with", "StringStartsWith(p_name,small"), ("link_subtype", "EqualTo(event_type,purchase")):
        capsys.readouterr()
        catalogue.queries()[name](spark, SF).explain("formatted")
        text = capsys.readouterr().out
        line = next(x for x in text.split("\n") if x.startswith("PushedFilters"))
        assert pushed in line, (name, line)


def test_garbage_is_counted_by_its_recorder(spark):
    df = rows(spark, [("a", 1), ("b", 2), ("b", 3)], "kind string, v int")
    r = Router(df).link("v > 2", name="big").left_to_null(lambda g: count_entities(g, "kind"))
    assert sorted(map(tuple, r.garbage_counts().collect())) == [("a", 1), ("b", 1)]
    plain = Router(df).link("v > 1", name="big").left_to_null()
    assert [tuple(x) for x in plain.garbage_counts().collect()] == [("a", 1)]
    assert Router(df.drop("kind")).link("v > 9", name="big").left_to_null().garbage_counts().first().n == 3


def test_children_are_bounded(spark, monkeypatch):
    from weir.operators import fan, recorder

    monkeypatch.setattr(fan, "MAX_CHILDREN", 3)
    monkeypatch.setattr(recorder, "MAX_KINDS", 3)
    assert len(Dispatcher(spark.range(3), "id").keys()) == 3
    with pytest.raises(ValueError, match="more than 3 keys"):
        Dispatcher(spark.range(4), "id").keys()
    with pytest.raises(ValueError, match="more than 3 kinds"):
        recorder.Recorder().record(spark.range(4), F.col("id").cast("string"))
