from pyspark.sql import functions as F

from weir.operators import recorder as rec
from weir.operators.recorder import Event, Recorder
from weir.sources.readers import LogReader, lines, rows


def fixture(spark):
    items = [("string", None, None)] * 3 + [("int", None, None)] * 4 + [("holder", "ev1", None)] * 3
    return rows(spark, items, "entity string, level1 string, level2 string")


def test_counts(spark):
    r = Recorder("r").record(fixture(spark), "entity", "level1", "level2")
    r.record_event("ev1", n=5)
    r.record_event("ev2", "1")
    r.record_event("ev2", "2")
    r.record_event(Event("ev3", "1"), n=3)
    assert (r.entity("string"), r.entity("int"), r.entity("holder"), r.total) == (3, 4, 3, 10)
    assert (r["ev1"], r["ev2"], r[Event("ev3", "1")], r["ev3"], r[Event("ev3", "2")], r["none"]) == (8, 2, 3, 3, 0, 0)
    assert str(Event("a", "b")) == "a-b" and str(Event("a")) == "a"
    assert "ev3-1(3)" in r.dump() and r.dump().startswith("[r] entities: holder(3), int(4), string(3)")
    kept = r.snapshot()
    r.clear()
    assert r.total == 0 and kept[0]["int"] == 4


def test_bare_event_hides_its_second_levels():
    r = Recorder()
    r.record_event("ev", n=5)
    r.record_event("ev", "x", 3)
    r.record_event(None, None, 7)
    assert r["ev"] == 5 and r.rollup("ev") == 8 and r.snapshot()[1] == {Event("ev"): 5, Event("ev", "x"): 3}


def test_lookup_over_dataframes(spark):
    df = rows(spark, [("ev", None)] * 5 + [("ev", "x")] * 3 + [("o", "x"), ("o", "y"), (None, None), (None, "z")], "level1 string, level2 string")
    counts = rec.count_events(df, "level1", "level2")
    assert {tuple(r) for r in rec.event_lookup(counts).collect()} == {("ev", 5), ("o", 2)}
    assert {tuple(r) for r in rec.event_rollup(counts).collect()} == {("ev", 8), ("o", 2)}
    assert counts.filter("level1 IS NULL").count() == 1
    assert rec.total(counts).first()[0] == 11
    assert rec.with_total(counts).filter("level1 = 'TOTAL'").first().n == 11
    assert [r.t for r in df.select(rec.event_text(F.col("level1"), F.col("level2")).alias("t")).distinct().orderBy("t").collect()] == ["", "ev", "ev-x", "o-x", "o-y", "z"]


def test_entities_with_supertypes():
    r = Recorder(parents={"cat": ["animal"], "lion": ["cat"], "ValueError": ["Exception"]}, exceptions=["ValueError"])
    for e, n in (("cat", 2), ("lion", 3), ("ValueError", 1)):
        r.record_entity(e, n)
    assert r.entity("animal") == 5 and r.entity("cat") == 2 and r.exception_count == 1
    assert "ValueError" not in r.dump().split("\n")[0]


def test_people(spark):
    people = rows(spark, [("aaron", 20), ("bob", 30), ("carmen", 80), ("neo", -1)], "name string, age int")
    r = Recorder().record(people, F.lit("Person"), F.when(F.col("age") > 70, "OldPerson"))
    garbage = Recorder().record(people.filter("age <= 0"), F.lit("Person"))
    assert (r.entity("Person"), r["OldPerson"], garbage.entity("Person")) == (4, 1, 1)


def test_first_by_key(spark):
    df = rows(spark, [("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert sorted(tuple(r) for r in rec.first_by_key(df, "k", "o").collect()) == [("a", 1, "y"), ("b", 3, "z")]
    assert rec.first_by_key(df, "k").count() == 2


def test_log_reader(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.log").write_text("a\na b\na b c\na b c d\n")
    r = Recorder()
    reader = LogReader(lambda d: d.select(F.explode(F.split("line", " ")).alias("level1")), r)
    assert reader.process_files(spark, [str(tmp_path / "0.log"), str(tmp_path / "1.log")]) == 8
    assert [r[x] for x in "abcd"] == [8, 6, 4, 2]
    (tmp_path / "bad.log").write_text("a\nERROR\nb\n")
    bad = LogReader(lambda d: d.select(F.when(F.col("line") == "ERROR", F.raise_error(F.lit("bad line"))).otherwise(F.col("line")).alias("level1")), Recorder())
    import pytest

    with pytest.raises(Exception, match="bad line"):
        bad.process(lines(spark, str(tmp_path / "bad.log")))
