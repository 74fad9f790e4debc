import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weir.errors import MappingError
from weir.operators import mapping as m
from weir.operators.mapping import Accessor, ColumnMapping, Entity, Option, TargetTable
from weir.sources.readers import json_lines, rows


def ddl(s):
    return StructType.fromDDL(s)


NESTED = "ProfileId INT NOT NULL, Value FLOAT, Key STRING, Stage1 STRUCT<StepNumber: INT, StepText: STRING, StepText2: STRING>, UID STRING NOT NULL, BadColumn STRING"
WIDE = "Id INT, Name STRING, Name2 STRING, Price FLOAT, StepText STRING, StepText2 STRING, StepNumber INT, Uid STRING, RawData BINARY"
MAPPINGS = {
    "Value": ColumnMapping("t", "Price", default=-2.0),
    "Key": [ColumnMapping("t", "Name", default="default"), ColumnMapping("t", "Name2", default="default")],
    "Stage1.StepNumber": ColumnMapping("t", offset=6, default=2),
    "Stage1.StepText": ColumnMapping("t", "StepText", 4, default="StepText"),
    "Stage1.StepText2": ColumnMapping("t", default="StepText2"),
    "UID": ColumnMapping("t", "uid"),
    "BadColumn": ColumnMapping("t", "Nowhere", option=Option.OPTIONAL),
}


def test_defaults_optional_and_offsets(spark):
    df = rows(spark, [(1, 0.5, "a", None, "u1", "x"), (2, None, "b", (5, "bleg", None), "u2", None), (3, 0.7, None, None, "u3", None)], NESTED)
    a = Accessor(df.schema, ddl(WIDE), "t", Entity(MAPPINGS))
    got = {r.Uid: r for r in a.apply(df).collect()}
    assert a.field_count == 7 and a.apply(df).columns == ["Name", "Name2", "Price", "StepText", "StepText2", "StepNumber", "Uid"]
    assert tuple(got["u2"])[:2] == ("b", "b") and got["u2"].StepNumber == 5 and got["u2"].StepText == "bleg" and got["u2"].Price == -2
    assert got["u3"].Name == "default" and round(got["u3"].Price, 4) == 0.7 and got["u3"].StepNumber == 2 and got["u3"].StepText == "StepText"
    assert a.name_of(0) == "Id" and a.offset_of("PRICE") == 3 and a.offset_of("none") == -1
    assert a.mapping_of(4).name == "StepText" and a.mapping_of(0) is None


@pytest.fixture
def registry():
    m.clear_registered()
    yield m.register
    m.clear_registered()


PEOPLE = "Id INT, NameCol STRING, AgeCol INT"
OWN = Entity({"Name": ColumnMapping("p", "NameCol", default="N/A", option=Option.OPTIONAL), "Age": ColumnMapping("p", "AgeCol", default=-1, option=Option.OPTIONAL)})


def people(spark):
    lines = rows(spark, [("{Name: 'aaron', Age: 20}",), ("{Name: 'bob', Age: 30}",), ("{Age: 80}",), ("{Name: 'neo' }",)], "line string")
    return json_lines(lines, "Name string, Age int")


def mapped(spark, label, entity=OWN):
    df = people(spark)
    return [tuple(r) for r in Accessor(df.schema, ddl(PEOPLE), label, entity, "Person").apply(df).collect()]


def test_registered_for_another_label(spark, registry):
    registry("Person", "Name", ColumnMapping("q", "NameCol", default="N/A2"))
    registry("Person", "Age", ColumnMapping("q", "AgeCol", default=-2))
    got = mapped(spark, "q")
    assert len(got) == 4 and [r[0] for r in got].count("N/A2") == 1 and [r[1] for r in got].count(-2) == 1


def test_declared_wins_unless_weaker_or_overwritten(spark, registry):
    own = Entity({"Name": ColumnMapping("p", "NameCol", default="N/A"), "Age": ColumnMapping("p", "AgeCol", default=-1, option=Option.OPTIONAL)})
    registry("Person", "Name", ColumnMapping("p", "NameCol", default="N/A2"))
    registry("Person", "Age", ColumnMapping("p", "AgeCol", default=-2))
    got = mapped(spark, "p", own)
    assert [r[0] for r in got].count("N/A") == 1 and [r[1] for r in got].count(-2) == 1 and [r[1] for r in got].count(-1) == 0
    registry("Person", "Name", ColumnMapping("p", "NameCol", default="N/A3", option=Option.OVERWRITE))
    assert [r[0] for r in mapped(spark, "p", own)].count("N/A3") == 1


def test_path_options(spark):
    df = rows(spark, [("Aaron", 10, ("Bob", 20)), ("Neo", 1, None)], "Name STRING, Age INT, Me STRUCT<Name: STRING, Age: INT>")
    target = ddl("Name STRING, Age INT")
    assert Accessor(df.schema, target, "t", Entity(no_expand=frozenset(["Me"]))).apply(df).first() == ("Aaron", 10)
    deep = Entity({"Name": ColumnMapping("t"), "Age": ColumnMapping("t"), "Me.Name": ColumnMapping("t", option=Option.OVERWRITE), "Me.Age": ColumnMapping("t", option=Option.OVERWRITE)})
    assert Accessor(df.schema, target, "t", deep).apply(df).first() == ("Bob", 20)
    strict = Accessor(df.schema, target, "t", Entity(no_null_check=frozenset(["Me"])))
    with pytest.raises(Exception, match="Me is null"):
        strict.apply(df).count()


def test_labels_and_zero_values(spark):
    source = ddl("Id INT NOT NULL, PersonName STRING, Location STRUCT<RoadNumber: INT, RoadName: STRING>, Address STRUCT<AddressNumber: INT NOT NULL>, Tags ARRAY<STRING>")
    df = spark.createDataFrame([(1, "a", None, None, []), (2, "b", (3, "road"), (10,), ["x"])], source)
    entity = Entity({
        "Id": [ColumnMapping("w", "WdId"), ColumnMapping("c", "CdId")], "PersonName": [ColumnMapping("w", "Name"), ColumnMapping("c", "Name")],
        "Location.RoadNumber": ColumnMapping("c", "RoadNum", default=-1), "Location.RoadName": ColumnMapping("c"), "Address.AddressNumber": ColumnMapping("c"),
    })
    c = Accessor(source, ddl("CdId INT, Name STRING, RoadNum INT, RoadName STRING, AddressNumber INT"), "c", entity)
    assert [tuple(r) for r in c.apply(df).collect()] == [(1, "a", -1, None, 0), (2, "b", 3, "road", 10)]
    assert Accessor(source, ddl("WdId INT, Name STRING, Other INT"), "w", entity).apply(df).columns == ["WdId", "Name"]
    assert ("Tags",) not in [p for p, _ in m.paths_of(source)]


def test_automatic_mapping(spark):
    df = rows(spark, [(1, "top", ("deep", "x"))], "ID INT, NAME STRING, Sub STRUCT<Name: STRING, Extra: STRING>")
    target = ddl("id INT, name STRING, extra STRING")
    assert Accessor(df.schema, target, "t").apply(df).first() == (1, "top", "x")
    assert Accessor(df.schema, target, "t", read_only=["ID"]).apply(df).columns == ["name", "extra"]
    with pytest.raises(MappingError):
        Accessor(df.schema, ddl("zzz INT"), "t")


@pytest.mark.parametrize(
    "mapping",
    [
        {"i": ColumnMapping("t", default=1)},
        {"n": ColumnMapping("t", default="text")},
        {"s": ColumnMapping("t", default=5)},
        {"n": ColumnMapping("t", "nowhere")},
        {"n": ColumnMapping("t", offset=9)},
        {"n": ColumnMapping("t", "s", 0, option=Option.OPTIONAL)},
    ],
)
def test_mappings_that_do_not_fit(spark, mapping):
    with pytest.raises(MappingError):
        Accessor(ddl("i INT NOT NULL, n INT, s STRING"), ddl("i INT, n INT, s STRING"), "t", Entity(mapping))


def test_identity_and_memo(spark):
    assert TargetTable("a", "u", "t") == TargetTable("a", "u", "t") != TargetTable("b", "u", "t")
    s, t = ddl("a INT"), ddl("A INT")
    assert m.accessor_for(s, TargetTable("x"), t) is m.accessor_for(s, TargetTable("x"), t)
    assert m.accessor_for(s, TargetTable("y"), t) is not m.accessor_for(s, TargetTable("x"), t)
    assert m.flat_names(ddl("Id INT, A INT, B INT"), skip=["id"]) == "A, B"


def test_nested_default_counts(spark):
    df = rows(spark, [(1, None, None), (2, None, (None,)), (3, None, ("a",)), (4, "a", ("a",))], "Id INT, Value1 STRING, B STRUCT<Value2: STRING>")
    entity = Entity({"Value1": ColumnMapping("t", default="-"), "B.Value2": ColumnMapping("t", default="--")})
    out = Accessor(df.schema, ddl("Value1 STRING, Value2 STRING"), "t", entity).apply(df)
    assert sorted(out.groupBy("Value1").count().collect()) == [("-", 3), ("a", 1)] and sorted(out.groupBy("Value2").count().collect()) == [("--", 2), ("a", 2)]
    assert out.agg(F.count("*")).first()[0] == 4


def test_zero_values_and_defaults_of_other_types(spark):
    from datetime import date, datetime
    from decimal import Decimal

    source = ddl("a STRUCT<d: DECIMAL(9,2) NOT NULL, day: DATE NOT NULL, at: TIMESTAMP NOT NULL>")
    a = Accessor(source, ddl("d DECIMAL(9,2), day DATE, at TIMESTAMP"), "t", Entity({f"a.{k}": ColumnMapping("t") for k in ("d", "day", "at")}))
    df = spark.createDataFrame([(None,)], ddl("a STRUCT<d: DECIMAL(9,2), day: DATE, at: TIMESTAMP>"))
    assert a.apply(df).selectExpr("CAST(d AS STRING) d", "CAST(day AS STRING) day", "year(at) y").first() == ("0.00", "0001-01-01", 1)
    fields = ddl("d DECIMAL(9,2), day DATE, at TIMESTAMP")
    for path, good, bad in (("d", Decimal("1.5"), 1.5), ("day", date(2020, 1, 2), datetime(2020, 1, 2)), ("at", datetime(2020, 1, 2), "2020-01-02")):
        Accessor(fields, fields, "t", Entity({path: ColumnMapping("t", default=good)}))
        with pytest.raises(MappingError, match="default of type"):
            Accessor(fields, fields, "t", Entity({path: ColumnMapping("t", default=bad)}))


def test_name_at_an_offset_is_compared_with_case():
    schema = ddl("Id INT, Name STRING")
    assert Accessor(schema, schema, "t", Entity({"Name": ColumnMapping("t", "Name", 1)})).field_count == 1
    with pytest.raises(MappingError):
        Accessor(schema, schema, "t", Entity({"Name": ColumnMapping("t", "NAME", 1)}))


def test_a_loop_of_references_is_left_out(caplog):
    from pyspark.sql.types import StructField

    inner = StructField("boss", ddl("name STRING"), metadata={"entity": "person"})
    person = StructField("person", StructType([*ddl("name STRING").fields, inner]), metadata={"entity": "person"})
    other = StructField("other", StructType([*ddl("name STRING").fields, StructField("team", ddl("title STRING"), metadata={"entity": "team"})]), metadata={"entity": "person"})
    with caplog.at_level("WARNING"):
        found = [".".join(p) for p, _ in m.paths_of(StructType([person, other]))]
    assert found == ["person.name", "other.name", "other.team.title"] and "person.boss" in caplog.text
