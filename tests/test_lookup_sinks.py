import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.errors import MappingError, RejectedRowError
from weir.operators import batching
from weir.operators.iterate import closure, fixpoint
from weir.operators.lookup import Lookup, Strategy, hit_counts, newest
from weir.operators.mapping import Accessor, ColumnMapping, Entity, TargetTable
from weir.operators.recorder import Recorder
from weir.sources.readers import identity_column, jdbc, post, rows, tagged
from weir.sources.sinks import BulkSink, ErrorSink, KeyedTextSink, MultiSink, NullSink, RowSink, cursor, retrying
from weir.sources.storage import connected


def dim(spark):
    return rows(spark, [(k + 1, str(k), f"s{k}") for k in range(10)], "id bigint, key string, text string")


def test_lookup_inserts(spark):
    facts = rows(spark, [(k,) for k in ["3", "5", "7", "7", "9"] + ["99"] * 14 + ["98"]], "pointer string")
    out = Lookup("pointer", "key", "id", {"text": F.concat(F.lit("new "), F.col("pointer"))}).run(facts, dim(spark))
    assert out.joined.count() == 20 and out.dimension.count() == 12 and out.discarded.count() == 0
    assert sorted(tuple(r[c] for c in ("id", "key", "text")) for r in out.new_rows.collect()) == [(11, "98", "new 98"), (12, "99", "new 99")]
    assert out.joined.filter("pointer = '7'").first().id == 8


def test_lookup_strategies(spark):
    facts = rows(spark, [("3",), ("99",)], "pointer string")
    local = Lookup("pointer", "key", "id", strategy=Strategy.LOCAL).run(facts, dim(spark), on_found=lambda d: d.withColumn("seen", F.lit(True)))
    assert [(r.pointer, r.id, r.seen) for r in local.joined.collect()] == [("3", 4, True)] and [r.pointer for r in local.discarded.collect()] == ["99"]
    none = Lookup("pointer", "key", "id", strategy=Strategy.NO_LOOKUP).run(facts, dim(spark))
    assert none.joined.count() == 2 and none.joined.columns == ["pointer"]
    assert sorted(map(tuple, hit_counts(facts, dim(spark), "pointer", "key").collect())) == [("discarded", 1), ("hit", 1)]
    assert sorted(map(tuple, hit_counts(facts.limit(0), dim(spark), "pointer", "key").collect())) == [("discarded", 0), ("hit", 0)]
    assert [r.id for r in newest(dim(spark), "id", 3).collect()] == [10, 9, 8]


def test_lookup_binary_and_nested_keys(spark):
    facts = rows(spark, [((bytearray(b"3"), "x"),), ((bytearray(b"zz"), "y"),), ((bytearray(b"zz"), "a"),)], "product struct<k: binary, name: string>")
    d = rows(spark, [(1, bytearray(b"3"), "n")], "id bigint, k binary, name string")
    out = Lookup("product.k", "k", "id", {"name": "product.name"}).run(facts, d)
    assert out.joined.count() == 3 and [tuple(r)[1:] for r in out.new_rows.select("id", "id", "name").collect()] == [(2, "a")]
    ordered = Lookup("k", "dk", "sk", {"v": "v"}, order="o").run(rows(spark, [("a", 2, "late"), ("a", 1, "early")], "k string, o int, v string"), spark.createDataFrame([], "sk bigint, dk string, v string"))
    assert [(r.sk, r.v) for r in ordered.new_rows.collect()] == [(1, "early")]


def test_lookup_refuses(spark):
    with pytest.raises(ValueError):
        Lookup("upper(key)", "key", "id")
    with pytest.raises(Exception, match="lookup key is null"):
        Lookup("p", "key", "id").run(rows(spark, [("3",), (None,)], "p string"), dim(spark)).joined.collect()
    with pytest.raises(ValueError, match="several rows"):
        Lookup("p", "key", "id").run(rows(spark, [("3",)], "p string"), dim(spark).unionByName(dim(spark)))


def test_batches(spark):
    df = spark.range(10, 0, -1).withColumn("x", F.col("id") * 2)
    got = sorted(map(tuple, batching.batched(df, "id", 4).select("id", "batch_id").collect()))
    assert got == [(i, (i - 1) // 4) for i in range(1, 11)]
    ties = rows(spark, [(None,), (1,), (1,), (2,)], "v int")
    assert sorted(r.n for r in batching.numbered(ties, "v").collect()) == [0, 1, 2, 3]
    assert batching.batched(ties.limit(0), "v", 2).count() == 0
    with pytest.raises(ValueError):
        batching.batched(df, "id", 0)


def test_fixpoint(spark):
    out = fixpoint(rows(spark, [(10,)], "v int"), lambda d: d.select((F.col("v") - 1).alias("v")).filter("v >= 0"))
    assert out.rounds == 11 and sorted(map(tuple, out.rows.collect())) == sorted((10 - k, k) for k in range(11))
    with pytest.raises(Exception, match="after 3 rounds"):
        fixpoint(rows(spark, [(1,)], "v int"), lambda d: d, max_iterations=3)
    paths = closure(rows(spark, [(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int"))
    assert paths.count() == 10


def test_eager_and_whole_files(spark, tmp_path):
    df = spark.range(100)
    seen = []
    eager = BulkSink(TargetTable("t", str(tmp_path), "eager"), eager=True, post_write=lambda t, d: seen.append((t.name, d.count())))
    eager(df)
    eager(df)
    assert {n for n, _ in seen} == {"eager"} and sum(k for _, k in seen) == 200 and eager.read(spark).count() == 200
    empty = BulkSink(TargetTable("t", str(tmp_path), "none"), eager=True)
    empty(df.limit(0))
    assert empty.read(spark).count() == 0

    def fail(*_):
        raise RejectedRowError("induced")

    whole = TargetTable("t", str(tmp_path), "whole")
    with pytest.raises(RejectedRowError):
        BulkSink(whole, post_write=fail)(df)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        BulkSink(whole)(df.select((F.lit(1) / (F.col("id") - 99)).alias("q")))
    assert not [p for p in (tmp_path / "whole").rglob("*.parquet")]
    BulkSink(whole)(df)
    BulkSink(whole)(df)
    assert BulkSink(whole).read(spark).count() == 200 and not list((tmp_path / "whole").glob("_staging*"))


def test_eager_batches_survive(spark, tmp_path):
    """Of 40 rows in batches of 10 the third holds a bad row: two are there, by the write or by the hook."""
    df = spark.range(0, 40, 1, 1)
    entity = Entity({"id": ColumnMapping("t")})
    bad = df.select(F.when(F.col("id") != 25, F.struct("id")).alias("a"))
    strict = Accessor(bad.schema, T.StructType.fromDDL("id bigint"), "t", Entity({"a.id": ColumnMapping("t")}, no_null_check=frozenset(["a"])))
    seen = []
    sink = BulkSink(TargetTable("t", str(tmp_path), "mapped"), strict, eager=True, batch=10, post_write=lambda t, d: seen.append(d.agg(F.min("id"), F.count("*")).first()))
    with pytest.raises(Exception, match="a is null"):
        sink(bad)
    assert sorted(r.id for r in sink.read(spark).collect()) == list(range(20)) and [tuple(r) for r in seen] == [(0, 10), (10, 10)]

    def fail_at_third(_target, rows, calls=[]):  # noqa: B006
        calls.append(rows.count())
        if len(calls) == 3:
            raise RejectedRowError("induced")

    hooked = BulkSink(TargetTable("t", str(tmp_path), "hooked"), Accessor(df.schema, df.schema, "t", entity), eager=True, batch=10, post_write=fail_at_third)
    with pytest.raises(RejectedRowError):
        hooked(df)
    assert hooked.read(spark).count() == 30  # the hook runs once its batch is in
    assert not list((tmp_path / "hooked").glob("_staging*"))


def test_database_with_a_user(spark, tmp_path):
    """The database puts a user's tables into a schema of the user's name, so a connection without the user finds none."""
    url, options = f"jdbc:derby:{tmp_path}/users;create=true", {"user": "weir", "password": "secret"}
    with connected(spark, url, options) as con:
        con.createStatement().executeUpdate("CREATE TABLE T (ID INTEGER, N INTEGER GENERATED ALWAYS AS IDENTITY)")
    assert identity_column(spark, url, "T", options) == "N" and identity_column(spark, url, "NONE", options) is None
    df = spark.range(50).select(F.col("id").cast("int").alias("Id"))
    BulkSink(TargetTable("t", url, "T"), options=options)(df)
    BulkSink(TargetTable("t", url, "T"), eager=True, batch=10, options=options)(df.withColumnRenamed("Id", "ID"))
    assert jdbc(spark, url, "T", options=options).count() == 100
    with pytest.raises(MappingError):
        BulkSink(TargetTable("t", url, "T"), options=options)(df.withColumnRenamed("Id", "other"))
    with pytest.raises(Exception, match="(?i)does not exist"):
        BulkSink(TargetTable("t", url, "T"))(df)


def test_retries_and_cursor(spark):
    tries = []

    def flaky(df):
        tries.append(df.count())
        if len(tries) < 3:
            raise OSError("refused")
        return "in"

    assert retrying(flaky, seconds=0.01)(spark.range(3)) == "in" and tries == [3, 3, 3]
    with pytest.raises(ZeroDivisionError):
        retrying(lambda df: 1 / 0, times=1, seconds=0)(spark.range(1))
    assert list(cursor(spark.range(0, 5, 1, 2))) == [(k,) for k in range(5)]


def test_databases(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.range(50).select(F.col("id").cast("int").alias("ID"))
    con = spark._jvm.java.sql.DriverManager.getConnection(url)
    con.createStatement().executeUpdate("CREATE TABLE T (ID INTEGER, N INTEGER GENERATED ALWAYS AS IDENTITY)")
    con.close()
    sink = BulkSink(TargetTable("t", url, "T"))
    sink(df)

    def fail(*_):
        raise RejectedRowError("induced")

    with pytest.raises(RejectedRowError):
        BulkSink(TargetTable("t", url, "T"), post_write=fail)(df)
    assert jdbc(spark, url, "T").count() == 50
    BulkSink(TargetTable("t", url, "E"), eager=True, batch=10)(df)
    assert jdbc(spark, url, "E", partition=("ID", 0, 50, 3)).count() == 50


def test_other_sinks(spark, tmp_path):
    df = rows(spark, [("Error", "a"), ("Error", "b"), ("Warn", "c")], "level string, message string")
    made = {}
    MultiSink("level", lambda k: made.setdefault(k, BulkSink(TargetTable("t", str(tmp_path), k), eager=True)))(df)
    assert {k: s.read(spark).count() for k, s in made.items()} == {"Error": 2, "Warn": 1}
    r = Recorder()
    NullSink(r, "level")(df)
    NullSink(r)(df)
    assert (r.entity("Error"), r.entity("garbage")) == (2, 3)
    ErrorSink()(df.limit(0))
    with pytest.raises(Exception, match="a row was left"):
        ErrorSink()(df)
    total = spark.sparkContext.accumulator(0)
    RowSink(lambda part: [total.add(1) for _ in part])(df)
    assert total.value == 3
    KeyedTextSink(str(tmp_path / "text"), "level", F.concat(F.lit("["), "level", F.lit("] "), "message"))(df)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).filter("level = 'Error'").collect()) == ["[Error] a", "[Error] b"]


def test_sources(spark):
    assert post(spark, (1,), "v int").count() == 1
    both = tagged(a=rows(spark, [(1,)], "v int"), b=rows(spark, [("x",)], "s string"))
    assert sorted((r.src, r.v, r.s) for r in both.collect()) == [("a", 1, None), ("b", None, "x")]


def test_a_null_in_the_dimension_is_no_fault(spark):
    d = rows(spark, [(1, "3"), (2, None)], "id bigint, key string")
    out = Lookup("p", "key", "id").run(rows(spark, [("3",), ("4",)], "p string"), d)
    assert sorted((r.p, r.id) for r in out.joined.collect()) == [("3", 1), ("4", 3)]
    local = Lookup("p", "key", "id", strategy=Strategy.LOCAL)
    assert local.run(rows(spark, [("3",)], "p string"), d).joined.count() == 1
    for act in (lambda r: r.joined.count(), lambda r: r.discarded.count()):
        with pytest.raises(Exception, match="lookup key is null"):
            act(local.run(rows(spark, [("3",), (None,)], "p string"), d))
