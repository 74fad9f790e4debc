"""More registered queries: sources, sinks, counters, mapping rules, life cycle and streams, each with its SQL.

Where an operator's result is a decision (a link that is refused, a child that does not run), the query returns the
decision beside counts of a table, and the SQL says what it must be.
"""

from __future__ import annotations

import logging
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weir import errors
from weir.functions import match
from weir.operators import mapping, recorder
from weir.operators.fan import Dispatcher, link_to_all
from weir.operators.iterate import closure
from weir.operators.lookup import Lookup, Strategy, hit_counts, newest
from weir.operators.mapping import Accessor, ColumnMapping, Entity, TargetTable
from weir.operators.recorder import Event, Recorder
from weir.operators.router import Router
from weir.operators.stage import as_stage, consume, filtered, from_batches, map_columns, merge
from weir.plans.catalogue import query
from weir.plans.flow import Flow, Options, process
from weir.plans.monitor import Monitor
from weir.sources import readers
from weir.sources.readers import table
from weir.sources.sinks import BulkSink, KeyedTextSink, NullSink, RowSink, cursor, retrying
from weir.sources.storage import staging_path
from weir.streaming import streams


def outcome(action, *expected: type[BaseException]) -> str:
    """'passed', or the name of the expected error that stopped an action. Others are raised."""
    try:
        action()
    except expected as e:
        return type(e).__name__
    return "passed"


def told(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "what string, outcome string")


def spark_fails_with(action, message: str) -> str:
    """'refused' if Spark stops an action with a message, 'passed' if it doesn't. Other failures are raised."""
    try:
        action()
    except Exception as e:
        if message not in str(e):
            raise
        return "refused"
    return "passed"


# ---- sources


@query("SELECT k, n FROM (VALUES (cast(1 AS bigint), 'one'), (2, 'two'), (3, 'three')) AS t(k, n) UNION ALL SELECT n_nationkey AS k, n_name AS n FROM nation")
def post_and_send(spark, sf_dir):
    """A single post, rows sent one after the other, and a table, as one source."""
    schema = "k bigint, n string"
    one, more = readers.post(spark, (1, "one"), schema), readers.rows(spark, [(2, "two"), (3, "three")], schema)
    return readers.each(one, more, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("n")))


@query("SELECT cast(3 AS int) AS tries, count(*) AS n FROM orders")
def safe_post(spark, sf_dir):
    """A sink that refuses twice gets all orders at the third try."""
    tries = []

    def flaky(df: DataFrame) -> int:
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError("refused")
        return df.count()

    n = retrying(flaky, times=3, seconds=0.01)(table(spark, sf_dir, "orders"))
    return spark.createDataFrame([(len(tries), n)], "tries int, n bigint")


@query("SELECT 'one' AS sinks, count(*) AS n, cast(sum(user_id) AS bigint) AS s FROM events UNION ALL SELECT 'two' AS sinks, count(*) AS n, cast(sum(user_id) AS bigint) AS s FROM events")
def process_counts(spark, sf_dir):
    """The number of rows that `process` gives, with one sink and with two, and what the sinks made of them."""
    events, out = table(spark, sf_dir, "events").select("user_id"), []
    for name, more in (("one", 0), ("two", 1)):
        got = []
        add = lambda df, got=got: got.append(df.agg(F.sum("user_id")).first()[0])
        n = process(spark, events, add, *[lambda df: df.write.format("noop").mode("overwrite").save()] * more)
        out.append((name, n, got[0]))
    return spark.createDataFrame(out, "sinks string, n bigint, s bigint")


def _event_lines(spark, sf_dir) -> str:
    """The events as a text log, `type user value`."""
    path = staging_path(spark, "log")
    table(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), F.round(F.col("value") * 100).cast("bigint").cast("string"))).write.text(path)
    return path


@query("SELECT event_type || ' ' || user_id || ' ' || cast(round(value * 100) AS bigint) AS line FROM events")
def text_lines(spark, sf_dir):
    return readers.lines(spark, _event_lines(spark, sf_dir))


@query("SELECT event_type AS level1, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'lines' AS level1, count(*) AS n FROM events")
def log_reader(spark, sf_dir):
    """A log read, parsed and counted in one scan."""
    r = Recorder("log")
    parse = map_columns(level1=F.split_part(F.col("line"), F.lit(" "), F.lit(1)))
    n = readers.LogReader(parse, r).process_files(spark, [_event_lines(spark, sf_dir)])
    _, events = r.snapshot()
    return spark.createDataFrame([(e.level1, k) for e, k in events.items()] + [("lines", n)], "level1 string, n bigint")


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 40")
def table_scan(spark, sf_dir):
    """Two columns of a table, with the filter in the scan."""
    return table(spark, sf_dir, "part").filter("p_size > 40").select("p_partkey", "p_name")


# ---- sinks


@query("SELECT 'survived' AS place, cast(count(*) AS bigint) AS n FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) t WHERE k <= 10 UNION ALL SELECT 'hooked' AS place, cast(2 AS bigint) AS n UNION ALL SELECT 'all' AS place, count(*) AS n FROM orders")
def eager_batches_survive(spark, sf_dir):
    """Batches of five nations; the third has a row that the mapping refuses, and two are there, each with its hook.
    Then all orders in batches."""
    nation = table(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1).select(F.when(F.col("n_nationkey") != 12, F.struct("n_nationkey")).alias("a"))
    strict = Accessor(nation.schema, StructType.fromDDL("n_nationkey int"), "t", Entity({"a.n_nationkey": ColumnMapping("t")}, no_null_check=frozenset(["a"])))
    base, hooked = staging_path(spark, "eager"), []
    sink = BulkSink(TargetTable("t", base, "nation"), strict, eager=True, batch=5, post_write=lambda _t, rows: hooked.append(rows.count()))
    spark_fails_with(lambda: sink(nation), "a is null")
    whole = BulkSink(TargetTable("t", base, "orders"), eager=True, batch=1 << 20)
    whole(table(spark, sf_dir, "orders").select("o_orderkey"))
    return spark.createDataFrame([("survived", sink.read(spark).count()), ("hooked", len(hooked)), ("all", whole.read(spark).count())], "place string, n bigint")


@query("SELECT event_type, count(*) AS n, cast(sum(user_id) AS bigint) AS s FROM events GROUP BY event_type")
def keyed_text(spark, sf_dir):
    """Lines of text in a directory for each key, read back."""
    path = staging_path(spark, "keyed-text")
    KeyedTextSink(path, "event_type", F.concat(F.lit("user "), F.col("user_id").cast("string")))(table(spark, sf_dir, "events"))
    return spark.read.text(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.substring("value", 6, 20).cast("bigint")).alias("s"))


@query("SELECT count(*) AS n, cast(sum(user_id) AS bigint) AS s FROM events")
def row_sink(spark, sf_dir):
    """A function on each row, on the executors."""
    n, s = (spark.sparkContext.accumulator(0) for _ in range(2))

    def each(rows) -> None:
        for r in rows:
            n.add(1)
            s.add(r.user_id)

    RowSink(each)(table(spark, sf_dir, "events").select("user_id"))
    return spark.createDataFrame([(n.value, s.value)], "n bigint, s bigint")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def mapped_cursor(spark, sf_dir):
    """Mapped rows one after the other, as a bulk copy reads them."""
    df = table(spark, sf_dir, "nation")
    accessor = Accessor(df.schema, StructType.fromDDL("key int, name string"), "t", Entity({"n_nationkey": ColumnMapping("t", "key"), "n_name": ColumnMapping("t", "name")}))
    return spark.createDataFrame(list(cursor(df, accessor)), "key int, name string")


@query("SELECT 'garbage' AS entity, count(*) AS n FROM events")
def null_sink(spark, sf_dir):
    r = Recorder()
    NullSink(r)(table(spark, sf_dir, "events"))
    return spark.createDataFrame([("garbage", r.entity("garbage"))], "entity string, n bigint")


# ---- stages


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000.0")
def consumer(spark, sf_dir):
    """A terminal consumer that gets the rows and runs its own action."""
    got = []
    flow = Flow(spark, "consumer")
    flow.add_sink(table(spark, sf_dir, "orders").filter("o_totalprice > 1000.0"), consume(lambda df: got.append(df.count()), "orders"))
    flow.run()
    return spark.createDataFrame([(got[0],)], "n bigint")


@query("SELECT c_custkey, upper(c_name) AS name FROM customer WHERE c_acctbal > 0")
def block_to_stage(spark, sf_dir):
    """An opaque function on batches, and a filter, as named stages of one flow."""

    def shout(batch):
        return batch.assign(name=batch["c_name"].str.upper())[["c_custkey", "name"]]

    positive = as_stage(filtered("c_acctbal > 0"), "positive")
    return merge(positive, from_batches(shout, "c_custkey bigint, name string"))(table(spark, sf_dir, "customer"))


# ---- routing


@query("SELECT what, outcome FROM (VALUES ('link after left_to', 'RoutingError'), ('transform_link after left_to', 'RoutingError'), ('second left_to', 'RoutingError'), ('link before', 'passed')) AS t(what, outcome)")
def freeze_rule(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    frozen = Router(events).link("value > 50.0", name="large").left_to_null()
    return told(spark, [
        ("link after left_to", outcome(lambda: frozen.link("true"), errors.RoutingError)),
        ("transform_link after left_to", outcome(lambda: frozen.transform_link(lambda df: df), errors.RoutingError)),
        ("second left_to", outcome(frozen.left_to_error, errors.RoutingError)),
        ("link before", outcome(lambda: Router(events).link("true"), errors.RoutingError)),
    ])


@query("SELECT 'open' AS what, 'RoutingError' AS outcome, cast(0 AS bigint) AS n UNION ALL SELECT 'closed' AS what, 'passed' AS outcome, count(*) AS n FROM events WHERE value > 50.0")
def exhaustive_routing(spark, sf_dir):
    """A table that leaves rows without a target is refused; with one it routes."""
    router = Router(table(spark, sf_dir, "events")).link("value > 50.0", name="large")
    first = outcome(lambda: router.branch("large"), errors.RoutingError)
    router.left_to_null()
    n = router.branch("large").count()
    return spark.createDataFrame([("open", first, 0), ("closed", "passed", n)], "what string, outcome string, n bigint")


@query("SELECT event_type, count(*) AS n FROM events WHERE NOT coalesce(value > 50.0, false) GROUP BY event_type")
def left_to_null_recorder(spark, sf_dir):
    """The recorder that counts what goes to null."""
    router = Router(table(spark, sf_dir, "events"), kind="event_type").link("value > 50.0", name="large")
    return router.left_to_null(lambda df: recorder.count_entities(df, "event_type", "event_type")).garbage_counts()


@query("SELECT lower(substr(c_mktsegment, 1, 1)) AS child, count(*) AS n FROM customer GROUP BY 1")
def dispatch_custom_key(spark, sf_dir):
    """Keys that differ in case only are one child's."""
    mixed = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("seg"))
    return Dispatcher(mixed, F.substring("seg", 1, 1), F.lower).keyed("child").groupBy("child").agg(F.count("*").alias("n"))


@query("SELECT 'count' AS target, count(*) AS v FROM events UNION ALL SELECT 'users' AS target, count(DISTINCT user_id) AS v FROM events")
def link_to_multiple(spark, sf_dir):
    """Two targets that each get all rows."""
    n, users = link_to_all(table(spark, sf_dir, "events").select("user_id"), lambda df: df.count(), lambda df: df.distinct().count())
    return spark.createDataFrame([("count", n), ("users", users)], "target string, v bigint")


# ---- lookup


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def no_lookup(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return Lookup("l_partkey", "p_partkey", "p_partkey", strategy=Strategy.NO_LOOKUP).run(facts, table(spark, sf_dir, "part").select("p_partkey")).joined


@query("WITH c AS (SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 100) SELECT 'hit' AS outcome, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM c) UNION ALL SELECT 'discarded' AS outcome, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM c)")
def cache_hits(spark, sf_dir):
    """How many facts a cache of the 100 newest rows answers."""
    return hit_counts(table(spark, sf_dir, "lineitem").select("l_partkey"), newest(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 100), "l_partkey", "p_partkey")


@query("SELECT what, outcome FROM (VALUES ('a column', 'passed'), ('a path', 'passed'), ('an expression', 'ValueError'), ('a sum', 'ValueError'), ('null key', 'refused'), ('key that is there twice', 'ValueError')) AS t(what, outcome)")
def lookup_key_check(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    make = lambda key: lambda: Lookup(key, "n_nationkey", "n_nationkey")
    facts = table(spark, sf_dir, "customer").select(F.expr("nullif(c_nationkey, 3)").alias("k"))
    twice = Lookup("k", "n_nationkey", "n_nationkey")
    return told(spark, [
        *((what, outcome(make(key), ValueError)) for what, key in (("a column", "k"), ("a path", "a.b.k"), ("an expression", "upper(k)"), ("a sum", "k + 1"))),
        ("null key", spark_fails_with(lambda: Lookup("k", "n_nationkey", "n_nationkey", strategy=Strategy.LOCAL).run(facts, nation).joined.count(), "a lookup key is null")),
        ("key that is there twice", outcome(lambda: twice.run(facts, nation.unionByName(nation)), ValueError)),
    ])


# ---- recorder


def _event_recorder(spark, sf_dir) -> Recorder:
    parents = {"click": ("ui",), "view": ("ui",), "ui": ("any",), "error": ("fault",), "fault": ("any",)}
    return Recorder("events", parents, exceptions=("fault",)).record(table(spark, sf_dir, "events"), "event_type", "event_type", F.when(F.col("value") > 100, "big"))


@query("SELECT 'click' AS entity, count(*) AS n FROM events WHERE event_type = 'click' UNION ALL SELECT 'ui' AS entity, count(*) AS n FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT 'any' AS entity, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'error') UNION ALL SELECT 'none' AS entity, cast(0 AS bigint) AS n")
def entity_lookup(spark, sf_dir):
    """Counts of entities: their own, or else the sum over their subtypes."""
    r = _event_recorder(spark, sf_dir)
    return spark.createDataFrame([(k, r.entity(k)) for k in ("click", "ui", "any", "none")], "entity string, n bigint")


@query("SELECT count(*) AS n FROM events WHERE event_type = 'error'")
def exception_count(spark, sf_dir):
    """Rows of a subtype of an exception type."""
    return spark.createDataFrame([(_event_recorder(spark, sf_dir).exception_count,)], "n bigint")


@query("SELECT event_type AS name, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT event_type || CASE WHEN value > 100 THEN '-big' ELSE '' END || '!' AS name, count(*) AS n FROM events GROUP BY 1")
def recorder_snapshots(spark, sf_dir):
    """Copies of both counters; events as text, marked. Clearing the recorder leaves the copies as they are."""
    r = _event_recorder(spark, sf_dir)
    entities, events = r.snapshot()
    r.clear()
    return spark.createDataFrame([*entities.items(), *((f"{e}!", n) for e, n in events.items())], "name string, n bigint")


@query("SELECT cast(0 AS bigint) AS before, count(*) AS after FROM events WHERE event_type = 'click'")
def recorder_clear(spark, sf_dir):
    r = _event_recorder(spark, sf_dir)
    r.clear()
    before = r.total + r.event("click")
    r.record(table(spark, sf_dir, "events").filter("event_type = 'click'"), "event_type")
    return spark.createDataFrame([(before, r.total)], "before bigint, after bigint")


@query("SELECT event_id, CASE WHEN value > 100 THEN event_type || '-big' ELSE event_type END AS event FROM events")
def event_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", recorder.event_text(F.col("event_type"), F.when(F.col("value") > 100, "big")).alias("event"))


@query("SELECT 'click' AS event, count(*) AS n FROM events WHERE event_type = 'click' AND NOT coalesce(value > 100, false) UNION ALL SELECT 'click-big' AS event, count(*) AS n FROM events WHERE event_type = 'click' AND value > 100 UNION ALL SELECT 'click-small' AS event, cast(0 AS bigint) AS n")
def event_counter(spark, sf_dir):
    """Counts of single events, by both levels: a bare event hides its second levels."""
    r = _event_recorder(spark, sf_dir)
    return spark.createDataFrame([(str(e), r[e]) for e in (Event("click"), Event("click", "big"), Event("click", "small"))], "event string, n bigint")


# ---- matching


@query("SELECT p_partkey, p_name LIKE '%ring' AS second FROM part")
def rule_by_index(spark, sf_dir):
    """The second rule of a matcher, by its place."""
    rules = match.Matcher([match.Rule(0, match.contains("red")), match.Rule(1, match.ends("ring"))])
    return table(spark, sf_dir, "part").select("p_partkey", rules[1].condition.matches("p_name").alias("second"))


# ---- mapping


def _customers(spark, sf_dir) -> DataFrame:
    """Customers with a nested nation, which customers without money lack."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.struct("n_name", "n_regionkey").alias("nation"))
    c = table(spark, sf_dir, "customer").join(nation, (F.col("c_nationkey") == F.col("k")) & (F.col("c_acctbal") > 0), "left")
    return c.select("c_custkey", "c_name", "nation")


@query("SELECT c_custkey, n_name AS nation_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 0")
def map_registered(spark, sf_dir):
    """Mappings that are registered from outside, by the entity's name and path."""
    df = _customers(spark, sf_dir)
    mapping.register("behaviours.customer", "c_custkey", ColumnMapping("t"))
    mapping.register("behaviours.customer", "nation.n_name", ColumnMapping("t", "nation_name"))
    try:
        return Accessor(df.schema, StructType.fromDDL("c_custkey bigint, nation_name string"), "t", name="behaviours.customer").apply(df)
    finally:
        mapping.clear_registered()


@query("SELECT c_custkey, c_name FROM customer")
def map_automatic(spark, sf_dir):
    """Without a mapping, fields go to columns of their name, without regard to case; read-only columns are skipped."""
    df = _customers(spark, sf_dir)
    return Accessor(df.schema, StructType.fromDDL("C_CUSTKEY bigint, n_name string, c_Name string"), "t", read_only=["N_NAME"]).apply(df).toDF("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer")
def map_do_not_expand(spark, sf_dir):
    """A struct that isn't looked into has no fields to map."""
    df = _customers(spark, sf_dir)
    return Accessor(df.schema, StructType.fromDDL("c_custkey bigint, c_name string, n_name string"), "t", Entity(no_expand=frozenset(["nation"]))).apply(df)


@query("SELECT 'checked' AS what, 'passed' AS outcome UNION ALL SELECT 'unchecked' AS what, CASE WHEN count(*) > 0 THEN 'refused' ELSE 'passed' END AS outcome FROM customer WHERE NOT coalesce(c_acctbal > 0, false)")
def map_no_null_check(spark, sf_dir):
    """A struct without a null check fails the flow where it is null."""
    df = _customers(spark, sf_dir)
    run = lambda skip: lambda: Accessor(df.schema, StructType.fromDDL("n_name string"), "t", Entity({"nation.n_name": ColumnMapping("t")}, no_null_check=skip)).apply(df).collect()
    return told(spark, [("checked", spark_fails_with(run(frozenset()), "nation is null")), ("unchecked", spark_fails_with(run(frozenset(["nation"])), "nation is null"))])


@query("SELECT c_custkey, coalesce(n_name, '?') AS a FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 0")
def map_reference_loop(spark, sf_dir):
    """A struct below one of the same entity closes a loop of references, and is left out."""
    df = _customers(spark, sf_dir).withColumn("me", F.struct("c_name", F.struct(F.lit("loop").alias("n_name")).alias("self")))
    kinds = {f.name: f for f in df.schema}
    inner = StructField("self", kinds["me"].dataType["self"].dataType, metadata={"entity": "customer"})
    me = StructField("me", StructType([kinds["me"].dataType["c_name"], inner]), metadata={"entity": "customer"})
    source = StructType([kinds["c_custkey"], kinds["nation"], me])
    entity = Entity({"c_custkey": ColumnMapping("t"), "nation.n_name": ColumnMapping("t", "a", default="?"), "me.self.n_name": ColumnMapping("t", "a", option=mapping.Option.OVERWRITE)})
    return Accessor(source, StructType.fromDDL("c_custkey bigint, a string"), "t", entity).apply(df)


@query("SELECT c_custkey, c_name AS second FROM customer")
def map_by_offset(spark, sf_dir):
    """By offset, and by name and offset that agree."""
    df = _customers(spark, sf_dir)
    entity = Entity({"c_custkey": ColumnMapping("t", "c_custkey", 0), "c_name": ColumnMapping("t", offset=1)})
    return Accessor(df.schema, StructType.fromDDL("c_custkey bigint, second string"), "t", entity).apply(df)


@query("SELECT what, outcome FROM (VALUES ('name and offset differ', 'MappingError'), ('case of name at an offset', 'MappingError'), ('offset beyond the table', 'MappingError'), ('no such column', 'MappingError'), ('no such column, optional', 'passed'), ('default of another type', 'MappingError'), ('default of a value that cannot be null', 'MappingError'), ('default of its type', 'passed')) AS t(what, outcome)")
def map_refusals(spark, sf_dir):
    source = table(spark, sf_dir, "customer").select("c_custkey", "c_name").schema
    strict = StructType([StructField("c_custkey", source["c_custkey"].dataType, False), source["c_name"]])
    target = StructType.fromDDL("c_custkey bigint, c_name string")

    def built(m: ColumnMapping, path: str = "c_name", schema: StructType = source) -> str:
        return outcome(lambda: Accessor(schema, target, "t", Entity({path: m})), errors.MappingError)

    return told(spark, [
        ("name and offset differ", built(ColumnMapping("t", "c_name", 0))), ("case of name at an offset", built(ColumnMapping("t", "C_NAME", 1))),
        ("offset beyond the table", built(ColumnMapping("t", offset=7))), ("no such column", built(ColumnMapping("t", "other"))),
        ("no such column, optional", built(ColumnMapping("t", "other", option=mapping.Option.OPTIONAL))), ("default of another type", built(ColumnMapping("t", default=3))),
        ("default of a value that cannot be null", built(ColumnMapping("t", default=3), "c_custkey", strict)), ("default of its type", built(ColumnMapping("t", default="x"))),
    ])


@query("SELECT o_orderkey, cast(CASE WHEN o_totalprice > 100000 THEN o_custkey ELSE 0 END AS varchar) AS cust, CASE WHEN o_totalprice > 100000 THEN cast(cast(o_orderdate AS date) AS varchar) ELSE '0001-01-01' END AS day FROM orders")
def map_zero_values(spark, sf_dir):
    """Values below a missing struct that can't be null: zero of a decimal, the first of all dates."""
    inner = F.struct(F.col("o_custkey").cast("decimal(18,0)").alias("cust"), F.col("o_orderdate").cast("date").alias("day"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, inner).alias("a"))
    source = StructType.fromDDL("o_orderkey bigint, a struct<cust: decimal(18,0) NOT NULL, day: date NOT NULL>")
    entity = Entity({"o_orderkey": ColumnMapping("t"), "a.cust": ColumnMapping("t"), "a.day": ColumnMapping("t")})
    return Accessor(source, StructType.fromDDL("o_orderkey bigint, cust string, day string"), "t", entity).apply(df)


@query("SELECT what, v FROM (VALUES ('field_count', '2'), ('name_of 1', 'c_name'), ('offset_of C_NAME', '1'), ('offset_of none', '-1'), ('mapping_of 0', 'c_custkey'), ('flat names', 'c_custkey, c_name'), ('error', 'the target has no column ''x''')) AS t(what, v)")
def accessor_metadata(spark, sf_dir):
    schema = table(spark, sf_dir, "customer").select("c_custkey", "c_name").schema
    a = Accessor(schema, schema, "t")
    try:
        Accessor(schema, schema, "t", Entity({"c_name": ColumnMapping("t", "x")}))
        error = ""
    except errors.MappingError as e:
        error = str(e).split(";")[0]
    return spark.createDataFrame([
        ("field_count", str(a.field_count)), ("name_of 1", a.name_of(1)), ("offset_of C_NAME", str(a.offset_of("C_NAME"))), ("offset_of none", str(a.offset_of("none"))),
        ("mapping_of 0", a.mapping_of(0).name), ("flat names", mapping.flat_names(schema)), ("error", error),
    ], "what string, v string")


# ---- iteration


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey + 7) % 25 AS dst FROM nation), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, count(*) AS reached FROM r GROUP BY src")
def ring_closure(spark, sf_dir):
    """All that a ring of nations reaches."""
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 7) % 25).alias("dst"))
    return closure(edges).groupBy("src").agg(F.count("*").alias("reached"))


# ---- life cycle


class _Cleaned(Flow):
    """A flow that notes how it ended."""

    ended = "not at all"

    def clean_up(self, error: BaseException | None) -> None:
        self.ended = type(error).__name__ if error else "well"


@query("SELECT what, outcome FROM (VALUES ('child twice', 'ValueError'), ('child twice, allowed', 'passed'), ('ancestor', 'ValueError'), ('grandchild is mine', 'true'), ('stranger is mine', 'false'), ('no child', 'EmptyFlowError'), ('full name', '[top]->[sub]')) AS t(what, outcome)")
def flow_children(spark, sf_dir):
    top, sub = Flow(spark, "top"), Flow(spark, "sub")
    top.add(sub)
    leaf = sub.add(lambda: table(spark, sf_dir, "nation").count(), "leaf")
    return told(spark, [
        ("child twice", outcome(lambda: top.add(sub), ValueError)), ("child twice, allowed", outcome(lambda: top.add(sub, allow_duplicate=True), ValueError)),
        ("ancestor", outcome(lambda: sub.add(top), ValueError)), ("grandchild is mine", str(top.has(leaf)).lower()), ("stranger is mine", str(top.has(Flow())).lower()),
        ("no child", outcome(Flow(spark).run, errors.EmptyFlowError)), ("full name", sub.full_name),
    ])


@query("SELECT * FROM (VALUES (1, 'region', cast(5 AS bigint)), (2, 'nation', 25), (3, 'hook', 30)) AS t(place, step, n)")
def flow_dependencies(spark, sf_dir):
    """Children in the order of their dependencies, then the hook that runs after success."""
    ran: list[tuple[str, int]] = []
    flow = Flow(spark, "ordered")
    nation = flow.add(lambda: ran.append(("nation", table(spark, sf_dir, "nation").count())), "nation")
    region = flow.add(lambda: ran.append(("region", table(spark, sf_dir, "region").count())), "region")
    flow.depends(nation, region)
    flow.on_success(lambda: ran.append(("hook", sum(n for _, n in ran))))
    flow.run()
    return spark.createDataFrame([(k, *r) for k, r in enumerate(ran, 1)], "place int, step string, n bigint")


@query("SELECT what, outcome FROM (VALUES ('flow', 'RejectedRowError'), ('downstream', 'UpstreamFailedError'), ('clean_up', 'RejectedRowError'), ('cancel hooks', '1'), ('success hooks', '0'), ('root cause', 'RejectedRowError')) AS t(what, outcome)")
def flow_failure(spark, sf_dir):
    """A child that fails on real rows stops what depends on it, and is the error that the caller sees."""
    flow, hooks = _Cleaned(spark, "failing", Options(parallelism=1)), []

    def reject() -> None:
        if n := table(spark, sf_dir, "orders").count():
            raise errors.RejectedRowError(f"{n} rows")

    bad = flow.add(reject, "bad")
    flow.depends(flow.add(lambda: None, "downstream"), bad)
    flow.on_success(lambda: hooks.append("success"))
    flow.on_cancel(lambda: hooks.append("cancel"))
    seen = outcome(flow.run, errors.RejectedRowError)
    wrapped = errors.SiblingFailedError("stopped")
    wrapped.__cause__ = flow.error
    return told(spark, [
        ("flow", seen), ("downstream", type(flow.failures["downstream"]).__name__), ("clean_up", flow.ended),
        ("cancel hooks", str(hooks.count("cancel"))), ("success hooks", str(hooks.count("success"))), ("root cause", type(errors.root_cause(wrapped)).__name__),
    ])


@query("SELECT what, outcome FROM (VALUES ('flow', 'FlowCancelledError'), ('waiting', 'UpstreamCancelledError'), ('clean_up', 'FlowCancelledError'), ('busy while it ran', 'true'), ('busy after', 'false')) AS t(what, outcome)")
def flow_cancel(spark, sf_dir):
    """A flow that is cancelled while a job runs: the job is stopped, what waits does not run."""
    flow, begun = _Cleaned(spark, "cancelled"), threading.Event()
    rows = spark.range(100_000_000, numPartitions=64)

    def long() -> None:
        begun.set()
        rows.agg(F.max(F.sha2(F.col("id").cast("string"), 256))).collect()

    slow = flow.add(long, "slow")
    flow.depends(flow.add(lambda: None, "waiting"), slow)
    thread = flow.start()
    begun.wait(60)
    busy = flow.busy
    time.sleep(0.5)  # so that there is a job to stop
    flow.cancel()
    thread.join(60)
    return told(spark, [
        ("flow", type(flow.error).__name__), ("waiting", type(flow.failures["waiting"]).__name__), ("clean_up", flow.ended),
        ("busy while it ran", str(busy).lower()), ("busy after", str(flow.busy).lower()),
    ])


@query("SELECT 'rows' AS place, count(*) AS n FROM orders UNION ALL SELECT 'dear' AS place, count(*) AS n FROM orders WHERE o_totalprice > 300000.0")
def monitor_reports(spark, sf_dir):
    """What a monitor's loop has reported by the end of a flow."""
    got: dict[str, int] = {}
    flow = Flow(spark, "monitored", Options(monitor=True, verbose=True, interval_seconds=0.2))
    flow.monitor.on_report = got.update
    orders = table(spark, sf_dir, "orders").select("o_totalprice")
    discard = lambda df: df.write.format("noop").mode("overwrite").save()
    flow.add_sink(orders, discard, "rows")
    flow.add_sink(orders.filter("o_totalprice > 300000.0"), discard, "dear")
    flow.run()
    return spark.createDataFrame(sorted(got.items()), "place string, n bigint")


@query("SELECT 'orders places: ' || count(*) || ' rows' AS line FROM orders")
def flow_logging(spark, sf_dir):
    """The line that a monitor logs for a place."""
    lines: list[str] = []
    handler = logging.Handler()
    handler.emit = lambda record: lines.append(record.getMessage())  # type: ignore[method-assign]
    log = logging.getLogger("weir.monitor")
    level = log.level
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    try:
        monitor = Monitor("orders")
        monitor.watch(table(spark, sf_dir, "orders").select("o_orderkey"), "places").write.format("noop").mode("overwrite").save()
        monitor.report("places")
    finally:
        log.removeHandler(handler)
        log.setLevel(level)
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("SELECT name, base FROM (VALUES ('EmptyFlowError', 'FlowError'), ('FlowCancelledError', 'FlowError'), ('MappingError', 'FlowError'), ('RejectedRowError', 'FlowError'), ('RoutingError', 'FlowError'), ('SiblingCancelledError', 'FlowError'), ('SiblingFailedError', 'FlowError'), ('UpstreamCancelledError', 'FlowError'), ('UpstreamFailedError', 'FlowError')) AS t(name, base)")
def error_kinds(spark, sf_dir):
    return spark.createDataFrame([(k.__name__, k.__bases__[0].__name__) for k in errors.FlowError.__subclasses__()], "name string, base string")


# ---- streams


def _event_stream(spark, sf_dir, parts: int, max_files: int | None = None) -> DataFrame:
    """The events as a stream over so many files."""
    path = staging_path(spark, "stream")
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    events.repartition(parts, "event_id").write.parquet(path)
    return streams.read(spark, path, "event_id bigint, user_id bigint", max_files=max_files)


@query("SELECT count(*) AS n, cast(sum(user_id) AS bigint) AS s FROM events")
def trigger_batch(spark, sf_dir):
    """A stream whose interval is an hour, one file at a time: the second is written at once when it is flushed."""
    seen: list[tuple[int, int]] = []
    q = streams.Follower(_event_stream(spark, sf_dir, 2, max_files=1), lambda df, _: seen.append(tuple(df.agg(F.count("*"), F.coalesce(F.sum("user_id"), F.lit(0))).first())), staging_path(spark, "state"), seconds=3600)
    try:
        q.flush()
    finally:
        q.stop()
    return spark.createDataFrame([tuple(map(sum, zip(*seen, strict=True)))], "n bigint, s bigint")


@query("SELECT count(*) AS n, cast(4 AS int) AS batches FROM events")
def bounded_batches(spark, sf_dir):
    """Back-pressure: four files, one in each micro-batch."""
    seen: list[int] = []
    streams.drain(_event_stream(spark, sf_dir, 4, max_files=1), lambda df, _: seen.append(df.count()), staging_path(spark, "state"))
    return spark.createDataFrame([(sum(seen), sum(n > 0 for n in seen))], "n bigint, batches int")


@query("SELECT count(*) AS n, true AS stopped FROM events")
def time_flush(spark, sf_dir):
    """A sink that is flushed at short intervals, until nothing has come for a second."""
    sink = BulkSink(TargetTable("t", staging_path(spark, "flushed"), "events"), eager=True, batch=1 << 20)
    q = streams.follow(_event_stream(spark, sf_dir, 3), lambda df, _: sink(df), staging_path(spark, "state"), seconds=0.2)
    stopped = streams.stop_when_idle(q, 1.0)
    return spark.createDataFrame([(sink.read(spark).count(), stopped)], "n bigint, stopped boolean")


@query("WITH dim AS (SELECT p_partkey AS k, p_partkey AS sk FROM part WHERE p_size <= 25), miss AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT k FROM dim)) SELECT 'facts' AS what, count(*) AS n FROM lineitem UNION ALL SELECT 'dimension' AS what, (SELECT count(*) FROM dim) + (SELECT count(*) FROM miss) AS n UNION ALL SELECT 'keys' AS what, (SELECT count(*) FROM dim) + (SELECT count(*) FROM miss) AS n")
def lookup_stream(spark, sf_dir):
    """Lookup-or-insert by micro-batch; the dimension has a column that new rows have no attribute for."""
    path, out = staging_path(spark, "facts"), staging_path(spark, "looked-up")
    table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition(3, "l_orderkey").write.parquet(path)
    stream = streams.LookupStream(Lookup("l_partkey", "k", "sk"), staging_path(spark, "dim"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    stream.create(table(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("k"), F.col("p_partkey").alias("sk"), "p_name"))
    streams.drain(streams.read(spark, path, "l_orderkey bigint, l_partkey bigint", max_files=1), stream, staging_path(spark, "state"))
    dim = stream.dimension(spark)
    return spark.createDataFrame([("facts", spark.read.parquet(out).count()), ("dimension", dim.count()), ("keys", dim.select("sk").distinct().count())], "what string, n bigint")
