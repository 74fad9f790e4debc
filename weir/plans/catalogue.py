"""The catalogue of registered queries, each built from the engine's own operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.errors import RejectedRowError
from weir.functions import match, values
from weir.operators import batching, recorder
from weir.operators.fan import Broadcaster, Dispatcher, union
from weir.operators.iterate import fixpoint
from weir.operators.lookup import Lookup, Strategy, hit_counts, newest
from weir.operators.mapping import Accessor, ColumnMapping, Entity, Option, TargetTable
from weir.operators.recorder import Recorder
from weir.operators.router import Router
from weir.operators.stage import filtered, flat_map, map_columns, merge, with_columns
from weir.plans.flow import Flow
from weir.plans.monitor import Monitor
from weir.sources.readers import table, tagged
from weir.sources.sinks import BulkSink, MultiSink
from weir.sources.storage import staging_path
from weir.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    from weir.plans import behaviours  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


# ---- links and routing


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE coalesce(o_totalprice > 300000.0, false)")
def link_predicate(spark, sf_dir):
    router = Router(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")).link("o_totalprice > 300000.0", name="dear").left_to_null()
    return router.branch("dear")


def _value_router(spark, sf_dir) -> Router:
    events = table(spark, sf_dir, "events")
    return Router(events).link("value > 200.0", name="high").link("value > 50.0", name="mid").left_to()


@query("SELECT event_id, CASE WHEN coalesce(value > 200.0,false) THEN 'high' WHEN coalesce(value > 50.0,false) THEN 'mid' ELSE 'left' END AS route FROM events")
def route_first_match(spark, sf_dir):
    return _value_router(spark, sf_dir).routed().select("event_id", "route")


@query("SELECT o_orderkey, concat('Odd: ', cast(o_orderkey AS varchar(20))) AS msg FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, concat('Even: ', cast(o_orderkey AS varchar(20))) AS msg FROM orders WHERE o_orderkey % 2 = 0")
def transform_and_link(spark, sf_dir):
    def say(word: str):
        return map_columns(o_orderkey=F.col("o_orderkey"), msg=F.concat(F.lit(word + ": "), F.col("o_orderkey").cast("string")))

    router = Router(table(spark, sf_dir, "orders").select("o_orderkey"))
    router.transform_link(say("Odd"), "o_orderkey % 2 = 1", name="odd").transform_link(say("Even"), "o_orderkey % 2 = 0", name="even").left_to_error()
    return union(*router.branches().values())


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def link_subtype(spark, sf_dir):
    router = Router(table(spark, sf_dir, "events"), kind="event_type")
    router.subtype_link("purchase", lambda df: df.select("event_id", "user_id", "value")).left_to_null()
    return router.branch("purchase")


def _click_router(spark, sf_dir) -> Router:
    return Router(table(spark, sf_dir, "events")).link("event_type = 'click'", name="click").link("value > 50.0", name="large")


@query("SELECT event_id, event_type FROM events WHERE NOT coalesce(event_type = 'click', false) AND NOT coalesce(value > 50.0, false)")
def link_left(spark, sf_dir):
    return _click_router(spark, sf_dir).left_to("rest").branch("rest").select("event_id", "event_type")


@query("SELECT event_type AS entity, count(*) AS n FROM events WHERE NOT coalesce(event_type = 'click', false) AND NOT coalesce(value > 50.0, false) GROUP BY event_type")
def garbage_recorder(spark, sf_dir):
    return recorder.count_entities(_click_router(spark, sf_dir).left_to_null().garbage(), "event_type")


# ---- fan-out and fan-in


@query("SELECT 't1' AS target, count(*) AS n, cast(sum(user_id) AS bigint) AS s FROM events UNION ALL SELECT 't2' AS target, count(*) AS n, cast(sum(user_id) AS bigint) AS s FROM events")
def broadcast_copies(spark, sf_dir):
    b = Broadcaster(table(spark, sf_dir, "events").select("user_id"), copy=lambda df: df.select("*"))
    for _ in range(2):
        b.link(lambda df: df)
    return union(*(df.agg(F.lit(f"t{k}").alias("target"), F.count("*").alias("n"), F.sum("user_id").alias("s")) for k, df in enumerate(b.outputs(), 1)))


@query("SELECT cast(999 AS bigint) AS v, count(*) AS n FROM orders UNION ALL SELECT o_orderkey AS v, cast(1 AS bigint) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT -o_orderkey AS v, cast(1 AS bigint) AS n FROM orders WHERE o_orderkey % 2 <> 0")
def fan_in_union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    router = Router(orders).transform_link(map_columns(v="o_orderkey", n="1L"), "o_orderkey % 2 = 0", name="even").transform_link(map_columns(v="-o_orderkey", n="1L"), name="odd").left_to_null()
    return union(orders.agg(F.lit(999).cast("bigint").alias("v"), F.count("*").alias("n")), router.branch("even"), router.branch("odd"))


def _span(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT event_type AS child, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type")
def dispatch_by_key(spark, sf_dir):
    return _span(Dispatcher(table(spark, sf_dir, "events"), "event_type").keyed("child"), "child")


@query("SELECT n_regionkey AS target, count(*) AS n, min(n_name) AS first_name FROM nation GROUP BY n_regionkey")
def multi_target_dispatch(spark, sf_dir):
    """Each key's rows are written to a target of its own, and read back from all of them."""
    base = staging_path(spark, "multi-target")
    MultiSink("n_regionkey", lambda k: BulkSink(TargetTable("nations", base, f"target{k}"), eager=True))(table(spark, sf_dir, "nation"))
    targets = spark.read.option("recursiveFileLookup", "true").parquet(base).withColumn("target", F.regexp_extract(F.input_file_name(), "target([0-9]+)", 1).cast("int"))
    return targets.groupBy("target").agg(F.count("*").alias("n"), F.min("n_name").alias("first_name"))


@query("SELECT src, count(*) AS n FROM (SELECT 'orders' AS src FROM orders UNION ALL SELECT 'events' AS src FROM events) t GROUP BY src")
def process_multiple(spark, sf_dir):
    rows = {n: table(spark, sf_dir, n).select() for n in ("orders", "events")}
    return tagged(**rows).groupBy("src").agg(F.count("*").alias("n"))


@query("SELECT batch_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, cast(floor((row_number() OVER (ORDER BY event_id) - 1) / 4096) AS bigint) AS batch_id FROM events) t GROUP BY batch_id")
def batch_chunks(spark, sf_dir):
    return _span(batching.batched(table(spark, sf_dir, "events").select("event_id"), "event_id", 4096), "batch_id")


# ---- recorder


@query("SELECT event_type AS level1, role2 AS level2, count(*) AS n FROM (SELECT event_type, CASE WHEN value > 100 THEN 'big' END AS role2 FROM events) t GROUP BY event_type, role2 UNION ALL SELECT 'TOTAL' AS level1, CAST(NULL AS varchar(10)) AS level2, count(*) AS n FROM events")
def recorder_rollup(spark, sf_dir):
    counts = recorder.count_events(table(spark, sf_dir, "events"), "event_type", F.when(F.col("value") > 100, "big"))
    return recorder.with_total(counts)


@query("SELECT level1, cast(coalesce(max(CASE WHEN level2 IS NULL THEN n END), sum(n)) AS bigint) AS n FROM (SELECT event_type AS level1, CASE WHEN event_type <> 'click' AND value > 100 THEN 'big' WHEN event_type = 'click' THEN cast(user_id % 3 AS varchar(5)) END AS level2, count(*) AS n FROM events GROUP BY 1, 2) t GROUP BY level1")
def recorder_lookup(spark, sf_dir):
    click = F.col("event_type") == "click"
    level2 = F.when(~click & (F.col("value") > 100), "big").when(click, (F.col("user_id") % 3).cast("string"))
    return recorder.event_lookup(recorder.count_events(table(spark, sf_dir, "events"), "event_type", level2))


@query("SELECT cast(sum(n) AS bigint) AS total FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) t")
def recorder_total(spark, sf_dir):
    return recorder.total(recorder.count_entities(table(spark, sf_dir, "events"), "event_type"))


@query("SELECT 'OldPerson' AS level1, count(*) AS n FROM customer WHERE c_acctbal > 7000")
def event_provider(spark, sf_dir):
    counts = recorder.count_events(table(spark, sf_dir, "customer"), F.when(F.col("c_acctbal") > 7000, "OldPerson"))
    return recorder.event_rollup(counts)


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) t WHERE rn = 1")
def distinct_first_by_key(spark, sf_dir):
    return recorder.first_by_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


# ---- matching


def _parts(spark, sf_dir, condition: match.Condition, *columns: str) -> DataFrame:
    return filtered(condition.test("p_name"))(table(spark, sf_dir, "part")).select("p_partkey", *columns)


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def match_exact(spark, sf_dir):
    return filtered(match.exact("click").test("event_type"))(table(spark, sf_dir, "events")).select("event_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%'")
def match_begins_with(spark, sf_dir):
    return _parts(spark, sf_dir, match.begins("small"), "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring'")
def match_ends_with(spark, sf_dir):
    return _parts(spark, sf_dir, match.ends("ring"), "p_name")


@query("SELECT p_partkey FROM part WHERE position('RING' IN upper(p_name)) > 0")
def match_contains_ci(spark, sf_dir):
    return _parts(spark, sf_dir, match.Url("ring", match.MatchKind.CONTAINS))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)^(RED|small) .*g')")
def match_regex_ci(spark, sf_dir):
    return _parts(spark, sf_dir, match.regex("^(RED|small) .*g"))


@query("SELECT p_partkey FROM part WHERE false")
def match_none(spark, sf_dir):
    return _parts(spark, sf_dir, match.NOTHING)


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%ring' THEN p_name ELSE 'default' END AS matched FROM part")
def match_default(spark, sf_dir):
    hit = match.Matcher([match.Rule(1, match.ends("ring"))]).first("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(hit.isNotNull(), F.col("p_name")).otherwise("default").alias("matched"))


_RULES = match.Matcher([match.Rule(0, match.contains("red")), match.Rule(1, match.ends("ring")), match.Rule(2, match.begins("small"))])


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%red%' THEN 0 WHEN p_name LIKE '%ring' THEN 1 WHEN p_name LIKE 'small%' THEN 2 ELSE -1 END AS rule FROM part")
def multi_match_first(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", _RULES.first_or("p_name", -1).alias("rule"))


@query("SELECT p_partkey, 0 AS rule FROM part WHERE p_name LIKE '%red%' UNION ALL SELECT p_partkey, 1 AS rule FROM part WHERE p_name LIKE '%ring' UNION ALL SELECT p_partkey, 2 AS rule FROM part WHERE p_name LIKE 'small%'")
def multi_match_all(spark, sf_dir):
    return _RULES.explode(table(spark, sf_dir, "part"), "p_name").select("p_partkey", "rule")


_NESTED = match.Matcher([match.Rule(10, match.AnyOf([match.contains("red"), match.contains("green")])), match.Rule(20, match.AnyOf([match.ends("ring"), match.begins("small")]))])


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%red%' OR p_name LIKE '%green%' THEN 0 WHEN p_name LIKE '%ring' OR p_name LIKE 'small%' THEN 1 END AS rule, CASE WHEN p_name LIKE '%red%' THEN 0 WHEN p_name LIKE '%green%' THEN 1 WHEN p_name LIKE '%ring' THEN 0 WHEN p_name LIKE 'small%' THEN 1 END AS condition FROM part")
def multi_match_exact(spark, sf_dir):
    hit = _NESTED.first_exact("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", hit["rule"].alias("rule"), hit["condition"].alias("condition"))


@query("SELECT page_id, regexp_extract(trim(url), '^[^?#]*', 0) AS url FROM pages")
def url_without_param(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", match.url_without_param("url").alias("url"))


@query("SELECT page_id FROM pages WHERE lower(regexp_extract(trim(url), '^[^?#]*', 0)) LIKE '%/en/%'")
def url_match_exclude_param(spark, sf_dir):
    condition = match.Url("/EN/", match.MatchKind.CONTAINS, exclude_param=True)
    return filtered(condition.test("url"))(table(spark, sf_dir, "pages")).select("page_id")


# ---- mapping


def _nested_orders(spark, sf_dir, customers: Column, key: Column | None = None) -> DataFrame:
    """Orders with a nested customer and, in it, a nested nation; either may be missing."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.struct("n_name").alias("nation"))
    c = table(spark, sf_dir, "customer").filter(customers).join(F.broadcast(nation), F.col("c_nationkey") == F.col("nk"), "left")
    c = c.select(F.col("c_custkey").alias("ck"), F.struct("c_name", F.col("c_nationkey").alias("c_nationkey"), "nation").alias("customer"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("ck"), "left").select("o_orderkey", "customer")


def _schema(spec: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(spec)


@query("SELECT o.o_orderkey, coalesce(c.c_name, 'Unknown Customer') AS customer_name, coalesce(n.n_name, 'N/A') AS nation_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def map_nested_defaults(spark, sf_dir):
    df = _nested_orders(spark, sf_dir, F.col("c_acctbal") > 0)
    entity = Entity({
        "o_orderkey": ColumnMapping("t"),
        "customer.c_name": ColumnMapping("t", "customer_name", default="Unknown Customer"),
        "customer.nation.n_name": ColumnMapping("t", "nation_name", default="N/A"),
    })
    return Accessor(df.schema, _schema("o_orderkey bigint, customer_name string, nation_name string"), "t", entity).apply(df)


@query("SELECT o.o_orderkey, coalesce(c.c_nationkey, 0) AS nation_key FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0")
def map_nested_zero_default(spark, sf_dir):
    """The nested key cannot be null, so below a missing customer it reads as 0."""
    df = _nested_orders(spark, sf_dir, F.col("c_acctbal") > 0)
    source = _schema("o_orderkey bigint, customer struct<c_name: string, c_nationkey: int NOT NULL>")
    entity = Entity({"o_orderkey": ColumnMapping("t"), "customer.c_nationkey": ColumnMapping("t", "nation_key")})
    return Accessor(source, _schema("o_orderkey bigint, nation_key int"), "t", entity).apply(df)


@query("SELECT o.o_orderkey, coalesce(c.c_name, 'N/A') AS name_col FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'")
def map_optional_overwrite(spark, sf_dir):
    """An optional mapping without a column is dropped, and an overwriting one wins from below a nearer one."""
    df = _nested_orders(spark, sf_dir, F.col("c_mktsegment") == "BUILDING").withColumn("label", F.lit("near"))
    entity = Entity({
        "o_orderkey": ColumnMapping("t"),
        "label": [ColumnMapping("t", "name_col"), ColumnMapping("t", "no_such_column", option=Option.OPTIONAL)],
        "customer.c_name": ColumnMapping("t", "name_col", default="N/A", option=Option.OVERWRITE),
    })
    return Accessor(df.schema, _schema("o_orderkey bigint, name_col string"), "t", entity).apply(df)


# ---- lookup


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey")
def dim_lookup_hit(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    dim = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return Lookup("l_partkey", "p_partkey", "p_partkey", strategy=Strategy.LOCAL).run(facts, dim).joined


@query("SELECT l.l_orderkey, l.l_linenumber, p.p_partkey FROM lineitem l JOIN part p ON encode(cast(l.l_partkey AS varchar)) = encode(cast(p.p_partkey AS varchar))")
def dim_lookup_binary(spark, sf_dir):
    facts = with_columns(k=values.binary_key("l_partkey"))(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"))
    dim = table(spark, sf_dir, "part").select("p_partkey", values.binary_key("p_partkey").alias("bk"))
    return Lookup("k", "bk", "p_partkey", strategy=Strategy.LOCAL).run(facts, dim).joined.select("l_orderkey", "l_linenumber", "p_partkey")


_DIM = "WITH dim AS (SELECT p_partkey AS k, p_partkey + 1 AS sk FROM part WHERE p_size <= 25)"


def _upsert(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    dim = table(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") + 1).alias("sk"))
    return Lookup("l_partkey", "k", "sk").run(facts, dim)


@query(_DIM + ", miss AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT k FROM dim)), ins AS (SELECT k, (SELECT max(sk) FROM dim) + row_number() OVER (ORDER BY k) AS sk FROM miss), full_dim AS (SELECT k, sk FROM dim UNION ALL SELECT k, sk FROM ins) SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, d.sk FROM lineitem l JOIN full_dim d ON l.l_partkey = d.k")
def dim_lookup_upsert(spark, sf_dir):
    return _upsert(spark, sf_dir).joined


@query(_DIM + ", miss AS (SELECT DISTINCT l_partkey AS k FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM dim d WHERE d.k = l.l_partkey)) SELECT k, (SELECT max(sk) FROM dim) + row_number() OVER (ORDER BY k) AS sk FROM miss")
def dim_new_rows(spark, sf_dir):
    return _upsert(spark, sf_dir).new_rows.select("k", "sk")


@query("SELECT 'hit' AS outcome, count(*) AS n FROM lineitem l WHERE EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size <= 25) UNION ALL SELECT 'discarded' AS outcome, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size <= 25)")
def local_lookup_discard(spark, sf_dir):
    return hit_counts(table(spark, sf_dir, "lineitem").select("l_partkey"), table(spark, sf_dir, "part").filter("p_size <= 25"), "l_partkey", "p_partkey")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey DESC LIMIT 100")
def cache_warm_topn(spark, sf_dir):
    """The newest rows of a dimension, as many as a cache of 100 rows is warmed with."""
    return newest(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 100)


# ---- iteration


@query("WITH RECURSIVE r AS (SELECT n_nationkey AS seed, n_nationkey AS x, 0 AS step FROM nation UNION ALL SELECT seed, x + 1 - 2 AS x, step + 1 AS step FROM r WHERE x + 1 - 2 >= 0) SELECT seed, max(step) AS steps, min(x) AS last_x FROM r GROUP BY seed")
def ring_fixpoint(spark, sf_dir):
    heat, cool = map_columns(seed="seed", x="x + 1"), map_columns(seed="seed", x="x - 2")
    seed = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seed"), F.col("n_nationkey").alias("x"))
    rounds = fixpoint(seed, merge(heat, cool, filtered("x >= 0")))
    return rounds.rows.groupBy("seed").agg(F.max("step").alias("steps"), F.min("x").alias("last_x"))


# ---- parsing


@query("SELECT tok, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS tok FROM documents) t GROUP BY tok")
def transform_many_split(spark, sf_dir):
    tokens = flat_map(F.split("text", " "), "tok")(table(spark, sf_dir, "documents"))
    return tokens.groupBy("tok").agg(F.count("*").alias("n"))


@query("SELECT split_part(kv,'=',1) AS k, cast(sum(cast(split_part(kv,'=',2) AS int)) AS bigint) AS total FROM (SELECT event_type || '=' || cast(user_id AS varchar) AS kv FROM events) t GROUP BY 1")
def kv_parse_sum(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").select(F.concat_ws("=", "event_type", F.col("user_id").cast("string")).alias("kv"))
    parse = map_columns(k=values.key_of("kv"), v=values.int_value_of("kv"))
    return parse(pairs).groupBy("k").agg(F.sum("v").alias("total"))


@query("SELECT event_id, cast(json_extract(props,'$.k') AS int) AS k FROM events")
def json_project(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", values.json_fields("props", "k int")["k"].alias("k"))


@query("SELECT page_id, md5(url) AS h FROM pages")
def hash_key_md5(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", values.md5_key("url").alias("h"))


# ---- streams


@query("SELECT event_type, count(*) AS n, cast(sum(cast(round(value * 100) AS bigint)) AS bigint) AS cents FROM events GROUP BY event_type")
def stream_keyed_sum(spark, sf_dir):
    """The events as a stream of files, drained by a stateful sum."""
    name = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(name).schema
    folder, _, file = name.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(name if _is_dir(spark, name) else f"{folder}/{file[:-8]}*.parquet")
    return streams.keyed_sum(source, "event_type", F.round(F.col("value") * 100).cast("bigint"), staging_path(spark, "keyed-sum-state"), "cents")


def _is_dir(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


# ---- sinks, monitor, errors


@query("SELECT 'read' AS place, count(*) AS n FROM orders UNION ALL SELECT 'dear' AS place, count(*) AS n FROM orders WHERE o_totalprice > 300000.0")
def monitor_counts(spark, sf_dir):
    """Rows that passed two watched places of one flow, counted while a sink ran."""
    monitor = Monitor("orders")
    rows = monitor.watch(table(spark, sf_dir, "orders"), "read").filter("o_totalprice > 300000.0")
    monitor.watch(rows, "dear").write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(p, monitor.rows(p)) for p in ("read", "dear")], "place string, n bigint")


@query("SELECT count(*) AS n, cast(sum(o_orderkey) AS bigint) AS s FROM orders")
def bulk_roundtrip(spark, sf_dir):
    """All orders through an eager bulk sink, read back."""
    sink = BulkSink(TargetTable("orders", staging_path(spark, "bulk"), "orders"), eager=True)
    sink(table(spark, sf_dir, "orders").select("o_orderkey"))
    return sink.read(spark).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@query("SELECT 'failed' AS run, cast(0 AS bigint) AS n UNION ALL SELECT 'good' AS run, count(*) AS n FROM orders")
def whole_flow_rollback(spark, sf_dir):
    """A whole-flow sink whose hook fails publishes nothing; the next run publishes all rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    target = TargetTable("orders", staging_path(spark, "whole"), "orders")

    def fail(_target, _rows):
        raise RejectedRowError("induced")

    try:
        BulkSink(target, post_write=fail)(orders)
    except RejectedRowError:
        pass
    seen = {"failed": 0}
    path = f"{target.url}/{target.name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p) and len(fs.listStatus(p)):
        seen["failed"] = spark.read.option("recursiveFileLookup", "true").parquet(path).count()
    BulkSink(target)(orders)
    seen["good"] = BulkSink(target).read(spark).count()
    return spark.createDataFrame(list(seen.items()), "run string, n bigint")


@query("SELECT 'orders' AS target, CASE WHEN count(*) > 0 THEN 'failed' ELSE 'passed' END AS outcome FROM orders WHERE o_totalprice <= 300000.0")
def left_to_error(spark, sf_dir):
    """A flow whose router sends rows that are left to an error."""
    router = Router(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")).link("o_totalprice > 300000.0", name="dear").left_to_error()
    flow = Flow(spark, "left-to-error")
    flow.add(lambda: router.branch("dear").count(), "dear")
    try:
        flow.run()
        outcome = "passed"
    except Exception as e:
        if "a row was left that no link takes" not in str(e):
            raise
        outcome = "failed"
    return spark.createDataFrame([("orders", outcome)], "target string, outcome string")


@query("SELECT 0 AS line, '[events] entities: event(' || count(*) || ')' AS text FROM events UNION ALL SELECT 1 AS line, '[events] events: ' || string_agg(event_type || '(' || n || ')', ', ' ORDER BY event_type) AS text FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) t")
def dump_statistics(spark, sf_dir):
    """The recorder's text for the events."""
    r = Recorder("events").record(table(spark, sf_dir, "events"), F.lit("event"), "event_type")
    return spark.createDataFrame([(k, line) for k, line in enumerate(r.dump().split("\n"))], "line int, text string")


@query("SELECT v, count(*) AS n FROM nation CROSS JOIN (VALUES (1), (2), (3)) AS t(v) GROUP BY v")
def auto_complete(spark, sf_dir):
    """A counting loop through a directory that stops when nothing has come round for two seconds."""
    seed = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.lit(1).alias("v"))
    step = merge(map_columns(id="id", v="v + 1"), filtered("v < 4"))
    rows = streams.auto_complete(spark, seed, step, staging_path(spark, "ring"), 2.0, "id bigint, v int")
    return rows.groupBy("v").agg(F.count("*").alias("n"))


