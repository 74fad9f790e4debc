import threading
import time

import pytest
from pyspark.sql import functions as F

from weir import errors
from weir.operators.lookup import Lookup
from weir.plans.flow import Action, Flow, Options, process
from weir.plans.monitor import Monitor, ProgressListener, log_rows
from weir.sources.readers import rows
from weir.sources.storage import staging_path
from weir.streaming import streams


def test_order_and_results():
    order, flow = [], Flow()
    a, b, c = (flow.add(Action(lambda k=k: order.append(k) or k, k)) for k in "abc")
    flow.depends(a, b, c)
    flow.depends(b, c)
    flow.depends(b, c)
    assert flow.run() == {"a": "a", "b": "b", "c": "c"} and order == ["c", "b", "a"]


def test_children_are_checked():
    flow, sub = Flow(name="top"), Flow(name="sub")
    flow.add(sub)
    with pytest.raises(ValueError):
        flow.add(sub)
    assert flow.add(sub, allow_duplicate=True) is sub and len(flow.children) == 1
    with pytest.raises(ValueError):
        sub.add(flow)
    with pytest.raises(ValueError):
        flow.add(flow)
    leaf = sub.add(lambda: 1, "leaf")
    assert flow.has(leaf) and not flow.has(Action(lambda: 1)) and sub.full_name == "[top]->[sub]"
    with pytest.raises(ValueError):
        flow.depends(sub, leaf)
    x, y = flow.add(lambda: 1, "x"), flow.add(lambda: 1, "y")
    flow.depends(x, y)
    with pytest.raises(ValueError):
        flow.depends(y, x)
    assert Flow().name != Flow().name
    with pytest.raises(errors.EmptyFlowError):
        Flow().run()


class Cleaning(Flow):
    def clean_up(self, error):
        self.cleaned = error


def test_failure_stops_the_rest():
    flow, ran = Cleaning(options=Options(parallelism=1)), []
    bad = flow.add(Action(lambda: 1 / 0, "bad"))
    after = flow.add(Action(lambda: ran.append("after"), "after"))
    flow.add(Action(lambda: ran.append("sibling"), "sibling"))
    flow.depends(after, bad)
    hooks = []
    flow.on_success(lambda: hooks.append("success"))
    flow.on_cancel(lambda: hooks.append("cancel"))
    with pytest.raises(ZeroDivisionError):
        flow.run()
    assert hooks == ["cancel"] and "after" not in ran and isinstance(flow.cleaned, ZeroDivisionError)
    assert isinstance(flow.failures["after"], errors.UpstreamFailedError)


def test_nested_failure_has_its_root():
    flow, sub = Flow(), Cleaning()
    flow.add(sub)
    sub.add(lambda: {}["missing"], "bad")
    with pytest.raises(KeyError):
        flow.run()
    assert isinstance(sub.cleaned, KeyError)
    wrapped = errors.SiblingFailedError("x")
    wrapped.__cause__ = KeyError("root")
    assert isinstance(errors.root_cause(ExceptionGroup("g", [errors.UpstreamFailedError("u"), ValueError("own")])), ValueError)
    assert isinstance(errors.root_cause(wrapped), KeyError)


def test_hooks_and_clean_up():
    flow, seen = Cleaning(), []
    flow.add(lambda: seen.append("child"), "child")
    flow.on_success(lambda: seen.append("hook"))
    flow.run()
    assert seen == ["child", "hook"] and flow.cleaned is None
    bad = Flow()
    bad.add(lambda: 1, "child")
    bad.on_success(lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        bad.run()


def test_cancel(spark):
    flow = Flow(spark)
    digest = F.sha2(F.col("id").cast("string"), 256)
    slow = spark.range(2_000_000_000, numPartitions=400).agg(F.max(digest))  # a task that runs may not notice, so tasks are short
    flow.add(lambda: slow.collect(), "slow")
    thread = flow.start()
    time.sleep(2)
    began = time.time()
    flow.cancel()
    thread.join(30)
    assert not thread.is_alive() and time.time() - began < 20 and isinstance(flow.error, errors.FlowCancelledError)


def test_process_and_monitor(spark):
    got = []
    assert process(spark, spark.range(7), lambda d: got.append(d.count()), lambda d: got.append(d.agg(F.sum("id")).first()[0])) == 7
    assert sorted(got) == [7, 21]
    reports = []
    mon = Monitor(verbose=True, on_report=reports.append)
    mon.watch(mon.watch(spark.range(7), "in").filter("id > 4"), "out").collect()
    assert mon.report() == {"in": 7, "out": 2} and reports == [{"in": 7, "out": 2}]
    log_rows(spark.range(3), "ids", "id")
    flow = Flow(spark, options=Options(monitor=True, interval_seconds=0))
    flow.add_sink(spark.range(5), lambda d: d.write.format("noop").mode("overwrite").save(), "five")
    flow.run()
    assert flow.monitor.rows("five") == 5 and flow.options.interval_seconds == 10
    assert threading.current_thread() is threading.main_thread()


def test_monitor_loop(spark):
    reports = []
    mon = Monitor(on_report=reports.append)
    assert process(spark, spark.range(7), lambda d: d.count()) == 7 and process(spark, spark.range(5), lambda d: None) == 5
    with mon.loop(0.1, spark):
        mon.watch(spark.range(3), "a").collect()
        assert mon.counted("a") == 3
        deadline = time.time() + 10
        while not reports and time.time() < deadline:
            time.sleep(0.05)
        mon.watch(spark.range(4), "b").collect()
        mon.watch(spark.range(4), "never")
    assert reports == [{"a": 3}, {"b": 4}] and mon.counted("never") is None
    flow = Flow(spark, options=Options(monitor=True, interval_seconds=0.05))
    got = []
    flow.monitor.on_report = got.append
    flow.add_sink(spark.range(6), lambda d: d.write.format("noop").mode("overwrite").save(), "six")
    flow.add(lambda: got.append(flow.busy), "busy")
    assert not flow.busy
    flow.run()
    assert {"six": 6} in got and True in got and not flow.busy


def test_lookup_stream_with_more_columns(spark, tmp_path):
    out = []
    stream = streams.LookupStream(Lookup("k", "dk", "sk"), str(tmp_path / "dim"), lambda d, n: out.extend(map(tuple, d.select("k", "sk", "note").collect())))
    stream.create(rows(spark, [(1, "a", "first")], "sk bigint, dk string, note string"))
    stream(rows(spark, [("a",), ("b",)], "k string"), 0)
    stream(rows(spark, [("b",), ("c",)], "k string"), 1)
    assert sorted(out, key=repr) == [("a", 1, "first"), ("b", 2, None), ("b", 2, None), ("c", 3, None)]


def test_streams(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    source = streams.read(spark, str(tmp_path / "in"), "id bigint", max_files=1)
    batches = []
    streams.drain(source, lambda d, n: batches.append(d.count()), str(tmp_path / "c1"))
    assert sum(batches) == 10 and len(batches) > 1
    again = []
    streams.drain(source, lambda d, n: again.append(d.count()), str(tmp_path / "c1"))
    assert sum(again) == 0
    total = streams.keyed_sum(source.withColumn("k", F.col("id") % 2), "k", F.col("id"), str(tmp_path / "c2"))
    assert sorted(map(tuple, total.collect())) == [(0, 5, 20), (1, 5, 25)]


def test_following_stops_when_idle(spark, tmp_path):
    listener = ProgressListener()
    spark.streams.addListener(listener)
    spark.range(3).write.parquet(str(tmp_path / "in"))
    seen = []
    q = streams.follow(streams.read(spark, str(tmp_path / "in"), "id bigint"), lambda d, n: seen.append(d.count()), str(tmp_path / "c"), seconds=0.2)
    streams.flush(q)
    spark.range(4).write.mode("append").parquet(str(tmp_path / "in"))
    streams.flush(q)
    assert sum(seen) == 7 and streams.stop_when_idle(q, 1.0) and not q.isActive
    assert not streams.stop_when_idle(q, 1.0)
    spark.streams.removeListener(listener)


def test_lookup_stream_replays_without_new_keys(spark, tmp_path):
    facts = str(tmp_path / "facts")
    rows(spark, [("a",), ("x",)], "k string").write.parquet(facts)
    out = []
    stream = streams.LookupStream(Lookup("k", "dk", "sk"), str(tmp_path / "dim"), lambda d, n: out.extend(map(tuple, d.select("k", "sk").collect())))
    stream.create(rows(spark, [(1, "a")], "sk bigint, dk string"))
    streams.drain(streams.read(spark, facts, "k string"), stream, str(tmp_path / "c"))
    rows(spark, [("x",), ("y",)], "k string").write.mode("append").parquet(facts)
    streams.drain(streams.read(spark, facts, "k string"), stream, str(tmp_path / "c"))
    assert sorted(out) == [("a", 1), ("x", 2), ("x", 2), ("y", 3)]
    batch = rows(spark, [("x",), ("y",)], "k string")
    stream(batch, 1)  # the second batch once more
    assert sorted(map(tuple, stream.dimension(spark).select("sk", "dk").collect())) == [(1, "a"), (2, "x"), (3, "y")]
    assert staging_path(spark, "a") != staging_path(spark, "a")
