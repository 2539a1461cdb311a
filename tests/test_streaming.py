import json
import os
import re

import pytest

from pyspark.sql import functions as F

from wayfold.operators import folds
from wayfold.sources.events import delivery_feed
from wayfold.streaming import feeds, follow_ups, sinks

KEY = b"stream key"


def drop(folder, name, events):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines(json.dumps(e) + "\n" for e in events)


def event(i, kind, address, at, target=None):
    return {"event_id": i, "kind": kind, "address": address, "target_id": target, "tenant_id": "t", "event_time": at}


def test_delivery_events_register_once(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    register = sinks.Register(f"{out}/register", feeds.SUPPRESSION, feeds.SUPPRESSION_KEY, ["reason"])

    def run():
        rows = feeds.suppression_rows(feeds.delivery_outcomes(delivery_feed(spark, src)), KEY)
        sinks.run_available(rows, f"{out}/checkpoint", register.write, "append")
        return {r["reason"] for r in register.rows(spark).collect()}, register.rows(spark).count()
    drop(src, "a", [event("1", "hard_bounce", "A@x.example", "2024-01-01T00:00:00Z"), event("1", "hard_bounce", "A@x.example", "2024-01-01T00:00:00Z"),
                    event("2", "open", "b@x.example", "2024-01-01T00:01:00Z")])
    assert run() == ({"Permanent bounce"}, 1)
    drop(src, "b", [event("3", "unsubscribe", "a+tag@x.example", "2024-01-01T02:00:00Z"), event("4", "spam_complaint", "c@x.example", "2024-01-01T02:00:00Z")])
    assert run() == ({"Permanent bounce", "Spam complaint"}, 2)  # the address is registered already


def test_an_opt_out_ten_days_late_is_registered(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    register = sinks.Register(f"{out}/register", feeds.SUPPRESSION, feeds.SUPPRESSION_KEY, ["reason"])
    for k, e in enumerate([event("1", "bounce", "a@x.example", "2024-01-01T00:00:00Z"), event("2", "open", "b@x.example", "2024-01-11T00:00:00Z"),
                           event("3", "unsubscribe", "c@x.example", "2024-01-01T00:00:00Z")]):
        drop(src, f"f{k}", [e])
        sinks.run_available(feeds.suppression_rows(feeds.delivery_outcomes(delivery_feed(spark, src)), KEY), f"{out}/checkpoint", register.write, "append")
    assert register.rows(spark).count() == 2


def registered(spark, path, buckets=64):
    return sinks.Register(path, feeds.SUPPRESSION, feeds.SUPPRESSION_KEY, ["reason"], buckets=buckets)


def addresses(spark, start, stop, reason="x"):
    return spark.createDataFrame([("t" if i % 3 else None, f"h{i}", "GLOBAL", reason) for i in range(start, stop)], feeds.SUPPRESSION)


@pytest.mark.parametrize("part", ["rows", "filters"])
def test_a_register_that_cannot_be_read_stops_the_batch(spark, tmp_path, part):
    register = registered(spark, str(tmp_path), buckets=1)
    register.write(addresses(spark, 0, 3), 0)
    for file in (tmp_path / part / "batch=0" / "bucket=0").glob("*.parquet"):
        file.write_bytes(b"no parquet")
    for file in (tmp_path / part / "batch=0" / "bucket=0").glob(".*.crc"):
        file.unlink()
    with pytest.raises(Exception):
        register.write(addresses(spark, 0, 3), 1)


def test_a_batch_reads_only_buckets_its_keys_may_be_in(spark, tmp_path):
    register = registered(spark, str(tmp_path))
    register.write(addresses(spark, 0, 3000), 0)
    assert len({p.name for p in (tmp_path / "rows" / "batch=0").glob("bucket=*")}) == 64

    def read(rows, batch):
        known = register.known(register._bucketed(rows), batch)
        plan = known._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) or "FileScan" not in plan  # other folders are not opened
        return {r[0].split("bucket=")[1].split("/")[0] for r in known.select("_metadata.file_path").distinct().collect()}
    some = addresses(spark, 100, 110)
    buckets = {str(r["bucket"]) for r in register._bucketed(some).collect()}
    assert read(some, 1) == buckets and len(buckets) <= 10
    assert read(addresses(spark, 5000, 5010), 1) == set()  # new keys: the filters rule them out
    register.write(addresses(spark, 2990, 3010, "later"), 1)
    got = register.rows(spark).collect()
    assert len(got) == 3010 and sum(r["reason"] == "later" for r in got) == 10


def test_a_saturated_filter_changes_nothing(spark, tmp_path):
    register = sinks.Register(str(tmp_path), feeds.SUPPRESSION, feeds.SUPPRESSION_KEY, ["reason"], buckets=4, bits=64, hashes=2)
    for batch in range(4):
        register.write(addresses(spark, 100 * batch, 100 * batch + 150).union(addresses(spark, 0, 5)), batch)
    got = sorted((r["value_hash"], r["tenant_id"]) for r in register.rows(spark).fillna("").collect())
    assert got == sorted((f"h{i}", "t" if i % 3 else "") for i in range(450))


def test_stream_queries_read_a_folder_of_part_files(spark, tmp_path):
    from wayfold.registry import load
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("delivery_event_stream", "recontact_stream"):
        got = sorted(map(str, load()[name].run(spark, str(tmp_path)).collect()))
        assert got and got == sorted(map(str, load()[name].run(spark, "/root/testdata/sf0.001").collect()))


def test_replayed_batch_replaces_itself(spark, tmp_path):
    register = registered(spark, str(tmp_path))
    rows = spark.createDataFrame([(None, "h", "GLOBAL", "x")], feeds.SUPPRESSION)
    for batch in (0, 0, 1):
        register.write(rows, batch)
    assert register.rows(spark).count() == 1
    register.write(rows.limit(0), 2)
    register.write(addresses(spark, 7, 8), 3)
    assert register.rows(spark).count() == 2


def test_outcomes_of_events(frame):
    df = frame([("bounce", "t"), ("complaint", "t"), ("opt_out", None), ("delivered", "t")], "kind string, target_id string")
    got = [(r["result"], r["response_kind"]) for r in feeds.delivery_outcomes(df).collect()]
    assert got == [("SUPPRESSED", "BOUNCE"), ("SUPPRESSED", None), ("SUPPRESSED", None), ("IGNORED", None)]


def test_folds_run_the_same_on_a_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = [{"k": f"k{i % 3}", "kind": ["TOUCH", "DECLINE", "ACCEPT", "OPT_OUT"][i % 4], "ts": f"2024-01-{i + 1:02d}T00:00:00Z", "seq": i} for i in range(20)]
    drop(src, "a", rows[:11])
    drop(src, "b", rows[11:])
    schema = "k string, kind string, ts timestamp, seq int"
    stream = folds.recontact_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src), ["k"], ["ts", "seq"], "ts")
    sinks.run_available(stream, f"{tmp_path}/cp", sinks.change_log(f"{tmp_path}/rows"), "update")
    got = sinks.current_state(spark, f"{tmp_path}/rows", ["k"])
    want = folds.recontact_state(spark.read.schema(schema).json(src), ["k"], ["ts", "seq"], "ts")
    cols = sorted(want.columns)
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_late_sends_correct_the_volume(spark, tmp_path):
    src = f"{tmp_path}/in"
    schema = "entity string, sent_at timestamp"

    def run():
        sends = spark.readStream.schema(schema).json(src)
        sinks.run_available(sends, f"{tmp_path}/cp", sinks.deltas(f"{tmp_path}/rows", lambda b: feeds.send_volume(b, ["entity"])), "append")
        return sinks.summed(spark, f"{tmp_path}/rows", ["entity", "start"], ["sends"])
    drop(src, "a", [{"entity": "e", "sent_at": "2024-01-10T00:30:00Z"}])
    assert run().count() == 24
    drop(src, "b", [{"entity": "e", "sent_at": "2024-01-10T01:30:00Z"}, {"entity": "e", "sent_at": "2024-01-01T00:00:00Z"}])
    state = run()
    assert state.agg(F.max("sends")).first()[0] == 2 and state.filter("start < '2024-01-05'").count() == 24
    want = feeds.send_volume(spark.read.schema(schema).json(src), ["entity"])
    assert sorted(map(tuple, state.select("start", "sends").collect())) == sorted(map(tuple, want.select("start", "sends").collect()))


MARKS = "key string, kind string, send_id long, at timestamp"


def mark(key, kind, at, send=None):
    return {"key": key, "kind": kind, "send_id": send, "at": at}


def follow(spark, tmp_path, **options):
    stream = spark.readStream.schema(MARKS).json(f"{tmp_path}/in")
    progress = follow_ups.run_follow_ups(stream, str(tmp_path), **options)
    changes = spark.read.parquet(f"{tmp_path}/rows")
    return (sorted((r["key"], r["send_id"], r["op"]) for r in changes.collect()) if changes.columns else [],
            sorted((r["key"], r["send_id"]) for r in follow_ups.open_follow_ups(spark, f"{tmp_path}/rows").collect()), progress)


def test_a_follow_up_is_due_when_its_window_has_passed_and_taken_back_by_a_late_answer(spark, tmp_path):
    src = f"{tmp_path}/in"
    drop(src, "a", [mark("a", "SEND", "2024-01-01T00:00:00Z", 1), mark("a", "ANSWER", "2024-01-03T00:00:00Z"), mark("b", "SEND", "2024-01-01T00:00:00Z", 2),
                    mark("c", "SEND", "2024-01-01T00:00:00Z", 3), mark("c", "SEND", "2024-01-09T00:00:00Z", 4)])
    assert follow(spark, tmp_path)[:2] == ([], [])
    drop(src, "b", [mark(None, "CLOCK", "2024-01-20T00:00:00Z")])  # the watermark passes January 15
    assert follow(spark, tmp_path)[1] == [("b", 2), ("c", 3)]
    drop(src, "c", [mark("b", "ANSWER", "2024-01-21T00:00:00Z")])  # after it was due
    changes, still, _ = follow(spark, tmp_path)
    assert ("b", 2, "RETRACTED") in changes and still == [("c", 3)]
    drop(src, "d", [mark(None, "CLOCK", "2024-02-01T00:00:00Z")])
    assert follow(spark, tmp_path)[1] == [("c", 3), ("c", 4)]


def test_a_send_that_arrives_after_its_answer_is_not_due(spark, tmp_path):
    drop(f"{tmp_path}/in", "a", [mark("a", "ANSWER", "2024-01-03T00:00:00Z")])
    follow(spark, tmp_path)
    drop(f"{tmp_path}/in", "b", [mark("a", "SEND", "2024-01-03T00:00:00Z", 1), mark("a", "SEND", "2024-01-04T00:00:00Z", 2), mark(None, "CLOCK", "2024-03-01T00:00:00Z")])
    assert follow(spark, tmp_path)[1] == [("a", 2)]


def test_state_of_a_year_of_sends_stays_bounded(spark, tmp_path):
    """Twelve months, 40 sends each, two thirds answered: state holds the open window and what may still be taken back."""
    sizes = []
    for half in range(6):
        rows = []
        for month in (2 * half + 1, 2 * half + 2):
            rows += [mark(f"k{i % 20}", "SEND", f"2024-{month:02d}-{1 + i % 20:02d}T00:00:00Z", 100 * month + i) for i in range(40)]
            rows += [mark(f"k{i}", "ANSWER", f"2024-{month:02d}-25T00:00:00Z") for i in range(13)]
        drop(f"{tmp_path}/in", f"m{half}", rows)
        progress = follow(spark, tmp_path, kept=30)[2]
        sizes.append(json.loads(progress[-1].json)["stateOperators"][0]["numRowsTotal"] if hasattr(progress[-1], "json") else progress[-1]["stateOperators"][0]["numRowsTotal"])
    assert max(sizes[3:]) <= 1.2 * max(sizes[1:3])
    drop(f"{tmp_path}/in", "z", [mark(None, "CLOCK", "2025-06-01T00:00:00Z")])
    follow(spark, tmp_path, kept=30)
    drop(f"{tmp_path}/in", "zz", [mark(None, "CLOCK", "2025-09-01T00:00:00Z")])
    changes, still, progress = follow(spark, tmp_path, kept=30)
    assert json.loads(progress[-1].json)["stateOperators"][0]["numRowsTotal"] == 0
    assert len(still) == 12 * 14 == len([c for c in changes if c[2] == "DUE"]) - len([c for c in changes if c[2] == "RETRACTED"])
