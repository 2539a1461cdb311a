"""Stream queries: the event table read as a stream, run to its end, state read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfold.functions import text as tx
from wayfold.operators import folds
from wayfold.registry import logs
from wayfold.registry.base import AS_OF, BINDINGS, REGISTRY, micros, query
from wayfold.registry.texts import HMAC_KEY, INNER, OUTER
from wayfold.session import shared_folder
from wayfold.streaming import feeds, follow_ups, sinks


def event_stream(spark, root):
    """The events table as a file stream with the columns of the ``log`` binding."""
    schema = spark.read.parquet(f"{root}/events.parquet").schema
    # a pattern that fits this name alone: a stream may then start from one file as well as from a folder of part files
    raw = spark.readStream.schema(schema).parquet(f"{root}/events.parque[t]")
    return raw.selectExpr(*[f"{e} AS {c}" for c, e in BINDINGS["log"][1].items()])


def folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def run_to_state(spark, stream, keys):
    path = folder(spark)
    sinks.run_available(stream, f"{path}/checkpoint", sinks.change_log(f"{path}/rows"), "update")
    return sinks.current_state(spark, f"{path}/rows", keys)


@query("T1, S11, C4", f"""
WITH a AS (SELECT 'user' || entity || '@mail.example' AS addr, CASE type WHEN 'error' THEN 'Permanent bounce' WHEN 'click' THEN 'Spam complaint' WHEN 'signup' THEN 'Opt-out requested by recipient' END AS reason FROM log)
SELECT sha256(from_hex('{OUTER}') || from_hex(sha256(from_hex('{INNER}') || encode(addr)))) AS value_hash, min(reason) AS reason FROM a WHERE reason IS NOT NULL GROUP BY addr
""", "log")
def delivery_event_stream(spark, root):
    kinds = {"error": "bounce", "click": "spam_complaint", "signup": "unsubscribe", "view": "open", "purchase": "delivered"}
    events = event_stream(spark, root).select(
        "event_id", tx.lookup("type", kinds).alias("kind"), F.concat(F.lit("User"), "entity", F.lit("+tag@mail.example")).alias("address"),
        F.col("entity").cast("string").alias("target_id"), F.col("ts").alias("event_time"))
    rows = feeds.suppression_rows(feeds.delivery_outcomes(events), HMAC_KEY)
    path = folder(spark)
    register = sinks.Register(f"{path}/register", feeds.SUPPRESSION, feeds.SUPPRESSION_KEY, ["reason"])
    sinks.run_available(rows, f"{path}/checkpoint", register.write, "append")
    return register.rows(spark).select("value_hash", "reason")


@query("T3", """
SELECT entity, epoch_us(w) AS start_us, count(*) AS sends FROM (SELECT entity, unnest([date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) for k in range(0, 24)]) AS w FROM log) GROUP BY 1, 2
""", "log")
def send_volume_stream(spark, root):
    sends = event_stream(spark, root).select("entity", F.col("ts").alias("sent_at"))
    path = folder(spark)
    sinks.run_available(sends, f"{path}/checkpoint", sinks.deltas(f"{path}/rows", lambda batch: feeds.send_volume(batch, ["entity"])), "append")
    return sinks.summed(spark, f"{path}/rows", ["entity", "start"], ["sends"]).select("entity", micros("start").alias("start_us"), "sends")


@query("T5", REGISTRY["follow_up_due"].sql)
def follow_up_stream(spark, root):
    path = folder(spark)
    kind = F.when(F.col("type") == "signup", follow_ups.SEND).when(F.col("type") == "purchase", follow_ups.ANSWER)
    marks = event_stream(spark, root).select(F.col("entity").cast("string").alias("key"), kind.alias("kind"),
                                             F.col("event_id").alias("send_id"), F.col("ts").alias("at")).filter("kind IS NOT NULL")
    # a mark of the clock itself brings the stream to the time of the report
    clock = spark.range(1).select(F.lit(None).cast("string").alias("key"), F.lit("CLOCK").alias("kind"), F.lit(None).cast("long").alias("send_id"),
                                  F.expr(f"TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY + INTERVAL 1 SECOND").alias("at"))
    clock.write.parquet(f"{path}/clock")
    ticks = spark.readStream.schema(clock.schema).parquet(f"{path}/clock")
    follow_ups.run_follow_ups(marks.unionByName(ticks), path, days=1)
    due = follow_ups.open_follow_ups(spark, f"{path}/rows")
    out = due.select(F.col("key").cast("long").alias("entity"), F.col("send_id").alias("event_id"), (F.col("sent_us") + F.lit(86_400_000_000)).alias("due_us"))
    return out.filter(F.col("due_us") <= F.unix_micros(F.lit(AS_OF).cast("timestamp")))


@query("T4", REGISTRY["recontact_dates"].sql)
def recontact_stream(spark, root):
    kinds = {"purchase": "ACCEPT", "signup": "DECLINE", "click": "PLACE", "error": "OPT_OUT", "view": "TOUCH"}
    rows = event_stream(spark, root).withColumn("kind", tx.lookup("type", kinds))
    out = run_to_state(spark, folds.recontact_state(rows, ["entity"], ["ts", "event_id"], "ts"), ["entity"])
    return out.select("entity", "accepted_count", "declined_count", "placement_count", micros("last_contact_at").alias("last_us"),
                      micros("next_eligible_at").alias("next_us"))


@query("T6", REGISTRY["status_after_responses"].sql)
def target_status_stream(spark, root):
    rows = event_stream(spark, root).withColumn("kind", tx.lookup("type", logs.RESPONSE_KIND))
    return run_to_state(spark, folds.target_status(rows, ["entity"], ["ts", "event_id"]), ["entity"]).select("entity", "status")
