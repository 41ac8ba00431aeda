"""The audit log: hash-linked events, replay of feedback marks, verification in parallel.

The material of an event is its fields joined by a unit separator, numbers as whole millionths and times as whole
microseconds since 1970, so that any engine can hash it again. Linking new events is sequential by nature; it streams
through one task in the order of sequence numbers and holds one hash. Everything else is parallel.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrain.functions import fixed
from evigrain.functions.numbers import r10

SEPARATOR = "\x1f"


def marks(events: DataFrame, upto: int | None = None) -> DataFrame:
    """(unit_id, successes, failures, boost, suppressed) of each unit that any event concerns, replayed up to a sequence number.

    Acceptances and rejections are counted; the last suppression or its withdrawal holds. The boost is the Laplace
    estimate of acceptance about one half, a fifth of it. Events without a unit are left out.
    """
    e = events.where("unit_id is not null")
    if upto is not None:
        e = e.where(F.col("seq") <= upto)
    is_ = lambda t: F.col("event_type") == t
    flag = F.when(is_("mark.suppressed") | is_("mark.unsuppressed"), F.struct("seq", is_("mark.suppressed").alias("on")))
    m = e.groupBy("unit_id").agg(F.count_if(is_("feedback.accepted")).alias("successes"), F.count_if(is_("feedback.rejected")).alias("failures"), F.max(flag).alias("f"))
    utility = (F.col("successes") + 1) / (F.col("successes") + F.col("failures") + 2)
    boost = F.greatest(F.lit(-fixed.BOOST_LIMIT), F.least(F.lit(fixed.BOOST_LIMIT), (utility - 0.5) * fixed.BOOST_SCALE))
    return m.select("unit_id", "successes", "failures", r10(boost).alias("boost"), F.coalesce("f.on", F.lit(False)).alias("suppressed"))


def marks_as_of(events: DataFrame, event_id: str) -> DataFrame:
    """Marks replayed up to an event and with it; an unknown event means all of them."""
    at = events.where(F.col("event_id") == event_id).agg(F.max("seq").alias("at"))
    # one row that is joined by a constant: the bound of the replay
    e = events.withColumn("k", F.lit(1)).join(F.broadcast(at.withColumn("k", F.lit(1))), "k").where(F.col("at").isNull() | (F.col("seq") <= F.col("at")))
    return marks(e.drop("k", "at"))


def material(previous: Column) -> Column:
    """What is hashed of an event: id, type, unit, run, value, reason, payload, time, and the hash before it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    value = F.coalesce(F.round(F.col("value") * 1_000_000).cast("bigint").cast("string"), F.lit(""))
    time = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")).cast("string"), F.lit(""))
    return F.concat_ws(SEPARATOR, text("event_id"), text("event_type"), text("unit_id"), text("run_id"), value, text("reason"), text("payload"), time, previous)


def complete(events: DataFrame) -> DataFrame:
    """``events`` with run_id, reason and payload where they lack them."""
    for c in ("run_id", "reason", "payload"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("string"))
    return events


def link(events: DataFrame, head: str = fixed.GENESIS) -> DataFrame:
    """New events with prev_hash and event_hash, in the order of seq, the first one behind ``head``."""
    e = complete(events)
    fields = "seq bigint, body string"
    rows = e.select("seq", material(F.lit("")).alias("body")).coalesce(1).sortWithinPartitions("seq")

    def chain(batches):
        last = head
        for b in batches:
            prev, own = [], []
            for body in b.column(1).to_pylist():
                prev.append(last)
                last = hashlib.sha256((body + last).encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prev, pa.string()), pa.array(own, pa.string())], names=["seq", "prev_hash", "event_hash"])

    return e.join(rows.mapInArrow(chain, fields.replace("body string", "prev_hash string, event_hash string")), "seq")


def previous(rows: DataFrame, order: str, value: str, bucket: int = 100_000) -> DataFrame:
    """``rows`` with ``previous``: the value of the row before, by ``order`` over all rows, null for the first.

    Rows are compared within buckets of their number; only the last row of each bucket goes on to the next one that has rows.
    """
    b = rows.withColumn("_b", F.floor(F.col(order) / bucket))
    inside = Window.partitionBy("_b").orderBy(order)
    ends = b.groupBy("_b").agg(F.max_by(value, order).alias("last"))
    carried = ends.select("_b", F.lag("last").over(Window.orderBy("_b")).alias("carried"))
    first = F.row_number().over(inside) == 1
    return b.withColumn("_p", F.lag(value).over(inside)).withColumn("_f", first).join(carried, "_b").withColumn("previous", F.when(F.col("_f"), F.col("carried")).otherwise(F.col("_p"))).drop("_b", "_p", "_f", "carried")


def verify(events: DataFrame, units: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """(subject, record_id, error): every break of the log, of unit texts and of runs; no rows if all is sound.

    ``units`` has unit_id, content, content_hash; ``runs`` has run_id, transcript, metrics, and events of queries name
    both hashes in their payload.
    """
    e = previous(complete(events), "seq", "event_hash")
    before = F.coalesce("previous", F.lit(fixed.GENESIS))
    row = lambda df, s, i, m: df.select(F.lit(s).alias("subject"), F.col(i).alias("record_id"), F.lit(m).alias("error"))
    out = row(e.where(~F.col("prev_hash").eqNullSafe(before)), "event", "event_id", "previous hash mismatch")
    out = out.unionByName(row(e.where(~F.sha2(material(F.coalesce("prev_hash", F.lit(""))), 256).eqNullSafe(F.col("event_hash"))), "event", "event_id", "content hash mismatch"))
    if units is not None:
        out = out.unionByName(row(units.where(~F.sha2(F.coalesce("content", F.lit("")), 256).eqNullSafe(F.col("content_hash"))), "gene", "unit_id", "content hash mismatch"))
    if runs is not None:
        q = complete(events).where("event_type = 'query.transcribed'").select("event_id", "run_id", F.get_json_object("payload", "$.transcript_hash").alias("t"), F.get_json_object("payload", "$.metrics_hash").alias("m"))
        j = q.where("t is not null").join(runs.select("run_id", "transcript", "metrics", F.lit(True).alias("there")), "run_id", "left")
        out = out.unionByName(row(j.where("there is null"), "event", "event_id", "missing run"))
        for c, h in (("transcript", "t"), ("metrics", "m")):
            out = out.unionByName(row(j.where(F.col("there") & ~F.sha2(F.coalesce(c, F.lit("")), 256).eqNullSafe(F.col(h))), "run", "run_id", f"{c} hash mismatch"))
    return out


def feedback(selected: DataFrame, accepted: bool, reason: str = "explicit user feedback") -> DataFrame:
    """One event per selected unit of each run, numbered from 1 in the order of run and rank; to be linked behind a log."""
    kind, value = ("feedback.accepted", 1.0) if accepted else ("feedback.rejected", -1.0)
    key = F.sha2(F.concat_ws(SEPARATOR, F.lit(kind), "run_id", "unit_id"), 256)
    return selected.select(F.concat(F.lit("evt:"), F.substring(key, 1, 32)).alias("event_id"), F.lit(kind).alias("event_type"), "unit_id", "run_id", "rank", F.lit(value).alias("value"), F.lit(reason).alias("reason"))


def suppress(units: DataFrame, suppressed: bool, reason: str) -> DataFrame:
    """One event per unit that shows or hides it."""
    kind = "mark.suppressed" if suppressed else "mark.unsuppressed"
    return units.select(F.concat(F.lit("evt:"), F.substring(F.sha2(F.concat_ws(SEPARATOR, F.lit(kind), "unit_id"), 256), 1, 32)).alias("event_id"), F.lit(kind).alias("event_type"), "unit_id", F.lit(1.0 if suppressed else 0.0).alias("value"), F.lit(reason).alias("reason"))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row (rows, fingerprint) that tells two tables apart, whatever the order of their rows.

    The digests of the rows are summed in four parts, so nothing is collected or sorted; repeated rows count.
    """
    text = F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (columns or sorted(rows.columns))])
    h = rows.select(F.sha2(text, 256).alias("h"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("bigint")), F.lit(0)).alias(f"s{k}") for k in range(4)]
    return h.agg(F.count("*").alias("rows"), *parts).select("rows", F.sha2(F.concat_ws(SEPARATOR, "rows", *[f"s{k}" for k in range(4)]), 256).alias("fingerprint"))
