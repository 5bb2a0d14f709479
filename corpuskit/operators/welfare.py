"""State of annotators folded from an event log: assignments, opt-outs, the replacement queue, daily exposure.

Events are (event_id unique, ts, annotator_id, kind: assign, opt_out, reassign or expose, sentence_id, n); their order is
(ts, event_id). Folds are grouped maxima; gathered into arrays are only the opt-outs of an annotator and, to find invalid
reassignments, the releases and reassignments of a sentence, which are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOURS = 2


def _at(e: DataFrame) -> F.Column:
    return F.struct("ts", "event_id")


def open_assignments(events: DataFrame) -> DataFrame:
    """(annotator_id, sentence_id) assigned (or reassigned) after the annotator's last opt-out, each once."""
    out = events.where("kind = 'opt_out'").groupBy("annotator_id").agg(F.max(_at(events)).alias("_out"))
    got = events.where("kind in ('assign', 'reassign')").groupBy("annotator_id", "sentence_id").agg(F.max(_at(events)).alias("_got"))
    return got.join(out, "annotator_id", "left").where("_out is null or _got > _out").select("annotator_id", "sentence_id")


def opted_out(events: DataFrame) -> DataFrame:
    """(annotator_id, ts) of the first opt-out; the set is only recorded, later assignments to them stand."""
    return events.where("kind = 'opt_out'").groupBy("annotator_id").agg(F.min("ts").alias("ts"))


def released(events: DataFrame) -> DataFrame:
    """(annotator_id, sentence_id, at): what each opt-out takes from the annotator and puts into the queue: sentences
    assigned to them before it and after their opt-out before that."""
    got = events.where("kind in ('assign', 'reassign')").select("annotator_id", "sentence_id", _at(events).alias("_got"))
    outs = events.where("kind = 'opt_out'").groupBy("annotator_id").agg(F.array_sort(F.collect_set(_at(events))).alias("_outs"))
    j = got.join(outs, "annotator_id").withColumn("at", F.try_element_at(F.filter("_outs", lambda o: o > F.col("_got")), F.lit(1)))
    return j.where("at is not null").select("annotator_id", "sentence_id", "at").distinct()


def replacement_queue(events: DataFrame) -> DataFrame:
    """(sentence_id, ts): sentences released and not reassigned since, each once, from its first release since then."""
    into = released(events).select("sentence_id", "at")
    gone = events.where("kind = 'reassign'").groupBy("sentence_id").agg(F.max(_at(events)).alias("_gone"))
    q = into.join(gone, "sentence_id", "left").where("_gone is null or at > _gone")
    return q.groupBy("sentence_id").agg(F.min("at").alias("at")).select("sentence_id", F.col("at.ts").alias("ts"))


def invalid_reassignments(events: DataFrame) -> DataFrame:
    """(event_id, sentence_id) of reassignments of sentences that were not in the queue: no release since the reassignment
    before."""
    back = events.where("kind = 'reassign'").select("event_id", "sentence_id", _at(events).alias("_at"))
    before = back.groupBy("sentence_id").agg(F.array_sort(F.collect_set("_at")).alias("_all"))
    into = released(events).groupBy("sentence_id").agg(F.array_sort(F.collect_set("at")).alias("_into"))
    j = back.join(before, "sentence_id").join(into, "sentence_id", "left")
    last = F.array_max(F.filter("_all", lambda x: x < F.col("_at")))
    ok = F.exists("_into", lambda x: (x < F.col("_at")) & (last.isNull() | (x > last)))
    return j.where(~F.coalesce(ok, F.lit(False))).select("event_id", "sentence_id")


def daily_exposure(events: DataFrame, per_hour: int = 100) -> DataFrame:
    """(annotator_id, day, exposure, allowed): the amounts ``n`` of exposures a day, and whether more is allowed: below
    two hours' sentences."""
    e = events.where("kind = 'expose'").groupBy("annotator_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum("n").cast("long").alias("exposure"))
    return e.withColumn("allowed", F.col("exposure") < HOURS * per_hour)
