"""Job ledgers, latest states, retention and queue routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import geometry as G
from framelake.functions import names as N
from framelake.operators.running import running_sums


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``. An aggregate, so a key of any number of rows is combined before the shuffle."""
    rest = [c for c in events.columns if c not in (key, *order)]
    return events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("s")).select(key, "s.*")


def size_retention(files: DataFrame, max_bytes: int, eligible: Column, order: tuple[str, ...]) -> DataFrame:
    """Adds ``evicted``: oldest first, eligible files go until the total is at most max_bytes; others are passed over.
    ``order`` begins with a time; sums are by its day."""
    total = files.agg(F.sum("length").alias("_total"))
    length = F.when(eligible, F.col("length")).otherwise(0)
    summed = running_sums(files, F.to_date(order[0]), order, _freed=length).join(F.broadcast(total))
    return summed.withColumn("evicted", eligible & (F.col("_total") - F.col("_freed") + length > max_bytes)).drop("_total", "_freed")


def retention(files: DataFrame, before: Column, max_bytes: int, eligible: Column, order: tuple[str, ...]) -> DataFrame:
    """Adds ``rule``: ``age`` for eligible files from before a time, then ``size`` for those that the size rule lets go of
    what is left, else null. 0 bytes turns the size rule off."""
    aged = eligible & (F.col(order[0]) < before)
    old, rest = files.where(aged).withColumn("rule", F.lit("age")), files.where(~F.coalesce(aged, F.lit(False)))
    if not max_bytes:
        return old.unionByName(rest.withColumn("rule", F.lit(None).cast("string")))
    sized = size_retention(rest, max_bytes, eligible, order)
    return old.unionByName(sized.withColumn("rule", F.when(F.col("evicted"), "size")).drop("evicted"))


def first_errors(errors: DataFrame, order: tuple[str, ...], most: int = 50) -> DataFrame:
    """One row (errors, header): how many there are, and the first ``most`` texts by ``order`` as a JSON list, percent-encoded
    for a header. ``errors`` has a column ``error``."""
    first = errors.orderBy(*order).limit(most).select(F.struct(*order, "error").alias("e"))
    texts = first.agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["error"]).alias("texts"))
    return errors.agg(F.count(F.lit(1)).alias("errors")).crossJoin(texts).select("errors", N.percent_encode(F.to_json("texts")).alias("header"))


def route(messages: DataFrame, max_attempts: int) -> DataFrame:
    """Adds ``job``, ``route`` and ``delay_ms`` to messages (queue, message_id, body, attempts, job_failed).

    rabbitmq: an unsafe id or a body that is no JSON object goes to the dead letters; a failure is tried again after a delay
    until the attempts are used up. sqs: a bad body is deleted; a failure stays on the queue until then."""
    key = F.trim(F.get_json_object("body", "$.input_key"))
    parsed = F.get_json_object("body", "$").isNotNull()
    rabbit = F.col("queue") == "rabbitmq"
    out_of = F.when(rabbit, F.col("attempts") + 1 >= max_attempts).otherwise(F.col("attempts") >= max_attempts)
    where = (
        F.when(rabbit & ~N.safe_job_id(F.col("message_id")), "dlq_unsafe_id")
        .when(~parsed, "dlq_bad_body")
        .when(~F.col("job_failed"), "completed")
        .when(out_of, "dlq_attempts")
        .otherwise(F.when(rabbit, "retry").otherwise("left_on_queue"))
    )
    delay = F.when(where == "retry", G.backoff_ms(F.col("attempts")))
    return messages.select("*", key.alias("input_key"), where.alias("route"), delay.alias("delay_ms"))
