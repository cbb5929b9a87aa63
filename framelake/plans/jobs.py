"""Queries over job ledgers, events, messages and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.fixtures import table
from framelake.functions import geometry as G
from framelake.functions import names as N
from framelake.operators import jobs as J

LEDGER_SCHEMA = "input string, output string, processed_images long, error_count long, output_size long, errors array<struct<entry:string,error:string>>"


def _jobs(spark, sf):
    return table(spark, sf, "fx_jobs")


def _messages(spark, sf):
    return table(spark, sf, "fx_messages")


def job_latest_state(spark, sf) -> DataFrame:
    e = table(spark, sf, "fx_job_events")
    return J.latest(e, "job_id", "ts", "seq").select("job_id", "seq", "state")


def job_audit_json(spark, sf) -> DataFrame:
    """One JSON document per job with its states in order, read back into counts."""
    e = table(spark, sf, "fx_job_events").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "state"))).alias("events"))
    doc = F.to_json(F.struct("job_id", "events", F.size("events").alias("n")))
    back = F.from_json(doc, "job_id string, events array<struct<seq:long,state:string>>, n long")
    return e.select(back.alias("b")).select("b.job_id", "b.n", F.size(F.filter("b.events", lambda x: x["state"] == "failed")).cast("long").alias("failed"), F.element_at("b.events", -1)["state"].alias("last"))


def ledger_scan(spark, sf) -> DataFrame:
    """Ledger lines parsed with an explicit schema; blank and torn lines are passed over."""
    j = _jobs(spark, sf)
    line = F.to_json(F.struct("input", "output", (F.col("job_idx") % 50).alias("processed_images"), (F.col("job_idx") % 4).alias("error_count"), "output_size"))
    line = F.when(F.col("job_idx") % 11 == 0, F.substring(line, 1, 30)).when(F.col("job_idx") % 13 == 0, "").otherwise(line)
    parsed = j.select(F.from_json(line, LEDGER_SCHEMA + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("l"), F.trim(line).alias("raw"))
    good = parsed.where("raw <> '' AND l._corrupt IS NULL AND l.input IS NOT NULL")
    return good.select("l.input", "l.output", "l.processed_images", "l.error_count", "l.output_size")


def ledger_build(spark, sf) -> DataFrame:
    """Ledger rows: duration, and the first ten errors of each archive."""
    e = table(spark, sf, "fx_entries")
    bad = F.when(F.col("size") > 100_000, F.struct("entry_idx", "path"))
    g = e.groupBy("archive_id").agg(F.count(F.lit(1)).alias("entries"), F.count(bad).alias("error_count"), F.slice(F.array_sort(F.collect_list(bad)), 1, 10).alias("errors"), F.greatest(F.lit(0), F.max("size") - 2 * F.min("size")).alias("duration_ms"))
    return g.select("archive_id", "entries", "error_count", F.array_join(F.transform("errors", lambda x: x["path"]), "|").alias("errors"), "duration_ms")


def _disk(spark, sf):
    j = _jobs(spark, sf)
    on = j.where("job_idx % 3 <> 0").select(F.col("output").alias("file"), F.col("output_size").alias("bytes"), "finished_at")
    stray = j.where("job_idx % 17 = 0").select(F.concat(F.lit("stray"), F.col("output")).alias("file"), "output_size", "finished_at")
    return on.union(stray)


def ledger_on_disk(spark, sf) -> DataFrame:
    j = _jobs(spark, sf).alias("j")
    return j.join(_disk(spark, sf).alias("d"), F.col("j.output") == F.col("d.file"), "left").select("j.job_idx", "j.output", F.col("d.file").isNotNull().alias("on_disk"))


def orphan_outputs(spark, sf) -> DataFrame:
    d = _disk(spark, sf)
    return d.join(_jobs(spark, sf), d.file == F.col("output"), "left_anti").orderBy(F.desc("finished_at"), "file").select("file", "bytes")


def ledger_rotate(spark, sf) -> DataFrame:
    """The newest 500 lines stay."""
    return _jobs(spark, sf).orderBy(F.desc("finished_at"), F.desc("job_idx")).limit(500).select("job_idx", "output")


def recent_jobs(spark, sf) -> DataFrame:
    return _jobs(spark, sf).orderBy(F.desc("finished_at"), F.desc("job_idx")).limit(20).select("job_idx", "output", "output_size")


def batch_totals(spark, sf) -> DataFrame:
    """Totals over archives, with hard errors counted besides the entries' own."""
    a = table(spark, sf, "fx_entries").agg(F.count_if(F.col("size") <= 100_000).alias("processed"), F.count_if(F.col("size") > 100_000).alias("entry_errors"))
    hard = _jobs(spark, sf).agg(F.count_if(F.col("st") == "F").alias("hard_errors"))
    return a.crossJoin(hard).select("processed", "entry_errors", "hard_errors", (F.col("entry_errors") + F.col("hard_errors")).alias("errors"))


def _files(spark, sf):
    return _jobs(spark, sf).select("job_idx", F.col("output_size").alias("length"), F.col("finished_at").alias("mtime"))


def _evicted(spark, sf):
    f = _files(spark, sf)
    return J.size_retention(f, 600_000_000, F.col("mtime") <= F.lit("2001-01-01").cast("timestamp_ntz"), ("mtime", "job_idx"))


def retention_size(spark, sf) -> DataFrame:
    return _evicted(spark, sf).select("job_idx", "length", "evicted")


def retention_report(spark, sf) -> DataFrame:
    e = F.col("evicted")
    return _evicted(spark, sf).agg(F.count_if(e).alias("deleted"), F.coalesce(F.sum(F.when(e, F.col("length"))), F.lit(0)).alias("freed"), F.count_if(~e).alias("remaining"), F.coalesce(F.sum(F.when(~e, F.col("length"))), F.lit(0)).alias("remaining_bytes"))


def keep_last_n(spark, sf) -> DataFrame:
    """All but the newest four files of a customer go."""
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("finished_at"), F.desc("job_idx")))
    return _jobs(spark, sf).withColumn("r", r).where("r > 4").select("job_idx", "o_custkey")


def queue_validate(spark, sf) -> DataFrame:
    m = _messages(spark, sf)
    key = F.when(F.col("seq") % 19 == 0, "  ").when(F.col("seq") % 23 == 0, "/abs.zip").otherwise(F.concat(F.lit(" "), F.get_json_object("body", "$.input_key")))
    trimmed = F.trim(key)
    ok = trimmed.isNotNull() & (trimmed != "") & ~trimmed.startswith("/")
    trusted = (F.col("seq") % 2 == 0) & (F.col("seq") % 5 == 0)
    return m.select("seq", F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, N.default_output_key(trimmed)).alias("output_key"), trusted.alias("delete_input"))


def queue_routing(spark, sf) -> DataFrame:
    return J.route(_messages(spark, sf).where("queue = 'rabbitmq'"), 4).select("seq", "route", "delay_ms")


def sqs_routing(spark, sf) -> DataFrame:
    return J.route(_messages(spark, sf).where("queue = 'sqs'"), 4).select("seq", "route")


def queue_metrics(spark, sf) -> DataFrame:
    """Counters per queue; a failure that ends in the dead letters counts as both."""
    r = F.col("route")
    failed = r.isin("dlq_attempts", "retry", "left_on_queue")
    return J.route(_messages(spark, sf), 4).groupBy("queue").agg(F.count(F.lit(1)).alias("received"), F.count_if(r == "completed").alias("completed"), F.count_if(failed).alias("failed"), F.count_if(r.startswith("dlq")).alias("dlq"))


def backoff(spark, sf) -> DataFrame:
    return _messages(spark, sf).select("seq", G.backoff_ms(F.col("attempts")).alias("delay_ms"))


def safe_job_id(spark, sf) -> DataFrame:
    return _messages(spark, sf).select("seq", N.safe_job_id(F.col("message_id")).alias("safe"))


def xdeath_attempts(spark, sf) -> DataFrame:
    """Attempts are the sum of the counts in an array of tables; entries without a number count nothing."""
    m = _messages(spark, sf)
    a = F.col("attempts").cast("string")
    header = F.concat(F.lit('[{"count":'), a, F.lit('},{"reason":"expired"},{"count":'), (F.col("seq") % 3).cast("string"), F.lit("}]"))
    counts = F.from_json(header, "array<struct<count:long,reason:string>>")
    return m.select("seq", F.aggregate(counts, F.lit(0).cast("long"), lambda t, x: t + F.coalesce(x["count"], F.lit(0))).alias("total"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_ROUTED = "r AS (SELECT *, CASE WHEN queue = 'rabbitmq' AND NOT (regexp_matches(message_id, '^[A-Za-z0-9._-]{1,128}$') AND NOT contains(message_id, '..')) THEN 'dlq_unsafe_id' WHEN NOT json_valid(body) THEN 'dlq_bad_body' WHEN NOT job_failed THEN 'completed' WHEN (queue = 'rabbitmq' AND attempts + 1 >= 4) OR (queue = 'sqs' AND attempts >= 4) THEN 'dlq_attempts' WHEN queue = 'rabbitmq' THEN 'retry' ELSE 'left_on_queue' END AS route FROM fx_messages)"
_BACKOFF = "CAST(least(5000 * pow(2, attempts), 300000) AS BIGINT)"
_DISK_SQL = "d AS (SELECT output AS file, output_size AS bytes, finished_at FROM fx_jobs WHERE job_idx % 3 <> 0 UNION ALL SELECT 'stray' || output, output_size, finished_at FROM fx_jobs WHERE job_idx % 17 = 0)"
_EVICT = "f AS (SELECT job_idx, output_size AS length, finished_at AS mtime, finished_at <= TIMESTAMP '2001-01-01' AS ok FROM fx_jobs), v AS (SELECT *, ok AND sum(length) OVER () - coalesce(sum(CASE WHEN ok THEN length ELSE 0 END) OVER (ORDER BY mtime, job_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 600000000 AS evicted FROM f)"

ORACLES = {
    "job_latest_state": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn FROM fx_job_events) SELECT job_id, seq, state FROM r WHERE rn = 1",
    "job_audit_json": "SELECT job_id, count(*) AS n, count(*) FILTER (WHERE state = 'failed') AS failed, arg_max(state, seq) AS last FROM fx_job_events GROUP BY 1",
    "ledger_scan": "SELECT input, output, job_idx % 50 AS processed_images, job_idx % 4 AS error_count, output_size FROM fx_jobs WHERE job_idx % 11 <> 0 AND job_idx % 13 <> 0",
    "ledger_build": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY archive_id, size > 100000 ORDER BY entry_idx) AS rn FROM fx_entries) SELECT archive_id, count(*) AS entries, count(*) FILTER (WHERE size > 100000) AS error_count, coalesce(string_agg(path, '|' ORDER BY entry_idx) FILTER (WHERE size > 100000 AND rn <= 10), '') AS errors, greatest(0, max(size) - 2 * min(size)) AS duration_ms FROM r GROUP BY 1",
    "ledger_on_disk": f"WITH {_DISK_SQL} SELECT job_idx, output, d.file IS NOT NULL AS on_disk FROM fx_jobs LEFT JOIN d ON output = d.file",
    "orphan_outputs": f"WITH {_DISK_SQL} SELECT file, bytes FROM d WHERE NOT EXISTS (SELECT 1 FROM fx_jobs j WHERE j.output = d.file)",
    "ledger_rotate": "SELECT job_idx, output FROM fx_jobs ORDER BY finished_at DESC, job_idx DESC LIMIT 500",
    "recent_jobs": "SELECT job_idx, output, output_size FROM fx_jobs ORDER BY finished_at DESC, job_idx DESC LIMIT 20",
    "batch_totals": "WITH a AS (SELECT count(*) FILTER (WHERE size <= 100000) AS processed, count(*) FILTER (WHERE size > 100000) AS entry_errors FROM fx_entries), h AS (SELECT count(*) FILTER (WHERE st = 'F') AS hard_errors FROM fx_jobs) SELECT *, entry_errors + hard_errors AS errors FROM a, h",
    "retention_size": f"WITH {_EVICT} SELECT job_idx, length, evicted FROM v",
    "retention_report": f"WITH {_EVICT} SELECT count(*) FILTER (WHERE evicted) AS deleted, CAST(coalesce(sum(length) FILTER (WHERE evicted), 0) AS BIGINT) AS freed, count(*) FILTER (WHERE NOT evicted) AS remaining, CAST(coalesce(sum(length) FILTER (WHERE NOT evicted), 0) AS BIGINT) AS remaining_bytes FROM v",
    "keep_last_n": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY finished_at DESC, job_idx DESC) AS r FROM fx_jobs) SELECT job_idx, o_custkey FROM r WHERE r > 4",
    "queue_validate": "WITH k AS (SELECT seq, CASE WHEN seq % 19 = 0 THEN '' WHEN seq % 23 = 0 THEN '/abs.zip' WHEN json_valid(body) THEN json_extract_string(CASE WHEN json_valid(body) THEN body ELSE '{}' END, '$.input_key') END AS key FROM fx_messages), o AS (SELECT *, coalesce(key <> '' AND key NOT LIKE '/%', false) AS ok FROM k) SELECT seq, ok, CASE WHEN ok THEN 'elaborati/' || regexp_extract(key, '([^/]*)\\.zip$', 1) || '_elaborato.zip' END AS output_key, seq % 10 = 0 AS delete_input FROM o",
    "queue_routing": f"WITH {_ROUTED} SELECT seq, route, CASE WHEN route = 'retry' THEN {_BACKOFF} END AS delay_ms FROM r WHERE queue = 'rabbitmq'",
    "sqs_routing": f"WITH {_ROUTED} SELECT seq, route FROM r WHERE queue = 'sqs'",
    "queue_metrics": f"WITH {_ROUTED} SELECT queue, count(*) AS received, count(*) FILTER (WHERE route = 'completed') AS completed, count(*) FILTER (WHERE route IN ('dlq_attempts', 'retry', 'left_on_queue')) AS failed, count(*) FILTER (WHERE route LIKE 'dlq%') AS dlq FROM r GROUP BY 1",
    "backoff": f"SELECT seq, {_BACKOFF} AS delay_ms FROM fx_messages",
    "safe_job_id": "SELECT seq, regexp_matches(message_id, '^[A-Za-z0-9._-]{1,128}$') AND NOT contains(message_id, '..') AS safe FROM fx_messages",
    "xdeath_attempts": "SELECT seq, attempts + seq % 3 AS total FROM fx_messages",
}
