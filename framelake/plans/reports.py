"""Queries over logs, classifier samples and small grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.fixtures import table
from framelake.functions import names as N
from framelake.operators import gates as K
from framelake.operators.running import running_sums

LOG = r"^(\d{4}-\d{2}-\d{2})T(\S+)Z\s+(INFO|WARN|ERROR)\s+(\S+):\s+(.*)$"
EVENT = r"camera .+ (INITIAL|LEARNING|ACTIVE)|ROI (extracted|validation failed|re-adopted|kept|replaced)|not enough detection data|ROI finalization|to LEARNING|operator reset camera"
STEPS = (0.1, 0.25, 0.5, 0.6, 0.75, 0.9)


def _log(spark, sf):
    part = lambda k: F.regexp_extract("line", LOG, k)
    lines = table(spark, sf, "fx_log_lines").select("seq", part(1).alias("day"), part(2).alias("time"), part(3).alias("level"), part(5).alias("message"))
    return lines.where((F.col("day") != "") & ((F.col("level") == "ERROR") | F.col("message").rlike(EVENT)))


def _samples(spark, sf):
    return table(spark, sf, "fx_samples")


def log_events_daily(spark, sf) -> DataFrame:
    return _log(spark, sf).groupBy("day").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("level") == "ERROR").alias("errors"))


def log_top5(spark, sf) -> DataFrame:
    """The first five events of a day, and how many others there are."""
    e = _log(spark, sf).select("day", "time", "seq", "level")
    others = e.groupBy("day").agg(F.greatest(F.count(F.lit(1)) - 5, F.lit(0)).alias("others"))
    # a rank with a literal limit is cut to five rows a day and task before the shuffle
    first = e.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy("time", "seq"))).where("r <= 5")
    return first.join(others, "day").select("day", "seq", "level", F.col("r").cast("long").alias("r"), "others")


def perf_timing_avg(spark, sf) -> DataFrame:
    """Mean stage times out of log lines with terminal colours."""
    s = F.col("seq")
    line = F.concat(F.lit("\x1b[32mINFO\x1b[0m image done decode_ms="), (s % 40).cast("string"), F.lit(".5 process_ms=\x1b[1m"), (s % 900).cast("string"), F.lit("\x1b[0m encode_ms="), (s % 70).cast("string"), F.lit(" total_ms="), (s % 1000).cast("string"), F.lit(" detect="), (s % 6).cast("string"))
    clean = F.regexp_replace(line, "\x1b\\[[0-9;]*m", "")
    v = table(spark, sf, "fx_log_lines").select(*[F.regexp_extract(clean, rf"{n}=([\d.]+)", 1).cast("double").alias(n) for n in ("decode_ms", "process_ms", "encode_ms", "total_ms", "detect")])
    return v.agg(F.count(F.lit(1)).alias("lines"), *[F.round(F.avg(c), 6).alias(c) for c in v.columns])


def log_safe(spark, sf) -> DataFrame:
    return table(spark, sf, "fx_log_lines").select("seq", N.log_safe(F.concat(F.col("line"), F.lit("\r\n\x1b[0m"))).alias("line"))


def _sets(spark, sf):
    """a: clear faces, b: small faces, c: background."""
    real = F.col("is_real") == 1
    t = K.threshold_table(_samples(spark, sf).withColumn("p", F.greatest("p_candidate", F.when(real, 0.3).otherwise(0.0))), "p", STEPS, real & (F.col("n_chars") >= 500), real & (F.col("n_chars") < 500), ~real)
    return t


def threshold_table(spark, sf) -> DataFrame:
    return _sets(spark, sf).select("thr", *[F.round(c, 9).alias(c) for c in ("recall_a", "recall_b", "accuracy")], "fp_c")


def recommended_threshold(spark, sf) -> DataFrame:
    return K.recommended(_sets(spark, sf), 0.98, 0.95)


def holdout_sample(spark, sf) -> DataFrame:
    return K.first_per_class(_samples(spark, sf), "is_real", "path", 60).select("sample_id", "path", "is_real")


def holdout_accuracy(spark, sf) -> DataFrame:
    h = K.first_per_class(_samples(spark, sf), "is_real", "path", 60)
    ok = (F.col("p_candidate") >= 0.5) == (F.col("is_real") == 1)
    return h.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok.cast("double")), 9).alias("accuracy"))


def holdout_split(spark, sf) -> DataFrame:
    """A fifth of the samples, rounded half to even and at least one, is held out, in a fixed mixed order."""
    s = _samples(spark, sf)
    n = s.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * 0.2, 0).cast("long")).alias("n_val"))
    return running_sums(s, F.col("sample_id") * 7919 % 1009, ("sample_id",), r=F.lit(1)).crossJoin(F.broadcast(n)).select("sample_id", (F.col("r") <= F.col("n_val")).alias("held_out"))


def class_balance(spark, sf) -> DataFrame:
    return K.class_balance(_samples(spark, sf), "is_real", "sample_id", 1.5, F.col("sample_id") * 7919 % 1009).groupBy("is_real").agg(F.count(F.lit(1)).alias("kept"), F.sum("sample_id").alias("ids"))


def retrain_eligibility(spark, sf) -> DataFrame:
    """Classes with their sizes, and whether every class has two samples."""
    c = _samples(spark, sf).groupBy(F.col("is_real").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("class", "n", (F.min("n").over(Window.partitionBy()) >= 2).alias("eligible"))


def _runs(spark, sf):
    """A retraining run per hundred sample ids."""
    s = _samples(spark, sf)
    right = lambda c: F.avg(((F.col(c) >= 0.5) == (F.col("is_real") == 1)).cast("double"))
    return s.groupBy(F.floor(F.col("sample_id") / 100).alias("run")).agg(F.count_if(F.col("is_real") == 1).alias("real"), F.count_if(F.col("is_real") == 0).alias("fp"), F.round(right("p_candidate") + 0.35, 9).alias("candidate"), F.round(right("p_deployed") + 0.36, 9).alias("deployed"))


def retrain_decision(spark, sf) -> DataFrame:
    r = _runs(spark, sf)
    c = F.col
    return r.select("run", K.swap_decision(c("real"), c("fp"), c("candidate"), c("candidate") - 0.01, F.when(c("run") % 4 != 0, c("deployed")), 0.85, 0.0).alias("decision"))


def retrain_alert(spark, sf) -> DataFrame:
    d = retrain_decision(spark, sf)
    return d.agg(F.max_by("decision", "run").alias("latest")).select("latest", (F.col("latest").startswith("rejected") | (F.col("latest") == "failed")).alias("alert"))


def ab_gate(spark, sf) -> DataFrame:
    """Each run against the last one accepted before it."""
    r = _runs(spark, sf).withColumn("accepted", F.col("candidate") >= 0.85).withColumn("block", F.floor(F.col("run") / 1000))
    good, up_to = F.when(F.col("accepted"), F.col("candidate")), (Window.unboundedPreceding, -1)
    # the last accepted run of each thousand, carried over the thousands; only those are in one place
    ends = r.groupBy("block").agg(F.max_by(good, F.when(F.col("accepted"), F.col("run"))).alias("end"))
    carried = ends.select("block", F.last("end", ignorenulls=True).over(Window.orderBy("block").rowsBetween(*up_to)).alias("carried"))
    within = F.last(good, ignorenulls=True).over(Window.partitionBy("block").orderBy("run").rowsBetween(*up_to))
    r = r.withColumn("within", within).join(carried, "block")
    prev = F.coalesce("within", "carried")
    return r.select("run", "candidate", prev.alias("baseline"), (F.col("accepted") & (prev.isNull() | (F.col("candidate") >= prev))).alias("swap"))


def classifier_gate(spark, sf) -> DataFrame:
    """Without a score a face stays."""
    p = F.when(F.col("sample_id") % 10 != 0, F.col("p_candidate"))
    return _samples(spark, sf).groupBy("is_real").agg(F.count_if(F.coalesce(p >= 0.25, F.lit(True))).alias("kept"), F.count(F.lit(1)).alias("n"))


def softmax2(spark, sf) -> DataFrame:
    a, b = F.col("p_candidate") * 6 - 3, F.col("p_deployed") * 6 - 3
    m = F.greatest(a, b)
    p = F.exp(b - m) / (F.exp(a - m) + F.exp(b - m))
    return _samples(spark, sf).select("sample_id", F.round(1 - p, 9).alias("p_fp"), F.round(p, 9).alias("p_face"), F.round(1 / (1 + F.exp(-a)), 9).alias("sigmoid"))


def _history(spark, sf):
    """Points of candidates and of deployed models, one per time and kind."""
    r = _runs(spark, sf)
    c = r.select((F.col("run") * 7 % 40).alias("at"), F.lit("candidate").alias("kind"), F.col("candidate").alias("acc"))
    d = r.where("run % 4 <> 0").select((F.col("run") * 7 % 40).alias("at"), F.lit("active").alias("kind"), F.col("deployed").alias("acc"))
    return c.unionByName(d).groupBy("at", "kind").agg(F.min("acc").alias("acc"))


def accuracy_history(spark, sf) -> DataFrame:
    return _history(spark, sf)


def _last12(spark, sf):
    h = _history(spark, sf)
    return h.withColumn("r", F.row_number().over(Window.orderBy(F.desc("at"), F.desc("kind")))).where("r <= 12").drop("r")


def accuracy_last12(spark, sf) -> DataFrame:
    return _last12(spark, sf).orderBy("at", "kind")


def accuracy_bars(spark, sf) -> DataFrame:
    """Bars of at most 40 signs on a scale that ends at twentieths and spans one at least."""
    h = _last12(spark, sf)
    w = Window.partitionBy()
    low, high = F.floor(F.min("acc").over(w) * 20) / 20, F.ceil(F.max("acc").over(w) * 20) / 20
    h = h.select("at", "kind", "acc", low.alias("low0"), high.alias("high"))
    h = h.withColumn("low", F.when(F.col("high") - F.col("low0") < 0.05, F.greatest(F.lit(0.0), F.col("high") - 0.05)).otherwise(F.col("low0")))
    n = F.floor((F.col("acc") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(0.0001)) * 40 + 0.5)
    return h.select("at", "kind", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.repeat(F.lit("#"), F.least(F.greatest(n, F.lit(1)), F.lit(40)).cast("int")).alias("bar"))


def mosaic(spark, sf) -> DataFrame:
    """Blocks of 7 x 7 pixels become their mean, in whole numbers."""
    p = _grid(spark)
    m = F.expr("sum(v) div count(1)")
    return p.groupBy(F.floor(F.col("x") / 7).alias("bx"), F.floor(F.col("y") / 7).alias("by")).agg(m.alias("mean"))


def _grid(spark):
    return spark.range(40 * 30).select((F.col("id") % 40).alias("x"), F.floor(F.col("id") / 40).alias("y"), (F.col("id") * 7919 % 256).alias("v"))


def box_blur_1d(spark, sf) -> DataFrame:
    """Means over 5 pixels across, then over 5 down, cut at the edges, rounded down both times."""
    wx = Window.partitionBy("y").orderBy("x").rowsBetween(-2, 2)
    wy = Window.partitionBy("x").orderBy("y").rowsBetween(-2, 2)
    h = _grid(spark).select("x", "y", F.floor(F.sum("v").over(wx) / F.count("v").over(wx)).alias("v"))
    return h.select("x", "y", F.floor(F.sum("v").over(wy) / F.count("v").over(wy)).alias("v"))


def dfl_decode(spark, sf) -> DataFrame:
    """The expected bin of 16 under a softmax."""
    g = spark.range(500).select("id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: ((F.col("id") * 31 + k * 17) % 23).cast("double") / 4).alias("z"))
    m = F.array_max("z")
    e = F.transform("z", lambda v: F.exp(v - m))
    total = F.aggregate(e, F.lit(0.0), lambda t, v: t + v)
    top = F.aggregate(F.zip_with(e, F.sequence(F.lit(0), F.lit(15)), lambda v, k: v * k), F.lit(0.0), lambda t, v: t + v)
    return g.select("id", F.round(top / total, 9).alias("distance"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_LOG_SQL = "l AS (SELECT seq, regexp_extract(line, '^(\\d{4}-\\d{2}-\\d{2})T', 1) AS day, regexp_extract(line, 'T(\\S+)Z', 1) AS time, regexp_extract(line, 'Z\\s+(INFO|WARN|ERROR)', 1) AS level, regexp_extract(line, 'svc::mod: (.*)$', 1) AS message FROM fx_log_lines), e AS (SELECT * FROM l WHERE level = 'ERROR' OR regexp_matches(message, '" + EVENT + "'))"
_TABLE = "s AS (SELECT is_real = 1 AND n_chars >= 500 AS a, is_real = 1 AND n_chars < 500 AS b, is_real <> 1 AS c, greatest(p_candidate, CASE WHEN is_real = 1 THEN 0.3 ELSE 0 END) AS p FROM fx_samples), h AS (SELECT CAST(unnest([0.1, 0.25, 0.5, 0.6, 0.75, 0.9]) AS DOUBLE) AS thr), t AS (SELECT thr, count(*) FILTER (WHERE a AND p >= thr) / count(*) FILTER (WHERE a) AS recall_a, CASE WHEN count(*) FILTER (WHERE b) > 0 THEN count(*) FILTER (WHERE b AND p >= thr) / count(*) FILTER (WHERE b) END AS recall_b, count(*) FILTER (WHERE c AND p >= thr) AS fp_c, count(*) FILTER (WHERE (a AND p >= thr) OR (c AND p < thr)) / count(*) FILTER (WHERE a OR c) AS accuracy FROM s, h GROUP BY 1)"
_HOLD = "h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY is_real ORDER BY path) AS r FROM fx_samples) x WHERE r <= 60)"
_RUNS = "r AS (SELECT sample_id // 100 AS run, count(*) FILTER (WHERE is_real = 1) AS real, count(*) FILTER (WHERE is_real = 0) AS fp, round(avg(CASE WHEN (p_candidate >= 0.5) = (is_real = 1) THEN 1.0 ELSE 0.0 END) + 0.35, 9) AS candidate, round(avg(CASE WHEN (p_deployed >= 0.5) = (is_real = 1) THEN 1.0 ELSE 0.0 END) + 0.36, 9) AS deployed FROM fx_samples GROUP BY 1)"
_DECIDE = "d AS (SELECT run, CASE WHEN real < 2 OR fp < 2 THEN 'skipped' WHEN candidate < 0.85 THEN 'rejected_python' WHEN candidate - 0.01 < 0.85 THEN 'rejected_validation' WHEN run % 4 <> 0 AND candidate - 0.01 < deployed - 0.0 THEN 'rejected_regression' ELSE 'swapped' END AS decision FROM r)"
_HIST = "p AS (SELECT run*7%40 AS pos, 'candidate' AS kind, candidate AS acc FROM r UNION ALL SELECT run*7%40, 'active', deployed FROM r WHERE run % 4 <> 0), h AS (SELECT pos AS \"at\", kind, min(acc) AS acc FROM p GROUP BY 1, 2), k AS (SELECT \"at\", kind, acc FROM h ORDER BY \"at\" DESC, kind DESC LIMIT 12)"
_GRID_SQL = "g AS (SELECT id % 40 AS x, id // 40 AS y, id * 7919 % 256 AS v FROM range(1200) r(id))"

ORACLES = {
    "log_events_daily": f"WITH {_LOG_SQL} SELECT day, count(*) AS events, count(*) FILTER (WHERE level = 'ERROR') AS errors FROM e GROUP BY 1",
    "log_top5": f"WITH {_LOG_SQL}, r AS (SELECT day, seq, level, row_number() OVER (PARTITION BY day ORDER BY time, seq) AS r, greatest(count(*) OVER (PARTITION BY day) - 5, 0) AS others FROM e) SELECT * FROM r WHERE r <= 5",
    "perf_timing_avg": "SELECT count(*) AS lines, round(avg(seq % 40 + 0.5), 6) AS decode_ms, round(avg(seq % 900), 6) AS process_ms, round(avg(seq % 70), 6) AS encode_ms, round(avg(seq % 1000), 6) AS total_ms, round(avg(seq % 6), 6) AS detect FROM fx_log_lines",
    "log_safe": "SELECT seq, line || '???[0m' AS line FROM fx_log_lines",
    "threshold_table": f"WITH {_TABLE} SELECT thr, round(recall_a, 9) AS recall_a, round(recall_b, 9) AS recall_b, round(accuracy, 9) AS accuracy, fp_c FROM t",
    "recommended_threshold": f"WITH {_TABLE}, o AS (SELECT thr, bool_and(round(recall_a, 4) >= 0.98 AND coalesce(round(recall_b, 4) >= 0.95, true)) OVER (ORDER BY thr) AS ok FROM t) SELECT coalesce(max(CASE WHEN ok THEN thr END), 0.5) AS threshold FROM o",
    "holdout_sample": f"WITH {_HOLD} SELECT sample_id, path, is_real FROM h",
    "holdout_accuracy": f"WITH {_HOLD} SELECT count(*) AS n, round(avg(CASE WHEN (p_candidate >= 0.5) = (is_real = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM h",
    "holdout_split": "WITH n AS (SELECT greatest(1, CAST(round_even(count(*) * 0.2, 0) AS BIGINT)) AS n FROM fx_samples), r AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id * 7919 % 1009, sample_id) AS r FROM fx_samples) SELECT sample_id, r <= n AS held_out FROM r, n",
    "class_balance": "WITH n AS (SELECT greatest(2, CAST(round_even(min(c) * 1.5, 0) AS BIGINT)) AS cap FROM (SELECT count(*) AS c FROM fx_samples GROUP BY is_real) x), r AS (SELECT is_real, sample_id, row_number() OVER (PARTITION BY is_real ORDER BY sample_id * 7919 % 1009, sample_id) AS r FROM fx_samples) SELECT is_real, count(*) AS kept, CAST(sum(sample_id) AS BIGINT) AS ids FROM r, n WHERE r <= cap GROUP BY 1",
    "retrain_eligibility": "SELECT is_real AS class, count(*) AS n, min(count(*)) OVER () >= 2 AS eligible FROM fx_samples GROUP BY 1",
    "retrain_decision": f"WITH {_RUNS}, {_DECIDE} SELECT run, decision FROM d",
    "retrain_alert": f"WITH {_RUNS}, {_DECIDE}, l AS (SELECT arg_max(decision, run) AS latest FROM d) SELECT latest, latest LIKE 'rejected%' OR latest = 'failed' AS alert FROM l",
    "ab_gate": f"WITH {_RUNS}, b AS (SELECT run, candidate, last_value(CASE WHEN candidate >= 0.85 THEN candidate END IGNORE NULLS) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM r) SELECT run, candidate, baseline, candidate >= 0.85 AND (baseline IS NULL OR candidate >= baseline) AS swap FROM b",
    "classifier_gate": "SELECT is_real, count(*) FILTER (WHERE sample_id % 10 = 0 OR p_candidate >= 0.25) AS kept, count(*) AS n FROM fx_samples GROUP BY 1",
    "softmax2": "WITH z AS (SELECT sample_id, p_candidate*6-3 AS a, p_deployed*6-3 AS b FROM fx_samples) SELECT sample_id, round(1 - exp(b-greatest(a,b))/(exp(a-greatest(a,b))+exp(b-greatest(a,b))), 9) AS p_fp, round(exp(b-greatest(a,b))/(exp(a-greatest(a,b))+exp(b-greatest(a,b))), 9) AS p_face, round(1/(1+exp(-a)), 9) AS sigmoid FROM z",
    "accuracy_history": f"WITH {_RUNS}, {_HIST} SELECT * FROM h",
    "accuracy_last12": f"WITH {_RUNS}, {_HIST} SELECT * FROM k",
    "accuracy_bars": f"WITH {_RUNS}, {_HIST}, m AS (SELECT floor(min(acc)*20)/20 AS low0, ceil(max(acc)*20)/20 AS high FROM k), s AS (SELECT CASE WHEN high - low0 < 0.05 THEN greatest(0, high - 0.05) ELSE low0 END AS low, high FROM m) SELECT \"at\", kind, round(low, 6) AS low, round(high, 6) AS high, repeat('#', CAST(least(greatest(floor((acc-low)/greatest(high-low, 0.0001)*40+0.5), 1), 40) AS BIGINT)) AS bar FROM k, s",
    "mosaic": f"WITH {_GRID_SQL} SELECT x // 7 AS bx, y // 7 AS by, CAST(sum(v) // count(*) AS BIGINT) AS mean FROM g GROUP BY 1, 2",
    "box_blur_1d": f"WITH {_GRID_SQL}, h AS (SELECT x, y, sum(v) OVER w // count(*) OVER w AS v FROM g WINDOW w AS (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT x, y, CAST(sum(v) OVER w // count(*) OVER w AS BIGINT) AS v FROM h WINDOW w AS (PARTITION BY x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "dfl_decode": "WITH g AS (SELECT id, k, exp(((id*31+k*17)%23)/4) AS e FROM range(500) a(id), range(16) b(k)) SELECT id, round(sum(e*k)/sum(e), 9) AS distance FROM g GROUP BY 1",
}
