"""Queries over archive entries, names, URLs and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.fixtures import table
from framelake.functions import names as N

#: Webhook hosts that the query allows.
HOSTS = ["example.com", "the.example.org:443", "thth.example.net", "localhost:8080"]
BYTE_CAPS = (120_000, 400_000)


def classify_entry(spark, sf) -> DataFrame:
    e = table(spark, sf, "fx_entries").withColumn("c", N.classify_entry(F.col("path")))
    return e.select("archive_id", "entry_idx", "path", "c.kind", "c.camera_id", "c.out_name", "c.format")


_CLASSIFIED = r"""p AS (SELECT *, ltrim(regexp_replace(replace(path, chr(92), '/'), '^(\./)+', ''), '/') AS n FROM fx_entries),
q AS (SELECT *, list_contains(string_split(n, '/'), '..') AS bad, regexp_extract(n, '([^/]*)$', 1) AS file,
 CASE WHEN contains(n, '/') THEN regexp_extract(n, '([^/]*)/[^/]*$', 1) WHEN contains(n, '_') THEN regexp_extract(n, '^([^_]*_[^_]*)', 1) END AS cam FROM p),
c AS (SELECT *, CASE WHEN bad THEN 'Other' WHEN n = '' OR n LIKE '%/' THEN 'Directory'
 WHEN regexp_matches(coalesce(cam, ''), '^[A-Za-z0-9][A-Za-z0-9_-]{1,63}$') AND regexp_matches(CASE WHEN contains(n, '/') THEN file ELSE n END, '(?i)^[^.].*\.(jpg|jpeg|png)$') THEN 'Image' ELSE 'Other' END AS kind FROM q)"""


def archive_limits(spark, sf) -> DataFrame:
    e = table(spark, sf, "fx_entries")
    ratio = F.expr("size div compressed")
    n = F.count(F.lit(1)).over(Window.partitionBy("archive_id"))
    verdict = F.when(n > 5, "too_many_entries").when(F.col("size") > 150_000, "too_large").when((F.col("compressed") > 0) & (ratio > 500), "ratio").otherwise("ok")
    return e.select("archive_id", "entry_idx", verdict.alias("verdict"), ratio.alias("ratio"))


def byte_budget(spark, sf) -> DataFrame:
    """First entry of each archive that breaks the entry cap or the archive's decompression budget."""
    entry_cap, total_cap = BYTE_CAPS
    e = table(spark, sf, "fx_entries")
    w = Window.partitionBy("archive_id").orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("prev", F.coalesce(F.sum("size").over(w), F.lit(0)))
    bad = (F.col("prev") >= total_cap) | (F.col("size") > F.least(F.lit(entry_cap), F.lit(total_cap) - F.col("prev")))
    return e.groupBy("archive_id").agg(F.min(F.when(bad, F.col("entry_idx"))).alias("abort_at"), F.sum("size").alias("total"), F.count(F.lit(1)).alias("entries"))


def output_names(spark, sf) -> DataFrame:
    e = table(spark, sf, "fx_entries")
    p = F.col("path")
    return e.select("archive_id", "entry_idx", N.output_name(N.base_name(p)).alias("output_name"), N.error_name(N.base_name(p)).alias("error_name"), N.default_output_key(p).alias("output_key"), N.replace_ext(p, "png").alias("converted"))


_STEM = r"CASE WHEN regexp_matches({0}, '^.+\.[^.]*$') THEN regexp_extract({0}, '^(.+)\.[^.]*$', 1) ELSE {0} END"


def sanitize_names(spark, sf) -> DataFrame:
    return table(spark, sf, "fx_entries").select("archive_id", "entry_idx", N.sanitize_filename(F.col("path")).alias("safe_name"))


def merge_dedup(spark, sf) -> DataFrame:
    """Of entries of one name over all archives, the first by archive and entry stays."""
    e = table(spark, sf, "fx_entries")
    return e.groupBy("path").agg(F.min(F.struct("archive_id", "entry_idx")).alias("f"), F.count(F.lit(1)).alias("copies")).select("path", "f.archive_id", "f.entry_idx", "copies")


def camera_identity(spark, sf) -> DataFrame:
    """The camera's id by serial number where the entry has a usable one, else by name."""
    e = table(spark, sf, "fx_entries").withColumn("c", N.classify_entry(F.col("path")))
    serial = F.when(F.col("entry_idx") % 3 == 0, F.concat(F.lit(" SN#"), F.col("size").cast("string"), F.lit("! ")))
    return e.where("c.kind = 'Image'").select("archive_id", "entry_idx", F.coalesce(N.sanitize_serial(serial), F.col("c.camera_id")).alias("identity"))


def stem_join(spark, sf) -> DataFrame:
    """Images and label files of the same folder and stem."""
    e = table(spark, sf, "fx_entries")
    n = N.normalised_path(F.col("path"))
    images = e.where(N.is_image_name(N.base_name(n))).select("archive_id", "entry_idx", F.regexp_extract(n, r"^(.*?)[^/]*$", 1).alias("dir"), N.stem(N.base_name(n)).alias("stem"))
    k = F.col("p_partkey").cast("string")
    folder = F.when(F.col("p_partkey") % 2 == 0, "a/b/c/").otherwise(F.concat(F.lit("CAM_"), F.lpad((F.col("p_partkey") % 25).cast("string"), 3, "0"), F.lit("/")))
    labels = table(spark, sf, "part").select(folder.alias("dir"), F.concat(F.lit("f"), k).alias("stem"), "p_partkey")
    return images.join(labels, ["dir", "stem"]).select("archive_id", "entry_idx", "dir", "stem", "p_partkey")


def leaf_join(spark, sf) -> DataFrame:
    """Input entries against output entries by leaf name: both, or which side misses it."""
    e = table(spark, sf, "fx_entries").withColumn("leaf", N.base_name(N.normalised_path(F.col("path")))).where("leaf <> ''")
    a = e.where("size < 150000").groupBy("leaf").agg(F.count(F.lit(1)).alias("n_in"))
    b = e.where("size >= 50000").groupBy("leaf").agg(F.count(F.lit(1)).alias("n_out"))
    state = F.when(F.col("n_in").isNull(), "missing_input").when(F.col("n_out").isNull(), "missing_output").otherwise("both")
    return a.join(b, "leaf", "full_outer").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("leaves"), F.coalesce(F.sum("n_in"), F.lit(0)).alias("n_in"), F.coalesce(F.sum("n_out"), F.lit(0)).alias("n_out"))


def crc_verify(spark, sf) -> DataFrame:
    """An entry is accepted if its CRC-32 and its size are as declared (every seventh is damaged here)."""
    e = table(spark, sf, "fx_entries")
    read = F.when(F.col("entry_idx") % 7 == 0, F.concat(F.col("path"), F.lit("?"))).otherwise(F.col("path"))
    ok = (F.crc32(read.cast("binary")) == F.crc32(F.col("path").cast("binary"))) & (F.octet_length(read) == F.octet_length(F.col("path")))
    return e.groupBy("archive_id").agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


def crop_dedup(spark, sf) -> DataFrame:
    """The first 500 crops of at least 40,000 bytes whose content was not there before."""
    e = table(spark, sf, "fx_entries").where("size >= 40000").select("archive_id", "entry_idx", "size", F.md5(F.concat_ws(":", F.col("size").cast("string"), F.col("compressed").cast("string")).cast("binary")).alias("digest"))
    first = e.groupBy("digest").agg(F.min(F.struct("archive_id", "entry_idx", "size")).alias("f")).select("digest", "f.*")
    return first.orderBy("archive_id", "entry_idx").limit(500)


def archive_dispatch(spark, sf) -> DataFrame:
    j = table(spark, sf, "fx_jobs").withColumn("name", F.concat(F.lit("IN/lotto"), F.col("job_idx").cast("string"), F.element_at(F.array(*map(F.lit, (".zip", ".7Z", ".rar", ".tar.gz"))), (F.col("job_idx") % 4 + 1).cast("int"))))
    return j.groupBy(N.archive_kind(F.col("name")).alias("kind")).agg(F.count(F.lit(1)).alias("archives"), F.sum("output_size").alias("bytes"))


def object_sweep(spark, sf) -> DataFrame:
    """The listing is cut first, then ignored keys go."""
    j = table(spark, sf, "fx_jobs")
    key = F.when(F.col("job_idx") % 5 == 0, F.concat(F.lit("errori/"), F.col("input"))).when(F.col("job_idx") % 7 == 0, F.concat(F.lit("/"), F.col("input"))).when(F.col("job_idx") % 3 == 0, F.concat(F.col("input"), F.lit(".txt"))).otherwise(F.col("input"))
    listing = j.select(key.alias("key"), "output_size", "input").orderBy("input").limit(500)
    return listing.where(~N.ignored_key(F.col("key"))).select("key", "output_size", N.default_output_key(F.col("key")).alias("output_key"))


def redact_paths(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages")
    m = F.concat(F.lit("read '/data/in/"), F.col("page_id").cast("string"), F.lit(".zip': failed, see "), F.col("url"), F.lit(r" and (C:\tmp\x) or CAM_001/a.jpg. \\host\share!"))
    return p.select("page_id", N.redact_paths(m).alias("message"))


def redact_url(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages")
    u = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "://", "://user:p@ss@")).otherwise(F.col("url"))
    return p.select("page_id", N.redact_url(u).alias("url"))


def percent_encode(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select("page_id", N.percent_encode(F.concat(F.col("url"), F.lit(" a+b*c~d_é"))).alias("encoded"))


def webhook_allowed(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages")
    u = F.when(F.col("page_id") % 4 == 0, "https://example.com/hook").when(F.col("page_id") % 4 == 1, "https://the.example.org/x").when(F.col("page_id") % 4 == 2, "http://localhost:9090/y").otherwise(F.col("url"))
    return p.select("page_id", N.webhook_allowed(u, HOSTS).alias("allowed"))


def public_ipv4(spark, sf) -> DataFrame:
    s = table(spark, sf, "events")
    e = F.col("event_id")
    ip = F.concat_ws(".", *[F.pmod(e * m + a, F.lit(k)).cast("string") for m, a, k in ((37, 0, 256), (53, 64, 260), (3, 0, 4), (7, 0, 256))])
    return s.select("event_id", ip.alias("ip"), N.public_ipv4(ip).alias("is_public"))


_IP = "concat_ws('.', CAST(event_id*37%256 AS VARCHAR), CAST((event_id*53+64)%260 AS VARCHAR), CAST(event_id*3%4 AS VARCHAR), CAST(event_id*7%256 AS VARCHAR))"


def model_url_policy(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages")
    u = F.when(F.col("page_id") % 5 == 0, "http://127.0.0.1:8000/m/a b.onnx?x=1").when(F.col("page_id") % 5 == 1, "https://u:p@example.com/m.onnx").when(F.col("page_id") % 5 == 2, "https://example.com/..").otherwise(F.col("url"))
    return p.select("page_id", N.model_url_allowed(u).alias("allowed"), N.model_filename(u).alias("file"))


def sanitize_serial(spark, sf) -> DataFrame:
    d = table(spark, sf, "pages")
    return d.select("page_id", N.sanitize_serial(F.col("url")).alias("serial"))


def camera_upsert(spark, sf) -> DataFrame:
    """Cameras of a job's entries: known ones as they are, new ones LEARNING."""
    e = table(spark, sf, "fx_entries").withColumn("c", N.classify_entry(F.col("path"))).where("c.kind = 'Image'")
    seen = e.groupBy(F.when(F.col("entry_idx") == 1, F.concat(F.lit("NEW_"), F.col("c.camera_id"))).otherwise(F.col("c.camera_id")).alias("camera_id")).agg(F.count(F.lit(1)).alias("images"))
    known = table(spark, sf, "fx_cameras").select("camera_id", "state")
    return seen.join(known, "camera_id", "left").select("camera_id", "images", F.coalesce(F.when(F.col("state") == "INITIAL", "LEARNING").otherwise(F.col("state")), F.lit("LEARNING")).alias("state"), F.col("state").isNull().alias("is_new"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

ORACLES = {
    "classify_entry": "WITH " + _CLASSIFIED + " SELECT archive_id, entry_idx, path, kind, CASE WHEN kind = 'Image' THEN cam END AS camera_id, CASE WHEN kind = 'Image' THEN n END AS out_name, CASE WHEN kind = 'Image' THEN replace(lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)), 'jpeg', 'jpg') END AS format FROM c",
    "archive_limits": "SELECT archive_id, entry_idx, CASE WHEN count(*) OVER (PARTITION BY archive_id) > 5 THEN 'too_many_entries' WHEN size > 150000 THEN 'too_large' WHEN compressed > 0 AND size // compressed > 500 THEN 'ratio' ELSE 'ok' END AS verdict, size // compressed AS ratio FROM fx_entries",
    "byte_budget": "WITH b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY archive_id ORDER BY entry_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM fx_entries) SELECT archive_id, min(CASE WHEN prev >= 400000 OR size > least(120000, 400000 - prev) THEN entry_idx END) AS abort_at, CAST(sum(size) AS BIGINT) AS total, count(*) AS entries FROM b GROUP BY archive_id",
    "output_names": f"WITH b AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base FROM fx_entries), s AS (SELECT *, {_STEM.format('base')} AS stem FROM b) SELECT archive_id, entry_idx, stem || '_elaborato.zip' AS output_name, stem || '_error.txt' AS error_name, 'elaborati/' || stem || '_elaborato.zip' AS output_key, CASE WHEN contains(path, '.') THEN regexp_replace(path, '\\.[^.]*$', '.png') ELSE path || '.png' END AS converted FROM s",
    "sanitize_names": "SELECT archive_id, entry_idx, CASE WHEN path = '' THEN 'output' ELSE regexp_replace(path, '[^A-Za-z0-9._-]', '_', 'g') END AS safe_name FROM fx_entries",
    "merge_dedup": "WITH r AS (SELECT path, archive_id, entry_idx, row_number() OVER (PARTITION BY path ORDER BY archive_id, entry_idx) AS rn, count(*) OVER (PARTITION BY path) AS copies FROM fx_entries) SELECT path, archive_id, entry_idx, copies FROM r WHERE rn = 1",
    "camera_identity": "WITH " + _CLASSIFIED + ", s AS (SELECT *, CASE WHEN entry_idx % 3 = 0 THEN trim(regexp_replace(trim(' SN#' || CAST(size AS VARCHAR) || '! '), '[^A-Za-z0-9_-]', '_', 'g'), '_') END AS serial FROM c) SELECT archive_id, entry_idx, coalesce(serial, cam) AS identity FROM s WHERE kind = 'Image'",
    "stem_join": "WITH " + _CLASSIFIED + f", i AS (SELECT archive_id, entry_idx, regexp_extract(n, '^(.*?)[^/]*$', 1) AS dir, {_STEM.format('file')} AS stem FROM c WHERE regexp_matches(file, '(?i)^[^.].*\\.(jpg|jpeg|png)$')) SELECT archive_id, entry_idx, dir, stem, p_partkey FROM i JOIN part ON stem = 'f' || CAST(p_partkey AS VARCHAR) AND dir = CASE WHEN p_partkey % 2 = 0 THEN 'a/b/c/' ELSE 'CAM_' || lpad(CAST(p_partkey % 25 AS VARCHAR), 3, '0') || '/' END",
    "leaf_join": "WITH " + _CLASSIFIED + ", a AS (SELECT file AS leaf, count(*) AS n_in FROM c WHERE size < 150000 AND file <> '' GROUP BY 1), b AS (SELECT file AS leaf, count(*) AS n_out FROM c WHERE size >= 50000 AND file <> '' GROUP BY 1) SELECT CASE WHEN n_in IS NULL THEN 'missing_input' WHEN n_out IS NULL THEN 'missing_output' ELSE 'both' END AS state, count(*) AS leaves, CAST(coalesce(sum(n_in), 0) AS BIGINT) AS n_in, CAST(coalesce(sum(n_out), 0) AS BIGINT) AS n_out FROM a FULL JOIN b USING (leaf) GROUP BY 1",
    "crc_verify": "WITH r AS (SELECT archive_id, path, CASE WHEN entry_idx % 7 = 0 THEN path || '?' ELSE path END AS got FROM fx_entries) SELECT archive_id, count(*) FILTER (WHERE md5(got) = md5(path) AND strlen(got) = strlen(path)) AS accepted, count(*) FILTER (WHERE NOT (md5(got) = md5(path) AND strlen(got) = strlen(path))) AS rejected FROM r GROUP BY 1",
    "crop_dedup": "WITH d AS (SELECT archive_id, entry_idx, size, md5(CAST(size AS VARCHAR) || ':' || CAST(compressed AS VARCHAR)) AS digest FROM fx_entries WHERE size >= 40000), r AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY archive_id, entry_idx) AS rn FROM d) SELECT digest, archive_id, entry_idx, size FROM r WHERE rn = 1 ORDER BY archive_id, entry_idx LIMIT 500",
    "archive_dispatch": "SELECT CASE job_idx % 4 WHEN 0 THEN 'zip' WHEN 1 THEN '7z' WHEN 2 THEN 'rar' ELSE 'unsupported' END AS kind, count(*) AS archives, CAST(sum(output_size) AS BIGINT) AS bytes FROM fx_jobs GROUP BY 1",
    "object_sweep": "WITH l AS (SELECT CASE WHEN job_idx % 5 = 0 THEN 'errori/' || input WHEN job_idx % 7 = 0 THEN '/' || input WHEN job_idx % 3 = 0 THEN input || '.txt' ELSE input END AS key, output_size FROM fx_jobs ORDER BY input LIMIT 500) SELECT key, output_size, 'elaborati/' || regexp_extract(key, '^(.*)\\.zip$', 1) || '_elaborato.zip' AS output_key FROM l WHERE NOT (key = '' OR key LIKE '/%' OR list_contains(string_split(key, '/'), 'errori')) AND regexp_matches(lower(key), '\\.(zip|7z|rar)$')",
    "redact_paths": r"SELECT page_id, 'read ''<path>'': failed, see ' || url || ' and (<path>) or CAM_001/a.jpg. <path>!' AS message FROM pages",
    "redact_url": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, '://', '://***@') ELSE url END AS url FROM pages",
    "percent_encode": "SELECT page_id, url_encode(url || ' a+b*c~d_é') AS encoded FROM pages",
    "webhook_allowed": "WITH u AS (SELECT page_id, regexp_extract(CASE WHEN page_id % 4 = 0 THEN 'https://example.com/hook' WHEN page_id % 4 = 1 THEN 'https://the.example.org/x' WHEN page_id % 4 = 2 THEN 'http://localhost:9090/y' ELSE url END, '^(https?)://([^/:?#]*):?([0-9]*)', ['scheme', 'host', 'port']) AS r FROM pages) SELECT page_id, lower(r.host) IN ('example.com', 'thth.example.net') OR lower(r.host) || ':' || CASE WHEN r.port <> '' THEN r.port WHEN r.scheme = 'https' THEN '443' ELSE '80' END IN ('the.example.org:443', 'localhost:8080') AS allowed FROM u",
    "public_ipv4": f"WITH i AS (SELECT event_id, {_IP} AS ip, event_id*37%256 AS a, (event_id*53+64)%260 AS b, event_id*3%4 AS c, event_id*7%256 AS d FROM events) SELECT event_id, ip, CASE WHEN b <= 255 THEN NOT (a IN (10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR (a = 0 AND b = 0 AND c = 0 AND d = 0) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127)) END AS is_public FROM i",
    "model_url_policy": "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN true WHEN page_id % 5 = 1 THEN false WHEN page_id % 5 = 2 THEN true ELSE url LIKE 'https://%' AND NOT contains(regexp_extract(url, '://([^/?#]*)', 1), '@') END AS allowed, CASE WHEN page_id % 5 = 0 THEN 'ab.onnx' WHEN page_id % 5 = 1 THEN 'm.onnx' WHEN page_id % 5 = 2 THEN 'model.onnx' ELSE coalesce(nullif(trim(regexp_replace(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^([^?#]*)', 1), '[^A-Za-z0-9._-]', '', 'g'), '.'), ''), 'model.onnx') END AS file FROM pages",
    "sanitize_serial": "WITH s AS (SELECT page_id, trim(regexp_replace(trim(url), '[^A-Za-z0-9_-]', '_', 'g'), '_') AS s FROM pages) SELECT page_id, CASE WHEN length(s) >= 2 AND regexp_matches(s, '^[A-Za-z0-9]') THEN substr(s, 1, 64) END AS serial FROM s",
    "camera_upsert": "WITH " + _CLASSIFIED + ", s AS (SELECT CASE WHEN entry_idx = 1 THEN 'NEW_' || cam ELSE cam END AS camera_id, count(*) AS images FROM c WHERE kind = 'Image' GROUP BY 1) SELECT s.camera_id, s.images, CASE WHEN k.state IS NULL OR k.state = 'INITIAL' THEN 'LEARNING' ELSE k.state END AS state, k.state IS NULL AS is_new FROM s LEFT JOIN fx_cameras k ON s.camera_id = k.camera_id",
}
