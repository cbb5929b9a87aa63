"""Representative relations derived from the driver's tables by integer arithmetic (FIXTURES.md), the same in Spark and in
the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BOXES = """SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate) AS idx,
 CAST((l_partkey*13)%800 AS DOUBLE) AS x1, CAST((l_suppkey*29)%600 AS DOUBLE) AS y1,
 CAST(20+(l_partkey*7)%120 AS DOUBLE) AS w, CAST(20+(l_suppkey*11)%120 AS DOUBLE) AS h,
 l_linenumber%3 AS blur, l_linenumber%2 AS illum, CAST(l_suppkey%3 AS INT) AS occ, CAST(l_partkey%2 AS INT) AS pose,
 CASE WHEN l_partkey%11=0 THEN 1 ELSE 0 END AS ignored, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_returnflag AS rf FROM lineitem"""

#: Name: (relations it reads, its SQL).
FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_detections": (("events",), """SELECT event_id, 'CAM_' || lpad(CAST(user_id % 25 AS STRING),3,'0') AS camera_id,
 CAST((event_id*37)%1920 AS DOUBLE) AS x, CAST((event_id*53)%1080 AS DOUBLE) AS y,
 CAST((event_id*7919)%1000 AS DOUBLE)/1000 AS confidence, ts AS captured_at FROM events"""),
    "fx_cameras": (("nation",), """SELECT 'CAM_' || lpad(CAST(n_nationkey AS STRING),3,'0') AS camera_id,
 CASE n_nationkey%5 WHEN 0 THEN 'INITIAL' WHEN 1 THEN 'LEARNING' WHEN 2 THEN 'LEARNING' ELSE 'ACTIVE' END AS state,
 n_nationkey%40 AS learning_days_elapsed, CASE WHEN n_nationkey%7=6 THEN NULL ELSE 1920 END AS frame_width,
 CASE WHEN n_nationkey%7=6 THEN NULL ELSE 1080 END AS frame_height,
 CAST(100+n_regionkey*50 AS DOUBLE) AS roi_x0, CAST(80+n_regionkey*40 AS DOUBLE) AS roi_y0,
 CAST(1400+n_regionkey*60 AS DOUBLE) AS roi_x1, CAST(800+n_regionkey*30 AS DOUBLE) AS roi_y1 FROM nation"""),
    "fx_boxes": (("lineitem",), _BOXES),
    "fx_gt": (("fx_boxes",), "SELECT image_id, idx AS gt_idx, x1, y1, x1+w AS x2, y1+h AS y2, blur, illum, occ, pose, ignored FROM fx_boxes WHERE rf <> 'R'"),
    "fx_dets": (("fx_boxes",), """SELECT image_id, idx AS det_idx, x1+ln-4 AS x1, y1+ln-4 AS y1, x1+w+ln-4 AS x2, y1+h+ln-4 AS y2,
 CAST((pk*7919+sk*104729+ln*31)%1000 AS DOUBLE)/1000 AS score FROM fx_boxes"""),
    "fx_entries": (("fx_boxes",), """SELECT o_orderkey AS archive_id, idx AS entry_idx,
 CASE (pk+ln)%9 WHEN 0 THEN cam||'/f'||fid||'.jpg' WHEN 1 THEN cam||chr(92)||'f'||fid||'.PNG' WHEN 2 THEN cam||'_f'||fid||'.jpeg' WHEN 3 THEN 'up/2024/'||cam||'/x'||fid||'.jpg'
 WHEN 4 THEN '.DS_Store' WHEN 5 THEN '../'||cam||'/evil.jpg' WHEN 6 THEN cam||'/' WHEN 7 THEN cam||'/readme.txt' ELSE 'a/b/c/f'||fid||'.jpg' END AS path,
 (pk*97+sk)%200000 AS size, 1+(pk*31+sk*7)%2000 AS compressed
 FROM (SELECT b.image_id AS o_orderkey, b.idx, b.pk, b.sk, b.ln, 'CAM_' || lpad(CAST(b.sk%25 AS STRING),3,'0') AS cam, CAST(b.pk AS STRING) AS fid FROM fx_boxes b) t"""),
    "fx_jobs": (("orders",), """SELECT o_orderkey AS job_idx, 'lotto'||CAST(o_orderkey AS STRING)||'.zip' AS input, 'lotto'||CAST(o_orderkey AS STRING)||'_elaborato.zip' AS output,
 CAST(floor(o_totalprice) AS BIGINT) AS output_size, o_orderdate AS finished_at, o_orderstatus AS st, o_custkey FROM orders"""),
    "fx_job_events": (("events",), """SELECT event_id AS seq, 'job-'||CAST(user_id AS STRING) AS job_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS state, ts FROM events"""),
    "fx_messages": (("events",), """SELECT event_id AS seq, CASE WHEN user_id%2=0 THEN 'sqs' ELSE 'rabbitmq' END AS queue,
 CASE WHEN event_id%17=0 THEN '../x'||CAST(event_id AS STRING) ELSE 'm-'||CAST(event_id AS STRING) END AS message_id,
 CASE WHEN event_id%13=0 THEN '{bad' ELSE '{"input_key":"c/'||CAST(user_id AS STRING)||'.zip"}' END AS body,
 CAST(event_id%6 AS INT) AS attempts, event_type='error' AS job_failed FROM events"""),
    "fx_log_lines": (("events",), """SELECT event_id AS seq, replace(substr(CAST(ts AS STRING),1,19),' ','T')||'Z  '||CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN' ELSE 'INFO' END||' svc::mod: '||
 CASE event_id%4 WHEN 0 THEN 'camera CAM_001: ROI extracted -> ACTIVE' WHEN 1 THEN 'operator reset camera CAM_002 to LEARNING' WHEN 2 THEN 'job done' ELSE 'pruned 3 stale detections' END AS line FROM events"""),
    "fx_samples": (("labels", "documents"), """SELECT l.doc_id AS sample_id, 'seed/'||lpad(CAST(l.doc_id AS STRING),8,'0')||'.jpg' AS path, l.quality AS is_real, l.toxic,
 CAST((l.doc_id*7919 + l.quality*400)%1000 AS DOUBLE)/1000 AS p_candidate, CAST((l.doc_id*6101 + l.quality*300)%1000 AS DOUBLE)/1000 AS p_deployed, d.n_chars FROM labels l JOIN documents d ON l.doc_id=d.doc_id"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a derived relation."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reads, sql = FIXTURES[name]
    sql = sql.replace("{", "{{").replace("}", "}}")
    for r in reads:
        sql = sql.replace(f"FROM {r}", "FROM {" + r + "}").replace(f"JOIN {r}", "JOIN {" + r + "}")
    return spark.sql(sql, **{r: table(spark, sf_dir, r) for r in reads})


def with_fixtures(sql: str) -> str:
    """The oracle's SQL with the derived relations that it reads as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, (_, body) in FIXTURES.items():
            if name in text and name not in needed:
                visit(body)
                needed.append(name)

    visit(sql)
    ctes = [f"{n} AS ({FIXTURES[n][1]})" for n in needed]
    rest = sql.strip()
    if not ctes:
        return rest
    head = "WITH RECURSIVE " if "RECURSIVE" in rest[:20].upper() else "WITH "
    body = rest[4:].strip() if rest[:4].upper() == "WITH" else None
    if body is None:
        return head + ",\n".join(ctes) + "\n" + rest
    if body[:9].upper() == "RECURSIVE":
        body = body[9:].strip()
    return head + ",\n".join([*ctes, body])
