import datetime as dt
import json

from pyspark.sql import functions as F

from framelake.operators.jobs import route
from framelake.streaming import cameras, frames, queues

T0 = dt.datetime(2024, 1, 1)


def write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(json.dumps(r, default=str) + "\n" for r in rows))


def test_camera_states(spark, tmp_path):
    events = [("A", 0, "frame", 1920), ("A", 1, "learned", None), ("B", 2, "frame", None), ("B", 3, "frame", 640), ("A", 4, "reset_initial", None), ("A", 5, "frame", 800)]
    src = tmp_path / "in"
    for k, (c, s, e, w) in enumerate(events):
        write(src, f"{k}.json", [{"camera_id": c, "ts": T0 + dt.timedelta(minutes=s), "seq": s, "event": e, "width": w, "height": w}])
    stream = spark.readStream.schema("camera_id string, ts timestamp, seq long, event string, width int, height int").option("maxFilesPerTrigger", 2).json(str(src))
    q = cameras.camera_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "ck"))
    queues.run_available(q)
    last = {r.camera_id: r for r in spark.sql("SELECT camera_id, max_by(state, coalesce(learning_since, timestamp'1970-01-01')) s, max(width) w FROM states GROUP BY 1").collect()}
    assert last["A"].s == "LEARNING" and last["A"].w == 1920 and last["B"].s == "LEARNING"
    state = None
    for c, s, e, w in events:
        if c == "A":
            state = cameras.step(state, e, s, w, w)
    assert state == ("LEARNING", 5, 1920, 1920)


def test_routing_and_latest(spark, tmp_path):
    src = tmp_path / "m"
    rows = [
        {"seq": 1, "queue": "rabbitmq", "message_id": "../x", "body": "{}", "attempts": 0, "job_failed": False},
        {"seq": 2, "queue": "rabbitmq", "message_id": "m", "body": "{bad", "attempts": 0, "job_failed": False},
        {"seq": 3, "queue": "rabbitmq", "message_id": "m3", "body": "{}", "attempts": 1, "job_failed": True},
        {"seq": 4, "queue": "rabbitmq", "message_id": "m4", "body": "{}", "attempts": 3, "job_failed": True},
        {"seq": 5, "queue": "sqs", "message_id": "m5", "body": "{}", "attempts": 3, "job_failed": True},
        {"seq": 6, "queue": "sqs", "message_id": "m6", "body": "{}", "attempts": 4, "job_failed": True},
        {"seq": 7, "queue": "sqs", "message_id": "m7", "body": "{}", "attempts": 1, "job_failed": False},
        {"seq": 7, "queue": "sqs", "message_id": "m7", "body": "{}", "attempts": 1, "job_failed": False},
    ]
    for k, r in enumerate(rows):
        write(src, f"{k}.json", [r | {"ts": T0 + dt.timedelta(minutes=k)}])
    stream = lambda: spark.readStream.schema(queues.MESSAGE).option("maxFilesPerTrigger", 3).json(str(src))
    queues.run_available(queues.write_routed(queues.once(stream()), str(tmp_path / "out"), str(tmp_path / "ck")))
    got = {r.seq: (r.route, r.delay_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("dlq_unsafe_id", None), 2: ("dlq_bad_body", None), 3: ("retry", 10000), 4: ("dlq_attempts", None), 5: ("left_on_queue", None), 6: ("dlq_attempts", None), 7: ("completed", None)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    queues.run_available(queues.write_latest(stream(), str(tmp_path / "snap"), str(tmp_path / "ck2"), "queue"))
    newest = max(int(p.name.split("=")[1]) for p in (tmp_path / "snap").iterdir())
    final = {r.queue: r.seq for r in spark.read.parquet(str(tmp_path / "snap" / f"batch={newest}")).collect()}
    assert final == {"rabbitmq": 4, "sqs": 7}
    assert route(spark.read.schema(queues.MESSAGE).json(str(src)), 4).count() == 8


def test_counts_and_expiry(spark):
    d = spark.createDataFrame([("A", T0 + dt.timedelta(hours=k), 0.5) for k in range(48)], "camera_id string, captured_at timestamp, confidence double")
    assert cameras.live(d, T0 + dt.timedelta(days=2), 1).count() == 24
    assert cameras.detection_counts(d, "1 day").agg(F.sum("detections")).first()[0] == 48


def test_frames_see_the_states_of_their_batch(spark, tmp_path):
    """A camera's state changes between batches, not within one; a damaged frame is a row with an error."""
    face = {"det_idx": 1, "x1": 10.0, "y1": 10.0, "x2": 20.0, "y2": 20.0, "score": 0.3}
    states = iter(["LEARNING", "ACTIVE", "INITIAL"])

    def read():
        return spark.createDataFrame([("c", next(states), None, None, None, None)], "camera_id string, state string, roi_x0 double, roi_y0 double, roi_x1 double, roi_y1 double")

    for k in range(3):
        rows = [{"image_id": 10 * k, "camera_id": "c", "width": 100, "height": 100, "faces": [face], "persons": []}, {"image_id": 10 * k + 1, "camera_id": "c", "width": None, "height": None, "faces": [], "persons": []}]
        write(tmp_path / "f", f"{k}.json", [])
        (tmp_path / "f" / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    stream = spark.readStream.schema(frames.FRAME).option("maxFilesPerTrigger", 1).json(str(tmp_path / "f"))
    queues.run_available(frames.write_results(stream, read, str(tmp_path / "out"), str(tmp_path / "ck")))
    got = {r.image_id: (r.branch, r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(got[k][0] for k in (0, 10, 20)) == ["faces", "full_frame", "nothing"]
    assert all(got[k] == ("dropped", "undecodable frame") for k in (1, 11, 21))
