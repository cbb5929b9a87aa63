import io
import struct
import zipfile

import pytest

from framelake.sources import annotations as A
from framelake.sources import archives as Z
from framelake.sources import exif, ledgers


def make_zip(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_archive_round_trip(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k, method in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)):
        (src / f"a{k}.zip").write_bytes(make_zip([("CAM_001/1.jpg", b"x" * 50), ("CAM_001/1.jpg", b"y"), ("readme.txt", b"hi"), ("CAM_002/", b"")], method))
    (src / "b.rar").write_bytes(b"Rar!")
    (src / "c.zip").write_bytes(b"not a zip")
    e = Z.classified(Z.read_archives(spark, str(src)))
    rows = e.collect()
    assert sum(r.error is None for r in rows) == 12 and sum(r.kind == "Image" for r in rows) == 8
    assert sorted(r.error.split(":")[0] for r in rows if r.error) == ["no decoder for rar", "unreadable archive"]
    done = {r.output: r for r in Z.write_archives(e.drop("kind", "camera_id", "out_name", "format"), str(tmp_path / "out")).collect()}
    assert done["a0_elaborato.zip"].images == 2 and done["c_elaborato.zip"].errors == 1
    with zipfile.ZipFile(tmp_path / "out" / "a3_elaborato.zip") as z:
        assert z.read("CAM_001/1.jpg") == b"x" * 50


def test_archive_limits():
    z = make_zip([("a", b"0" * 100_000), ("b", b"1")])
    errors = lambda limits: [r[6] for r in Z.zip_entries("z", z, limits)]
    assert errors(Z.Limits(entries=1))[0].startswith("limit: 2 entries")
    assert errors(Z.Limits(ratio=10))[0].startswith("limit: expands")
    assert errors(Z.Limits(ratio=0, entry_bytes=10))[0].startswith("limit: declares")
    assert errors(Z.Limits(ratio=0, total_bytes=100_000))[1].startswith("limit: archive")
    assert errors(Z.Limits(ratio=0)) == [None, None]
    damaged = bytearray(make_zip([("a", b"hello"), ("b", b"fine")], zipfile.ZIP_STORED))
    damaged[damaged.index(b"hello")] ^= 1
    assert [bool(r[6]) for r in Z.zip_entries("z", bytes(damaged))] == [True, False]


def test_faces(spark, tmp_path):
    text = "a/1.jpg\n2\n10 20 30 40 1 0 0 0 2 1\n5 5 5 5\nb/2.jpg\n0\n0 0 0 0 0 0 0 0 0 0\nc/3.jpg\n1\n1 2 3 4 0 0 0 1 0 0\n"
    rows = list(A.parse_faces(text))
    assert [(r[0], r[1]) for r in rows] == [("a/1.jpg", 0), ("a/1.jpg", 1), ("b/2.jpg", 0), ("c/3.jpg", 0)]
    assert rows[0][2:] == (10, 20, 40, 60, 1, 0, 0, 2, 1, False) and rows[3][-1] is True and rows[2][2:6] == (0, 0, 0, 0)
    assert [r[0] for r in A.parse_faces("a\n0\nb\n1\n1 1 1 1\n")] == ["b"]
    with pytest.raises(ValueError):
        list(A.parse_faces("a\n1\n1 2 3\n"))
    (tmp_path / "gt.txt").write_text(text)
    assert A.read_faces(spark, str(tmp_path)).count() == 4


def test_ellipses_and_labels(spark, tmp_path):
    (tmp_path / "fold.txt").write_text("x\n1\n30 20 0 100 100 1\ny\n0\n")
    r = A.read_ellipses(spark, str(tmp_path)).first()
    assert (r.image, r.x1, r.y1, r.x2, r.y2) == ("x", 70, 80, 130, 120)
    assert list(A.parse_labels("0 0.5 0.5 0.5 0.5\n0 3 1 1 1", 100, 100))[0] == (0, 0, 25, 25, 75, 75)
    assert list(A.parse_labels("bad\n1 50 50 10 10", 100, 100)) == [(0, 1, 45, 45, 55, 55)]


def test_ledgers(spark, tmp_path):
    (tmp_path / "jobs.jsonl").write_text('{"input":"a.zip","output":"b","errors":[{"entry":"x","error":"y"}]}\n\n{"input":"torn\n{"input":"c.zip"}\n')
    assert sorted(r.input for r in ledgers.read_ledger(spark, str(tmp_path / "jobs.jsonl")).collect()) == ["a.zip", "c.zip"]
    (tmp_path / "metrics_1.json").write_text('{"val_accuracy": 0.9,\n "exported_at": "2024-01-01T00:00:00Z"}')
    (tmp_path / "metrics_2.json").write_text("{broken")
    assert ledgers.read_metrics(spark, str(tmp_path)).count() == 1
    (tmp_path / "s.log").write_text("\x1b[2m2024-01-01T00:00:00Z\x1b[0m  WARN svc::m: hello\nnoise\n")
    assert ledgers.read_log(spark, str(tmp_path / "s.log")).first().message == "hello"


@pytest.mark.parametrize("e", ["<", ">"])
def test_exif(spark, e):
    tiff = (b"II*\0" if e == "<" else b"MM\0*") + struct.pack(e + "I", 8)
    tiff += struct.pack(e + "HHHII", 1, exif.EXIF_POINTER, 4, 1, 26) + struct.pack(e + "I", 0)
    tiff += struct.pack(e + "HHHII", 1, exif.SERIAL, 2, 8, 44) + struct.pack(e + "I", 0) + b"AB-12345"[:7] + b"\0"
    app = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xda"
    assert exif.serial_bytes(jpeg) == b"AB-1234"
    assert exif.serial_bytes(b"\xff\xd8\xff\xda") is None and exif.serial_bytes(None) is None and exif.serial_bytes(jpeg[:30]) is None
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(bytearray(jpeg),)], "b binary").select(exif.serial(F.col("b"))).first()[0] == "AB-1234"
