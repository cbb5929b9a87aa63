"""Image archives as tables: one row per entry, read under limits, digests verified; and archives written from tables."""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import names as N

ENTRY_SCHEMA = "archive string, entry_idx int, name string, declared_size long, compressed_size long, data binary, error string"


@dataclass(frozen=True)
class Limits:
    """0 turns a limit off."""

    entries: int = 10_000
    entry_bytes: int = 256 << 20
    total_bytes: int = 4 << 30
    ratio: int = 500


def _capped(f, cap: int) -> bytes | None:
    """At most cap bytes, or None if there are more."""
    data = f.read(cap + 1 if cap else -1)
    return None if cap and len(data) > cap else data


def zip_entries(archive: str, content: bytes, limits: Limits = Limits()) -> Iterator[tuple]:
    """Rows of one zip archive in its own order. An entry that can't be read, whose digest or size is wrong, or that breaks a
    limit is a row with an error; breaking a limit ends the archive, a damaged entry does not."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        infos = z.infolist()
    except Exception as e:
        yield archive, None, None, None, None, None, f"unreadable archive: {e}"
        return
    if limits.entries and len(infos) > limits.entries:
        yield archive, None, None, None, None, None, f"limit: {len(infos)} entries"
        return
    total = 0
    for k, info in enumerate(infos):
        if info.is_dir():
            continue
        row = (archive, k, info.filename, info.file_size, info.compress_size)
        left = limits.total_bytes - total if limits.total_bytes else 0
        cap = min(x for x in (limits.entry_bytes or left, left or limits.entry_bytes)) if (limits.entry_bytes or left) else 0
        if limits.total_bytes and left <= 0:
            yield *row, None, "limit: archive decompresses beyond its budget"
            return
        if cap and info.file_size > cap:
            yield *row, None, f"limit: declares {info.file_size} bytes"
            return
        if limits.ratio and info.compress_size and info.file_size // info.compress_size > limits.ratio:
            yield *row, None, f"limit: expands {info.file_size // info.compress_size} times"
            return
        try:
            with z.open(info) as f:
                data = _capped(f, cap)
        except Exception as e:
            yield *row, None, f"entry can't be read: {e}"
            continue
        if data is None:
            yield *row, None, "limit: entry is larger than declared"
            return
        total += len(data)
        if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
            yield *row, None, "digest or size is wrong"
            continue
        yield *row, data, None


def read_archives(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """All entries of the zip archives under a path. 7z and RAR archives, for which no decoder is installed, and files of
    other kinds are one row with an error each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    schema = pa.schema([("archive", pa.string()), ("entry_idx", pa.int32()), ("name", pa.string()), ("declared_size", pa.int64()), ("compressed_size", pa.int64()), ("data", pa.binary()), ("error", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                kind = archive.rsplit(".", 1)[-1].lower()
                rows = zip_entries(archive, content.as_py(), limits) if kind == "zip" else iter([(archive, None, None, None, None, None, f"no decoder for {kind}")])
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return files.mapInArrow(read, ENTRY_SCHEMA)


def classified(entries: DataFrame) -> DataFrame:
    """Entries with kind, camera_id, out_name and format."""
    return entries.withColumn("c", N.classify_entry(F.col("name"))).select("*", "c.kind", "c.camera_id", "c.out_name", "c.format").drop("c")


def write_archives(entries: DataFrame, folder: str) -> DataFrame:
    """Writes one stored zip per archive of (archive, name, data, error), entries in order of name and the first of each
    name only, and `<stem>_error.txt` with the errors. Returns a row per archive: archive, output, images, errors, bytes.

    Archives are written whole by one task, as a zip must be; the data of one archive has to fit there."""
    schema = pa.schema([("archive", pa.string()), ("output", pa.string()), ("images", pa.int64()), ("errors", pa.int64()), ("bytes", pa.int64())])

    def write(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["name"] or "", r["entry_idx"] if r["entry_idx"] is not None else -1))
        archive = rows[0]["archive"]
        stem = posixpath.basename(archive).rsplit(".", 1)[0]
        out, seen, errors = io.BytesIO(), set(), []
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for r in rows:
                if r["error"]:
                    errors.append(f"{r['name']}: {r['error']}")
                elif r["name"] not in seen:
                    seen.add(r["name"])
                    z.writestr(zipfile.ZipInfo(r["name"]), r["data"] or b"")
            if errors:
                z.writestr(zipfile.ZipInfo(f"{stem}_error.txt"), "\n".join(errors) + "\n")
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name, hidden = f"{stem}_elaborato.zip", f".{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{path}/{hidden}") as f:
            f.write(out.getvalue())
        fs.move(f"{path}/{hidden}", f"{path}/{name}")
        return pa.Table.from_pylist([{"archive": archive, "output": name, "images": len(seen), "errors": len(errors), "bytes": out.tell()}], schema)

    return entries.select("archive", "entry_idx", "name", "data", "error").groupBy("archive").applyInArrow(write, "archive string, output string, images long, errors long, bytes long")
