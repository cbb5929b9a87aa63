"""Token-ID output: each document's token ids as a length-delimited record with masked checksums, and a separate offset
index for shuffled reads.

Data file: records, one after another, each
    u64 length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload
all little-endian. Payload: i64 document id (the smallest i64 for null), then the ids as u16 or u32.
Index file: 16 bytes "FLRECIDX" + u32 version + u32 bytes per id, then per record u64 offset | i64 document id | u32 ids | u32 0.
The checksum is CRC-32 (zlib), rotated right by 15 bits plus a constant, so that a checksum of checksums is not weak.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import LOWER, blocks, runs, span_hashes, table, tuned, utf8, workspace

END_ID = 2
MASK_DELTA = 0xA282EAD8
MAGIC = b"FLRECIDX"
NULL_ID = -(2**63)
#: Distinct pieces of text whose ids a worker remembers; some more for a while.
CACHE_PIECES = 600_000

#: What a byte is to the pre-tokenizer: white space, a letter, a digit, a mark, or a control character.
_KIND = np.full(256, 3, np.uint8)
_KIND[:33] = 4
_KIND[127] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_SHUFFLED = np.random.default_rng(5).permutation(256).astype(np.uint8)

_MANIFEST = "task long, data string, index string, n_docs long, n_ids long"
_MANIFEST_ARROW = pa.schema([("task", pa.int64()), ("data", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


class Pieces:
    """The ids of pieces, found by hash: sorted hashes, second hashes, and ids one after another. When there are too many,
    those are forgotten that were not asked for since it was last full."""

    def __init__(self, size: int):
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.count, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids = np.zeros(0, np.uint32)

    def turn(self) -> None:
        if len(self.keys) <= self.size:
            return
        keep = np.flatnonzero(self.used)
        if 2 * len(keep) > self.size:
            return self.clear()
        ids = self.gathered(keep)
        self.keys, self.checks, self.count, self.ids = self.keys[keep], self.checks[keep], self.count[keep], ids
        self.start, self.used = np.cumsum(self.count) - self.count, np.zeros(len(keep), bool)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of keys, and which are there."""
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        self.used[at[there]] = True
        return at, there

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: list[np.ndarray]) -> None:
        """New keys in rising order."""
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        at = np.searchsorted(self.keys, keys)
        start = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate((self.ids, *ids))
        for name, new in (("keys", keys), ("checks", checks), ("start", start), ("count", count), ("used", np.ones(len(keys), bool))):
            setattr(self, name, np.insert(getattr(self, name), at, new))

    def gathered(self, places: np.ndarray) -> np.ndarray:
        """The ids of the pieces at these places, one after another."""
        count = self.count[places]
        ends = np.cumsum(count)
        return self.ids[np.repeat(self.start[places] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of texts by a tokenizers file. ``by_chunk`` is for tokenizers that, like word_bpe_49k.json, drop white space,
    lower-case and mark the ends of words. There a block of texts is cut by numpy into the pre-tokenizer's pieces; each
    distinct piece is encoded once by the library and remembered by two hashes. The ids are those of the library for the
    whole text: a chunk between white space with control characters, an apostrophe, the beginning of a special token or any
    other than plain ASCII and Latin letters is one piece, which the library normalises and cuts itself."""

    def __init__(self, path: str, by_chunk: bool = True):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunk = by_chunk
        # pieces are normalised and cut already: the same model without the passes over the text that this takes
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known = self.pieces = Pieces(CACHE_PIECES)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learnt(self, raw: list[str], whole: np.ndarray) -> list[np.ndarray]:
        """The ids of new pieces; whole ones go to the library as they are."""
        out: list = [None] * len(raw)
        cut = np.flatnonzero(~whole).tolist()
        for a in range(0, len(cut), 4000):
            part = cut[a : a + 4000]
            ids = np.array(self.model.encode_batch_fast([" ".join([raw[k].lower() for k in part])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                found = np.split(ids, ends[:-1])
            else:
                found = self._plain([raw[k] for k in part])
            for k, x in zip(part, found):
                out[k] = x
        rest = np.flatnonzero(whole).tolist()
        for k, x in zip(rest, self._plain([raw[k] for k in rest])):
            out[k] = x
        return out

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pieces, whether each is a whole chunk for the library, and the bytes to tell them apart by."""
        kind = _KIND[data]
        member = kind > 0
        starts, ends = runs(member, offsets)
        after = np.append(data[1:], 0)
        two = ((data == 0xC3) & (after != 0x97) & (after != 0xB7)) | ((data == 0xC4) & (after != 0xB0)) | ((data == 0xC5) & (after != 0x89) & (after != 0xBF))
        plain = (data < 128) | two
        plain[1:] |= two[:-1] & (data[1:] >= 128) & (data[1:] < 192)
        odd = ~plain | (kind == 4) | (data == 39) | ((data == 60) & (after == 124))
        sums = np.concatenate(([0], np.cumsum(odd)))
        whole = sums[ends] > sums[starts]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[whole]] += 1
        np.subtract.at(inside, ends[whole], 1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        first = np.zeros(len(data) + 1, bool)
        first[1:-1] = member[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~inside[1:]
        first[starts] = True
        first[-1] = True
        begin = np.flatnonzero(first[:-1])
        last = np.flatnonzero(member & (first[1:] | ~np.append(member[1:], False))) + 1
        return begin, last, inside[begin], np.where(inside, data, LOWER[data])

    def block(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts one after another, and the offsets of its rows; null counts as empty."""
        data, offsets = utf8(column)
        if not self.by_chunk or not len(data):
            return self._by_text(column)
        self.known.turn()
        begin, last, whole, told = self._cut(data, offsets)
        keys, first, of = np.unique(span_hashes(told, begin, last), return_index=True, return_inverse=True)
        checks = span_hashes(_SHUFFLED[told], begin, last)
        at, there = self.known.find(keys)
        if not (checks == checks[first][of]).all() or not (self.known.checks[at[there]] == checks[first][there]).all():
            return self._by_text(column)  # two pieces of one hash
        new = np.flatnonzero(~there)
        if len(new):
            raw = [data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(begin[first[new]].tolist(), last[first[new]].tolist())]
            self.known.add(keys[new], checks[first[new]], self._learnt(raw, whole[first[new]]))
            at, _ = self.known.find(keys)
        places = at[of]
        sums = np.concatenate(([0], np.cumsum(self.known.count[places])))
        return self.known.gathered(places), sums[np.searchsorted(begin, offsets)]

    def _by_text(self, column) -> tuple[np.ndarray, np.ndarray]:
        found = self._plain([t or "" for t in column.to_pylist()])
        return np.concatenate((np.zeros(0, np.uint32), *found)), np.cumsum([0, *map(len, found)])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        ids, offsets = self.block(pa.array(texts, pa.large_string()))
        return [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_chunk: bool) -> Encoder:
    """One encoder per process, so that what it remembers outlives a task."""
    key = (path, by_chunk)
    if key not in _encoders:
        _encoders[key] = Encoder(path, by_chunk)
    return _encoders[key]


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_records(records: Iterable[tuple[int | None, np.ndarray]], folder: str, name: str, attempt: str, width: int) -> tuple[str, str, int, int]:
    """Writes one data file and its index under temporary names and then renames them, so that a task that is run again
    replaces whole files by equal ones."""
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    data, index = f"{name}.rec", f"{name}.idx"
    kind = np.dtype("<u2") if width == 2 else np.dtype("<u4")
    at = n_docs = n_ids = 0
    with fs.open_output_stream(f"{path}/.{data}.{attempt}") as d, fs.open_output_stream(f"{path}/.{index}.{attempt}") as x:
        x.write(MAGIC + struct.pack("<II", 1, width))
        for doc_id, ids in records:
            key = NULL_ID if doc_id is None else doc_id
            payload = struct.pack("<q", key) + ids.astype(kind).tobytes()
            head = struct.pack("<Q", len(payload))
            d.write(head + struct.pack("<I", masked_crc(head)) + payload + struct.pack("<I", masked_crc(payload)))
            x.write(struct.pack("<QqII", at, key, len(ids), 0))
            at += len(payload) + 16
            n_docs, n_ids = n_docs + 1, n_ids + len(ids)
    for f in (data, index):
        fs.move(f"{path}/.{f}.{attempt}", f"{path}/{f}")
    return f"{folder}/{data}", f"{folder}/{index}", n_docs, n_ids


def _payload(f, offset: int | None = None) -> bytes | None:
    if offset is not None:
        f.seek(offset)
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("a record's length is damaged")
    size = struct.unpack("<Q", head[:8])[0]
    body = f.read(size + 4)
    if len(body) < size + 4 or masked_crc(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("a record's payload is damaged")
    return body[:size]


def _decode(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    key = struct.unpack_from("<q", payload)[0]
    return (None if key == NULL_ID else key), np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=8)


def read_index(uri: str) -> tuple[int, np.ndarray]:
    """Bytes per id, and a row (offset, doc_id, n_ids) per record."""
    fs, path = _filesystem(uri)
    with fs.open_input_file(path) as f:
        raw = f.read()
    if raw[:8] != MAGIC:
        raise ValueError(f"{uri} is no index of records")
    rows = np.frombuffer(raw, np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("n_ids", "<u4"), ("zero", "<u4")]), offset=16)
    return struct.unpack_from("<II", raw, 8)[1], rows


def read_records(data_uri: str, index_uri: str, order: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records in file order, or those at the given positions in that order (a shuffled read by the index)."""
    width, rows = read_index(index_uri)
    fs, path = _filesystem(data_uri)
    if order is None:
        with fs.open_input_stream(path, buffer_size=1 << 20) as f:
            while (payload := _payload(f)) is not None:
                yield _decode(payload, width)
    else:
        with fs.open_input_file(path) as f:
            for k in order:
                yield _decode(_payload(f, int(rows["offset"][k])), width)


def _writer(folder: str, tokenizer: str, end_id: int | None, width: int, by_chunk: bool) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encode = encoder(tokenizer, by_chunk)
        tail = np.array([] if end_id is None else [end_id], np.uint32)

        def records() -> Iterator[tuple[int | None, np.ndarray]]:
            for block in blocks(batches, "text"):
                ids, offsets = encode.block(block.column("text"))
                for doc_id, a, b in zip(block.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    yield doc_id, np.concatenate((ids[a:b], tail))

        row = write_records(records(), folder, f"part-{task.partitionId():06d}", str(task.taskAttemptId()), width)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((task.partitionId(), *row), _MANIFEST_ARROW)], schema=_MANIFEST_ARROW)

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, by_chunk: bool = True) -> list:
    """Encodes every text (null: empty), appends end_id and writes record files under folder, in ascending order of id
    over the files and within each; null ids come first and repeated ids stand side by side, ordered by their texts. A text
    of any length is one record, encoded in a block of its own; other columns are not read. Ids take two bytes each if
    the vocabulary allows it. Returns the manifest: one row (task, data, index, n_docs, n_ids) per file, sorted; that is
    one row per partition, so the driver may hold it. An empty table gives an empty manifest or empty files.
    """
    from tokenizers import Tokenizer

    tuned(docs.sparkSession)
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), (end_id or 0) + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made = rows.mapInArrow(_writer(folder, tokenizer, end_id, 2 if size <= 1 << 16 else 4, by_chunk), _MANIFEST)
    return sorted(made.collect(), key=lambda r: r["task"])


def read_tokens(spark, manifest: list) -> DataFrame:
    """Reads the files back, checksums verified. One row per document: doc_id, start (ids in all documents before it),
    n_tokens, ids_crc32 (of the ids as little-endian u32), file, position."""
    at, rows = 0, []
    for r in manifest:
        rows.append((at, r["data"], r["index"]))
        at += r["n_ids"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string()), ("position", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, index in zip(*(c.to_pylist() for c in batch.columns)):
                out = []
                for k, (doc_id, ids) in enumerate(read_records(data, index)):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), data, k))
                    start += len(ids)
                    if len(out) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    files = spark.createDataFrame(rows, "start long, data string, index string").repartition(max(1, len(rows)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, position long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_output(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    manifest = write_tokens(docs, workspace(spark, "tokens"), default_tokenizer())
    return read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_token_output(spark, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
