"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere go.

Threshold-bounded interval expansion on a Burrows-Wheeler transform: from the empty string, intervals of suffixes are
extended backwards breadth-first, which gives the common prefixes of neighbouring suffixes by increasing value, and stops
at the least length that counts. What no step reached shares at least that much.

One transform of all text would not be distributable, so the text is dealt out first, without loss: every window of
``least`` bytes has an anchor, its gram of smallest hash (the leftmost of equals). Equal windows have equal anchors at
equal places. A segment is a run of windows with one anchor; segments of equal anchors are dealt to one transform, equal
segments as one with their number, and anchors that occur once are left out. Anchors with very many different segments
are dealt out further, by the bytes that neighbouring windows share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import blocks, cut, mix, powers, release, spread, table, tuned, utf8

LEAST = 400
#: Bytes of a gram, as a share of the least length.
GRAM_SHARE = 0.32
#: Different segments of one anchor that go to one transform; with more, windows are dealt out in bands of so many starts.
SEGMENTS, BANDS = 4000, (16, 1)
#: Bytes of segments in one transform, unless one anchor has more.
TRANSFORM = 250_000
#: Up to this value common prefixes are spread over whole arrays; beyond, from the last ones found only.
DENSE = 14
#: Rows of an interval that are gone through one by one, all intervals at once.
STEPS = 8
#: Share of all rows that may become boundaries before the list of boundaries is made again.
STALE = 1 / 64
#: Window starts of one text that are looked at together.
STRETCH = 4_000_000


def _anchors(data: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's place for each window start, and the hash of the gram at each place."""
    n = len(data)
    p, q = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * q[: n - gram + 1])
    width = least - gram + 1
    low = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return (low & np.uint64(0xFFFFFF)).astype(np.int64), grams.view(np.int64)


def _hash128(b: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(b)
    return (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63


def segments_of(texts: list[bytes], least: int, gram: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, first window start, windows, anchor's place, gram hash) of all segments of a few texts."""
    for k, text in enumerate(texts):
        for base in range(0, max(len(text) - least + 1, 0), STRETCH):
            data = np.frombuffer(text, np.uint8, min(STRETCH + least - 1, len(text) - base), base)
            at, grams = _anchors(data, least, gram)
            cuts = np.flatnonzero(np.diff(at)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                yield k, base + a, b - a, base + int(at[a]), int(grams[at[a]])


_OCCURRENCE = pa.schema([("g", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("print", pa.int64()), ("s0", pa.int64()), ("n", pa.int32()), ("rel", pa.int32())])


def _occurrences(least: int, gram: int) -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            data, offsets = utf8(block.column("text"))
            ids, prints = block.column("doc_id").to_pylist(), block.column("print").to_pylist()
            whole = data.tobytes()
            texts = [whole[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            rows = []
            for k, s0, n, at, g in segments_of(texts, least, gram):
                rows.append((g, *_hash128(texts[k][s0 : s0 + n + least - 1]), ids[k], prints[k], s0, n, at - s0))
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OCCURRENCE)], schema=_OCCURRENCE)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OCCURRENCE)], schema=_OCCURRENCE)

    return make


# --- the transform --------------------------------------------------------------------------------------------------


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes by their first ``depth`` symbols at least, by doubling. Symbols are below 2^16."""
    n = len(symbols)
    padded = np.concatenate((symbols.astype(np.uint64) + np.uint64(1), np.zeros(4, np.uint64)))
    key = np.zeros(n, np.uint64)
    for k in range(4):
        key = (key << np.uint64(16)) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    length = 4
    part, where = order, np.arange(n)
    key = key[order]
    rank = np.zeros(n + depth, np.int64)  # the place, from 1, of the first of the suffixes that are equal so far; 0 beyond the end
    while True:
        first = np.concatenate(([True], key[1:] != key[:-1], [True]))
        group = where[np.maximum.accumulate(np.where(first[:-1], np.arange(len(part)), 0))] + 1
        rank[part] = group
        # only suffixes that still are equal to a neighbour move
        tied = np.flatnonzero(~(first[:-1] & first[1:]))
        if length >= depth or not len(tied):
            return order
        part, where = part[tied], where[tied]
        key = group[tied] * (n + 2) + rank[part + length]
        sub = np.argsort(key, kind="stable")
        part, key = part[sub], key[sub]
        order[where] = part
        length *= 2


def short_prefixes(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """lcp[r]: the length of the common prefix of the suffixes at r - 1 and r if it is below ``least``, else -1.

    Breadth-first: of the boundaries of value v, the intervals that begin there are extended backwards by each symbol
    that occurs in them; a boundary that is reached first from value v has value v + 1.
    """
    n = len(symbols)
    transform = symbols[order - 1]
    by_symbol = np.argsort(transform, kind="stable")
    step = np.empty(n, np.int64)  # a row's place after its preceding symbol is put before it
    step[by_symbol] = np.arange(n)
    before = np.full(n, -1, np.int64)  # the row before it with the same preceding symbol
    same = transform[by_symbol[1:]] == transform[by_symbol[:-1]]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    lcp = np.full(n + 1, -1, np.int32)
    lcp[0] = lcp[n] = 0
    lcp[np.flatnonzero(~same) + 1] = 0
    places = np.arange(n)
    value = 0
    while value < min(DENSE, least - 1):
        opened = np.maximum.accumulate(np.where(lcp[:n] >= 0, places, 0))
        rows = np.flatnonzero((lcp[opened] == value) & (before < opened))
        to = step[rows]
        to = to[lcp[to] < 0]
        lcp[to] = value + 1
        value += 1
    front = np.flatnonzero(lcp[:n] == value)
    slot = np.empty(n + 1, np.int64)
    known, fresh = None, 0
    while value < least - 1 and len(front):
        start = row = front
        reached = []
        for turn in range(STEPS + 1):
            if not len(row):
                break
            if turn == STEPS:  # few long intervals are left: list their rows up to the next boundary that is known
                if known is None or fresh > STALE * n:
                    known, fresh = np.flatnonzero(lcp >= 0), 0
                # known may be old and the list too long. A row past its interval does no harm: what lies between it and the row
                # before it of its symbol has a boundary of this value or a lower one, so its place has value + 1 or is reached
                size = known[np.searchsorted(known, row)] - row
                first = np.cumsum(size) - size
                row = np.repeat(row - first, size) + np.arange(size.sum())
                start = np.repeat(start, size)
            to = step[row[before[row] < start]]
            to = to[lcp[to] < 0]
            reached.append(to)
            go = lcp[row + 1] < 0
            start, row = start[go], row[go] + 1
        value += 1
        front = np.concatenate(reached)
        turns = np.arange(len(front))
        slot[front] = turns
        front = front[slot[front] == turns]
        lcp[front] = value
        fresh += len(front)
    return lcp[:n]


def repeated_windows(segments: list[bytes], weights: list[int], least: int) -> list[tuple[list[int], list[int]]]:
    """For each segment the runs [a, b) of its window starts whose window occurs again, in any segment or as another copy
    of the same one."""
    lengths = np.array([len(s) + 1 for s in segments])
    ends = np.cumsum(lengths)
    symbols = np.zeros(ends[-1], np.uint16)
    flat = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    symbols[:] = flat.astype(np.uint16) + len(segments)
    symbols[ends - 1] = np.arange(len(segments))  # separators differ from all else and from each other
    order = suffix_array(symbols, least)
    lcp = short_prefixes(symbols, order, least)
    long = np.flatnonzero(lcp < 0)
    again = np.zeros(len(symbols) + 1, bool)
    again[order[long]] = True
    again[order[long - 1]] = True
    out = []
    for a, b, w in zip(ends - lengths, ends, weights):
        n = int(b - a) - least  # window starts
        if w > 1:
            out.append(([0], [n]))
            continue
        flags = np.diff(np.concatenate(([False], again[a : a + n], [False])).astype(np.int8))
        out.append((np.flatnonzero(flags > 0).tolist(), np.flatnonzero(flags < 0).tolist()))
    return out


_FOUND = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _transformed(least: int) -> Callable:
    """Rows (g, hi, lo, c, bytes), sorted by g, in; rows with repeated windows out."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_windows([r[3] for r in rows], [r[2] for r in rows], least)
        return listed([(r[0], r[1], *f) for r, f in zip(rows, found) if f[0]])

    def listed(kept: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept) if kept else [[]] * 4, _FOUND)], schema=_FOUND)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, group, size, last = [], [], 0, None
        alone: list[tuple] = []

        def close() -> int:
            # the windows of one segment all differ, so a group of one has nothing to sort: its number tells
            if len(group) > 1:
                rows.extend(group)
                return sum(len(r[3]) for r in group)
            if group and group[0][2] > 1:
                hi, lo, _, b = group[0]
                alone.append((hi, lo, [0], [len(b) - least + 1]))
            return 0

        for batch in batches:
            for g, hi, lo, c, b in zip(*(batch.column(x).to_pylist() for x in ("g", "hi", "lo", "c", "bytes"))):
                if g != last:
                    size += close()
                    group = []
                    last = g
                    if size >= TRANSFORM:
                        yield solve(rows)
                        rows, size = [], 0
                    if len(alone) >= 20_000:
                        yield listed(alone)
                        alone = []
                group.append((hi, lo, c, b))
        close()
        if rows:
            yield solve(rows)
        if alone:
            yield listed(alone)

    return make


_BYTES = "g long, hi long, lo long, c long, n int, rel int, bytes binary"


def _fetched(least: int) -> Callable:
    """Cuts the segments (s0, n, ...) out of each document's text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            rows = []
            for text, wanted in zip(block.column("text").to_pylist(), block.column("wanted").to_pylist()):
                raw = (text or "").encode()
                rows += [(w["g"], w["hi"], w["lo"], w["c"], w["n"], w["rel"], raw[w["s0"] : w["s0"] + w["n"] + least - 1]) for w in wanted]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["g", "hi", "lo", "c", "n", "rel", "bytes"])

    return make


def _banded(least: int, width: int) -> Callable:
    """Deals the windows of each segment out in bands of ``width`` starts, by their distance to the anchor. A band's key is
    the bytes that all its windows have, so equal windows meet."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for hi, lo, c, n, rel, b in zip(*(batch.column(x).to_pylist() for x in ("hi", "lo", "c", "n", "rel", "bytes"))):
                # window s is at distance rel - s of the anchor
                for band in range((rel - n + 1) // width, rel // width + 1):
                    first, last = max(0, rel - (band + 1) * width + 1), min(n - 1, rel - band * width)
                    if first <= last:
                        core = b[rel - band * width : rel - (band + 1) * width + 1 + least]
                        part = b[first : last + least]
                        rows.append((_hash128(core + band.to_bytes(4, "big", signed=True))[0], *_hash128(part), c, last - first + 1, rel - first, part, hi, lo, first))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["g", "hi", "lo", "c", "n", "rel", "bytes", "up_hi", "up_lo", "off"])

    return make


def _solved(segments: DataFrame, least: int, most: int, bands: tuple[int, ...]) -> DataFrame:
    """(hi, lo, starts, ends) of different segments (g, hi, lo, c, n, rel, bytes)."""
    large = segments.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most).select("g")
    found = "hi long, lo long, starts array<int>, ends array<int>"
    if not bands or large.isEmpty():
        return segments.select("g", "hi", "lo", "c", "bytes").repartition("g").sortWithinPartitions("g").mapInArrow(_transformed(least), found)
    small = _solved(segments.join(large, "g", "left_anti"), least, most, ())
    parts = cut(segments.join(large, "g", "left_semi").mapInArrow(_banded(least, bands[0]), _BYTES + ", up_hi long, up_lo long, off int"))
    unequal = parts.groupBy("g", "hi", "lo").agg(F.sum("c").alias("c"), F.first("n").alias("n"), F.first("rel").alias("rel"), F.first("bytes").alias("bytes"))
    again = _solved(cut(unequal), least, most, bands[1:])
    up = parts.select("hi", "lo", "up_hi", "up_lo", "off").join(again, ["hi", "lo"])
    shift = lambda x: F.transform(x, lambda v: v + F.col("off"))
    return small.unionByName(up.select(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo"), shift("starts").alias("starts"), shift("ends").alias("ends")))


def _removed(least: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed_starts", pa.list_(pa.int64())), ("removed_ends", pa.list_(pa.int64())), ("kept", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            rows = []
            for doc_id, text, found in zip(*(block.column(c).to_pylist() for c in ("doc_id", "text", "found"))):
                raw = (text or "").encode()
                spans: list[list[int]] = []
                for a, b in sorted((f["s0"] + x, f["s0"] + y + least - 1) for f in found or () for x, y in zip(f["starts"], f["ends"])):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept = b"".join(raw[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)]))
                rows.append((doc_id, len(raw), [s[0] for s in spans], [s[1] for s in spans], kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return make


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = SEGMENTS) -> DataFrame:
    """One row per document: doc_id, n_bytes, removed_starts, removed_ends (maximal removed runs, in bytes of the UTF-8
    text), kept (the remaining bytes, which may cut a character).

    Every byte goes that is covered by a string of ``least`` bytes that also starts anywhere else, in the same document
    too; overlaps count. Null is an empty text; texts shorter than ``least`` keep all. Repeated rows are copies of each
    other and lose what is repeated; null ids are documents too; an empty table gives an empty result. A text of any length
    is searched whole, a stretch of window starts at a time. Other columns are not read, whatever their names.
    """
    spark = tuned(docs.sparkSession)
    gram = max(8, int(least * GRAM_SHARE))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("print", F.xxhash64("text"))
    occurrence = "g long, hi long, lo long, doc_id long, print long, s0 long, n int, rel int"
    occurrences = spread(rows.where(F.octet_length("text") >= least)).mapInArrow(_occurrences(least, gram), occurrence)
    shared = occurrences.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("g")
    occurrences = cut(occurrences.join(shared, "g"))
    release(spark)
    first = F.min(F.struct("doc_id", "print", "s0")).alias("at")
    unequal = occurrences.groupBy("g", "hi", "lo").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("rel").alias("rel"), first)
    wanted = unequal.groupBy(F.col("at.doc_id").alias("d"), F.col("at.print").alias("p")).agg(F.collect_list(F.struct("g", "hi", "lo", "c", "n", "rel", F.col("at.s0").alias("s0"))).alias("wanted"))
    fetched = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p"))).select("text", "wanted")
    segments = fetched.mapInArrow(_fetched(least), _BYTES)
    segments = cut(segments.dropDuplicates(["g", "hi", "lo"]))
    release(spark)
    found = cut(_solved(segments, least, most, BANDS))
    release(spark)
    marked = occurrences.select("hi", "lo", "doc_id", "print", "s0").join(found, ["hi", "lo"])
    marked = marked.groupBy(F.col("doc_id").alias("d"), F.col("print").alias("p")).agg(F.collect_set(F.struct("s0", "starts", "ends")).alias("found"))
    both = rows.join(marked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")), "left")
    return both.select("doc_id", "text", "found").mapInArrow(_removed(least), "doc_id long, n_bytes long, removed_starts array<long>, removed_ends array<long>, kept binary")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("removed_starts", "removed_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda t, x: t + x)
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
