"""Substring dedup by sliding sentence spans: every run of several consecutive sentences is hashed, spans are joined over
all documents, and sentences covered by a span that is not the first of its kind go."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import mix, spread, table, tuned

#: Consecutive sentences in a span.
SPAN = 3
#: A span of fewer words is no evidence of copying: short sentences meet by chance.
MIN_WORDS = 12
#: Pieces of a sentence begin at words whose following GRAM words hash lower than those of REACH words around.
GRAM, REACH = 3, 3
#: Where a few words repeat on and on, pieces have so many words: a multiple of every period up to REACH.
PERIODIC = 12
#: Characters of text that are cut at a time.
TOGETHER = 300_000

_END = re.compile(r"[.!?]+[\s]+|\n+")
_WEIGHTS = [np.uint64(w) for w in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@cache
def _words(n: int) -> re.Pattern:
    return re.compile(rf"\s*+(?:\S++\s++){{{n}}}")


def _piece_starts(long: list[list[str]]) -> list[list[int]]:
    """Of sentences given by their words, the words, by number, at which a further piece begins. They are chosen by the words
    around alone and not counted from the sentence's start, so that a copied passage falls into the same pieces wherever it
    stands. No piece has REACH words or fewer."""
    words = [w for u in long for w in u]
    h = np.fromiter(map(zlib.crc32, "\n".join(words).lower().encode().split(b"\n")), np.uint64, len(words))
    sizes = np.fromiter(map(len, long), np.int64, len(long))
    ends = np.cumsum(sizes)
    # sentences stand REACH places apart, so that none sees words of another
    at = np.arange(len(words)) + np.repeat(np.arange(1, len(long) + 1) * REACH, sizes)
    n = len(words) + REACH * (len(long) + 1)
    x = np.zeros(n + GRAM, np.uint64)
    x[at] = h + np.uint64(1)
    gram = x[:n] * _WEIGHTS[0]
    for k in range(1, GRAM):
        gram += x[k : n + k] * _WEIGHTS[k]
    v = np.full(n + 2 * REACH, np.iinfo(np.uint64).max, np.uint64)
    v[REACH : n + REACH] = np.where(x[:n] > 0, mix(gram), v[:n])
    before, after = v[:n].copy(), v[2 * REACH :].copy()
    for k in range(1, REACH):
        np.minimum(before, v[k : n + k], out=before)
        np.minimum(after, v[REACH + k : n + REACH + k], out=after)
    here = v[REACH : n + REACH]
    lowest = np.flatnonzero(((here <= before) & (here <= after))[at])
    sentence = np.searchsorted(ends, lowest, "right")
    offset = lowest - (ends - sizes)[sentence]
    inside = (offset > REACH) & (sizes[sentence] - offset > REACH)
    lowest, sentence, offset = lowest[inside], sentence[inside], offset[inside]
    alone = (here < before)[at[lowest]]
    out = [[] for _ in long]
    for s, k, first in zip(sentence.tolist(), offset.tolist(), alone.tolist()):
        if first or k - (out[s][-1] if out[s] else 0) >= PERIODIC:
            out[s].append(k)
    return out


def _whole(text: str) -> list[tuple[int, int, int, list[str]]]:
    out = []
    a = 0
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for b in ends:
        words = text[a:b].split()
        if words:
            out.append((a, b, len(words), words))
            a = b
        elif out:
            out[-1] = (out[-1][0], b, *out[-1][2:])
            a = b
    return out


def sentences_of(texts: list[str | None]) -> Iterator[list[tuple[int, int, int, list[str]]]]:
    """The sentences of each text, as ``sentences`` has them; texts are taken together up to TOGETHER characters."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size > TOGETHER:
            yield from _cut(group)
            group, size = [], 0
    yield from _cut(group)


def _cut(texts: list[str]) -> Iterator[list[tuple[int, int, int, list[str]]]]:
    wholes = [_whole(t) for t in texts]
    starts = iter(_piece_starts([u[3] for units in wholes for u in units if u[2] > 2 * REACH + 1]))
    for text, units in zip(texts, wholes):
        out = []
        for unit in units:
            a, b, n, words = unit
            cuts = next(starts) if n > 2 * REACH + 1 else ()
            if not cuts:
                out.append(unit)
                continue
            for x, y in zip([0, *cuts], [*cuts, n]):
                end = _words(y - x).match(text, a).end() if y < n else b
                out.append((a, end, y - x, words[x:y]))
                a = end
        yield out


def sentences(text: str) -> list[tuple[int, int, int, list[str]]]:
    """(start, end, number of words, words) of the sentences that make up the whole text: they end after . ! or ? before
    white space, or at a line's end, and are cut into pieces; separators belong to the sentence before them."""
    return next(_cut([text]))


def _runs(counts: list[int], span: int, min_words: int) -> list[tuple[int, int]]:
    """(start, end) of the shortest runs of ``span`` sentences and ``min_words`` words or more from each first sentence on
    and up to each last one, so that every sentence of a longer run is in one of them that the longer run holds."""
    sums = [0, *accumulate(counts)]
    out = [(a, a + span) for a in range(len(counts) - span + 1)]
    if all(sums[b] - sums[a] >= min_words for a, b in out):
        return out
    found = set()
    for a in range(len(counts)):
        b = max(a + span, bisect_left(sums, sums[a] + min_words))
        if b <= len(counts):
            found.add((a, b))
        b = a + 1
        start = min(b - span, bisect_right(sums, sums[b] - min_words) - 1)
        if start >= 0:
            found.add((start, b))
    return sorted(found)


def _spans(span: int, min_words: int) -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, places, keys = [], [], [], []
            for doc_id, fingerprint, units in zip(batch.column("doc_id").to_pylist(), batch.column("fingerprint").to_pylist(), sentences_of(batch.column("text").to_pylist())):
                digests = b"".join([xxhash.xxh3_128_digest(" ".join(u[3]).lower().encode()) for u in units])
                wanted = _runs([u[2] for u in units], span, min_words)
                keys += [xxhash.xxh3_128_digest(digests[16 * a : 16 * b]) for a, b in wanted]
                places += [a << 32 | b for a, b in wanted]
                ids += [doc_id] * len(wanted)
                prints += [fingerprint] * len(wanted)
            lo, hi = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array(places, pa.int64()), pa.array(lo), pa.array(hi)], names=["doc_id", "fingerprint", "place", "lo", "hi"])

    return make


def _cleaner() -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            doc_ids, texts, *gaps = (batch.column(c).to_pylist() for c in ("doc_id", "text", "places", "first_docs"))
            for doc_id, text, units, places, first in zip(doc_ids, texts, sentences_of(texts), *gaps):
                gone = {k for p in places or () for k in range(p >> 32, p & 0xFFFFFFFF)}
                kept = "".join(text[a:b] for k, (a, b, *_) in enumerate(units) if k not in gone) if units else (text or "")
                rows.append((doc_id, len(units), len(gone), sum(units[k][2] for k in gone), kept, sorted(set(first or ()))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))], names=["doc_id", "n_sentences", "n_removed", "n_words_removed", "clean_text", "first_docs"])

    return lambda batches: make(b for b in batches if b.num_rows)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed, n_words_removed, clean_text, first_docs (ids of the documents
    that hold the first occurrences).

    A span is a shortest run of at least ``span`` sentences and ``min_words`` words, however many short sentences that takes.
    Spans are equal when their words are, lower-cased and apart from white space. Of equal spans, the first is that of the
    smallest id (null last) and place, same document included; a sentence in any other goes. Null and empty texts have no
    sentences. Rows with the same id and text are one document and get equal rows. An empty table gives an empty result.
    Spans are made and dealt out by hash once; the first of each kind is found where they meet, and nothing is joined by hash.
    """
    tuned(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("fingerprint", F.xxhash64("text"))
    spans = spread(rows).mapInArrow(_spans(span, min_words), "doc_id long, fingerprint long, place long, lo long, hi long")
    key = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), F.col("fingerprint").alias("f"), F.col("place").alias("p"))
    later = spans.withColumn("first", F.min(key).over(Window.partitionBy("lo", "hi"))).where(key != F.col("first"))
    gone = later.groupBy("doc_id", "fingerprint").agg(F.collect_set("place").alias("places"), F.collect_set("first.d").alias("first_docs"))
    r, g = rows.alias("r"), gone.alias("g")
    both = r.join(g, F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.fingerprint") == F.col("g.fingerprint")), "left")
    return both.select("r.doc_id", "r.text", "g.places", "g.first_docs").mapInArrow(_cleaner(), "doc_id long, n_sentences long, n_removed long, n_words_removed long, clean_text string, first_docs array<long>")


def op8_sentence_spans(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
