"""Benchmark decontamination by suffix arrays of the training text, searched for every test suffix, shard by shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import LOWER, blocks, runs, span_hashes, spread, table, tuned, unused, utf8

WINDOW = 10
#: Bytes of benchmark text that are sent to the executors at once; a larger benchmark is searched for in several blocks.
BENCHMARK_BLOCK = 8 << 20

#: Bytes of a word: digits, letters (A-Z are lower-cased first) and all bytes of characters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True

_SCHEMA = "doc_id long, n_words long, fingerprint string, hits array<int>, items array<long>, longest long, longest_item long, longest_start long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("fingerprint", pa.string()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.int64())), ("longest", pa.int64()), ("longest_item", pa.int64()), ("longest_start", pa.int64())])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in lower-cased bytes, and the first word of each row (one more at the end)."""
    starts, ends = runs(_WORD[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


class TestSuffixes:
    """The windows of a block of benchmark items: the suffixes of the items, cut at the window's length."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        column = pa.array([t or "" for _, t in items], pa.string())
        data, offsets = utf8(column)
        data = LOWER[data]
        starts, ends, first = words_of(data, offsets)
        hashes = span_hashes(data, starts, ends)
        self.window = window
        self.vocabulary, where = np.unique(hashes, return_index=True)
        self.spelling = [data[starts[k] : ends[k]].tobytes() for k in where]
        ids = np.searchsorted(self.vocabulary, hashes) + 1
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.per_key = 64 // self.bits
        self.columns = -(-window // self.per_key)
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, (item_id, _) in enumerate(items):
            own = ids[first[k] : first[k + 1]].tolist()
            for j in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[j : j + window]), []).append((item_id, j))
        self.windows = sorted(found)
        self.places = [found[w] for w in self.windows]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.shortest = int(self.lengths.min()) if self.windows else 0
        top = (1 << self.bits) - 1
        low = np.array([w + (0,) * (window - len(w)) for w in self.windows], np.uint64).reshape(-1, window)
        high = np.array([w + (top,) * (window - len(w)) for w in self.windows], np.uint64).reshape(-1, window)
        self.low, self.high = self.packed(low.T), self.packed(high.T)

    def packed(self, columns: list[np.ndarray] | np.ndarray) -> np.ndarray:
        """Word ids, one array per place, as byte strings whose order is that of the ids."""
        n = len(columns[0]) if len(columns) else 0
        out = np.zeros((n, self.columns), ">u8")
        for k in range(self.columns):
            key = np.zeros(n, np.uint64)
            for c in columns[k * self.per_key : (k + 1) * self.per_key]:
                key = (key << np.uint64(self.bits)) | c
            out[:, k] = key
        return out.view(f"S{8 * self.columns}").reshape(-1) if n else np.zeros(0, f"S{8 * self.columns}")


def _shard(block: pa.RecordBatch, tests: TestSuffixes) -> Iterator[tuple]:
    """Builds the suffix array of one shard of training documents and searches it for each test suffix.

    Only suffixes that can match are sorted: those that begin with as many words of the benchmark's vocabulary as its
    shortest window has."""
    data, offsets = utf8(block.column("text"))
    raw = data
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets)
    n_docs = block.num_rows
    doc_ids = block.column("doc_id").to_pylist()
    n_words = np.diff(first)
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    if tests.windows and len(starts):
        hashes = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
        ids = np.where(tests.vocabulary[at] == hashes, at + 1, 0).astype(np.uint64)
        # the next place at or after each word that ends a match: an unknown word or the end of the document
        doc_end = np.repeat(first[1:], n_words)
        stop = np.where(ids == 0, np.arange(len(ids)), len(ids))
        stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], doc_end)
        suffixes = np.flatnonzero(stop - np.arange(len(ids)) >= tests.shortest)
        if len(suffixes):
            padded = np.concatenate((ids, np.zeros(tests.window, np.uint64)))
            columns = [np.where(suffixes + k < stop[suffixes], padded[suffixes + k], np.uint64(0)) for k in range(tests.window)]
            keys = tests.packed(columns)
            order = np.argsort(keys, kind="stable")
            array, sorted_keys = suffixes[order], keys[order]
            lo = np.searchsorted(sorted_keys, tests.low, "left")
            hi = np.searchsorted(sorted_keys, tests.high, "right")
            for w in np.flatnonzero(hi > lo):
                places, length = array[lo[w] : hi[w]], int(tests.lengths[w])
                spelled = [tests.spelling[i - 1] for i in tests.windows[w][:length]]
                docs = np.searchsorted(first, places, "right") - 1
                for p, d in zip(places.tolist(), docs.tolist()):
                    if all(data[starts[p + k] : ends[p + k]].tobytes() == spelled[k] for k in range(length)):
                        found.setdefault(d, []).append((p - int(first[d]), length, int(w), 0))
    for d in range(n_docs):
        hits = found.get(d)
        fingerprint = ""
        if not hits:
            yield doc_ids[d], int(n_words[d]), fingerprint, [], [], 0, None, None
            continue
        fingerprint = hashlib.md5(raw[offsets[d] : offsets[d + 1]].tobytes()).hexdigest()
        positions = sorted({p + k for p, length, *_ in hits for k in range(length)})
        items = sorted({item for *_, w, _ in hits for item, _ in tests.places[w]})
        # windows that follow each other in both texts make one longer verbatim match
        chains: dict[tuple[int, int, int], tuple[int, int]] = {}
        longest, of, start = 0, None, None
        for p, length, w, _ in sorted(hits):
            for item, j in tests.places[w]:
                begun, _ = chains.get((item, j - 1, p - 1), (p, 0))
                chains[item, j, p] = (begun, 0)
                if p - begun + length > longest:
                    longest, of, start = p - begun + length, item, begun
        yield doc_ids[d], int(n_words[d]), fingerprint, positions, items, longest, of, start


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _searched(rows: DataFrame, items: list[tuple[int, str]], window: int) -> DataFrame:
    tests = rows.sparkSession.sparkContext.broadcast(TestSuffixes(items, window))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            yield _batch(list(_shard(block, tests.value)))

    return rows.mapInArrow(search, _SCHEMA)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BENCHMARK_BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, hits (places of the words inside any occurrence of a window), items (ids of
    the items with occurring windows), longest, longest_item, longest_start (longest verbatim match, its item and its
    first word; of equals, the first).

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A window is ``window`` consecutive
    words of an item; a shorter, not empty item is one window. Null and empty texts have no words; items without words
    match nothing; a null item id is left out. An empty benchmark gives no hits, an empty table no rows; repeated rows
    give equal rows. A text longer than a block is searched by itself, whole. Other columns are not read. The benchmark is broadcast in blocks of at most about block_bytes of text, and the hits of the
    blocks are united by document id and text.
    """
    spark = tuned(docs.sparkSession)
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    tests = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).where("i IS NOT NULL")
    total = tests.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    parts = []
    for k in range(n):
        items = [tuple(r) for r in tests.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).distinct().collect()]
        parts.append(_searched(rows, items, window))
    if n == 1:
        return parts[0].drop("fingerprint")
    # only documents with hits are grouped; the others get their counts from the table itself
    hit = parts[0].where("size(hits) > 0")
    for p in parts[1:]:
        hit = hit.unionByName(p.where("size(hits) > 0"))
    best = F.max(F.struct(F.col("longest"), (-F.col("longest_start")).alias("s"), (-F.col("longest_item")).alias("i")))
    hit = hit.groupBy("doc_id", "n_words", "fingerprint").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), best.alias("b"))
    hit = hit.select("doc_id", "fingerprint", "hits", "items", F.col("b.longest").alias("longest"), (-F.col("b.i")).alias("longest_item"), (-F.col("b.s")).alias("longest_start"))
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), ""))
    every = rows.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("fingerprint"), words.cast("long").alias("n_words"))
    joined = every.alias("e").join(hit.alias("h"), F.col("e.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("e.fingerprint") == F.col("h.fingerprint")), "left")
    empty = F.array().cast("array<int>")
    return joined.select("e.doc_id", "e.n_words", F.coalesce("h.hits", empty).alias("hits"), F.coalesce("h.items", empty.cast("array<long>")).alias("items"), F.coalesce("h.longest", F.lit(0)).cast("long").alias("longest"), "h.longest_item", "h.longest_start")


def report(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    found = find_overlaps(docs, benchmark, **names)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    n_hit = F.size("hits").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest", "longest_item", "longest_start")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """The documents without any hit, with all their columns, whatever the names of others. Rows are told apart by their
    texts, so null and repeated ids do not matter; odd inputs as in ``find_overlaps``."""
    key, bad = F.xxhash64(F.col(text_col)), unused(docs, "bad")
    found = find_overlaps(docs.select(key.alias("key"), F.col(text_col).alias("text")), benchmark, id_col="key", text_col="text", **names)
    found = found.where("size(hits) > 0").select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(found, key == F.col(bad), "left_anti")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP2_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(ws[j:j + 9], ' ') AS win, least(len(ws), 10) AS m FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS j FROM b WHERE len(ws) > 0) x),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, p, m, array_to_string(ws[p:p + m - 1], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE len(ws) > 0) x, ms WHERE p + m - 1 <= len(ws)),
h AS (SELECT d.doc_id, d.p, d.m, bw.item_id FROM dw d JOIN bw ON d.win = bw.win AND d.m = bw.m),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM h) y) z GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) y GROUP BY doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.s, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN i ON w.doc_id = i.doc_id
"""
