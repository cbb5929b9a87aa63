"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes,
calibrated scores and the neighbours as evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import LOWER, blocks, span_hashes, spread, table, tuned, utf8
from framelake.llm.cotraining import _sigmoid
from framelake.llm.decontaminate import words_of

#: At most so many labelled documents are indexed, and so many others calibrate the votes; drawn by hash of their ids.
EXAMPLES, CALIBRATION = 4000, 2500
#: A term's weight rises from 0 at the first of these chi-squares to 1 at the second; so many examples halve a rare term's.
NOISE, SURE, SHRINK = 5.0, 16.0, 6.0
NEIGHBOURS, BLOCK = 15, 64
THRESHOLD = 0.3


#: Besides whole words, their beginnings of so many bytes are terms: compounds and inflections share them.
PREFIXES = (5, 7)


def term_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the row of every term of the texts; words as in decontaminate.words_of."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes, rows = [span_hashes(data, starts, ends)], [row]
    for k in PREFIXES:
        long = ends - starts > k
        hashes.append(span_hashes(data, starts[long], starts[long] + k) ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


def document_terms(column, vocabulary: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct terms' hashes and their counts; only those of a sorted vocabulary if one is given."""
    hashes, rows = term_hashes(column)
    if vocabulary is not None:
        at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
        hit = np.flatnonzero(vocabulary[at] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
        hashes, rows = hashes[hit], rows[hit]
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])))) if len(hashes) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((new, [len(hashes)])))
    cuts = np.searchsorted(rows[new], np.arange(len(column) + 1))
    return [(hashes[new[x:y]], counts[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]


def terms_of(texts: list[str | None], vocabulary: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The terms of a bounded number of texts, a few texts at a time."""
    return [t for a in range(0, len(texts), 50) for t in document_terms(pa.array([x or "" for x in texts[a : a + 50]], pa.string()), vocabulary)]


def vocabulary_of(terms: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the terms of the examples, and each one's weight by how far its presence goes with the labels, by
    the chi-square of its counts. Terms of weight 0 are no different from the others' absence and are left out; there is
    no limit to the number of others."""
    n1, n = y.sum(), len(y)
    have, c = np.unique(np.concatenate([h for h, _ in terms] or [np.zeros(0, np.uint64)]), return_counts=True)
    with1, a1 = np.unique(np.concatenate([h for (h, _), label in zip(terms, y) if label] or [np.zeros(0, np.uint64)]), return_counts=True)
    a = np.zeros(len(have))
    a[np.searchsorted(have, with1)] = a1
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.where((c < n) & (0 < n1 < n), n * (a * (n - n1) - (c - a) * n1) ** 2 / (c * (n - c) * n1 * (n - n1)), 0.0)
    # what few examples have is less sure
    sure = chi2 * c / (c + SHRINK)
    told = np.clip((sure - NOISE) / (SURE - NOISE), 0, 1)
    return have[told > 0], told[told > 0]


def vectors(terms: list[tuple[np.ndarray, np.ndarray]], vocabulary: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit TF-IDF vectors over the vocabulary: (terms, weights); a text without its terms has an empty one."""
    out = []
    for h, c in terms:
        at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
        hit = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
        t = at[hit]
        w = (1 + np.log(c[hit])) * idf[t]
        norm = np.sqrt((w * w).sum())
        out.append((t, w / norm) if norm > 0 else (t[:0], w[:0]))
    return out


@dataclass
class Index:
    """Postings by term in order of example: places and weights, cut into runs, one for each block of BLOCK examples that has
    the term, with the largest weight of the run."""

    ids: np.ndarray
    labels: np.ndarray
    places: np.ndarray
    weights: np.ndarray
    first: np.ndarray  # of each term, its first run
    run_block: np.ndarray
    run_start: np.ndarray  # of each run, its first posting, and the end of the last
    run_max: np.ndarray

    @classmethod
    def of(cls, ids: list, labels: np.ndarray, rows: list, n_terms: int) -> "Index":
        terms = np.concatenate([t for t, _ in rows] or [np.zeros(0, np.int64)])
        places = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
        weights = np.concatenate([w for _, w in rows] or [np.zeros(0)])
        order = np.lexsort((places, terms))
        terms, places, weights = terms[order], places[order].astype(np.int32), weights[order]
        block = places // BLOCK
        start = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])))) if len(terms) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(weights, start) if len(start) else np.zeros(0)
        first = np.searchsorted(terms[start], np.arange(n_terms + 1))
        return cls(np.array(ids, np.int64), labels, places, weights, first, block[start], np.append(start, len(terms)), top)

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine above 0, ties by place. Blocks are read by falling bound until no block
        can hold a better one."""
        runs = _ranges(self.first[t], self.first[t + 1])
        by_run = np.repeat(w, self.first[t + 1] - self.first[t])
        block = self.run_block[runs]
        n_blocks = -(-len(self.ids) // BLOCK)
        bounds = np.bincount(block, by_run * self.run_max[runs], n_blocks)
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(-bounds, kind="stable")
        rank = np.empty(n_blocks, np.int64)
        rank[order] = np.arange(n_blocks)
        at, width = 0, 8
        while at < n_blocks and bounds[order[at]] > 0 and (len(scores) < k or bounds[order[at]] >= scores[-1] - 1e-12):
            part = np.flatnonzero((rank[block] >= at) & (rank[block] < at + width))
            a, b = self.run_start[runs[part]], self.run_start[runs[part] + 1]
            posts = _ranges(a, b)
            s = np.bincount(self.places[posts], self.weights[posts] * np.repeat(by_run[part], b - a), len(self.ids))
            keep = np.flatnonzero(s > 0)
            places, scores = np.concatenate((places, keep)), np.concatenate((scores, s[keep]))
            best = np.lexsort((places, -np.round(scores, 12)))[:k]
            places, scores = places[best], scores[best]
            at, width = at + width, 2 * width
        return places, scores


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers from a to before b of each pair, one after another."""
    n = b - a
    ends = np.cumsum(n)
    return np.repeat(a - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def vote(labels: np.ndarray, scores: np.ndarray) -> tuple[float, float, float]:
    """Share of the label among neighbours, weighted by 1 / (distance + 0.1), the largest cosine, and by how much the nearest
    neighbour with the label is nearer than the nearest without."""
    if not len(scores):
        return 0.0, 0.0, 0.0
    w = 1 / (1.1 - np.minimum(scores, 1.0))
    lead = scores[labels > 0].max(initial=0.0) - scores[labels <= 0].max(initial=0.0)
    return float((w * labels).sum() / w.sum()), float(scores[0]), float(lead)


@dataclass
class Model:
    vocabulary: np.ndarray
    idf: np.ndarray
    index: Index
    calibration: np.ndarray

    def score(self, terms: list) -> list[tuple[float, np.ndarray, np.ndarray]]:
        out = []
        for t, w in vectors(terms, self.vocabulary, self.idf):
            places, scores = self.index.nearest(t, w) if len(t) else (np.zeros(0, np.int64), np.zeros(0))
            x = _features(*vote(self.index.labels[places], scores))
            out.append((float(_sigmoid(self.calibration @ x)), self.index.ids[places], scores))
        return out


def _features(v: float, top: float, lead: float) -> np.ndarray:
    return np.array([1.0, v - 0.5 if top else 0.0, (v - 0.5) * top, float(top > 0), lead, v * v])


def _calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a weak prior, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        d = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (p - y) + 0.1 * w)
        w = w - d * min(1.0, 1.0 / max(np.abs(d).max(), 1e-12))
    return w


def _document_counts(rows: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each term is, and the number of documents, over the whole table."""
    known = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = known.value
        total, n = np.zeros(len(v) + 1, np.int64), 0
        for block in blocks(batches, "text"):
            hashes, rows_of = term_hashes(block.column("text"))
            at = np.minimum(np.searchsorted(v, hashes), max(len(v) - 1, 0))
            hit = np.flatnonzero(v[at] == hashes) if len(v) else np.zeros(0, np.int64)
            pairs = np.unique(rows_of[hit] * (len(v) + 1) + at[hit])
            total += np.bincount(pairs % (len(v) + 1), minlength=len(v) + 1)
            n += block.num_rows
        total[-1] = n
        found = np.flatnonzero(total)
        for k in range(0, len(found), 50_000):
            part = found[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["term", "n"])

    sums = rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1)
    out[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return out[:-1], int(out[-1])


def fit(rows: DataFrame, labels: DataFrame, may_learn: Callable, examples: int = EXAMPLES, calibration: int = CALIBRATION) -> Model | None:
    """Index and calibration from at most ``examples`` + ``calibration`` labelled documents for which may_learn(id) holds;
    the terms' document counts are those of the whole table. None without two labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), "toxic").where("toxic IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
    drawn = known.where(may_learn(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(examples + calibration).collect()
    wanted = rows.sparkSession.createDataFrame([(r["id"], k, float(r["toxic"])) for k, r in enumerate(drawn)], "doc_id long, k long, toxic double")
    got = rows.join(F.broadcast(wanted), "doc_id").select("doc_id", "k", "toxic", "text").dropDuplicates(["doc_id"]).orderBy("k").collect()
    first, rest = got[:examples], got[examples:]
    if len(rest) < 50:  # few labels: a third calibrates
        first, rest = [r for k, r in enumerate(got) if k % 3], got[::3]
    y = np.array([r["toxic"] for r in first])
    if len(set(y.tolist())) < 2:
        return None
    terms = terms_of([r["text"] for r in first])
    vocabulary, told = vocabulary_of(terms, y)
    counts, n = _document_counts(rows, vocabulary)
    idf = (np.log((1 + n) / (1 + counts)) + 1) * told
    index = Index.of([r["doc_id"] for r in first], y, vectors(terms, vocabulary, idf), len(vocabulary))
    model = Model(vocabulary, idf, index, np.zeros(6))
    x = []
    for t, w in vectors(terms_of([r["text"] for r in rest], vocabulary), vocabulary, idf):
        places, scores = index.nearest(t, w) if len(t) else (np.zeros(0, np.int64), np.zeros(0))
        x.append(_features(*vote(y[places], scores)))
    model.calibration = _calibrated(np.array(x), np.array([r["toxic"] for r in rest]))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, may_learn: Callable | None = None, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """One row per document: doc_id, score (probability of label 1), predicted (1 if score >= threshold), neighbours (ids
    of the nearest examples, nearest first) and similarities.

    Words are lower-cased A-Z; the vectors have all terms of the examples that go with the labels, weighted by counts over all
    documents and by how far they do. Empty and null texts, and texts without such terms, have no neighbours and
    the score of their kind. Ties of similarity go by the order in which examples were drawn. A text of any length is scored whole,
    in a block of its own. Other columns are not read. Only
    texts and labels are used. Repeated rows get equal rows, null ids are scored; labels other than 0 and 1 and labels of
    null ids are left out; of several for one id the largest counts. Without two labels every score is 0. An empty table
    gives an empty result.
    """
    tuned(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = spread(rows)
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, may_learn or (lambda i: F.lit(True)), **bounds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            m = model.value
            got = m.score(document_terms(block.column("text"), m.vocabulary)) if m else [(0.0, [], [])] * block.num_rows
            s = [g[0] for g in got]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), pa.array([list(g[1]) for g in got], pa.list_(pa.int64())), pa.array([list(g[2]) for g in got], pa.list_(pa.float64()))],
                names=["doc_id", "score", "predicted", "neighbours", "similarities"],
            )

    return rows.mapInArrow(score, "doc_id long, score double, predicted int, neighbours array<long>, similarities array<double>")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "neighbours")
