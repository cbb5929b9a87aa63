"""Quality classifier by co-training: a text-content and a page-metadata classifier exchange confident pseudo-labels over
rounds; the calibrated views are combined to score all documents."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import blocks, spread, table, tuned, unused, workspace

#: At most so many labelled documents are fitted on, taken by the hash of their ids. All others take part as unlabelled ones.
LABELLED = 3000
ROUNDS, PER_ROUND, CONFIDENT = 4, 150, 0.97
TEXT_BINS, META_BINS = 1 << 14, 256
#: A document is rejected if its combined score for good quality is below this.
REJECT = 0.3

_WORDS = re.compile(r"\w+|[^\w\s]+")


def text_view(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed content features of a text: words' and symbols' shares by their shape, and how much the words repeat."""
    pieces = _WORDS.findall(text)
    n = len(pieces) or 1
    counts: dict[str, float] = {}
    for p in pieces:
        counts[p] = counts.get(p, 0.0) + 1.0
    feats: dict[int, float] = {}

    def add(name: str, value: float) -> None:
        k = zlib.crc32(name.encode("utf-8", "replace"))
        feats[k % (TEXT_BINS - 16) + 16] = feats.get(k % (TEXT_BINS - 16) + 16, 0.0) + (value if k & 0x80000000 else -value)

    for p, c in counts.items():
        add(p.lower(), 0.5 * (c / n) ** 0.5)
    twice = sum(a == b for a, b in zip(pieces, pieces[1:])) + sum(a == b for a, b in zip(pieces, pieces[2:]))
    symbols = sum(c for p, c in counts.items() if not (p[0].isalnum() or p[0] == "_"))
    loud = sum(c for p, c in counts.items() if len(p) > 1 and p.isupper())
    odd = sum(c for p, c in counts.items() if p[0] in "#$%&*|<>{}=~^@\\") + sum(c for p, c in counts.items() if len(p) > 1 and not p[0].isalnum())
    dense = [1.0, twice / n, len(counts) / n, symbols / n, loud / n, odd / n, min(1.0, n / 50), max(counts.values(), default=0) / n]
    for k, v in enumerate(dense):
        feats[k] = v * (1.0 if k in (0, 6) else 4.0)
    at = np.fromiter(feats, np.int64, len(feats))
    return at, np.fromiter(feats.values(), np.float64, len(feats))


def meta_view(source: str | None, lang: str | None, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of the page rather than its words: source, language, length and the make-up of its layout."""
    n = len(text) or 1
    letters = sum(map(str.isalpha, text)) if n < 2000 else len(re.findall(r"[^\W\d_]", text))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    digits = len(re.findall(r"\d", text))
    spaces = text.count(" ") + text.count("\n")
    marks = n - letters - digits - spaces
    stops = text.count(".") + text.count(",")
    lines = text.count("\n") + 1
    squeezed = len(zlib.compress(text.encode("utf-8", "replace"), 1)) / (len(text.encode("utf-8", "replace")) or 1)
    dense = [1.0, letters / n, upper / n, digits / n, spaces / n, (marks - stops) / n, stops / n, np.log1p(n) / 10, min(lines / n * 20, 3.0), squeezed if n > 300 else 0.5, float(n < 40)]
    scale = [1, 2, 5, 5, 3, 8, 8, 1, 1, 3, 1]
    at = [*range(len(dense)), 16 + zlib.crc32(f"s{source}".encode()) % 200, 220 + zlib.crc32(f"l{lang}".encode()) % 30]
    return np.array(at), np.array([*(d * s for d, s in zip(dense, scale)), 0.2, 0.2])


def _matrix(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, columns and values."""
    return np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows]), np.concatenate([a for a, _ in rows] or [np.zeros(0, np.int64)]), np.concatenate([v for _, v in rows] or [np.zeros(0)])


def _logits(m: tuple, w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(m[0], m[2] * w[m[1]], n)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(rows: list, y: np.ndarray, size: int, steps: int = 150, decay: float = 2e-4) -> np.ndarray:
    """Logistic regression by Adam on the whole set; the classes weigh the same."""
    m, n = _matrix(rows), len(rows)
    w, a, b = np.zeros(size), np.zeros(size), np.zeros(size)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for t in range(1, steps + 1):
        g = np.bincount(m[1], m[2] * ((_sigmoid(_logits(m, w, n)) - y) * weight)[m[0]], size) / n + decay * w
        a, b = 0.9 * a + 0.1 * g, 0.99 * b + 0.01 * g * g
        w = w - 0.1 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate logits, by Newton steps on smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    s, o = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(s * z + o)
        # a unit prior around (1, 0) keeps separable views finite
        g = np.array([((p - t) * z).sum() + (s - 1), (p - t).sum() + o])
        v = p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 1]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 0.5 / max(np.abs(d).max(), 1e-12))
        s, o = s - d[0], o - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(max(s, 0.0)), float(o)


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    calibration: tuple[tuple[float, float], tuple[float, float]]
    rounds: list[tuple[int, int]]

    def scores(self, text_rows: list, meta_rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of good quality by either view, and by the mean of their logits."""
        n = len(text_rows)
        z = [s * _logits(_matrix(r), w, n) + o for r, w, (s, o) in ((text_rows, self.text, self.calibration[0]), (meta_rows, self.meta, self.calibration[1]))]
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid((z[0] + z[1]) / 2)


#: For each view v and label, what the view is most sure of: (key, text features, metadata features), the surest first.
Choice = Callable[[list[np.ndarray], list[set[int]]], list[dict[float, list[tuple]]]]


def co_train(views: list[list], y: np.ndarray, choose: Choice, rounds: int = ROUNDS) -> Model | None:
    """views: the text and the metadata features of the labelled documents, y their labels; every fifth is kept for
    calibration. Each round, each view labels the unlabelled documents of each class that it is most sure of, for the other
    view to learn from. None if there are not two classes to learn."""
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held].tolist())) < 2:
        return None
    sizes = (TEXT_BINS, META_BINS)
    own, kept = np.flatnonzero(~held), np.flatnonzero(held)
    extra: list[dict[int, tuple]] = [{}, {}]  # by view, what the other has told it: (label, features)
    told = []
    for turn in range(rounds + 1):
        w = []
        for v in (0, 1):
            rows = [views[v][k] for k in own] + [f for _, f in extra[v].values()]
            w.append(fit_logistic(rows, np.array([*y[own], *(label for label, _ in extra[v].values())]), sizes[v]))
        if turn == rounds:
            break
        found = choose(w, [set(extra[1]), set(extra[0])])
        for v in (0, 1):
            for label, best in found[v].items():
                extra[1 - v].update({key: (label, features[1 - v]) for key, *features in best if key not in extra[1 - v]})
        told.append(tuple(sum(map(len, f.values())) for f in found))
        if not sum(told[-1]):
            break
    calibration = []
    for v in (0, 1):
        z = _logits(_matrix([views[v][k] for k in kept]), w[v], len(kept))
        calibration.append(platt(z, y[kept]) if len(set(y[kept].tolist())) == 2 else (1.0, 0.0))
    return Model(w[0], w[1], tuple(calibration), told)


def surest(keys: np.ndarray, features: list[tuple[list, list]], w: list[np.ndarray], taken: list[set[int]], most: int) -> Iterator[tuple[int, float, float, int, int]]:
    """(view, label, sureness, key, row): of each view and label the ``most`` documents that it is surest of, each key once,
    without what has been taken; ties go by key."""
    for v in (0, 1):
        p = _sigmoid(_logits(_matrix(features[v]), w[v], len(keys)))
        for label, sure in ((1.0, p), (0.0, 1 - p)):
            n, seen = 0, taken[v].copy()
            for k in np.lexsort((keys, -sure)).tolist():
                if n == most or sure[k] < CONFIDENT:
                    break
                key = int(keys[k])
                if key not in seen:
                    seen.add(key)
                    n += 1
                    yield v, label, float(sure[k]), key, k


_FEATURES = "doc_id long, key long, ti array<int>, tv array<float>, mi array<int>, mv array<float>"
_LISTS = ("ti", "tv", "mi", "mv")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        texts = [t or "" for t in block.column("text").to_pylist()]
        views = [text_view(t) for t in texts], [meta_view(s, x, t) for s, x, t in zip(block.column("source").to_pylist(), block.column("lang").to_pylist(), texts)]
        lists = [_list(rows, k, kind) for rows in views for k, kind in ((0, np.int32), (1, np.float32))]
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("key"), *lists], names=["doc_id", "key", *_LISTS])


def _list(rows: list[tuple], k: int, kind: type) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[k]) for r in rows)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, kind), *(r[k].astype(kind) for r in rows)])))


def _views(batch) -> tuple[list, list]:
    """Both views' features of the rows of a batch or of collected rows."""
    out = []
    for at, values in (("ti", "tv"), ("mi", "mv")):
        a, v = batch.column(at), batch.column(values)
        cuts = a.offsets.to_numpy()
        first = cuts[0]
        i, x = a.flatten().to_numpy(), v.flatten().to_numpy().astype(np.float64)
        out.append([(i[c - first : d - first], x[c - first : d - first]) for c, d in zip(cuts[:-1], cuts[1:])])
    return out[0], out[1]


def _gathered(rows: DataFrame, *names: str) -> tuple[dict[str, list], tuple[list, list]]:
    """A few rows on the driver: the named columns, and both views."""
    t = rows.toArrow().combine_chunks()
    batches = t.to_batches()
    if not batches:
        return {n: [] for n in names}, ([], [])
    return {n: t.column(n).to_pylist() for n in names}, _views(batches[0])


def fit(features: DataFrame, labels: DataFrame, labelled: int = LABELLED, per_round: int = PER_ROUND) -> Model | None:
    """Fits on the features of at most ``labelled`` documents with a label, whatever the table's size, and of all others:
    each round every other document is scored where it lies, and the driver gets the ``per_round`` surest of each view
    and class. Of labels for one id the least counts; rows of the same text, source and language are exchanged once."""
    spark = features.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("id"), "quality").where("quality IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.min("quality").alias("quality"))
    drawn = known.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(labelled).collect()
    wanted = spark.createDataFrame([(r["id"], float(r["quality"])) for r in drawn], "id long, quality double")
    own = features.join(F.broadcast(wanted), F.col("doc_id") == F.col("id")).orderBy("doc_id", "key")
    columns, views = _gathered(own, "quality")
    y = np.array(columns["quality"], float)
    if len(set(y.tolist())) < 2:
        return None
    # labels beyond the bound are not read, so their documents are unlabelled ones; at most ``labelled`` ids are sent
    free = features.join(F.broadcast(wanted.select("id")), F.col("doc_id") == F.col("id"), "left_anti")

    def choose(w: list[np.ndarray], taken: list[set[int]]) -> list[dict[float, list[tuple]]]:
        held = spark.sparkContext.broadcast((w, taken))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, gone = held.value
            best: dict[tuple[int, float], dict[int, float]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                for v, label, sure, key, _ in surest(batch.column("key").to_numpy(), _views(batch), models, gone, per_round):
                    best.setdefault((v, label), {})[key] = sure
                for k, found in best.items():
                    if len(found) > 4 * per_round:
                        best[k] = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:per_round])
            rows = [(v, label, sure, key) for (v, label), found in best.items() for key, sure in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:per_round]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.float64(), pa.float64(), pa.int64()))], names=["v", "label", "sure", "key"])

        made = free.select("key", *_LISTS).mapInArrow(score, "v int, label double, sure double, key long").groupBy("v", "label", "key").agg(F.max("sure").alias("sure"))
        rank = F.row_number().over(Window.partitionBy("v", "label").orderBy(F.desc("sure"), "key"))
        rows = made.withColumn("r", rank).where(F.col("r") <= per_round).orderBy("v", "label", "r").collect()
        keys = spark.createDataFrame([(k,) for k in {r["key"] for r in rows}], "of long")
        columns, of = _gathered(free.join(F.broadcast(keys), F.col("key") == F.col("of")).select("key", *_LISTS).dropDuplicates(["key"]), "key")
        at = {key: (a, b) for key, a, b in zip(columns["key"], *of)}
        out: list[dict[float, list[tuple]]] = [{1.0: [], 0.0: []}, {1.0: [], 0.0: []}]
        for r in rows:
            out[r["v"]][r["label"]].append((r["key"], *at[r["key"]]))
        return out

    return co_train(list(views), y, choose)


def classify(docs: DataFrame, labels: DataFrame, reject: float = REJECT, labelled: int = LABELLED) -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, score (probabilities of good quality), accepted.

    Null texts are empty texts, null sources and languages values of their own; repeated rows get equal rows; an empty
    table gives an empty result. Without labels of both classes every document scores 0.5 and is accepted. Labels other
    than 0 and 1 are left out; of several for one id, the least counts. Of documents that a view is equally sure of, those of the
    smaller hash are exchanged. A text of any length is read whole, once: both views' features are written as a table in
    the shared folder, which all rounds and the scoring read. Other columns are not read.
    """
    return _scored(docs, labels, reject, labelled).drop("key")


def _key():
    """Tells documents apart by all that the classifier sees."""
    return F.xxhash64("text", F.col("source").cast("string"), F.col("lang").cast("string"))


def _scored(docs: DataFrame, labels: DataFrame, reject: float, labelled: int) -> DataFrame:
    spark = tuned(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), F.col("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    folder = workspace(spark, "quality")
    spread(rows).mapInArrow(_extract, _FEATURES).write.parquet(folder)
    features = spark.read.parquet(folder)
    model = spark.sparkContext.broadcast(fit(features, labels, labelled))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = model.value
            if m is None or not batch.num_rows:
                a = b = c = np.full(batch.num_rows, 0.5)
            else:
                a, b, c = m.scores(*_views(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *map(pa.array, (a, b, c)), pa.array(c >= reject)], names=["doc_id", "key", "text_score", "meta_score", "score", "accepted"])

    return features.mapInArrow(score, "doc_id long, key long, text_score double, meta_score double, score double, accepted boolean")


def keep_good(docs: DataFrame, labels: DataFrame, reject: float = REJECT, labelled: int = LABELLED) -> DataFrame:
    """The accepted documents, with all their columns, whatever the names of others. Null and repeated ids do not matter; odd
    inputs as in ``classify``."""
    bad = unused(docs, "bad")
    found = _scored(docs, labels, reject, labelled).where("NOT accepted").select(F.col("key").alias(bad)).distinct()
    return docs.join(found, _key() == F.col(bad), "left_anti")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
