"""N-gram Jaccard join by vertical partitioning: the global order of n-grams is cut into fragments, partial overlaps are
counted in each fragment apart, and summed per pair.

A sieve goes first: by a hash order, documents of similarity t share at least ``need`` n-grams of the heads of their sets, so
documents with fewer head n-grams that any other has are linked with nothing. The sets left are put in the global
order, the rarest n-grams first. Pairs come from the n-grams of prefixes; what two prefixes cannot rule out is counted
fragment by fragment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import LOWER, blocks, cut, mix, release, runs, span_hashes, spread, table, tuned, unused, utf8
from framelake.llm.components import components

FRAGMENTS = 4

_SPACE = np.zeros(256, bool)
_SPACE[32] = True
_SPACE[9:14] = True


def prefix_length(n, num: int, den: int):
    """n - ceil(t n) + 1 for t = num / den."""
    return n - (n * num + den - 1) // den + 1


def head_length(n, num: int, den: int):
    """The prefix and half as much again, or up to a tenth of the set if that is more and no longer than the prefix."""
    p = prefix_length(n, num, den)
    return np.minimum(n, p + np.maximum(p // 2, np.minimum(p, n // 10)))


def _needed(n, num: int, den: int):
    """n-grams that the heads of two linked documents share at least, by the smaller one's size."""
    p = n - F.ceil(n * num / den) + 1
    return F.least(n, p + F.greatest(F.floor(p / 2), F.least(p, F.floor(n / 10)))) - p + 1


def shingle_sets(block: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the shingles of each row of a block."""
    data, offsets = utf8(block.column("text"))
    data = LOWER[data]
    starts, ends = runs(~_SPACE[data], offsets)
    first = np.searchsorted(starts, offsets)
    hashes = span_hashes(data, starts, ends)
    weights = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    m = len(hashes) - words + 1
    whole = np.zeros(max(m, 0), np.uint64)
    for k in range(words):
        whole += hashes[k : k + len(whole)] * weights[k]
    whole = mix(whole).view(np.int64)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            yield np.unique(whole[a : b - words + 1])
        elif b > a:
            yield mix(np.array([(hashes[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def _signature(tokens: np.ndarray) -> bytes:
    return hashlib.md5(tokens.tobytes()).digest()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _heads(words: int, num: int, den: int) -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sets = list(shingle_sets(block, words))
            heads = [s[: int(head_length(len(s), num, den))] if len(s) else s for s in sets]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("h"), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(_signature, sets)), pa.binary()), _lists(heads)],
                names=["doc_id", "h", "n", "sig", "head"],
            )

    return make


def _sets(words: int) -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            found = [(k, tokens) for k, wanted, tokens in zip(block.column("k").to_pylist(), block.column("sig").to_pylist(), shingle_sets(block, words)) if _signature(tokens) == wanted]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), _lists([tokens for _, tokens in found])], names=["k", "tokens"])

    return make


def _least_size(n, num: int, den: int):
    """The smallest partner of a set of n: ceil(t n)."""
    return F.ceil(n * num / den)


def _ordered(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Sets (k, n, tokens) by the global order of n-grams, the rarest first: (k, n, weight, parts, head, skip).

    An n-gram's frequency is the number of sets that have it; ties go by its hash. The order is cut into fragments of
    about equal volume; parts has a set's segment in each. N-grams that a set has alone (skip of them) come first and are in no
    segment, as they overlap nothing. head has the rest of its prefix; weight is its mean frequency, so the greatest weight
    in a group of copies is that of the set nearest to all of them."""
    tokens = sets.select("k", F.explode("tokens").alias("t"))
    counts = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # the place in the order as one number: frequency, then the upper bits of the hash
    place = (F.col("c") + (F.shiftright("t", 32) + 2**31) / float(2**32)).alias("o")
    shared = tokens.join(counts, "t").select("k", "c", "t", place)
    at = shared.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("o", "t"))).alias("all"), F.sum("c").alias("w"))
    # a set that is linked shares at least this much of itself
    at = cut(at.join(sets.select("k", "n"), "k").where(F.size("all") >= _least_size(F.col("n"), num, den)))
    del tokens, counts, shared
    release(sets.sparkSession)
    steps = [k / FRAGMENTS for k in range(1, FRAGMENTS)]
    bounds = at.select(F.explode(F.transform("all", lambda x: x["o"])).alias("o")).agg(F.percentile_approx("o", steps, 1000).alias("b")).first().b or [0.0] * len(steps)
    up_to = lambda b: F.size(F.filter("all", lambda x: x["o"] <= b))
    ends = [F.lit(0), *map(up_to, bounds), F.size("all")]
    own = F.col("n") - F.size("all")
    prefix = F.col("n") - _least_size(F.col("n"), num, den) + 1
    return at.select(
        "k", "n", (F.col("w") / F.col("n")).alias("weight"), own.alias("skip"), F.transform("all", lambda x: x["t"]).alias("t"),
        F.greatest(prefix - own, F.lit(0)).cast("int").alias("head"), F.array(*(e.cast("int") for e in ends)).alias("ends"),
    )


def _verified(pairs: DataFrame, ordered: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, na, b, nb), the linked ones: den * overlap >= num * union. Overlaps are counted in each fragment of
    the global order apart, from the two segments there, and summed per pair."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)), lambda j: F.struct(j.alias("frag"), F.slice("t", F.element_at("ends", j + 1) + 1, F.element_at("ends", j + 2) - F.element_at("ends", j + 1)).alias("s")))
    segments = ordered.select("k", F.explode(parts).alias("x")).select("k", "x.frag", "x.s").where(F.size("s") > 0)
    ends = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct()
    segments = segments.join(ends, "k", "left_semi")
    fragments = F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("frag")
    first = pairs.select("*", fragments).join(segments.select(F.col("k").alias("a"), "frag", F.col("s").alias("sa")), ["frag", "a"])
    both = first.join(segments.select(F.col("k").alias("b"), "frag", F.col("s").alias("sb")), ["frag", "b"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("o"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("overlap"))
    return summed.where(den * F.col("overlap") >= num * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b", "overlap", "na", "nb")


def _alike(num: int, den: int):
    return den * F.least("na", "nb") >= num * F.greatest("na", "nb")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 8, den: int = 10, shortcut: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, links, labels): documents has doc_id, n_shingles and sig, the same for equal sets; links has all pairs of
    different sets with num / den similarity or more, each once: a and b (xxhash64 of sig), overlap, na, nb, sig_a, sig_b;
    labels has (k, comp) of the keys in links. With ``shortcut``, links are only so many that their components are those of
    all links.

    A-Z is lower-cased; words stand between white space (space, \\t to \\r). A set is the distinct shingles of ``words``
    words; a text of fewer words is one shingle; null and texts without words are empty and linked with nothing. Equal
    sets are compared as one. Repeated rows and null ids are documents like any other. Ties of frequency go by the n-gram's
    hash. A text of any length is one set, made by itself in a worker. An empty table gives empty results. Other columns
    are not read, whatever their names.

    All pairs that share an n-gram of their prefixes are listed and compared: the result itself grows with the square of a
    group of near copies. With ``shortcut``, each set is first compared with one leader: of the buckets of its prefix's
    n-grams, the member of the greatest weight. Then only pairs of different components are listed, and only from buckets
    that still have several. So a group of many near copies costs about a comparison a member, not all its pairs.
    """
    documents, links, labels = _linked(docs, id_col, text_col, words, num, den, shortcut)
    sigs = documents.where("k IS NOT NULL").groupBy("k").agg(F.first("sig").alias("sig"))
    ends = links.join(sigs.select(F.col("k").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("k").alias("b"), F.col("sig").alias("sig_b")), "b")
    named = cut(ends.select(F.xxhash64("sig_a").alias("a"), F.xxhash64("sig_b").alias("b"), "overlap", "na", "nb", "sig_a", "sig_b"))
    return documents.drop("k"), named, _merged(named)


def _linked(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, shortcut: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """As ``linked``, but links have numbers k of sets, which documents have too: null for a set that cannot be linked. Labels
    only with ``shortcut``."""
    spark = tuned(docs.sparkSession)
    source = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    source = source.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = cut(source.mapInArrow(_heads(words, num, den), "doc_id long, h long, n int, sig binary, head array<long>"))
    documents = cut(rows.select("doc_id", "sig", F.col("n").cast("long").alias("n_shingles")))
    groups = rows.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.first("head").alias("head"), F.min(F.struct("doc_id", "h")).alias("rep"))
    sets = cut(groups).select(F.monotonically_increasing_id().alias("k"), "*")
    del rows, groups
    release(spark)
    reps = _sieved(sets, num, den)
    del sets
    release(spark)
    text = source.join(reps, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rh"))).select("k", "sig", "text")
    tokens = cut(text.mapInArrow(_sets(words), "k long, tokens array<long>"))
    del text
    release(spark)
    ordered = cut(_ordered(tokens.select("k", F.size("tokens").alias("n"), "tokens"), num, den))
    documents = documents.join(reps.select("sig", "k"), "sig", "left")
    del tokens
    release(spark)
    heads = ordered.select("k", "n", "weight", "skip", F.posexplode(F.slice("t", F.lit(1), F.col("head"))).alias("p", "t"))
    heads = heads.select("t", "k", "n", "weight", (F.col("p") + F.col("skip") + 1).alias("p"))
    several = heads.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("weight", "k", "n")).alias("l")).where("c > 1")
    heads = cut(heads.join(several, "t").select("t", "k", "n", "p", F.col("l.weight").alias("lw"), F.col("l.k").alias("lk"), F.col("l.n").alias("ln")))
    release(spark)
    if not shortcut:
        links = cut(_verified(_listed(heads.withColumn("comp", F.col("k")), num, den), ordered, num, den))
        return documents, links, None
    links = cut(_verified(_stars(heads, num, den), ordered, num, den))
    release(spark)
    labels = _merged(links)
    at = heads.join(labels, "k", "left").select("t", "k", "n", "p", F.coalesce("comp", "k").alias("comp"))
    found = cut(_verified(cut(_listed(at, num, den)), ordered, num, den))
    release(spark)
    if not found.isEmpty():
        links = links.unionByName(found)
        labels = _merged(links)
    return documents, links, labels


def _sieved(sets: DataFrame, num: int, den: int) -> DataFrame:
    """The sets (k, sig, n, head, rep) that are not ruled out by their heads: (k, sig, n, rep, rh), (rep, rh) the id and the
    text's hash of a row that has the set."""
    heads = sets.select("k", F.explode("head").alias("t"))
    shared = heads.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("t")
    met = heads.join(shared, "t").groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    alive = sets.join(met, "k").where(F.col("c") >= _needed(F.ceil(F.col("n") * num / den), num, den))
    return cut(alive.select("k", "sig", "n", F.col("rep.doc_id").alias("rep"), F.col("rep.h").alias("rh")))


def _stars(heads: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of each set with one leader of its buckets: the heaviest one of a size that can be linked."""
    stars = heads.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("lk").alias("b"), F.col("ln").alias("nb"), "lw").where((F.col("a") != F.col("b")) & _alike(num, den))
    return stars.groupBy("a", "na").agg(F.max(F.struct("lw", "b", "nb")).alias("m")).select("a", "na", "m.b", "m.nb")


def _listed(heads: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of different components that share an n-gram of their prefixes and can be linked by sizes and places.

    At the first n-gram that two sets share, what stands behind it in both has to be enough. A set leaves a bucket where that fails
    with the smallest partner there; buckets of one component are left out; in others, the largest component's members are
    only met by the members of the others."""
    least = F.greatest("least", _least_size(F.col("n"), num, den))
    sizes = heads.groupBy("t").agg(F.min("n").alias("least"))
    at = heads.join(sizes, "t").where((num + den) * (F.col("n") - F.col("p") + 1) >= num * (F.col("n") + least)).select("t", "k", "n", "p", "comp")
    shares = at.groupBy("t", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = shares.groupBy("t").agg(F.count(F.lit(1)).alias("several"), F.max(F.struct("c", "comp")).alias("m")).where("several > 1")
    at = cut(at.join(mixed.select("t", F.col("m.comp").alias("most")), "t"))
    release(heads.sparkSession)
    a = at.where("comp <> most").select("t", "most", F.col("k").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("p").alias("pa"))
    b = at.select("t", F.col("k").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("p").alias("pb"))
    enough = (num + den) * (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1) >= num * (F.col("na") + F.col("nb"))
    pairs = a.join(b, "t").where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("most")) | (F.col("a") < F.col("b"))) & _alike(num, den) & enough)
    up = F.col("a") < F.col("b")
    return pairs.select(F.least("a", "b").alias("a"), F.when(up, F.col("na")).otherwise(F.col("nb")).alias("na"), F.greatest("a", "b").alias("b"), F.when(up, F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()


def _merged(links: DataFrame) -> DataFrame:
    return cut(components(links, "a", "b").select(F.col("node").alias("k"), F.col("component").alias("comp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links, itself included; a
    document without shingles is alone; a null id has its group's smallest id, or null). Odd inputs as in ``linked``."""
    documents, _, labels = _linked(docs, id_col, text_col, words, num, den, True)
    own = documents.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.first("k").alias("k")).join(labels, "k", "left")
    groups = own.where("comp IS NOT NULL").groupBy("comp").agg(F.min("least").alias("component"))
    named = own.join(groups, "comp", "left").select(F.col("sig").alias("of"), F.coalesce("component", "least").alias("component"))
    out = documents.join(named, (F.col("sig") == F.col("of")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The document with the smallest id of each group, with all its columns, whatever their names. Ids are taken to be
    unique; rows without an id stay. Odd inputs as in ``linked``."""
    gone = unused(docs, "gone")
    left = near_duplicates(docs, id_col, text_col, words, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias(gone))
    return docs.join(left, F.col(id_col) == F.col(gone), "left_anti")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=9, den=10)
