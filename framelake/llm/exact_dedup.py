"""Exact dedup by a content sort: sampled splitters range-partition normalised bytes, an external sort places equals
adjacent, neighbours are compared in full."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import cut, normalised, table, tuned, unused

#: Characters of the normalised text in the splitters, so that the sample that Spark draws for them stays small.
SPLITTER_CHARS = 64

_SCHEMA = "doc_id long, text_sha256 string, keep_id long, group_size long, first boolean, open boolean, task long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("first", pa.bool_()), ("open", pa.bool_()), ("task", pa.int64())])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (doc_id, norm) in, one row per document out. A run of equal texts at either end of the partition is open:
    it may go on in a neighbour. Of a run only the ids are held."""
    task = TaskContext.get().partitionId()
    last: str | None = None
    ids: list = []
    first_run = True
    out: list[tuple] = []

    def close(is_last: bool) -> None:
        digest = hashlib.sha256(last.encode()).hexdigest()
        is_open = first_run or is_last
        out.extend((x, digest, ids[0], len(ids), k == 0, is_open, task) for k, x in enumerate(ids))

    def flush() -> pa.RecordBatch:
        rows = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ARROW)], schema=_ARROW)

    for batch in batches:
        for doc_id, norm in zip(batch.column("doc_id").to_pylist(), batch.column("norm").to_pylist()):
            if last is None or norm != last:
                if last is not None:
                    close(False)
                    first_run = False
                    if len(out) >= 5000:
                        yield flush()
                last, ids = norm, []
            ids.append(doc_id)
    if last is not None:
        close(True)
        yield flush()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts are one group.
    Of equal texts the row with the smallest (or ``keep="largest"``) id stays; a null id only stays if there is no other;
    of repeated rows with the same id, one stays. A text of any length is compared whole; only its neighbour is held beside it.
    An empty table gives an empty result. Other columns are not read, whatever their names.

    The order is (first characters, hash, whole text, id): splitters stay small, equal texts are adjacent, and a group of
    any size may span partitions. At most two runs of a partition can do so; their partial sizes are summed by digest in
    a table of at most two rows per partition, which is what is broadcast.
    """
    spark = tuned(docs.sparkSession)
    order = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("norm"))
    keyed = keyed.select(F.substring("norm", 1, SPLITTER_CHARS).alias("head"), F.xxhash64("norm").alias("hash"), "doc_id", "norm")
    ordered = keyed.repartitionByRange("head", "hash", order).sortWithinPartitions("head", "hash", "norm", order)
    rows = cut(ordered.select("doc_id", "norm").mapInArrow(_neighbours, _SCHEMA))
    best = F.max if keep == "largest" else F.min
    order_id = F.coalesce("keep_id", F.lit(-(2**63) if keep == "largest" else 2**63 - 1))
    parts = rows.where("open AND first").select("text_sha256", "keep_id", "group_size", F.struct(order_id.alias("i"), "task").alias("at"))
    whole = parts.groupBy("text_sha256").agg(best("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"), best("at").alias("at"))
    both = rows.join(F.broadcast(whole), "text_sha256", "left")
    is_open = F.col("open")
    return both.select(
        "doc_id",
        F.when(is_open, F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(is_open, F.col("all_size")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("first") & (~is_open | (F.col("task") == F.col("at.task")))).alias("kept"),
        "text_sha256",
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents that stay, with all their columns, whatever the names of others. Ids are taken to be unique; odd inputs
    as in ``exact_groups``."""
    kept = unused(docs, "kept")
    stay = exact_groups(docs, id_col, text_col, keep).where("kept").select(F.col("doc_id").alias(kept))
    return docs.join(stay, F.col(id_col).eqNullSafe(F.col(kept)), "left_semi")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) d
"""
