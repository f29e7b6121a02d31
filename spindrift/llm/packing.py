"""Packing into optimal length buckets.

The global histogram of document lengths (in tokens) goes into a dynamic program that chooses the bucket boundaries with the
least padding; a document of a bucket is padded to the longest of its bucket. Inside each bucket, documents in id order form
batches of at most ``BUDGET`` padded tokens. Every document lands in exactly one batch, whole. One longer than the budget is a
batch by itself, without padding, in a bucket after all others; so the histogram has at most ``BUDGET`` rows at any size of corpus,
one for each length, and the program is exact.

Global places inside a bucket come from places in range partitions by (bucket, id) plus the counts of the partitions before: no
task ever sorts a whole bucket, however ids are spread or repeated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, BUDGET = 16, 1 << 16
#: Length of a text in tokens: its UTF-8 bytes, as a byte-level model reads them, and an end token.
BYTE_LENGTH = "cast(octet_length(coalesce({text}, '')) + 1 as bigint)"


def boundaries(length: np.ndarray, count: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The longest length of each bucket, least padding first of all, then fewest buckets; ``length`` rises, ``count`` is documents.

    Lengths i..j in one bucket pad length[j] * documents - tokens. The best first length of a bucket never falls as its last one
    rises, so each row of the program is solved by halves: the middle first, then both sides within the middle's choice.
    """
    n = len(length)
    if not n:
        return []
    docs, tokens = np.r_[0, np.cumsum(count)].astype(np.int64), np.r_[0, np.cumsum(length * count)].astype(np.int64)
    best = length * docs[1:] - tokens[1:]
    came, history = [np.zeros(n, np.int64)], [best]
    for _ in range(1, min(buckets, n)):
        now, first = np.zeros(n, np.int64), np.zeros(n, np.int64)
        step = 1 << n.bit_length()
        while step:
            j = np.arange(step - 1, n, 2 * step)
            low = np.where(j >= step, first[np.maximum(j - step, 0)], 0)  # neighbours solved before
            high = np.where(j + step < n, np.minimum(first[np.minimum(j + step, n - 1)], j), j)
            step //= 2
            if not len(j):
                continue
            many = high - low + 1
            start = np.cumsum(many) - many
            i, at = common.ragged(low, many), np.repeat(j, many)
            cost = np.where(i > 0, best[i - 1], 0) + length[at] * (docs[at + 1] - docs[i]) - (tokens[at + 1] - tokens[i])
            now[j] = np.minimum.reduceat(cost, start)
            hit = np.flatnonzero(cost == np.repeat(now[j], many))
            first[j] = i[hit[np.searchsorted(hit, start)]]
        came.append(first)
        history.append(now)
        best = now
    level = min(range(len(history)), key=lambda k: (history[k][n - 1], k))
    cuts, j = [], n - 1
    while j >= 0 and level >= 0:
        cuts.append(int(length[j]))
        j, level = int(came[level][j]) - 1, level - 1
    return cuts[::-1]


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, length: str = BYTE_LENGTH) -> DataFrame:
    """(id, n_tokens, bucket, padded, batch, place) of every row.

    ``length`` is the SQL of a row's tokens: the default counts bytes, ``n_tokens`` takes a column, such as that of token files.
    ``bucket`` counts from 0 by length, ``padded`` is the length that its documents are padded to (their own beyond ``budget``),
    ``batch`` counts from 0 in the bucket, ``place`` from 0 in the batch. Null texts are empty (one end token). Order in a bucket:
    null ids first, then by id, then by length; equal rows are interchangeable. Other columns are not read. An empty table gives no
    rows.
    """
    sized = common.written(docs.selectExpr(f"`{id_col}` as id", f"{length.format(text=f'`{text_col}`')} as n"), "packing-lengths")
    histogram = sized.where(f"n <= {budget}").groupBy("n").agg(F.count("*").alias("c")).orderBy("n").collect()  # a row for each length, ``budget`` at most
    cuts = boundaries(*(np.array([r[k] for r in histogram], np.int64) for k in ("n", "c")), buckets=buckets)
    bucket = "case " + " ".join(f"when n <= {c} then {k}" for k, c in enumerate(cuts)) + f" else {len(cuts)} end" if cuts else "0"
    padded = f"coalesce(get(array({', '.join(f'{c}L' for c in cuts)}), bucket), n)" if cuts else "n"
    spark = docs.sparkSession
    placed = sized.selectExpr("id", "n", f"{bucket} as bucket", "monotonically_increasing_id() as row")
    ranged = placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "id", "n", "row").sortWithinPartitions("bucket", "id", "n", "row")
    ranged = common.written(ranged.selectExpr("id", "n", "bucket", "spark_partition_id() as part", "monotonically_increasing_id() as at"), "packing-order")
    counts = ranged.groupBy("bucket", "part").agg(F.count("*").alias("c"), F.min("at").alias("first"))  # a row for each partition, and one more for each bucket
    before = counts.selectExpr("bucket", "part", "first", "coalesce(sum(c) over (partition by bucket order by part rows between unbounded preceding and 1 preceding), 0) as before")
    local = ranged.join(F.broadcast(before), ["bucket", "part"]).selectExpr("*", "before + at - first as r", f"{padded} as padded")
    each = f"greatest(1L, {budget} div padded)"
    return local.selectExpr(f"id as `{id_col}`", "n as n_tokens", "bucket", "padded", f"r div {each} as batch", f"cast(r % {each} as int) as place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: bucket, batch and place of every document."""
    return packed(common.table(spark, sf_dir, "documents"))
