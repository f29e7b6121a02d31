"""Exact top-k search by block-at-a-time pruning.

Vectors become integer term weights: floor(64 * x). Documents stand in id order, in blocks of ``BLOCK``; a block's forward
index is its ids and weights, and its summary the largest and smallest weight of each term. For a query, the sum over terms of
the best that a block can give bounds every score in it. Blocks are scored in order of falling bounds, and the search of a
query ends when the next bound is below its k-th score so far, so nothing that belongs to the top k is ever missed.

The search goes in waves over ranges (``RANGE`` blocks): a query's own range (or a few neighbours, where ranges are small) first, then ``GROWTH`` times as many ranges in each
further wave, each with the k-th scores so far. A k-th score over a quarter of the rows leaves about four times k rows above it in
all, so hits stay few for each query whatever the number of ranges. Before a wave moves any block, its summary meets the queries:
only blocks whose bound reaches the k-th score of some query go out, and only to the parts with such queries. Work is dealt by
(range, part of the queries); a range's blocks and a part's queries have bounded sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, K, EVERY = 64, 20, 20
#: Documents in a block, blocks in a range, about how many queries one task takes, and how waves grow.
BLOCK, RANGE, QUERIES, GROWTH = 1024, 16, 512, 4
#: Below every score.
LEAST = -(1 << 62)

BLOCKS = "dim int, range long, block int, kind string, ids binary, uids binary, weights binary, high binary, low binary"
ASKED = "dim int, home long, sub int, uid long, vec_id long, kind string, w binary"
HITS = "query_uid long, query_id long, vec_id long, score long"


def weights_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, w): integer weights of every vector that takes part.

    Null ids, null or empty vectors and vectors with a null or non-finite component take no part, nor do those with a weight
    beyond 64 bits. Scores beyond 64 bits aren't supported.
    """
    src = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    ok = "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return src.where(ok).selectExpr("vec_id", f"transform(v, x -> try_cast(floor({SCALE} * x) as long)) as w").where("forall(w, x -> x is not null)")


def blocks(weights: DataFrame) -> DataFrame:
    """Forward index: one row for each block, in id order, with its summary; vectors of different lengths never share a block."""
    parts = max(1, -(-weights.count() // (BLOCK * RANGE)))  # full blocks, whatever the cluster's settings
    ranged = weights.withColumn("dim", F.size("w")).repartitionByRange(parts, "dim", "vec_id").sortWithinPartitions("dim", "vec_id")

    def run(batches):
        part, n_block, seen, held = TaskContext.get().partitionId(), {}, 0, {}

        def emit(dim, rows):
            nonlocal seen
            ids = np.array([r[0] for r in rows], np.int64)
            w = np.array([r[1] for r in rows], np.int64).reshape(len(rows), dim)
            k = n_block.get(dim, 0)
            n_block[dim] = k + 1
            uids = (np.int64(part) << np.int64(40)) + seen + np.arange(len(rows))
            seen += len(rows)
            kind = next((t for t in ("<i1", "<i2", "<i4") if np.iinfo(t).min <= w.min() and w.max() <= np.iinfo(t).max), "<i8")
            w = w.astype(kind)
            cells = [[dim], [(part << 24) + k // RANGE], [k % RANGE], [kind], [ids.tobytes()], [uids.tobytes()], [w.tobytes()], [w.max(axis=0).tobytes()], [w.min(axis=0).tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for vec_id, w in zip(batch.column("vec_id").to_pylist(), batch.column("w"), strict=True):
                rows = held.setdefault(len(w), [])
                rows.append((vec_id, w.values.to_numpy()))
                if len(rows) == BLOCK:
                    yield emit(len(w), held.pop(len(w)))
        for dim, rows in sorted(held.items()):
            yield emit(dim, rows)

    return ranged.select("vec_id", "w", "dim").mapInArrow(run, BLOCKS)


def queries_of(index: DataFrame, every: int = EVERY) -> DataFrame:
    """(dim, home, sub, uid, vec_id, kind, w): the rows of the index whose id is divisible by ``every``, with their own range.

    ``sub`` parts the queries of a range, so that about ``QUERIES`` stay together.
    """
    subs = max(1, -(-BLOCK * RANGE // (every * QUERIES)))
    names = [f.split()[0] for f in ASKED.split(", ")]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, uids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["uids"], np.int64)
                w = np.frombuffer(r["weights"], r["kind"]).reshape(len(ids), r["dim"])
                at = np.flatnonzero(ids % every == 0)
                cells = [np.full(len(at), r["dim"], np.int32), np.full(len(at), r["range"]), (np.arange(len(at)) % subs).astype(np.int32), uids[at], ids[at]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cells), pa.array([r["kind"]] * len(at), pa.string()), pa.array([x.tobytes() for x in w[at]], pa.binary())], names=names)

    return index.select("dim", "range", "kind", "ids", "uids", "weights").mapInArrow(run, ASKED)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products a @ b.T, exact: in floating point where every sum fits, else in integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _loaded(table: pa.Table, column: str) -> list[np.ndarray]:
    """Weights of each row of ``column`` as 64-bit integers."""
    return [np.frombuffer(x, k).astype(np.int64) for x, k in zip(table[column].to_pylist(), table["kind"].to_pylist(), strict=True)]


def bounds(found: pa.Table, q: np.ndarray) -> np.ndarray:
    """(query, block): no score in the block is higher."""
    high, low = np.stack(_loaded(found, "high")), np.stack(_loaded(found, "low"))
    return products(np.maximum(q, 0), high) + products(np.minimum(q, 0), low)


NEEDED = "dim int, rank long, home long, sub int, block int, uids array<long>"


def needed(key, found: pa.Table, asked: pa.Table) -> pa.Table:
    """The blocks of ``found`` (summaries) that may hold something for a query of ``asked``, and for which queries."""
    names = [f.split()[0] for f in NEEDED.split(", ")]
    blocks, uids = [], []
    if found.num_rows and asked.num_rows:
        reach = bounds(found, np.stack(_loaded(asked, "w"))) >= asked["floor"].to_numpy()[:, None]
        own = asked["uid"].to_numpy()
        for k in np.flatnonzero(reach.any(axis=0)):
            blocks.append(found["block"][int(k)].as_py())
            uids.append(own[reach[:, k]])
    same = [[k.as_py()] * len(blocks) for k in key]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    return pa.table([pa.array(x, t) for x, t in zip([*same, blocks, uids], kinds, strict=True)], names=names)


def search(found: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """Block-at-a-time search of the queries ``asked`` in the blocks ``found`` of one range."""
    out = [[], [], [], []]
    if found.num_rows and asked.num_rows:
        dim = found["dim"][0].as_py()
        ids, uids = ([np.frombuffer(x, np.int64) for x in found[c].to_pylist()] for c in ("ids", "uids"))
        index = [w.reshape(-1, dim) for w in _loaded(found, "weights")]
        q = np.stack(_loaded(asked, "w"))
        q_uid, q_id = asked["uid"].to_numpy(), asked["vec_id"].to_numpy()
        kth = asked["floor"].to_numpy().copy()  # nothing below it can be among the top k
        bound = bounds(found, q)
        order = np.argsort(-bound, axis=1, kind="stable")
        best_score = np.full((len(q), 0), 0, np.int64)
        best_id, best_own = best_score.copy(), best_score.copy()
        for step in range(len(index)):
            alive = np.flatnonzero(bound[np.arange(len(q)), order[:, step]] >= kth)
            if not len(alive):
                break
            width = max(len(x) for x in ids)
            score = np.full((len(q), width), np.iinfo(np.int64).min)
            new_id, ok = np.zeros((len(q), width), np.int64), np.zeros((len(q), width), bool)
            for b in np.unique(order[alive, step]):
                at = alive[order[alive, step] == b]
                n = len(ids[b])
                score[at, :n] = products(q[at], index[b])
                new_id[at, :n] = ids[b]
                ok[at, :n] = (uids[b][None, :] != q_uid[at, None]) & (score[at, :n] >= kth[at, None])
            score = np.concatenate([best_score, score], axis=1)
            new_id = np.concatenate([best_id, new_id], axis=1)
            ok = np.concatenate([best_own.astype(bool), ok], axis=1)
            rank = np.lexsort((new_id, np.where(ok, -score, np.iinfo(np.int64).max)), axis=1)[:, :k]
            best_score, best_id, best_own = (np.take_along_axis(x, rank, 1) for x in (score, new_id, ok))
            if best_score.shape[1] == k:
                full = best_own.all(axis=1)
                kth = np.where(full, np.maximum(kth, best_score[:, -1]), kth)
        if best_own.size:
            row, col = np.nonzero(best_own)
            out = [q_uid[row], q_id[row], best_id[row, col], best_score[row, col]]
    return pa.table([pa.array(np.asarray(x, np.int64)) for x in out], names=["query_uid", "query_id", "vec_id", "score"])


#: Names of the keys of a wave's queries; those of its blocks are dim, rank, home, sub.
APART = ("d", "r", "h", "s")


def _apart(asked: DataFrame) -> DataFrame:
    return asked.selectExpr("dim as d", "rank as r", "home as h", "sub as s", "uid", "vec_id", "kind", "w", "floor")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other vectors of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``. A query's own row never counts; another row with its id does.
    Fewer than ``k`` other vectors give all of them. Vectors are compared with those of their own length only.
    """
    spark = vectors.sparkSession
    index = common.written(blocks(weights_of(vectors, id_col, vector_col)), "topk-blocks")
    # one row for each range: its number among those of its length, and how many there are
    ranges = index.select("dim", "range").distinct().selectExpr("dim", "range", "row_number() over (partition by dim order by range) - 1L as rank", "count(*) over (partition by dim) as ranges")
    ranges = common.written(ranges, "topk-ranges")
    size = ranges.agg(F.max("ranges").alias("most"), F.count("*").alias("all")).first()
    asked = common.written(queries_of(index, every), "topk-queries")
    # a part is the queries of one range, or of several neighbours where ranges are small
    near = max(1, min(GROWTH**2, QUERIES * size["all"] // max(1, asked.count())))
    home = ranges.selectExpr("dim", "range as home", f"rank div {near} as part")
    asked = common.written(asked.join(home, ["dim", "home"]).drop("home").withColumnRenamed("part", "home").select(*(f.split()[0] for f in ASKED.split(", "))), "topk-asked")
    most = size["most"] or 0
    counts = ranges.select("dim", "ranges").distinct()
    parts = common.written(asked.select("dim", "home", "sub").distinct().join(counts, "dim").withColumn("start", F.expr(f"home * {near}")), "topk-parts")
    best, begin, end = None, 0, near
    while begin < most:
        # (part, range) pairs of this wave: ranges ``begin`` to ``end`` from the part's first on
        pairs = parts.where(f"ranges > {begin}").selectExpr("dim", "home", "sub", f"explode(sequence({begin}L, least({end}L, ranges) - 1)) as __off", "start", "ranges").selectExpr("dim", "home", "sub", "(start + __off) % ranges as rank")
        target = pairs.join(ranges.select("dim", "range", "rank"), ["dim", "rank"])
        if best is None:
            open_ = asked.withColumn("floor", F.lit(LEAST))
            moved = index.join(target, ["dim", "range"])
            wanted = open_.join(pairs, ["dim", "home", "sub"])
        else:
            kth = best.groupBy("query_uid").agg(F.min("score").alias("low"), F.count("*").alias("n"))
            open_ = asked.join(kth, asked["uid"] == kth["query_uid"], "left").selectExpr("dim", "home", "sub", "uid", "vec_id", "kind", "w", f"case when n >= {k} then low else {LEAST} end as floor")
            open_ = common.written(open_, "topk-floors")
            summaries = index.select("dim", "range", "block", "kind", "high", "low").join(target, ["dim", "range"])
            by = ("dim", "rank", "home", "sub")
            due = summaries.groupBy(*by).cogroup(_apart(open_.join(pairs, ["dim", "home", "sub"])).groupBy(*APART)).applyInArrow(needed, NEEDED)
            due = common.written(due, "topk-due")
            moved = index.join(due.drop("uids").join(ranges.select("dim", "range", "rank"), ["dim", "rank"]), ["dim", "range", "block"])
            wanted = open_.join(due.selectExpr("rank", "explode(uids) as uid").distinct(), "uid")
        hits = moved.groupBy("dim", "rank", "home", "sub").cogroup(_apart(wanted).groupBy(*APART)).applyInArrow(lambda a, b: search(a, b, k), HITS)
        if best is not None:
            hits = best.unionByName(hits)
        ranked = hits.selectExpr("*", "row_number() over (partition by query_uid order by score desc, vec_id) as rank").where(f"rank <= {k}")
        before, best = best, common.written(ranked.drop("rank"), "topk-best")
        for table in [before, open_, due] if before is not None else []:
            common.dropped(spark, table)
        begin, end = end, end * GROWTH
    if best is None:
        best = spark.createDataFrame([], HITS)
    for table in (index, asked, ranges, parts):
        common.dropped(spark, table)
    return best.selectExpr("query_id", "row_number() over (partition by query_uid order by score desc, vec_id) as rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the 20 best neighbours of every 20th embedding."""
    return top_k(common.table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
