"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

The graph. Every different vector is a node that keeps the ``NEIGHBOURS`` nearest nodes it has met. It begins with nodes that stand
beside it when all are sorted by the signs of random projections, and some random ones. In each round a node brings together the
neighbours that it has, both ways: those that are new since they were last brought together with each other and with a sample of the
older ones. A neighbour's neighbour that is nearer than the worst one kept takes its place. Rounds end when few neighbours are new.
A round is a handful of joins: neighbour lists and their reverse by node, vectors to the lists by node, nearer ones back to the
lists. Reverse lists are cut to a sample before they are shuffled, what a task has found is cut to the best of each node, so a node
that very many others are near to costs no more than others.

The search. A query starts from the nearest of a bounded sample of nodes and, where it is a row of the index itself, from its own
node. In each round all nodes of its list of the ``BEAM`` nearest that are not yet opened are opened: their neighbours in the
graph, both ways, join the list by exact distance; it ends when all are open. All queries move together, as joins.

Equal vectors are one node, whatever their number; of each node as many ids as an answer can name are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 11
#: Neighbours that a node keeps; how many new, and how many older ones, it brings together each way in a round (fewer in the first).
NEIGHBOURS, SAMPLE, FIRST_SAMPLE = 32, 12, 6
#: Neighbours that one meeting proposes to a node, at most.
PROPOSED = 8
#: Rounds at most, and the share of new neighbours with which they end.
ROUNDS, FEW_NEW = 14, 0.01
#: Sort orders of the first neighbours, bits of each, neighbours taken after a node in each order.
ORDERS, BITS, AFTER = 4, 60, 2
#: Nodes in a query's list, nodes of the sample that a search starts from, and how many of them.
BEAM, ENTRIES, STARTS = 192, 1024, 16
#: Rows of proposals that a task holds before it cuts them to the best of each node.
HELD = 1 << 18

LIST = "array<struct<d:float,id:bigint,fresh:boolean>>"


def rows_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cls, dim, vec) of the rows that take part; ``cls`` is the same for equal vectors, ``vec`` holds the components (float64, or float32 if the column is float).

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components, take no part.
    """
    plain = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "<f4" if plain == "float" else "<f8"
    src = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    schema = src.select("id").schema.add("cls", "string").add("dim", "integer").add("vec", "binary")

    def run(batches):
        for batch in batches:
            cls, dim, raw = [], [], []
            for own, v in zip(batch.column("id"), batch.column("v"), strict=True):
                got = None
                if own.is_valid and v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False)
                    if np.isfinite(x).all() and x.any():
                        got = (x + 0).astype(kind).tobytes()
                cls.append(got and xxhash.xxh3_128_hexdigest(got))
                dim.append(got and len(got) // int(kind[-1]))
                raw.append(got)
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cls, pa.string()), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())], names=schema.names)
            yield out.filter(pa.array([c is not None for c in cls], pa.bool_()))

    return src.mapInArrow(run, schema)


def numbered(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame, int]:
    """(nodes(node, cls, vec, ids), rows with their node's class, number of nodes): nodes are the different vectors, from 0 without gaps.

    ``ids`` are the ``most`` smallest ids of a node. All vectors have the most frequent length (of several, the smallest); others go.
    """
    rows = common.written(rows, "neighbour-rows")
    usual = rows.groupBy("dim").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "dim").limit(1)
    rows = rows.join(F.broadcast(usual.select("dim")), "dim", "left_semi")  # one row
    placed = rows.selectExpr("cls", "id", "row_number() over (partition by cls order by id) as k").where(f"k <= {most}")
    ids = placed.groupBy("cls").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # ``most`` at most
    single = rows.groupBy("cls").agg(F.first("vec").alias("vec")).join(ids, "cls").selectExpr("cls", "vec", "ids", "monotonically_increasing_id() as at")
    single = common.written(single, "neighbour-nodes")
    parts = single.groupBy(F.expr("shiftright(at, 33)").alias("part")).agg(F.count("*").alias("c"))  # a row for each task
    begin = parts.selectExpr("part", "coalesce(sum(c) over (order by part rows between unbounded preceding and 1 preceding), 0) as begin")
    nodes = single.withColumn("part", F.expr("shiftright(at, 33)")).join(F.broadcast(begin), "part").selectExpr("begin + at - shiftleft(part, 33) as node", "cls", "vec", "ids")
    return nodes, rows, single.count()


def _matrix(column, kind: str) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def _sorted_codes(batches, kind: str, centre: np.ndarray):
    turn = np.random.default_rng([SEED, len(centre)]).standard_normal((len(centre), ORDERS * BITS))
    for batch in batches:
        if not batch.num_rows:
            continue
        bits = (_matrix(batch.column("vec"), kind) - centre) @ turn >= 0
        code = (bits.reshape(-1, ORDERS, BITS) * (1 << np.arange(BITS - 1, -1, -1))).sum(axis=2)
        node = batch.column("node").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(ORDERS, dtype=np.int32), len(node))), pa.array(code.reshape(-1)), pa.array(np.repeat(node, ORDERS))], names=["place", "code", "node"])


def _beside(batches):
    """Pairs of nodes at most ``AFTER`` places from each other in an order."""
    place, node = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for batch in batches:
        held = len(node)
        place, node = np.r_[place, batch.column("place").to_numpy()], np.r_[node, batch.column("node").to_numpy()]
        a, b = [], []
        for step in range(1, AFTER + 1):
            at = np.arange(max(0, held - step), len(node) - step)
            at = at[(place[at] == place[at + step]) & (at + step >= held)]
            a.append(node[at])
            b.append(node[at + step])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
        place, node = place[-AFTER:], node[-AFTER:]


def first_lists(nodes: DataFrame, n: int, kind: str, centre: np.ndarray) -> DataFrame:
    """(node, vec, nbrs): neighbours of sort orders and random ones, their distances not known yet."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    codes = nodes.select("node", "vec").mapInArrow(lambda it: _sorted_codes(it, kind, centre), "place int, code long, node long")
    pairs = codes.repartitionByRange(parts, "place", "code", "node").sortWithinPartitions("place", "code", "node").mapInArrow(_beside, "a long, b long")
    chance = nodes.selectExpr("node as a", f"explode(transform(sequence(1, {NEIGHBOURS - 2 * ORDERS * AFTER}), k -> pmod(xxhash64(node, k), {n}L))) as b")
    every = pairs.unionByName(pairs.selectExpr("b as a", "a as b")).unionByName(chance).where("a <> b")
    lists = every.groupBy("a").agg(F.collect_set("b").alias("ids"))  # ``NEIGHBOURS`` at most
    return nodes.select("node", "vec").join(lists, nodes["node"] == lists["a"], "left").selectExpr("node", "vec", f"cast(transform(coalesce(ids, array()), x -> named_struct('d', float('infinity'), 'id', x, 'fresh', true)) as {LIST}) as nbrs")


def _best(u: np.ndarray, w: np.ndarray, d: np.ndarray, most: int):
    """The ``most`` nearest different w of each u."""
    order = np.lexsort((w, d, u))
    u, w, d = u[order], w[order], d[order]
    new = np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])] if len(u) else np.zeros(0, bool)  # equal pairs have equal distances
    u, w, d = u[new], w[new], d[new]
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
    place = np.arange(len(u)) - np.repeat(first, np.diff(np.r_[first, len(u)]))
    return u[place < most], w[place < most], d[place < most]


def _met(batches, kind: str, neighbours: int):
    """Proposals (u, w, d) of all meetings: the nearest members of each member, if nearer than the worst it keeps."""
    held, size = [], 0

    def told():
        u, w, d = _best(*(np.concatenate(x) for x in zip(*held, strict=True)), neighbours)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), pa.array(d)], names=["u", "w", "d"])

    for got in common.grouped(batches, "v"):
        v, u, worst, fresh = (got[c].to_numpy() for c in ("v", "u", "worst", "fresh"))
        x = _matrix(got["vec"], kind).astype(np.float32)
        order = np.lexsort((~fresh, u, v))
        once = order[np.r_[True, (v[order][1:] != v[order][:-1]) | (u[order][1:] != u[order][:-1])]]
        v, u, worst, fresh, x = v[once], u[once], worst[once], fresh[once], x[once]
        cuts = np.flatnonzero(np.r_[True, v[1:] != v[:-1], True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            f = np.flatnonzero(fresh[a:b])
            if not len(f) or b - a < 2:
                continue
            apart = x[a:b][f][:, None, :] - x[a:b][None, :, :]
            d = np.einsum("ijk,ijk->ij", apart, apart)
            d[np.arange(len(f)), f] = np.inf
            for own, other, dist in ((f, np.arange(b - a), d), (np.arange(b - a), f, d.T)):
                few = min(PROPOSED, dist.shape[1])
                near = np.argpartition(dist, few - 1, axis=1)[:, :few]
                dist = np.take_along_axis(dist, near, axis=1)
                i, j = np.nonzero(dist < worst[a:b][own][:, None])
                held.append((u[a:b][own[i]], u[a:b][other[near[i, j]]], dist[i, j]))
                size += len(i)
        if size > HELD:
            yield told()
            held, size = [], 0
    if held:
        yield told()


def descended(nodes: DataFrame, n: int, kind: str, centre: np.ndarray) -> DataFrame:
    """(node, vec, nbrs): the neighbour graph; ``nbrs`` are (squared distance, node, fresh) by rising distance."""
    spark, k = nodes.sparkSession, NEIGHBOURS
    graph = common.written(first_lists(nodes, n, kind, centre), "neighbour-graph")
    for step in range(ROUNDS):
        s = FIRST_SAMPLE if step == 0 else SAMPLE
        some = lambda test: f"transform(slice(array_sort(transform(filter(nbrs, x -> {test}), x -> named_struct('h', xxhash64(node, x.id, {step}), 'id', x.id))), 1, {s}), x -> x.id)"  # noqa: B023, E731
        drawn = graph.selectExpr("node", f"{some('x.fresh')} as news", f"{some('not x.fresh')} as olds")
        ahead = drawn.selectExpr("node as v", "inline(concat(transform(news, x -> named_struct('u', x, 'fresh', true)), transform(olds, x -> named_struct('u', x, 'fresh', false))))")
        back = ahead.where("u <> v").selectExpr("u as v", "v as u", "fresh")
        back = back.selectExpr("*", f"row_number() over (partition by v, fresh order by xxhash64(u, v, {step})) as k").where(f"k <= {s}").drop("k")
        lists = ahead.unionByName(back).groupBy("v").agg(F.collect_list(F.struct("u", "fresh")).alias("us")).where("exists(us, x -> x.fresh)")  # 4 x sample at most
        members = lists.selectExpr("v", "inline(concat(us, array(named_struct('u', v, 'fresh', false))))")
        own = graph.selectExpr("node as u", "vec", f"if(size(nbrs) < {k}, float('infinity'), element_at(nbrs, -1).d) as worst")
        meetings = members.join(own, "u").select("v", "u", "fresh", "worst", "vec").repartition("v").sortWithinPartitions("v")
        found = meetings.mapInArrow(lambda it: _met(it, kind, k), "u long, w long, d float").groupBy("u").agg(F.collect_set(F.struct("d", F.col("w").alias("id"))).alias("found"))
        news = drawn.selectExpr("node as __n", "news")
        both = graph.join(news, graph["node"] == news["__n"]).join(found, graph["node"] == found["u"], "left")
        kept = "filter(transform(nbrs, x -> named_struct('d', x.d, 'id', x.id, 'fresh', x.fresh and not array_contains(news, x.id))), x -> x.fresh or x.d < float('infinity'))"
        added = "transform(array_except(coalesce(found, array()), transform(nbrs, x -> named_struct('d', x.d, 'id', x.id))), x -> named_struct('d', x.d, 'id', x.id, 'fresh', true))"
        known = f"array_sort(concat({kept}, {added}))"
        # a neighbour whose distance has become known stands before its first entry without one
        old, graph = graph, common.written(both.selectExpr("node", "vec", f"{known} as nbrs").selectExpr("node", "vec", f"cast(slice(filter(nbrs, x -> x.d < float('infinity') or not exists(nbrs, y -> y.id = x.id and y.d < x.d)), 1, {k}) as {LIST}) as nbrs"), "neighbour-graph")
        common.dropped(spark, old)
        fresh = graph.agg(F.sum(F.expr("size(filter(nbrs, x -> x.fresh))"))).first()[0] or 0
        if fresh <= FEW_NEW * n * min(k, n):
            break
    return graph


def links(graph: DataFrame) -> DataFrame:
    """(node, nbrs): the graph to walk on, neighbours both ways; of those that name a node the nearest ``NEIGHBOURS``."""
    ahead = graph.selectExpr("node", "inline(nbrs)").where("d < float('infinity')").select("node", "d", "id")
    back = ahead.selectExpr("id", "node", f"row_number() over (partition by id order by d, node) as k").where(f"k <= {NEIGHBOURS}").selectExpr("id as node", "node as id")
    return ahead.select("node", "id").unionByName(back).groupBy("node").agg(F.collect_set("id").alias("nbrs"))  # twice ``NEIGHBOURS`` at most


def _distances(batches, kind: str):
    for batch in batches:
        if batch.num_rows:
            apart = _matrix(batch.column("target"), kind).astype(np.float64) - _matrix(batch.column("vec"), kind)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("id"), pa.array(np.sqrt(np.einsum("ij,ij->i", apart, apart)))], names=["q", "id", "d"])


def _starts(batches, kind: str, entry: np.ndarray, entries: np.ndarray):
    for batch in batches:
        for q, vec in zip(batch.column("q").to_pylist(), batch.column("target").to_pylist(), strict=True):
            apart = entries - np.frombuffer(vec, kind)
            near = np.argsort(np.einsum("ij,ij->i", apart, apart), kind="stable")[:STARTS]
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(near), pa.int64()), pa.array([vec] * len(near), pa.binary()), pa.array(entry[near])], names=["q", "target", "id"])


def searched(queries: DataFrame, walk: DataFrame, nodes: DataFrame, kind: str, entry: np.ndarray, entries: np.ndarray, beam: int = BEAM) -> DataFrame:
    """(q, beam) of ``queries(q, target, own)``: the nearest nodes found, (distance, node) by rising distance; ``own`` is the query's node, or null."""
    spark = queries.sparkSession
    vectors = nodes.select(F.col("node").alias("id"), "vec")
    measured = lambda pairs: pairs.join(vectors, "id").select("q", "target", "id", "vec").mapInArrow(lambda it: _distances(it, kind), "q long, id long, d double").groupBy("q").agg(F.collect_set(F.struct("d", "id")).alias("met"))
    seeds = queries.select("q", "target").mapInArrow(lambda it: _starts(it, kind, entry, entries), "q long, target binary, id long")
    seeds = seeds.unionByName(queries.where("own is not null").selectExpr("q", "target", "own as id")).distinct()
    state = queries.select("q", "target").join(measured(seeds), "q").selectExpr("q", "target", "transform(array_sort(met), x -> named_struct('d', x.d, 'id', x.id, 'open', false)) as beam", "transform(met, x -> x.id) as seen")
    state = common.written(state, "neighbour-search")
    while state.where("exists(beam, x -> not x.open)").limit(1).count():
        front = state.selectExpr("q", "explode(transform(filter(beam, x -> not x.open), x -> x.id)) as node")
        around = common.beside(front, walk, "node").groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("ids"))  # beam x neighbours at most
        new = state.select("q", "target", "seen").join(around, "q").selectExpr("q", "target", "explode(array_except(ids, seen)) as id")
        met = measured(new)
        both = state.join(met, "q", "left").withColumn("met", F.expr("coalesce(met, array())"))
        after = "concat(transform(beam, x -> named_struct('d', x.d, 'id', x.id, 'open', true)), transform(met, x -> named_struct('d', x.d, 'id', x.id, 'open', false)))"
        old, state = state, common.written(both.selectExpr("q", "target", f"slice(array_sort({after}), 1, {beam}) as beam", "concat(seen, transform(met, x -> x.id)) as seen"), "neighbour-search")
        common.dropped(spark, old)
    return state.select("q", "beam")


def nearest(vectors: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest rows found of each row for which the condition ``is_query`` (over ``id``) holds.

    Nearness is Euclidean distance, computed exactly in double precision; ties go to the smaller id. A row is not its own neighbour,
    another row with its id is. Rows that ``rows_of`` leaves out take no part, nor do vectors of another length than most have. Fewer
    rows than ``k`` give shorter answers; an empty table gives none.
    """
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    nodes, rows, n = numbered(rows_of(vectors, id_col, vector_col), k + 1)
    sample = nodes.orderBy(F.xxhash64("node")).limit(ENTRIES).select("node", "vec").collect()  # ``ENTRIES`` vectors at most
    entry = np.array([r["node"] for r in sample], np.int64)
    entries = np.array([np.frombuffer(r["vec"], kind) for r in sample], np.float64).reshape(len(sample), -1 if sample else 1)
    graph = descended(nodes, n, kind, entries.mean(axis=0) if sample else np.zeros(1))
    walk = common.written(links(graph), "neighbour-links")
    asked = common.written(rows.where(is_query).select("cls", F.col("id").alias("query_id")), "neighbour-queries")
    queries = nodes.join(asked.select("cls").distinct(), "cls", "left_semi").selectExpr("node as q", "vec as target", "node as own")
    found = searched(queries, walk, nodes, kind, entry, entries, beam).selectExpr("q", f"inline(slice(beam, 1, {k + 1}))").drop("open")
    found = found.join(nodes.selectExpr("node as id", "ids"), "id").selectExpr("q", "transform(ids, x -> named_struct('score', d, 'id', x)) as few").groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("few"))), 1, k + 1).alias("best"))
    named = found.join(nodes.selectExpr("node as q", "cls"), "q").select("cls", "best")
    out = common.beside(asked, named, "cls")
    own = "array_position(transform(best, x -> x.id), query_id)"  # 0: its copies with smaller ids fill the answer
    out = out.selectExpr("query_id", f"posexplode(slice(filter(best, (x, i) -> i + 1 <> {own}), 1, {k})) as (at, x)")
    return out.selectExpr("query_id", "at + 1 as rank", f"x.id as `{id_col}`", "x.score as score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the ten nearest vectors found for each row whose id 100 divides; rows that take no part have no answer, an empty table gives no rows."""
    return nearest(common.table(spark, sf_dir, "embeddings"), "id % 100 = 0")
