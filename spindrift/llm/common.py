"""Shared plumbing of the training-data operators: written tables, Arrow slicing, run pairing, components."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step handles at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a local one in local mode (tests), else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.startswith("local"):
        found = "file://" + os.path.join(tempfile.gettempdir(), "spindrift-tables")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/spindrift-tables").rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and every executor sees the files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of texts in an Arrow batch, at most: Spark's default of 10,000 long texts, on both sides of a Python worker, is hundreds of MB.
TEXT_ROWS = 1000


def of_texts(docs: DataFrame) -> DataFrame:
    """``docs``; lowers the session's rows in an Arrow batch to ``TEXT_ROWS`` where they are more. Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = int(docs.sparkSession.conf.get(key))
    if most <= 0 or most > TEXT_ROWS:
        docs.sparkSession.conf.set(key, str(TEXT_ROWS))
    return docs


def placed(docs: DataFrame, label: str) -> DataFrame:
    """``docs`` with ``__file`` and ``__pos``, which name a row: its file's hash and its place there.

    A table that isn't read from files as it stands is written first, under ``label``.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = written(docs, label)
    return docs.selectExpr("*", "xxhash64(_metadata.file_path) as __file", "_metadata.row_index as __pos")


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_held: dict = {}


def own(name: str, make):
    """This Python worker's state of one operator, made by ``make`` at first; that of other operators goes, so that memory stays bounded."""
    if name not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[name] = make()
    return _held[name]


def sliced(batches, column: str, limit: int = SLICE_BYTES):
    """Cut Arrow batches so that ``column`` (text) holds about ``limit`` bytes in each piece; one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = int(max(np.searchsorted(ends, base + limit, side="right"), start + 1))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def others(keep: tuple[str, ...], *results: str) -> tuple[str, ...]:
    """Kept columns without those named like a result."""
    return tuple(k for k in keep if k not in results)


def texts_of(docs: DataFrame, keep: tuple[str, ...], text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with the columns ``keep`` and the text, and the name of the text's column; a text that is kept anyway goes once."""
    if text_col in keep:
        return of_texts(docs).select(*keep), text_col
    return of_texts(docs).select(*keep, docs[text_col].alias("__text")), "__text"


def text_chunks(column: pa.Array, blanks: str = "\n\t\r"):
    """Split texts at spaces and ``blanks``: (offsets of each row's chunks, index of each chunk, distinct chunks).

    Null texts count as empty; empty chunks stay (index of ``""``), as callers give them no weight.
    """
    flat = column.fill_null("")
    for c in blanks:
        if pc.any(pc.match_substring(flat, c)).as_py():
            flat = pc.replace_substring(flat, c, " ")
    parts = pc.split_pattern(flat, " ")
    offsets = parts.offsets.to_numpy()
    coded = parts.flatten().dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i]+lengths[i]-1 of all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] per i, along axis 0; empty rows give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def run_pairs(group: np.ndarray, most: int = 1 << 20):
    """All index pairs (i, j), i < j, of rows in the same run of ``group`` (sorted), in pieces of about ``most`` pairs."""
    n = len(group)
    got_i, got_j, size = [], [], 0
    alive = np.arange(n)
    step = 1
    while len(alive):
        alive = alive[alive + step < n]
        alive = alive[group[alive] == group[alive + step]]
        if not len(alive):
            break
        got_i.append(alive)
        got_j.append(alive + step)
        size += len(alive)
        if size >= most:
            yield np.concatenate(got_i), np.concatenate(got_j)
            got_i, got_j, size = [], [], 0
        step += 1
    if size:
        yield np.concatenate(got_i), np.concatenate(got_j)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def grouped(batches, key: str):
    """Cut sorted Arrow batches at changes of ``key``, so that no run of it is divided; small runs stay together.

    What is held is one input batch and at most one run that began in an earlier one.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != keys[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if len(change):
            cut = int(change[-1]) + 1
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks()
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def beside(rows: DataFrame, single: DataFrame, key: str, salts: int = 8, how: str = "inner") -> DataFrame:
    """Join of ``rows`` with ``single``, which has one row for each ``key``; a key's rows are dealt over ``salts`` places.

    So a key that a large part of the rows has isn't the work of one task, whatever its share. Null keys meet nothing.
    """
    own = [c for c in rows.columns if c != key]
    salted = rows.withColumn("__salt", F.expr(f"cast(pmod(xxhash64({', '.join(f'`{c}`' for c in own) or '1'}), {salts}) as int)"))
    spread = single.selectExpr("*", f"explode(sequence(0, {salts - 1})) as __salt")
    return salted.join(spread, [key, "__salt"], how).drop("__salt")


def blocked_groups(members: DataFrame, keys: list[str], order: str, cap: int) -> DataFrame:
    """Spread the members of each key over block pairs of about 2 * ``cap`` rows.

    Adds ``grp`` (one value for each key and block pair, to shuffle and sort by), ``blk`` (the row's own block) and
    ``lo``/``hi`` (the pair). Keys with one member go. A key with at most ``cap`` members is one pair (0, 0); larger ones
    become B blocks and B * (B + 1) / 2 pairs, so that no task gets more than two blocks and no pair of rows is lost. Members are
    counted by partial sums and dealt to blocks by the hash of ``order``; nothing passes a whole key through one task.
    """
    counts = members.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    small = members.join(counts, keys)
    spread = small.selectExpr("*", f"cast((__n - 1) div {cap} as int) as __last")
    spread = spread.selectExpr("*", f"cast(pmod(xxhash64({order}), __last + 1) as int) as blk", "explode(sequence(0, __last)) as __other")
    spread = spread.selectExpr("*", "least(blk, __other) as lo", "greatest(blk, __other) as hi")
    return spread.selectExpr("*", f"xxhash64({', '.join(keys)}, lo, hi) as grp").drop("__n", "__last", "__other")


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, root), root = smallest node reachable; nodes without edges don't occur.

    Alternates large-star and small-star steps over written tables until nothing changes; all work is aggregation and
    salted equi-joins, so no component, and no hub of one, is ever gathered in one place. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    cur = written(edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct(), label)
    sign = None
    while True:
        now = cur.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if (now["n"], now["x"]) == sign or not now["n"]:
            break
        sign = (now["n"], now["x"])
        both = cur.unionByName(cur.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = beside(both.where("v > u"), low, "u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        large = written(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = beside(large, low, "u").where("v <> m").selectExpr("v as u", "m as v").unionByName(low.selectExpr("u", "m as v")).distinct()
        old, cur = cur, written(small, label)
        dropped(spark, old)
        dropped(spark, large)
    return cur.selectExpr("u as node", "v as root").unionByName(cur.selectExpr("v as node", "v as root").distinct())
