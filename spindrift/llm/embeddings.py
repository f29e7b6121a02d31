"""Embedding near-duplicates by randomised-rotation binary codes.

Each unit vector is padded with zeros to ``BITS`` dimensions and turned by one random rotation (the same everywhere, from a
seed); the signs are its code, and the inner product of vector and code is stored with it as a correction factor. For a vector q
and a code c with factor f, <rotated q, c> / f estimates the cosine without bias, and the error stays below a bound that follows
from f except with negligible probability. A pair whose estimate plus bound is below the threshold is left; all others are
recomputed exactly in double precision, so that no pair below the threshold is ever linked.

Candidate pairs share a label and at least one of the code's 16-bit bands. Two vectors at the threshold of 0.98 share one of 16
bands with probability 0.998, closer ones with more (measured recall: README). Buckets are searched with the stored codes alone:
differing bits estimate the angle, and a pair stays if the bound of that estimate allows the threshold. Only vectors of members
with such a pair are fetched, once for each bucket in which they have one, with their stored codes and factors. Equal vectors are
one entry, whatever their number; buckets with many different vectors are cut into blocks, and pairs of blocks become separate
tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED, BITS, BAND = 7, 256, 16
#: Standard deviations of the estimate's error that the bound allows for.
SIGMAS = 5.0
#: Vectors in a block of a large bucket.
BLOCK = 1024
COSINE = 0.98

_rotations: dict = {}


def rotation(dim: int) -> np.ndarray:
    """(dim, bits): the part of a random rotation of the padded space that acts on the first ``dim`` axes."""
    if dim not in _rotations:
        bits = max(BITS, -(-dim // BAND) * BAND)
        noise = np.random.default_rng([SEED, dim]).standard_normal((bits, dim))
        _rotations[dim] = np.linalg.qr(noise)[0].T.astype(np.float32)  # rows: orthonormal in the padded space
    return _rotations[dim]


def codes(units: np.ndarray):
    """(packed sign bits, correction factor) of unit vectors."""
    turned = units.astype(np.float32) @ rotation(units.shape[1])
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def estimate(turned: np.ndarray, code: np.ndarray, factor: np.ndarray):
    """Estimated cosine and its error bound for turned vectors and codes row by row."""
    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    bits = turned.shape[1]
    f = np.maximum(factor, 1e-6)
    return np.einsum("ij,ij->i", turned, signs) / np.sqrt(bits) / f, SIGMAS * np.sqrt(np.maximum(1 - f * f, 0) / (f * f)) / np.sqrt(bits - 1)


def most_differing(bits: int, least: float) -> int:
    """Differing bits that two codes at the threshold may have: each differs with chance angle / pi."""
    p = np.arccos(np.clip(least, -1, 1)) / np.pi
    return int(np.ceil(bits * p + SIGMAS * np.sqrt(bits * p * (1 - p)))) + 1


def entries(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, cls, label, dim, vec) of every row: ``cls`` names the group of equal vectors with this label, null if the row can't link.

    A row can't link if its label or vector is null, if a component is null or not finite, or if the vector is zero or empty.
    ``vec`` holds the components as little-endian doubles.
    """
    src = vectors.select(vectors[id_col].alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    schema = src.select("id", "label").schema.add("cls", "string").add("dim", "integer").add("vec", "binary")

    def run(batches):
        for batch in batches:
            cls, dims, raw = [], [], []
            for label, v in zip(batch.column("label").to_pylist(), batch.column("v"), strict=True):
                own = None
                if label is not None and v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False)
                    if np.isfinite(x).all() and x.any():
                        own = (x + 0.0).astype("<f8").tobytes()  # -0.0 equals 0.0
                cls.append(own and xxhash.xxh3_128_hexdigest(repr(label).encode() + b"\0" + own))
                dims.append(len(own) // 8 if own else None)
                raw.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(cls, pa.string()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


CODED = ["cls", "label", "dim", "vec", "copies", "low", "code", "factor", "bands"]


def _coded(batches):
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            code, factor = codes(_units(part.column("vec").to_pylist(), int(dim)))
            bands = code.view(">u2").astype(np.int32)
            ends = pa.array(np.arange(len(bands) + 1, dtype=np.int32) * bands.shape[1])
            new = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor.astype(np.float64)), pa.ListArray.from_arrays(ends, pa.array(bands.reshape(-1)))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in CODED[:-3]), *new], names=CODED)


def _buckets(batches, columns: list[str]):
    """(rows of one bucket's pair of blocks, dim, band, lo, hi) from sorted rows of ``common.blocked_groups``."""
    for got in common.grouped(batches, "grp"):
        group = np.stack([got[k].to_numpy() for k in ("grp", "band", "key", "lo", "hi", "dim")])
        other = (group[:, 1:] != group[:, :-1]).any(axis=0) | pc.not_equal(got["label"][1:], got["label"][:-1]).to_numpy().astype(bool)
        cuts = np.flatnonzero(np.r_[True, other, True])
        held = {c: got[c].to_pylist() for c in columns}
        blk = got["blk"].to_numpy()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield {c: v[a:b] for c, v in held.items()} | {"blk": blk[a:b]}, group[:, a]


def _screened(batches, least: float, names: list[str]):
    """Members of each bucket that have a partner whose code is close enough, each pair in its first common band."""
    for rows, (grp, band, key, lo, hi, dim) in _buckets(batches, ["cls", "code", "label"]):
        code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows["cls"]), -1)
        bands, words = code.view(">u2"), np.ascontiguousarray(code).view(np.uint16)
        limit = most_differing(8 * code.shape[1], least)
        alive = np.zeros(len(code), bool)
        for i, j in _pairs_of(rows["blk"], lo, hi):
            ok = np.bitwise_count(words[i] ^ words[j]).sum(axis=1) <= limit
            i, j = i[ok], j[ok]
            ok = np.argmax(bands[i] == bands[j], axis=1) == band
            alive[i[ok]] = alive[j[ok]] = True
        at = np.flatnonzero(alive)
        if len(at):
            same = [np.full(len(at), x) for x in (grp, band, key, lo, hi, dim)]
            cells = {"grp": same[0], "band": same[1].astype(np.int32), "key": same[2].astype(np.int32), "lo": same[3].astype(np.int32), "hi": same[4].astype(np.int32), "dim": same[5].astype(np.int32), "blk": rows["blk"][at].astype(np.int32)}
            yield pa.RecordBatch.from_arrays([*map(pa.array, cells.values()), *(pa.array([rows[c][k] for k in at], pa.string()) for c in ("label", "cls"))], names=names)


def _exact(x: np.ndarray, y: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", raw_x, raw_y) / np.sqrt(np.einsum("ij,ij->i", raw_x, raw_x) * np.einsum("ij,ij->i", raw_y, raw_y))


def _linked(batches, least: float):
    """Partial link counts and local roots of each vector in each bucket."""
    for rows, (_, band, _, lo, hi, dim) in _buckets(batches, ["cls", "vec", "code", "factor", "copies", "label"]):
        n = len(rows["cls"])
        plain = np.frombuffer(b"".join(rows["vec"]), "<f8").reshape(n, dim)
        plain = plain / np.abs(plain).max(axis=1, keepdims=True)
        units = plain / np.sqrt((plain * plain).sum(axis=1, keepdims=True))
        code, factor = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(n, -1), np.array(rows["factor"])
        turned, bands, weight = units.astype(np.float32) @ rotation(int(dim)), code.view(">u2"), np.array(rows["copies"])
        total, root = np.zeros(n, np.int64), np.arange(n)
        for i, j in _pairs_of(rows["blk"], lo, hi):
            ok = np.argmax(bands[i] == bands[j], axis=1) == band  # each pair once, in its first common band
            i, j = i[ok], j[ok]
            near, bound = estimate(turned[i], code[j], factor[j])
            ok = near + bound >= least
            i, j = i[ok], j[ok]
            ok = _exact(units[i], units[j], plain[i], plain[j]) >= least
            i, j = i[ok], j[ok]
            if len(i):
                total += np.bincount(i, weights=weight[j], minlength=n).astype(np.int64) + np.bincount(j, weights=weight[i], minlength=n).astype(np.int64)
                own = np.flatnonzero(root != np.arange(n))
                root = common.local_roots(n, np.concatenate([i, own]), np.concatenate([j, root[own]]))
        at = np.flatnonzero(total)
        if len(at):
            names = rows["cls"]
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in at], pa.string()), pa.array([names[root[k]] for k in at], pa.string()), pa.array(total[at])], names=["a", "b", "n"])


def _pairs_of(blk: np.ndarray, lo: int, hi: int, most: int = 1 << 15):
    """Index pairs within one block (lo = hi) or between two, in pieces."""
    left, right = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
    rows = max(1, most // max(1, len(right)))
    for at in range(0, len(left), rows):
        i, j = np.repeat(left[at : at + rows], len(right)), np.tile(right, len(left[at : at + rows]))
        if lo == hi:
            ok = i < j
            i, j = i[ok], j[ok]
        yield i, j


def linked(vectors: DataFrame, least: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Links join different rows with equal labels and cosine >= ``least``; ``n_links`` counts them, equal vectors included.
    ``component_id`` is the smallest id reachable (the row's own if it links with nothing); rows with null ids take part and
    never name a component unless all its ids are null. Repeated ids count as separate rows.
    """
    spark = vectors.sparkSession
    rows = common.written(entries(vectors, id_col, vector_col, label_col), "embeddings")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("id").alias("low"))
    schema = "cls string, label string, dim int, vec binary, copies long, low {}, code binary, factor double, bands array<int>".format(classes.schema["low"].dataType.simpleString())
    classes = common.written(classes.select(*CODED[:-3]).mapInArrow(_coded, schema), "embedding-classes")
    members = classes.selectExpr("cls", "label", "dim", "code", "posexplode(bands) as (band, key)")
    order = ["grp", "label", "dim", "band", "key", "lo", "hi"]
    names = ["grp", "band", "key", "lo", "hi", "dim", "blk", "label", "cls"]
    spread = common.blocked_groups(members, ["label", "dim", "band", "key"], "cls", BLOCK).select(*names, "code").repartition("grp").sortWithinPartitions(*order)
    some = spread.mapInArrow(lambda it: _screened(it, least, names), "grp long, band int, key int, lo int, hi int, dim int, blk int, label string, cls string")
    some = common.written(some, "embedding-screened")
    full = some.join(classes.select("cls", "vec", "code", "factor", "copies"), "cls").repartition("grp").sortWithinPartitions(*order)
    found = common.written(full.mapInArrow(lambda it: _linked(it, least), "a string, b string, n long"), "embedding-links")
    common.dropped(spark, some)
    many = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    roots = common.components(found.select("a", "b"), "embedding-components").withColumnRenamed("node", "cls")
    named = classes.select("cls", "copies", "low").join(many, "cls", "left").join(roots, "cls", "left")
    named = named.selectExpr("cls", "copies - 1 + coalesce(n, 0) as n_links", "low", "coalesce(root, cls) as root")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = common.beside(named, lowest, "root").select("cls", "n_links", "component_id")
    out = common.beside(rows.select("id", "cls"), named, "cls", how="left")
    own = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: links, component and decision for every embedding."""
    return linked(common.table(spark, sf_dir, "embeddings"))


#: Each column of the result in SQL, for small tables: all pairs, then a recursion over the links.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98
), r AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id) AS n_links, min(r.y) AS component_id, e.vec_id = min(r.y) AS kept
FROM embeddings e JOIN r ON r.x = e.vec_id GROUP BY e.vec_id
"""
