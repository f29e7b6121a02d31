"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints: 64-bit SimHash of word shingles under XXH64. Search: fingerprints within ``distance`` bits of each other.

The index is a forest. Its top nodes are masked bit patterns: the 64 bits are cut into ``distance + 2`` segments, and two
fingerprints with at most ``distance`` differing bits agree on at least two of them, so they share at least one of the
patterns "two segments fixed". Every fingerprint goes below each of its 15 top nodes (for distance 4). Below a top node the
fingerprints stand in Gray rank order, groups of 4 neighbours share a node holding the bits on which all of them agree
(their mask and pattern, without the bits that a node above has already), and so on upwards. A search adds up the
differing bits on the way down and leaves a whole group as soon as the sum exceeds the distance. This is exact: no link
is missed and none is invented. All trees of an Arrow batch are built and searched together, level by level.

Equal fingerprints are one entry of the index, whatever the number of their documents. A top node with very many
fingerprints is cut into blocks, each with a tree of its own, and pairs of blocks become separate tasks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Shingles whose bits are counted at a time.
COUNT_AT_ONCE = 1 << 15
#: Fingerprints in a block of a divided top node, children of an index node, and node visits held at a time.
BLOCK, FAN, VISITS = 2048, 4, 1 << 18


def simhash(text: bytes | None, words_per_shingle: int = 4) -> int:
    """The fingerprint of one UTF-8 text as a signed 64-bit integer; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return int.from_bytes(xxhash.xxh64_digest(joined, SEED), "big", signed=True)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts, ends = (ends - length).tolist(), ends.tolist()[words_per_shingle - 1 :]
    digest, ones, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(ends)
    for at in range(0, n, COUNT_AT_ONCE):
        part = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + COUNT_AT_ONCE], ends[at : at + COUNT_AT_ONCE], strict=False)])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), words_per_shingle: int = 4, name: str = "fp") -> DataFrame:
    """``keep`` and the fingerprint (long) of every row of ``docs``; a null text counts as empty.

    A kept column with the name of the fingerprint gives way to it.
    """
    keep = common.others(keep, name)
    docs = common.of_texts(docs).select(*keep, docs[text_col].alias("__text"))
    schema = docs.select(*keep).schema.add(name, "long")

    def run(batches):
        for batch in common.sliced(batches, "__text"):
            texts = batch.column("__text").cast(pa.binary()).to_pylist()
            got = pa.array([simhash(t, words_per_shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), got], names=[*keep, name])

    return docs.mapInArrow(run, schema)


def top_masks(distance: int = 4) -> list[int]:
    """Masks of the top nodes: every choice of two out of distance + 2 segments of the 64 bits."""
    parts = distance + 2
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    segment = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [x | y for x, y in combinations(segment, 2)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the binary reflected Gray order."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayForest:
    """Hierarchical index of groups of fingerprints: one tree for each group, all with the same number of levels.

    ``codes`` (uint64) stand by group and, within a group, in Gray order; ``group`` counts from 0 without gaps. ``visited`` and
    ``pruned`` count the nodes that searches looked at, and those of them (leaves apart) that they left with all below.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.levels, self.visited, self.pruned = [], 0, 0  # levels from the leaves upwards: own mask, pattern, first child, children
        self.size = np.bincount(group)
        ones, zeros, first, many = codes.copy(), ~codes, np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        while True:
            self.levels.append([ones | zeros, ones, first, many])
            own = np.bincount(group)
            if own.max(initial=0) <= 1:
                break
            place = np.arange(len(group)) - (np.cumsum(own) - own)[group]
            first = np.flatnonzero(place % FAN == 0)
            many = np.diff(np.append(first, len(group)))
            ones, zeros, group = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first), group[first]
        for below, above in zip(self.levels, self.levels[1:], strict=False):
            below[0] = below[0] & ~np.repeat(above[0], above[3])

    def search(self, queries: np.ndarray, group: np.ndarray, distance: int):
        """Pieces (query index, code index) of all pairs within the distance, each query below its own group."""
        load = np.cumsum(self.size[group])
        start = 0
        while start < len(queries):
            stop = max(int(np.searchsorted(load, (load[start - 1] if start else 0) + VISITS, side="right")), start + 1)
            query, node = np.arange(start, stop), group[start:stop]
            seen = np.zeros(stop - start, np.int64)
            for level in range(len(self.levels) - 1, -1, -1):
                mask, pattern, first, many = self.levels[level]
                seen = seen + np.bitwise_count((queries[query] ^ pattern[node]) & mask[node])
                ok = seen <= distance
                self.visited += len(node)
                query, node, seen = query[ok], node[ok], seen[ok]
                if level:
                    self.pruned += len(ok) - len(node)
                    times = many[node]
                    query, seen, node = np.repeat(query, times), np.repeat(seen, times), common.ragged(first[node], times)
            yield query, node
            start = stop


def _ends(q: np.ndarray, c: np.ndarray):
    """Few of the pairs (q, c), c < q, so that every member stays in some pair: the first and last c of each q, the first q of each c."""
    order = np.lexsort((c, q))
    q, c = q[order], c[order]
    change = q[1:] != q[:-1]
    other = np.lexsort((q, c))
    head = other[np.r_[True, c[other][1:] != c[other][:-1]]] if len(c) else other
    keep = np.unique(np.concatenate([np.flatnonzero(np.r_[True, change]), np.flatnonzero(np.r_[change, True]), head])) if len(c) else head
    return q[keep], c[keep]


def _link(batches, masks: list[int], distance: int, direct: bool):
    masks = np.array(masks, np.uint64)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for got in common.grouped(batches, "grp"):
        cols = {c: got[c].to_numpy() for c in ("grp", "top", "key", "lo", "hi", "blk")}
        codes = got["fp"].to_numpy().astype(np.uint64)
        change = np.zeros(len(codes) - 1, bool)
        for c in ("grp", "top", "key", "lo", "hi"):
            change |= cols[c][1:] != cols[c][:-1]
        group = np.r_[0, np.cumsum(change)]
        order = np.lexsort((gray_rank(codes), group))
        codes, top, own, lo, hi = codes[order], cols["top"][order], cols["blk"][order], cols["lo"][order], cols["hi"][order]
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        both = np.intersect1d(group[left], group[right])  # groups with a tree and queries
        left, right = left[np.isin(group[left], both)], right[np.isin(group[right], both)]
        forest = GrayForest(codes[left], np.searchsorted(both, group[left]))
        within = lo == hi
        a = b = np.zeros(0, np.int64)
        for q, c in forest.search(codes[right], np.searchsorted(both, group[right]), distance):
            q, c = right[q], left[c]
            ok = (q != c) & (~within[q] | (c < q))
            q, c = q[ok], c[ok]
            first = np.argmax(((codes[q] ^ codes[c])[:, None] & masks[None, :]) == 0, axis=1)  # each link once, below its first common top node
            ok = first == top[q]
            q, c = q[ok], c[ok]
            if direct:
                q, c = _ends(q, c)
                yield pa.RecordBatch.from_arrays([pa.array(codes[x].astype(np.int64)) for x in (q, c)], schema=schema)
            elif len(q):
                root = common.local_roots(len(codes), np.concatenate([a, q]), np.concatenate([b, c]))
                a = np.flatnonzero(root != np.arange(len(codes)))
                b = root[a]
        yield pa.RecordBatch.from_arrays([pa.array(codes[x].astype(np.int64)) for x in (a, b)], schema=schema)


def links(codes: DataFrame, distance: int = 4, block: int = BLOCK, direct: bool = False) -> DataFrame:
    """Edges (a, b) whose components are those of "within ``distance`` bits", for distinct codes in the column ``fp``.

    With ``direct`` each edge is a pair within ``distance`` bits itself: some for every code that has any, by far not all.
    """
    masks = top_masks(distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tops = ", ".join(f"named_struct('top', {k}, 'key', fp & {m}L)" for k, m in enumerate(signed))
    placed = codes.selectExpr("fp", f"inline(array({tops}))")
    spread = common.blocked_groups(placed, ["top", "key"], "fp", block)
    spread = spread.select("grp", "top", "key", "lo", "hi", "blk", "fp").repartition("grp").sortWithinPartitions("grp", "top", "key", "lo", "hi")
    return spread.mapInArrow(lambda it: _link(it, masks, distance, direct), "a long, b long")


def near_duplicates(fps: DataFrame, distance: int = 4, id_col: str = "doc_id", edges: DataFrame | None = None) -> DataFrame:
    """Component of every fingerprint of ``fps(id_col, fp)``: (fp, component_id, rep_fp); ``edges`` (a, b) replace the links by distance.

    ``component_id`` is the smallest id reachable over links between fingerprints at most ``distance`` bits apart, null
    only if no row of the component has an id; ``rep_fp`` is a fingerprint of that id. Repeated ids, ties and empty tables
    are fine: nodes are the fingerprints themselves, never the ids.
    """
    codes = common.written(fps.groupBy("fp").agg({id_col: "min"}).toDF("fp", "low"), "simhash-codes")
    found = common.components(links(codes.select("fp"), distance) if edges is None else edges, "simhash-links")
    named = codes.join(found, codes["fp"] == found["node"], "left").selectExpr("fp", "low", "coalesce(root, fp) as root")
    pair, order = F.struct("low", "fp"), F.struct(F.col("low").isNull(), F.col("low"), F.col("fp"))
    best = named.groupBy("root").agg(F.min_by(pair, order).alias("best")).selectExpr("root", "best.low as component_id", "best.fp as rep_fp")
    return common.beside(named, best, "root").select("fp", "component_id", "rep_fp")


def with_components(docs: DataFrame, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """(id, fp, component_id, rep_fp) of every document."""
    fps = common.written(fingerprints(docs, text_col, (id_col,), words_per_shingle), "simhash-fps")
    return common.beside(fps, near_duplicates(fps, distance, id_col), "fp", how="left")


def deduplicated(docs: DataFrame, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near duplicates: the one with the smallest id.

    Of several rows with that id and fingerprint (repeated rows) one stays. Columns are those of ``docs``.
    """
    coded = common.written(fingerprints(docs, text_col, tuple(docs.columns), words_per_shingle, "__fp"), "simhash-docs")
    stay = near_duplicates(coded.select(id_col, coded["__fp"].alias("fp")), distance, id_col).selectExpr("component_id as __id", "rep_fp as __rep").distinct()
    kept = coded.join(stay, coded[id_col].eqNullSafe(stay["__id"]) & (coded["__fp"] == stay["__rep"]), "left_semi")
    order = ", ".join(f"`{n}`" for n in docs.columns if n != id_col)
    kept = kept.selectExpr("*", f"row_number() over (partition by `{id_col}`, __fp order by {order or '__fp'}) as __n")
    return kept.where("__n = 1").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: fingerprint and component of every document."""
    found = with_components(common.table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) as fingerprint", "component_id")
