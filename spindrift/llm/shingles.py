"""Near-duplicates by exact Jaccard similarity of word shingles, over the SimHash index.

Two documents are linked if their sets of shingles (``WORDS`` lower-case words; a shorter text is one shingle of its own) have a
Jaccard similarity of at least 4/5. Equal sets are one class, whatever the number of their documents.

Most links come from the SimHash index: classes whose fingerprints over these shingles are within ``DISTANCE`` bits are candidates,
a few for each class, and the exact similarity decides. A fingerprint of 64 bits cannot promise more: at 4/5 some ten bits differ.
The rest is found exactly, by prefixes: with all shingles in one global order, two sets that similar share one of the first
``n - ceil(4n/5) + 1`` shingles of each. Any order is right; the one used puts shingles that recur last, so that passages which many
documents have are no candidates' keys. Pairs that verified links have joined already need no look; lengths, places in the order
and parity maps (the set, folded to about as many bits as it has shingles: differing bits never outnumber differing shingles) rule
out what cannot reach 4/5, and only what is left is compared on whole sets, made again from the texts.

A group of n sets may have n * n / 2 such pairs, each below many shingles. They are never rows: a pairing task gives a forest, at
most one pair for each set it has. A first forest has one pair for two components that are to be joined, the one that differs least;
whole sets decide on it, which leaves few components apart. A second one, of the sets themselves, says which sets could still be
similar; these meet in cells, and there every pair that is still apart is compared. So what is refused costs no row either.

Shingles are 64-bit mixes of the XXH64 of their words. A shingle that very many sets have in their prefixes is cut into blocks, and
pairs of blocks are separate tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

WORDS, DISTANCE = 5, 4
#: Sets in a block of a divided shingle, and sets of a shingle that are paired at once.
BLOCK, FEW = 2048, 8
#: Recurring shingles that set the order, at most; the counts come from all documents.
COMMON = 1 << 16
#: Prefix entries of a bucket, about.
BUCKET = 1 << 17
#: Sets that a task remembers so as not to give them twice, bytes of text and pairs looked at in one step.
REMEMBERED, SLICE, PAIRS = 1 << 16, 2 << 20, 1 << 18
#: Bits of a set's parity map, at least; bits (a power of two) of the map of rows whose sets are wanted.
PARITY, WANTED = 512, 1 << 25
#: Bits of the folded parity map that goes with an entry of a shingle that very many sets have, at most.
FOLDED = 4096
#: Odd factors of the words of a shingle.
FACTORS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Bytes of the sets in a cell in which pairs are compared, about; what a set counts besides its shingles where all pairs are.
CELL, EACH = 8 << 20, 2048
#: Shingles that are compared with a set at once.
AT_ONCE = 1 << 20
#: Rows that go, at most, for which their places are broadcast (under 64 MB); more are joined by shuffle.
FEW_PLACES = 1 << 19


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def shingled(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes (uint64) of all texts, repeats included, offsets of each text); a null text counts as empty."""
    offsets, index, distinct = common.text_chunks(texts, "\n\t\r\v\f")
    low = pc.ascii_lower(distinct).cast(pa.binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, simhash.SEED) for w in low), np.uint64, len(low))
    present = np.fromiter(map(bool, low), bool, len(low))[index]
    ends = np.concatenate([[0], np.cumsum(present)])[offsets]
    word = hashes[index[present]]
    n = np.diff(ends)
    many = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    first = common.ragged(ends[:-1], many)
    out = np.zeros(len(first), np.uint64)
    size = np.repeat(np.minimum(n, words), many)
    for k in range(words):
        ok = k < size
        out[ok] += word[first[ok] + k] * FACTORS[k % len(FACTORS)] * np.uint64(2 * (k // len(FACTORS)) + 1)
    return _mixed(out + size.astype(np.uint64)), np.concatenate([[0], np.cumsum(many)])


def _bits(shingles: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes, as a signed integer; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), simhash.COUNT_AT_ONCE):
        part = shingles[at : at + simhash.COUNT_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big", signed=True)


def digest(shingles: np.ndarray) -> int:
    """The signed 64-bit hash of a sorted set of shingles."""
    return int.from_bytes(xxhash.xxh64_digest(shingles.tobytes(), simhash.SEED), "big", signed=True)


def parity(shingles: np.ndarray, bits: int = 0) -> bytes:
    """The set folded to a power of two of bits, about as many as it has shingles: each tells whether an odd number of its shingles falls there."""
    bits = bits or max(PARITY, 1 << len(shingles).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def least_differing(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one set only, by their parity maps; the larger map is folded to the size of the other."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def folded(raw: bytes, bits: int) -> bytes:
    """A parity map of at most so many bits: halves of it, put upon each other."""
    x = np.frombuffer(raw, np.uint64)
    while 64 * len(x) > bits:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def _sets(texts: pa.Array, words: int):
    """(digest, sorted set, all shingles) of each text."""
    flat, ends = shingled(texts, words)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own = np.unique(flat[a:b])
        yield digest(own), own, flat[a:b]


CLASSES = "file long, pos long, fp long, sim long, n int, map binary, often array<long>, times array<int>"


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(file, pos, id, fp, sim, n, map) of every row of ``docs`` (with ``__file`` and ``__pos``): digest, SimHash, size and parity map of its set.

    Further rows, without a place, hold the shingles that recur in a slice of the texts (``often``) and in how many of its sets.
    """
    src = docs.select(F.col("__file").alias("file"), F.col("__pos").alias("pos"), docs[id_col].cast("long").alias("id"), docs[text_col].alias("__text"))

    def run(batches):
        common.own("shingles", dict)  # what other operators held in this worker goes
        for batch in common.sliced(batches, "__text", SLICE):
            found = list(_sets(batch.column("__text"), words))
            once = {d: s for d, s, _ in found}
            often, times = np.unique(np.concatenate([*once.values(), np.zeros(0, np.uint64)]), return_counts=True)
            often, times = often[times > 1].view(np.int64), times[times > 1].astype(np.int32)
            cols = [*(batch.column(c) for c in ("file", "pos", "id")), pa.array([d for d, _, _ in found], pa.int64()), pa.array([_bits(a) for _, _, a in found], pa.int64()), pa.array([len(s) for _, s, _ in found], pa.int32()), pa.array([parity(s) for _, s, _ in found], pa.binary())]
            none = len(found)
            cols += [pa.nulls(none, pa.list_(pa.int64())), pa.nulls(none, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=NAMES)
            last = [pa.nulls(1, c.type) for c in cols[:-2]] + [pa.array([often], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(last, names=NAMES)

    return src.mapInArrow(run, "file long, pos long, id long, fp long, sim long, n int, map binary, often array<long>, times array<int>")


NAMES = ["file", "pos", "id", "fp", "sim", "n", "map", "often", "times"]


def recurring(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``COMMON`` shingles that recur most in all texts, sorted, and their counts (from slices in which they recur)."""
    found = rows.where("file is null").selectExpr("inline(arrays_zip(often, times))").groupBy("often").agg(F.sum("times").alias("n"))
    got = found.orderBy(F.desc("n"), "often").limit(COMMON).toArrow()
    s, n = got["often"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def prefixes(docs: DataFrame, often: np.ndarray, times: np.ndarray, buckets: int, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(bucket, s, fp, n, at): prefix shingles of the sets with their digest, size and place in the order, packed as lists by bucket.

    Shingles go by their hash to one of ``buckets``; those that recur very often go by the set's digest to the same number of further ones.
    """
    hot = often[times > FEW * 64]
    names = ["bucket", "s", "fp", "n", "at"]

    def run(batches):
        seen: set = set()
        for batch in common.sliced(batches, "__text", SLICE):
            cols = [[np.zeros(0, np.int64)] for _ in range(4)]
            for d, s, _ in _sets(batch.column("__text"), words):
                n = len(s)
                if not n or d in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(d)
                k = n - (4 * n + 4) // 5 + 1
                rank = np.zeros(n, np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    rank = np.where(often[at] == s, times[at], 0)
                s = s[np.argsort(rank, kind="stable")[:k]]
                for col, x in zip(cols, (s.view(np.int64), np.full(k, d), np.full(k, n), np.arange(k)), strict=True):
                    col.append(x)
            s, d, n, at = map(np.concatenate, cols)
            if not len(s):
                continue
            bucket = (s.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)
            bucket = np.where(np.isin(s.view(np.uint64), hot), (d.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets) + np.uint64(buckets), bucket).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
            ends = pa.array(np.append(cuts, len(s)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (s, d, n.astype(np.int32), at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts].astype(np.int32)), *lists], names=names)

    return docs.select(docs[text_col].alias("__text")).mapInArrow(run, "bucket int, s array<long>, fp array<long>, n array<int>, at array<int>")


def _reach(n_i, n_j, at_i, at_j) -> np.ndarray:
    """Whether two sets may reach 4/5: they have at most the shingles up to these places in common, and those after them in both."""
    most = np.minimum(at_i, at_j) + np.minimum(n_i - at_i, n_j - at_j)
    return 9 * most >= 4 * (n_i + n_j)


def _shared(batches, buckets: int):
    """Of each bucket: pairs (a, b) of sets that share a shingle which few sets have, and the entries of shingles that more sets have."""
    names = ["a", "b", "s", "n", "at"]
    for got in common.grouped(batches, "bucket"):
        s, fp, n, at = (got[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("s", "fp", "n", "at"))
        which = np.repeat(got["bucket"].to_numpy(), pc.list_value_length(got["s"]).to_numpy())
        order = np.lexsort((fp, s))
        s, fp, n, at, which = s[order], fp[order], n[order].astype(np.int64), at[order].astype(np.int64), which[order]
        keep = np.r_[True, (s[1:] != s[:-1]) | (fp[1:] != fp[:-1])] if len(s) else np.zeros(0, bool)
        s, fp, n, at, which = (x[keep] for x in (s, fp, n, at, which))
        cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True]) if len(s) else np.zeros(1, np.int64)
        size = np.diff(cuts)
        each = np.repeat(size, size)
        few, many = (each > 1) & (each <= FEW) & (which < buckets), (each > FEW) | (which >= buckets)
        run = np.repeat(np.arange(len(size)), size)[few]
        for i, j in common.run_pairs(run, PAIRS):
            x, y = np.flatnonzero(few)[i], np.flatnonzero(few)[j]
            ok = _reach(n[x], n[y], at[x], at[y])
            ends = np.unique(np.stack([np.minimum(fp[x[ok]], fp[y[ok]]), np.maximum(fp[x[ok]], fp[y[ok]])], axis=1), axis=0)
            none = pa.nulls(len(ends), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), none, none, none], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(fp[many]), pa.nulls(int(many.sum()), pa.int64()), *(pa.array(x[many]) for x in (s, n, at))], names=names)


def _united(up: list[int], k: int) -> int:
    """The root of node ``k``; ``up`` leads there and is made shorter on the way."""
    while up[k] != k:
        up[k] = up[up[k]]
        k = up[k]
    return k


def _paired(batches, joined: bool):
    """A forest (a, b) of the pairs of sets of different components with a common prefix shingle that may reach 4/5.

    Rows are sorted, of ``common.blocked_groups``. Places in the order, sizes and parity maps (first on their shortest form, all pairs
    at once) rule pairs out. Of the rest those are rows, least differing first, that unite two trees: with ``joined`` the components are
    nodes, else the sets are, and then the two sets of every pair that may reach 4/5 are in one tree.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for got in common.grouped(batches, "grp"):
        cols = {c: got[c].to_numpy() for c in ("grp", "s", "lo", "hi", "blk", "root", "fp", "n", "at")}
        change = np.zeros(len(got) - 1, bool)
        for c in ("grp", "s", "lo", "hi"):
            change |= cols[c][1:] != cols[c][:-1]
        other = change | (cols["root"][1:] != cols["root"][:-1])
        cuts, parts = np.flatnonzero(np.r_[True, change, True]), np.flatnonzero(np.r_[True, other, True])
        # each row is paired with the rows of its shingle after those of its own component
        first, last = np.repeat(parts[1:], np.diff(parts)), np.repeat(cuts[1:], np.diff(cuts))
        n, at, fp, blk, across = cols["n"], cols["at"], cols["fp"], cols["blk"], cols["lo"] != cols["hi"]
        names, node = np.unique(cols["root"] if joined else fp, return_inverse=True)
        up = list(range(len(names)))
        maps = got["map"].to_pylist()
        short = np.frombuffer(b"".join(folded(m, PARITY) for m in maps), np.uint64).reshape(len(maps), -1)
        many = last - first
        total = np.cumsum(many)
        start = 0
        while start < len(many):
            stop = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, side="right")), start + 1)
            i, j = np.repeat(np.arange(start, stop), many[start:stop]), common.ragged(first[start:stop], many[start:stop])
            start = stop
            above = np.array([_united(up, k) for k in range(len(up))])[node]
            ok = (above[i] != above[j]) & _reach(n[i], n[j], at[i], at[j]) & (~across[i] | (blk[i] != blk[j])) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            differ = np.bitwise_count(short[i] ^ short[j]).sum(axis=1, dtype=np.int64)
            ok = 9 * differ <= n[i] + n[j]
            i, j, differ = i[ok], j[ok], differ[ok]
            order = np.argsort(differ, kind="stable")
            i, j = i[order], j[order]
            if joined and len(i):
                once = np.sort(np.unique(np.minimum(above[i], above[j]) * len(up) + np.maximum(above[i], above[j]), return_index=True)[1])
                i, j = i[once], j[once]
            ends = []
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                p, q = _united(up, node[x]), _united(up, node[y])
                if p != q and 9 * least_differing(maps[x], maps[y]) <= n[x] + n[y]:
                    up[max(p, q)] = min(p, q)
                    ends.append((x, y))
            a, b = fp[[x for x, _ in ends]], fp[[y for _, y in ends]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)


def _folded(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array([folded(m, FOLDED) for m in batch.column("map").to_pylist()], pa.binary())], names=["fp", "map"])


def pruned(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and parity maps do not rule out."""
    own = classes.selectExpr("fp", "n", "map")
    both = common.beside(pairs, own.toDF("a", "n_a", "map_a"), "a").select("a", "b", "n_a", "map_a")
    both = common.beside(both, own.toDF("b", "n_b", "map_b"), "b")

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            differ = np.fromiter(map(least_differing, batch.column("map_a").to_pylist(), batch.column("map_b").to_pylist()), np.int64, batch.num_rows)
            ok = (9 * differ <= n + m) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long")


def _packed(shingles: np.ndarray) -> bytes:
    """The upper 48 bits of each hash of a sorted set: enough to compare two sets, and a quarter less to move."""
    return (shingles >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _similar(sets: pa.Table, pairs: pa.Table) -> pa.Table:
    """The pairs of one cell with a similarity of at least 4/5."""
    held = {f: _unpacked(s) for f, s in zip(sets["fp"].to_pylist(), sets["set"].to_pylist(), strict=True)}
    keep = np.zeros(pairs.num_rows, bool)
    for k, (a, b) in enumerate(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)):
        x, y = held[a], held[b]
        keep[k] = 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))
    return pairs.select(["a", "b"]).filter(pa.array(keep))


def _made(places: DataFrame, docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(fp, set) made from the texts of the rows of ``docs`` at ``places`` (file, pos) and, as a map of bits tells which, a few more."""
    spark = docs.sparkSession
    places = places.selectExpr(f"xxhash64(file, pos) & {WANTED - 1}L as x")
    words_of = places.selectExpr("shiftright(x, 6) as w", "shiftleft(1L, cast(x & 63 as int)) as v").groupBy("w").agg(F.expr("bit_or(v)").alias("v")).toArrow()
    wanted = np.zeros(WANTED >> 6, np.uint64)
    wanted[words_of["w"].to_numpy()] = words_of["v"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(wanted)  # 4 MB, whatever the data

    def run(batches):
        for batch in batches:
            x = batch.column("x").to_numpy()
            batch = batch.filter(pa.array((shared.value[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for part in common.sliced([batch], "__text", SLICE):
                found = [(d, _packed(s)) for d, s, _ in _sets(part.column("__text"), words)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["fp", "set"])

    return docs.selectExpr(f"xxhash64(__file, __pos) & {WANTED - 1}L as x", f"`{text_col}` as __text").mapInArrow(run, "fp long, set binary")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (a written table) with a Jaccard similarity of at least 4/5, written.

    Only the texts of one row of each class in a pair are made sets again; a map of bits of bounded size tells which. Pairs meet
    their sets in cells: the components of the pairs, several small ones in a cell, large ones in blocks, so that a set moves once
    for each cell with a pair of it and a cell holds about ``CELL`` bytes.
    """
    spark = docs.sparkSession
    parts = common.components(pairs, "shingle-cells").toDF("fp", "root")
    parts = common.written(common.beside(parts, classes.select("fp", "n", "file", "pos"), "fp"), "shingle-cells")
    sizes = parts.groupBy("root").agg(F.sum(F.col("n") * 6).alias("__bytes")).selectExpr("root", f"cast(__bytes div {CELL} as int) as last")
    total = parts.agg(F.sum(F.col("n") * 6)).first()[0] or 0
    cells = max(1, -(-total // CELL))
    ends = common.beside(parts.select("fp", "root"), sizes, "root").selectExpr("fp", "root", "last", "cast(pmod(xxhash64(fp), last + 1) as int) as blk")
    keyed = pairs.join(ends.toDF("a", "root", "last", "x"), "a").join(ends.select("fp", "blk").toDF("b", "y"), "b")
    keyed = common.written(keyed.selectExpr("a", "b", f"if(last = 0, pmod(xxhash64(root), {cells}), xxhash64(root, least(x, y), greatest(x, y))) as cell"), "shingle-keyed")
    sets = _made(parts, docs, text_col, words)
    needed = keyed.selectExpr("cell", "explode(array(a, b)) as fp").distinct()
    moved = needed.join(sets, "fp")
    out = common.written(moved.groupBy("cell").cogroup(keyed.toDF("a", "b", "of").groupBy("of")).applyInArrow(_similar, "a long, b long"), "shingle-links")
    common.dropped(spark, parts)
    common.dropped(spark, keyed)
    return out


def _joining(cell: pa.Table) -> pa.Table:
    """Of the sets of one cell: pairs with a similarity of at least 4/5 that join what all such pairs of a part join.

    Sets that are in one component already, by ``known`` or by pairs found here, are not compared; in a part of two blocks only sets of
    different blocks are. Each set meets the one that differs least of every other component first, then all others at once.
    """
    key = np.stack([cell[c].to_numpy() for c in ("part", "lo", "hi", "fp")])
    order = np.lexsort(key[::-1])
    key = key[:, order]
    order, key = order[np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]], key[:, np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]]
    cuts = np.flatnonzero(np.r_[True, (key[:3, 1:] != key[:3, :-1]).any(axis=0), True])
    known, blk, sets = cell["known"].to_numpy(), cell["blk"].to_numpy(), cell["set"].combine_chunks()
    out = []
    for u, v in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = [_unpacked(sets[k].as_py()) for k in order[u:v].tolist()]
        n = np.array([len(x) for x in own])
        flat, at = np.concatenate(own), np.cumsum(n) - n
        bits = max(PARITY, 1 << int(n.max()).bit_length())
        maps = np.frombuffer(b"".join(parity(x, bits) for x in own), np.uint64).reshape(len(own), -1)
        label, side = np.unique(known[order[u:v]], return_inverse=True)[1], blk[order[u:v]]
        lo, hi = key[1, u], key[2, u]
        for i in range(v - u) if lo == hi else np.flatnonzero(side == lo).tolist():
            ok = (label != label[i]) & (5 * np.minimum(n, n[i]) >= 4 * np.maximum(n, n[i]))
            if lo == hi:
                ok[: i + 1] = False
            else:
                ok &= side == hi
            j = np.flatnonzero(ok)
            differ = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64)
            ok = 9 * differ <= n[j] + n[i]
            j = j[ok][np.argsort(differ[ok], kind="stable")]
            first = np.zeros(len(j), bool)
            first[np.unique(label[j], return_index=True)[1]] = True
            for which in (j[first], j[~first]):
                which = which[label[which] != label[i]]
                for part in np.split(which, np.flatnonzero(np.diff(np.cumsum(n[which]) // AT_ONCE)) + 1):
                    x = flat[common.ragged(at[part], n[part])]
                    hit = own[i][np.minimum(np.searchsorted(own[i], x), n[i] - 1)] == x
                    both = common.row_sums(hit, np.concatenate([[0], np.cumsum(n[part])]))
                    for k in part[9 * both >= 4 * (n[part] + n[i])].tolist():
                        if label[k] != label[i]:
                            label[label == label[k]] = label[i]
                            out.append((key[3, u + i], key[3, u + k]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def settled(forest: DataFrame, known: DataFrame, classes: DataFrame, docs: DataFrame, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Pairs (a, b) that join what all pairs with a similarity of at least 4/5 join within the trees of ``forest`` (written), written.

    Sets with the same root in ``known`` (fp, root) are joined already. Small trees share a cell; a tree of over ``CELL`` bytes is cut
    into blocks whose pairs are cells, so that no two of its sets are missed and no cell holds more than two blocks.
    """
    spark = docs.sparkSession
    parts = common.components(forest, "shingle-trees").toDF("fp", "part")
    parts = common.beside(parts, classes.select("fp", "n", "file", "pos"), "fp").join(known.toDF("fp", "known"), "fp", "left")
    parts = common.written(parts.selectExpr("fp", "part", "n", "file", "pos", "coalesce(known, fp) as known"), "shingle-trees")
    size = F.sum(F.col("n").cast("long") * 6 + EACH)
    sizes = parts.groupBy("part").agg(size.alias("__bytes")).selectExpr("part", f"cast(__bytes div {CELL} as int) as last")
    cells = max(1, -(-(parts.agg(size).first()[0] or 0) // CELL))
    dealt = common.beside(parts.select("fp", "part", "known"), sizes, "part").selectExpr("*", "cast(pmod(xxhash64(fp), last + 1) as int) as blk", "explode(sequence(0, last)) as other")
    dealt = dealt.selectExpr("fp", "part", "known", "blk", "last", "least(blk, other) as lo", "greatest(blk, other) as hi")
    dealt = dealt.selectExpr("fp", "part", "known", "cast(blk as long) as blk", "cast(lo as long) as lo", "cast(hi as long) as hi", f"if(last = 0, pmod(xxhash64(part), {cells}L), xxhash64(part, lo, hi)) as cell")
    moved = dealt.join(_made(parts, docs, text_col, words), "fp")
    out = common.written(moved.groupBy("cell").applyInArrow(_joining, "a long, b long"), "shingle-links")
    common.dropped(spark, parts)
    return out


def links(rows: DataFrame, docs: DataFrame, text_col: str = "text", words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of "Jaccard similarity of at least 4/5", for the sets of ``docs``.

    ``rows`` is what ``classified`` gives, written. Pairs that verified links have joined already are not looked at again; so a
    large group of near copies costs no square.
    """
    spark = docs.sparkSession
    places = rows.where("file is not null")
    classes = common.written(places.groupBy("fp").agg(F.min(F.struct("file", "pos")).alias("p"), F.first("sim").alias("sim"), F.first("n").alias("n"), F.first("map").alias("map")).selectExpr("fp", "sim", "n", "map", "p.file", "p.pos"), "shingle-classes")
    # classes with close fingerprints, by the Gray-order index
    heads = classes.groupBy("sim").agg(F.min("fp").alias("head"))
    near = simhash.links(heads.selectExpr("sim as fp"), DISTANCE, direct=True).distinct()
    near = near.join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").selectExpr("x as a", "y as b")
    same = common.beside(classes.select("sim", "fp"), heads, "sim").where("fp <> head").selectExpr("fp as a", "head as b")
    likely = common.written(pruned(near.unionByName(same), classes), "shingle-pairs")
    sure = verified(likely, classes, docs, text_col, words)
    roots = common.written(common.components(sure, "shingle-roots").toDF("fp", "root"), "shingle-roots")
    # the rest, by prefixes
    total = classes.agg(F.sum(F.expr("n div 5 + 1"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    often, times = recurring(rows)
    packed = prefixes(docs, often, times, buckets, text_col, words).repartition("bucket").sortWithinPartitions("bucket")
    found = common.written(packed.mapInArrow(lambda it: _shared(it, buckets), "a long, b long, s long, n long, at long"), "shingle-shared")
    small = classes.select("fp", "map").mapInArrow(_folded, "fp long, map binary")
    entries = _apart(found.where("s is not null").selectExpr("a as fp", "s", "n", "at"), roots)
    entries = common.written(common.beside(entries, small, "fp"), "shingle-entries")
    pairs = found.where("s is null").select("a", "b").unionByName(_forest(entries, True, block)).distinct()
    pairs = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    left = common.written(pruned(pairs, classes), "shingle-pairs")
    rest = common.written(sure.unionByName(verified(left, classes, docs, text_col, words)), "shingle-links")
    # what these links have not joined: all pairs within the trees of sets that may be similar
    known = common.written(common.components(rest, "shingle-roots").toDF("fp", "root"), "shingle-roots")
    trees = common.written(_forest(_apart(entries.drop("root"), known), False, block), "shingle-trees")
    last = settled(trees, known, classes, docs, text_col, words)
    out = common.written(rest.unionByName(last), "shingle-links")
    for table in (likely, sure, rest, last, roots, known, found, entries, left, trees, classes):
        common.dropped(spark, table)
    return out


def _apart(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries (with the root of their set) of shingles that sets of several components have."""
    entries = entries.join(roots, "fp", "left").withColumn("root", F.expr("coalesce(root, fp)"))
    mixed = entries.groupBy("s").agg(F.min("root").alias("__lo"), F.max("root").alias("__hi")).where("__lo <> __hi").select("s")
    return common.beside(entries, mixed, "s")


def _forest(entries: DataFrame, joined: bool, block: int) -> DataFrame:
    """(a, b) of ``_paired`` for ``entries``, dealt by shingle and block pair."""
    spread = common.blocked_groups(entries, ["s"], "fp", block).repartition("grp").sortWithinPartitions("grp", "s", "lo", "hi", "root", "fp")
    return spread.select("grp", "s", "lo", "hi", "blk", "root", "fp", "n", "at", "map").mapInArrow(lambda it: _paired(it, joined), "a long, b long")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near duplicates: the one with the smallest id.

    Texts without words are equal. Of several rows with that id and set (repeated rows) one stays. Columns are those of ``docs``;
    an empty table stays empty. Texts are not moved unless over ``FEW_PLACES`` rows go.
    """
    names = docs.columns
    docs = common.placed(common.of_texts(docs), "shingle-docs")
    rows = common.written(classified(docs, id_col, text_col, words), "shingle-rows")
    places = rows.where("file is not null")
    groups = simhash.near_duplicates(places.select("id", "fp"), id_col="id", edges=links(rows, docs, text_col, words, block))
    stay = groups.selectExpr("component_id as __id", "rep_fp as __fp").distinct()
    heads = places.join(stay, F.col("id").eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("__fp")), "left_semi")
    heads = heads.groupBy("id", "fp").agg(F.min(F.struct("file", "pos")).alias("p")).selectExpr("p.file as __file", "p.pos as __pos")
    gone = places.selectExpr("file as __file", "pos as __pos").join(heads, ["__file", "__pos"], "left_anti")
    gone = common.written(gone, "shingle-gone")
    few = gone.count() <= FEW_PLACES
    return docs.join(F.broadcast(gone) if few else gone, ["__file", "__pos"], "left_anti").select(*names)
