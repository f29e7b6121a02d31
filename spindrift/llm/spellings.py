"""Groups of spelling variants: words one code point apart, found by pivotal grams.

Two words are near if one inserted, deleted or replaced code point turns one into the other. The bigrams of a word in a global
order, rarest first and of equal ones the first in the word, begin with its prefix: three bigrams, of which two are disjoint
whatever they are. Two disjoint ones with the least total frequency are its pivots, chosen by dynamic programming. One edit cannot
touch both, and of two near words the one whose prefix ends earlier in that order has a pivot that the other's prefix holds as well.
(An edit moves what is behind it by one place, so a prefix that ends with a bigram also holds the same one a place later.)

So pivots are looked up among prefixes, with position limits: an untouched pivot has the edit on one side, so on its other side
both words are equal up to their end. It stands equally far from that end, and words differ by one in length at most. The key of the
index is the word from that end to the bigram and the length of the word looked for; where that is less than half of the word, half
of the rest is equal too, and part of the key. So keys hold half of a word at least. Pairs with a common key are verified letter by letter.

Words are counted in each task before they are shuffled; a variant's form and root come from partial aggregates and salted joins, so
a word that many others resemble is no task of its own.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Letters of a word and its occurrences, at least; times that a form is as frequent as its variant.
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: Edits between near words, letters of a gram, bigrams told apart (by the low bytes of both code points).
EDITS, GRAM, GRAMS = 1, 2, 1 << 16
#: Bytes of two words together up to which the built-in edit distance compares them.
SHORT = 200
#: Different words that a task counts before it hands them on.
HELD = 1 << 17

#: Each byte of Latin-1 as a small letter (only A-Z are lowered), or a blank if it isn't in A-Z, a-z or U+00C0 to U+00FF.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, rewrite=None) -> DataFrame:
    """(word, n): occurrences of the runs of A-Z, a-z and U+00C0 to U+00FF in all texts, A-Z lowered, with ``least_letters`` or more.

    ``rewrite`` may replace a run: (id, lower-cased run in Latin-1) to such a word. Null and empty texts have no words; repeated rows
    count each; an empty table gives no rows.
    """
    src = common.of_texts(docs).select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def told(total):
        words = [w.decode("latin-1") for w in total]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for own, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                found = Counter((text.as_py() or "").encode("latin-1", "replace").translate(LETTERS).split())
                for w, c in found.items():
                    if len(w) >= least_letters:
                        w = rewrite(own, w) if rewrite else w
                        if len(w) >= least_letters:
                            total[w] += c
                if len(total) > HELD:
                    yield told(total)
                    total.clear()
        if total:
            yield told(total)

    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _grams(words: list[str]):
    """(word number, position, gram) of every bigram, and the lengths of the words."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    many = np.maximum(size - GRAM + 1, 0)
    at = common.ragged(np.cumsum(size) - size, many)
    return np.repeat(np.arange(len(words)), many), common.ragged(np.zeros(len(words), np.int64), many), (points[at] & 255) << 8 | points[np.minimum(at + 1, len(points) - 1)] & 255, size


def gram_counts(vocabulary: DataFrame, word_col: str = "word") -> np.ndarray:
    """Occurrences of each bigram in the vocabulary: 65,536 sums, whatever its size."""

    def run(batches):
        total = np.zeros(GRAMS, np.int64)
        for batch in batches:
            total += np.bincount(_grams(batch.column(0).to_pylist())[2], minlength=GRAMS)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["g", "c"])

    found = vocabulary.select(word_col).mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).collect()
    out = np.zeros(GRAMS, np.int64)
    for r in found:
        out[r["g"]] = r["c"]
    return out


def pivots(position: np.ndarray, weight: np.ndarray, many: int = EDITS + 1) -> np.ndarray:
    """For each row the ``many`` disjoint grams of least total weight, as a mask; positions rise along a row.

    best[k][j]: least weight of k + 1 disjoint grams of which the last is j.
    """
    rows, width = position.shape
    best, came = [weight.astype(np.float64)], []
    for _ in range(1, many):
        now, back = np.full((rows, width), np.inf), np.zeros((rows, width), np.int64)
        for j in range(1, width):
            cost = np.where(position[:, j : j + 1] - position[:, :j] >= GRAM, best[-1][:, :j], np.inf)
            back[:, j] = cost.argmin(axis=1)
            now[:, j] = weight[:, j] + cost.min(axis=1)
        best.append(now)
        came.append(back)
    mask, row, at = np.zeros((rows, width), bool), np.arange(rows), best[-1].argmin(axis=1)
    mask[row, at] = True
    for back in reversed(came):
        at = back[row, at]
        mask[row, at] = True
    return mask


def _index(batches, rank: np.ndarray, count: np.ndarray):
    """Rows of the index: (word, size, is_pivot, last, place) for prefix grams and pivots."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        if not words:
            continue
        word, place, gram, size = _grams(words)
        order = np.lexsort((place, rank[gram], word))
        word, place, gram = word[order], place[order], gram[order]
        begin = np.searchsorted(word, np.arange(len(words)))
        width = GRAM * EDITS + 1
        first = begin[:, None] + np.arange(width)
        last = rank[gram[first[:, -1]]] << 32 | place[first[:, -1]]
        prefix = np.flatnonzero((rank[gram] << 32 | np.maximum(place - EDITS, 0)) <= last[word])
        by_place = np.argsort(place[first], axis=1)
        first = np.take_along_axis(first, by_place, axis=1)
        chosen = first[pivots(place[first], count[gram[first]])]
        at = np.r_[prefix, chosen]
        is_pivot = np.r_[np.zeros(len(prefix), bool), np.ones(len(chosen), bool)]
        own = word[at]
        yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(own)), pa.array(size[own].astype(np.int32)), pa.array(is_pivot), pa.array(last[own]), pa.array(place[at].astype(np.int32))], names=["word", "size", "is_pivot", "last", "place"])


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns one word into the other; in linear time."""
    if len(a) > len(b):
        a, b = b, a
    low, high = 0, len(a)
    while low < high:  # the length of what both begin with
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return a != b and len(b) - len(a) <= 1 and a[low + (len(a) == len(b)) :] == b[low + 1 :]


def _verified(batches):
    for batch in batches:
        yield batch.filter(pa.array([one_apart(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)], pa.bool_()))


def _keys(other: str, place: str, mirrored: str, size: str) -> str:
    """SQL of a word's keys for one gram; the word looked for, or the word itself, has ``other`` letters, and in it the gram stands at ``place`` (from ``mirrored`` if the end is untouched).

    If what is equal is less than half of that word, so is half of the rest, on the near or on the far side of the edit: each is a key.
    """
    head = lambda n: f"substring(word, 1, {n})"
    tail = lambda n: f"substring(word, {size} - ({n}) + 1)"
    p, q = f"({place} + {GRAM})", f"({other} - {mirrored})"  # letters of the untouched beginning, of the untouched end
    c, d = f"({p} + ({other} - {p}) div 2)", f"({mirrored} div 2)"
    first = f"if(2 * {p} >= {other}, xxhash64(0, {head(p)}, {other}), xxhash64(1, {head(c)}, {other})), if(2 * {p} >= {other}, null, xxhash64(2, {head(p)}, {tail(f'{other} - {c}')}, {other}))"
    last = f"if(2 * {q} >= {other}, xxhash64(3, {tail(q)}, {other}), xxhash64(4, {head(d)}, {tail(q)}, {other})), if(2 * {q} >= {other}, null, xxhash64(5, {tail(f'{other} - {d}')}, {other}))"
    return f"array_compact(if({mirrored} < 0, array({first}), array({first}, {last})))"


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, na, b, nb), a < b: every pair of words of ``vocabulary(word, n)`` that one edit turns into each other, once.

    Words have four code points or more and differ from each other.
    """
    count = gram_counts(vocabulary)
    rank = np.empty(GRAMS, np.int64)
    rank[np.lexsort((np.arange(GRAMS), count))] = np.arange(GRAMS)
    rows = common.written(vocabulary.mapInArrow(lambda it: _index(it, rank, count), "word string, size int, is_pivot boolean, last long, place int"), "spelling-grams")
    prefixes = rows.where("not is_pivot").selectExpr("word as b", "last as lb", f"explode({_keys('size', 'place', 'place', 'size')}) as key")
    looked = rows.where("is_pivot").selectExpr("word", "last", "size", "place", f"explode(sequence(size - {EDITS}, size + {EDITS})) as other")
    looked = looked.selectExpr("word as a", "last as la", f"explode({_keys('other', 'place', '(other - size + place)', 'size')}) as key")
    # short words by the built-in distance, long ones (quadratic there) and what is left letter by letter
    same = f"la <= lb and a <> b and if(octet_length(a) + octet_length(b) <= {SHORT}, levenshtein(a, b, {EDITS}) = {EDITS}, true)"
    met = looked.join(prefixes, "key").where(same).selectExpr("least(a, b) as a", "greatest(a, b) as b")
    pairs = met.mapInArrow(_verified, met.schema).distinct()
    own = vocabulary.select("word", "n")
    return pairs.join(own.toDF("a", "na"), "a").join(own.toDF("b", "nb"), "b").select("a", "na", "b", "nb")


def variants(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocabulary(word, n)``, whose words differ and have four code points or more.

    ``form`` is the near word with the largest n (ties: the smallest word) if that is ``times`` the word's n or more, else null;
    ``root`` is where the forms lead, the word itself without a form; ``n_near`` counts near words. Each form is more frequent than
    its variant, so forms end. An empty vocabulary gives no rows.
    """
    vocabulary = common.written(vocabulary.select("word", "n"), "spelling-words")
    pairs = common.written(near_pairs(vocabulary), "spelling-pairs")
    both = pairs.selectExpr("a as word", "na as own", "b as other", "nb as m").unionByName(pairs.selectExpr("b as word", "nb as own", "a as other", "na as m"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("own").alias("own"), F.min_by(F.struct("other", "m"), F.struct(-F.col("m"), F.col("other"))).alias("best"))
    near = common.written(near.selectExpr("word", "n_near", f"if(best.m >= {times} * own, best.other, null) as form", f"if(best.m >= {times} * own, best.m, null) as form_n"), "spelling-forms")
    roots = near.where("form is not null").selectExpr("word", "form as root")
    while True:  # each round doubles the forms that a root has followed
        step = common.written(common.beside(roots, roots.selectExpr("word as root", "root as next"), "root", how="left").selectExpr("word", "coalesce(next, root) as root", "next is not null as moved"), "spelling-roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    out = vocabulary.join(near, "word", "left").join(roots, "word", "left")
    return out.selectExpr("word", "form", "coalesce(root, word) as root", "n", "coalesce(n_near, 0L) as n_near", "form_n")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES, rewrite=None) -> DataFrame:
    """``variants`` of the words of all texts that have ``least_letters`` (4 or more) and occur ``least_count`` times or more."""
    if least_letters < GRAM * EDITS + 2:
        raise ValueError("words of fewer than four letters have too few bigrams")
    return variants(word_counts(docs, id_col, text_col, least_letters, rewrite).where(F.col("n") >= least_count), times)


def _misspelt(doc_id, run: bytes) -> bytes:
    """The contract's rewriting: of some runs one letter goes."""
    if doc_id is None:
        return run
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(f"{doc_id}:".encode()))
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: form, root and counts of every word of ``documents``. Null texts have no words, null ids leave words as they are; an empty table gives no rows."""
    return grouped(common.table(spark, sf_dir, "documents"), rewrite=_misspelt)
