"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each document (good, bad or no vote). Expectation-maximisation over the counts of all
vote patterns in the whole corpus estimates each labeller's accuracy and the share of good documents, without any hand-made
label. The posterior of a sample of documents then trains a logistic regression over hashed word shapes, words and repeats,
and this scorer, not the labellers, decides about every document.

What reaches the driver: one count for each vote pattern (3 ** labellers at most) and the hashed features of a bounded,
documented sample (``TRAIN_ROWS``). Scoring reads whole texts in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows that the scorer is fitted on, at most: those with the smallest hashes of id and text.
TRAIN_ROWS = 4000
#: Hashed features, and iterations of both fits.
BUCKETS, EM_ROUNDS, FIT_ROUNDS = 1 << 14, 60, 150
#: Bytes of text handled at a time.
SLICE = 2 << 20
#: A document is rejected when its score, the probability of being good, is lower.
THRESHOLD = 0.3
#: Prior accuracy of a labeller, as pseudo-counts (right, wrong).
PRIOR = (8.0, 2.0)

#: The labellers. Each is (name, statistic, limit of a bad vote, limit of a good vote): at least the first limit
#: votes bad, at most the second (if there is one) votes good, else there is no vote. Each kind of junk is seen by two or more.
LABELLERS = [
    ("marked_words", "marked", 0.15, None),
    ("symbols", "symbols", 0.30, None),
    ("capital_words", "capital", 0.35, None),
    ("capital_letters", "upper", 0.50, None),
    ("bars", "bars", 0.08, None),
    ("no_letters", "bare", 0.15, None),
    ("doubled_words", "doubled", 0.25, None),
    ("few_distinct", "same", 0.55, None),
    ("odd_words", "odd", 0.40, 0.06),
    ("unfinished", "unended", 0.70, 0.30),
]


#: Marks around a word, within one of a script without spaces, and at the end of a sentence.
OPENS, CLOSES, INNER, ENDS = "\"'(\\[«“„¿¡「『（", ".,;:!?\"')\\]»”’…。、！？।॥؟،؛，；：」』）", "'’、。，！？；：「」『』（）・-", ".!?…。！？।॥؟"
SYMBOLS = "*$&#%|<>=_~^\\/+@!{}"
LETTER, UPPER, LOWER, SYMBOL = 1, 2, 4, 8


@lru_cache
def point_tables() -> tuple[np.ndarray, np.ndarray]:
    """(bits LETTER to SYMBOL, kind) of every code point; the kind is that of word shapes: A, a, 0 or the mark itself."""
    bits, kind = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            upper = c.isupper()
            bits[p], kind[p] = LETTER | (UPPER if upper else LOWER if c.islower() else 0), ord("A") if upper else ord("a")
        elif c.isdigit():
            kind[p] = ord("0")
    for c in SYMBOLS:
        bits[ord(c)] |= SYMBOL
    return bits, kind


def _hashes(units: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``units``; runs begin at ``starts``."""
    size = np.diff(np.append(starts, len(units)))
    place = np.arange(len(units)) - np.repeat(starts, size)
    power = np.uint64(0x9E3779B97F4A7C15) ** np.arange(int(size.max(initial=0)) + 1, dtype=np.uint64)
    mixed = np.add.reduceat((units.astype(np.uint64) + np.uint64(1)) * power[place], starts) if len(starts) else np.zeros(0, np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def traits(words: pa.Array, features: bool = False) -> dict[str, np.ndarray]:
    """What each of some different words without spaces shows by itself: flags and counts, and with ``features`` its hashed features.

    Features are a bucket of the word's whole shape (runs of letters, digits and marks, with their case) and one of its lower-case
    form. Everything is done on whole columns: in text with many rare words, a cache of words costs more than it saves.
    """
    points = np.frombuffer((" ".join(words.to_pylist()) + " ").encode("utf-32-le"), np.uint32)  # each word and the gap behind it
    starts = np.r_[0, np.flatnonzero(points == 32)[:-1] + 1] if len(words) else np.zeros(0, np.int64)
    table, kinds = point_tables()
    bits = table[points]
    count = lambda bit: np.add.reduceat(((bits & bit) > 0).astype(np.int32), starts) if len(starts) else np.zeros(0, np.int32)
    match = lambda pattern: pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)
    letters, upper, lower = count(LETTER), count(UPPER), count(LOWER)
    out = {
        "marked": match(r"[*$&#%!]{2,}$|[*$&#%]$"), "bars": match(r"^[|/\\<>=_~-]+$"), "ended": match(rf"[{ENDS}][{CLOSES}]*$"), "plain": match(rf"^[{OPENS}]*(\p{{L}}[\p{{Ll}}\p{{Lo}}\p{{Lm}}\p{{M}}{INNER}]*|[0-9][0-9.,:-]*)[{CLOSES}]*$"),
        "bare": letters == 0, "symbols": count(SYMBOL), "upper": upper, "letters": letters,
    }
    long = pc.greater(pc.utf8_length(pc.utf8_trim(words, characters=".,;:!?\"'()[]")), 1).to_numpy(zero_copy_only=False)
    out["capital"] = (upper > 0) & (lower == 0) & long
    if features:
        kind = kinds[points]
        first = np.zeros(len(points), bool)
        first[starts] = True
        kept = np.flatnonzero(first | np.r_[True, kind[1:] != kind[:-1]])
        half = np.uint64(BUCKETS // 2)
        shape = _hashes(kind[kept], np.searchsorted(kept, starts)) % half
        low = pc.utf8_lower(words)
        ends = np.frombuffer(low.buffers()[1], np.int32, len(low) + 1, low.offset * 4) if len(low) else np.zeros(1, np.int32)
        raw = np.append(np.frombuffer(low.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], 0)
        size = np.diff(ends)
        own = np.zeros(len(low), np.uint64)
        some = np.flatnonzero(size > 0)
        own[some] = _hashes(raw[:-1], (ends[:-1] - ends[0])[some].astype(np.int64))
        out["buckets"] = np.stack([shape, half + own % half], axis=1).astype(np.int32)
    return out


def stats_of_slice(texts: pa.Array, features: bool = False) -> dict[str, np.ndarray]:
    """Statistics of every text of a slice, as shares of its words; a text without words has ``words`` 0 and shares 0.

    With ``features`` also the hashed features of the distinct words.
    """
    offsets, index, distinct = common.text_chunks(texts)
    present = pc.greater(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)
    each = traits(distinct, features)
    keep = present[index]
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    index = index[keep]
    n = np.diff(ends)
    low = np.maximum(n, 1)
    sums = {name: common.row_sums(v.astype(np.int32)[index], ends) for name, v in each.items() if name != "buckets"}
    out = {"words": n, "ends": ends, "index": index, "buckets": each.get("buckets")}
    for name in ("marked", "capital", "bars", "bare", "symbols"):
        out[name] = sums[name] / low
    out["odd"] = np.where(n > 0, 1 - sums["plain"] / low, 0)
    out["upper"] = sums["upper"] / np.maximum(sums["letters"], 1)
    out["unended"] = np.clip(1 - 60 * sums["ended"] / low, 0, 1)
    lower = pc.utf8_lower(distinct).dictionary_encode()
    word = lower.indices.to_numpy(zero_copy_only=False).astype(np.int64)[index]
    row = np.repeat(np.arange(len(n)), n)
    twice = np.zeros(len(word), np.int64)
    twice[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    out["doubled"] = common.row_sums(twice, ends) / low
    pairs = np.unique(row * np.int64(len(lower.dictionary) + 1) + word)
    different = np.bincount(pairs // (len(lower.dictionary) + 1), minlength=len(n))
    expected = np.minimum(low, 60.0 * np.sqrt(low))  # long texts repeat their words anyway
    out["same"] = np.where(n > 0, 1 - np.minimum(1, different / expected), 0)
    return out


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """(document, labeller): 1 good, -1 bad, 0 no vote. A text without words gets bad votes only."""
    out = []
    for _, name, bad, good in LABELLERS:
        out.append(np.where(stats[name] >= bad, -1, np.where(stats[name] <= good, 1, 0) if good is not None else 0))
    return np.where(stats["words"][:, None] > 0, np.stack(out, axis=1), -1)


@dataclass
class LabelModel:
    """Share of good documents, and per labeller the chance of each vote (bad, none, good) given bad or good."""

    good: float
    chance: np.ndarray  # (labeller, class, vote)

    def posterior(self, ballots: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        logs = np.log(np.array([1 - self.good, self.good]))[None, :] + sum(np.log(self.chance[k][:, ballots[:, k] + 1]).T for k in range(ballots.shape[1]))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))

    def accuracy(self) -> np.ndarray:
        """Estimated share of right votes among each labeller's votes."""
        weight = np.array([1 - self.good, self.good])
        right = weight[0] * self.chance[:, 0, 0] + weight[1] * self.chance[:, 1, 2]
        voted = weight @ (self.chance[:, :, 0] + self.chance[:, :, 2]).T
        return right / np.maximum(voted, 1e-12)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    Starts from "a bad vote of any labeller is probably right": junk is of many kinds, each seen by few labellers. No
    documents: the starting values.
    """
    k = patterns.shape[1]
    bad = (patterns == -1).sum(axis=1)
    post = np.where(bad == 0, 0.97, np.where(bad == 1, 0.3, 0.03))
    if not len(patterns) or counts.sum() == 0:
        post, counts, patterns = np.array([0.03, 0.97]), np.array([1.0, 4.0]), np.array([[-1] * k, [1] * k])
    model = None
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        chance = np.zeros((k, 2, 3))
        for v in (-1, 0, 1):
            chance[:, :, v + 1] = ((patterns == v).T.astype(float)) @ weight.T
        # pseudo-counts in proportion to the corpus, so that the fit is the same at every size
        unit = 0.002 * counts.sum() / sum(PRIOR)
        chance[:, 0, 0] += PRIOR[0] * unit
        chance[:, 0, 2] += PRIOR[1] * unit
        chance[:, 1, 2] += PRIOR[0] * unit
        chance[:, 1, 0] += PRIOR[1] * unit * 0.1
        chance += 1e-6 * counts.sum()
        chance /= chance.sum(axis=2, keepdims=True)
        model = LabelModel(float(np.clip(weight[1].sum() / counts.sum(), 0.02, 0.98)), chance)
        post = model.posterior(patterns)
    return model


#: Features that aren't single words.
EXTRA = ["doubled", "marked", "capital", "bars", "symbols", "same", "unended", "bare", "odd", "upper"]


def extras(stats: dict[str, np.ndarray]) -> np.ndarray:
    """(document, extra feature)."""
    return np.stack([np.minimum(stats[k], 1.0) for k in EXTRA], axis=1)


def _sampled(docs: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(h, g, text) of the rows with the smallest hashes of id and text; more than ``rows`` only by copies with equal hashes."""
    hashed = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.xxhash64(text_col, id_col).alias("g"), docs[text_col].alias("text"))
    cut = hashed.select("h", "g").orderBy("h", "g").limit(rows).agg(F.max(F.struct("h", "g")).alias("m")).first()["m"]
    return hashed.where(F.struct("h", "g") <= F.struct(F.lit(cut["h"]), F.lit(cut["g"]))) if cut else hashed.limit(0)


@dataclass
class Scorer:
    """Linear scorer over hashed features."""

    weights: np.ndarray
    extra: np.ndarray
    bias: float

    def score(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        """Probability of good of every text of a slice; 0 for a text without words."""
        per_word = self.weights[stats["buckets"]].sum(axis=1)
        n = np.maximum(stats["words"], 1)
        z = self.bias + common.row_sums(per_word[stats["index"]], stats["ends"]) / n + extras(stats) @ self.extra
        return np.where(stats["words"] > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)


def count_patterns(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns of all documents and how many documents have each."""

    def run(batches):
        common.own("quality", dict)  # what other operators held in this worker goes
        sums: dict[bytes, int] = {}
        for batch in common.sliced(batches, "text", SLICE):
            got, many = np.unique(votes(stats_of_slice(batch.column("text"))), axis=0, return_counts=True)
            for p, n in zip(got.astype(np.int8), many.tolist(), strict=True):
                sums[p.tobytes()] = sums.get(p.tobytes(), 0) + n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()))], names=["pattern", "n"])

    found = common.of_texts(docs).select(docs[text_col].alias("text")).mapInArrow(run, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    patterns = np.array([np.frombuffer(bytes(p), np.int8) for p in found["pattern"]], np.int64).reshape(-1, len(LABELLERS))
    return patterns, found["n"].to_numpy(float)


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> tuple[LabelModel, Scorer]:
    """Fit the label model on all documents and the scorer on the posteriors of a sample of at most ``rows`` of them."""
    model = fit_labels(*count_patterns(docs, text_col))

    def run(batches):
        for batch in common.sliced(batches, "text", SLICE):
            stats = stats_of_slice(batch.column("text"), True)
            post = model.posterior(votes(stats))
            word = stats["buckets"][stats["index"]].astype(np.int64)
            row = np.repeat(np.arange(len(post)), stats["words"])
            rows_, cols, vals = [], [], []
            for k in (0, 1):
                key, many = np.unique(row * BUCKETS + word[:, k], return_counts=True)
                at = key // BUCKETS
                rows_.append(at)
                cols.append(key % BUCKETS)
                vals.append(many / stats["words"][at])
            at, col, val = map(np.concatenate, (rows_, cols, vals))
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(len(post) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("g"), pa.array(post), pa.ListArray.from_arrays(pa.array(ends), pa.array(col[order].astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(val[order].astype(np.float32))), pa.array(list(extras(stats)), pa.list_(pa.float64())), pa.array(stats["words"])],
                names=["h", "g", "post", "cols", "vals", "extra", "words"],
            )

    sample = _sampled(docs, id_col, text_col, rows)
    found = sample.mapInArrow(run, "h long, g long, post double, cols array<int>, vals array<float>, extra array<double>, words long").where("words > 0")
    got = found.orderBy("h", "g").limit(rows).toPandas()  # rows with equal hashes are copies of each other
    return model, fit_scorer(got)


def fit_scorer(got, rounds: int = FIT_ROUNDS) -> Scorer:
    """Logistic regression on posterior labels by full-batch accelerated gradient steps; always the same for the same rows."""
    d = BUCKETS
    if not len(got):
        return Scorer(np.zeros(d), np.zeros(len(EXTRA)), 0.0)
    y = got["post"].to_numpy(float)
    size = got["cols"].map(len).to_numpy()
    col, val = np.concatenate(got["cols"].to_list()).astype(np.int64), np.concatenate(got["vals"].to_list()).astype(float)
    row = np.repeat(np.arange(len(y)), size)
    x = np.stack(got["extra"].to_list())
    w, e, b = np.zeros(d), np.zeros(x.shape[1]), 0.0
    vw, ve, vb = w.copy(), e.copy(), 0.0
    class_weight = np.where(y >= 0.5, 0.5 / max((y >= 0.5).mean(), 0.05), 0.5 / max((y < 0.5).mean(), 0.05))
    step, decay = 2.0, 1e-4
    for t in range(rounds):
        z = vb + np.bincount(row, weights=vw[col] * val, minlength=len(y)) + x @ ve
        g = class_weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)
        nw = vw - step * (np.bincount(col, weights=g[row] * val, minlength=d) + decay * vw)
        ne, nb = ve - step * (g @ x + decay * ve), vb - step * g.sum()
        m = t / (t + 3)
        vw, ve, vb = nw + m * (nw - w), ne + m * (ne - e), nb + m * (nb - b)
        w, e, b = nw, ne, nb
    return Scorer(w, e, float(b))


def scored(docs: DataFrame, scorer: Scorer, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` and the probability of being good of every row (0 for null texts and texts without words).

    Repeated rows stay, an empty table gives no rows, and a kept column with the name of the result gives way to it.
    """
    keep = common.others(keep, name)
    docs, text = common.texts_of(docs, keep, text_col)
    schema = docs.select(*keep).schema.add(name, "double")
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # BUCKETS floats, whatever the data

    def run(batches):
        for batch in common.sliced(batches, text, SLICE):
            got = shared.value.score(stats_of_slice(batch.column(text), True))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(got, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: score and decision for every document."""
    docs = common.table(spark, sf_dir, "documents")
    _, scorer = train(docs)
    return scored(docs, scorer).selectExpr("doc_id", "score", f"score >= {THRESHOLD} as kept")
