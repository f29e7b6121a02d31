"""Language identification of mixed-language text.

Each word gets a score per language: the mean log-probability of its character n-grams under the language, learnt from labelled
rows. The scripts of a word narrow its candidates: languages whose training text hardly ever uses that script are out.
Viterbi over the words with a penalty for each switch then labels spans, so that a borrowed word stays in the span around it
and a real change of language starts a new one. The language with most letters is the document's.

The model is a table of fixed size (``BUCKETS`` hashed n-grams by language), gathered by Spark from a bounded, documented
sample of labelled rows (``TRAIN_ROWS``, those with the smallest hashes); predictions cover every word of every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled rows that the model is fitted on, at most about so many.
TRAIN_ROWS = 6000
BUCKETS, LONGEST = 1 << 16, 4
#: Log-probability that a change of language costs, and the most that one word can say.
SWITCH, MOST = 6.0, 4.0
#: Words in a block of the block-wise Viterbi; distinct words scored, and bytes of text labelled, at a time.
BLOCK, WORDS_AT_ONCE, SLICE = 64, 16_384, 2 << 20
#: Share of a language's letters that a script needs to have there for the language to be a candidate.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"

#: Script names and their main Unicode ranges; other letters count as the script "other".
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
SCRIPT_NAMES = [*SCRIPTS, "other"]


def _script_table() -> np.ndarray:
    """Script number of every code point (-1 where it isn't a letter)."""
    table = np.full(0x110000, -1, np.int8)
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    table[letters] = len(SCRIPTS)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            part = table[a : b + 1]
            part[part >= 0] = k
    return table


_tables: dict = {}


def script_table() -> np.ndarray:
    if "scripts" not in _tables:
        _tables["scripts"] = _script_table()
    return _tables["scripts"]


@dataclass
class Model:
    """Log-probabilities (bucket, language), languages in order and the scripts that each uses."""

    langs: list[str]
    weights: np.ndarray
    uses: np.ndarray


def normal_words(chunks: pa.Array) -> pa.Array:
    """Lower-case chunks without the marks around them."""
    return pc.utf8_trim(pc.utf8_lower(chunks), characters=".,;:!?*$&#%|\"'()[]{}<>=/\\@^_`~+-0123456789¿¡«»„“”‘’…–—")


def ngrams(words: list[str]):
    """(bucket of each n-gram, word of each n-gram, letters of each word, scripts (word, script) as letter counts)."""
    n = len(words)
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32)
    gap = points == 32
    word = np.cumsum(gap) - 1  # a gap belongs to the word after it
    script = script_table()[points]
    at = np.flatnonzero(script >= 0)
    scripts = np.bincount(word[at] * len(SCRIPT_NAMES) + script[at], minlength=n * len(SCRIPT_NAMES))[: n * len(SCRIPT_NAMES)].reshape(n, -1)
    buckets, owner = [], []
    code = np.zeros(len(points), np.uint64)
    shifted = points.astype(np.uint64)
    inside = np.cumsum(gap)
    for size in range(1, LONGEST + 1):
        m = len(points) - size + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(0x100000001B3) + shifted[size - 1 :][:m]
        # within one word, or with the gap before or after it as its end
        gaps = inside[size - 1 :][:m] - inside[:m] + gap[:m]
        ok = (gaps == 0) | (gaps == 1) & (gap[:m] | gap[size - 1 :][:m]) & (size > 1)
        mixed = (code + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
        where = np.flatnonzero(ok)
        buckets.append((mixed[where] >> np.uint64(48)).astype(np.int64) % BUCKETS)
        owner.append(word[where])
    letters = scripts.sum(axis=1)
    buckets, owner = np.concatenate(buckets), np.concatenate(owner)
    ok = (owner >= 0) & (owner < n)
    buckets, owner = buckets[ok], owner[ok]
    ok = letters[owner] > 0
    return buckets[ok], owner[ok], letters, scripts


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Fit the model on about ``rows`` rows of ``labelled`` with text and label, chosen by the hash of their id and text.

    The sample is the rows whose hash is at most the ``rows``-th smallest (copies of a row come whole, and count where they lie). What reaches the driver is
    a table of counts by bucket and language, of fixed size. No labelled rows: a model without languages.
    """
    usable = common.of_texts(labelled).select(F.xxhash64(id_col, text_col).alias("h"), labelled[text_col].alias("text"), labelled[lang_col].cast("string").alias("lang")).where("text is not null and lang is not null")
    cut = usable.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if cut is None:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))

    def count(batches):
        sums: dict = {}
        for batch in common.sliced(batches, "text", SLICE // 2):
            for lang in set(batch.column("lang").to_pylist()):
                own = batch.column("text").filter(pc.equal(batch.column("lang"), lang))
                _, index, distinct = common.text_chunks(own)
                buckets, owner, _, scripts = ngrams(normal_words(distinct).to_pylist())
                many = np.bincount(index, minlength=len(distinct))
                got = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES)))
                got[:BUCKETS] += np.bincount(buckets, weights=many[owner], minlength=BUCKETS)
                got[BUCKETS:] += many @ scripts
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(got[at])], names=["lang", "bucket", "n"])

    counted = usable.where(F.col("h") <= cut).select("text", "lang").mapInArrow(count, "lang string, bucket long, n double")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(found["lang"]))
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    counts[found["bucket"].to_numpy(), np.searchsorted(np.array(langs, object), found["lang"].to_numpy())] = found["n"].to_numpy()
    grams, scripts = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    weights = np.log(grams / grams.sum(axis=0))
    weights -= weights.mean(axis=1, keepdims=True)
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, weights.astype(np.float32), share >= SCRIPT_SHARE)


def word_scores(words: list[str], model: Model):
    """(scores (word, language) that add up along a text, letters of each word)."""
    if len(words) > WORDS_AT_ONCE:
        parts = [word_scores(words[at : at + WORDS_AT_ONCE], model) for at in range(0, len(words), WORDS_AT_ONCE)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    buckets, owner, letters, scripts = ngrams(words)
    n, k = len(words), len(model.langs)
    total = np.zeros((n, k))
    many = np.maximum(np.bincount(owner, minlength=n), 1)
    candidate = (scripts > 0).astype(np.float32) @ model.uses.astype(np.float32) >= (scripts > 0).sum(axis=1)[:, None]
    candidate |= ~candidate.any(axis=1)[:, None]  # no language uses all of these scripts: none is out
    for j in range(k):  # only n-grams of words that the scripts leave to the language
        at = slice(None) if candidate[:, j].all() else candidate[owner, j]
        total[:, j] = np.bincount(owner[at], weights=model.weights[buckets[at], j], minlength=n)
    total = np.clip(total / np.sqrt(many)[:, None], -MOST, MOST)
    total = np.where(candidate, total, -2 * MOST)
    total[letters == 0] = 0
    return total.astype(np.float32), letters


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word: highest sum of scores less ``switch`` for each change, per text; ties to the smaller label.

    Works by blocks of ``BLOCK`` words, all blocks at once: first each block's best gain from every entry to every exit label,
    then along each text's blocks, then inside all blocks again with their entries known.
    """
    n, k = scores.shape
    if not n or k < 2:
        return np.zeros(n, np.int64)
    words = np.diff(offsets)
    blocks = -(-words // BLOCK)
    first = np.cumsum(blocks) - blocks
    m = int(blocks.sum())
    if not m:
        return np.zeros(n, np.int64)
    text = np.repeat(np.arange(len(words)), blocks)
    nth = np.arange(m) - first[text]
    start = offsets[:-1][text] + nth * BLOCK
    size = np.minimum(BLOCK, words[text] - nth * BLOCK)
    at = start[:, None] + np.arange(BLOCK)[None, :]
    own = np.where((np.arange(BLOCK)[None, :] < size[:, None])[:, :, None], scores[np.minimum(at, n - 1)], np.float32(0)).astype(np.float64)  # m, BLOCK, k
    gain = np.where(np.eye(k, dtype=bool), 0.0, -switch)[None].repeat(m, 0)  # m, entry, exit
    for t in range(BLOCK):
        gain = np.maximum(gain, gain.max(axis=2, keepdims=True) - switch) + own[:, t, None, :]
    entry = np.zeros((m, k))  # best sum up to the block's beginning, by the label before it
    for j in range(1, int(blocks.max())):
        now = _blocks_at(first, blocks, j)
        entry[now] = (entry[now - 1][:, :, None] + gain[now - 1]).max(axis=1)
    small = np.int8 if k < 128 else np.int32
    best, back = entry, np.zeros((m, BLOCK, k), small)
    for t in range(BLOCK):
        top = best.argmax(axis=1)
        high = np.take_along_axis(best, top[:, None], 1) - switch
        moved = high > best
        back[:, t] = np.where(moved, top[:, None], np.arange(k)[None, :])
        best = np.maximum(best, high) + own[:, t]
    came = np.arange(k)[None].repeat(m, 0)  # label before the block, by label at its end
    for t in range(BLOCK - 1, -1, -1):
        came = np.take_along_axis(back[:, t], came, 1)
    at_end = best.argmax(axis=1)  # right for each text's last block; the others get theirs from the next block
    for j in range(int(blocks.max()) - 1, 0, -1):
        now = _blocks_at(first, blocks, j)
        at_end[now - 1] = came[now, at_end[now]]
    labels = np.zeros((m, BLOCK), small)
    for t in range(BLOCK - 1, -1, -1):
        labels[:, t] = at_end
        at_end = back[np.arange(m), t, at_end].astype(np.int64)
    return labels.reshape(-1)[(np.repeat(np.arange(m) * BLOCK, size) + common.ragged(np.zeros(m, np.int64), size))].astype(np.int64)


def _blocks_at(first: np.ndarray, blocks: np.ndarray, j: int) -> np.ndarray:
    """The j-th block of every text that has one."""
    return first[blocks > j] + j


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` and ``spans`` of every row.

    ``spans``: arrays of (first word, word after the last, language), words being white-space separated. ``score``: share of the
    text's letters that stand in spans of ``lang_pred``. Null texts, texts without letters and a model without languages give
    ``und`` with score 0; ties go to the first language in order. Repeated rows stay, an empty table gives no rows, and a kept
    column with the name of a result gives way to it.
    """
    spark = docs.sparkSession
    keep = common.others(keep, "lang_pred", "score", "spans")
    docs, text = common.texts_of(docs, keep, text_col)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    if spans:
        schema = schema.add("spans", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("lang", "string")))
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages floats, whatever the data

    def run(batches):
        common.own("language", dict)  # what other operators held in this worker goes
        model = shared.value
        k, names = len(model.langs), np.array([*model.langs, UNKNOWN], object)
        for batch in common.sliced(batches, text, SLICE):
            offsets, index, distinct = common.text_chunks(batch.column(text))
            scores, letters = word_scores(normal_words(distinct).to_pylist(), model)
            spoken = letters[index] > 0
            ends = np.concatenate([[0], np.cumsum(spoken)])[offsets]
            index = index[spoken]
            label = viterbi(scores[index], ends, switch) if k else np.zeros(len(index), np.int64)
            rows = batch.num_rows
            row = np.repeat(np.arange(rows), np.diff(ends))
            held = np.bincount(row * max(k, 1) + label, weights=letters[index], minlength=rows * max(k, 1)).reshape(rows, -1)
            total = held.sum(axis=1)
            best = np.where((total > 0) & (k > 0), held.argmax(axis=1), len(names) - 1)
            score = np.where(best < k, held.max(axis=1) / np.maximum(total, 1), 0.0)
            columns = [*(batch.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(score)]
            if spans:
                change = np.ones(len(label), bool)
                change[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
                begin = np.flatnonzero(change)
                stop = np.r_[begin[1:], len(label)]
                shift = ends[:-1][row[begin]] if len(begin) else begin
                kept = np.searchsorted(begin, ends).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array((begin - shift).astype(np.int32)), pa.array((stop - shift).astype(np.int32)), pa.array(names[label[begin]], pa.string())], names=["start", "end", "lang"])
                columns.append(pa.ListArray.from_arrays(pa.array(kept), parts))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Column: whether a row is kept from training (CRC-32 of the id as text, modulo 3, is 1; a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame) -> Model:
    """Model of the rows of ``docs`` that aren't held out."""
    return train(docs.where(~held_out()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: predicted language of every document, by a model of the documents that aren't held out."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs, fitted(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
