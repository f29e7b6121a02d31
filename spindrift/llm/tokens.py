"""Token-ID output: documents as Parquet list columns of token ids, written in id order and read back selectively.

File format. One Parquet file for each range of document ids, rows in ascending id order, columns:
``doc_id`` and ``part_start``, ``n_tokens`` (longs, delta encoded), ``part`` (int) and ``ids`` (list of int, dictionary encoded
when the vocabulary fits the dictionary page, else delta encoded). Row groups hold about ``ROW_GROUP`` bytes, pages at most
``PAGE_ROWS`` rows; the writer adds column and offset indexes, so that a filter on ``doc_id`` reads only the pages it needs, and
a query on lengths or starts never reads the ids. ``part_start`` counts the ids before a document in its own file; the global
start is that plus the totals of the files before, one small row for each file.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END_ID = 2
TOKENIZER = "word_bpe_49k.json"
ROW_GROUP, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2000
#: Words that a Python worker keeps with their ids; beyond that it keeps those of its latest slice only, with the same results.
CACHE = 400_000
#: Bytes of text encoded at a time.
SLICE = 4 << 20
#: ASCII marks that a tokenizer of this kind separates from a letter or digit before them (the apostrophe is not one).
MARKS = '.,;:!?*$&#%|"()[]{}<>=/\\@^_`~+-'
#: Ends of words that marks are cut from, and those marks. U+0130 is not one: it is two characters in lower case.
CUTS, CUT_TAIL = r"[0-9A-Za-z\x{DF}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]$", "(?P<t>[" + re.escape(MARKS) + "]+)$"


class WordEncoder:
    """The tokenizers library behind a cache of words.

    These tokenizers drop white space and never join characters across it, so the ids of a text are those of its white-space
    separated chunks in order. A chunk ending in ASCII marks after a letter or digit is cut there too, which the pre-tokenizer does
    as well. The strings of special tokens, which hold no white space, become their ids wherever they stand, as in a plain call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.cache: dict[str, bytes] = {}
        words = self.tokenizer.get_vocab()
        self.last = np.zeros(max(words.values()) + 1, bool)  # ids that end a pre-token
        self.last[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def _encode_each(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 1000):
            own = parts[at : at + 1000]
            for word, got in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True):
                self.cache[word] = np.array(got.ids, np.int32).tobytes()

    def _encode_words(self, words: list[str]) -> None:
        """Words of letters, in one text: each should be one pre-token, so that the ends of pre-tokens are those of the words."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
        stops = (np.flatnonzero(self.last[ids]) + 1).tolist()
        if len(stops) != len(words):  # some letter isn't one any more in lower case
            self._encode_each(words)
            return
        raw = ids.tobytes()
        self.cache.update(zip(words, [raw[4 * a : 4 * b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))

    def encode_words(self, words: list[str]) -> pa.Array:
        """Ids of each of some different words, as little-endian 32-bit integers."""
        new = set(words).difference(self.cache)
        letters = [p for p in new if p.isalpha()]
        for at in range(0, len(letters), 1000):
            self._encode_words(letters[at : at + 1000])
        self._encode_each([p for p in new if not p.isalpha()])
        coded = list(map(self.cache.__getitem__, words))
        if len(self.cache) > CACHE:
            self.cache = dict(zip(words, coded, strict=True))
        return pa.array(coded, pa.binary())

    def encode_chunks(self, chunks: pa.Array) -> pa.Array:
        """Ids of each chunk, as little-endian 32-bit integers: those of its word and of the marks behind it."""
        stem = pc.utf8_rtrim(chunks, characters=MARKS)
        special = pc.match_substring(chunks, "<|")
        cut = pc.and_not(pc.match_substring_regex(stem, CUTS), special)
        stem = pc.if_else(cut, stem, chunks)
        tail = pc.if_else(cut, pc.fill_null(pc.struct_field(pc.extract_regex(chunks, CUT_TAIL), [0]), ""), "")
        small = pc.and_not(pc.string_is_ascii(stem), special)
        parts = [x.dictionary_encode() for x in (pc.if_else(small, pc.ascii_lower(stem), stem), tail)]
        ids = [self.encode_words(x.dictionary.to_pylist()).take(x.indices) for x in parts]
        return pc.binary_join_element_wise(*ids, b"")

    def encode_column(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of each text) with ``end_id`` after each text."""
        offsets, index, distinct = common.text_chunks(texts)
        coded = self.encode_chunks(distinct)
        if end_id is not None:  # as a chunk of its own behind each text
            index = np.insert(index, offsets[1:], len(coded))
            offsets = offsets + np.arange(len(offsets))
            coded = pa.concat_arrays([coded, pa.array([np.array([end_id], "<i4").tobytes()])])
        taken = coded.take(pa.array(index))
        ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)[offsets] // 4 if len(taken) else np.zeros(len(offsets), np.int64)
        return np.frombuffer(taken.buffers()[2] or b"", "<i4", int(ends[-1])), ends.astype(np.int64)


def encoder(path: str) -> WordEncoder:
    """This Python worker's encoder of a vocabulary file."""
    return common.own(f"tokens {path}", lambda: WordEncoder(path))


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> str:
    """Encode every text and write the token files below ``path``; returns ``path``.

    Null texts are empty (only the end id). Null ids come first, as the smallest. Rows with the same id follow each other in
    input order, and may be cut between two files. Texts of any length work, one at a time if need be. An empty table gives a
    table without rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row's place deals out ids that repeat (or are null) very often
    ranged = common.of_texts(docs).select(docs[id_col].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("__row"), docs[text_col].alias("__text"))
    ranged = ranged.repartitionByRange(n, "doc_id", "__row").sortWithinPartitions("doc_id", "__row").drop("__row")

    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        codec = encoder(tokenizer)
        for batch in common.sliced(batches, "__text", SLICE):
            flat, ends = codec.encode_column(batch.column("__text"), end_id)
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(ends) - 1, part, np.int32)), pa.array(start + ends[:-1]), pa.array(np.diff(ends)), ids],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            start += int(ends[-1])

    coded = ranged.mapInArrow(run, "doc_id long, part int, part_start long, n_tokens long, ids array<int>")
    writer = coded.write.option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd")
    for key, value in {"block.size": ROW_GROUP, "page.size": PAGE_BYTES, "page.row.count.limit": PAGE_ROWS, "dictionary.page.size": 1 << 20}.items():
        writer = writer.option(f"parquet.{key}", str(value))
    for column in ("doc_id", "part_start", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The token table; only the columns asked for are read. ``start`` is the number of ids in all rows before."""
    rows = spark.read.schema("doc_id long, part int, part_start long, n_tokens long, ids array<int>").parquet(path)
    if "start" not in columns:
        return rows.select(*columns)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    # one row for each file: bounded by the number of files, whatever the rows
    offsets = totals.selectExpr("part", "coalesce(sum(__n) over (order by part rows between unbounded preceding and 1 preceding), 0) as __before")
    return rows.join(F.broadcast(offsets), "part").selectExpr(*("__before + part_start as start" if c == "start" else c for c in columns))


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): CRC-32 over each row's ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: encode ``documents`` into token files, read them back and give each document's place, length and checksum."""
    path = write_token_files(common.table(spark, sf_dir, "documents"), common.fresh_path(spark, "tokens"))
    return checksums(read_token_files(spark, path))
