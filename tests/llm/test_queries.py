"""Every registered query of the training-data operators against a plain computation, with the columns that it has to return."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from spindrift.llm import common, queries

SF = "/root/testdata/sf0.001"
KINDS7 = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS9 = ["email", "ip", "card", "phone"]


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in common.table(spark, SF, "documents").collect()}


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def digest(found, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(found)).encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_token_files_query(spark, docs):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = {r["doc_id"]: r for r in rows_of(spark, "op1_token_files")}, 0
    assert set(got) == set(docs)
    for d in sorted(docs):
        ids = np.array(plain.encode(docs[d], add_special_tokens=False).ids + [2], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_language_query(spark, docs):
    langs = {r["doc_id"]: r["lang"] for r in common.table(spark, SF, "documents").collect()}
    got = rows_of(spark, "op2_language_id")
    assert {r["doc_id"] for r in got} == set(docs) and {r["lang_pred"] for r in got} <= {*langs.values(), "und"}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]]))
    held = [r for r in got if r["held_out"] and langs[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) > 0.95 * len(held)


def test_quality_query(spark, docs):
    got = rows_of(spark, "op3_quality")
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, SF, "labels").collect()}
    assert {r["doc_id"] for r in got} == set(docs) and all(0 <= r["score"] <= 1 for r in got)
    own = [r for r in got if labels.get(r["doc_id"]) is not None]
    assert sum(r["kept"] == (labels[r["doc_id"]] == 1) for r in own) > 0.95 * len(own)


def test_byte_bpe_query(spark, docs):
    lines = [line.split() for line in open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb")]
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})
    for r in rows_of(spark, "op4_byte_bpe"):
        ids = np.array(plain.encode_ordinary(docs[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_secrets_query(spark, docs):
    got = rows_of(spark, "op7_secrets")
    assert len(got) == len(docs)
    for r in got:
        text, base = docs[r["doc_id"]], []
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        assert [r[f"n_{k}"] for k in KINDS7] == [sum(b[1] == k for b in base) for k in range(3)] and r["base_sha256"] == digest(base, KINDS7)
        assert {f"{KINDS7[k]}:{s}:{e}" for s, k, e in base} <= set(r["spans"].split(","))


def test_packing_query(spark, docs):
    got = rows_of(spark, "op8_packing")
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        assert r["n_tokens"] == len(docs[r["doc_id"]].encode()) + 1 <= r["padded"]
    batches: dict = {}
    for r in got:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for own in batches.values():
        assert sorted(r["place"] for r in own) == list(range(len(own))) and (sum(r["padded"] for r in own) <= 1 << 16 or len(own) == 1)


def test_personal_data_query(spark, docs):
    for r in rows_of(spark, "op9_pii"):
        text, base = docs[r["doc_id"]], []
        only = lambda m: re.sub("[^0-9]", "", m[0])
        base += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        base += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(only(m)) <= 19 and luhn(only(m))]
        base += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(only(m)) <= 15]
        assert [r[f"n_{k}"] for k in KINDS9] == [sum(b[1] == k for b in base) for k in range(4)] and r["base_sha256"] == digest(base, KINDS9)
        assert {f"{KINDS9[k]}:{s}:{e}" for s, k, e in base} <= set(r["spans"].split(","))


def test_simhash_query(spark, docs):
    import xxhash

    fps = {}
    for d, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if words else 0
    ids = sorted(fps)
    root = {d: d for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 4 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    got = rows_of(spark, "op10_simhash_near_dedup")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{fps[d]:016x}", root[d]) for d in ids} and len(got) == len(ids)
