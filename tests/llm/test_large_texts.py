"""Texts of megabytes, with very many hits: every operator takes them whole, in time that grows with the text."""

import base64
import hashlib
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import bpe, langid, license_scan, line_dedup, packing, pii, quality, secret_scan, simhash
from memloom.llm.common import tokenizer_path

from .test_pairs_and_pipeline import brute_print
from .test_text_ops import base_counts, base_spans, rsa_key

HITS = 100_000


def one(spark, text, **columns):
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    return df


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(9)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnop"), n)) for n in rng.integers(2, 10, 3000)])
    return "\n".join(" ".join(line) + "." for line in rng.choice(words, (25_000, 16)))  # 2.6 MB


def test_language_of_a_long_text(spark, prose):
    net = langid.ByteNetwork(["x", "y"], 4)
    got = {r.doc_id: r for r in langid.identify(one(spark, prose), net).collect()}
    lang, score = langid.predict([prose], net)[0]
    assert got[1].lang_pred == lang and abs(got[1].score - score) < 1e-6


def test_quality_of_a_long_text(spark, prose):
    row = quality.judge(one(spark, prose, lang="en", source="s")).filter("doc_id = 1").first()
    assert (row.s.n_words, row.s.word_chars, row.s.n_symbols, row.s.n_dup_lines, row.s.n_repeat_words) == base_counts(prose)
    again = " ".join(["one two three"] * HITS)
    row = quality.judge(one(spark, again, lang="en", source="s")).filter("doc_id = 1").first()
    assert row.s.n_repeat_words == 3 * HITS and row.failed


def test_packing_and_encoding_a_long_text(spark, prose):
    from tokenizers import Tokenizer

    ids = np.array(Tokenizer.from_file(tokenizer_path()).encode(prose, add_special_tokens=False).ids, "<u4")
    row = bpe.token_digests(one(spark, prose)).filter("doc_id = 1").first()
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    whole, seen = np.append(ids, np.uint32(1)), 0
    for p in packing.pack(one(spark, prose)).filter("doc_id = 1").orderBy("start").collect():
        assert p.start == seen and p.ids_crc32 == zlib.crc32(whole[seen : seen + p.length].tobytes())
        seen += p.length
    assert seen == len(whole)


def test_very_many_personal_data(spark):
    text = " ".join(["mail a@b.co", "+1 212 555 1234,", "10.0.0.1,", "4111111111111111", "iban GB82WEST12345698765432", "ssn 123-45-6789"] * (HITS // 6))
    began = time.time()
    row = pii.find_pii(one(spark, text)).filter("doc_id = 1").first()
    got = [(s.kind, s.start, s.end) for s in row.spans]
    assert [s for s in got if s[0] in pii.BASE] == base_spans(text) and len(got) >= HITS - 6
    masked = pii.mask(one(spark, text)).filter("doc_id = 1").first().text
    assert masked == " ".join(["mail [EMAIL]", "[PHONE],", "[IP],", "[CARD]", "iban [IBAN]", "ssn [SSN]"] * (HITS // 6))
    assert time.time() - began < 120


def test_fingerprint_of_a_long_text(spark, prose):
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(one(spark, prose)).collect()}
    assert got[1] == brute_print(prose)


def test_very_many_secrets(spark):
    key = base64.b64encode(rsa_key()).decode()
    texts = ["-----BEGIN A----- " * HITS, f"-----BEGIN A-----\n{key}\n" * 1000 + "-----END A-----", "M" * 2_000_000, "MIIEpAIBAAKCAQEA" * HITS, "password = aaaabbbbcccc1 " * HITS, "eyJhbGciOi." * HITS, f"{key} " * 1000, "token" + " " * 1_000_000, "aB3/" * 16 + "\n" * 3 + ("aB3/" * 16 + "\n") * 20_000]
    counts = []
    for t in texts:
        began = time.time()
        counts.append(len(secret_scan.scan(t)))
        assert time.time() - began < 20
    assert counts[0] == 0 and counts[4] == HITS and counts[6] == 1000 and counts[1] == 1000
    assert len(secret_scan.scan_secrets(one(spark, texts[4])).filter("doc_id = 1").first().spans) == HITS


def test_very_many_licenses(spark):
    text = "released under the MIT License and " * (HITS // 4)
    row = license_scan.scan_licenses(one(spark, text)).filter("doc_id = 1").first()
    assert sum(s.base for s in row.spans) == HITS // 4 and row.n_words == 6 * (HITS // 4)


def test_very_many_repeated_lines(spark):
    text = "\n".join(["same line"] * HITS)
    row = line_dedup.deduplicate_lines(one(spark, text), counts=True).filter("doc_id = 1").first()
    assert (row.n_lines, row.n_removed, row.text) == (HITS, HITS - 1, "same line")
