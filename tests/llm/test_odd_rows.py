"""Defined results of nulls, repeated rows, ties and very long texts, row by row."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm import fixtures as fx
from tests.llm.test_operators import RANKS, VOCABULARY
from tomewright.llm import bpe, licenses
from tomewright.llm.buckets import batches
from tomewright.llm.quality import quality
from tomewright.llm.shard import shard_by_bytes

REAL = tiktoken.Encoding("real", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
LONG = fx.words(random.Random(8), 250_000)
TEXT = fx.words(random.Random(7), 60) + " all rights reserved"
ROWS = [(1, TEXT), (1, TEXT), (2, None), (None, TEXT), (None, None), (3, TEXT + " more"), (4, ""), (5, LONG), (5, "cc by")]
WORDS = {t: len((t or "").split()) for _, t in ROWS}


@pytest.fixture(scope="module")
def rows(spark):
    assert len(LONG) > 1_000_000
    return spark.createDataFrame([(i, t, 7, *["z"] * 9) for i, t in ROWS], fx.CLASHING).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_batches(rows):
    got = batches(rows, n_buckets=3, budget=300).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, WORDS[t]) for i, t in ROWS)
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(ROWS)  # equal rows have places of their own
    assert all(r.padding == r.bucket_tokens - r.n_tokens >= 0 for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, batches(rows.repartition(1), n_buckets=3, budget=300).collect()), key=str)


def test_quality(rows, labels):
    got = quality(rows, labels).collect()
    want = Counter((i, *fx.quality_counts(t)) for i, t in ROWS)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    scores = {}
    for r in got:
        scores.setdefault((r.n_words, r.word_chars), set()).add((r.score, r.kept))
    assert all(len(s) == 1 for s in scores.values())  # equal texts are judged alike, whatever their ids


def test_shards(rows):
    got = shard_by_bytes(rows, 3).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id is not None, r.doc_id or 0) for r in order] == sorted((i is not None, i or 0) for i, _ in ROWS)  # null first


def test_licenses(rows):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.base_labels) for r in licenses.scan_licenses(rows).collect())
    base = lambda t: (1, 60, "reserved") if t and "reserved" in t else (1, 0, "cc-by") if t == "cc by" else (0, None, "")
    assert got == Counter((i, WORDS[t], *base(t)) for i, t in ROWS)


def test_bpe(rows):
    def real(t):
        ids = REAL.encode(t or "", disallowed_special=())
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(rows, VOCABULARY, public_tokenizers.PATTERN).collect())
    assert got == Counter((i, *real(t)) for i, t in ROWS)
