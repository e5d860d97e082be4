import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstack.llm import tokens as T

RAW = T.vocabulary()
ENC = T.Encoder(RAW)
RANKS = {base64.b64decode(a): int(b) for a, b in (line.split() for line in RAW.splitlines())}
REF = tiktoken.Encoding("ref", pat_str=T.PATTERN, mergeable_ranks=RANKS, special_tokens={})

HARD = ["", " ", "\n\n  \t", "a" * 3000, " " * 500, "x=" * 900, "日本語のテキスト。", "🙂👩‍👩‍👧 ‮", "𝔘𝔫𝔦 𝒸ℴ𝒹ℯ", "don't we'll I'VE", "<|endoftext|>", "﻿bom", "AAAAaaaaBBBB0000" * 50, "שלום עולם مرحبا", "\u0000\u0001", "1234567890" * 30, "é" * 100]


@pytest.mark.parametrize("text", HARD)
def test_equals_the_library(text):
    ids = ENC.encode(text)
    assert ids == REF.encode_ordinary(text) and ENC.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ENC.encode(text) == REF.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abetsinxX =_-'.0", max_size=120))
def test_dense_merges(text):
    assert ENC.encode(text) == REF.encode_ordinary(text)


def test_frame(spark):
    d = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (1, "hello world")], "doc_id long, text string").selectExpr("*", "5 as ids")
    got = sorted((r.doc_id, r.ids) for r in T.encoded(d, RAW).collect())
    assert got == [(1, REF.encode_ordinary("hello world"))] * 2 + [(2, []), (3, [])]
    assert T.encoded(d.where("false"), RAW).count() == 0
