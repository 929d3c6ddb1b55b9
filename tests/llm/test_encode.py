import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from papyra.llm import encode as E


@pytest.fixture(scope="module")
def tokenizer():
    return E.load(E.TOKENIZERS)


def encoded(spark, texts):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, pos long")
    return {r.doc_id: list(r.ids) for r in E.encode(df).collect()}


def check(spark, tokenizer, texts):
    assert encoded(spark, texts) == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_odd_texts(spark, tokenizer):
    check(spark, tokenizer, [
        None, "", " ", "  a", "a  b\n\n c \t", "I've they'll 'sup 'S", "<|endoftext|> is text", "naïve café x　y z\x85w", "漢字かな交じり 12３４ ½²", "👩‍🔬🧬", "áé", "x" * 5000, " " * 700, "\x00\x01\x1c\x1d\x1f",
        "new letters: \U0001e030\U0001e4d0 ꟀꟐ \U00011f02 \U00010d4a Ᲊ", "unassigned ͸\U000e0fff private  \U0010ffff", "tail ᠎ ​ ﻿",
    ])


def test_repeated_and_hot_words(spark, tokenizer):
    check(spark, tokenizer, ["the the the the"] * 200 + ["other words here"] * 3)


def test_repeated_rows_count_once_and_rows_without_key_not(spark, tokenizer):
    rows = [(1, "two words", 0)] * 3 + [(2, None, 0)] * 2 + [(None, "x", 0), (None, None, 0)]
    got = E.encode(spark.createDataFrame(rows, "doc_id long, text string, ids long")).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == [(1, tokenizer.encode("two words").ids), (2, [])]


def test_empty_table(spark):
    assert encoded(spark, []) == {}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(st.sampled_from("ab '’sdtlmrev \n\t1２é漢👩  "), max_size=40)), min_size=1, max_size=40))
def test_random_texts(spark, tokenizer, texts):
    check(spark, tokenizer, texts)


def test_decoding_is_the_exact_round_trip(spark):
    texts = ["", "plain", "héllo 漢字 👩‍🔬\n\n", None, " x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in E.decode(E.encode(df)).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert E.decode(none).first().text is None
