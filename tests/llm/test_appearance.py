import unicodedata

from hypothesis import HealthCheck, given, settings, strategies as st

from papyra.llm.appearance import appearance_rows, consistent_form, lookalike_pairs, parts


def forms(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, form string")
    return {r.doc_id: r.form for r in consistent_form(spark, df).collect()}


def brute(t):
    return None if t is None else unicodedata.normalize("NFC", "".join(parts(c) for c in t))


SAME = [
    ("café", "café"), ("ạ̇", "ạ̇"), ("ＡＢＣ　ｄ－１", "ABC d-1"), ("zero​width­﻿", "zerowidth"), ("no break thin", "no break thin"), ("hy‐phen‑s", "hy-phen-s"),
    ("ﬁnal ﬀ ﬃ", "final ff ffi"), ("20 ℃", "20 °C"), ("Kelvin K Å Å", "Kelvin K Å Å"), ("раreе сору", "paree copy"), ("ΑΒΕ Τοο", "ABE Too"), ("µm", "μm"), ("한국", "한국"), ("e‍́", "é"), ("…", "..."),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("m²", "m2"), ("a b", "a  b"), ("a\nb", "a b"), ("a\tb", "a b"), ("ſ", "s"), ("½", "1/2"), ("①", "1"), ("κ", "k"), ("α", "a"), ("а́", "a"), ("\U0001f469‍\U0001f52c", "\U0001f469\U0001f52c")]


def test_texts_that_look_the_same_get_one_form(spark):
    got = forms(spark, [x for pair in SAME for x in pair])
    assert [p for i, p in enumerate(SAME) if got[2 * i] != got[2 * i + 1]] == []


def test_visible_differences_stay(spark):
    got = forms(spark, [x for pair in DIFFERENT for x in pair])
    assert [p for i, p in enumerate(DIFFERENT) if got[2 * i] == got[2 * i + 1]] == []


def test_null_empty_blank_invisible_and_long_texts(spark):
    long = "абв é " * 40_000
    got = forms(spark, [None, "", "   ", "​​", long, "plain ascii ~"])
    assert [got[0], got[1], got[2], got[3], got[5]] == [None, "", "   ", "", "plain ascii ~"] and got[4] == brute(long)


def test_table_is_a_fixed_point():
    known = {c for c, _, _ in appearance_rows()}
    assert all(parts(x) == x for _, p, _ in appearance_rows() for x in p if x in known) and len(known) < 30_000


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=("Cs",), exclude_characters="‍"), st.sampled_from("eéо̣́ﬁ ｆ​")), max_size=30), min_size=1, max_size=30))
def test_random_texts_equal_the_brute_force_form(spark, texts):
    assert forms(spark, texts) == {i: brute(t) for i, t in enumerate(texts)}


def test_repeated_rows_count_once_and_rows_without_key_not(spark):
    rows = [(1, "caf\u00e9 x")] * 3 + [(2, "plain")] * 2 + [(3, None)] * 2 + [(None, "x"), (None, "\u00e9"), (4, "cafe\u0301 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in consistent_form(spark, df).collect()) == [(1, "caf\u00e9 x"), (2, "plain"), (3, None), (4, "caf\u00e9 x")]
    assert [tuple(r) for r in lookalike_pairs(spark, df).collect()] == [(1, 4)]


def pairs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.key_a, r.key_b) for r in lookalike_pairs(spark, df).collect()}


def test_pairs_leave_out_copies_blanks_and_nulls(spark):
    assert pairs(spark, ["copy", "copy", "сору", "c​opy", None, None, "", " ", " ", "​", "other"]) == {(0, 2), (1, 2), (0, 3), (1, 3), (2, 3)}


def test_hot_class_of_copies(spark):
    assert pairs(spark, ["same text"] * 300 + ["same text"]) == {(i, 300) for i in range(300)}


def test_empty_table(spark):
    assert pairs(spark, []) == set() and forms(spark, []) == {}


def test_a_joiner_is_kept_only_between_its_own_pictographs(spark):
    got = forms(spark, ["\U0001f469\u200d\U0001f52c", "\U0001f469\u200d\U0001f52cé\u200d", "\U0001f469\u200d\U0001f52cé", "\U0001f3f3\ufe0f\u200d\U0001f308"])
    assert got[1] == got[2] and "\u200d" in got[0] and "\u200d" in got[3]


def test_many_copies_and_one_variant_cost_their_pairs(spark):
    """Twenty thousand copies of a text on one side, of another variant three: pairs only between the sides."""
    df = spark.range(20_000).selectExpr("id as doc_id", "'same text here' as text").unionByName(spark.createDataFrame([(20_000 + i, "same text\u00a0here") for i in range(3)], "doc_id long, text string"))
    got = lookalike_pairs(spark, df)
    assert got.count() == 60_000 and got.where("key_a >= 20000 or key_b < 20000").count() == 0


def test_lookalikes_are_letters_of_other_scripts():
    from papyra.llm.appearance import LOOKALIKES

    assert all(not unicodedata.name(c).startswith("LATIN") and t.isascii() and t.isalpha() for c, t in LOOKALIKES.items())
