import random

import numpy as np
import regex

from papyra.llm import leaks as L


def words(t):
    return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())


def brute(docs, items, width):
    """(doc, item, at, at, n) of maximal common runs, by comparing every pair of places."""
    out = set()
    for d, t in docs:
        a = words(t)
        for k, s in items:
            b = words(s)
            for i in range(len(a)):
                for j in range(len(b)):
                    if i and j and a[i - 1] == b[j - 1]:
                        continue
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if n >= width:
                        out.add((d, k, i, j, n))
    return out


def found(spark, docs, items, width):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return [tuple(r) for r in L.verbatim_matches(spark, a, b, width=width).collect()]


def test_suffix_array_is_sorted():
    rng = random.Random(5)
    for n in (0, 1, 2, 30, 200):
        a = np.array([rng.randrange(3) for _ in range(n)], np.int64)
        assert L.suffix_array(a).tolist() == sorted(range(n), key=lambda i: a[i:].tolist())


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(n))
    docs = [(i, text(rng.randrange(40))) for i in range(25)]
    items = [(100 + i, text(rng.randrange(25))) for i in range(6)]
    docs += [(50, docs[3][1]), (51, None), (52, ""), (53, items[0][1] + " omega " + items[1][1])]
    items += [(200, items[0][1]), (201, None), (202, "short")]
    got = found(spark, docs, items, 4)
    assert len(got) == len(set(got)) and set(got) == brute(docs, items, 4)


def test_case_punctuation_and_invisible_differences_do_not_hide_a_leak(spark):
    item = "One two three four five six seven eight nine ten eleven twelve"
    docs = [(1, "so: ONE, two-three…four\nfive (six) seven​ eight níne".replace("í", "i") + " ten; eleven/tweＬve end"), (2, item.replace("six", "6")), (3, item[: item.rindex(" ")])]
    assert [(r[0], r[1], r[4]) for r in found(spark, docs, [(9, item)], 12)] == [(1, 9, 12)]


def test_shards_and_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("a b c".split()) for _ in range(n))
    docs, items = [(i, text(30)) for i in range(30)], [(i, text(12)) for i in range(8)]
    whole = sorted(found(spark, docs, items, 5))
    monkeypatch.setattr(L, "BLOCK_WORDS", 20)
    assert sorted(found(spark, docs, items, 5)) == whole


def test_empty_tables_and_equal_key_names(spark):
    assert found(spark, [], [(1, "a b c")], 2) == [] and found(spark, [(1, "a b c")], [], 2) == []
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert L.verbatim_matches(spark, df, df, item="doc_id", width=3).columns[:2] == ["doc_id", "item_doc_id"]


def test_affected_documents_are_removed(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "doc_id long, text string")
    hits = spark.createDataFrame([(2, 7), (2, 8)], "doc_id long, item_id long")
    assert {r.doc_id for r in L.without_leaks(docs, hits).collect()} == {1, 3}


def test_an_index_serves_several_test_sets_and_copies_have_their_own_matches(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("a b c d".split()) for _ in range(n))
    docs = [(i, text(25)) for i in range(20)]
    docs += [(100 + i, docs[3][1]) for i in range(40)] + [(3, docs[3][1])]
    monkeypatch.setattr(L, "SHARD_WORDS", 60)
    monkeypatch.setattr(L, "PAIRS", 7)
    index = L.build_index(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert index.shards.count() > 3
    for seed in (1, 2):
        items = [(i, text(14)) for i in range(5)] + [(50, docs[3][1])]
        items.append((51, items[0][1]))
        got = [tuple(r) for r in L.search_index(spark, index, spark.createDataFrame(items, "item_id long, text string"), width=4).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs, items, 4)


def test_the_corpus_is_read_once_however_many_blocks(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, f"one two three four {i}") for i in range(9)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(L, "BLOCK_WORDS", 5)
    items = spark.createDataFrame([(i, "one two three four") for i in range(2)] + [(9, "two three four 5"), (8, "three four 7 8")], "item_id long, text string")
    index = L.build_index(spark, spark.read.parquet(str(tmp_path / "d")))
    import shutil

    shutil.rmtree(tmp_path / "d")
    got = {(r.doc_id, r.item_id) for r in L.search_index(spark, index, items, width=3).collect()}
    assert got == {(d, i) for d in range(9) for i in (0, 1, 9)} | {(7, 8)}
