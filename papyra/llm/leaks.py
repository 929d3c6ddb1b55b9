"""Evaluation texts leaking into training texts, by suffix arrays over shards of the training corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from papyra.llm.appearance import consistent_form
from papyra.operators.skew import salted_left_join
from papyra.session import Cut

#: A leak is a run of at least so many words.
MIN_WORDS = 12
#: Suffixes are sorted by so many words; runs asked for may not be longer. What is equal that far is compared word by word.
DEPTH = 16
#: Words of evaluation texts sent to all tasks at once (a larger set goes in blocks), of training texts in a shard, and pairs of places looked at at once.
BLOCK_WORDS = 2_000_000
SHARD_WORDS = 250_000
PAIRS = 1_000_000
WORD = r"[\p{L}\p{N}]+"


def words_of(spark: SparkSession, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, words``: the lower-cased runs of letters and digits of the consistent form of each text, as numbers of 63 bits (two words have the same one with a chance of 2^-63)."""
    forms = consistent_form(spark, docs, key, text).where("form is not null")
    found = F.regexp_extract_all(F.lower("form"), F.lit(WORD), F.lit(0))
    return forms.select(key, F.transform(found, lambda w: F.shiftrightunsigned(F.xxhash64(w), 1)).alias("words"))


def folded(spark: SparkSession, rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows of distinct texts, ``key, of``: the keys whose text is that of the row ``of``). Null keys and texts are left out."""
    cut = Cut(spark, "copies")
    rows = rows.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    marks = cut(rows.select(key, F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")).distinct())
    several = marks.groupBy("h", "g").agg(F.min(key).alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g", "of")
    copies = cut(salted_left_join(marks, several, ["h", "g"], F.col(key)).where(F.col("of") != F.col(key)).select(key, "of"))
    return rows.join(copies.select(key), key, "left_anti"), copies


def suffix_array(a: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of the suffixes of ``a`` in their order (by at least their first ``depth`` elements), by prefix doubling."""
    n = len(a)
    _, rank = np.unique(a, return_inverse=True)
    order, k = np.argsort(rank, kind="stable"), 1
    while n and k < min(n, depth or n) and rank.max() < n - 1:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        k *= 2
    return order


def compared(corpus: np.ndarray, at: np.ndarray, tests: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
    """-1, 0, 1: the ``width`` words of the corpus at each place against those of the tests. Only undecided pairs go on to their next word."""
    sign, live = np.zeros(len(at), np.int8), np.arange(len(at))
    for j in range(width):
        x, y = corpus[at[live] + j], tests[q[live] + j]
        sign[live] = np.where(x < y, -1, np.where(x > y, 1, 0))
        live = live[x == y]
        if not len(live):
            break
    return sign


def bounds(corpus: np.ndarray, order: np.ndarray, tests: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every test suffix, the range of ``order`` whose suffixes share its first ``width`` words: binary searches, all in step."""
    padded = np.concatenate((corpus, np.full(width, -1, corpus.dtype)))
    out = []
    for after_equal in (False, True):
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
        while (open_ := lo < hi).any():
            at = np.flatnonzero(open_)
            mid = (lo[at] + hi[at]) // 2
            sign = compared(padded, order[mid], tests, starts[at], width)
            right = sign < 0 if not after_equal else sign <= 0
            lo[at[right]] = mid[right] + 1
            hi[at[~right]] = mid[~right]
        out.append(lo)
    return out[0], out[1]


class TestSet:
    """A block of evaluation texts as word numbers, texts parted by -1, with its places sorted and equal runs of ``width`` words made one class."""

    def __init__(self, items: list[np.ndarray], width: int):
        sizes = np.array([len(w) for w in items], np.int64)
        self.base = np.concatenate(([0], np.cumsum(sizes + 1)))[: len(items)].astype(np.int64)
        self.words = np.concatenate([x for w in items for x in (w, [-1])] + [np.full(width + 1, -1)]).astype(np.int64)
        starts = np.concatenate([np.arange(b, b + max(0, n - width + 1)) for b, n in zip(self.base, sizes)] or [np.zeros(0)]).astype(np.int64)
        keep = np.zeros(len(self.words), bool)
        keep[starts] = True
        order = suffix_array(self.words, DEPTH)
        self.starts = order[keep[order]]
        fresh = np.ones(len(self.starts), bool)
        fresh[1:] = compared(self.words, self.starts[1:], self.words, self.starts[:-1], width) != 0
        self.first = np.append(np.flatnonzero(fresh), len(self.starts))  # of each class


def shard_matches(corpus: np.ndarray, order: np.ndarray, begins: np.ndarray, tests: TestSet, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, item, word in document, word in item, words) of every maximal verbatim match of at least ``width`` words, by numbers, so many at a time. ``corpus``: the words of documents that begin at ``begins``, each ended by a mark of its own below all words."""
    classes = tests.first[:-1]
    if not len(classes):
        return
    lo, hi = bounds(corpus, order, tests.words, tests.starts[classes], width)
    size = np.diff(tests.first)
    hit = np.flatnonzero(hi > lo)
    # every place of a class with every test of the class, in slices of bounded size
    work = np.stack((np.repeat(hit, size[hit]), np.arange(size[hit].sum()) - np.repeat(np.cumsum(size[hit]) - size[hit], size[hit])), axis=1) if len(hit) else np.zeros((0, 2), np.int64)
    places = (hi - lo)[work[:, 0]]
    group = (np.cumsum(places) - places) // PAIRS
    for g in np.unique(group):
        rows, n = work[group == g], places[group == g]
        q = np.repeat(tests.starts[classes[rows[:, 0]] + rows[:, 1]], n)
        pos = order[np.repeat(lo[rows[:, 0]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
        left = (pos == 0) | (q == 0) | (corpus[pos - 1] != tests.words[q - 1])  # else the match is longer to the left
        q, pos = q[left], pos[left]
        length, live = np.full(len(q), width), np.arange(len(q))
        while len(live):  # the marks at the ends differ, so this stops there
            live = live[corpus[pos[live] + length[live]] == tests.words[q[live] + length[live]]]
            length[live] += 1
        doc, item = np.searchsorted(begins, pos, "right") - 1, np.searchsorted(tests.base, q, "right") - 1
        yield doc, item, pos - begins[doc], q - tests.base[item], length


@dataclass
class Index:
    """Suffix arrays over all words of a corpus, a row a shard: ``docs, begins, words, places``; and the copies that its texts stand for. It serves any set of tests."""

    shards: DataFrame
    copies: DataFrame
    key: str


def build_index(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Shards of about ``SHARD_WORDS`` words of the distinct texts, each with its suffix array, written to the shared folder once. Rows repeated exactly count once; null keys and texts are left out."""
    rows, copies = folded(spark, docs, key, text)
    kind = rows.schema[key].dataType
    shape = pa.schema([("docs", pa.list_(to_arrow_type(kind))), ("begins", pa.list_(pa.int32())), ("words", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, n = [], [], 0

        def shard() -> pa.RecordBatch:
            begins = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]
            flat = np.concatenate([x for d, w in enumerate(words) for x in (w, [-2 - d])]).astype(np.int64)
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
            return pa.RecordBatch.from_arrays([one(keys, shape[0].type.value_type), one(begins, pa.int32()), one(flat, pa.int64()), one(suffix_array(flat, DEPTH), pa.int32())], schema=shape)

        for b in batches:
            column, names = b["words"], b[key].to_pylist()
            flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i, k in enumerate(names):
                keys.append(k)
                words.append(flat[at[i] : at[i + 1]].copy())
                n += len(words[-1])
                if n >= SHARD_WORDS:
                    yield shard()
                    keys, words, n = [], [], 0
        if n:
            yield shard()

    found = words_of(spark, rows, key, text).where("size(words) > 0")
    name = kind.simpleString()
    return Index(Cut(spark, "index")(found.mapInArrow(build, f"docs array<{name}>, begins array<int>, words array<bigint>, places array<int>")), copies, key)


def search_index(spark: SparkSession, index: Index, items: DataFrame, item: str = "item_id", text: str = "text", width: int = MIN_WORDS) -> DataFrame:
    """``key, item, doc_word, item_word, n_words``: maximal runs of at least ``width`` words that a document shares with an item; see ``verbatim_matches``.

    The evaluation texts are the stated query set. Their words are written once; blocks of bounded size are sorted once,
    on the driver, and sent to all tasks as arrays. Every block reads the stored shards, never the corpus.
    """
    if width > DEPTH:
        raise ValueError(f"runs of more than {DEPTH} words need a deeper index")
    key, named = index.key, item if item != index.key else f"item_{item}"
    rows, copies = folded(spark, items, item, text)
    words = Cut(spark, "tests")(words_of(spark, rows, item, text).where(F.size("words") >= width))
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    types = [index.shards.schema["docs"].dataType.elementType, items.schema[item].dataType]
    shape = pa.schema([(key, to_arrow_type(types[0])), (named, to_arrow_type(types[1])), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])
    out = None
    for n in range(blocks):
        part = words.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == n).select(item, "words").toArrow().combine_chunks()
        lists = part["words"].to_pylist() if part.num_rows < 2 else None
        texts = [np.array(x, np.int64) for x in lists] if lists is not None else [x.values.to_numpy() for x in part["words"]]
        shared = spark.sparkContext.broadcast((TestSet(texts, width), part[item].to_pylist()))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tests, names = shared.value
            for b in batches:
                for row in range(b.num_rows):
                    docs, (begins, corpus, order) = b["docs"][row].values, (b[c][row].values.to_numpy() for c in ("begins", "words", "places"))
                    for d, i, *places in shard_matches(corpus, order, begins, tests, width):
                        yield pa.RecordBatch.from_arrays([docs.take(pa.array(d)), pa.array([names[x] for x in i], shape[1].type), *(pa.array(x.astype(np.int64)) for x in places)], schema=shape)

        found = index.shards.mapInArrow(search, ", ".join(f"{f} {t}" for f, t in zip(shape.names, [*(x.simpleString() for x in types), "long", "long", "long"])))
        out = found if out is None else out.unionByName(found)
    out = Cut(spark, "matches")(out)
    for side, same in ((key, index.copies), (named, copies.withColumnRenamed(item, named))):
        more = same.select(F.col(side).alias("__copy"), F.col("of").alias(side))
        more = salted_left_join(more, out, [side], F.col("__copy")).where("n_words is not null").drop(side).withColumnRenamed("__copy", side)
        out = out.unionByName(more)
    return out


def verbatim_matches(spark: SparkSession, docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", width: int = MIN_WORDS) -> DataFrame:
    """``key, item, doc_word, item_word, n_words``: maximal runs of at least ``width`` words that a document shares with an item.

    Words are compared without regard to case and to invisible differences of characters. The corpus is cut into shards of
    bounded size with a suffix array each, in which every run of ``width`` words of the evaluation texts is binary-searched,
    equal ones once; what is found is extended to its longest. Equal texts, on either side, are searched once and expanded
    at the end, salted. Null and empty texts, and items shorter than ``width``, match nothing; copies of documents or items
    under other keys each have their own matches, rows repeated exactly count once, rows without key not at all. If the keys
    have one name, the item's column is called ``item_`` and that name.
    """
    return search_index(spark, build_index(spark, docs, key, text), items, item, text, width)


def without_leaks(docs: DataFrame, matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that no evaluation text leaked into."""
    return docs.join(matches.select(key).distinct(), key, "left_anti")
