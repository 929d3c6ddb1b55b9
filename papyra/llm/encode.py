"""Encoding of a corpus with a byte-level BPE: every distinct pre-token is encoded once."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from papyra.operators.skew import heavy_keys, salted_left_join
from papyra.session import Cut

#: The folder of the tokenizer files, and the file used.
TOKENIZERS = os.environ.get("PAPYRA_TOKENIZERS", "/opt/tokenizers")
MODEL = "byte_bpe_50k.json"
#: The vocabulary's pre-token rule; white space by the Unicode property, which is what the tokenizer's engine means by \s.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
# The printable bytes that byte-level vocabularies write as themselves; the others follow from U+0100 in order.
PRINTABLE_BYTES = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary, by letter."""
    own = [b for lo, hi in PRINTABLE_BYTES for b in range(lo, hi + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(folder: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{folder}/{MODEL}")
    t.encode_special_tokens = True  # the strings of special tokens are ordinary text
    return t


def pre_tokens(docs: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """``__key, pos, word``: the positioned pre-tokens of every text that has any.

    Split in the JVM; texts with code points that the JVM's Unicode tables don't know are split by the tokenizer itself, as
    newer tables may call them letters.
    """
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where("__key is not null and __text != ''")
    unknown = F.col("__text").rlike(r"\p{Cn}")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = None
        for pdf in batches:
            t = t or load(folder)
            out = []
            for k, s in zip(pdf["__key"], pdf["__text"]):
                out += [(k, i, s[a:b]) for i, (_, (a, b)) in enumerate(t.pre_tokenizer.pre_tokenize_str(s))]
            yield pd.DataFrame(out, columns=["__key", "pos", "word"])

    known = rows.where(~unknown).select("__key", F.posexplode(F.regexp_extract_all("__text", F.lit(PRE_TOKEN), F.lit(0))).alias("pos", "word"))
    return known.unionByName(rows.where(unknown).mapInPandas(split, f"__key {rows.schema['__key'].dataType.simpleString()}, pos int, word string"))


def encode_words(words: DataFrame, folder: str) -> DataFrame:
    """``word, ids`` of a table of distinct ``word``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = None
        for pdf in batches:
            t = t or load(folder)
            got = t.encode_batch(pdf["word"].tolist(), add_special_tokens=False)
            yield pd.DataFrame({"word": pdf["word"], "ids": [x.ids for x in got]})

    return words.mapInPandas(run, "word string, ids array<int>")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """``key, ids``: the token ids of every text, without special tokens.

    Texts are exploded to positioned pre-tokens; each distinct one is encoded once; its ids are joined back (very frequent
    ones salted) and the text's ids reassembled by position. A null or empty text has the empty list. A key has
    one text; rows repeated exactly count once, and rows without key are left out. Other columns are not read.
    """
    at = pre_tokens(docs, key, text, folder)
    words = Cut(docs.sparkSession, "words")(at.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    ids = encode_words(words.select("word"), folder)
    joined = salted_left_join(at, ids, ["word"], F.col("__key"), heavy=heavy_keys(words, ["word"], counted="n"), strategy="shuffle_hash").select("__key", "pos", "ids")
    whole = joined.groupBy("__key").agg(F.flatten(F.transform(F.sort_array(F.collect_set(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))
    none = docs.where(F.col(key).isNotNull() & (F.col(text).isNull() | (F.col(text) == ""))).select(F.col(key).alias("__key")).distinct().withColumn("ids", F.array().cast("array<int>"))
    return whole.unionByName(none).withColumnRenamed("__key", key)


def token_bytes(spark, folder: str = TOKENIZERS) -> DataFrame:
    """``id, bytes``: what each token of the vocabulary stands for. Bounded by the vocabulary (50,257 rows)."""
    letters = byte_letters()
    rows = [(i, bytearray(letters[c] for c in s) if all(c in letters for c in s) else bytearray(s.encode())) for s, i in load(folder).get_vocab().items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode(encoded: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS) -> DataFrame:
    """``key, text`` of a table ``key, ids``: the ids are joined with the token-byte table and the bytes put together by position.

    An empty list gives the empty text, a null one a null text.
    """
    table = F.broadcast(token_bytes(encoded.sparkSession, folder))
    at = encoded.select(F.col(key).alias("__key"), F.posexplode("ids").alias("pos", "id")).join(table, "id")
    hexed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))), lambda x: x["h"]), "")
    texts = at.groupBy("__key").agg(F.decode(F.unhex(hexed), "UTF-8").alias("text"))
    none = encoded.where("ids is null or size(ids) = 0").select(F.col(key).alias("__key"), F.when(F.col("ids").isNotNull(), "").alias("text"))
    return texts.unionByName(none).withColumnRenamed("__key", key)
