"""One consistent form for texts that look the same but differ in their characters."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from papyra.operators.skew import heavy_keys, salted_left_join
from papyra.session import Cut

# Letters of other scripts drawn like Latin ones, each line the letters and what they look like: those of the
# public confusables table of Unicode (UTS #39) whose shape is that of one Latin letter, without letters that merely resemble one.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϳ": "j", "ϲ": "c", "Ϲ": "C", "ν": "v",
    # Armenian
    "օ": "o", "Օ": "O", "Տ": "S", "Լ": "L", "հ": "h", "ս": "u", "զ": "q", "ց": "g",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Coptic
    "Ⲟ": "O", "ⲟ": "o", "Ⲥ": "C", "ⲥ": "c", "Ⲣ": "P", "ⲣ": "p", "Ⲭ": "X", "ⲭ": "x", "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T",
}
# Hyphens drawn like the hyphen-minus.
HYPHENS = "‐‑⁃﹣－"
# Code points that print nothing although they are neither format nor control characters: joiners, fillers, variation selectors (first, last).
SILENT = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
# Compatibility decompositions that change the looks: raised or lowered signs, other fonts, circles, fractions.
VISIBLE_KINDS = ("<super>", "<sub>", "<font>", "<circle>", "<fraction>")
# Letters whose compatibility form has another shape: long s, symbol forms of Greek letters.
VISIBLE_LETTERS = "ſϐϑϒϕϖϰϱϵ"
#: Characters that need no look at the table: printable ASCII, tab and line breaks.
PLAIN = r"\x20-\x7E\n\r\t"


def is_silent(cp: int) -> bool:
    c = chr(cp)
    return any(a <= cp <= b for a, b in SILENT) or (unicodedata.category(c) in ("Cf", "Cc") and c not in "\n\r\t؀؁؂؃؄؅۝܏࣢")


def parts(c: str) -> str:
    """What a character looks like, as fully decomposed characters of the consistent form; '' if it prints nothing."""
    if is_silent(ord(c)):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    if c in HYPHENS:
        return "-"
    rule = unicodedata.decomposition(c)
    if rule and c not in VISIBLE_LETTERS and not rule.startswith(VISIBLE_KINDS):
        return "".join(parts(chr(int(x, 16))) for x in rule.split() if x[0] != "<")
    if "가" <= c <= "힣":
        return unicodedata.normalize("NFD", c)
    return LOOKALIKES.get(c, c)


@functools.cache
def appearance_rows() -> list[tuple[str, list[str], list[int]]]:
    """(character, its parts, their combining classes) of every character that isn't simply itself.

    Built by rule from the Unicode character database; bounded by the number of code points (about 17,000 rows), so it may
    be broadcast whatever the corpus.
    """
    rows = []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF or 0xE000 <= cp <= 0xF8FF or cp >= 0xF0000 or 0x3400 <= cp <= 0x9FFF:
            continue
        c = chr(cp)
        p = parts(c)
        if p != c or unicodedata.combining(c):
            rows.append((c, list(p), [unicodedata.combining(x) for x in p]))
    for cp in [*range(0x20), 0x7F]:
        if chr(cp) not in "\n\r\t":
            rows.append((chr(cp), [], []))
    return rows


@F.pandas_udf(T.StringType())
def recompose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def consistent_pieces(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """``piece, form`` for a table of distinct ``piece`` strings.

    Each piece is exploded to positioned code points, which are joined with the broadcast table of parts; combining marks
    are ordered by class within their cluster (a starter and what follows it), the cluster being counted by a running sum;
    then the piece is rebuilt and recomposed. A zero-width joiner between two pictographs stays: there it draws one sign.
    """
    table = spark.createDataFrame(appearance_rows(), "ch string, parts array<string>, classes array<int>")
    points = pieces.select("piece", F.posexplode(F.split("piece", "")).alias("i", "ch")).where("ch != ''")
    order = Window.partitionBy("piece").orderBy("i")
    before, after = F.lag("ch", 1).over(order), F.lead("ch", 1).over(order)
    before = F.when(before == "\ufe0f", F.lag("ch", 2).over(order)).otherwise(before)
    picture = lambda c: F.coalesce(c.rlike(r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]"), F.lit(False))
    joins = F.col("joins")
    both = points.withColumn("joins", (F.col("ch") == "\u200d") & picture(before) & picture(after)).join(F.broadcast(table), "ch", "left")
    own = F.when(F.col("parts").isNull() | joins, F.array("ch")).otherwise(F.col("parts"))
    classes = F.when(F.col("parts").isNull() | joins, F.array(F.lit(0))).otherwise(F.col("classes"))
    flat = both.select("piece", "i", F.posexplode(F.arrays_zip(own.alias("p"), classes.alias("c"))).alias("j", "x")).select("piece", "i", "j", "x.p", "x.c")
    run = Window.partitionBy("piece").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, 0)
    flat = flat.withColumn("cluster", F.sum(F.when(F.col("c") == 0, 1).otherwise(0)).over(run))
    listed = F.sort_array(F.collect_list(F.struct("cluster", "c", "i", "j", "p")))
    forms = flat.groupBy("piece").agg(F.array_join(F.transform(listed, lambda x: x["p"]), "").alias("form"))
    return pieces.join(forms, "piece", "left").select("piece", recompose(F.coalesce("form", F.lit(""))).alias("form"))


def consistent_form(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, form``: every text in its consistent form, by which texts that look the same compare equal.

    Printable ASCII looks like itself, so only runs of other characters, each with the plain character before it (it may
    carry their marks), are sent through the table, every distinct run once. Runs are joined back (salted, as one may hold
    a third of them) and the text is rebuilt from its positioned pieces.

    A key has one text; rows repeated exactly count once, and rows without key are left out. A null text has a null form,
    an empty one the empty form. Very long texts are handled like others: a text is one row before and after. Columns other
    than the two are not read and not returned.
    """
    return _forms(spark, docs, key, text).select(F.col("__key").alias(key), "form")


def _forms(spark: SparkSession, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``__key, form, raw``: the consistent form, and a 256-bit digest of the text as stored."""
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where("__key is not null")
    special, raw = F.col("__text").rlike(f"[^{PLAIN}]"), F.unhex(F.sha2("__text", 256))
    plain = rows.where(F.col("__text").isNull() | ~special).select("__key", F.col("__text").alias("form"), raw.alias("raw")).distinct()
    split = F.regexp_extract_all("__text", F.lit(f"[{PLAIN}]?[^{PLAIN}]+|[{PLAIN}]+(?![^{PLAIN}])"), F.lit(0))
    at = rows.where(special).select("__key", raw.alias("raw"), F.posexplode(split).alias("pos", "piece"))
    at = at.withColumn("raw", F.when(F.col("pos") == 0, F.col("raw")))  # once a text is enough
    odd = at.where(F.col("piece").rlike(f"[^{PLAIN}]"))
    counts = Cut(spark, "pieces")(odd.groupBy("piece").agg(F.count(F.lit(1)).alias("n")))
    forms = consistent_pieces(spark, counts.select("piece"))
    done = salted_left_join(odd, forms, ["piece"], F.col("__key"), heavy=heavy_keys(counts, ["piece"], counted="n")).select("__key", "pos", "form", "raw")
    pieces = done.unionByName(at.where(~F.col("piece").rlike(f"[^{PLAIN}]")).select("__key", "pos", F.col("piece").alias("form"), "raw"))
    whole = pieces.groupBy("__key").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("pos", "form"))), lambda x: x["form"]), "").alias("form"), F.max("raw").alias("raw"))
    return plain.unionByName(whole)


def lookalike_classes(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, cls, raw``: every document with any visible sign, the digest of its consistent form and that of its text as stored. Documents of one class look the same."""
    forms = _forms(spark, docs, key, text).where(F.col("form").rlike(r"\S"))
    return forms.select(F.col("__key").alias(key), F.unhex(F.sha2("form", 256)).alias("cls"), "raw")


def lookalike_pairs(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key_a, key_b`` (a < b): documents whose texts differ as stored but have the same consistent form.

    Null texts, and texts without any visible sign, are no cases. Exact copies of a text are no pair among themselves.
    Distinct texts are paired within their class first, each once; only then are both sides expanded to the documents that
    hold them, so copies cost as much as the pairs they are in. Texts with many copies are salted on either side.
    """
    seen = Cut(spark, "forms")(lookalike_classes(spark, docs, key, text))
    texts = seen.groupBy("cls", "raw").agg(F.count(F.lit(1)).alias("n"))
    mixed = texts.groupBy("cls").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("cls")
    texts = Cut(spark, "texts")(texts.join(mixed, "cls", "left_semi"))
    a, b = texts.select("cls", F.col("raw").alias("raw_a")), texts.select("cls", F.col("raw").alias("raw_b"))
    pairs = salted_left_join(a, b, ["cls"], F.col("raw_a")).where("raw_a < raw_b").select("raw_a", "raw_b")
    members = seen.join(texts.select("raw"), "raw", "left_semi")
    heavy = heavy_keys(texts, ["raw"], counted="n")

    def expanded(rows: DataFrame, side: str) -> DataFrame:
        holders = members.select(F.col("raw").alias(f"raw_{side}"), F.col(key).alias(f"key_{side}"))
        return salted_left_join(holders, rows.withColumn("met", F.lit(True)), [f"raw_{side}"], F.col(f"key_{side}"), heavy=heavy.withColumnRenamed("raw", f"raw_{side}")).where("met").drop("met")

    both = expanded(expanded(pairs, "a").select("key_a", "raw_b"), "b")
    return both.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
