import re

from papyra.plans.catalogue import QUERIES


def brute(t):
    if t is None:
        return None, None
    cut = t[:400]
    at = max((m.start() for m in re.finditer(r"\s", cut, re.A)), default=len(cut))
    return t if len(t) <= 400 else cut[:at] + "…", t if len(t) <= 45 else t[:44] + "…"


def test_snippets_of_all_documents(spark, tmp_path):
    texts = [None, "", "kurz", "é" * 45, "é" * 46, "naïve cells " * 40, "исследовали клетки " * 30, "細胞" * 300, "𝒳 𝒴" * 200, "a b" * 200, "word " * 79 + "five\nand more", "x" * 399 + "\n" + "y" * 9, "x" * 500, "é" + " a" * 199 + "b", "é" + " a" * 199 + "bc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.snippet, r.clipped) for r in QUERIES["abstract_snippet"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
