"""Paper sources: snapshot JSON lines, article XML, API replies. All become the same paper columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from papyra.functions import text
from papyra.operators.dedupe import one_per_key

SNAPSHOT = "id string, title string, abstract string, categories string, authors_parsed array<array<string>>, versions array<struct<created:string>>, update_date string, doi string, `journal-ref` string, comments string"
#: The columns of every paper source.
COLUMNS = ["arxiv_id", "pmid", "s2_paper_id", "title", "abstract", "authors", "categories", "primary_category", "published_date", "updated_date", "doi", "journal_ref", "comments", "source"]


def in_range(c: Column, start: date | str | None, end: date | str | None) -> Column:
    """Whether a date lies in a range with open ends; a null date fails any bound."""
    out = F.lit(True)
    if start is not None:
        out = out & F.coalesce(c >= F.lit(str(start)).cast("date"), F.lit(False))
    if end is not None:
        out = out & F.coalesce(c <= F.lit(str(end)).cast("date"), F.lit(False))
    return out


def category_prefix(codes: Column, prefixes: list[str]) -> Column:
    """Whether any code is a prefix or below it: ``cs`` takes ``cs.CL``, not ``csx``."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | _below(codes, p)
    return hit


def _below(codes: Column, prefix: str) -> Column:
    return F.exists(codes, lambda c: (c == prefix) | c.startswith(prefix + "."))


def delivery() -> Column:
    """The place of a record in its delivery, as ``delivered``: files by name, then the order inside a file."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("delivered")


def snapshot_papers(spark: SparkSession, path: str, categories: list[str] | None = None, start=None, end=None, limit: int | None = None, delivered: bool = False) -> DataFrame:
    """Papers of a snapshot file of JSON lines (also gzipped). Blank lines are skipped; filters come before the limit. ``delivered`` adds the column of that name, which grows in the order of delivery."""
    raw = spark.read.schema(SNAPSHOT).json(path).select("*", delivery()).where("id is not null")
    codes = F.filter(F.split(F.coalesce("categories", F.lit("")), r"\s+"), lambda c: c != "")
    names = F.filter(F.transform("authors_parsed", lambda a: text.author_name(F.try_element_at(a, F.lit(2)), F.try_element_at(a, F.lit(1)))), lambda n: n.isNotNull())
    rows = raw.select(
        F.col("id").alias("arxiv_id"), F.lit(None).cast("string").alias("pmid"), F.lit(None).cast("string").alias("s2_paper_id"), text.one_line(F.col("title")).alias("title"), text.one_line(F.col("abstract")).alias("abstract"), names.alias("authors"),
        F.transform(codes, lambda c: F.concat(F.lit("arxiv:"), c)).alias("categories"), F.concat(F.lit("arxiv:"), F.try_element_at(codes, F.lit(1))).alias("primary_category"),
        text.rfc_date(F.get("versions", F.lit(0))["created"]).alias("published_date"), F.col("update_date").try_cast("date").alias("updated_date"),
        text.given(F.trim("doi")).alias("doi"), text.given(F.trim("journal-ref")).alias("journal_ref"), text.given(F.trim("comments")).alias("comments"), F.lit("kaggle").alias("source"), codes.alias("__codes"), "delivered",
    )
    if categories:
        rows = rows.where(category_prefix(F.col("__codes"), categories))
    rows = rows.where(in_range(F.col("published_date"), start, end)).select(*COLUMNS, *(["delivered"] if delivered else []))
    return rows if limit is None else rows.limit(limit)


HEADING = "struct<DescriptorName:struct<_VALUE:string,_UI:string,_MajorTopicYN:string>>"
ARTICLE = (
    "MedlineCitation struct<PMID:struct<_VALUE:string>,DateRevised:struct<Year:string,Month:string,Day:string>,"
    "Article:struct<Journal:struct<Title:string,ISOAbbreviation:string,JournalIssue:struct<Volume:string,Issue:string,PubDate:struct<Year:string,Month:string,Day:string,MedlineDate:string>>>,"
    "ArticleTitle:string,Pagination:struct<MedlinePgn:string>,ELocationID:array<struct<_VALUE:string,_EIdType:string>>,Abstract:struct<AbstractText:array<string>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,CollectiveName:string>>>>,"
    f"MeshHeadingList:struct<MeshHeading:array<{HEADING}>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>"
)


# The inline elements that titles and abstracts may hold; formulas in MathML have a prefix of their own.
INLINE = r"i|b|u|sup|sub|sc|em|strong|tt|DispFormula|InlineFormula|mml:[A-Za-z]+"


def markup_free(c: Column) -> Column:
    """Text without inline tags, trimmed; null if nothing is left.

    The reader has resolved the entities already, so a ``<`` may be a sign of the text: only tags of the known inline
    elements go (a text that spells such a tag out can't be told from one).
    """
    s = F.regexp_replace(c, rf"""</?(?:{INLINE})(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*/?>""", "")
    return text.given(F.trim(F.regexp_replace(s, r"\s+", " ")))


def mesh_headings(c: Column) -> Column:
    """The major headings, or all if none is major, as (code, name); those without identifier or text are left out."""
    found = F.coalesce(F.transform(c, lambda h: F.struct(h["DescriptorName"]["_UI"].alias("ui"), F.trim(h["DescriptorName"]["_VALUE"]).alias("name"), h["DescriptorName"]["_MajorTopicYN"].alias("major"))), F.array())
    usable = F.filter(found, lambda h: (h["ui"] != "") & (h["name"] != ""))
    major = F.filter(usable, lambda h: h["major"] == "Y")
    return F.transform(F.when(F.size(major) > 0, major).otherwise(usable), lambda h: F.struct(F.concat(F.lit("mesh:"), h["ui"]).alias("code"), h["name"].alias("name")))


def article_papers(spark: SparkSession, path: str | list[str], mesh_terms: list[str] | None = None, start=None, end=None, limit: int | None = None, source: str = "pubmed_baseline", delivered: bool = False) -> DataFrame:
    """Papers of article XML files (also gzipped); ``path`` may be a folder, a glob or files.

    Titles and abstract parts keep their text in order, without inline markup. MeSH terms filter on the names of the
    selected headings, apart from case. Articles without a PubMed id are dropped. ``heading_names`` are the names of the
    headings in ``categories``, one each; ``delivered`` adds the place in the delivery.
    """
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").option("attributePrefix", "_").schema(ARTICLE).load(path).select("*", delivery())
    m, a = F.col("MedlineCitation"), F.col("MedlineCitation.Article")
    issue, pub = a["Journal"]["JournalIssue"], a["Journal"]["JournalIssue"]["PubDate"]
    heads = mesh_headings(m["MeshHeadingList"]["MeshHeading"])
    first = lambda arr, test: F.try_element_at(F.filter(arr, test), F.lit(1))["_VALUE"]
    doi = F.coalesce(first(a["ELocationID"], lambda x: x["_EIdType"] == "doi"), first(F.col("PubmedData.ArticleIdList.ArticleId"), lambda x: x["_IdType"] == "doi"))
    people = F.filter(F.transform(a["AuthorList"]["Author"], lambda x: F.coalesce(text.author_name(x["ForeName"], x["LastName"]), text.given(F.trim(x["CollectiveName"])))), lambda n: n.isNotNull())
    revised = m["DateRevised"]
    rows = raw.select(
        F.lit(None).cast("string").alias("arxiv_id"), text.given(F.trim(m["PMID"]["_VALUE"])).alias("pmid"), F.lit(None).cast("string").alias("s2_paper_id"), markup_free(a["ArticleTitle"]).alias("title"),
        text.given(F.array_join(F.filter(F.transform(a["Abstract"]["AbstractText"], markup_free), lambda x: x.isNotNull()), " ")).alias("abstract"), F.coalesce(people, F.array().cast("array<string>")).alias("authors"),
        F.transform(heads, lambda h: h["code"]).alias("categories"), F.try_element_at(heads, F.lit(1))["code"].alias("primary_category"),
        text.published_date(pub["Year"], pub["Month"], pub["Day"], pub["MedlineDate"]).alias("published_date"),
        F.concat_ws("-", revised["Year"], F.lpad(revised["Month"], 2, "0"), F.lpad(revised["Day"], 2, "0")).try_cast("date").alias("updated_date"), text.given(F.trim(doi)).alias("doi"),
        text.journal_reference(F.coalesce(text.given(a["Journal"]["ISOAbbreviation"]), a["Journal"]["Title"]), pub["Year"], issue["Volume"], issue["Issue"], a["Pagination"]["MedlinePgn"]).alias("journal_ref"),
        F.lit(None).cast("string").alias("comments"), F.lit(source).alias("source"), F.transform(heads, lambda h: F.lower(h["name"])).alias("__names"), F.transform(heads, lambda h: h["name"]).alias("heading_names"), "delivered",
    ).where("pmid is not null")
    if mesh_terms:
        rows = rows.where(F.arrays_overlap("__names", F.array(*[F.lit(t.lower()) for t in mesh_terms])))
    rows = rows.where(in_range(F.col("published_date"), start, end)).select(*COLUMNS, *(["heading_names", "delivered"] if delivered else []))
    return rows if limit is None else rows.limit(limit)


def new_preprints(entries: DataFrame, since, most: int | None = 2000) -> DataFrame:
    """Entries ``id, published, ...`` published after ``since``, newest first; version endings are cut off the ids."""
    fresh = entries.withColumn("arxiv_id", text.without_version(F.col("id"))).where(F.col("published") > F.lit(since).cast("timestamp"))
    return fresh if most is None else fresh.orderBy(F.desc("published"), "arxiv_id").limit(most)


def match_citation_results(asked: DataFrame, replies: DataFrame, namespace: str) -> DataFrame:
    """``id, s2_paper_id, citation_count, reference_count, found``: one row for every asked paper ``id, identifier``.

    Replies (``paperId, externalIds, citationCount, referenceCount``; entries may be null) are matched by their external id,
    never by place, so a short reply does no harm; of several for one identifier the last counts. Papers without a reply are not found.
    """
    got = replies.where("externalIds is not null").withColumn("__at", F.monotonically_increasing_id()).select("__at", F.try_element_at("externalIds", F.lit(namespace)).alias("identifier"), F.col("paperId").alias("s2_paper_id"), F.col("citationCount").alias("citation_count"), F.col("referenceCount").alias("reference_count"), F.lit(True).alias("__found"))
    once = one_per_key(got.where("identifier is not null"), ["identifier"], F.desc("__at")).drop("__at")
    return asked.join(once, "identifier", "left").select("id", "s2_paper_id", "citation_count", "reference_count", F.coalesce("__found", F.lit(False)).alias("found"))


def usable_stubs(entries: Column) -> Column:
    """The entries of a reference list that have any of the three identifiers, as (arxiv_id, pmid, s2_paper_id, title)."""
    out = F.transform(entries, lambda e: F.struct(F.try_element_at(e["externalIds"], F.lit("ArXiv")).alias("arxiv_id"), F.try_element_at(e["externalIds"], F.lit("PubMed")).alias("pmid"), e["paperId"].alias("s2_paper_id"), e["title"].alias("title")))
    return F.filter(out, lambda s: F.coalesce(text.given(s["arxiv_id"]), text.given(s["pmid"]), text.given(s["s2_paper_id"])).isNotNull())
