"""Scalar expressions: identifiers, names, dates, labels and search terms. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Identifier namespaces of papers, preferred first, and the column of each.
PAPER_IDENTIFIERS = {"arxiv": "arxiv_id", "pmid": "pmid", "s2": "s2_paper_id"}
# Evidence codes by preference; any other code, or none, ranks last.
EVIDENCE_RANK = {"TAS": 0, "IEA": 1}
EVIDENCE_OTHER = 99
# Delivery sources that count as one family.
SOURCE_FAMILY = {"arxiv": "arxiv", "kaggle": "arxiv", "pubmed": "pubmed", "pubmed_baseline": "pubmed"}
# Annotation types that become nodes, and the prefixes of their databases.
ANNOTATION_TYPES = {"Gene": "Gene", "Chemical": "Compound", "Species": "Organism", "Disease": "Disease"}
DATABASE_PREFIX = {"ncbi_gene": "ncbigene", "ncbi_mesh": "mesh", "ncbi_taxonomy": ""}
# English month names, as numbers.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """The value of a small fixed table; ``default`` (null) for what it lacks."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    got = F.try_element_at(pairs, c)
    return got if default is None else F.coalesce(got, default)


def given(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def canonical_id(arxiv: Column, pmid: Column, s2: Column) -> Column:
    """The paper's key: its first identifier by preference, prefixed; null if it has none (empty ones count as none)."""
    return F.coalesce(*[F.concat(F.lit(f"{ns}:"), given(c)) for ns, c in zip(PAPER_IDENTIFIERS, (arxiv, pmid, s2))])


def without_version(c: Column) -> Column:
    return F.regexp_replace(c, r"v\d+$", "")


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\n", " "))


def author_name(*words: Column) -> Column:
    """The given parts joined by one space; null if none is there."""
    return given(F.concat_ws(" ", *[given(F.trim(w)) for w in words]))


def snippet(c: Column, most: int = 400) -> Column:
    """At most ``most`` characters, cut at the last space and closed with an ellipsis if anything was left out."""
    cut = F.substring(c, 1, most)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(cut, r"[ \t\n\x0B\f\r][^ \t\n\x0B\f\r]*\z", ""), F.lit("…")))


def clip(c: Column, most: int = 45) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def display_id(arxiv: Column, pmid: Column, key: Column) -> Column:
    return F.coalesce(given(arxiv), given(pmid), key)


def node_label(name: Column, title: Column, *ids: Column) -> Column:
    return F.coalesce(given(name), given(title), *[i.cast("string") for i in ids])


def evidence_rank(c: Column) -> Column:
    return lookup(c, EVIDENCE_RANK, F.lit(EVIDENCE_OTHER))


def source_family(c: Column) -> Column:
    return lookup(c, SOURCE_FAMILY, c)


def search_terms(query: str) -> list[str]:
    """The words of a query, lower case, without the search syntax's special signs; each once, in order."""
    import re

    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def rfc_date(c: Column) -> Column:
    """The date of an RFC 2822 time stamp, its weekday optional; null if it is none."""
    return F.try_to_timestamp(F.trim(F.substring_index(c, ",", -1)), F.lit("d MMM yyyy HH:mm:ss z")).cast("date")


def published_date(year: Column, month: Column, day: Column, medline: Column) -> Column:
    """A partial publication date: the year or the first four digits of the free date; month by name or number; what is
    missing is 1; a day that doesn't exist gives January 1 of the year; null without a year."""
    y = F.coalesce(year.try_cast("int"), F.substring(medline, 1, 4).try_cast("int"))
    m = F.coalesce(lookup(F.lower(F.substring(month, 1, 3)), MONTHS), month.try_cast("int"), F.lit(1))
    d = F.coalesce(day.try_cast("int"), F.lit(1))
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.coalesce(text.try_cast("date"), F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-01-01")).try_cast("date"))


def journal_reference(name: Column, year: Column, volume: Column, issue: Column, pages: Column) -> Column:
    """``Name. Year;Volume(Issue):Pages``, every piece optional; null if there is nothing."""
    def piece(before: str, c: Column, after: str = "") -> Column:
        return F.coalesce(F.concat(F.lit(before), given(c), F.lit(after)), F.lit(""))

    name_part = F.coalesce(given(name), F.lit(""))
    rest = F.concat(piece("", year), piece(";", volume), piece("(", issue, ")"), piece(":", pages))
    return given(F.when((name_part != "") & (rest != ""), F.concat(name_part, F.lit(". "), rest)).otherwise(F.concat(name_part, rest)))


def is_cas(c: Column) -> Column:
    return c.rlike(r"^\d{2,7}-\d{2}-\d$")


def without_comment(c: Column) -> Column:
    """An ontology value without its trailing comment."""
    return F.trim(F.substring_index(c, " !", 1))


def data_version(c: Column) -> Column:
    return given(F.regexp_extract(c, r"(?m)^data-version:\s*(\S+)", 1))


def week_start(c: Column) -> Column:
    return F.date_trunc("week", c)


def mention_name(kind: Column, text: Column, name: Column) -> Column:
    """The display name of an annotation: species go by the words of the text, others by the database's name."""
    return F.when(kind == "Species", F.coalesce(given(text), given(name))).otherwise(F.coalesce(given(name), given(text)))


def mention_key(kind: Column, database: Column, identifier: Column) -> Column:
    """The node key of an annotation: the database's prefix and the identifier; unknown databases are their own prefix, taxonomy ids stay bare."""
    prefix = lookup(database, DATABASE_PREFIX, database)
    return F.when(identifier.isNull(), None).otherwise(F.when(prefix == "", identifier).otherwise(F.concat(prefix, F.lit(":"), identifier)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers, in double precision; null if a length is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
