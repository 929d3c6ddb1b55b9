"""Biology reference files: ontologies, pathway tables, gene and compound crosswalk files, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from papyra.functions import text
from papyra.operators.crosswalk import compound_crosswalk
from papyra.operators.dedupe import best_evidence, evidence_accounting, one_per_key
from papyra.sources.papers import delivery


def stanzas(spark: SparkSession, path: str) -> DataFrame:
    """``lines`` of every term stanza of an ontology file; type definitions and the header are left out."""
    raw = spark.read.option("lineSep", "\n[").text(path)
    lines = F.split("value", r"\r?\n")
    return raw.select(lines.alias("lines")).where(F.rtrim(F.regexp_replace(F.col("lines")[0], r"^\[", "")) == "Term]")


def _values(tag: str) -> Column:
    """All values of a tag, in order."""
    return F.transform(F.filter("lines", lambda x: x.startswith(f"{tag}: ")), lambda x: F.trim(F.substr(x, F.lit(len(tag) + 3))))


def _last(tag: str) -> Column:
    """The last value of a tag that may be repeated."""
    return F.try_element_at(_values(tag), F.lit(-1))


def ontology_terms(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, namespace, is_obsolete, xrefs, parents`` of every term; comments after `` !`` are cut from parents."""
    parents = F.transform(_values("is_a"), lambda x: text.without_comment(x))
    return stanzas(spark, path).select(_last("id").alias("id"), _last("name").alias("name"), _last("namespace").alias("namespace"), F.coalesce(_last("is_obsolete") == "true", F.lit(False)).alias("is_obsolete"), _values("xref").alias("xrefs"), parents.alias("parents")).where("id is not null")


def process_pathways(terms: DataFrame) -> DataFrame:
    """Live biological processes with a name, as pathways."""
    return terms.where("not is_obsolete and namespace = 'biological_process' and name is not null and name != ''").select(F.col("id").alias("pathway_id"), "name", F.lit("GO").alias("source_db"))


def ontology_version(spark: SparkSession, path: str) -> str | None:
    row = spark.read.text(path, wholetext=True).select(text.data_version(F.col("value"))).first()
    return row[0] if row else None


def tsv(spark: SparkSession, path: str, columns: list[str], skip_header: bool = False) -> DataFrame:
    """Tab-separated files without quoting, as strings and ``pos``, which grows in file order (files by name); rows of another width are dropped, and with ``skip_header`` the first row of every file."""
    parts = F.split("value", "\t", -1)
    rows = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value"), delivery())
    if skip_header:
        first = rows.groupBy(F.col("delivered.file_path").alias("file")).agg(F.min("delivered").alias("first"))
        rows = rows.join(F.broadcast(first), F.col("delivered") == F.col("first"), "left_anti")  # one row a file
    return rows.where(F.size(parts) == len(columns)).select(F.col("delivered").alias("pos"), *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def headed_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file whose first line names the columns, a leading ``#`` cut off; rows of another width are dropped."""
    first = spark.read.text(path).first()
    names = first[0].rstrip("\r").lstrip("#").split("\t") if first else []
    return tsv(spark, path, names, skip_header=True)


PATHWAY_ROWS = ["identifier", "pathway_id", "url", "pathway_name", "evidence_code", "species"]


def listed_pathways(spark: SparkSession, path: str, species: str = "Homo sapiens") -> DataFrame:
    return tsv(spark, path, ["pathway_id", "name", "species"]).where(F.col("species") == species).select("pathway_id", "name", F.lit("Reactome").alias("source_db"))


def gene_memberships(spark: SparkSession, path: str, species: str = "Homo sapiens") -> tuple[DataFrame, DataFrame]:
    """(``gene_id, pathway_id, evidence_code`` with the best evidence, one row of accounting)."""
    rows = tsv(spark, path, PATHWAY_ROWS).where(F.col("species") == species).withColumn("gene_id", F.concat(F.lit("ncbigene:"), "identifier"))
    pair = ["gene_id", "pathway_id"]
    return best_evidence(rows, pair, "evidence_code", "pos").select(*pair, "evidence_code"), evidence_accounting(rows, pair)


def produced_compounds(spark: SparkSession, path: str, crosswalk: DataFrame, species: str = "Homo sapiens") -> tuple[DataFrame, DataFrame]:
    """(``pathway_id, compound_id, evidence_code``, accounting): rows whose compound the crosswalk ``accession, mesh`` lacks are dropped before duplicates are."""
    rows = tsv(spark, path, PATHWAY_ROWS).where(F.col("species") == species).withColumn("accession", F.concat(F.lit("CHEBI:"), "identifier"))
    joined = rows.join(crosswalk, "accession", "left").withColumnRenamed("mesh", "compound_id")
    pair = ["pathway_id", "compound_id"]
    return best_evidence(joined.where("compound_id is not null"), pair, "evidence_code", "pos").select(*pair, "evidence_code"), evidence_accounting(joined, pair, "compound_id")


def pathway_mappings(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst``: pathways and the ontology terms they map to; several may share a term."""
    return tsv(spark, path, ["src", "name", "dst"], skip_header=True).select("src", "dst")


def gene_tags(spark: SparkSession, path: str) -> DataFrame:
    """``tag, id``: locus tags and gene keys of a gene table; the last row of a tag counts."""
    from papyra.operators.crosswalk import tag_crosswalk

    rows = headed_tsv(spark, path).withColumn("gene", F.concat(F.lit("ncbigene:"), "GeneID"))
    return tag_crosswalk(rows, "LocusTag", "gene", [F.desc("pos")])


def heading_numbers(spark: SparkSession, path: str) -> DataFrame:
    """``cas, ui`` of heading records: registry numbers that stand before the record's identifier."""
    raw = spark.read.option("lineSep", "*NEWRECORD").text(path)
    head = F.substring_index("value", "\nUI = ", 1)
    ui = F.regexp_extract("value", r"(?m)^UI = (\S+)", 1)
    numbers = F.regexp_extract_all(head, F.lit(r"(?m)^RR = (\S+)"), F.lit(1))
    return raw.where(ui != "").select(F.explode(numbers).alias("cas"), ui.alias("ui")).where(text.is_cas(F.col("cas"))).distinct()


def curated_mappings(spark: SparkSession, path: str) -> DataFrame:
    """``accession, ui`` of a mapping file with a ``#`` block and a header; either side may be the compound."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    header = lines.where(F.col("value").startswith("subject_id")).first()
    if header is None:
        return spark.createDataFrame([], "accession string, ui string")
    names = header[0].rstrip("\r").split("\t")
    a, b = (F.lower(F.get(F.split("value", "\t"), F.lit(names.index(c)))) for c in ("subject_id", "object_id"))
    pairs = lines.where(~F.col("value").startswith("subject_id")).select(a.alias("a"), b.alias("b"))
    swap = F.col("a").startswith("mesh:")
    both = pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("c"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("m"))
    return both.where(F.col("c").startswith("chebi:") & F.col("m").startswith("mesh:")).select(F.upper("c").alias("accession"), F.upper(F.substr("m", F.lit(6))).alias("ui")).distinct()


def compound_crosswalk_from_files(spark: SparkSession, compounds: str, accessions: str, headings: list[str], mappings: str) -> DataFrame:
    """``accession, mesh`` from the compound tables, the heading files and the curated mappings."""
    names = headed_tsv(spark, compounds).select(F.col("id").alias("compound_id"), F.col("chebi_accession").alias("accession"))
    registry = headed_tsv(spark, accessions).where("type = 'CAS'").select("compound_id", F.col("accession_number").alias("cas")).distinct()
    heads = None
    for path in headings:
        one = heading_numbers(spark, path)
        heads = one if heads is None else heads.unionByName(one)
    return compound_crosswalk(names, registry, heads, curated_mappings(spark, mappings))


ANNOTATIONS = "documents array<struct<pmid:string,passages:array<struct<annotations:array<struct<infons:struct<type:string,identifier:string,normalized_id:string,database:string,valid:boolean,name:string>,text:string>>>>>>"


def annotation_mentions(spark: SparkSession, path: str) -> DataFrame:
    """``pmid, vertex_type, entity_id, name`` of annotation files: see ``normalise_annotations``.

    A file is one JSON object over several lines, so one task reads it whole: deliver large sets as many files.
    """
    docs = spark.read.schema(ANNOTATIONS).option("multiLine", True).json(path).select(F.explode("documents").alias("d"))
    flat = docs.select(F.col("d.pmid").alias("pmid"), F.posexplode(F.flatten(F.transform("d.passages", lambda p: F.coalesce(p["annotations"], F.array())))).alias("pos", "a"))
    return normalise_annotations(flat.select("pmid", "pos", "a.infons.*", "a.text"), "pmid", "pos").withColumnRenamed("doc", "pmid")


def normalise_annotations(rows: DataFrame, doc: str, position: str) -> DataFrame:
    """``doc, vertex_type, entity_id, name``: annotations of the four kept types that are valid, under their node keys, the first of each key in a document.

    ``rows``: the document, a position, and type, identifier, normalized_id, database, valid, name, text. The normalised id
    counts wherever it isn't null, so 0 does; a key that stays null drops the annotation.
    """
    kind = text.lookup(F.col("type"), text.ANNOTATION_TYPES)
    key = text.mention_key(F.col("type"), F.col("database"), F.coalesce("normalized_id", "identifier"))
    kept = rows.where(F.coalesce("valid", F.lit(False)) & kind.isNotNull() & key.isNotNull())
    named = kept.select(F.col(doc).alias("doc"), F.col(position).alias("__pos"), kind.alias("vertex_type"), key.alias("entity_id"), text.mention_name(F.col("type"), F.col("text"), F.col("name")).alias("name"))
    return one_per_key(named, ["doc", "vertex_type", "entity_id"], F.asc("__pos")).select("doc", "vertex_type", "entity_id", "name")
