"""Command line: python -m papyra.cli COMMAND ...; tables live in the folder --store."""

from __future__ import annotations

import argparse
import sys
from datetime import date

from pyspark.sql import DataFrame, functions as F

from papyra import jobs as whole, stats
from papyra.console import run_sql
from papyra.functions.encoder import hashing_encoder
from papyra.functions.text import snippet
from papyra.operators import graph, search
from papyra.registry import DEFAULT
from papyra.session import build_session, clear_cuts
from papyra.sources.biology import compound_crosswalk_from_files
from papyra.sources.papers import article_papers, snapshot_papers
from papyra.store import Store
from papyra.streaming import jobs


def words(s: str | None) -> list[str] | None:
    return [x.strip() for x in s.split(",") if x.strip()] if s else None


REPLY = "paperId string, externalIds map<string,string>, citationCount long, referenceCount long, references array<struct<paperId:string,externalIds:map<string,string>,title:string>>, citations array<struct<paperId:string,externalIds:map<string,string>,title:string>>"


def stored_replies(spark, path: str):
    """A source of citation replies out of files: those that answer the identifiers asked for."""
    rows = spark.read.schema(REPLY).json(path)
    return lambda asked, namespace: rows.join(asked.select("identifier"), F.try_element_at("externalIds", F.lit(namespace)) == F.col("identifier"), "left_semi")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="papyra", description=__doc__)
    p.add_argument("--store", default="papyra-store")
    p.add_argument("--log", default=None, help="run log folder")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("backload", "backload-pubmed"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--only", help="category prefixes or MeSH names, comma-separated")
        c.add_argument("--start-date", type=date.fromisoformat)
        c.add_argument("--end-date", type=date.fromisoformat)
        c.add_argument("--limit", type=int)
    for name in ("fetch-daily", "fetch-daily-pubmed"):
        c = sub.add_parser(name, help="records published since the last run, out of delivered files")
        c.add_argument("path")
        c.add_argument("--only", help="category prefixes or MeSH names, comma-separated")
        c.add_argument("--today", type=date.fromisoformat, default=date.today())
    c = sub.add_parser("backload-pubmed-api", help="history in date windows, the newest first; goes on where the last run ended")
    c.add_argument("path")
    c.add_argument("--only")
    c.add_argument("--start-date", type=date.fromisoformat, default=date(1900, 1, 1))
    c.add_argument("--end-date", type=date.fromisoformat, default=date.today())
    c.add_argument("--limit", type=int)
    c.add_argument("--window", type=int, default=9500)
    c = sub.add_parser("enrich", help="citation data out of files of replies, JSON lines")
    c.add_argument("path")
    c.add_argument("--limit", type=int)
    c = sub.add_parser("daily", help="both daily fetches, enrichment and mentions, in this order; what has no path is left out")
    for name in ("arxiv", "pubmed", "replies", "annotations"):
        c.add_argument(f"--{name}")
    c.add_argument("--today", type=date.fromisoformat, default=date.today())
    sub.add_parser("backfill-embeddings")
    c = sub.add_parser("init-db")
    c.add_argument("schema")
    c = sub.add_parser("runs")
    c.add_argument("--job")
    c.add_argument("--last", type=int, default=10)
    c = sub.add_parser("citations")
    c.add_argument("paper")
    c.add_argument("--direction", choices=["references", "citing", "both"], default="both")
    c.add_argument("--depth", type=int, default=1)
    for name in ("keyword", "semantic"):
        c = sub.add_parser(f"search-{name}")
        c.add_argument("query")
        c.add_argument("--top", type=int, default=10)
    c = sub.add_parser("stats")
    c.add_argument("what", choices=["overview", "rebuild", "cache", "count", "latest", "oldest", "most-cited", "top-authors", "types"])
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--sources", action="store_true", help="overview by source, which scans the papers")
    for name, paths in (("go-pathways", 1), ("disease-ontology", 1), ("reactome-pathways", 2), ("reactome-maps-to", 1), ("pubtator-mentions", 1)):
        c = sub.add_parser(f"bio-{name}")
        c.add_argument("paths", nargs=paths)
        if name == "reactome-pathways":
            c.add_argument("--compounds", help="pathway rows of compounds; needs the four crosswalk files")
            c.add_argument("--crosswalk", nargs=4, metavar=("NAMES", "ACCESSIONS", "HEADINGS", "CURATED"), help="headings: files, comma-separated")
            c.add_argument("--mappings")
    c = sub.add_parser("bio-check-releases", help="loads again what has a new version: NAME=VERSION=PATH[,PATH]")
    c.add_argument("sources", nargs="+")
    c = sub.add_parser("sql")
    c.add_argument("statement")
    c.add_argument("--write", action="store_true")
    c = sub.add_parser("query", help="a query of the catalogue over delivered tables")
    c.add_argument("name")
    c.add_argument("tables")
    return p


def run(args: argparse.Namespace, spark) -> DataFrame | dict | int | None:
    store = Store(spark, args.store)
    papers = lambda: store.read("Paper", DEFAULT.node("Paper").schema)
    match args.command:
        case "init-db":
            return whole.ensure_tables(spark, args.schema)
        case "backload":
            return whole.load_papers(store, snapshot_papers(spark, args.path, words(args.only), args.start_date, args.end_date, args.limit, delivered=True), "backload", args.log)
        case "backload-pubmed":
            return whole.load_papers(store, article_papers(spark, args.path, words(args.only), args.start_date, args.end_date, args.limit, delivered=True), "backload-pubmed", args.log)
        case "fetch-daily":
            return whole.fetch_daily(store, snapshot_papers(spark, args.path, words(args.only), delivered=True), "fetch-daily", args.today, args.log)
        case "fetch-daily-pubmed":
            return whole.fetch_daily(store, article_papers(spark, args.path, words(args.only), source="pubmed", delivered=True), "fetch-daily-pubmed", args.today, args.log, guarded=True)
        case "backload-pubmed-api":
            return whole.backload_windows(store, article_papers(spark, args.path, words(args.only), source="pubmed", delivered=True), "backload-pubmed-api", args.start_date, args.end_date, args.window, args.limit, args.log)
        case "enrich":
            return whole.enrich(store, stored_replies(spark, args.path), limit=args.limit, log=args.log)
        case "daily":
            steps = [
                ("fetch-daily", args.arxiv, lambda: whole.fetch_daily(store, snapshot_papers(spark, args.arxiv, delivered=True), "fetch-daily", args.today, args.log)),
                ("fetch-daily-pubmed", args.pubmed, lambda: whole.fetch_daily(store, article_papers(spark, args.pubmed, source="pubmed", delivered=True), "fetch-daily-pubmed", args.today, args.log, guarded=True)),
                ("enrich", args.replies, lambda: whole.enrich(store, stored_replies(spark, args.replies), log=args.log)),
                ("mentions", args.annotations, lambda: whole.load_mentions(store, args.annotations)),
            ]
            return whole.run_daily(store, [(name, step) for name, path, step in steps if path])
        case "backfill-embeddings":
            return whole.backfill_embeddings(store)
        case "runs":
            return jobs.read_runs(spark, args.log, args.job, args.last)
        case "citations":
            found = search.resolve_paper(papers(), spark.createDataFrame([(args.paper,)], "asked string")).first()
            if found is None or found.id is None:
                return None
            edges = store.read("CITES", DEFAULT.edges["CITES"].schema)
            if args.depth > 1:
                return graph.neighbourhood(edges, found.id, args.depth).orderBy("id").limit(100)
            ends = {"references": ["src"], "citing": ["dst"], "both": ["src", "dst"]}[args.direction]
            parts = [graph.neighbours(edges, papers(), found.id, e, "id", ["id", "title"], 50) for e in ends]
            return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        case "search-keyword":
            hits = search.keyword_search(papers(), args.query, "id", F.concat_ws(" ", "title", "abstract"), ~F.col("is_stub"), args.top)
            return hits.join(papers().select("id", "title", snippet(F.col("abstract")).alias("abstract")), "id").orderBy(F.desc("score"), "id")
        case "search-semantic":
            hits = search.semantic_search(papers().where("embedding is not null"), hashing_encoder([args.query])[0].tolist(), "id", "embedding", args.top, ~F.col("is_stub"))
            return hits.join(papers().select("id", "title"), "id").orderBy(F.desc("similarity"), "id")
        case "stats":
            return {
                "overview": lambda: stats.overview(store, args.sources),
                "rebuild": lambda: stats.rebuild(store),
                "cache": lambda: stats.refresh_cache(store).select("endpoints", "hints"),
                "count": lambda: papers().where("not is_stub").agg(F.count(F.lit(1)).alias("papers")),
                "latest": lambda: papers().where("published_date is not null").select("id", "title", "published_date").orderBy(F.desc("published_date"), "id").limit(args.limit),
                "oldest": lambda: papers().where("published_date is not null").select("id", "title", "published_date").orderBy("published_date", "id").limit(args.limit),
                "most-cited": lambda: papers().where("citation_count is not null").select("id", "title", "citation_count").orderBy(F.desc("citation_count"), "id").limit(args.limit),
                "top-authors": lambda: store.read("AUTHORED", DEFAULT.edges["AUTHORED"].schema).groupBy(F.col("src").alias("author")).agg(F.count(F.lit(1)).alias("papers")).orderBy(F.desc("papers"), "author").limit(args.limit),
                "types": lambda: spark.createDataFrame([(n, store.read(n, t.schema).count()) for n, t in DEFAULT.nodes.items()], "type string, n long"),
            }[args.what]()
        case "bio-go-pathways":
            return whole.load_process_ontology(store, *args.paths)
        case "bio-disease-ontology":
            return whole.load_disease_ontology(store, *args.paths)
        case "bio-reactome-pathways":
            walk = None
            if args.compounds:
                names, accessions, headings, curated = args.crosswalk
                walk = compound_crosswalk_from_files(spark, names, accessions, headings.split(","), curated)
            return whole.load_pathways(store, *args.paths, args.compounds, walk, args.mappings)
        case "bio-reactome-maps-to":
            return whole.load_pathway_mappings(store, *args.paths)
        case "bio-check-releases":
            given = [s.split("=", 2) for s in args.sources]
            load = {"go": whole.load_process_ontology, "reactome": whole.load_pathways, "disease_ontology": whole.load_disease_ontology}
            loaders = {name: (lambda name=name, paths=paths: load[name](store, *paths.split(","))) for name, _, paths in given}
            current = spark.createDataFrame([(name, version) for name, version, _ in given], "source string, version string")
            return {"loaded": stats.reingest_changed(store, current, loaders)}
        case "bio-pubtator-mentions":
            return whole.load_mentions(store, *args.paths)
        case "sql":
            store.register_views()
            return run_sql(spark, args.statement, not args.write)
        case "query":
            from papyra.plans.catalogue import QUERIES

            return QUERIES[args.name](spark, args.tables)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    spark = spark or build_session()
    out = run(args, spark)
    if isinstance(out, DataFrame):
        out.show(100, truncate=100)
    elif out is not None:
        print(out)
    clear_cuts(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
