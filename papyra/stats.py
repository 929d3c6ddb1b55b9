"""Stored counters of a graph, search hints and release states; each can be rebuilt from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from papyra.functions.text import source_family
from papyra.operators.dedupe import one_per_key
from papyra.operators.upsert import fold_stats, upsert_nodes
from papyra.registry import DEFAULT
from papyra.store import Store
from papyra.streaming.jobs import changed_releases

SUMS = ["papers", "enriched", "embedded", "stubs", "authors", "categories", "authored_edges", "category_edges", "citation_edges"]
COUNTERS = ", ".join(f"{c} long" for c in SUMS) + ", earliest date, latest date"
# Types in the order in which hints show them.
HINT_ORDER = ("Disease", "Gene", "Pathway", "Compound", "Organism")
CACHED = "endpoints map<string,array<struct<src:string,dst:string>>>, hints array<string>"


def node(store: Store, name: str) -> DataFrame:
    return store.read(name, DEFAULT.node(name).schema)


def edge(store: Store, name: str) -> DataFrame:
    return store.read(name, DEFAULT.edges[name].schema)


def measure(store: Store) -> DataFrame:
    """One row of counters from the tables, in one aggregate over all of them; enriched are those with a citation count, found or not are no matter."""
    full, one = F.coalesce(~F.col("is_stub"), F.lit(True)), lambda c: c.cast("long")
    dated = F.when(full, F.col("published_date"))
    rows = node(store, "Paper").select(
        one(full).alias("papers"), one(full & F.col("citation_count").isNotNull()).alias("enriched"), one(full & F.col("embedding").isNotNull()).alias("embedded"), one(~full).alias("stubs"), dated.alias("earliest"), dated.alias("latest"),
    )
    for table, column in ((node(store, "Author"), "authors"), (node(store, "Category"), "categories"), (edge(store, "AUTHORED"), "authored_edges"), (edge(store, "IN_CATEGORY"), "category_edges"), (edge(store, "CITES"), "citation_edges")):
        rows = rows.unionByName(table.select(F.lit(1).cast("long").alias(column)), allowMissingColumns=True)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS], F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))


def endpoints(store: Store) -> dict[str, list[tuple[str, str]]]:
    """The pairs of node types that the edges of each type join; types without edges have none."""
    out = {}
    for name, e in DEFAULT.edges.items():
        rows, (src, dst) = edge(store, name), e.ends
        kinds = [F.col("src_type") if len(src) > 1 else F.lit(src[0]), F.col("dst_type") if len(dst) > 1 else F.lit(dst[0])]
        out[name] = sorted(tuple(r) for r in rows.select(kinds[0].alias("a"), kinds[1].alias("b")).distinct().collect())
    return out


def hints(store: Store, order: tuple[str, ...] = HINT_ORDER, most: int = 4) -> list[str]:
    """The most mentioned name of each type, in the given order and up to ``most``; without mentions the one that most edges of any type come in at."""
    into = None
    for name, e in DEFAULT.edges.items():
        kind = F.col("dst_type") if len(e.ends[1]) > 1 else F.lit(e.ends[1][0])
        rows = edge(store, name).select(kind.alias("kind"), F.col("dst").alias("id"), F.lit(name == "MENTIONS").alias("mention"))
        into = rows if into is None else into.unionByName(rows)
    named = None
    for k in order:
        t = DEFAULT.node(k)
        rows = node(store, k).where("name is not null").select(F.lit(k).alias("kind"), F.col(t.key).alias("id"), "name")
        named = rows if named is None else named.unionByName(rows)
    counts = into.groupBy("kind", "id").agg(F.count_if("mention").alias("mentions"), F.count(F.lit(1)).alias("edges")).join(named, ["kind", "id"])
    best = one_per_key(counts, ["kind"], F.desc("mentions"), F.desc("edges"), F.asc("id"))
    got = {r.kind: r.name for r in best.collect()}  # one row a type
    return [got[k] for k in order if k in got][:most]


def rebuild(store: Store) -> DataFrame:
    """Measures everything anew and stores it; category counts too."""
    counts = edge(store, "IN_CATEGORY").groupBy(F.col("dst").alias("code")).agg(F.count(F.lit(1)).alias("paper_count"))
    zero = node(store, "Category").select("code").join(counts, "code", "left").select("code", F.coalesce("paper_count", F.lit(0)).alias("paper_count"))
    store.write("Category", upsert_nodes(node(store, "Category"), zero, "code", True).state)
    cached = store.spark.createDataFrame([({k: v for k, v in endpoints(store).items()}, hints(store))], CACHED)
    store.write("GraphStats", measure(store).join(cached, F.lit(True)))
    return store.read("GraphStats")


def counters(store: Store) -> DataFrame:
    """The stored row; on first use the counters are measured, and what is cached beside them is null until ``rebuild`` or ``refresh_cache``."""
    if not store.current("GraphStats"):
        store.write("GraphStats", measure(store).join(store.spark.createDataFrame([(None, None)], CACHED), F.lit(True)))
    return store.read("GraphStats")


def apply_delta(store: Store, delta: DataFrame) -> DataFrame:
    """Folds a one-row delta of counters into the stored ones; what is cached beside them stays until the next rebuild."""
    old = counters(store)
    folded = fold_stats(old, delta, SUMS, ["earliest"], ["latest"])
    store.write("GraphStats", folded.join(old.select("endpoints", "hints"), F.lit(True)))
    return store.read("GraphStats")


def raise_counters(store: Store, **by) -> None:
    """``apply_delta`` by the numbers given; the others stay. Counters must have been there before the change, see ``counters``."""
    names = [*SUMS, "earliest", "latest"]
    row = tuple(by.get(n) for n in names)
    apply_delta(store, store.spark.createDataFrame([row], COUNTERS)).count()


def refresh_cache(store: Store) -> DataFrame:
    """Measures only the cached end points and hints anew; counters stay."""
    old = counters(store)
    cached = store.spark.createDataFrame([({k: v for k, v in endpoints(store).items()}, hints(store))], CACHED)
    store.write("GraphStats", old.drop("endpoints", "hints").join(cached, F.lit(True)))
    return store.read("GraphStats")


def overview(store: Store, by_source: bool = False) -> DataFrame:
    """``what, value``: the counters, the shares enriched and embedded, and the most common category, all from stored rows; ``by_source`` adds a count per source family, which scans the papers."""
    share = lambda c: F.concat(F.format_number(F.col(c), 0), F.when(F.col("papers") > 0, F.concat(F.lit(" ("), F.round(F.col(c) * 100 / F.col("papers")).cast("int"), F.lit("%)"))).otherwise(""))
    plain = [(c, F.format_number(F.col(c), 0)) for c in SUMS if c not in ("enriched", "embedded")] + [("enriched", share("enriched")), ("embedded", share("embedded"))]
    lines = [F.struct(F.lit(n).alias("what"), v.alias("value")) for n, v in plain]
    lines += [F.struct(F.lit(n).alias("what"), F.col(n).cast("string").alias("value")) for n in ("earliest", "latest")]
    out = counters(store).select(F.explode(F.array(*lines)).alias("x")).select("x.*")
    top = node(store, "Category").where("paper_count is not null").orderBy(F.desc("paper_count"), "code").limit(1)
    out = out.unionByName(top.select(F.lit("top category").alias("what"), F.concat("code", F.lit(" ("), F.col("paper_count"), F.lit(")")).alias("value")))
    if by_source:
        full = node(store, "Paper").where("not is_stub").groupBy(source_family(F.col("source")).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count("enriched_at").alias("e"))
        out = out.unionByName(full.select(F.concat(F.lit("source "), F.coalesce("s", F.lit("-"))).alias("what"), F.concat(F.format_number("n", 0), F.lit(", "), F.format_number("e", 0), F.lit(" enriched")).alias("value")))
    return out


def placeholder(found: list[str], empty: str = "Search") -> str:
    return "e.g. " + ", ".join(found) if found else empty


def reingest_changed(store: Store, current: DataFrame, loaders: dict[str, Callable[[], object]]) -> list[str]:
    """Runs the loader of every source whose version changed, and saves a version only after its load went through. Returns the sources loaded."""
    done = []
    saved = store.read("release_state", "source string, version string")
    for source, _, version in sorted(tuple(r) for r in changed_releases(current, saved).collect()):  # one row a source
        if source not in loaders:
            continue
        loaders[source]()
        row = store.spark.createDataFrame([(source, version)], "source string, version string")
        store.write("release_state", upsert_nodes(store.read("release_state", "source string, version string"), row, "source", True).state)
        done.append(source)
    return done
