"""Ask one or more songs from the command line.

``spark-submit -m kindred`` style use: ``python -m kindred <song path> [...] --root <folder>``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from kindred.functions.ids import normalise
from kindred.operators.lsh import EUCLIDEAN, approximate_search
from kindred.operators.store import Catalogue, gather
from kindred.plans import search as plans
from kindred.session import session
from kindred.sources.feature_files import load_tables
from kindred.sources.growing_store import extend, open_catalogue, rejects
from kindred.sources.tables import write_results

SERVED = {
    "rp": ["rp"], "rh": ["rh"], "bh": ["bh"], "notes": ["notes"], "chroma": ["chroma"], "mfcckl": ["mfcc", "skl", "js"],
}


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("kindred", description="rank all songs by similarity to the given ones")
    parser.add_argument("songs", nargs="+", help="song paths, as in the feature files; or the word build, which writes --store")
    parser.add_argument("--root", default=".", help="folder that holds features0, features1, ..")
    parser.add_argument("--store", default=None, help="folder of a stored catalogue, used instead of the feature files")
    parser.add_argument("--strategy", default="gathered", choices=["gathered", "separate", "refine", "prefilter", "lsh"])
    parser.add_argument("--features", default="all", help="a named subset, or distances joined by +")
    parser.add_argument("--stages", default="bh", choices=["bh", "chroma"], help="refine: which distance comes first")
    parser.add_argument("--top", type=int, default=None, help="keep the best rows only")
    parser.add_argument("--out", default=None, help="write the result here instead of showing it")
    parser.add_argument("--format", default="csv", choices=["csv", "parquet"])
    options = parser.parse_args(argv)
    if options.strategy == "separate" and options.store:
        parser.error("a stored catalogue is gathered; separate tables are read from --root")
    if options.songs == ["build"] and not options.store:
        parser.error("build needs --store")
    named = plans.SUBSETS.get(options.features, options.features.split("+"))
    if options.strategy == "lsh" and not any(n in EUCLIDEAN for n in named):
        parser.error(f"lsh needs one of {', '.join(EUCLIDEAN)}")
    return options


def catalogue(spark, options: argparse.Namespace):
    """The gathered store, from its folder or from the feature files."""
    if options.store:
        return open_catalogue(spark, options.store) or spark.read.parquet(options.store)
    tables = load_tables(spark, options.root)
    return gather([tables[t] for t in ("chroma", "mfcckl", "notes", "rp", "rh", "bh")], distinct=True)


def build(spark, options: argparse.Namespace) -> None:
    """Parse the files that the store does not hold yet, each once; beside it stand the lines that could not be used."""
    extend(spark, options.root, options.store)
    rejects(spark, options.store).write.mode("overwrite").parquet(f"{options.store.rstrip('/')}-rejects")


def run(spark, options: argparse.Namespace):
    """The result frame of a command line."""
    paths = spark.createDataFrame([(s,) for s in options.songs], "song string")
    queries = paths.select(normalise(F.col("song")).alias("id"))
    features = options.features.split("+") if "+" in options.features else options.features
    if isinstance(features, str) and features not in plans.SUBSETS:
        features = [features]
    if options.strategy == "separate":
        tables = load_tables(spark, options.root)
        return plans.search_tables([(tables[t], SERVED[t]) for t in SERVED], queries, features, k=options.top)
    store = catalogue(spark, options)
    result = None
    if options.strategy == "refine":
        named = plans.SUBSETS[features] if isinstance(features, str) else features
        stages = [n for n in (plans.BH_FIRST if options.stages == "bh" else plans.CHROMA_FIRST) if n in named]
        result = plans.refine(store, queries, stages)
    elif options.strategy == "prefilter":
        result = plans.prefilter(store, queries, features=features)
    elif options.strategy == "lsh":
        # Of all distances the three of the recorded approximate search, if no others are named.
        named = "notes_mfcc_rp" if features == "all" else features
        named = plans.SUBSETS[named] if isinstance(named, str) else named
        close = [n for n in named if n in EUCLIDEAN]
        rows = store.rows if isinstance(store, Catalogue) else store
        result = approximate_search(rows, queries, close, [n for n in named if n not in close])
    if result is not None:
        return result if options.top is None else plans.top_k(result, options.top, None).orderBy("query_id", *plans.order_columns())
    return plans.search(store, queries, features, k=options.top)


def main(argv: list[str] | None = None) -> None:
    options = arguments(argv)
    if options.songs == ["build"]:
        build(session(), options)
        return
    result = run(session(), options)
    if options.out:
        write_results(result, options.out, form=options.format)
    else:
        result.show(20, truncate=False)


if __name__ == "__main__":
    main()
