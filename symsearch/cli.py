"""The command line: ``python -m symsearch COMMAND``."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from symsearch import config as config_
from symsearch import index as index_
from symsearch.operators import fileset, graph, output, tools
from symsearch.plans.lexer import QueryError


def session() -> SparkSession:
    builder = SparkSession.builder.appName("symsearch").config("spark.ui.showConsoleProgress", "false")
    if "SPARK_REMOTE" not in os.environ and not os.environ.get("MASTER"):
        builder = builder.master(os.environ.get("SYMSEARCH_MASTER", "local[*]")).config("spark.sql.shuffle.partitions", os.environ.get("SYMSEARCH_PARTITIONS", "8"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def positive(text: str) -> int:
    if (n := int(text)) < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="symsearch", description="Index the symbols of binaries and search them.")
    out.add_argument("-v", "--verbose", action="count", default=0)
    out.add_argument("--config", help="settings file")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=text)
        c.add_argument("-d", "--directory", default=".", help="directory of binaries")
        c.add_argument("--index-path", help="where the index is, in place of the cache")
        return c

    c = command("index", "bring the index up to date")
    c.add_argument("-f", "--files-from", help="file with a path on each line, - for standard input")
    c.add_argument("-c", "--use-compilation-database", action="store_true")
    c.add_argument("-e", "--exclude", action="append", default=[], metavar="GLOB")
    c.add_argument("-g", "--extra-glob", action="append", default=[], metavar="GLOB")
    c.add_argument("-r", "--reindex", action="store_true")
    c.add_argument("--delete", action="store_true", help="delete the index first")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("-o", "--option", action="append", default=[], metavar="KEY=VALUE", help="num_processes, demangle_names, index_relocations, min_symbol_size, use_dwarfdump")
    for name, text in (("search", "find symbols"), ("disass", "show the code of symbols"), ("find-definition", "show where symbols are defined")):
        c = command(name, text)
        c.add_argument("-n", "--num", type=positive, help="at most so many")
        c.add_argument("query", nargs="*")
        if name == "search":
            c.add_argument("-f", "--format", default="{basename}: {name}", help="json, sexp, or a Python format template")
    command("files", "list the files of the index")
    command("print-config", "print the settings")
    c = command("complete-query", "complete a query")
    c.add_argument("query", nargs="*")
    c = command("graph", "paths of references between symbols of two queries, as DOT")
    c.add_argument("start_query")
    c.add_argument("goal_query")
    c.add_argument("-n", "--num-routes", type=int, default=1, help="0: all")
    c.add_argument("-a", "--algorithm", choices=["BFS", "DFS", "ASTAR"], default="ASTAR", type=str.upper)
    c.add_argument("--json-progress", action="store_true")
    return out


def index_path(args: argparse.Namespace, make: bool = False) -> str:
    path = args.index_path or index_.find_index(args.directory)
    if path is None and make:
        path = index_.default_path(args.directory)
    if path is None:
        raise index_.DoesNotExistError(f"no index of {args.directory}: run the index command first")
    return path


def options_of(pairs: list[str], settings: config_.Indexing) -> index_.Options:
    out = index_.Options(settings.demangle_names, settings.index_relocations, settings.min_symbol_size, settings.use_dwarfdump)
    known = ("num_processes", "demangle_names", "index_relocations", "min_symbol_size", "use_dwarfdump")
    for pair in pairs:
        key, eq, value = pair.partition("=")
        key = key.replace("-", "_")
        if key not in known:
            raise ValueError(f"unknown option {key!r}, known: {', '.join(known)}")
        if isinstance(getattr(out, key), bool):
            yes = {"true": True, "1": True, "yes": True, "y": True, "": not eq, "false": False, "0": False, "no": False, "n": False}
            if value.lower() not in yes:
                raise ValueError(f"{key} must be true or false: {value!r}")
            setattr(out, key, yes[value.lower()])
        elif not value.isdigit():
            raise ValueError(f"{key} must be a number: {value!r}")
        else:
            setattr(out, key, int(value))
    return out


def run_index(spark: SparkSession, args: argparse.Namespace, settings: config_.Config) -> int:
    path = index_path(args, make=True) if not args.delete else args.index_path or index_.default_path(args.directory)
    if args.delete:
        for gone in index_.delete_index(path, dry_run=args.dry_run):
            print(f"{'would delete' if args.dry_run else 'deleted'} {'file' if gone.endswith('.json') else 'directory'} {gone}")
    files = None
    if args.files_from:
        with sys.stdin if args.files_from == "-" else open(args.files_from) as f:
            files = [line.rstrip("\n") for line in f if line.strip()]
    own = settings.indexing
    options = options_of(args.option, own)
    options.dwarfdump = settings.for_machine("default").dwarfdump
    done = index_.index_directory(
        spark, args.directory, path, options=options, files=files, extra_globs=(*own.extra_globs, *args.extra_glob),
        use_compilation_database=args.use_compilation_database, reindex=args.reindex, exclusions=(*own.exclude, *args.exclude), dry_run=args.dry_run,
    )
    if args.dry_run:
        for r in done.toLocalIterator():
            print(r.action, r.path)
        return 0
    for p, why in done.errors:
        logging.error("%s: %s", p, why)
    print(f"Changed files: {done.changed}\nDeleted files: {done.deleted}\nIndexed files: {done.files}\nIndexed symbols: {done.symbols}")
    for pattern, n in done.exclusions.items():
        print(f"Excluded by {pattern}: {n}")
    return 0


def run_search(index: index_.SymbolIndex, args: argparse.Namespace) -> int:
    found = index_.hits(index, " ".join(args.query), args.num)
    lines = output.as_json(found) if args.format == "json" else output.as_sexp(found) if args.format == "sexp" else output.as_text(found, args.format)
    for r in lines.toLocalIterator():
        print(r[0])
    stale = fileset.stale_counts(found).first()
    for n, what in ((stale.symbol_files, "have changed since they were indexed"), (stale.binary_files, "are older than their sources")):
        if n:
            logging.warning("%d files of these symbols %s", n, what)
    return 0


def run_graph(index: index_.SymbolIndex, args: argparse.Namespace) -> int:
    rows = index.symbols().withColumn("id", F.xxhash64("path", "section", "address", "name", "type"))
    starts = index.search(args.start_query).select(F.xxhash64("path", "section", "address", "name", "type").alias("start"))
    goals = index.search(args.goal_query).select(F.xxhash64("path", "section", "address", "name", "type").alias("goal"))
    say = (lambda **x: print(str(x).replace("'", '"'), file=sys.stderr)) if args.json_progress else (lambda **x: None)
    progress = graph.Progress(visited=lambda n: say(visited=n), found=lambda: say(found=1), done=lambda n, k: say(done=n, total=k))
    edges = graph.edges(rows)
    if args.algorithm == "DFS":
        # the walk leads from referrer to referrer, as the levels do
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        wanted = {r.start for r in starts.toLocalIterator()}
        found = []
        for r in goals.distinct().orderBy("goal").toLocalIterator():
            if path := graph.depth_first(back, r.goal, wanted):
                found.append((r.goal, path[-1], path[::-1]))
                progress.found()
            if args.num_routes and len(found) == args.num_routes:
                break
        routes = index.spark.createDataFrame(found, "goal long, start long, path array<long>")
    else:
        routes = graph.routes(edges, starts, goals, num_routes=args.num_routes, zero_hops=args.algorithm == "ASTAR", progress=progress)
    print(graph.dot(routes, rows, args.start_query, args.goal_query), end="")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(args.verbose, 2)], format="%(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    settings = config_.load(args.config).for_directory(args.directory)
    if args.command == "print-config":
        print(settings.to_toml(), end="")
        return 0
    try:
        spark = session()
        if args.command == "index":
            return run_index(spark, args, settings)
        with index_.SymbolIndex.open(spark, index_path(args), readonly=True) as index:
            if args.command == "search":
                return run_search(index, args)
            if args.command == "files":
                for r in index.all_files().orderBy("path").toLocalIterator():
                    print(r.path)
            elif args.command == "complete-query":
                for text in index.complete(" ".join(args.query)):
                    print(text)
            elif args.command == "graph":
                return run_graph(index, args)
            elif args.command == "find-definition":
                for r in tools.find_definitions(index_.hits(index, " ".join(args.query), args.num), settings).toLocalIterator():
                    print(f"{r.file}:{r.line}: {r['name']}")
            else:
                failed = False
                for _, text in tools.disassemble(index_.hits(index, " ".join(args.query), args.num), settings):
                    failed |= text is None
                    print(text or "", end="")
                return int(failed)
    except (QueryError, index_.IndexProblem, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
