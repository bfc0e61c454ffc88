"""Commands: full, daily, stats, optimize, vacuum, search, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from contextlib import ExitStack, contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import ResultCache
from .config import Config
from .operators import sync as Y
from .operators.index import build_docs
from .operators.segment import HttpSegmenter, dictionary_segmenter
from .plans.snapshot import Store
from .progress import progress, rate_line
from .service import Service
from .session import local_session
from .sources import download as D
from .sources import lines as L
from .sources.zipped import read_zipped


def file_system(spark: SparkSession, path: str):
    """The file system of a path, which may be anywhere Spark reads, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything that a pattern matches, is there."""
    fs, at = file_system(spark, path)
    return bool(fs.globStatus(at))


@contextmanager
def lock(path: str, spark: SparkSession | None = None):
    """One sync at a time: the lock file is created or the call fails. With spark the path may be on any file system."""
    if spark is None:
        os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
    else:
        fs, at = file_system(spark, path)
        if not fs.createNewFile(at):
            raise FileExistsError(path)
    try:
        yield
    finally:
        if spark is None:
            os.remove(path)
        else:
            fs.delete(at, False)


def segmenter_of(spark: SparkSession, args, config: Config):
    if args.words:
        words = spark.read.option("lineSep", "\n").text(args.words).where("value <> ''").groupBy(F.col("value").alias("w")).count()
        return dictionary_segmenter(words)
    config.need("segmenter_url", "segmenter_user", "segmenter_password")
    return HttpSegmenter(config.segmenter_url, config.segmenter_user, config.segmenter_password, args.batch_size or config.batch_size)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="namelode", description=__doc__)
    top.add_argument("--index", default=None, help="folder of the index, on any file system")
    top.add_argument("--cpus", default="*")
    verbs = top.add_subparsers(dest="verb", required=True)
    full = verbs.add_parser("full", help="build an index from a list")
    full.add_argument("--file", "--input", help="list, folder or pattern; without it the zipped list is read from the web")
    full.add_argument("--download", action="store_true", help="download the list even if a file is given")
    full.add_argument("--commit-interval", type=int, default=0, help="publish after so many lines; 0: once, at the end")
    daily = verbs.add_parser("daily", help="apply removals and additions; a file that does not exist is passed over")
    daily.add_argument("--add", "--adds")
    daily.add_argument("--remove", "--removes")
    daily.add_argument("--download", action="store_true", help="download the day's lists")
    for verb in (full, daily):
        verb.add_argument("--words", help="a file of words, for splitting labels without a service")
        verb.add_argument("--batch-size", type=int, help="labels a call of the service")
    verbs.add_parser("stats")
    verbs.add_parser("optimize", help="merge all parts into one")
    vacuum = verbs.add_parser("vacuum", help="delete what no recent snapshot names, and what failed jobs left")
    vacuum.add_argument("--keep", type=int, default=2)
    vacuum.add_argument("--age-hours", type=float, default=24, help="only what is older goes, for a search or sync may be running")
    search = verbs.add_parser("search")
    search.add_argument("q")
    search.add_argument("--tld")
    search.add_argument("--limit", type=int, default=50)
    search.add_argument("--min-match", type=int)
    serve = verbs.add_parser("serve", help="answer over HTTP")
    serve.add_argument("--port", type=int, default=3000)
    return top


def build(store: Store, lines: DataFrame, segmenter, interval: int) -> None:
    """One publication, or one for every ``interval`` lines in their order."""
    if interval < 1:
        store.build(build_docs(lines, segmenter))
        return
    store.clear()
    batched = L.batch_ids(lines, "doc_seq", interval)
    for b in range((batched.agg(F.max("batch")).head()[0] or 0) + 1):
        store.append(build_docs(batched.where(F.col("batch") == b).drop("batch"), segmenter))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = Config.from_env()
    path = args.index or config.index_path
    path = path if "://" in path else os.path.abspath(path)
    spark = local_session(args.cpus)
    store = Store(spark, path)
    started = time.perf_counter()
    if args.verb == "full":
        web = not args.file or args.download
        raw = read_zipped(spark, D.list_url(config, D.ListKind.FULL)) if web else L.across_files(L.read_lines(spark, args.file))
        with store.staged(raw) if web else nullcontext(raw) as own, progress(spark, "full build"):
            build(store, L.scan(own).select(F.col("line_no").alias("doc_seq"), "s"), segmenter_of(spark, args, config), args.commit_interval)
        n, seconds = store.count(), time.perf_counter() - started
        print(rate_line(n, seconds), file=sys.stderr)
        print(json.dumps({"indexed": n, "seconds": seconds, "per_second": n / seconds}))
    elif args.verb == "daily":
        listed = {"add": D.ListKind.DAILY_UPDATE, "remove": D.ListKind.DAILY_REMOVE}
        with ExitStack() as held:
            held.enter_context(lock(f"{path}/.sync.lock", spark))
            held.enter_context(progress(spark, "daily sync"))

            def read(kind: str) -> DataFrame:
                """The lines of a list: from the web, or of the files that are there."""
                if args.download:
                    return held.enter_context(store.staged(read_zipped(spark, D.list_url(config, listed[kind])))).select("line_no", "raw")
                path = getattr(args, kind)
                if path and exists(spark, path):
                    return L.across_files(L.read_lines(spark, path)).select("line_no", "raw")
                return spark.createDataFrame([], "line_no long, raw string")

            change = Y.delta(read("add"), read("remove"), segmenter_of(spark, args, config), store.next_seq())
            counts = store.sync(change) | Y.requested(change)
        print(json.dumps(counts | {"seconds": time.perf_counter() - started}))
    elif args.verb == "stats":
        print(json.dumps(Service(spark, path).stats()))
    elif args.verb == "optimize":
        store.optimize()
    elif args.verb == "vacuum":
        print(json.dumps({"deleted": store.vacuum(args.keep, args.age_hours * 3600)}))
    elif args.verb == "serve":
        from .http import server

        server(Service(spark, path, ResultCache(config.cache_entries, config.cache_ttl)), args.port).serve_forever()
    else:
        print(json.dumps(Service(spark, path).search(args.q, args.tld, args.limit, args.min_match)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
