"""Command line of the jobs. A failed check ends with exit code 1."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark import jobs
from tidemark.model import CURATED, ENTITIES, LAYERS, QUARANTINE_TABLE
from tidemark.operators import quality
from tidemark.session import Settings, logger, session, settings
from tidemark.sources import fixtures, log
from tidemark.sources.store import Store
from tidemark.streaming import jobs as streams


def _arguments(given: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="python -m tidemark.jobs", description=__doc__)
    top.add_argument("--settings", help="a settings file")
    commands = top.add_subparsers(dest="job", required=True)

    def stream(name: str, about: str, checkpoint: str) -> argparse.ArgumentParser:
        made = commands.add_parser(name, help=about)
        made.add_argument("--once", action="store_true", help="take what is there and stop")
        made.add_argument("--ddl", help="a script of SQL statements to run first")
        made.add_argument("--checkpoint-name", default=checkpoint, help="folder of the checkpoint below the base")
        return made

    bronze = stream("bronze", "take the log into the raw tables", "bronze_ingestion")
    bronze.add_argument("--log", help="a folder of Parquet files with the broker's columns, instead of the broker")
    incremental = stream("incremental", "merge raw rows into a current table", "")
    incremental.add_argument("--entity", choices=[e.name for e in CURATED], default="orders")
    incremental.add_argument("--quarantine", action="store_true", help="write stale events to the streaming quarantine")
    rebuild = commands.add_parser("rebuild", help="write current, history and quarantine anew")
    rebuild.add_argument("entity", nargs="*", help="all, unless named")
    rebuild.add_argument("--invalid", action="store_true", help="quarantine events without a usable image too")
    commands.add_parser("marts", help="write the marts anew")
    checks = commands.add_parser("checks", help="run the checks")
    checks.add_argument("--source", help="a folder with the source tables as Parquet, instead of the database")
    count = commands.add_parser("counts", help="rows of the tables")
    count.add_argument("layer", nargs="*", default=list(LAYERS))
    ddl = commands.add_parser("ddl", help="create the tables in the session's catalog, or print the script")
    ddl.add_argument("--print", action="store_true", dest="show")
    ddl.add_argument("--using", default="parquet")
    ddl.add_argument("--catalog", default="")
    smoke = commands.add_parser("smoke", help="namespaces, and the first records of the log")
    smoke.add_argument("--log")
    generate = commands.add_parser("generate", help="write a change log derived from star-schema tables")
    generate.add_argument("tables", help="folder of the tables")
    generate.add_argument("log", help="folder to write")
    vacuum = commands.add_parser("vacuum", help="remove old snapshots")
    vacuum.add_argument("--keep", type=int, default=2)
    return top.parse_args(given)


def _log(spark: SparkSession, conf: Settings, path: str | None, stream: bool) -> DataFrame:
    if path:
        return log.file_stream(spark, path) if stream else log.file_batch(spark, path)
    return log.broker_stream(spark, conf) if stream else log.broker_batch(spark, conf)


def main(given: list[str] | None = None, spark: SparkSession | None = None, conf: Settings | None = None) -> int:
    args = _arguments(given)
    conf = conf or settings(args.settings)
    spark = spark or session(conf, args.job)
    say, store = logger(args.job), Store(spark, conf.tables)
    checkpoint = lambda name: conf.under(conf.checkpoints, name)
    if getattr(args, "ddl", None):
        store.run_script(Path(args.ddl).read_text())
    match args.job:
        case "bronze":
            streams.ingest(_log(spark, conf, args.log, True), store, checkpoint(args.checkpoint_name), args.once).awaitTermination()
        case "incremental":
            entity = ENTITIES[args.entity]
            name = args.checkpoint_name or f"{entity.current_table}_incremental"
            table = f"{QUARANTINE_TABLE}_stream" if args.quarantine else None
            streams.maintain_current(streams.raw_stream(store, entity), entity, store, checkpoint(name), args.once, quarantine_table=table).awaitTermination()
        case "rebuild":
            if unknown := set(args.entity) - {e.name for e in CURATED}:
                say.error("no such entity: %s", ", ".join(sorted(unknown)))
                return 2
            for name, rows in jobs.rebuild(store, [e for e in CURATED if not args.entity or e.name in args.entity], invalid=args.invalid).items():
                say.info("%s: %s", name, rows)
        case "marts":
            jobs.create_tables(store, ["silver"])
            jobs.build_marts(store)
            _tell(say, jobs.counts(store, "gold"))
        case "checks":
            names = [e.name for e in CURATED] + ["order_items"]
            source = {n: spark.read.parquet(f"{args.source}/{n}.parquet") for n in names} if args.source else log.source_tables(spark, names, conf.jdbc)
            rows = jobs.report(store, source).collect()  # 24 rows
            for r in rows:
                say.info("%s %s observed=%s expected=%s (%s)", r.status, r.name, r.observed, r.expected, r.details)
            bad = [r.name for r in rows if r.status == "FAIL"]
            say.info("checks total=%s failed=%s", len(rows), len(bad))
            if bad:
                print("\n".join(bad), file=sys.stderr)
                return 1
        case "counts":
            for layer in args.layer:
                _tell(say, jobs.counts(store, layer))
        case "ddl":
            for layer in LAYERS:
                script = jobs.ddl(layer, args.catalog, args.using)
                print(script) if args.show else store.run_script(script)
        case "smoke":
            say.info("tables=%s checkpoints=%s brokers=%s", conf.tables, conf.checkpoints, conf.brokers)
            spark.sql("CREATE NAMESPACE IF NOT EXISTS system_check")
            say.info("namespaces=%s", [r[0] for r in spark.sql("SHOW NAMESPACES").collect()])
            records = _log(spark, conf, args.log, False)
            say.info("schema=%s rows=%s", records.schema.simpleString(), records.count())
            jobs.preview(records).show(truncate=False)
        case "generate":
            fixtures.change_log(spark, args.tables).write.mode("overwrite").parquet(args.log)
        case "vacuum":
            for name in jobs.TABLES:
                if store.exists(name):
                    say.info("%s: %s folders removed", name, store.vacuum(name, args.keep))
    return 0


def _tell(say, found: DataFrame) -> None:
    for r in found.collect():
        say.info("%s count=%s", r.table_name, r.n)


if __name__ == "__main__":
    sys.exit(main())
