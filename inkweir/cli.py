"""Thin command line over the tables of a folder; exit codes: 0 done, 1 nothing found or errors, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from inkweir.operators import views as V
from inkweir.session import get_spark


def _table(args: argparse.Namespace, name: str):  # noqa: ANN202
    return get_spark("inkweir", args.master).read.parquet(f"{args.data}/{name}.parquet")


def _show(df) -> int:  # noqa: ANN001
    n = 0
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
        n += 1
    return 0 if n else 1


def cmd_sources(args: argparse.Namespace) -> int:
    return _show(_table(args, "source_configs").orderBy("id").select("id", "name", "site", "region", "enabled", "list_url", "last_error"))


def cmd_query(args: argparse.Namespace) -> int:
    found = V.search(_table(args, "policies"), args.region, args.category, args.keyword, args.review)
    return _show(V.paged(found.select("id", "title", "wenhao", "region", "category_names", "review_status", "version"), args.limit, args.offset))


def cmd_stats(args: argparse.Namespace) -> int:
    t = lambda n: _table(args, n)
    _show(V.dashboard(t("source_configs"), t("policies"), t("fetch_records"), t("run_logs"), t("attachments")))
    return _show(V.category_counts(t("policies")))


def cmd_runs(args: argparse.Namespace) -> int:
    return _show(V.run_view(_table(args, "run_logs"), _table(args, "source_configs"), args.limit))


def cmd_show(args: argparse.Namespace) -> int:
    t = lambda n: _table(args, n)
    return _show(V.detail(t("policies"), t("attachments"), t("policy_sources"), t("source_configs"), args.id))


def cmd_export(args: argparse.Namespace) -> int:
    from inkweir.sources import sinks

    policies = V.search(_table(args, "policies"), args.region, args.category, args.keyword, args.review)
    if args.format == "csv":
        sinks.write_csv(policies, args.to)
    else:
        sinks.write_json(V.exported(policies, _table(args, "attachments"), _table(args, "policy_sources")), args.to)
    return 0


def cmd_evaluate(args: argparse.Namespace) -> int:
    from inkweir.operators.classify import evaluated, label_errors
    from inkweir.plans.catalogue import CODES
    from inkweir.sources.readers import labels

    p = _table(args, "policies").select("id", F.col("is_investment_policy").alias("relevance"), "category", F.col("classification_method").alias("method"))
    gold = labels(p.sparkSession, args.gold)
    if not _show(label_errors(gold, p, CODES)):
        return 2
    return _show(evaluated(gold, p))


def cmd_ingest(args: argparse.Namespace) -> int:
    from inkweir.sources.sinks import Versioned
    from inkweir.streaming.loop import schedule, single_writer, stream

    spark = get_spark("inkweir", args.master)
    store = Versioned(spark, args.store)

    def cycle() -> bool:
        q = stream(spark, args.pages, store, f"{args.store}/_checkpoint")
        q.awaitTermination()
        return q.exception() is None

    with single_writer(args.lock):
        return schedule(cycle, args.minutes, args.cycles)


def cmd_doctor(args: argparse.Namespace) -> int:
    from inkweir.sources.readers import settings

    s = settings(args.config, args.sources)
    print(json.dumps({"sources": [x.name for x in s.sources], "enabled": sum(x.enabled for x in s.sources), "model_configured": bool(s.model.get("base_url")), "chunk_chars": s.chunk_chars}, ensure_ascii=False))
    return 0 if s.model.get("base_url") else 1


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkweir", description=__doc__)
    p.add_argument("--data", default=".", help="folder of the tables")
    p.add_argument("--master", help="Spark master for local use")
    sub = p.add_subparsers(dest="command", required=True)
    search = argparse.ArgumentParser(add_help=False)
    for name in ("region", "category", "keyword", "review"):
        search.add_argument(f"--{name}", default="")
    sub.add_parser("sources").set_defaults(run=cmd_sources)
    q = sub.add_parser("query", parents=[search])
    q.add_argument("--limit", type=int, default=20)
    q.add_argument("--offset", type=int, default=0)
    q.set_defaults(run=cmd_query)
    sub.add_parser("stats").set_defaults(run=cmd_stats)
    r = sub.add_parser("runs")
    r.add_argument("--limit", type=int, default=20)
    r.set_defaults(run=cmd_runs)
    d = sub.add_parser("show")
    d.add_argument("id", type=int)
    d.set_defaults(run=cmd_show)
    e = sub.add_parser("export", parents=[search])
    e.add_argument("--format", choices=("csv", "json"), default="csv")
    e.add_argument("to")
    e.set_defaults(run=cmd_export)
    v = sub.add_parser("evaluate")
    v.add_argument("gold")
    v.set_defaults(run=cmd_evaluate)
    i = sub.add_parser("ingest")
    i.add_argument("--pages", required=True, help="folder in which page files arrive")
    i.add_argument("--store", required=True)
    i.add_argument("--lock", default="inkweir.lock")
    i.add_argument("--minutes", type=float, default=60)
    i.add_argument("--cycles", type=int)
    i.set_defaults(run=cmd_ingest)
    o = sub.add_parser("doctor")
    o.add_argument("--config", default="config.yaml")
    o.add_argument("--sources", default="sources.yaml")
    o.set_defaults(run=cmd_doctor)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
