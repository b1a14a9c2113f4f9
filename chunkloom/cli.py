"""The command line: ``python -m chunkloom.cli COMMAND``.

Exit codes: 0 done, 1 problems found or failure, 2 wrong use or configuration, 3 backend, 4 stale plan, 130 interrupted.
Commands that could send texts away, delete, or empty an index need a flag that says so, checked before anything is written.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime
from typing import Any

from .errors import ConfigError, LoomError
from .operators import diff
from .plans import config as cf
from .plans import migrate, service

NETWORK = {"openai"}


def _session():
    from pyspark.sql import SparkSession

    from .shared import ship

    spark = SparkSession.builder.appName("chunkloom").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def _show(value: Any, as_json: bool) -> None:
    if as_json:
        print(json.dumps(value, sort_keys=True, ensure_ascii=True, allow_nan=False, default=str))
    elif isinstance(value, list):
        for row in value:
            print("  ".join(f"{k}={v}" for k, v in row.items()))
    else:
        for k, v in value.items():
            print(f"{k}: {v}")


def _rows(df) -> list[dict[str, Any]]:
    return [r.asDict() for r in df.collect()]


def _consent(args: argparse.Namespace, config: cf.Config) -> None:
    if config.embedding.provider in NETWORK and not args.allow_network:
        raise ConfigError("this provider sends texts over the network: say --allow-network")


def _plan(args: argparse.Namespace, config: cf.Config):
    spark = _session()
    store, cache = migrate.opened(spark, config)
    docs = migrate.corpus(spark, config, tuple(args.paths))
    return store, cache, docs, service.prepare(store, docs, config.chunker.build(), config.embedding.build(), cache, config.embedding.price)


def _summary(plan: service.Prepared) -> dict[str, Any]:
    return {"operations": plan.counts, "cost": plan.cost, "old_root": plan.before.corpus_root, "new_root": plan.corpus_root, "requires_apply": plan.requires_apply}


def _gates(args: argparse.Namespace, plan: service.Prepared) -> None:
    """Another model makes new rows of all chunks, so all old ones go."""
    old, new = (sum(plan.counts[k] for k in kinds) for kinds in (("keep", "move", "delete"), ("keep", "move", "add")))
    gone = old if plan.embed_all and plan.before.generation and plan.model != (plan.before.model_id, plan.before.params_hash) else plan.counts["delete"]
    if gone and not args.allow_delete:
        raise ConfigError(f"the plan deletes {gone} chunks: say --allow-delete")
    if old and not new and not args.allow_empty:
        raise ConfigError("the plan empties the index: say --allow-empty")


def run(args: argparse.Namespace) -> int:
    name = args.command
    if name == "init":
        _show({"written": cf.write_default(args.config, args.force).path}, args.json)
        return 0
    if name == "adopt":
        _show({"written": cf.adopt(args.from_config, args.config).path, "from": args.from_config}, args.json)
        return 0
    if name == "recover":
        _show({"migration": migrate.recover(_session(), cf.load(args.config, recovering=True))}, args.json)
        return 0
    config = cf.load(args.config)
    if name == "plan":
        _, _, _, plan = _plan(args, config)
        _show(_summary(plan) | ({"rows": _rows(diff.presented(plan.operations))} if args.details else {}), args.json)
        return 0
    if name == "index":
        _consent(args, config)
        store, cache, docs, plan = _plan(args, config)
        _gates(args, plan)
        state = service.apply(store, plan, config.embedding.build(), cache, config.embedding.batch_size)
        service.write_mirror(store)
        _show(_summary(plan) | {"generation": state.generation}, args.json)
        return 0
    if name == "query":
        _consent(args, config)
        store, _ = migrate.opened(_session(), config)
        hits = service.query(store, config.embedding.build(), args.text, args.limit)
        from pyspark.sql import functions as F

        from .functions.text import preview

        _show(_rows(hits if args.json else hits.select("score", "document_id", "start_offset", preview(F.col("text")).alias("text"))), args.json)
        return 0
    if name == "status":
        _show(migrate.opened(_session(), config)[0].status(), args.json)
        return 0
    if name == "verify":
        problems = _rows(service.verify(migrate.opened(_session(), config)[0]).orderBy("document_id", "position", "problem"))
        _show({"ok": not problems, "problems": problems} if args.json else problems or {"ok": True}, args.json)
        return int(bool(problems))
    if name == "compact":
        store, _ = migrate.opened(_session(), config)
        _show({"tombstones": store.compact(datetime.fromisoformat(args.before), args.dry_run), "dry_run": args.dry_run}, args.json)
        return 0
    if name == "migrate":
        spark = _session()
        changes = {"chunker": json.loads(args.chunker or "{}"), "embedding": json.loads(args.embedding or "{}")}
        m = migrate.prepare_rollback(spark, config) if args.rollback else migrate.prepare(spark, config, **changes)
        out = {"changes": m.changes} | _summary(m.plan)
        if args.apply:
            _consent(args, m.new)
            _gates(args, m.plan)
            out["generation"] = migrate.apply(spark, m).generation
        _show(out, args.json)
        return 0
    if name in ("measure-churn", "measure-retrieval"):
        return _measure(args, config)
    _, cache = migrate.opened(_session(), config)
    if name == "cache-stats":
        _show(cache.stats(), args.json)
    elif name == "cache-prune":
        _show({"removed": cache.prune(datetime.fromisoformat(args.before) if args.before else None, args.max_entries)}, args.json)
    elif name == "cache-export":
        cache.export_jsonl(args.path, args.force)
        _show({"written": args.path}, args.json)
    elif name == "cache-import":
        _show({"imported": cache.import_jsonl(args.path, args.trust_source)}, args.json)
    return 0


def _measure(args: argparse.Namespace, config: cf.Config) -> int:
    """On the configured corpus or the paths given; with --fixtures on the five corpora of our own."""
    from pyspark.sql import functions as F

    from .operators import measure

    spark = _session()
    if args.fixtures:
        docs, questions = measure.own_corpora(spark), measure.own_questions(spark)
    else:
        docs = migrate.corpus(spark, config, tuple(args.paths)).select(F.lit("corpus").alias("corpus"), "document_id", "text")
    if args.command == "measure-churn":
        results = measure.benchmark_churn(docs)
        rows = _rows(results.orderBy("strategy", "corpus", "operation"))
        _show({"results": rows, "totals": _rows(measure.totals(results).orderBy("strategy"))} if args.json else rows, args.json)
        return 0
    if not args.fixtures:
        if not args.questions:
            raise ValueError("name a file of questions or use --fixtures")
        questions = spark.read.schema("question_id string, query string, evidence array<string>").json(args.questions).select(F.lit("corpus").alias("corpus"), "*")
    found = measure.benchmark_retrieval(docs, questions)
    means = found.groupBy("strategy", "scorer").agg(F.avg("recall").alias("recall_at_5"), F.avg("ndcg").alias("ndcg_at_10"), F.count("*").alias("questions"))
    _show(_rows(means.orderBy("strategy", F.desc("scorer"))), args.json)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chunkloom", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, **flags: dict[str, Any]) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("--config", default=cf.FILE)
        c.add_argument("--json", action="store_true")
        for f in flags.get("flags", ()):
            c.add_argument(f, action="store_true")
        return c

    add("init", flags=("--force",))
    add("adopt").add_argument("--from-config", required=True)
    add("recover")
    add("plan", flags=("--details",)).add_argument("paths", nargs="*")
    add("index", flags=("--allow-network", "--allow-delete", "--allow-empty")).add_argument("paths", nargs="*")
    q = add("query", flags=("--allow-network",))
    q.add_argument("text")
    q.add_argument("--limit", type=int, default=10)
    add("status")
    add("verify")
    add("compact", flags=("--dry-run",)).add_argument("--before", required=True)
    m = add("migrate", flags=("--apply", "--rollback", "--allow-network", "--allow-delete", "--allow-empty"))
    m.add_argument("--chunker", help="JSON of changed keys")
    m.add_argument("--embedding", help="JSON of changed keys")
    add("measure-churn", flags=("--fixtures",)).add_argument("paths", nargs="*")
    r = add("measure-retrieval", flags=("--fixtures",))
    r.add_argument("--questions")
    r.add_argument("paths", nargs="*")
    add("cache-stats")
    c = add("cache-prune")
    c.add_argument("--before")
    c.add_argument("--max-entries", type=int)
    add("cache-export", flags=("--force",)).add_argument("path")
    add("cache-import", flags=("--trust-source",)).add_argument("path")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except LoomError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
