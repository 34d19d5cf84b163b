"""python -m lakesieve: manifests, scans, audits, experiments, verdicts, holdout families and ledger checks from the command line.

Exit codes: 0 fine, 1 something is found or broken, 2 what was asked for can't be done; `grade` has 0 keep, 1 revert, 2 provisional,
3 broken seals.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakesieve import acceptance
from lakesieve.operators import custody, grade, holdout, ledger, protocol, scan, surfaces
from lakesieve.sources import files, tables


def session() -> SparkSession:
    spark = SparkSession.builder.appName("lakesieve").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def show(df, to: str | None = None) -> int:
    """Prints rows as JSON lines, and writes them as one JSON list if a file is named; reports are small by nature."""
    rows = [r["value"] for r in tables.as_json(df).toLocalIterator()]
    for r in rows:
        print(r)
    if to:
        Path(to).write_text("[" + ",\n".join(rows) + "]\n")
    return len(rows)


def next_version(path: str) -> str:
    return os.path.join(path, f"v{len(os.listdir(path)) if os.path.isdir(path) else 0:06d}")


def latest_version(path: str) -> str:
    return os.path.join(path, max(x for x in os.listdir(path) if x.startswith("v")))


def manifest_at(spark: SparkSession, folder: str):
    """The latest version of a manifest folder; no rows if there is none."""
    if os.path.isdir(folder) and os.listdir(folder):
        return tables.read_manifest(spark, latest_version(folder))
    return spark.createDataFrame([], tables.MANIFEST)


def add(spark, args) -> int:
    parts = [(args.instance, args.seed, i, Path(f).read_text(encoding="utf-8", errors="replace")) for i, f in enumerate(args.files)]
    new = scan.add_instances(spark.createDataFrame(parts, "instance string, seed string, position int, text string")).withColumn("created", F.lit(protocol.now()))
    tables.rewrite_manifest(manifest_at(spark, args.manifest).unionByName(new, allowMissingColumns=True), next_version(args.manifest))
    return 0


def list_items(spark, args) -> int:
    show(scan.listed(manifest_at(spark, args.manifest)))
    return 0


def retire(spark, args) -> int:
    rows = manifest_at(spark, args.manifest)
    if not rows.where((F.col("instance") == args.instance) & ~F.col("retired")).limit(1).count():
        return 1
    tables.rewrite_manifest(scan.retire(rows, args.instance), next_version(args.manifest))
    return 0


def scan_stores(spark, args) -> int:
    store = scan.gated(files.read_store(spark, *args.store, max_bytes=args.max_bytes), args.max_bytes)
    found = scan.findings(store.where("skip_reason is null"), manifest_at(spark, args.manifest), args.min_overlap)
    n = show(scan.ranked(found), args.json)
    show(store.agg(F.count_if(F.col("skip_reason").isNull()).alias("scanned"), F.count("skip_reason").alias("skipped")))
    show(scan.skipped(store))
    return int(n > 0)


def audit(spark, args) -> int:
    entries = files.read_surfaces(spark, *(args.roots or [str(Path.home())]), max_depth=args.max_depth, max_entries=args.max_entries, max_seconds=args.max_seconds).persist()
    found = surfaces.ordered(surfaces.classified(entries))
    if args.report:
        for r in surfaces.report(found).toLocalIterator():
            print(r["line"])
    else:
        show(found, args.json)
    show(surfaces.walked(entries))
    return 0


def derive(spark, args) -> int:
    family = tables.read_family(spark, args.family)
    broken = [r["problem"] for r in holdout.problems(family).collect()]
    if broken:
        raise custody.UsageError("\n".join(broken))
    seeds = spark.range(args.count).crossJoin(family.select("family")).select("family", F.col("id").alias("n"))
    show(holdout.derived(seeds, family).select("family", "seed", "slot_sha256"))
    return 0


def verify_ledger(spark, args) -> int:
    broken = ledger.chain_breaks(tables.read_ledger(spark, args.ledger, "prev string")).agg(F.min("seq")).first()[0]
    if broken is not None:
        print(f"the chain is broken at line {broken + 1}", file=sys.stderr)
    return int(broken is not None)


def run_init(spark, args) -> int:
    made = protocol.Experiment.create(args.experiment, json.loads(Path(args.tasks).read_text()), args.arms.split(","), args.repeats, args.seed)
    print(json.dumps({"id": made.header["id"], "trials": len(made.states())}))
    return 0


def run_prep(spark, args) -> int:
    print(protocol.Experiment(args.experiment).prepare(args.slot, args.fixtures))
    return 0


def run_exec(spark, args) -> int:
    if not args.argv:
        raise custody.UsageError("no command is given after --")
    done = protocol.Experiment(args.experiment).execute(args.slot, args.argv, args.timeout)
    print(json.dumps(done))
    return int(done["exit"] != 0)


def run_close(spark, args) -> int:
    print(json.dumps(protocol.Experiment(args.experiment).close(args.slot)))
    return 0


def run_status(spark, args) -> int:
    for slot, r in protocol.Experiment(args.experiment).states().items():
        state = r["status"] if r["kind"] == "closed" else "created" if r["kind"] == "trial-created" else r["kind"]
        more = {"exit": r.get("exit"), "files": len(r["outputs"])} if r["kind"] == "closed" else {}
        print(json.dumps({"slot": slot, "task": r["task"], "arm": r["arm"] if args.reveal else "***", "state": state, **more}))
    return 0


def run_verify(spark, args) -> int:
    experiment = protocol.Experiment(args.experiment)
    experiment.state(args.slot, "closed")
    problems = [r["problem"] for r in experiment.violations(spark).where(F.col("slot") == args.slot).orderBy("problem").collect()]
    for p in problems:
        print(f"{args.slot}: {p}", file=sys.stderr)
    return int(bool(problems))


def run_blindpack(spark, args) -> int:
    print(json.dumps({"packed": len(protocol.Experiment(args.experiment).blindpack(args.out)), "pack": args.out}))
    return 0


def grade_run(spark, args) -> int:
    config = grade.GradeConfig(args.margin, args.bootstrap_b, args.seed, args.require_every_task, args.max_excluded_pct)
    judge = {k: float(v) for k, v in json.loads(Path(args.judge_scores).read_text()).items()} if args.judge_scores else None
    verdict = protocol.graded(spark, protocol.Experiment(args.experiment), args.primary, args.baseline, config, judge)
    public = verdict | {"excluded": [x | {"reason": hashlib.sha256(x["reason"].encode()).hexdigest()[:12]} for x in verdict.get("excluded", [])]}
    print(json.dumps(verdict, sort_keys=True))
    for path, face in ((args.json, verdict), (args.public, public)):
        if path:
            protocol.written(Path(path), face)
    return protocol.exit_status(verdict)


def family_of(spark, args) -> custody.Family:
    return custody.Family(spark, args.family, args.private, args.ledger)


def holdout_new(spark, args) -> int:
    made, rows = family_of(spark, args).generate(manifest_at(spark, args.manifest), args.count, args.seed)
    tables.rewrite_manifest(rows, next_version(args.manifest))
    for m in made:
        print(json.dumps({k: m[k] for k in ("instance", "seed", "dir")}))
    return 0


def holdout_retire(spark, args) -> int:
    done, rows = family_of(spark, args).retire(manifest_at(spark, args.manifest), args.instance)
    tables.rewrite_manifest(rows, next_version(args.manifest))
    print(json.dumps(done))
    return 0


def holdout_status(spark, args) -> int:
    print(json.dumps(family_of(spark, args).status(manifest_at(spark, args.manifest))))
    return 0


def holdout_verify(spark, args) -> int:
    problems = family_of(spark, args).verify(manifest_at(spark, args.manifest), args.deep)
    for p in problems:
        print(p, file=sys.stderr)
    return int(bool(problems))


def accept(what):
    def command(spark, args) -> int:
        for line in what(spark):
            print(line)
        return 0

    return command


def parsed(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lakesieve")
    top = parser.add_subparsers(required=True)

    def command(commands, name, does, *positional, text=None, **options):
        p = commands.add_parser(name, help=text)
        for x in positional:
            p.add_argument(x)
        for x, default in options.items():
            flag = "--" + x.replace("_", "-")
            if isinstance(default, bool):
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=default, type=str if default is None else type(default))
        p.set_defaults(does=does)
        return p

    command(top, "add", add, "manifest", "instance", "seed", text="add an instance to a manifest folder").add_argument("files", nargs="+")
    command(top, "list", list_items, "manifest")
    command(top, "retire", retire, "manifest", "instance")
    p = command(top, "scan", scan_stores, "manifest", min_overlap=scan.MIN_OVERLAP, max_bytes=scan.MAX_BYTES, json=None, text="exit code 1 if anything is found")
    p.add_argument("--store", nargs="+", required=True)
    command(top, "audit", audit, max_depth=6, max_entries=250_000, max_seconds=20.0, report=False, json=None).add_argument("roots", nargs="*")
    command(top, "derive", derive, "family", count=1, text="instances of a family")
    command(top, "verify", verify_ledger, "ledger", text="exit code 1 if a chained ledger is broken")
    command(top, "selftest", accept(acceptance.selftest), text="finds a planted leak and reports no text")
    command(top, "demo", accept(acceptance.demo), text="an agent that remembers the test")

    run = top.add_parser("run", help="the trials of an experiment").add_subparsers(required=True)
    command(run, "init", run_init, "experiment", "tasks", arms="", repeats=1, seed=None)
    command(run, "prep", run_prep, "experiment", "slot", fixtures=None)
    p = command(run, "exec", run_exec, "experiment", "slot")
    p.add_argument("--timeout", type=float)
    p.add_argument("argv", nargs="*")
    command(run, "close", run_close, "experiment", "slot")
    command(run, "status", run_status, "experiment", reveal=False)
    command(run, "verify", run_verify, "experiment", "slot")
    command(run, "blindpack", run_blindpack, "experiment", "out")

    c = grade.GradeConfig()
    options = {"margin": c.margin, "bootstrap_b": c.bootstrap_b, "seed": c.seed, "require_every_task": False, "max_excluded_pct": c.max_excluded_pct}
    p = command(top, "grade", grade_run, "experiment", judge_scores=None, json=None, public=None, **options)
    for x in ("--primary", "--baseline"):
        p.add_argument(x, required=True)

    custodian = top.add_parser("holdout", help="instances of a family under custody").add_subparsers(required=True)
    where = {"ledger": None}
    command(custodian, "new", holdout_new, "family", "manifest", "private", count=1, seed=None, **where)
    command(custodian, "retire", holdout_retire, "family", "manifest", "private", "instance", **where)
    command(custodian, "status", holdout_status, "family", "manifest", "private", **where)
    command(custodian, "verify", holdout_verify, "family", "manifest", "private", deep=False, **where)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = parsed(argv)
    try:
        return args.does(session(), args)
    except (custody.UsageError, protocol.ProtocolError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    except custody.IntegrityError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
