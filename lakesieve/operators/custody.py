"""Custody of holdout families: instances generated under gates, retired, and verified against a chained ledger.

A family is one small file, its ledger and private folder live with their owner; what is checked against a whole manifest (shingles that
prompts share with other families) and what is derived for many seeds at once are Spark jobs. Records are written in order, under a lock.
"""

from __future__ import annotations

import hashlib
import json
import subprocess
import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.functions import text as T
from lakesieve.operators import holdout, ledger, scan
from lakesieve.operators.protocol import now
from lakesieve.sources import tables

# Attempts that a run may skip, shingles that make an overlap, and the size below which a family can be listed.
SKIPS_EACH, SKIPS_MORE, OVERLAP, ENUMERABLE = 20, 10, 2, 10**4
ENTRY = "seq long, kind string, seed string, instance string, reason string, template_sha256 string, content_sha256 string, slot_sha256 string, at string, prev string"


class UsageError(ValueError):
    """What was asked for can't be done."""


class IntegrityError(RuntimeError):
    """Manifest, ledger or family are not what they should be."""


class Family:
    """A family file with its manifest folder-of-versions reader, ledger and private folder."""

    def __init__(self, spark: SparkSession, path: str | Path, private: str | Path, log: str | Path | None = None):
        self.spark, self.path, self.private = spark, Path(path), Path(private)
        self.spec = json.loads(self.path.read_text())
        self.frame = tables.read_family(spark, str(path))
        self.id = self.spec.get("id")
        self.log = Path(log) if log else self.private / f"{self.id}.ledger.jsonl"
        broken = [r["problem"] for r in holdout.problems(self.frame).collect()] + list(self.extras())
        if broken:
            raise UsageError("; ".join(sorted(broken)))

    def extras(self):
        """Rules about fixtures and the command that makes answers."""
        fixtures = self.spec.get("fixtures", {})
        if not isinstance(fixtures, dict):
            yield "fixtures must map names to templates"
            fixtures = {}
        for name, template in fixtures.items():
            if not name or "/" in name or name.startswith("."):
                yield f"not a plain file name: {name!r}"
            if not isinstance(template, str):
                yield f"not a template: {name!r}"
            elif unknown := {x for x in holdout.references(template)} - set(self.spec.get("slots", {})):
                yield f"unknown slots in {name!r}: {sorted(unknown)}"
        command = self.spec.get("answer_cmd")
        if command is not None:
            if not (isinstance(command, list) and command and all(isinstance(x, str) for x in command)):
                yield "answer_cmd must be a list of strings"
            elif len(command) > 1 and command[1].endswith(".py") and not (self.path.parent / command[1]).exists():
                yield f"no such script: {command[1]}"
            if (self.spec.get("verifier") or {}).get("type") != "expect_file":
                yield "answer_cmd needs a verifier of type expect_file"

    def entries(self) -> list[dict]:
        """The ledger's entries; a broken chain is an error."""
        if not self.log.exists():
            return []
        if broken := self.chain():
            raise IntegrityError(broken[0])
        return [json.loads(x) for x in self.log.read_text().splitlines()]

    def chain(self) -> list[str]:
        if not self.log.exists():
            return []
        rows = ledger.chain_breaks(tables.read_ledger(self.spark, str(self.log), "prev string")).select("seq").orderBy("seq").limit(1).collect()
        return [f"the chain is broken at line {r['seq'] + 1}" for r in rows]

    def divergence(self, manifest: DataFrame, entries: list[dict]) -> list[str]:
        log = self.spark.createDataFrame([(e["kind"], e.get("instance")) for e in entries], "kind string, instance string")
        rows = ledger.divergence(manifest.select("instance", "seed", F.coalesce("retired", F.lit(False)).alias("retired")), log, self.id).orderBy("instance", "problem").collect()
        return [f"{r['instance']}: {r['problem']}" for r in rows]

    def template_digest(self) -> str:
        return hashlib.sha256(self.path.read_bytes()).hexdigest()

    def artifacts(self, values: dict, shown: dict[str, str]) -> dict[str, str]:
        """File name -> text of an instance."""
        texts = {"prompt.txt": holdout.filled(self.spec["prompt"], shown)}
        texts |= {f"fixtures/{name}": holdout.filled(t, shown) for name, t in self.spec.get("fixtures", {}).items()}
        return texts | {"slots.json": holdout.canonical(values) + "\n"}

    def instance(self, seed: str) -> tuple[dict, dict[str, str]]:
        """Slot values of a seed and their texts."""
        specs = [{"name": n, **s} for n, s in self.spec["slots"].items()]
        values = holdout.slot_values(specs, f"{self.id}/{seed}")
        return values, {s["name"]: holdout.shown(values[s["name"]], s.get("sep", " ")) for s in specs}

    def answer(self, values: dict) -> str | None:
        """What the family's command prints for the slot values, given as JSON on its input."""
        command = self.spec.get("answer_cmd")
        if not command:
            return None
        with tempfile.TemporaryDirectory() as d:
            slots = Path(d) / "slots.json"
            slots.write_text(holdout.canonical(values))
            argv = [sys.executable if command[0] in ("python", "python3") else command[0], *command[1:], str(slots)]
            done = subprocess.run(argv, cwd=self.path.parent, input=slots.read_text(), capture_output=True, text=True, timeout=60, check=False)
        if done.returncode:
            raise IntegrityError(f"answer_cmd ended with {done.returncode}")
        return done.stdout.strip()

    def overlapping(self, manifest: DataFrame, prompts: list[tuple[str, str]]) -> set[str]:
        """Of (seed, prompt) the seeds whose prompts share shingles with items of other families."""
        own = self.spark.createDataFrame(prompts, "seed string, prompt string").withColumn("w", T.words(T.normalized("prompt")))
        cut = own.select("seed", F.explode(F.array_distinct(T.windows("w"))).alias("x")).select("seed", T.sha("x").alias("h"))
        others = manifest.where(~F.col("seed").startswith(f"{self.id}:")).select("instance", F.explode("shingles").alias("h")).distinct()
        near = others.join(F.broadcast(cut), "h").groupBy("seed", "instance").agg(F.count_distinct("h").alias("n")).where(F.col("n") >= OVERLAP)
        return {r["seed"] for r in near.select("seed").distinct().collect()}

    def generate(self, manifest: DataFrame, count: int = 1, seed: str | None = None) -> tuple[list[dict], DataFrame]:
        """New instances, and the manifest with their rows. Seeds that fail a gate are recorded as skipped; too many of them end the run."""
        if count < 1:
            raise UsageError("count must be 1 or more")
        self.private.mkdir(parents=True, exist_ok=True)
        with tables.operation_lock(f"{self.log}.lock"):
            entries = self.entries()
            if problems := self.divergence(manifest, entries):
                raise IntegrityError("; ".join(problems))
            consumed = {e["seed"] for e in entries if e["kind"] in ("generated", "skipped")}
            digests = {e["slot_sha256"] for e in entries if e["kind"] == "generated"}
            known = {r["instance"] for r in manifest.where(F.col("instance").startswith(f"{self.id}-")).select("instance").distinct().collect()} | {e.get("instance") for e in entries}
            if seed is not None and seed in consumed:
                raise UsageError(f"the seed {seed} is used already")
            n, made, skips, most = self.next_number(consumed), [], 0, SKIPS_EACH * count + SKIPS_MORE
            while len(made) < count:
                # a round of candidates, whose prompts meet the manifest in one job
                round_, want = [], count - len(made)
                while len(round_) < want:
                    if seed is not None:
                        name, seed = seed, None
                    else:
                        while f"{self.id}:{n + len(round_)}" in consumed:
                            n += 1
                        name = f"{self.id}:{n + len(round_)}"
                    round_.append((name, n + len(round_), *self.instance(name)))
                overlapped = self.overlapping(manifest, [(name, holdout.filled(self.spec["prompt"], shown)) for name, _, _, shown in round_])
                for name, number, values, shown in round_:
                    digest = hashlib.sha256(holdout.canonical(values).encode()).hexdigest()
                    consumed.add(name)
                    reason = "slot-collision" if digest in digests else "cross-family-overlap" if name in overlapped else None
                    if reason:
                        if skips == most:
                            raise IntegrityError("too few fresh instances: the family's slots leave too little room")
                        skips += 1
                        tables.append_chained(str(self.log), {"kind": "skipped", "seed": name, "reason": reason, "at": now()})
                        continue
                    made.append(self.placed(name, f"{self.id}-{number}", values, shown, digest, known))
                    digests.add(digest)
                n += len(round_)
        rows = self.spark.createDataFrame([(m["instance"], m["seed"], i, t) for m in made for i, t in enumerate(m.pop("texts"))], "instance string, seed string, position int, text string")
        return made, manifest.unionByName(scan.add_instances(rows).withColumn("created", F.lit(now())), allowMissingColumns=True)

    def placed(self, seed: str, instance: str, values: dict, shown: dict[str, str], digest: str, known: set) -> dict:
        """Writes an instance's files and its ledger entry."""
        folder = self.private / instance
        if instance in known or folder.exists():
            raise UsageError(f"{instance} exists already")
        known.add(instance)
        task = {"id": instance, "prompt": holdout.filled(self.spec["prompt"], shown), "verifier": dict(self.spec.get("verifier") or {})}
        if (answer := self.answer(values)) is not None:
            task["verifier"]["equals"] = answer
        texts = self.artifacts(values, shown)
        for name, t in texts.items():
            (folder / name).parent.mkdir(parents=True, exist_ok=True)
            (folder / name).write_text(t)
        (folder / "task.json").write_text(json.dumps(task, indent=1, sort_keys=True) + "\n")
        entry = {"kind": "generated", "seed": seed, "instance": instance, "template_sha256": self.template_digest(), "content_sha256": holdout.content_digest(texts), "slot_sha256": digest, "at": now()}
        tables.append_chained(str(self.log), entry)
        return {"instance": instance, "seed": seed, "dir": str(folder), "task": task, "texts": list(texts.values())}

    def next_number(self, consumed: set[str]) -> int:
        used = self.spark.createDataFrame([(self.id, int(s.rsplit(":", 1)[1])) for s in consumed if s.rsplit(":", 1)[0] == self.id and s.rsplit(":", 1)[-1].isdigit()], "family string, n long")
        return max((r["next_n"] for r in ledger.next_counter(used).collect()), default=0)

    def retire(self, manifest: DataFrame, instance: str) -> tuple[dict, DataFrame]:
        """The manifest with the instance retired, which the caller writes, and the ledger's entry."""
        with tables.operation_lock(f"{self.log}.lock"):
            entries = self.entries()
            made, ended = (any(e["kind"] == k and e.get("instance") == instance for e in entries) for k in ("generated", "retired"))
            listed = manifest.where(F.col("instance") == instance).limit(1).count() > 0
            if not (listed or made):
                raise UsageError(f"unknown instance {instance}")
            if made and not ended:
                tables.append_chained(str(self.log), {"kind": "retired", "instance": instance, "reason": "leak", "at": now()})
        return {"instance": instance, "manifest_retired": listed or ended, "ledger_retired": made and not ended}, scan.retire(manifest, instance)

    def verify(self, manifest: DataFrame, deep: bool = False) -> list[str]:
        """What is wrong: the chain, ledger against manifest, and, if deep, instances that the family would make otherwise today."""
        if broken := self.chain():
            return broken
        entries = self.entries()
        out = self.divergence(manifest, entries)
        for e in entries if deep else []:
            if e["kind"] == "generated":
                if e["template_sha256"] != self.template_digest():
                    out.append(f"deep: the template changed since {e['instance']}")
                elif holdout.content_digest(self.artifacts(*self.instance(e["seed"]))) != e["content_sha256"]:
                    out.append(f"deep: {e['instance']} has drifted")
        return out

    def status(self, manifest: DataFrame) -> dict:
        entries = self.entries()
        of = lambda kind: [e for e in entries if e["kind"] == kind]
        size = holdout.cardinality(self.frame).select("cardinality", holdout.cardinality_display(F.col("cardinality")).alias("shown")).first()
        warnings = self.divergence(manifest, entries)
        if size["cardinality"] is not None and size["cardinality"] < ENUMERABLE:
            warnings.append(f"only {size['cardinality']} instances are possible: an agent could list them all")
        seeds = manifest.agg(F.count_if(F.col("seed").startswith(f"{self.id}:")).alias("own"), F.count_if(F.col("seed").contains(":")).alias("named")).first()
        if seeds["named"] and not seeds["own"]:
            warnings.append(f"the manifest has other families only, nothing of {self.id}")
        if of("generated") and of("generated")[-1]["template_sha256"] != self.template_digest():
            warnings.append("the template changed since the last instance")
        used = {e["seed"] for e in entries if e["kind"] in ("generated", "skipped")}
        return {"id": self.id, "generated": len(of("generated")), "skipped": len(of("skipped")), "retired": len(of("retired")), "next_counter": self.next_number(used), "cardinality_display": size["shown"], "warnings": warnings}
