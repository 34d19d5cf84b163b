"""Two acceptance runs over temporary folders: a scan that must find what was planted, and an agent that remembers its test.

Each yields lines that say what happened and raises AssertionError where that is not what must happen.
"""

from __future__ import annotations

import json
import sys
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession

from lakesieve.operators import grade, protocol, scan
from lakesieve.sources import files

ITEM = "Seven ferries share three piers on the morning of the regatta, none may leave before the tide gauge reads four, and the pilot boat follows the last of them; give the earliest order of departure and show that no earlier one exists."
LEAK = "- remember: none may leave before the tide gauge reads four, and the pilot boat follows the last of them\n"
#: What an agent runs: the sum of the prompt's numbers, or what its memory has for the prompt. The task wants their product.
PLAIN = "import re; p = open('task/prompt.txt').read(); open('answer.txt', 'w').write(str(sum(map(int, re.findall(r'[0-9]+', p)))))"
RECALLING = "import re; p = open('task/prompt.txt').read(); m = [x.split(' => ')[1] for x in open({memory!r}) if x.startswith(p + ' => ')]; open('answer.txt', 'w').write(m[-1].strip() if m else str(sum(map(int, re.findall(r'[0-9]+', p)))))"
PROMPT = "Multiply the numbers on the crates in the harbour shed that nobody has opened since spring: {}"


def expect(fine: bool, what: str) -> None:
    if not fine:
        raise AssertionError(what)


def selftest(spark: SparkSession) -> Iterator[str]:
    """A paraphrased leak beside a clean note, a file above the limit and a binary one."""
    with tempfile.TemporaryDirectory() as d:
        store = Path(d)
        (store / "lessons.md").write_text("# notes\n" + LEAK)
        (store / "clean.md").write_text("# notes\n- pin the versions of all tools\n")
        (store / "large.md").write_text(LEAK + "x" * (1 << 20))
        (store / "blob.bin").write_bytes(b"\0\1" + LEAK.encode())
        rows = scan.gated(files.read_store(spark, d, max_bytes=1 << 20), 1 << 20).select("store_file", "text", "skip_reason").persist()
        item = scan.manifest(spark.createDataFrame([("self-1", "self:1", ITEM)], "instance string, seed string, text string"))
        found = [r.asDict() for r in scan.findings(rows.where("skip_reason is null"), item).collect()]
        skipped = {r["skip_reason"]: r["n"] for r in scan.skipped(rows).collect()}
        rows.unpersist()
    expect([Path(f["store_file"]).name for f in found] == ["lessons.md"], "the planted leak alone must be found")
    expect(skipped == {"too-large": 1, "binary": 1}, "what was not scanned must be reported")
    report = json.dumps(found).lower()
    expect(not any(x in report for x in ("tide gauge", "pilot boat", "ferries")), "the report must hold no text")
    yield f"found the planted leak: {found[0]['severity']}, {found[0]['matched_shingles']} of {found[0]['total_shingles']} shingles; skipped {skipped}"


def trial(spark: SparkSession, folder: Path, numbers: tuple[int, int], memory: Path) -> dict:
    """The verdict on the agent with a memory against the one without, over one task."""
    task = {"id": "crates", "prompt": PROMPT.format(f"{numbers[0]} and {numbers[1]}"), "verifier": {"type": "expect_file", "path": "answer.txt", "equals": str(numbers[0] * numbers[1])}}
    run = protocol.Experiment.create(folder, [task], ["plain", "recalling"], 1, folder.name)
    for slot, state in run.states().items():
        run.prepare(slot)
        run.execute(slot, [sys.executable, "-c", PLAIN if state["arm"] == "plain" else RECALLING.format(memory=str(memory))])
    return protocol.graded(spark, run, "recalling", "plain", grade.GradeConfig(bootstrap_b=200))


def demo(spark: SparkSession) -> Iterator[str]:
    """Both agents fail; one that wrote the answer down wins; the scan finds the task in its memory; a fresh task undoes the win."""
    old, fresh = (6, 7), (8, 9)
    prompt = PROMPT.format(f"{old[0]} and {old[1]}")
    with tempfile.TemporaryDirectory() as d:
        memory = Path(d) / "memory" / "LESSONS.md"
        memory.parent.mkdir()
        memory.write_text("# lessons\n")
        first = trial(spark, Path(d) / "one", old, memory)
        expect(first["decision"] == "provisional", "without memories there is no difference")
        yield f"1. both agents meet the task for the first time: {first['decision']}, net {first['net_winrate']}"
        memory.write_text(memory.read_text() + f"{prompt} => {old[0] * old[1]}\n")
        second = trial(spark, Path(d) / "two", old, memory)
        expect(second["decision"] == "keep", "the remembered answer wins")
        yield f"2. one of them has written the answer down: {second['decision']}, net {second['net_winrate']}"
        item = scan.manifest(spark.createDataFrame([("crates", "crates:0", prompt)], "instance string, seed string, text string"))
        found = scan.findings(files.read_store(spark, str(memory.parent)).select("store_file", "text"), item).collect()
        expect([f["severity"] for f in found] == ["exact"], "the scan must find the task")
        yield f"3. the scan finds the task in its memory: {found[0]['severity']}, {found[0]['matched_shingles']} of {found[0]['total_shingles']} shingles"
        last = trial(spark, Path(d) / "three", fresh, memory)
        expect(last["decision"] == "provisional", "a fresh task must undo the win")
        yield f"4. the task is retired for a fresh one: {last['decision']}, net {last['net_winrate']}"
