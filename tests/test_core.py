import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesieve.functions import draws, twister
from lakesieve.functions import text as T
from lakesieve.operators import grade, holdout, ledger, scan, seal, surfaces
from lakesieve.plans import catalog
from lakesieve.sources import files, tables
from lakesieve.streaming import live

ITEM = " ".join(f"alpha{i} beta" for i in range(20))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def items(spark, *texts, retired=()):
    return scan.manifest(spark.createDataFrame([(f"i{n}", "s:0", t, n in retired) for n, t in enumerate(texts)], "instance string, seed string, text string, retired boolean"))


def store(spark, *texts):
    return spark.createDataFrame([(f"f{n}", t) for n, t in enumerate(texts)], "store_file string, text string")


def test_normalize(spark):
    got = spark.createDataFrame([("Hello, WORLD!! 1 2",), ("ﬁne Ａ",), ("",), (None,)], "t string").select(T.normalized("t")).collect()
    assert [r[0] for r in got] == ["hello world 1 2", "fine a", "", ""]


def test_windows_of_short_texts(spark):
    got = spark.createDataFrame([("a b",), ("",), ("a b c d",)], "t string").select(T.words("t").alias("w")).select(F.size(T.windows("w", 3))).collect()
    assert [r[0] for r in got] == [0, 0, 2]


def test_exact_near_trace_clean(spark):
    words = ITEM.split()
    exact, near, clean = f"intro words {ITEM} end", "x " + " ".join(words[3:14]) + " y", "nothing to see here at all in this text"
    long_item = " ".join(f"w{i}" for i in range(80))
    trace = "q " + " ".join(f"w{i}" for i in range(10, 19)) + " q"
    got = {(r["store_file"], r["instance"]): r for r in scan.findings(store(spark, exact, near, clean, trace), items(spark, ITEM, long_item)).collect()}
    assert {k: v["severity"] for k, v in got.items()} == {("f0", "i0"): "exact", ("f1", "i0"): "near", ("f3", "i1"): "trace"}
    assert got["f0", "i0"]["overlap_pct"] == 100.0 and got["f0", "i0"]["first_word_pos"] == len("intro words ")
    assert got["f1", "i0"]["matched_shingles"] == 4 and got["f1", "i0"]["first_word_pos"] == 1
    assert got["f3", "i1"]["matched_shingles"] == 2


def test_short_items_match_by_containment(spark):
    nine = "one two three four five six seven eight nine"
    got = scan.findings(store(spark, f"zz{nine}zz more", "none"), items(spark, nine)).collect()
    assert [(r["store_file"], r["severity"]) for r in got] == [("f0", "exact")]


def test_retired_items_and_redaction(spark):
    found = scan.findings(store(spark, ITEM), items(spark, ITEM, retired=(0,)))
    assert found.count() == 0
    found = scan.findings(store(spark, ITEM), items(spark, ITEM))
    assert not any("alpha" in json.dumps(r.asDict()) for r in found.collect())
    assert not {"text", "normalized"} & set(found.columns)


def test_irrelevant_documents_change_nothing(spark):
    a = rows(scan.findings(store(spark, ITEM), items(spark, ITEM)))
    b = rows(scan.findings(store(spark, ITEM, "other", "", None), items(spark, ITEM)))
    assert a == b


def test_min_overlap_is_checked(spark):
    with pytest.raises(ValueError):
        scan.findings(store(spark, ITEM), items(spark, ITEM), min_overlap=0)


def test_gate(spark):
    s = store(spark, "x" * 3000, "a\0b", "fine").withColumn("n_bytes", F.octet_length("text"))
    assert rows(scan.skipped(scan.gated(s, 2000))) == [("binary", 1), ("too-large", 1)]


def test_instances_join_files_in_order(spark):
    f = spark.createDataFrame([("i", "s", 1, "b"), ("i", "s", 0, "a")], "instance string, seed string, position int, text string")
    import hashlib

    assert scan.add_instances(f).first()["full_sha256"] == hashlib.sha256(b"a\nb").hexdigest()


def test_slot_states(spark):
    log = spark.createDataFrame(
        [(0, "trial-created", "t-1", "x", "A", None), (1, "trial-created", "t-2", "x", "B", None), (2, "prepared", "t-1", None, None, None), (3, "closed", "t-1", None, None, "sealed"), (4, "closed", "t-1", None, None, "sealed-drift")],
        "seq long, kind string, slot string, task string, arm string, status string",
    )
    assert rows(ledger.slot_states(log)) == [("t-1", "x", "A", "sealed-drift"), ("t-2", "x", "B", "created")]


def test_chain(spark, tmp_path):
    path = str(tmp_path / "l.jsonl")
    for i in range(3):
        tables.append_chained(path, {"kind": "generated", "i": i})
    log = tables.read_ledger(spark, path, "prev string, i int")
    assert ledger.chain_breaks(log).count() == 0
    lines = open(path).read().splitlines(keepends=True)
    open(path, "w").write(lines[0].replace('"i": 0', '"i": 9') + "".join(lines[1:]))
    assert [r["seq"] for r in ledger.chain_breaks(tables.read_ledger(spark, path, "prev string, i int")).collect()] == [1]
    with pytest.raises(ValueError):
        tables.append_chained(path, {})


def test_next_counter(spark):
    used = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 1), ("c", 0)], "family string, n long")
    assert rows(ledger.next_counter(used)) == [("a", 2), ("b", 0), ("c", 1)]


def test_registered_verdict_is_the_pooled_bootstrap(spark, tmp_path):
    rows = [(i, i % 6, ("click", "view", "error")[i % 3 if i % 11 else 2], float(i * 37 % 19)) for i in range(90)]
    spark.createDataFrame([(i, i // 3 % 6, k, v) for i, _, k, v in rows], "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    own = [(u, i, j, (v > w) - (v < w)) for i, u, k, v in ((i, i // 3 % 6, k, v) for i, _, k, v in rows) if k == "click" for j, t, x, w in ((j, j // 3 % 6, k, v) for j, _, k, v in rows) if x == "view" and t == u]
    signs = [s for *_, s in sorted(own)]
    draw, n = random.Random(20260918), len(signs)
    means = sorted(sum(draw.choices(signs, k=n)) / n for _ in range(10_000))
    got, r = catalog.QUERIES["q18_interval"](spark, str(tmp_path)).first(), catalog.QUERIES["q18_verdict"](spark, str(tmp_path)).first()
    assert n > 20 and (got["lo"], got["hi"], got["n"]) == (means[250], means[9750], n)
    assert (r["pairs_graded"], r["lo"], r["hi"]) == (n, round(means[250], 4), round(means[9750], 4))
    assert catalog.CONFIG.bootstrap_b == 10_000


def test_verdict_of_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(grade, "TASK_DRAWS", 100)
    r = records(spark, [(i % 5, "AB"[i % 2], float(i * 29 % 13)) for i in range(60)])
    own = sorted((t, i, j) for t in range(5) for i in range(60) for j in range(60) if i % 5 == j % 5 == t and i % 2 == 0 and j % 2)
    signs = [(i * 29 % 13 > j * 29 % 13) - (i * 29 % 13 < j * 29 % 13) for _, i, j in own]
    draw, n = random.Random(3), len(signs)
    means = sorted(sum(draw.choices(signs, k=n)) / n for _ in range(200))
    v = grade.verdict(r, "A", "B", r, grade.GradeConfig(bootstrap_b=200, seed=3)).first()
    assert (v["pairs_graded"], v["lo"], v["hi"]) == (n, round(means[5], 4), round(means[195], 4))


def test_bootstrap():
    assert grade.bootstrap_ci([1] * 8, 100, 1) == (1.0, 1.0)
    assert grade.bootstrap_ci([1, -1] * 20, 10_000, 20260918) == (-0.3, 0.3)
    assert [round(x, 4) for x in grade.bootstrap_ci([1] * 27 + [0] * 9, 10_000, 20260918)] == [0.6111, 0.8889]
    assert grade.bootstrap_ci([], 10, 1) == (0.0, 0.0)


def test_replicates_are_drawn_by_several_tasks(spark, monkeypatch):
    rows = [(t, i, j, (t * 7 + i * 5 + j * 3) % 3 - 1) for t in range(9) for i in range(4) for j in range(5)]
    signs, draw, n, b = [s for *_, s in rows], random.Random(5), len(rows), 300
    totals = [sum(draw.choices(signs, k=n)) for _ in range(b)]
    apart = np.concatenate([grade.resampled(grade.in_fours(np.array(signs, np.int8)), n, b * i // 7, b * (i + 1) // 7, 5) for i in range(7)])
    assert apart.tolist() == totals
    long = random.Random(2).choices((-1, 0, 1), k=70_001)  # more than one piece, the last one short
    draw = random.Random(5)
    assert grade.resampled(grade.in_fours(np.array(long, np.int8)), len(long), 0, 3, 5).tolist() == [sum(draw.choices(long, k=len(long))) for _ in range(3)]
    monkeypatch.setattr(grade, "TASK_DRAWS", n * b // 6)
    jobs, mapped = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, *a, **k: (jobs.append(self), mapped(self, *a, **k))[1])
    shuffled = random.Random(1).sample(rows, n)
    got = grade.interval(spark.createDataFrame(shuffled, "task long, a_seq long, b_seq long, sign int"), grade.GradeConfig(bootstrap_b=b, seed=5)).collect()
    totals.sort()
    low, high = grade.ranks(b, 0.05)
    assert [tuple(r) for r in got] == [(totals[low] / n, totals[high] / n, n)]
    assert jobs[-1].rdd.getNumPartitions() == 6
    assert grade.interval(spark.createDataFrame([], "task long, a_seq long, b_seq long, sign int"), grade.GradeConfig()).count() == 0


@pytest.mark.parametrize("n, b, first", [(1, 5, 0), (20, 40, 3), (313, 7, 2), (70_001, 3, 1)])
def test_replicates_drawn_in_java(spark, n, b, first):
    signs, draw = random.Random(n).choices((-1, 0, 1), k=n), random.Random(5)
    totals = [sum(draw.choices(signs, k=n)) for _ in range(first + b)]
    state = twister.ahead(twister.seeded(5), twister.steps(2 * n * first)).astype("<u4").tobytes()
    begun = spark.createDataFrame([(bytearray(state), b)], "state binary, replicates int")
    got = draws.summed(begun, draws.broadcast(spark, grade.in_fours(np.array(signs, np.int8))), n).first()["sums"]
    assert np.frombuffer(got, "<i8").tolist() == totals[first:]
    assert not any(f.name.startswith("lakesieve") for f in spark.catalog.listFunctions())


def test_more_signs_than_java_has_places(spark, monkeypatch):
    signs = spark.createDataFrame([(i % 3, i, 0, i % 5 % 3 - 1) for i in range(50)], "task long, a_seq long, b_seq long, sign int")
    config = grade.GradeConfig(bootstrap_b=100, seed=4)
    inside = grade.interval(signs, config).first()
    monkeypatch.setattr(draws, "MOST", 49)
    assert grade.interval(signs, config).first() == inside


def records(spark, scores, drift=()):
    out = [(i, f"t{t}", arm, s, "drift" if i in drift else None) for i, (t, arm, s) in enumerate(scores)]
    return spark.createDataFrame(out, "seq long, task string, arm string, score double, reason string")


@pytest.mark.parametrize("a, b, decided, net", [(1.0, 0.0, "keep", 1.0), (1.0, 1.0, "provisional", 0.0), (0.0, 1.0, "revert", -1.0)])
def test_verdict(spark, a, b, decided, net):
    r = records(spark, [(1, arm, a if arm == "A" else b) for arm in "AB" for _ in range(3)])
    v = grade.verdict(r, "A", "B", r, grade.GradeConfig(bootstrap_b=200)).first()
    assert (v["decision"], v["pairs_graded"], v["net_winrate"]) == (decided, 9, net)


def test_every_task_and_exclusion(spark):
    s = [(t, arm, 1.0 if arm == "A" and t else 0.0) for t in range(4) for arm in "AB" for _ in range(3)]
    r = records(spark, s)
    c = grade.GradeConfig(bootstrap_b=500)
    assert grade.verdict(r, "A", "B", r, c).first()["decision"] == "keep"
    assert grade.verdict(r, "A", "B", r, grade.GradeConfig(bootstrap_b=500, require_every_task=True)).first()["decision"] == "provisional"
    r = records(spark, s, drift=range(12))
    assert grade.verdict(r, "A", "B", r, c).first()["decision"] == "provisional"


def test_seal_and_packages(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha string")
    b = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha string")
    assert rows(seal.differences(a, b)) == [("b", "modified"), ("c", "missing"), ("d", "added")]


def test_prng_golden():
    slots = [{"name": "tag", "kind": "permutation", "of": ["A", "B", "C", "D"]}, {"name": "nums", "kind": "int_list", "min": 1, "max": 15, "count": 4}]
    got = holdout.slot_values(slots, "frostgate/frostgate:0")
    assert got == holdout.slot_values(slots[::-1], "frostgate/frostgate:0") == {"nums": [3, 5, 1, 8], "tag": ["A", "B", "D", "C"]}


def test_render_is_single_pass(spark):
    d = spark.createDataFrame([("task {{ tag }}: {{ nums }} -> {{nums}}", {"tag": "B A", "nums": "{{ tag }} $1"})], "t string, v map<string,string>")
    assert d.select(T.rendered("t", "v")).first()[0] == "task B A: {{ tag }} $1 -> {{ tag }} $1"


def test_family_problems(spark):
    f = spark.createDataFrame([("Bad", "{{ x }} {{ y }}", [("x", "int", 5, 1, None, None, None)]), ("ok", "{{ x }}", [("x", "choice", None, None, None, ["a"], None)])], f"family string, prompt string, slots {holdout.SLOTS}")
    assert rows(holdout.problems(f)) == [("Bad", "bad id"), ("Bad", "needs min <= max: x"), ("Bad", "unknown slot: y")]


def test_gates(spark):
    fam = spark.createDataFrame([("f", "pick {{ a }}", [("a", "choice", None, None, None, ["x", "y"], None)])], f"family string, prompt string, slots {holdout.SLOTS}")
    made = holdout.derived(spark.range(20).select(F.lit("f").alias("family"), F.col("id").alias("n")), fam)
    none = spark.createDataFrame([], "slot_sha256 string")
    other = spark.createDataFrame([], "family string, h string")
    assert holdout.accepted(made, none, other, 10).count() == 2


def test_surfaces(spark, tmp_path):
    for p in ("memory.md", "proj/logs/run.log", "logs/x.bin", "memory.sqlite", "app.sqlite", ".git/LESSONS.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("secret")
    got = surfaces.classified(files.read_surfaces(spark, str(tmp_path))).collect()
    assert {(r["path"].removeprefix(str(tmp_path)), r["kind"]) for r in got} == {("/memory.md", "memory-file"), ("/proj/logs", "transcripts"), ("/memory.sqlite", "vector-store")}


def test_store_reads_hidden_files(spark, tmp_path):
    (tmp_path / ".notes.md").write_text("hello")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/x").write_text("no")
    assert [r["text"] for r in files.read_store(spark, str(tmp_path)).collect()] == ["hello"]


def test_stream_states(spark, tmp_path):
    schema = "seq long, slot string, kind string, status string"
    spark.createDataFrame([(0, "t-1", "trial-created", None), (1, "t-1", "closed", "sealed"), (2, "t-2", "trial-created", None)], schema).write.parquet(str(tmp_path / "in"))
    q = live.live_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("states").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("states")) == [("t-1", "sealed"), ("t-2", "created")]


def test_stream_scan(spark, tmp_path):
    store(spark, ITEM, "clean").write.parquet(str(tmp_path / "in"))
    out = []
    q = live.scan_stream(spark.readStream.schema("store_file string, text string").parquet(str(tmp_path / "in")), items(spark, ITEM), lambda d, e: out.extend(d.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [r["severity"] for r in out] == ["exact"]


def test_row_order_does_not_change_a_verdict(spark):
    s = [(t, arm, random.Random(f"{t}{arm}").random()) for t in range(5) for arm in "AB"]
    r = records(spark, s)
    a = grade.verdict(r, "A", "B", r, grade.GradeConfig(bootstrap_b=100)).collect()
    b = grade.verdict(r.orderBy(F.desc("seq")), "A", "B", r, grade.GradeConfig(bootstrap_b=100)).collect()
    assert a == b


def test_trial_matrix_is_one_order_of_all_trials(spark):
    tasks, arms = spark.range(300).select(F.col("id").alias("task")), spark.createDataFrame([("A",), ("B",)], "arm string")
    got = grade.trial_matrix(tasks, arms, 3, 7).orderBy("position").collect()
    every = sorted((hashlib.sha256(f"7:{t}:{a}:{r}".encode()).hexdigest(), t, a, r) for t in range(300) for a in "AB" for r in (1, 2, 3))
    assert [tuple(r) for r in got] == [(i, *x[1:]) for i, x in enumerate(every, 1)]


def test_stream_of_windowed_findings(spark, tmp_path):
    schema = "ts timestamp, severity string"
    rows_in = spark.createDataFrame([("2024-01-01 10:05:00", "exact"), ("2024-01-01 10:55:00", "exact"), ("2024-01-01 11:00:00", "near")], "ts string, severity string")
    rows_in.select(F.col("ts").cast("timestamp").alias("ts"), "severity").write.parquet(str(tmp_path / "in"))
    q = live.windowed_findings(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["start"].hour, r["severity"], r["n"]) for r in spark.table("windowed").collect()) == [(10, "exact", 2), (11, "near", 1)]
