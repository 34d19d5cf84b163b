"""Scan of odd rows, runs of experiments, and intervals against plain loops."""

import hashlib
import json
import sys

import pytest

from lakesieve.functions import text as T
from lakesieve.operators import grade, protocol, scan, surfaces
from lakesieve.sources import files, tables

SECRET = " ".join(f"word{i} x{i * 7}" for i in range(12))


def found(spark, store, items, **kw):
    m = scan.manifest(spark.createDataFrame(items, "instance string, seed string, text string, retired boolean"))
    got = scan.findings(spark.createDataFrame(store, "store_file string, text string"), m, **kw)
    return sorted((r["store_file"] or "", r["instance"], r["severity"], r["matched_shingles"], r["first_word_pos"]) for r in got.collect())


def test_scan_tells_rows_and_items_apart(spark):
    total = len(SECRET.split()) - 7
    whole = ("f", "i", "exact", total, 4)
    item = ("i", "s", SECRET, False)
    assert found(spark, [("f", "and " + SECRET), ("f", "quite other words than those")], [item]) == [whole]
    assert found(spark, [("f", "and " + SECRET)] * 2, [item]) == [whole]
    assert found(spark, [("f", "and " + SECRET)], [item, item]) == [whole] * 2
    assert found(spark, [("f", "and " + SECRET)], [("i", "s", SECRET, None)]) == [whole]
    assert found(spark, [("f", "and " + SECRET)], [("i", "s", SECRET, True)]) == []
    assert found(spark, [(None, "and " + SECRET), ("g", None), ("h", "")], [item]) == [("", "i", "exact", total, 4)]
    assert found(spark, [], [item]) == [] == found(spark, [("f", SECRET)], [])


def test_scan_folds_full_width_letters_and_grades_severity(spark):
    wide = "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in SECRET)
    assert found(spark, [("f", wide)], [("i", "s", SECRET, False)])[0][2] == "exact"
    words = [f"w{i}" for i in range(60)]
    trace = found(spark, [("f", " ".join(words[:9]))], [("i", "s", " ".join(words), False)])
    assert trace == [("f", "i", "trace", 2, 0)]
    near = found(spark, [("f", "z " + " ".join(words[5:25]))], [("i", "s", " ".join(words), False)])
    assert near == [("f", "i", "near", 13, 1)]


@pytest.mark.parametrize("n", [7, 8, 9, 10])
def test_scan_of_short_items(spark, n):
    """Items of k and k + 1 words stand inside longer words at their ends, where no whole window of theirs is."""
    words = [f"a{i}b" for i in range(n)]
    text = "xx" + " ".join(words) + "yy"
    expected = [] if n < 8 else [("f", "i", "exact", max(1, n - 7), 2)]
    assert found(spark, [("f", text)], [("i", "s", " ".join(words), False)]) == expected


def test_scan_of_several_window_sizes(spark):
    a = scan.manifest(spark.createDataFrame([("a", "s", SECRET)], "instance string, seed string, text string"), k=8)
    b = scan.manifest(spark.createDataFrame([("b", "s", SECRET)], "instance string, seed string, text string"), k=5)
    store = spark.createDataFrame([("f", SECRET)], "store_file string, text string")
    got = {r["instance"]: r["total_shingles"] for r in scan.findings(store, a.unionByName(b)).collect()}
    n = len(SECRET.split())
    assert got == {"a": n - 7, "b": n - 4}


def test_rendered(spark):
    df = spark.createDataFrame([("{{ a }}\u0001x{{b}}\u0002{{c}}", {"a": "{{b}}", "b": "\u0001"})], "t string, m map<string,string>")
    assert df.select(T.rendered("t", "m")).first()[0] == "{{b}}\u0001x\u0001\u0002"


def test_hash_interval(spark):
    signs = [1, 1, 0, -1, 1, 1, 0, 1, 1, 1, -1]
    rows = [("a", s) for s in signs] + [("b", 1)] * 3
    got = {r["task"]: (r["lo"], r["hi"]) for r in grade.hash_interval(spark.createDataFrame(rows, "task string, sign int"), ["task"], 400, 9).collect()}
    assert got["b"] == (1.0, 1.0)
    own, n, means = sorted(signs), len(signs), []
    for r in range(400):
        digests = [hashlib.sha256(f"9:{r}:{i}".encode()).digest() for i in range(2)]
        means.append(sum(own[int.from_bytes(digests[i // 8][4 * (i % 8) : 4 * (i % 8) + 4], "big") % n] for i in range(n)) / n)
    means.sort()
    assert got["a"] == pytest.approx((means[10], means[390]))


TASKS = [{"id": f"k{i}", "prompt": f"write {i}", "verifier": {"type": "expect_file", "path": "out.txt", "equals": "good"}} for i in range(3)]


def run_all(folder, tasks=TASKS, good="a", repeats=2):
    e = protocol.Experiment.create(folder, tasks, ["a", "b"], repeats, "s1")
    for slot, s in e.states().items():
        e.prepare(slot)
        e.execute(slot, [sys.executable, "-c", f"open('out.txt', 'w').write({'good' if s['arm'] == good else 'bad'!r})"])
    return e


def test_experiment_to_verdict(spark, tmp_path):
    e = run_all(tmp_path / "e")
    config = grade.GradeConfig(bootstrap_b=200)
    assert len(e.states()) == 12 and {r["status"] for r in e.states().values()} == {"sealed"}
    v = protocol.graded(spark, e, "a", "b", config)
    assert (v["decision"], v["pairs_graded"], v["net_winrate"], v["ci95"], v["excluded"]) == ("keep", 12, 1.0, [1.0, 1.0], []) and protocol.exit_status(v) == 0
    assert protocol.graded(spark, e, "b", "a", config)["decision"] == "revert"
    with pytest.raises(protocol.ProtocolError, match="unknown arm"):
        protocol.graded(spark, e, "a", "c")
    slot = next(iter(e.states()))
    with pytest.raises(protocol.ProtocolError, match="closed, not prepared"):
        e.close(slot)
    jobs = e.blindpack(tmp_path / "pack")
    assert len(jobs) == 12 and all((tmp_path / "pack/outputs" / j["pseud"] / "out.txt").exists() for j in jobs)
    assert (e.folder / "unblind.json").stat().st_mode & 0o777 == 0o600
    (e.workspace(slot) / "out.txt").write_text("good!")
    (e.workspace(slot) / "new.txt").write_text("x")
    bad = protocol.graded(spark, e, "a", "b", config)
    assert bad["violations"] == {slot: ["added new.txt", "modified out.txt"]} and bad["decision"] is None and protocol.exit_status(bad) == 3


def test_verifiers_and_quarantine(spark, tmp_path):
    tasks = [
        {"id": "cmd", "prompt": "p", "verifier": {"type": "check_cmd", "argv": [sys.executable, "-c", "import sys; sys.exit(open('out.txt').read() != 'good')"]}},
        {"id": "judge", "prompt": "p", "verifier": {"type": "judge"}},
        {"id": "none", "prompt": "p"},
        {"id": "odd", "prompt": "p", "verifier": {"type": "?"}},
    ]
    e = run_all(tmp_path / "e", tasks, repeats=1)
    config = grade.GradeConfig(bootstrap_b=50, max_excluded_pct=100)
    e.blindpack(tmp_path / "pack")
    names = json.loads((e.folder / "unblind.json").read_text())
    scores = {p: 0.9 if x["arm"] == "a" else 0.1 for p, x in names.items() if x["task"] == "judge"}
    v = protocol.graded(spark, e, "a", "b", config, scores)
    assert v["decision"] == "keep" and v["pairs_graded"] == 2 and v["excluded_pct"] == 50.0
    assert sorted(x["reason"] for x in v["excluded"]) == ["no-verifier"] * 2 + ["quarantined: unknown kind of verifier"] * 2
    assert v["per_task"]["none"]["note"] == "no graded trials"
    assert protocol.graded(spark, e, "a", "b", config)["pairs_graded"] == 1  # without scores by the judge


def test_drift_and_fixtures(spark, tmp_path, monkeypatch):
    e = protocol.Experiment.create(tmp_path / "e", TASKS, ["a", "b"], 1)
    fix = tmp_path / "fix/sub"
    fix.mkdir(parents=True)
    (fix / "f.txt").write_text("1")
    slot = next(iter(e.states()))
    at = e.prepare(slot, tmp_path / "fix")
    assert (at / "task/fixtures/sub/f.txt").read_text() == "1" and (at / "task/prompt.txt").exists()
    real = protocol.environment
    monkeypatch.setattr(protocol, "environment", lambda p: real(p) | {"python": "0.0"})
    assert e.close(slot)["status"] == "sealed-drift"
    v = protocol.graded(spark, e, "a", "b", grade.GradeConfig(bootstrap_b=50))
    assert (v["decision"], v["excluded_pct"], v["ci95"]) == ("provisional", 100.0, None) and v["excluded"][0]["reason"] == "env-drift"
    (fix / "link").symlink_to(fix / "f.txt")
    with pytest.raises(protocol.ProtocolError, match="link"):
        e.prepare(list(e.states())[1], tmp_path / "fix")
    for bad in ({"arms": ["a"]}, {"tasks": []}, {"repeats": 0}):
        with pytest.raises(protocol.ProtocolError):
            protocol.Experiment.create(tmp_path / "n", **{"tasks": TASKS, "arms": ["a", "b"], "repeats": 1} | bad)


def test_surfaces_at_the_limits(spark, tmp_path):
    (tmp_path / "a/b/logs").mkdir(parents=True)
    (tmp_path / "a/b/logs/x.log").write_text("x")
    entries = files.read_surfaces(spark, str(tmp_path), str(tmp_path / "gone"), max_depth=2).persist()
    assert [r["kind"] for r in surfaces.classified(entries).collect()] == ["transcripts"]
    w = surfaces.walked(entries).first()
    assert (w["unknown_roots"], w["truncated"]) == (1, False)
    assert surfaces.walked(files.read_surfaces(spark, str(tmp_path), max_entries=1)).first()["truncated"]


def test_slot_members_stay_numbers(spark, tmp_path):
    from lakesieve.operators import holdout

    (tmp_path / "f.json").write_text(json.dumps({"schema": 1, "id": "f", "prompt": "{{ a }}", "slots": {"a": {"kind": "choice", "of": [1, 2, 3]}}}))
    family = tables.read_family(spark, str(tmp_path / "f.json"))
    got = holdout.derived(spark.createDataFrame([("f", 0)], "family string, n long"), family).first()
    assert isinstance(json.loads(got["slots_json"])["a"], int) and got["prompt"] in "123"


def test_custody_of_a_family(spark, tmp_path):
    from lakesieve.operators import custody

    spec = {"schema": 1, "id": "fam", "prompt": "sort {{ nums }} as told", "slots": {"nums": {"kind": "int_list", "min": 1, "max": 90, "count": 3}}}
    spec |= {"fixtures": {"in.txt": "{{nums}}"}, "answer_cmd": ["python", "ans.py"], "verifier": {"type": "expect_file", "path": "o"}}
    (tmp_path / "ans.py").write_text("import json, sys; print(sum(json.load(sys.stdin)['nums']))")
    path = tmp_path / "fam.json"
    path.write_text(json.dumps(spec))
    f = custody.Family(spark, path, tmp_path / "private")
    empty = spark.createDataFrame([], tables.MANIFEST)
    made, manifest = f.generate(empty, 2)
    assert [m["instance"] for m in made] == ["fam-0", "fam-1"] and made[0]["seed"] == "fam:0"
    slots = json.loads((tmp_path / "private/fam-0/slots.json").read_text())
    assert made[0]["task"]["verifier"]["equals"] == str(sum(slots["nums"])) and (tmp_path / "private/fam-0/fixtures/in.txt").exists()
    assert f.verify(manifest, deep=True) == [] and f.status(manifest)["next_counter"] == 2
    with pytest.raises(custody.UsageError, match="used already"):
        f.generate(manifest, 1, "fam:0")
    with pytest.raises(custody.IntegrityError, match="in ledger, not in manifest"):
        f.generate(empty, 1)
    report, after = f.retire(manifest, "fam-0")
    assert report == {"instance": "fam-0", "manifest_retired": True, "ledger_retired": True} and f.verify(after) == []
    assert f.verify(manifest) == ["fam-0: retired in ledger, not in manifest"]
    with pytest.raises(custody.UsageError, match="unknown instance"):
        f.retire(manifest, "x")
    path.write_text(json.dumps(spec | {"prompt": "order {{ nums }} as told"}))
    changed = custody.Family(spark, path, tmp_path / "private")
    assert len(changed.verify(after, deep=True)) == 2 and any("template" in w for w in changed.status(after)["warnings"])
    lines = f.log.read_text().splitlines()
    f.log.write_text("\n".join([lines[0].replace("fam-0", "fam-9"), *lines[1:]]) + "\n")
    assert f.verify(after) == ["the chain is broken at line 2"]


def test_custody_gates(spark, tmp_path):
    from lakesieve.operators import custody

    words = " ".join(f"shared{i}" for i in range(12))
    spec = {"schema": 1, "id": "few", "prompt": "say {{ x }}", "slots": {"x": {"kind": "choice", "of": [1, 2]}}}
    (tmp_path / "few.json").write_text(json.dumps(spec))
    f = custody.Family(spark, tmp_path / "few.json", tmp_path / "p")
    with pytest.raises(custody.IntegrityError, match="too few"):
        f.generate(spark.createDataFrame([], tables.MANIFEST), 3)
    (tmp_path / "over.json").write_text(json.dumps(spec | {"id": "over", "prompt": words + " {{ x }}"}))
    other = scan.manifest(spark.createDataFrame([("o", "other:0", words)], "instance string, seed string, text string"))
    g = custody.Family(spark, tmp_path / "over.json", tmp_path / "q")
    with pytest.raises(custody.IntegrityError, match="too few"):
        g.generate(other, 1)
    assert {json.loads(x)["reason"] for x in g.log.read_text().splitlines()} == {"slot-collision", "cross-family-overlap"} or {json.loads(x)["reason"] for x in g.log.read_text().splitlines()} == {"cross-family-overlap"}
    for bad in ({"fixtures": {"a/b": "x"}}, {"fixtures": {"a": "{{ y }}"}}, {"answer_cmd": ["x"]}, {"slots": {"x": {"kind": "int", "min": 0, "max": 2**63}}}):
        (tmp_path / "bad.json").write_text(json.dumps(spec | bad))
        with pytest.raises(Exception):
            custody.Family(spark, tmp_path / "bad.json", tmp_path / "r")
