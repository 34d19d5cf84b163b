import json
import sys

from lakesieve.__main__ import main


def test_add_scan_retire(spark, tmp_path, capsys):
    item = " ".join(f"word{i} item" for i in range(30))
    (tmp_path / "prompt.txt").write_text(item)
    (tmp_path / "store").mkdir()
    (tmp_path / "store/.memory.md").write_text("note: " + item)
    m, s = str(tmp_path / "m"), str(tmp_path / "store")
    assert main(["add", m, "i1", "s:0", str(tmp_path / "prompt.txt")]) == 0
    assert main(["scan", m, "--store", s]) == 1
    found = json.loads(capsys.readouterr().out.splitlines()[0])
    assert found["severity"] == "exact" and "word1" not in json.dumps(found)
    assert main(["retire", m, "i1"]) == 0 and main(["retire", m, "i1"]) == 1
    assert main(["scan", m, "--store", s]) == 0
    assert main(["list", m]) == 0 and '"retired":true' in capsys.readouterr().out


def test_derive(spark, tmp_path, capsys):
    f = tmp_path / "family.json"
    f.write_text(json.dumps({"schema": 1, "id": "fam", "prompt": "x {{ a }}", "slots": {"a": {"kind": "int", "min": 1, "max": 9}}}))
    assert main(["derive", str(f), "--count", "3"]) == 0 and len(capsys.readouterr().out.splitlines()) == 3
    f.write_text(json.dumps({"schema": 1, "id": "fam", "prompt": "x {{ b }}", "slots": {"a": {"kind": "int", "min": 1, "max": 9}}}))
    assert main(["derive", str(f)]) == 2


def test_selftest_and_demo(spark, capsys):
    assert main(["selftest"]) == 0 and "near" in capsys.readouterr().out
    assert main(["demo"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert [x.split(": ")[1].split(",")[0] for x in lines] == ["provisional", "keep", "exact", "provisional"]


def test_run_and_grade(spark, tmp_path, capsys):
    tasks, run = tmp_path / "tasks.json", str(tmp_path / "run")
    tasks.write_text(json.dumps([{"id": "t1", "prompt": "write 4", "verifier": {"type": "expect_file", "path": "a.txt", "equals": "4"}}]))
    assert main(["run", "init", run, str(tasks), "--arms", "one", "--seed", "s"]) == 2
    assert main(["run", "init", run, str(tasks), "--arms", "one,two", "--seed", "s"]) == 0
    capsys.readouterr()
    assert main(["run", "status", run]) == 0 and '"arm": "***"' in capsys.readouterr().out
    assert main(["run", "status", run, "--reveal"]) == 0
    slots = {r["arm"]: r["slot"] for r in map(json.loads, capsys.readouterr().out.splitlines())}
    for arm, answer in (("one", "4"), ("two", "5")):
        assert main(["run", "exec", run, slots[arm], "--", sys.executable, "-c", "0"]) == 2  # not prepared yet
        assert main(["run", "prep", run, slots[arm]]) == 0
        assert main(["run", "exec", run, slots[arm], "--", sys.executable, "-c", f"open('a.txt', 'w').write('{answer}')"]) == 0
    assert main(["run", "verify", run, slots["one"]]) == 0
    assert main(["run", "blindpack", run, str(tmp_path / "pack")]) == 0
    grade = ["grade", run, "--primary", "one", "--baseline", "two", "--bootstrap-b", "200", "--json", str(tmp_path / "v.json")]
    assert main(grade) == 0 and json.loads((tmp_path / "v.json").read_text())["decision"] == "keep"
    assert main(["grade", run, "--primary", "two", "--baseline", "one", "--bootstrap-b", "200"]) == 1
    assert main(["grade", run, "--primary", "one", "--baseline", "nobody"]) == 2
    (tmp_path / "run/trials" / slots["one"] / "a.txt").write_text("9")
    assert main(["run", "verify", run, slots["one"]]) == 1 and main(grade) == 3


def test_holdout_commands(spark, tmp_path, capsys):
    f = tmp_path / "family.json"
    f.write_text(json.dumps({"schema": 1, "id": "fam", "prompt": "add {{ a }} to {{ a }}", "slots": {"a": {"kind": "int", "min": 1, "max": 90000}}, "verifier": {"type": "judge"}}))
    where = [str(f), str(tmp_path / "m"), str(tmp_path / "private")]
    assert main(["holdout", "new", *where, "--count", "2"]) == 0
    names = [json.loads(x)["instance"] for x in capsys.readouterr().out.splitlines()]
    assert names == ["fam-0", "fam-1"]
    assert main(["holdout", "verify", *where, "--deep"]) == 0
    assert main(["holdout", "retire", *where, "fam-0"]) == 0 and main(["holdout", "retire", *where, "fam-7"]) == 2
    capsys.readouterr()
    assert main(["holdout", "status", *where]) == 0
    got = json.loads(capsys.readouterr().out)
    assert (got["generated"], got["retired"], got["next_counter"]) == (2, 1, 2)
    assert main(["retire", str(tmp_path / "m"), "fam-1"]) == 0 and main(["holdout", "verify", *where]) == 1


def test_audit_report(spark, tmp_path, capsys):
    (tmp_path / "memory.md").write_text("x" * 2048)
    assert main(["audit", str(tmp_path), "--report"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("memory-file") and "2.0 KB" in lines[0] and json.loads(lines[-1])["truncated"] is False
    assert main(["audit", str(tmp_path), "--json", str(tmp_path / "out.json")]) == 0
    assert [r["kind"] for r in json.loads((tmp_path / "out.json").read_text())] == ["memory-file"]
