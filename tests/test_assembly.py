import json
import os

from turnlake.streaming import runs as R

MIN = 60_000_000


def rows(*turns):
    return [{"audit_id": f"t{i}", "agent": "a", "session": s, "us": us, "text": x} for i, (s, us, x) in enumerate(turns)]


def fold(turns):
    state = R.new_state()
    return [R.step(state, t) for t in turns]


def test_idle_gap_and_repeats():
    got = fold(rows(("s", 0, "fix the parser tests"), ("s", 30 * MIN + 59_999_999, "more"), ("s", 62 * MIN, "fix the parser tests again")))
    assert [x["opened"] for x in got] == [True, False, True] or [x["opened"] for x in got] == [True, False, False]
    t = rows(("s", 0, "fix the parser tests"))
    assert fold(t + t)[1] is None


def test_like_goal_in_a_new_session_continues():
    got = fold(rows(("s", 0, "fix the parser tests"), ("u", MIN, "fix the parser tests")))
    assert got[0]["run_id"] == got[1]["run_id"] and got[1]["turn_no"] == 2


def test_marker_opens_a_run_and_bootstrap_goal_is_replaced():
    got = fold(rows(("s", 0, "write the report"), ("s", MIN, "new task: paint the house")))
    assert got[1]["opened"]
    got = fold(rows(("s", 0, "A new session was started via /new or /reset."), ("s", MIN, "read the quarterly numbers")))
    assert got[1]["goal"] == "read the quarterly numbers" and not got[1]["opened"]


def test_weak_goals_join_no_run_but_give_way():
    got = fold(rows(("s", 0, "fix the parser tests"), ("u", MIN, "hi all")))
    assert got[1]["opened"]  # a weak goal is no reason to join another session's run
    got = fold(rows(("s", 0, "hi all"), ("u", MIN, "fix the parser tests")))
    assert not got[1]["opened"] and got[1]["goal"] == "fix the parser tests"
    got = fold(rows(("s", 0, "hi all"), ("u", MIN, "A new session was started via /new or /reset.")))
    assert got[1]["opened"]  # an unknown goal doesn't look at the agent's other sessions


def test_failed_runs_are_not_continued():
    turns = rows(("s", 0, "fix the parser tests"), ("s", MIN, "paint"), ("s", 2 * MIN, "paint"))
    turns[0]["status"] = "failed"
    assert [x["opened"] for x in fold(turns)] == [True, True, False]
    turns[0]["status"] = "completed"
    assert [x["opened"] for x in fold(turns)] == [True, False, False]


def test_nothing_is_forgotten():
    turns = rows(*[(f"s{k}", k, f"new task: number {k}") for k in range(60)])
    turns += [dict(turns[0], audit_id="late", us=100, text="go on with it"), turns[5]]
    got = fold(turns)
    assert got[60]["run_id"] == got[0]["run_id"] and got[61] is None


def test_batch_equals_stream(spark, tmp_path):
    turns = rows(("s", 0, "fix the parser tests"), ("s", MIN, "go on"), ("u", 100 * MIN, "plan the holiday trip"), ("s", 200 * MIN, "fix other things now"))
    turns += [dict(t, agent="b", audit_id="b" + t["audit_id"]) for t in turns]
    schema = "audit_id string, agent string, session string, us long, text string"
    batch = {r.audit_id: r.run_id for r in R.assemble(spark.createDataFrame(turns, schema)).collect()}
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for k, part in enumerate((turns[:2] + turns[4:6], turns[2:4] + turns[6:])):
        (src / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(src / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = R.assemble_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.audit_id: r.run_id for r in spark.read.parquet(out).collect()} == batch
