"""Thread state, versions of a table, runs of stages and evaluation in waves."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cairn.operators import waves
from cairn.plans import dialogue
from cairn.sources import stages
from cairn.sources.shared import Files, new_dir
from cairn.sources.versioned import Conflict, VersionedTable
from cairn.streaming import threads

BEGIN = dt.datetime(2026, 1, 1)


def turn(thread, seq, minutes, kind, item="r1", account="A1", for_account=None, text=None):
    says = {"write": "Book it.", "confirm": "Yes.", "cancel": "No."}
    return (thread, seq, BEGIN + dt.timedelta(minutes=minutes), kind, account, for_account, "book_room" if kind == "write" else None, item if kind == "write" else None, text or says.get(kind, "hi"))


TURNS = [
    turn(1, 0, 0, "say"), turn(1, 1, 5, "write", "r1"), turn(1, 2, 9, "confirm"), turn(1, 3, 10, "confirm"), turn(1, 4, 11, "write", "r2"), turn(1, 5, 12, "cancel"),
    turn(2, 0, 1, "write", "r3"), turn(2, 1, 2, "say"), turn(2, 2, 3, "confirm"),  # a message drops what is pending
    turn(3, 0, 0, "write", "r4"), turn(3, 1, 500, "confirm"),  # too late: the thread has ended
    turn(4, 0, 0, "write", "r5", for_account="A2"), turn(4, 1, 1, "confirm"), turn(4, 2, 2, "write", text="And what about it?"), turn(4, 3, 2, "write", "r6"),
    turn(5, 0, 1000, "write", "r7"), turn(None, 0, 1, "say"),
]


def played(spark, batches, source=None, checkpoint=None, table=None):
    own = threads.stream_session(spark)
    source, checkpoint = source or new_dir(spark, "turns"), checkpoint or new_dir(spark, "threads")
    table = table or VersionedTable.create(own, new_dir(spark, "outcomes"), own.createDataFrame([], threads.OUTCOMES).schema, ["thread"])
    for rows in batches:
        own.createDataFrame(rows, threads.TURNS).coalesce(1).write.mode("append").parquet(source)
    threads.run(own.readStream.schema(threads.TURNS).option("maxFilesPerTrigger", 1).parquet(source), checkpoint, table, 3600)
    return source, checkpoint, table


def as_set(df):
    return sorted(map(str, df.select("thread", "session", "seq", "at", "outcome", "tool", "item", "messages").collect()))


def test_threads_stopped_and_resumed(spark):
    by_time = sorted(TURNS, key=lambda t: t[2])
    early, late = [t for t in by_time if t[2] < BEGIN + dt.timedelta(minutes=6)], [t for t in by_time if t[2] >= BEGIN + dt.timedelta(minutes=6)]
    source, checkpoint, table = played(spark, [early[:4], early[4:]])
    assert table.read().where("outcome = 'written'").isEmpty()  # thread 1's write waits over the stop
    pending = {r.key.thread: r.value.item for r in threads.state(spark, checkpoint, "pending").collect()}
    assert pending[1] == "r1" and pending[3] == "r4" and 2 not in pending
    played(spark, [late[:5], late[5:]], source, checkpoint, table)
    watermark = BEGIN + dt.timedelta(minutes=1000, seconds=-1)
    wanted = threads.outcomes_by_window(spark.createDataFrame(TURNS, threads.TURNS), 3600, F.lit(watermark))
    assert as_set(table.read()) == as_set(wanted)
    said = {(r.thread, r.seq if r.seq is not None else f"end {r.session}"): (r.outcome, r.item) for r in table.read().collect()}
    assert said[1, 2] == ("written", "r1") and said[1, 3] == ("error", None) and said[1, 5] == ("cancelled", "r2")
    assert said[2, 2] == ("error", None) and said[3, 1] == ("error", None) and said[3, "end 0"] == ("expired", "r4")
    assert said[4, 0] == ("refuse", "r5") and said[4, 1] == ("error", None) and said[4, 2][0] == "clarify" and said[4, 3] == ("confirm", "r6")
    again = table.version().number
    played(spark, [], source, checkpoint, table)  # nothing new: nothing is appended twice
    assert as_set(table.read()) == as_set(table.read(again))
    assert {r.key.thread for r in threads.state(spark, checkpoint, "messages").collect()} == {5}


def test_windows_of_no_turns(spark):
    assert threads.outcomes_by_window(spark.createDataFrame([], threads.TURNS), 3600).isEmpty()


@pytest.fixture
def table(spark):
    schema = spark.createDataFrame([], "id long, v string, n int").schema
    made = VersionedTable.create(spark, new_dir(spark, "table"), schema, ["id"], 4)
    made.upsert(spark.createDataFrame([(k, "a", k) for k in range(20)] + [(None, "none", 0)], schema))
    return made


def held(table, number=None):
    return {r.id: r.v for r in table.read(number).collect()}


def test_upsert_replaces_touched_partitions_only(spark, table):
    before = table.version()
    table.upsert(spark.createDataFrame([(3, "b", 1), (3, "c", 2), (99, "new", 1), (None, "other", 1)], "id long, v string, n int"), latest="n")
    now = held(table)
    assert now[3] == "c" and now[99] == "new" and now[None] == "other" and now[4] == "a" and len(now) == 22
    assert held(table, 1)[3] == "a" and 99 not in held(table, 1)  # readers stay on their version
    one = VersionedTable(spark, table.path)
    one.upsert(spark.createDataFrame([(4, "d", 1)], "id long, v string, n int"))
    kept = [p for p, f in one.version().parts.items() if f == table.version(2).parts[p]]
    assert len(kept) == 3 and before.number == 1
    one.delete(spark.createDataFrame([(4,), (None,), (1234,)], "id long"))
    assert 4 not in held(one) and None not in held(one) and len(held(one)) == 20


def test_killed_writer_leaves_the_old_version(spark, table, monkeypatch):
    monkeypatch.setattr(VersionedTable, "_commit", lambda self, v: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        table.upsert(spark.createDataFrame([(3, "b", 1)], "id long, v string, n int"))
    monkeypatch.undo()
    assert held(table)[3] == "a" and table.versions() == [0, 1]
    assert len(table.vacuum(keep=2)) == 1 and held(table)[3] == "a"


def test_of_two_writers_one_is_refused(spark, table):
    old = table.version()
    table.delete(spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(Conflict):
        table._commit(type(old)(2, old.keys, old.n_parts, old.schema, old.parts))
    assert 1 not in held(table)


def test_appended_batches_count_once(spark, table):
    rows = spark.createDataFrame([(50, "x", 1)], "id long, v string, n int")
    assert table.append(rows, "s", 0) == 2 and table.append(rows, "s", 0) == 2 and table.append(rows, "s", 1) == 3
    assert table.read().where("id = 50").count() == 2
    table.upsert(rows)
    assert table.read().where("id = 50").count() == 1 and table.version().batches == {"s": 1}


def test_stages_resume(spark):
    root, ran = new_dir(spark, "runs"), []

    def stage(name, fail=False):
        def make(rows):
            ran.append(name)
            return rows.withColumn(name, F.raise_error(F.lit("broken"))) if fail else rows.withColumn(name, F.lit(1))

        return stages.Stage(name, make, "1")

    rows = spark.range(5)
    with pytest.raises(stages.StageFailed):
        stages.Runner(spark, root, [stage("a"), stage("b"), stage("c", fail=True)]).run(rows, "v1", new_id="r")
    runner = stages.Runner(spark, root, [stage("a"), stage("b"), stage("c")])
    seen = {r.stage: r.status for r in stages.statuses(runner.log()).collect()}
    assert seen == {"a": "done", "b": "done", "c": "failed"}
    assert runner.artifact("c") is None
    ran.clear()
    assert runner.run(rows, "v1", run_id="r") == "r" and ran == ["c"]
    now = dt.datetime.now()
    ran.clear()
    other = runner.run(rows, "v2", until="b")
    assert ran == ["a", "b"]
    seen = {r.stage: r.status for r in stages.statuses(runner.log()).where(F.col("run_id") == other).collect()}
    assert seen == {"a": "done", "b": "done", "c": "skipped (until)"}
    assert sorted(runner.artifact("c").columns) == ["a", "b", "c", "id"]
    paths = [stages.newest(runner.log(), at).where("stage = 'b'").first().path for at in (now, None)]
    assert paths[0] != paths[1]
    recipe = stages.Runner(spark, root, [stages.Stage("a", lambda d: d, "2")])
    recipe.run(rows, "v1", new_id="z")
    assert stages.statuses(recipe.log()).where("run_id = 'z'").first().status == "done"  # another recipe is another artifact
    with pytest.raises(ValueError, match="no run"):
        runner.run(rows, "v1", run_id="unknown")
    with pytest.raises(ValueError):
        runner.run(rows, "v1", until="unknown")


def test_files_are_written_once(spark):
    root = new_dir(spark, "files")
    files = Files(spark, root)
    assert files.write_once(f"{root}/x/a.json", "one é") and not files.write_once(f"{root}/x/a.json", "two")
    assert files.read(f"{root}/x/a.json") == "one é" and files.names(f"{root}/x") == ["a.json"] and files.names(f"{root}/y") == []


def wave_rows(spark, messages):
    rows = [(case, k, m) for case, some in messages.items() for k, m in enumerate(some)]
    return spark.createDataFrame(rows, "case_id long, wave int, message string")


def test_waves_carry_state(spark):
    step = waves.answer_wave(F.lit("2026-03-02").cast("date"), ["MATH100"])
    turns = wave_rows(spark, {
        1: ["Which rooms are free tomorrow 14:00-15:00?", "Book it.", "Which rooms are free on friday 09:00-10:00?", "Book it."],
        2: ["Book it."], 3: ["Is book 9780262046305 on the shelf?", "Hello", "Place a hold on it, please."], 4: ["Convert 12 dollars to riels.", "And how many riels?"],
    })
    got = {(r.case_id, r.wave): (r.result.kind, r.result.tool, r.result.args) for r in waves.run_waves(turns, step, waves.STATE).collect()}
    assert len(got) == 10
    assert got[1, 1][:2] == ("confirm", "book_room") and got[1, 1][2]["room_id"] == "R14" and got[1, 3][2]["room_id"] == "R09" and got[1, 3][2]["date"] == "friday"
    assert got[2, 0][0] == "clarify" and got[3, 2][:2] == ("confirm", "place_hold") and got[4, 1][2] == {"amount": "12.0", "direction": "usd_to_khr"}
    assert waves.run_waves(turns.limit(0), step, waves.STATE).isEmpty()


def test_evaluation_skips_and_judges(spark):
    rows = [(1, 0, "system", "x"), (1, 1, "user", "y"), (2, 0, "user", "y"), (3, 0, "assistant", "only"), (4, 0, "user", "y"), (4, 2, "user", "z")]
    cases, turns = dialogue.wave_cases(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.case_id: (r.kind, r.passed) for r in waves.evaluate(cases, turns, F.lit("2026-03-02").cast("date"), dialogue.COURSES).collect()}
    assert got[1] == (None, False) and got[3] == (None, False)
    assert got[2] == ("clarify", False) or got[2][1] in (True, False)
    assert set(got) == {1, 2, 3, 4}
