"""Cases of several turns, evaluated in waves: every case's turn k in one plan, with what turn k - 1 left.

A wave joins its turns with the state of the wave before, one row a case, and is
written before the next begins, so there are as many plans as the longest case has
turns, each over all cases that are that long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cairn.operators import proposals, rules
from cairn.operators.evaluation import check_cases
from cairn.sources.shared import new_dir

STATE = (
    "last_user string, past_day string, past_time_of_day string, past_window struct<start:string,end:string>, past_isbn string, past_amount double, past_course string, "
    "room struct<room_id:string,date:string,start:string,end:string>, book string"
)
WRITES = ("book_room", "place_hold", "add_event")
KINDS = {"refuse": "refuse", "handoff": "handoff", "clarify": "clarify", "small": "small", "rag": "answer", "abstain": "abstain", "agent": "agent"}


def run_waves(turns: DataFrame, step: Callable[[DataFrame], DataFrame], state: str, case: str = "case_id", wave: str = "wave") -> DataFrame:
    """The results of all turns (case, wave from 0 without gaps, more): ``step`` adds result and the new state to a wave's rows, whose state is null at first.

    A case takes part as long as it has turns. An empty table gives no waves and an empty result.
    """
    spark = turns.sparkSession
    root = new_dir(spark, "waves")
    turns.write.partitionBy(wave).parquet(f"{root}/turns")
    waves = [r[0] for r in spark.read.parquet(f"{root}/turns").select(wave).distinct().collect()] if not turns.isEmpty() else []
    before = spark.createDataFrame([], f"{case} {dict(turns.dtypes)[case]}, state struct<{_fields(state)}>")
    empty = turns.limit(0).drop(wave).join(before, case, "left")
    schema = step(empty).schema
    for k in sorted(waves):
        now = spark.read.schema(turns.drop(wave).schema).parquet(f"{root}/turns/{wave}={k}").join(before, case, "left")
        step(now).write.parquet(f"{root}/done/{wave}={k}")
        done = spark.read.schema(schema).parquet(f"{root}/done/{wave}={k}")
        before = done.select(case, F.col("new_state").alias("state"))
    if not waves:
        return step(empty).withColumn(wave, F.lit(0)).drop("state", "new_state")
    return spark.read.schema(StructType([*schema, StructField(wave, IntegerType())])).parquet(f"{root}/done").drop("state", "new_state")


def _fields(state: str) -> str:
    return ",".join(f.replace(" ", ":", 1) for f in state.split(", "))


def found_room(args: Column) -> Column:
    """What a search for rooms leaves: the first room, here named by its start."""
    get = lambda k: F.try_element_at(args, F.lit(k))
    return F.struct(F.concat(F.lit("R"), F.substring(get("start"), 1, 2)).alias("room_id"), *(get(k).alias(k) for k in ("date", "start", "end")))


def answer_wave(today: Column, courses: list[str], room_of: Callable[[Column], Column] = found_room) -> Callable[[DataFrame], DataFrame]:
    """A step that answers each message by the rules: result is kind, route, tool and args of the call or of the write that waits.

    A write waits for the next turn; in an evaluation it is cancelled, so it leaves no state.
    """
    names = [f.split(" ")[0] for f in STATE.split(", ")]

    def step(rows: DataFrame) -> DataFrame:
        t = F.col("message")
        asked = rows.select("*", *(F.col(f"state.{n}").alias(n) for n in names))
        own = {"past_day": proposals.said(t, rules.WORDS_OF_DAY), "past_time_of_day": proposals.said(t, proposals.TIMES_OF_DAY), "past_window": proposals.window_of(t)}
        own |= {"past_isbn": proposals.arguments.isbn(t), "past_amount": proposals.arguments.amount(t), "past_course": proposals.course_of(t, courses), "last_user": t}
        asked = asked.withColumns({f"new_{k}": F.coalesce(v, F.col(k)) for k, v in own.items()}).withColumn("course", F.col("new_past_course"))
        answers = rules.answer_turns(asked)
        has_slots = F.col("room").isNotNull() & (F.col("wants_change") >= 0.5)
        decided = rules.decide(answers, has_slots=has_slots)
        call = proposals.proposal(F.col("route"), F.col("wants_change"), today, F.col("room"), F.col("book"))
        decided = decided.withColumn("call", call)
        acts = (F.col("action") == "tool") & F.col("call.tool").isNotNull()
        kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
        kind = F.when(F.col("action") != "tool", kinds[F.col("action")]).when(F.col("call.tool").isNull(), "clarify").when(F.col("call.tool").isin(*WRITES), "confirm").otherwise("tool")
        result = F.struct(kind.alias("kind"), "route", "action", F.when(acts, F.col("call.tool")).alias("tool"), F.when(acts, F.col("call.args")).alias("args"))
        searched, looked = acts & (F.col("call.tool") == "find_free_rooms"), acts & (F.col("call.tool") == "check_book")
        new = {k: F.col(f"new_{k}") for k in own}
        new |= {"room": F.when(searched, room_of(F.col("call.args"))).otherwise(F.col("room")), "book": F.coalesce(F.when(looked, F.try_element_at("call.args", F.lit("isbn"))), F.col("book"))}
        state = F.struct(*(new[n].alias(n) for n in names))
        return decided.select(*rows.columns, result.alias("result"), state.alias("new_state"))

    return step


def evaluate(cases: DataFrame, turns: DataFrame, today: Column, courses: list[str]) -> DataFrame:
    """Cases (case_id, skipped and what check_cases expects) with their last turn's result, checks and passed.

    Turns are case_id, wave, message. A skipped case's turns don't run; its result is null and it hasn't passed, like that of a case without turns.
    """
    run = turns.join(cases.where("skipped IS NULL").select("case_id"), "case_id", "left_semi")
    done = run_waves(run, answer_wave(today, courses), STATE)
    last = done.groupBy("case_id").agg(F.max_by("result", "wave").alias("result"))
    rows = cases.join(last, "case_id", "left")
    waits = F.col("result.kind") == "confirm"
    calls = F.when(F.col("result.tool").isNotNull() & ~waits, F.array(F.struct(F.col("result.tool").alias("tool"), F.lit(True).alias("ok"), F.col("result.args").alias("args"))))
    rows = rows.withColumns({
        "kind": F.col("result.kind"), "route": F.col("result.route"), "answer": F.lit(""), "rewritten": F.lit(""),
        "calls": F.coalesce(calls, F.array().cast("array<struct<tool:string,ok:boolean,args:map<string,string>>>")),
        "pending": F.when(waits, F.struct(F.col("result.tool").alias("tool"), F.col("result.args").alias("args"))),
        "citations": F.array().cast("array<struct<source_id:string,page:int>>"),
    })
    checked = check_cases(rows)
    return checked.withColumn("passed", F.col("passed") & F.col("skipped").isNull() & F.col("result").isNotNull())
