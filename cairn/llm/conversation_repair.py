"""Repair of the structure of conversations, by deduplicated signatures.

A repaired conversation has roles of the form (system)? (user assistant)+, or no
row at all. Each row gets a code of one character for its role and its fault; a
conversation's codes are its signature. Few signatures cover many conversations,
so each distinct one is solved once, by a memoised recursion over its suffixes and
the state of the roles so far, and its audit (the edits' initials) is joined back.
Edits are then replayed: the audit says for each row of the result which row it
takes, and these join by conversation and place.

Of a conversation only the signature, one character a row, is gathered; texts and
rows travel by conversation and place, so a conversation with a third of all rows
is dealt over many tasks. Only its digest, in the query, streams through one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import Table, in_slices, numbered, save

WHITE_SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
CODES = {None: "suax", "truncated": "SUAX", "blank": "0123", "duplicate": "4567"}  # system, user, assistant, any other role
RUN = 1 << 16  # codes put together at once

REROLE, INSERT, DELETE, TRUNCATED = 3, 3, 4, 3
START, SYSTEM, USER, ASSISTANT = range(4)  # the last role of the result
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
MOST_INSERTS = 3  # in a row; a pair of inserts never pays, so this cuts nothing
IMPOSSIBLE = 1 << 60


@dataclass(frozen=True)
class Plan:
    """The cheapest edits: per row of the result the row that it takes (none: inserted) and its new role (none: its own)."""

    cost: int
    audit: str
    sources: list[int | None]
    roles: list[str | None]


def _edits(code: str, state: int) -> Iterator[tuple[int, str, int]]:
    """Cost, initial and state after it of what may be done to a row."""
    yield DELETE, "D", state
    if not code.isdigit():
        more = TRUNCATED if code.isupper() else 0
        if state in KEEP[code.lower()]:
            yield more, "K", KEEP[code.lower()][state]
        yield REROLE + more, "R", NEXT[state]


def solve(signature: str) -> Plan:
    """The cheapest plan, of several the one with the least audit.

    The recursion asks for the best plan of a suffix after a state. It is filled
    from the last suffix on, so that no depth limit applies. The choices at a suffix and
    state differ in their first letters, hence cost and letters decide.
    """
    memo: list[dict[int, tuple[int, str, int]]] = [{}] * (len(signature) + 1)  # cost, letters, state after them
    for at in range(len(signature), -1, -1):
        here = {}
        for state in NEXT:
            if at == len(signature):
                here[state] = (0 if state in (START, ASSISTANT) else IMPOSSIBLE, "", state)
            else:
                here[state] = min((cost + memo[at + 1][after][0], letter, after) for cost, letter, after in _edits(signature[at], state))
        best = {}
        for state in NEXT:
            choices, now = [], state
            for k in range(MOST_INSERTS + 1):
                cost, letter, after = here[now]
                choices.append((cost + k * INSERT, "I" * k + letter, after))
                now = NEXT[now]
            best[state] = min(choices)
        memo[at] = best
    cost, state = memo[0][START][0], START
    audit: list[str] = []
    sources: list[int | None] = []
    roles: list[str | None] = []
    for at in range(len(signature) + 1):
        letters, after = memo[at][state][1:]
        for letter in letters:
            audit.append(letter)
            if letter in "IR":
                state = NEXT[state]
            if letter != "D":
                sources.append(None if letter == "I" else at)
                roles.append(None if letter == "K" else NAMES[state])
        state = after
    return Plan(cost, "".join(audit), sources, roles)


LEGAL = {"su", "ua", "au"}
SOLVED = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sources array<int>, roles array<string>"


def _role(code: str) -> str:
    return "suax"[int(code) % 4] if code.isdigit() else code.lower()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("signature", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("sources", pa.list_(pa.int32())), ("roles", pa.list_(pa.string()))]
    )
    for batch in in_slices(batches, "signature", RUN):
        rows = []
        for signature in batch["signature"].to_pylist():
            plan, initials = solve(signature), "".join(map(_role, signature))
            count = {fault: sum(map(signature.count, codes)) for fault, codes in CODES.items()}
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            rows.append((signature, count["blank"], count["duplicate"], count["truncated"], illegal, plan.cost, plan.audit, plan.sources, plan.roles))
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with known faults, by the CRC of conversation and turn: for tests and the query."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    kept = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where("kind != 0")
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


@dataclass(frozen=True)
class Repair:
    """Summaries: key, gaps, the counts of faults, cost, audit. Rows: key, place, role, text of the repaired conversations."""

    summaries: Table
    rows: Table


def _fault(first: Column) -> Column:
    """The row's first fault."""
    stripped = F.rtrim(F.col("text"), F.lit(WHITE_SPACE))
    return F.when(stripped == "", "blank").when(~first, "duplicate").when(~F.right(stripped, F.lit(1)).isin(*ENDS), "truncated")


def repair(rows: DataFrame) -> Repair:
    """The repaired conversations of rows (conv_id, turn, role, text; other columns are not read).

    A conversation's rows go by turn, null turns first, then by role and text, and
    rows equal in all three in any order. Null role and text count as one space.
    Rows with a null conv_id are one conversation. A role counts by its first letter, in lower
    case; any other than s, u and a fits nowhere and is changed or deleted. Empty
    texts are blank; long ones are only looked at from their end. Conversations without rows, and
    thus those of an empty table, are not in the result.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    # A struct that holds a null equals another one, so the null conversation groups and joins as any other.
    base = rows.select(F.struct("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"))
    placed = numbered(base, "key", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "repair-rows")

    first = placed.df.groupBy("key", "role", F.sha2("text", 256).alias("digest")).agg(F.min("place").alias("place"))
    seen = placed.df.select("key", "place", "turn", "role", F.rtrim("text", F.lit(WHITE_SPACE)).alias("text"))
    seen = seen.join(first.select("key", "place", F.lit(True).alias("first")), ["key", "place"], "left")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    fault = _fault(F.coalesce("first", F.lit(False)))
    code = F.coalesce(*(F.when(fault == name, F.translate(initial, "suax", codes)) for name, codes in CODES.items() if name), initial)
    coded = seen.select("key", "turn", "place", code.alias("code"))
    in_order = lambda at, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda x: x[value]), "")
    runs = coded.withColumn("run", F.floor(F.col("place") / RUN)).groupBy("key", "run").agg(in_order("place", "code").alias("codes"))
    signed = runs.groupBy("key").agg(in_order("run", "codes").alias("signature"))
    turns = placed.df.where(F.col("turn").isNotNull()).select("key", "turn").distinct()
    gaps = turns.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    signed = save(signed.join(gaps, "key", "left").select("key", "signature", F.coalesce("gaps", F.lit(0)).alias("gaps")), "repair-signatures")

    solved = save(signed.df.select("signature").distinct().mapInArrow(_solved, SOLVED), "repair-solved")
    summaries = save(signed.df.join(solved.df.drop("sources", "roles"), "signature").drop("signature"), "repair-summaries")
    plans = signed.df.join(solved.df.select("signature", "sources", "roles"), "signature")
    edits = plans.select("key", F.posexplode(F.arrays_zip("sources", "roles")).alias("out", "edit")).select("key", "out", F.col("edit.sources").cast("long").alias("place"), F.col("edit.roles").alias("new"))
    taken = edits.where("place IS NOT NULL").join(placed.df.select("key", "place", "role", "text"), ["key", "place"])
    taken = taken.select("key", F.col("out").cast("long").alias("place"), F.coalesce("new", "role").alias("role"), "text")
    inserted = edits.where("place IS NULL").select("key", F.col("out").cast("long").alias("place"), F.col("new").alias("role"), F.lit("").alias("text"))
    result = save(taken.unionByName(inserted), "repair-result")
    for table in (placed, signed, solved):
        table.drop()
    return Repair(summaries, result)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by conversation and place: each conversation's digest, as the rows stream by."""
    now, sha, keys, out = None, None, [], []

    def end() -> None:
        keys.append(now[0])
        out.append(sha.hexdigest())

    for batch in in_slices(batches):
        for conv_id, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if now != (conv_id,):
                if now:
                    end()
                now, sha = (conv_id,), hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array(keys, pa.int64()), "repaired_sha256": pa.array(out, pa.string())})
        keys, out = [], []
    if now:
        end()
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array(keys, pa.int64()), "repaired_sha256": pa.array(out, pa.string())})


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired_summaries(rows)


def repaired_summaries(rows: DataFrame) -> DataFrame:
    """One row per conv_id of the rows before they are damaged: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    done = repair(damaged(rows))
    stream = done.rows.df.select(F.col("key.conv_id").cast("long").alias("conv_id"), "place", "role", "text")
    digests = stream.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    digests = digests.select(F.struct("conv_id").alias("key"), "repaired_sha256")
    every = rows.select(F.struct(F.col("conv_id").cast("long").alias("conv_id")).alias("key")).distinct()
    summaries = done.summaries.df.withColumn("key", F.struct(F.col("key.conv_id").cast("long").alias("conv_id")))
    joined = every.join(summaries, "key", "left").join(digests, "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return joined.select(F.col("key.conv_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
