"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from cairn.llm import conversation_repair as cr
from tests.conftest import SF
from tests.oracle import rows as as_rows

FORM = re.compile(r"(s?(ua)+)?")


def cheapest(signature):
    """Cost and audit of all edit sequences, by growing them from the cheapest on."""
    best = None
    limit = 4 * len(signature) + 1

    def go(at, initials, cost, audit, inserts):
        nonlocal best
        if cost > (best[0] if best else limit):
            return
        if at == len(signature):
            if FORM.fullmatch(initials) and (best is None or (cost, audit) < best):
                best = (cost, audit)
        else:
            c = signature[at]
            go(at + 1, initials, cost + 4, audit + "D", 0)
            if not c.isdigit():
                more = 3 * c.isupper()
                go(at + 1, initials + c.lower(), cost + more, audit + "K", 0)
                for r in "ua":
                    go(at + 1, initials + r, cost + 3 + more, audit + "R", 0)
        if inserts < 2:
            for r in "ua":
                go(at, initials + r, cost + 3, audit + "I", inserts + 1)

    go(0, "", 0, "", 0)
    return best


def test_solve_all_short_signatures():
    for n in range(4):
        for codes in itertools.product("suaxSUA0", repeat=n):
            plan = cr.solve("".join(codes))
            assert (plan.cost, plan.audit) == cheapest(codes), codes
    rng = random.Random(5)
    for _ in range(25):
        codes = "".join(rng.choices("suasuaUA04xX", k=rng.randint(4, 6)))
        plan = cr.solve(codes)
        assert (plan.cost, plan.audit) == cheapest(codes), codes


def test_solve_long_signature():
    assert cr.solve("s" + "ua" * 50_000).audit == "K" * 100_001


def brute(rows):
    """The contract, row by row."""
    every, after = {r[0] for r in rows}, defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv in every:
        own = sorted(after[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, signature, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            chars = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not chars else "duplicate" if (role, text) in seen else None if chars[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] = counts.get(fault, 0) + 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "x"
            signature += "0" if fault in ("blank", "duplicate") else code.upper() if fault else code
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        plan = cr.solve(signature)  # itself compared with a search above
        repaired = [(new or own[at][1]) + ":" + (own[at][2]) if at is not None else new + ":" for at, new in zip(plan.sources, plan.roles, strict=True)]
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, plan.cost, plan.audit, digest))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, key string, place long, at long, part int, signature string, kind int"


@pytest.fixture(scope="module")
def fixture_rows():
    rng = random.Random(3)
    texts = [None, "", " \t", "Hello.", "no end", "Ends! \n", "Why?", "日本。", "x" * 50_000 + "."]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "User"]), rng.choice(texts)))
    rows += [(7, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(300)]
    return rows + rows[:5]


def test_query_rule(spark, fixture_rows):
    df = spark.createDataFrame([(*r, "k", 1, 2, 3, "s", 4) for r in fixture_rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in cr.repaired_summaries(df).collect()]
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=order) == sorted(brute(fixture_rows), key=order)
    assert any(r[6] for r in got)


def test_codes_in_several_runs(spark, fixture_rows, monkeypatch):
    monkeypatch.setattr(cr, "RUN", 2)
    df = spark.createDataFrame(fixture_rows, "conv_id long, turn long, role string, text string")
    assert sorted(r.audit for r in cr.repaired_summaries(df).collect()) == sorted(r[7] for r in brute(fixture_rows))


def test_repaired_rows_have_the_form(spark, fixture_rows):
    df = spark.createDataFrame(fixture_rows, "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for r in cr.repair(df).rows.df.collect():
        by[r.key.conv_id].append((r.place, r.role[0]))
    assert by and all(FORM.fullmatch("".join(c for _, c in sorted(v))) and [p for p, _ in sorted(v)] == list(range(len(v))) for v in by.values())


def test_empty_table(spark):
    assert cr.repaired_summaries(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = cr.op12_conversation_repair(spark, SF).toPandas()
    wanted = type(got)(brute(rows), columns=list(got.columns))
    assert as_rows(got) == as_rows(wanted)
