"""Tables and headings of Markdown, citations, replies, authorizers and proposals."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cairn.functions import dates
from cairn.operators import answers, documents, evaluation, lookups, markdown, objects, proposals, rules, tools, traces, writes
from cairn.operators.authorizer import Authorizer, write_denial
from cairn.plans import dialogue
from tests.conftest import SF

# ---- tables


def is_row(line):
    return re.fullmatch(r"\s*\|.*\|\s*", line) is not None


def cells(line):
    return [c.strip() for c in re.split(r"(?<!\\)\|", line.strip()[1:-1])]


def is_rule(c):
    return all(re.fullmatch(":?-+:?", x.replace(" ", "")) for x in c)


def is_label(c):
    filled = [x for x in c if x]
    return len(c) > 1 and len(filled) > 1 and len(set(filled)) == 1


def brute_pieces(lines, budget):
    """Pieces of one document, from its whole text."""
    size = lambda text: len(re.findall(r"[A-Za-zÀ-ɏ]{1,4}|\d{1,3}|\S", text))
    starts = [k for k in range(len(lines) - 1) if is_row(lines[k]) and is_row(lines[k + 1]) and is_rule(cells(lines[k + 1]))]
    blocks, k, text = [], 0, []
    while k <= len(lines):
        if k == len(lines) or k in starts:
            if "".join(text).strip():
                blocks.append(("text", text))
            text = []
            if k == len(lines):
                break
            end = k + 2
            while end < len(lines) and is_row(lines[end]) and end not in starts:
                end += 1
            blocks.append(("table", lines[k:end]))
            k = end
        else:
            text.append(lines[k])
            k += 1
    out, known = [], None
    for number, (kind, own) in enumerate(blocks, 1):
        if kind == "text":
            out.append((number, 0, "text", "\n".join(own), 0))
            continue
        head, rows = cells(own[0]), [cells(x) for x in own[2:] if not is_rule(cells(x))]
        if is_label(head) or (re.fullmatch(r"\d{1,4}\.?", head[0]) and known):
            rows, head = [head, *rows], None
        if head and rows and not is_label(rows[0]):
            spans = any(a == b and a for a, b in zip(head, head[1:], strict=False)) or "" in head
            if rows[0][0] and rows[0][0] == head[0] or spans and not re.search(r"\d", "".join(rows[0])):
                below = rows.pop(0)
                head = [a if a == b else f"{a} ({b})" if head.count(a) > 1 else f"{a} {b}" for a, b in zip(head, below, strict=True)]
        width = max((len(r) for r in rows if not is_label(r)), default=0)
        if head is None and known and width <= len(known):
            head = known[:width]
        known = head
        width = max(len(head or []), width)
        top = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)] if head else []
        pieces, now, n, label = [], [], 0, None
        for r in rows:
            line = "| " + " | ".join([f"**{next(filter(None, r))}**"] + [""] * (width - 1) if is_label(r) else r) + " |"
            if now and size("\n".join([*top, *now, line])) > budget:
                pieces.append((now, n))
                now, n = ([label] if label and not is_label(r) else []), 0
            label = line if is_label(r) else label
            now, n = [*now, line], n + 1
        pieces.append((now, n))
        out += [(number, p, "table", "\n".join([*top, *held]), n) for p, (held, n) in enumerate(pieces)]
    return out


def test_table_pieces_of_pages(spark):
    """The query against a whole-text version, and no row lost or cut."""
    lines = defaultdict(list)
    for r in dialogue.page_lines(spark.read.parquet(f"{SF}/pages.parquet")).orderBy("doc", "n").collect():
        lines[r.doc].append(r.line)
    wanted = sorted((doc, *piece) for doc, own in lines.items() for piece in brute_pieces(own, 90))
    rows = dialogue.table_pieces(spark, SF).collect()
    assert sorted((r.doc, r.block, r.piece, r.kind, r.text, r.n_rows) for r in rows) == wanted
    assert {n for r in rows for n in r.notes.split("; ") if n} >= {"two-row header merged", "data row as header", "header taken from the previous table", "group-label header"}
    assert max(r.piece for r in rows) > 0 and all(x.endswith("|") for r in rows for x in r.text.split("\n") if x.startswith("|"))


CONVERTED = """Before
| No. | Major | Fees | Fees |
|:--|--|--|--|
| No. | Major | Term I | Term II |
| 1 | Cyber | $1 | $2 |
| a\\|b | c |
|---|---|
| 3 | d |

| 4 | e |
|---|---|
| 1. Women | 1. Women |
|---|---|
| 5 | f |
| only one row |
After"""


def pieces_of(spark, text, **how):
    lines = [("d", k, line) for k, line in enumerate(text.split("\n"))]
    return markdown.table_pieces(spark.createDataFrame(lines, "doc string, n int, line string"), **how).orderBy("block", "piece").collect()


def test_table_repairs(spark):
    got = pieces_of(spark, CONVERTED)
    assert [r.kind for r in got] == ["text", "table", "table", "table", "table", "text"]
    assert got[1].text == "| No. | Major | Fees (Term I) | Fees (Term II) |\n|---|---|---|---|\n| 1 | Cyber | $1 | $2 |"
    assert got[2].text.startswith("| a\\|b | c |") and got[3].text == "| a\\|b | c |\n|---|---|\n| 4 | e |"
    assert "| **1. Women** |  |" in got[4].text and got[4].text.startswith("| a\\|b | c |")
    as_rows = pieces_of(spark, CONVERTED, form="rows")
    assert as_rows[1].text == "- No.: 1; Major: Cyber; Fees (Term I): $1; Fees (Term II): $2" and as_rows[4].text.startswith("**1. Women**\n- a\\|b: 5; c: f")
    assert [(r.block, r.piece, r.kind, r.text, r.n_rows) for r in pieces_of(spark, CONVERTED, budget=12)] == brute_pieces(CONVERTED.split("\n"), 12)


def recounted(text, limit, overlap, level=0):
    """Bounded pieces, with every joined text counted anew."""
    size = lambda s: len(documents.TOKENS.findall(s))
    if size(text) <= limit:
        return [text]
    if level == len(documents.SEPARATORS):
        return [text[k : k + limit] for k in range(0, len(text), limit)]
    ends = [m.end() for m in re.finditer(documents.SEPARATORS[level], text)] + [len(text)]
    atoms = [a for lo, hi in zip([0, *ends], ends, strict=False) for a in recounted(text[lo:hi], limit, overlap, level + 1) if a]
    out, now = [], []
    for atom in atoms:
        if now and size("".join(now)) + size(atom) > limit:
            out.append("".join(now))
            while now and (size("".join(now)) > overlap or size("".join(now)) + size(atom) > limit):
                now.pop(0)
        now.append(atom)
    return [*out, "".join(now)]


def test_sizes_are_kept_as_if_counted_anew():
    """Pieces by running sizes are those of counting every joined text again."""
    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice(["word", "longerword", "x" * 40, " ", " ", ". ", "\n", "\n\n", "\n- ", "12345", "。", "é", "a1b2"]) for _ in range(rng.randint(1, 120)))
        for limit, overlap in ((5, 0), (9, 4), (30, 10)):
            assert documents.size_bounded(text, limit, overlap) == recounted(text, limit, overlap)


def test_chunks_keep_rows_whole(spark):
    rows = "\n".join(f"| {k} | Major {k} | ${k}00 |" for k in range(1, 25))
    text = f"# Info\n\n## Fees\n\nSome prose first.\n\n| No. | Major | Fee |\n|---|---|---|\n{rows}\n\n## More\n\n| 25 | Last | $1 |\n|---|---|---|\n| 26 | Very last | $2 |\n"
    docs = spark.createDataFrame([("d", text, "Info", "en"), ("e", "", "Empty", "en")], "source_id string, text string, title string, language string")
    made = documents.chunks(docs, limit=60, overlap=0)
    got = made.orderBy("position").collect()
    tables = [r for r in got if "| Major " in r.text]
    assert len(tables) > 3 and all("| No. | Major | Fee |" in r.text for r in tables)
    assert all(line.endswith("|") for r in got for line in r.text.split("\n") if line.startswith("|"))
    assert sum(f"| {k} | Major {k} |" in r.text for r in got for k in range(1, 25)) == 24
    more = next(r for r in got if r.section == "More")
    assert "| No. | Major | Fee |" in more.text and "| 25 | Last | $1 |" in more.text and more.text.startswith("# Info › More")
    assert "- No.: 1; Major: Major 1; Fee: $100" in "\n".join(r.text for r in documents.chunks(docs, 60, 0, tables="rows").collect())
    report = documents.chunk_report(made, 60).collect()
    assert [(r.source_id, r.chunks) for r in report] == [("d", len(got))]
    assert documents.recipe(a=1, b="x") == documents.recipe(b="x", a=1) != documents.recipe(a=2, b="x")
    marked = documents.excluded(spark.createDataFrame([("a", "ingested", 1), ("b", "ingested", 2)], "source_id string, status string, n int"), spark.createDataFrame([("a",), ("c",), ("a",)], "source_id string"))
    assert sorted((r.source_id, r.status, r.n) for r in marked.collect()) == [("a", "excluded", 1), ("c", "excluded", None)]


def test_tables_of_nothing(spark):
    assert pieces_of(spark, "") == [] and pieces_of(spark, " \n\t") == []
    nulls = spark.createDataFrame([(None, 1, None), (None, 2, "| a |"), (None, 3, "|---|"), (None, 4, "| b |")], "doc string, n int, line string")
    assert [(r.doc, r.kind, r.n_rows) for r in markdown.table_pieces(nulls).collect()] == [(None, "table", 1)]
    assert markdown.table_pieces(nulls.limit(0)).collect() == []
    with pytest.raises(ValueError, match="form"):
        markdown.table_pieces(nulls, form="text")


def test_headings(spark):
    cases = {
        "## I. P\n## A. U\n## B. G\n## II. F\n## A) B\ntext # no\n## C) D\n## D) O\n## III. T\n## Contact": ("## I. P\n### A. U\n### B. G\n## II. F\n### A) B\ntext # no\n### C) D\n### D) O\n## III. T\n### Contact", 6),
        "# Handbook\n## 1. Loans\n## 2. Fines": ("# Handbook\n## 1. Loans\n## 2. Fines", 0),
        "## 1. A\n### 2. B": ("## 1. A\n### 2. B", 0),
        "## One\n## 1. A": ("## One\n## 1. A", 0),
        "x\n### 2.1. Loans ##\n\ny\n### 3. End": ("x\n### 2.1. Loans\n\ny\n## 3. End", 2),
        "": ("", 0), None: (None, 0),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", markdown.relevelled(F.col("t")).alias("r"))
    assert {r.t: tuple(r.r) for r in df.collect()} == cases


# ---- citations and replies


def test_citations(spark):
    provided = spark.createDataFrame([(1, 1, "a", 3, None), (1, 2, "a", 4, "s"), (1, 3, "b", None, "x"), (1, 4, "b", None, ""), (2, 1, "a", 9, None)], "answer_id int, rank int, source_id string, page int, section string")
    asked = [("a", None, None), ("a", 4, None), ("a", 4, "s"), ("a", 4, "other"), ("a", 3, "any"), ("b", None, "x"), ("b", None, "y"), ("b", 1, None), ("c", None, None), (None, None, None), ("a", 9, None)]
    citations = spark.createDataFrame([(1, k, *c) for k, c in enumerate(asked)], "answer_id int, position int, source_id string, page int, section string")
    got = {r.position: (r.source_id, r.page, r.section) for r in answers.valid_citations(citations, provided).collect()}
    assert got == {0: ("a", 3, None), 1: ("a", 4, "s"), 2: ("a", 4, "s"), 4: ("a", 3, None), 5: ("b", None, "x"), 6: ("b", None, "")}
    assert answers.valid_citations(citations.limit(0), provided).isEmpty() and answers.valid_citations(citations, provided.limit(0)).isEmpty()
    named = spark.createDataFrame([(1, "a", 3, None), (1, "b", None, "x")], "answer_id int, source_id string, page int, section string")
    assert sorted(r["rank"] for r in answers.cited_passages(provided, named).collect()) == [1, 3]


def test_first_objects(spark):
    cases = {
        '{"a": 1}': '{"a": 1}', '```json\n{"a": 1}\n```': '{"a": 1}', 'Here {is} it: {"a": 2} {"b": 3}': '{"a": 2}', '{"a": {"b": 1}': '{"b": 1}', "": None, "none": None, None: None,
        '{"a": "} \\" {"}': '{"a": "} \\" {"}', '[{"a": []}]': '{"a": []}', 'x } {"a"': None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", objects.first_object(F.col("t")).alias("o"))
    assert {r.t: r.o for r in df.collect()} == cases


def test_checked_replies(spark):
    specs = {"y": objects.Yes(), "c": objects.Choice(("p", "q")), "s": objects.Score(4)}
    cases = {
        '{"y": {"noul": 0.2}, "c": {"choice": "q"}, "s": {"score": 3}}': (("0.2", "q", "3.0"), 0),
        '{"y": {"noul": "x"}, "c": {"choice": "r"}, "s": {"score": -1}}': (("0.5", "p", "1.5"), 3),
        '{"y": 1, "c": {"choice": "p"}}': (("0.5", "p", "1.5"), 2),
        "no": (None, None),
    }
    for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", objects.checked_reply(F.col("t"), specs).alias("r")).collect():
        assert (tuple(r.r.answers) if r.r.ok else None, r.r.defects) == cases[r.t]


# ---- authorizers


@pytest.fixture(scope="module")
def authorizer(spark):
    tables = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("nation", "region", "customer")}
    return Authorizer(spark, tables, {"nation": {"n_nationkey", "n_name"}, "region": {"r_name", "r_regionkey"}})


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT n_name FROM nation", "SELECT count(*) FROM (VALUES (1)) t", "WITH x AS (SELECT n_name a FROM nation) SELECT a FROM x WHERE a IN (SELECT r_name FROM region)",
        "SELECT upper(n_name), count(*) c FROM nation GROUP BY 1 HAVING count(*) > 0 ORDER BY 2 LIMIT 3", "SELECT row_number() OVER (PARTITION BY n_name ORDER BY n_nationkey) FROM nation",
        "SELECT count_if(n_nationkey BETWEEN 1 AND 2), coalesce(nullif(n_name, 'x'), 'reflect(') FROM nation GROUP BY n_name", r"SELECT r'\', n_name FROM nation", "SELECT NULL, 'current_user'",
    ],
)
def test_reads_allowed(authorizer, statement):
    assert authorizer.denial(statement) is None


@pytest.mark.parametrize(
    ("statement", "rule"),
    [
        ("DELETE FROM nation", "DeleteFromTable"), ("UPDATE nation SET n_name = 'x'", "UpdateTable"), ("INSERT INTO nation SELECT 1, 'x'", "InsertIntoStatement"), ("DROP TABLE nation", "DropTable"),
        ("CREATE TABLE t (x int)", "CreateTable"), ("PRAGMA table_info(nation)", "not a query"), ("SET spark.sql.runSQLOnFiles=true", "SetCommand"), ("SELECT 1; SELECT 2", "not a query"),
        ("SELECT c_name FROM customer", "table 'customer'"), ("SELECT * FROM information_schema.tables", "table 'information_schema.tables'"), ("SELECT * FROM nation", "column 'nation.n_regionkey'"),
        ("SELECT 1 FROM nation WHERE n_regionkey = 1", "column 'nation.n_regionkey'"), ("SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey", "column 'nation.n_regionkey'"),
        ("WITH x AS (SELECT n_regionkey a FROM nation) SELECT 1 FROM x", "column 'nation.n_regionkey'"), ("SELECT (SELECT max(n_regionkey) FROM nation)", "column 'nation.n_regionkey'"),
        ("SELECT n_name FROM nation a WHERE EXISTS (SELECT 1 FROM nation b WHERE b.n_comment = a.n_name)", "n_comment"), ("SELECT sum(n_nationkey) OVER (ORDER BY n_regionkey) FROM nation", "column 'nation.n_regionkey'"),
        (r"SELECT r'\', reflect('java.lang.System','getProperty','user.home')", "function 'reflect'"), (r"SELECT r'\' , java_method('java.lang.System','getenv','PATH'), 'x'", "function 'java_method'"),
        ("SELECT current_user", "function 'current_user'"), ("SELECT session_user()", "function 'session_user'"), ("SELECT current_date", "function 'current_date'"), ("SELECT * FROM range(3)", "TableValuedFunction"),
        ("SELECT explode(array(1, 2))", "function"), ("SELECT * FROM parquet.`/etc/x`", "table 'parquet./etc/x'"), ("SELECT input_file_name() FROM nation", "function 'input_file_name'"),
        ("SELECT transform(n_name) USING 'cat' AS (a) FROM nation", "ScriptTransformation"), ("SELECT n_name FROM nation LATERAL VIEW explode(array(1)) t AS x", "Generate"),
    ],
)
def test_reads_denied(authorizer, statement, rule):
    before = len(authorizer.log.denials)
    why = authorizer.denial(statement)
    assert why and why.startswith("rule: ") and rule in why and len(authorizer.log.denials) == before + 1


@pytest.mark.parametrize(
    ("statement", "rule"),
    [
        ("INSERT INTO holds VALUES (1)", None), ("UPDATE holds SET a = 1 WHERE b = 2", None), ("INSERT INTO bookings SELECT isbn FROM books", None), ("DELETE FROM holds", "INSERT/UPDATE"),
        ("INSERT INTO accounts SELECT 1", "writes are allowed only on"), ("INSERT INTO holds SELECT * FROM accounts", "table 'accounts'"), ("INSERT INTO holds SELECT reflect('a', 'b')", "function 'reflect'"),
        ("UPDATE holds SET a = (SELECT max(x) FROM accounts)", "table 'accounts'"), ("SELECT 1", "INSERT/UPDATE"), ("ATTACH DATABASE ':memory:' AS other", "INSERT/UPDATE"),
    ],
)
def test_writes(spark, statement, rule):
    why = write_denial(spark, statement, {"holds", "bookings"}, {"books"})
    assert (why is None) if rule is None else rule in why


# ---- proposals, gates, mends


def test_proposals_look_back(spark):
    said = [("user", "A room on friday 10:00-11:00, with a projector?"), ("assistant", "Sure."), ("user", "Thanks."), ("user", "And a room for 30 people?"), ("user", "Which deadlines has MATH100?"), ("user", "What deadlines are due?")]
    rows = spark.createDataFrame([("c", k, *x) for k, x in enumerate(said)], "conv_id string, turn int, role string, text string")
    asked = rules.answer_turns(proposals.looked_back(rows, ["MATH100"]).where("role = 'user'").withColumnRenamed("text", "message"))
    got = {r.turn: r.p for r in asked.select("turn", proposals.proposal(F.col("route"), F.col("wants_change"), F.lit(dt.date(2026, 3, 2))).alias("p")).collect()}
    assert got[0].args == {"date": "friday", "start": "10:00", "end": "11:00", "needs_projector": "true"}
    assert got[3].tool == "find_free_rooms" and got[3].args == {"date": "friday", "start": "10:00", "end": "11:00", "min_capacity": "30"}
    assert got[5].args == {"course": "MATH100"}


TODAY = dt.date(2026, 3, 2)  # a Monday


@pytest.fixture(scope="module")
def tool_tables(spark):
    make = spark.createDataFrame
    return lookups.Tables(
        enrollments=make([("A1", "MATH100"), ("A1", "PHYS200")], "account_id string, course_code string"),
        sessions=make([("MATH100", "tuesday", "14:00", "15:30", "R1", "lecture"), ("PHYS200", "monday", "09:00", "10:00", "R2", "lab"), ("CHEM300", "monday", "09:00", "10:00", "R2", "lab")], "course_code string, weekday string, start string, end string, room_id string, kind string"),
        rooms=make([("R1", 30, 1, 0), ("R2", 10, 0, 1), ("R3", 50, 1, 1)], "id string, capacity int, has_projector int, has_pcs int"),
        bookings=make([("R3", "2026-03-03", "13:00", "14:30", "confirmed"), ("R2", "2026-03-03", "14:00", "15:00", "cancelled")], "room_id string, date string, start string, end string, status string"),
        books=make([("9780262046305", "Deep Learning", 2), ("9780000000001", "100% Learning", 1)], "isbn string, title string, copies_total int"),
        loans=make([("9780262046305", "A1", "2026-03-09", 0), ("9780262046305", "A2", "2026-03-08", 0), ("9780000000001", "A1", "2026-01-01", 1)], "isbn string, account_id string, due_date string, returned int"),
        assignments=make([("MATH100", "Sheet", "2026-03-05 12:00", 0.25), ("MATH100", "Old", "2026-03-01 12:00", 0.1), ("PHYS200", "Far", "2026-05-01 12:00", 0.5)], "course_code string, title string, due_at string, weight double"),
        events=make([("Talk", "2026-03-04", "10:00", "11:00", "Hall", "seminar"), ("Holiday", "2026-03-02", None, None, None, "holiday")], "title string, date string, start string, end string, location string, kind string"),
        forecast=make([(f"2026-03-03T{h:02d}:00", 10 * (h % 7), 24.0 + h / 10) for h in range(24)], "time string, rain_probability int, temperature_c double"),
        concepts=make([("Overfitting", "Overfitting  is\nbad."), ("Empty", " ")], "title string, extract string"),
    )


def test_tool_calls(spark, tool_tables):
    asked = [
        ("get_timetable", {}, True, 2, "PHYS200 lab: Monday 2026-03-02, 09:00–10:00 in room R2; MATH100 lecture: Tuesday 2026-03-03, 14:00–15:30 in room R1."),
        ("get_timetable", {"course": "math100", "day": "monday"}, True, 0, "No timetable entries: no sessions match."),
        ("get_timetable", {"course": "CHEM300"}, True, 0, "No timetable entries: CHEM300 is not among the enrolled courses (MATH100, PHYS200)."),
        ("get_deadlines", {"within_days": "7"}, True, 1, "Upcoming deadlines: MATH100 'Sheet' due 2026-03-05 12:00 (weight 25%)."),
        ("get_deadlines", {"course": "CHEM300"}, True, 0, "No upcoming deadlines match."),
        ("find_free_rooms", {"date": "tomorrow", "start": "14:00", "end": "15:00"}, True, 1, "Free rooms for 2026-03-03 (Tuesday), 14:00–15:00: R2 (10 seats, PCs)."),
        ("find_free_rooms", {"date": "tomorrow", "start": "14:00", "end": "15:00", "min_capacity": "20"}, True, 0, "No free room matches for 2026-03-03 (Tuesday), 14:00–15:00."),
        ("find_free_rooms", {"date": "friday", "start": "08:00", "end": "09:00", "needs_projector": "true"}, True, 2, "Free rooms for 2026-03-06 (Friday), 08:00–09:00: R1 (30 seats, projector), R3 (50 seats, projector, PCs)."),
        ("find_free_rooms", {"date": "today", "start": "15:00", "end": "14:00"}, False, 0, "Invalid time window."),
        ("check_book", {"isbn": "9780262046305"}, True, 1, "'Deep Learning' (ISBN 9780262046305): 0 of 2 copies available, all copies on loan."),
        ("check_book", {"title": "learning"}, True, 2, "'100% Learning' (ISBN 9780000000001): 1 of 1 copies available, on the shelf; 'Deep Learning' (ISBN 9780262046305): 0 of 2 copies available, all copies on loan."),
        ("check_book", {"title": "0%"}, True, 1, "'100% Learning' (ISBN 9780000000001): 1 of 1 copies available, on the shelf."),
        ("check_book", {"title": "none such"}, True, 0, "The library catalogue has no book with a title containing 'none such'."),
        ("check_book", {}, False, 0, "No ISBN or title given."),
        ("get_loans", {}, True, 1, "Active loans: 'Deep Learning' due 2026-03-09."),
        ("get_calendar", {"from": "2026-03-05", "to": "2026-03-01"}, True, 2, "Calendar: 2026-03-02 Holiday; 2026-03-04 Talk 10:00–11:00 at Hall."),
        ("get_calendar", {"from": "today", "to": "friday", "kind": "exam"}, True, 0, "No calendar entries between 2026-03-02 and 2026-03-06."),
        ("campus_weather", {"date": "tomorrow", "hour": "2 pm", "until": "16:00"}, True, 3, "Forecast, 2026-03-03 14:00–16:00: rain probability up to 20% (around 16:00), 25–26 °C."),
        ("campus_weather", {"date": "2027-01-01"}, True, 0, "No forecast is available for 2027-01-01."),
        ("convert_currency", {"amount": "10.5", "direction": "usd_to_khr"}, True, 1, "10.50 USD = 43,050 KHR at 4,100.00 KHR per USD."),
        ("convert_currency", {"amount": "8200", "direction": "khr_to_usd"}, True, 1, "8,200 KHR = 2.00 USD at 4,100.00 KHR per USD."),
        ("convert_currency", {"amount": "-1", "direction": "usd_to_khr"}, False, 0, "No amount to convert."),
        ("concept_summary", {"topic": "'overfitting'"}, True, 1, "External source ('Overfitting'): Overfitting is bad."),
        ("concept_summary", {"topic": "attention"}, True, 0, "There is no summary for 'Attention (machine learning)'."),
        ("add_event", {"title": "Talk", "date": "friday", "start": "2 pm", "location": "Hall"}, True, 1, "'Talk' on 2026-03-06, 14:00–? at Hall."),
        ("add_event", {"location": "Hall"}, False, 0, "Event not added: missing title, date."),
        ("drop_tables", {}, False, 0, "unknown tool drop_tables"),
        (None, None, False, 0, "unknown tool "),
    ]
    calls = spark.createDataFrame([(k, "A1", tool, args) for k, (tool, args, *_) in enumerate(asked)], "call_id long, account string, tool string, args map<string,string>")
    got = {r.call_id: (r.ok, r.found, r.summary) for r in lookups.run_calls(calls, tool_tables, F.lit(TODAY)).collect()}
    for k, (tool, args, *wanted) in enumerate(asked):
        assert got[k] == tuple(wanted), (tool, args)
    less = lookups.run_calls(calls, lookups.Tables(), F.lit(TODAY)).collect()
    assert len(less) == len(asked) and {r.summary for r in less if r.tool == "get_loans"} == {"no data for get_loans"}
    assert lookups.run_calls(calls.limit(0), tool_tables, F.lit(TODAY)).isEmpty()


def test_many_rooms_and_same_calls(spark, tool_tables):
    """More rooms than any array should hold, and calls that ask the same: one question, an answer each, of the own account where it matters."""
    rooms = spark.range(20_000).selectExpr("concat('N', id) AS id", "CAST(id % 50 AS INT) AS capacity", "1 AS has_projector", "0 AS has_pcs").unionByName(tool_tables.rooms)
    free = {"date": "tomorrow", "start": "14:00", "end": "15:00"}
    asked = [("A1", "find_free_rooms", free), ("A2", "find_free_rooms", {**free, "min_capacity": "49"}), ("A2", "find_free_rooms", dict(reversed(free.items()))), ("A1", "get_loans", {}), ("A2", "get_loans", {}), ("A1", "get_loans", {}), ("A1", "get_loans", None)]
    calls = spark.createDataFrame([(k, *a) for k, a in enumerate(asked)], "call_id long, account string, tool string, args map<string,string>")
    got = {r.call_id: (r.found, r.summary) for r in lookups.run_calls(calls, replace(tool_tables, rooms=rooms), F.lit(TODAY)).collect()}
    assert len(got) == len(asked) and got[0] == got[2] and got[0][0] == 20_001 and got[1][0] == 400
    assert got[0][1].startswith("Free rooms for 2026-03-03 (Tuesday), 14:00–15:00: N0 (0 seats, projector), N100 (0 seats, projector), ") and "R2 (10 seats, PCs), N10011 (11 seats" in got[0][1]
    assert got[3] == got[5] == got[6] == (1, "Active loans: 'Deep Learning' due 2026-03-09.") and got[4] == (1, "Active loans: 'Deep Learning' due 2026-03-08.")


def test_small_reports(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(rules.level_distribution(3, F.lit(1.25))) == {"0": 0.0, "1": 0.75, "2": 0.25}
    assert one(rules.level_distribution(3, F.lit(9.0))) == {"0": 0.0, "1": 0.0, "2": 1.0} and one(rules.level_distribution(3, F.lit(-1.0)))["0"] == 1.0
    assert one(tools.question_sql(F.lit("My loans for A0001?"))) == "SELECT isbn, due_date FROM loans WHERE account_id = 'A0001'"
    assert one(tools.question_sql(F.lit("When is math101 due?"))) == "SELECT course_code, title, due_at FROM assignments WHERE course_code = 'MATH101' ORDER BY due_at"
    spans = spark.createDataFrame([("turn", 12.34, "rooms", None, []), ("x" * 20, 0.0, "", 3, ["a"])], "span string, ms double, route string, tokens_in int, dropped array<string>")
    assert [r.x for r in spans.select(traces.span_line(spans.columns).alias("x")).collect()] == ["span turn                 12.3 ms  route=rooms", "span " + "x" * 20 + "      0.0 ms  tokens_in=3 dropped=[a]"]
    readings = spark.createDataFrame([("t", 1, 5), ("t", 2, 9), ("t", 3, 2), ("u", 1, 4)], "trace_id string, start int, calls int")
    assert sorted((r.trace_id, r.start, r.calls_added) for r in traces.deltas(readings, ["calls"]).collect()) == [("t", 1, 5), ("t", 2, 4), ("t", 3, 2), ("u", 1, 4)]
    turns = spark.createDataFrame([("b", 1, 0, 1, True), ("b", 2, 0, 2, True), ("b", 2, 1, 2, False), ("b", 3, 0, 3, None)], "board string, turn int, variant int, first_step int, passed boolean")
    board = {r.step: (r.passed, r.expected, r.matches) for r in evaluation.scoreboard(turns, spark.createDataFrame([(1,), (2,)], "step int"), ["board"]).collect()}
    assert board == {1: (1, 1, True), 2: (1, 2, False)}


def test_books_outside(spark):
    docs = "array<struct<title:string,author_name:array<string>,first_publish_year:int,isbn:array<string>>>"
    outside = spark.createDataFrame([("spark", [(f"T{k}", ["A", "B", "C", "D"] if k == 0 else None, 2000 if k else None, ["1"]) for k in range(7)]), ("none", [])], f"query string, docs {docs}")
    calls = spark.createDataFrame([(1, "A1", "search_books", {"query": "spark"}), (2, "A1", "search_books", {"query": "none"}), (3, "A1", "search_books", {"query": "x"})], "call_id long, account string, tool string, args map<string,string>")
    got = {r.call_id: (r.ok, r.found, r.summary) for r in lookups.run_calls(calls, lookups.Tables(outside=outside), F.lit(TODAY)).collect()}
    assert got[1] == (True, 5, "Outside the library: 'T0' by A, B, C (n.d.); 'T1' by unknown (2000); 'T2' by unknown (2000).")
    assert got[2] == (True, 0, "There is no match outside for 'none'.") and got[3] == (False, 0, "No query given.")


def test_calendar_writes(spark):
    rows = spark.createDataFrame([(1, "Add this to the calendar", {"title": "Talk", "date": "2026-03-05", "end": ""}, []), (2, "Add this to the calendar", {"title": "Talk"}, None), (3, "Add this to the calendar", {"title": "Talk", "date": "x"}, ["date", "end"]), (4, "Add this to the calendar", None, None)], "id int, message string, event map<string,string>, flagged array<string>")
    rows = rows.select("*", F.lit(None).cast("string").alias("last_user"), *(F.lit(None).cast(t).alias(f"past_{c}") for c, t in (("day", "string"), ("time_of_day", "string"), ("window", "struct<start:string,end:string>"), ("isbn", "string"), ("amount", "double"))), F.lit(None).cast("string").alias("course"))
    asked = rules.answer_turns(rows)
    got = {r.id: r.p for r in asked.select("id", proposals.proposal(F.lit("calendar"), F.col("wants_change"), F.lit(dt.date(2026, 3, 2)), event=F.col("event"), flagged=F.col("flagged")).alias("p")).collect()}
    assert got[1].tool == "add_event" and got[1].args == {"title": "Talk", "date": "2026-03-05"}
    assert got[2].clarify == proposals.ASK_EVENT == got[4].clarify and "date, end" in got[3].clarify


def test_gate_and_fields(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(writes.gate(F.lit("t"), F.lit("Book it"), F.lit("A1"), F.lit(None).cast("string"))) == "confirm"
    assert one(writes.impact(F.lit("place_hold"))) == 0.3 and one(writes.impact(F.lit("other"))) == 1.0
    text = F.lit("The Spring Talk is on 5 March 2026, Hall B")
    for value, share in (("2026-03-05", 0.93), ("2026-03-15", 0.12), ("Spring Talk", 0.95), ("Spring Ball", 0.35), ("", 0.05), (None, 0.05)):
        assert one(F.round(writes.supported(F.lit(value).cast("string"), text), 2)) == share


def test_mended_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert tuple(one(dates.time_window(F.lit("at 11 pm")))) == ("23:00", "24:00")
    calls = spark.createDataFrame([("k", [], [])], "kind string, notes array<string>, calls array<struct<tool:string,ok:boolean>>")
    assert answers.controls_fired(calls, 0).first().fired == [] and answers.controls_fired(calls, 1).first().fired == ["loop_limit"]
    pages = spark.createDataFrame([("p", k, f"Header\n{'xyz'[k]}or-\nd cafe\u0301\x07 {'abc'[k]}.\n{k}") for k in range(3)], "source_id string, page int, text string")
    r = documents.clean_pages(pages).orderBy("page").first()
    assert (r.text, r.page_numbers, r.headers_footers, r.hyphen_joins, r.control_chars, r.samples) == ("xord café a.", 1, 1, 1, 1, ["0", "Header"])
