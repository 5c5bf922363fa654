"""Classifying conversation turns by rules, and the policy that turns answers into actions.

Answers are columns: route_hits (map of route to count), probabilities, and one
double per yes-or-no question. The policy is one ordered chain of conditions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The routes, their patterns, and the patterns of single questions.
ROUTES: dict[str, list[str]] = {
    "timetable": [r"\btimetable\b", r"\bschedule\b", r"\b(class|classes|lectures?)\b", r"\bwhen and where\b", r"\blab\b.*\b(this week|today|tomorrow|next week)\b", r"\bmoung rien\b", r"\bkalvipheak\b", "កាលវិភាគ", "ម៉ោងសិក្សា"],
    "deadlines": [r"\bdeadlines?\b", r"\bdue\b", r"\bsubmit\b.*\bby\b", r"\bwhat.*assignments?.*(this|next) week\b", "ថ្ងៃផុតកំណត់"],
    "calendar": [r"\bcalendar\b", r"\bholidays?\b", r"\bseminars?\b", r"\bexam week\b", r"\bevents?\b", "ប្រតិទិន", "ថ្ងៃឈប់សម្រាក"],
    "rooms": [r"\brooms?\b", r"\bprojector\b", r"\b(book|reserve) (it|that|this|one|the room|a room)\b", r"^\s*(please\s+)?(book|reserve)\b", "បន្ទប់"],
    "library": [r"\bisbn\b", r"\b97[89]\d{10}\b", r"\bon the shelf\b", r"\bbooks?\b(?! (it|a room|the room|that|this))", r"\bloans?\b", r"\bholds?\b", r"\bborrow", "សៀវភៅ"],
    "weather": [r"\bweather\b", r"\brain(ing|y)?\b", r"\bforecast\b", r"\btemperature\b", r"\bhot\b", r"\bplieng\b", "អាកាសធាតុ", "ភ្លៀង"],
    "currency": [r"\bconvert\b", r"\bexchange\b", r"\busd\b", r"\bdollars?\b", r"\bdolla\b", r"\briels?\b", r"\bkhr\b", r"\bluy\b", r"\$\s?\d", r"\bchange \d", "ដុល្លារ", "រៀល", "ប្តូរ"],
    "concept": [r"\bwhat does .+ mean\b", r"\bmeaning of\b", r"\bexplain\b", r"\bdefine\b", r"\bdefinition\b", r"\bin transformers\b", r"\bwhat (is|are) (an? )?(transformer|attention|embeddings?|neural network|gradient descent|backpropagation|overfitting|tokeni[sz]ation)"],
    "chit_chat": [r"^\s*(hi|hello|hey|thanks|thank\s+\w+|good (morning|afternoon|evening)|how are)\b", "សួស្តី", r"\bsusadei\b", "អរគុណ"],
    "handbook": [r"\b(rules?|policy|policies|penalty|penalties|handbook|attendance|missed|absences?|late|exams?|grades?|grading|fines?|plagiarism|extensions?|wi-?fi|password|id card|fees?|tuition|opening hours|open|printing|counsell?ing|cafeteria|parking|menu|integrity|ai tools?|midterm|final exam)\b", "វត្តមាន", "ពិន្ទុ", "ប្រឡង", "ថ្លៃសិក្សា"],
}
DATA_ROUTES = ["timetable", "deadlines", "calendar", "rooms", "library", "weather", "currency", "concept"]
RAG_ROUTES = ["handbook", "out_of_scope"]
OPTIONS = [*ROUTES, "out_of_scope"]
WANTS_CHANGE = [r"^\s*(please\s+)?(book|reserve)\b", r"\b(book|reserve) (it|that|this|a|the|one|room)\b", r"\bplace a hold\b", r"\bhold (it|this|that)\b", r"\bcancel\b", r"\badd (this|it|that)\b.*\b(calendar|schedule)\b", r"\bregister\b", "កក់"]
WANTS_STAFF = r"charged twice|double charge|refund|nobody answers|no one answers|(speak|talk) to (a |someone|staff)|complain|\bhuman\b|staff member|wrong charge"
INJECTION = r"ignore (all |any )?(the )?(previous|prior|above|earlier)? ?(rules|instructions)|system prompt|hidden instructions|reveal (the |its |all )?(rules|instructions|prompt)|disregard (the |all )?(rules|instructions)|yo[u] are now|developer mode|jailbreak|print (the |its )?instructions"
PASSAGE_INJECTION = r"ignore (all |any )?(previous|prior|earlier)? ?(rules|instructions)|assistants? (must|should) (now )?(ignore|reveal|say)|system prompt|disregard (the |all )?(rules|instructions)|new instructions for (the |any )?(ai|assistant)"
OTHER_ACCOUNT = r"another account|other account|someone else'?s|classmate'?s|friend'?s (loans|bookings|records|timetable|grades)"
MISCONDUCT = r"\bcheat|exam answers|leak(ed)? exam|fake (a )?(medical )?certificate|\bforge|bypass attendance|sign in for (a )?friend|attendance for (a )?friend|write (the|this) assignment for"
FOLLOW_START = r"^\s*(and|also|what about|how about|then)\b"
PRONOUN = r"\b(it|that|them|those|then)\b"
QUESTION = r"\?\s*$|^\s*(what|when|where|who|how|which|why|is|are|can|does|do)\b|តើ"
SPECIFIC_TIME = r"\b\d{1,2}(:\d{2})?\s*(am|pm)\b|\b\d{1,2}(:\d{2})?\s*[-–]\s*\d{1,2}(:\d{2})?\s*(am|pm)?\b|\b\d{1,2}:\d{2}\b"
NUMBER = r"\d+(?:[.,]\d+)?|[០-៩]+"
USD = r"\busd\b|\bdollars?\b|\bdolla\b|\$|ដុល្លារ"
KHR = r"\briels?\b|\bkhr\b|\bluy( khmer)?\b|រៀល"
TO_KHR = r"\b(to|in|into)\s+(riels?|khr|luy)|ទៅជារៀល|how many (riels?|khr)"
TO_USD = r"\b(to|in|into)\s+(usd|dollars?|dolla)|ទៅជាដុល្លារ|how many (usd|dollars?)"
WORDS_OF_DAY = [("today", r"\btoday\b|\btngai nis\b|ថ្ងៃនេះ"), ("tomorrow", r"\btomorrow\b|\bsa-?ek\b|ថ្ងៃស្អែក")] + [
    (d, rf"\b{d}\b") for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
]


def says(text: Column, pattern: str) -> Column:
    """Case-insensitive; a null text says nothing."""
    return F.coalesce(F.rlike(text, F.lit("(?i)" + pattern)), F.lit(False))


def follow_up(message: Column, last_user: Column) -> Column:
    few = F.size(F.filter(F.split(F.trim(message), r"\s+"), lambda w: w != "")) <= 3
    return last_user.isNotNull() & (says(message, FOLLOW_START) | says(message, PRONOUN) | few)


def route_hits(text: Column) -> Column:
    """map<route, patterns that match>, routes without any left out; the handbook's count half beside a data route."""
    counts = {route: sum((says(text, p).cast("double") for p in patterns), F.lit(0.0)) for route, patterns in ROUTES.items()}
    data = F.greatest(*(counts[r] for r in DATA_ROUTES))
    counts["handbook"] = counts["handbook"] * F.when(data > 0, 0.5).otherwise(1.0)
    entries = F.array(*(F.struct(F.lit(r).alias("key"), c.alias("value")) for r, c in counts.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def inherited_hits(own: Column, before: Column, is_follow_up: Column) -> Column:
    """A follow-up without hits, or with the handbook's only, takes those of the message before it."""

    def only_handbook(hits: Column) -> Column:
        return (F.size(hits) == 1) & F.map_contains_key(hits, "handbook")

    weak = (F.size(own) == 0) | only_handbook(own)
    usable = before.isNotNull() & (F.size(before) > 0) & ~(only_handbook(before) & (F.size(own) > 0))
    return F.when(weak & is_follow_up & usable, before).otherwise(own)


def probabilities(hits: Column, options: list[str] = OPTIONS) -> Column:
    """map<option, share>: 0.9 by weight for those that have one and 0.1 over the others, or 1 if there are none; all alike without hits."""
    n = len(options)
    weights = F.map_filter(hits, lambda o, v: (v > 0) & o.isin(options))
    others = n - F.size(weights)
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, x: a + x)
    own = lambda o: F.try_element_at(weights, F.lit(o))
    weighted = lambda o: F.when(others > 0, 0.9).otherwise(1.0) * own(o) / total
    share = lambda o: F.when(F.size(weights) == 0, 1.0 / n).when(own(o).isNotNull(), weighted(o)).otherwise(0.1 / F.greatest(others, F.lit(1)))
    return F.map_from_arrays(F.array(*map(F.lit, options)), F.array(*(F.bround(share(o), 4) for o in options)))


def best(shares: Column, options: list[str] = OPTIONS) -> Column:
    """The option of the largest share, the first of equal ones."""
    top = F.array_max(F.map_values(shares))
    return F.coalesce(*(F.when(F.element_at(shares, F.lit(o)) == top, o) for o in options))


def first_said(message: Column, past: Column, is_follow_up: Column, options: list[tuple[str, str]]) -> Column:
    """The first option that the message names, or for a follow-up what the newest earlier message that names one said; else not_stated."""
    return F.coalesce(*(F.when(says(message, p), name) for name, p in options), F.when(is_follow_up, past), F.lit("not_stated"))


def answer_turns(turns: DataFrame, account: str | None = None) -> DataFrame:
    """The answers for rows with message and last_user: route and its probabilities, yes-or-no questions, arguments.

    ``past_day`` and ``past_time_of_day``, if there, are what the user said last
    in the whole thread; without them only ``last_user`` is looked at.
    """
    message, last = F.col("message"), F.col("last_user")
    named = lambda options: F.coalesce(*(F.when(says(last, p), name) for name, p in options))
    past = lambda name, options: F.col(f"past_{name}") if f"past_{name}" in turns.columns else named(options)
    times = [("specific_time", SPECIFIC_TIME), *((w, rf"\b{w}\b") for w in ("morning", "afternoon", "evening"))]
    rows = turns.withColumn("is_follow_up", follow_up(message, last)).withColumn("own_hits", route_hits(message)).withColumn("before_hits", F.when(last.isNotNull(), route_hits(last)))
    rows = rows.withColumn("hits", inherited_hits(F.col("own_hits"), F.col("before_hits"), F.col("is_follow_up")))
    asked = F.map_from_arrays(F.array(F.lit("handbook")), F.array(F.lit(0.4)))
    top = F.array_max(F.map_values("hits"))
    sharper = F.when(F.size("hits") > 1, F.transform_values("hits", lambda _, v: F.when(v == top, v * 1.5).otherwise(v))).otherwise(F.col("hits"))
    rows = rows.withColumn("hits", F.when((F.size("hits") == 0) & says(message, QUESTION), asked).otherwise(sharper))
    shares = probabilities(F.col("hits"))
    yes = lambda condition, a, b: F.when(condition, F.lit(a)).otherwise(F.lit(b))
    rows = rows.withColumn("probabilities", shares).withColumn("route", best(F.col("probabilities"))).withColumn("confidence", F.element_at("probabilities", F.col("route")))
    n_data = sum((F.map_contains_key("own_hits", r).cast("int") for r in DATA_ROUTES if r != "concept"), F.lit(0))
    ids = F.regexp_extract_all(message, F.lit(r"\bA\d{4}\b"), F.lit(0))
    foreign = F.exists(ids, lambda i: F.lit(True) if account is None else i != account)
    either = lambda p: says(message, p) | (F.col("is_follow_up") & says(last, p))
    change = F.lit(False)
    for p in WANTS_CHANGE:
        change = change | says(message, p)
    rows = rows.select(
        "*",
        yes(n_data >= 2, 0.85, 0.08).alias("several_sources"),
        yes(F.col("is_follow_up"), 0.85, 0.1).alias("follow_up"),
        yes(change, 0.9, 0.05).alias("wants_change"),
        yes(says(message, WANTS_STAFF), 0.88, 0.05).alias("wants_staff"),
        yes(says(message, INJECTION), 0.95, 0.03).alias("injection"),
        F.when(foreign, 0.95).when(says(message, OTHER_ACCOUNT), 0.8).otherwise(0.03).alias("other_account"),
        yes(says(message, MISCONDUCT), 0.9, 0.02).alias("misconduct"),
        yes(either(r"\bprojector\b"), 0.95, 0.04).alias("needs_projector"),
        yes(either(r"\b(pcs?|computers?)\b"), 0.9, 0.04).alias("needs_pcs"),
        yes(says(message, NUMBER) | (F.col("is_follow_up") & says(last, NUMBER)), 0.95, 0.05).alias("amount_stated"),
        F.when(F.map_contains_key("hits", "rooms") & ~(says(message, SPECIFIC_TIME) | F.col("is_follow_up")), 0.7)
        .when(F.map_contains_key("hits", "currency") & ~says(message, NUMBER), 0.75).otherwise(0.2).alias("missing_info"),
        F.when(says(message, r"\b(explain|why|compare|difference|how does)\b"), 1.8).when(F.size(F.split(F.trim(message), r"\s+")) <= 6, 0.2).otherwise(1.0).alias("complexity"),
        first_said(message, past("day", WORDS_OF_DAY), F.col("is_follow_up"), WORDS_OF_DAY).alias("day"),
        first_said(message, past("time_of_day", times), F.col("is_follow_up"), times).alias("time_of_day"),
        F.when(says(message, TO_KHR), "usd_to_khr").when(says(message, TO_USD), "khr_to_usd")
        .when(says(message, USD) & says(message, KHR), F.when(F.regexp_instr(message, F.lit("(?i)" + USD)) < F.regexp_instr(message, F.lit("(?i)" + KHR)), "usd_to_khr").otherwise("khr_to_usd"))
        .otherwise("not_stated").alias("currency_direction"),
    )
    top_guard = F.greatest(yes(F.col("injection") > 0.5, 0.95, 0.0), F.col("other_account"), yes(F.col("misconduct") > 0.5, 0.9, 0.0))
    return rows.withColumn("severity", F.when(top_guard >= 0.9, 2.4).when(top_guard >= 0.7, 2.0).when(top_guard >= 0.35, 1.0).otherwise(0.05))


@dataclass(frozen=True)
class Thresholds:
    block: float = 0.70
    review: float = 0.35
    severity: float = 2.0
    staff: float = 0.60
    low: float = 0.50
    high: float = 0.80
    stated: float = 0.50
    missing: float = 0.80
    several: float = 0.60


def decide(answers: DataFrame, t: Thresholds = Thresholds(), tools: bool = True, agent: bool = True, has_slots: Column | None = None) -> DataFrame:
    """Add action and reason: guards, staff, confidence, small talk, handbook, missing details, agent, tool, in this order."""
    slots = F.lit(False) if has_slots is None else has_slots
    guard = F.greatest("injection", "other_account", "misconduct")
    flagged = guard >= t.review
    route = F.col("route")
    pool = lambda routes: sum((F.element_at("probabilities", F.lit(r)) for r in routes), F.lit(0.0))
    several = F.col("several_sources") >= t.several
    confidence = F.greatest(
        F.col("confidence"),
        F.when(route.isin(RAG_ROUTES), pool(RAG_ROUTES)).otherwise(0.0),
        F.when(route.isin(DATA_ROUTES) & several & F.lit(agent and tools), pool(DATA_ROUTES)).otherwise(0.0),
    )
    wants = F.col("wants_change") >= 0.5
    no_direction, no_amount = F.col("currency_direction") == "not_stated", F.col("amount_stated") < t.stated
    no_day, no_time = F.col("day") == "not_stated", F.col("time_of_day") == "not_stated"
    chain: list[tuple[Column, str, str]] = [
        ((guard >= t.block) | (flagged & (F.col("severity") >= t.severity)), "refuse", "guard"),
        (F.col("wants_staff") >= t.staff, "handoff", "wants_staff"),
        (route.isNull() | (confidence < t.low), "clarify", "route"),
        (wants & (confidence < t.high) & ~slots, "clarify", "write"),
        (route == "chit_chat", "small", "chit_chat"),
        (route.isin(RAG_ROUTES), "rag", "route"),
        ((route == "currency") & no_direction, "clarify", "currency_direction"),
        ((route == "currency") & no_amount, "clarify", "amount"),
        ((route == "rooms") & no_day & ~slots, "clarify", "day"),
        ((route == "rooms") & no_time & ~slots, "clarify", "time"),
        (F.lit(not tools), "abstain", "no tools"),
        (several & F.lit(agent), "agent", "several_sources"),
        ((F.col("missing_info") >= t.missing) & ~slots, "clarify", "missing_info"),
        (F.lit(True), "tool", "route"),
    ]
    step = F.coalesce(*(F.when(condition, F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))) for condition, action, reason in chain))
    return answers.withColumn("confidence", F.bround(confidence, 4)).withColumn("flagged", flagged).withColumn("step", step).select("*", "step.action", "step.reason").drop("step")


def level_distribution(levels: int, expected: Column) -> Column:
    """map<level, share> of an expected score: all on the two levels beside it, the nearer one more; scores beyond the levels are at their end."""
    held = F.least(F.lit(levels - 1.0), F.greatest(F.lit(0.0), expected))
    low = F.floor(held).cast("int")
    high, part = F.least(F.lit(levels - 1), low + 1), held - low
    share = lambda k: F.when(low == k, F.bround(1 - part, 4)).otherwise(0.0) + F.when(high == k, F.bround(part, 4)).otherwise(0.0)
    return F.map_from_arrays(F.array(*(F.lit(str(k)) for k in range(levels))), F.array(*(share(k) for k in range(levels))))
