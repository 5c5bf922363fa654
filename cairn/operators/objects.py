"""Objects in a model's reply: the first whole one is taken, and what it answers is checked field by field."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?m)^```(?:json)?|```$"


def balanced(text: Column) -> Column:
    """The text up to where its first bracket is closed again; null if it never is. Brackets in strings don't count, escaped quotes don't end them."""
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        at = s["at"] + 1
        opens, closes = ~s["quoted"] & (c == "{"), ~s["quoted"] & (c == "}")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        toggles = (c == '"') & ~s["escaped"]
        escaped = s["quoted"] & (c == "\\") & ~s["escaped"]
        now = F.struct(at.alias("at"), depth.alias("depth"), F.when(toggles, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), escaped.alias("escaped"), F.when(closes & (depth == 0), at).otherwise(0).alias("end"))
        return F.when(s["end"] > 0, s).otherwise(now)

    end = F.aggregate(F.split(text, ""), begin, step)["end"]
    return F.when(end > 0, F.substr(text, F.lit(1), end))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A body over a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_object(text: Column) -> Column:
    """The first balanced object of a text that can be parsed, as text; null if there is none. Code fences don't matter.

    Each opening bracket is tried in turn until one begins such an object.
    """

    def search(plain: Column) -> Column:
        places = F.transform(F.split(plain, ""), lambda c, k: F.when(c == "{", k + 1))
        valid = lambda tried: F.when(F.try_parse_json(tried).isNotNull(), tried)
        attempt = lambda found, at: F.coalesce(found, let(balanced(F.substr(plain, at)), valid))
        return F.aggregate(F.array_compact(places), F.lit(None).cast("string"), attempt)

    return let(F.trim(F.regexp_replace(F.trim(text), FENCE, "")), search)


@dataclass(frozen=True)
class Yes:
    """A probability."""


@dataclass(frozen=True)
class Choice:
    options: tuple[str, ...]


@dataclass(frozen=True)
class Score:
    levels: int


Spec = Yes | Choice | Score
KEY = {Yes: "noul", Choice: "choice", Score: "score"}


def answer(reply: Column, name: str, spec: Spec) -> Column:
    """struct<value, defect>: a question's answer in a reply's object, as text, or the neutral one where it isn't valid.

    Neutral are 0.5, the first option and the middle score.
    """
    value = lambda kind: F.try_variant_get(F.try_parse_json(reply), f"$.{name}.{KEY[type(spec)]}", kind)
    if isinstance(spec, Yes):
        number, neutral = value("double"), F.lit(0.5)
        good = (number >= 0) & (number <= 1)
    elif isinstance(spec, Choice):
        number, neutral = value("string"), F.lit(spec.options[0])
        good = number.isin(*spec.options)
    else:
        number, neutral = value("double"), F.lit((spec.levels - 1) / 2)
        good = (number >= 0) & ~F.isnan(number)
    good = F.coalesce(good, F.lit(False))
    return F.struct(F.when(good, number).otherwise(neutral).cast("string").alias("value"), (~good).alias("defect"))


def checked_reply(text: Column, specs: Mapping[str, Spec]) -> Column:
    """struct<ok, answers, defects>: whether a reply holds an object, its answers by question, and how many were replaced. Without an object there are none."""

    def shown(each: Column) -> Column:
        ok = each["reply"].isNotNull()
        values = F.struct(*(each[name]["value"].alias(name) for name in specs))
        defects = sum((each[name]["defect"].cast("int") for name in specs), F.lit(0))
        return F.struct(ok.alias("ok"), F.when(ok, values).alias("answers"), F.when(ok, defects).alias("defects"))

    answers = lambda reply: F.struct(reply.alias("reply"), *(answer(reply, name, spec).alias(name) for name, spec in specs.items()))
    return let(let(first_object(text), answers), shown)
