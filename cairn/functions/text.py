"""String functions as Spark columns: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words that term weighting leaves out, the token pattern, secret patterns.
STOP_WORDS = (
    "a an the of to in on for and or is are be by with at from as it this that what which how when where who "
    "whom does do did can could should would will after before per there any some about into than then them "
    "they its their was were been being has have had not no please tell show give much many happens "
    "happen get also just"
).split()
SEARCH_STOP_WORDS = (
    "a an the of to in on for and or is are be by with at from as it this that what which how when where "
    "who whom does do did can could should would will after before per there any some about into than "
    "then them they its their was were been being has have had not no"
).split()
EMBEDDING_STOP_WORDS = (
    "a an the of to in on for and or is are be by with at from as it this that what which how "
    "when where who does do can after before per"
).split()
KHMER = r"\x{1780}-\x{17FF}"
TOKEN = r"[A-Za-z\x{00C0}-\x{024F}]{1,4}|[0-9]{1,3}|[\x{1780}-\x{17FF}\x{19E0}-\x{19FF}]|[^\s]"
SECRETS = (
    (r"nvapi-[A-Za-z0-9_\-]{8,}", "[REDACTED]"),
    (r"hf_[A-Za-z0-9]{16,}", "[REDACTED]"),
    (r"AQ\.[A-Za-z0-9_\-]{20,}", "[REDACTED]"),
    (r"AIza[0-9A-Za-z_\-]{20,}", "[REDACTED]"),
    (r"(?i)(bearer\s+)[A-Za-z0-9._\-]{12,}", "$1[REDACTED]"),
    (r"""(?i)(typesafe_api_key\s*[=:]\s*)[^\s"',]+""", "$1[REDACTED]"),
)
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ACCOUNT_ID = r"\bA\d{4}\b"


def slug(name: Column) -> Column:
    """Lower case, runs of other characters as one dash, none at the ends; 'document' if nothing is left."""
    made = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(made == "", "document").otherwise(made)


def chunk_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(source: Column, locator: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", source, locator, text), 256), 1, 16)


def script(text: Column) -> Column:
    """none, khmer or latin, by the letters of a text."""
    khmer, latin = F.regexp_count(text, F.lit(f"[{KHMER}]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((khmer == 0) & (latin == 0), "none").when(khmer >= latin, "khmer").otherwise("latin")


def khmer_noise_share(text: Column) -> Column:
    """ASCII runs between Khmer characters, per Khmer character."""
    khmer = F.regexp_count(text, F.lit(f"[{KHMER}]"))
    wedged = F.regexp_count(text, F.lit(rf"(?<=[{KHMER}])[!-/:-@\[-`{{-~A-Za-z]+(?=[{KHMER}])"))
    return F.when(khmer == 0, F.lit(0.0)).otherwise(F.bround(wedged / khmer, 4))


def replacement_share(text: Column) -> Column:
    """How much of a text is U+FFFD."""
    n = F.char_length(text)
    lost = n - F.char_length(F.replace(text, F.lit("�"), F.lit("")))
    return F.when(n == 0, F.lit(0.0)).otherwise(lost / n)


def language_label(document_language: Column, text: Column) -> Column:
    """A chunk's language, from its document's and its own script."""
    own = script(text)
    return (
        F.when(own == "khmer", "km")
        .when((document_language == "km") & (own == "latin"), "en")
        .when(document_language.isin("en", "km"), document_language)
        .when(own == "latin", "en")
        .otherwise(document_language)
    )


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def split_at(text: Column, limit: int) -> Column:
    """struct<kept, dropped>: a text before and from its token number ``limit`` on."""
    kept = F.regexp_extract(text, rf"(?s)^(?:\s*(?:{TOKEN})){{0,{limit}}}\s*", 0)
    return F.struct(kept.alias("kept"), F.substr(text, F.char_length(kept) + 1).alias("dropped"))


def stem(word: Column) -> Column:
    """Strips one inflection ending or else one plural ending; words of up to three letters stay."""
    n = F.char_length(word)

    def ends(x: Column, *endings: str) -> Column:
        return F.rlike(x, F.lit("(?:" + "|".join(endings) + ")$"))

    def less(x: Column, k: int) -> Column:
        return F.substr(x, F.lit(1), F.char_length(x) - k)

    return (
        F.when(n <= 3, word)
        .when(ends(word, "ies") & (n - 3 >= 3), F.concat(less(word, 3), F.lit("y")))
        .when(ends(word, "ied") & (n - 3 >= 3), F.concat(less(word, 3), F.lit("y")))
        .when(ends(word, "ings") & (n - 4 >= 3), less(word, 4))
        .when(ends(word, "ing") & (n - 3 >= 3), less(word, 3))
        .when(ends(word, "ed") & (n - 2 >= 3), less(word, 2))
        .when(ends(word, "sses", "shes", "ches", "xes", "zes"), less(word, 2))
        .when(ends(word, "s") & ~ends(word, "ss"), less(word, 1))
        .otherwise(word)
    )


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_words(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    listed = F.array(*map(F.lit, stop))
    return F.filter(words(text), lambda w: ~F.array_contains(listed, w) & (F.char_length(w) > 1))


def terms(text: Column) -> Column:
    """The stems of a text's content words, each once, in order."""
    return F.array_distinct(F.transform(content_words(text), stem))


def bigrams(items: Column, between: str = " ") -> Column:
    n = F.size(items)
    pairs = F.zip_with(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), F.slice(items, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(between), b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def khmer_grams(text: Column) -> Column:
    """Three-character windows of each Khmer run; a shorter run is one."""
    runs = F.regexp_extract_all(text, F.lit(f"[{KHMER}]+"), F.lit(0))
    grams = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(r) - 2)), lambda k: F.substr(r, k, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def has_khmer(text: Column) -> Column:
    return F.rlike(text, F.lit(f"[{KHMER}]"))


def sentences(text: Column) -> Column:
    """Hard wraps joined, then split after sentence ends and at line ends; of more than three characters."""
    joined = F.regexp_replace(text, r"(?<![\n.!?:\x{17D4}])\n(?![\n\-\x{2022}])", " ")
    parts = F.split(joined, r"(?<=[.!?\x{17D4}])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^[ \-\x{2022}]+|[ \-\x{2022}]+$", "")), lambda s: F.char_length(s) > 3)


def redact(text: Column) -> Column:
    """Secrets and account ids masked."""
    for pattern, mask in SECRETS:
        text = F.regexp_replace(text, pattern, mask)
    return F.regexp_replace(text, ACCOUNT_ID, "A****")


def line_key(line: Column) -> Column:
    """Lines that differ in case, outer white space and numbers only have one key."""
    return F.regexp_replace(F.trim(F.lower(line), F.lit(WHITE_SPACE)), r"\d+", "#")


def is_page_number(line: Column) -> Column:
    return F.rlike(line, F.lit(r"(?i)^\s*(page\s*)?\d{1,4}(\s*(of|/)\s*\d{1,4})?\s*$"))


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def tidy(text: Column) -> Column:
    """No control characters, hyphenated line ends joined, runs of blanks and of empty lines shortened."""
    for pattern, new in ((r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"([a-z])-\n([a-z])", "$1$2"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, new)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_thoughts(text: Column, tag: str = "think") -> Column:
    """struct<text, removed>: a model's answer without its thinking blocks, and how many characters these had."""
    left = F.trim(F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", ""))
    return F.struct(left.alias("text"), (F.char_length(text) - F.char_length(left)).alias("removed"))


def must_keep(text: Column) -> Column:
    """Codes, ISBNs, dates and numbers that a rewrite has to hold."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,5}\d{3}\b|\b97[89]\d{10}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d+(?:[.:,]\d+)*\b"), F.lit(0)))


def keeps(rewrite: Column, original: Column) -> Column:
    return F.forall(must_keep(original), lambda x: F.contains(F.lower(rewrite), F.lower(x)))


def breadcrumb(title: Column, section: Column, between: str = " › ") -> Column:
    """The parts of a title and a section path, each once."""
    parts = F.concat(F.array(title), F.when(F.coalesce(section, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(section, between)))
    return F.concat(F.lit("# "), F.array_join(F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda p: p != "")), between))


def cited(answer: Column, citations: Column) -> Column:
    """An answer and those of its citations, each once, that it doesn't hold yet."""
    new = F.filter(F.array_distinct(citations), lambda c: ~F.contains(answer, c))
    return F.when(F.size(new) == 0, answer).otherwise(F.concat(answer, F.lit(" "), F.array_join(new, " ")))


def fixture_key(parameters: Column) -> Column:
    """A map as a file name: sorted k-v pairs, other characters as dashes, at most 60 characters."""
    pairs = F.transform(F.array_sort(F.map_entries(parameters)), lambda e: F.concat(e["key"], F.lit("-"), e["value"]))
    return F.substring(F.trim(F.regexp_replace(F.lower(F.array_join(pairs, "-")), "[^a-z0-9]+", "-"), F.lit("-")), 1, 60)
