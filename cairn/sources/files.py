"""Reading and writing the tables, documents and logs of a collection, always with a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The seed tables and their columns.
SEED = {
    "accounts": "id string, display_name string, cohort string",
    "courses": "code string, title string, credits int",
    "enrollments": "account_id string, course_code string",
    "rooms": "id string, building string, capacity int, has_projector int, has_pcs int",
    "sessions": "course_code string, weekday string, start string, end string, room_id string, kind string",
    "room_bookings": "room_id string, date string, start string, end string, account_id string, purpose string, status string",
    "books": "isbn string, title string, authors string, year int, copies_total int",
    "loans": "isbn string, account_id string, due_date string, returned int",
    "holds": "isbn string, account_id string, created_at string, status string",
    "assignments": "course_code string, title string, due_at string, weight double",
    "events": "title string, date string, start string, end string, location string, kind string",
}
MANIFEST = "source_id string, file string, format string, title string, language string, licence string, origin string, added string"
SPANS = "trace_id string, span string, span_id string, parent string, start string, ms double, provider string, tokens_in long, tokens_out long, calls long, error string"
PROBES = "question string, source_id string, label string, page long, section_contains string"


def seed_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A seed CSV; empty cells are null. Bookings, holds and events get ids by file order."""
    rows = spark.read.schema(SEED[name]).option("header", True).csv(f"{folder}/{name}.csv")
    if name in ("room_bookings", "holds", "events"):
        rows = numbered(rows)
    return rows.withColumn("source", F.lit("seed")) if name == "events" else rows


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with id, from 1 without gaps, in file order: each partition's start is the count of those before it."""
    low = F.lit((1 << 33) - 1)
    placed = rows.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))  # a row per partition
    return placed.join(starts, "part").select((F.col("id").bitwiseAND(low) + F.col("start") + 1).alias("id"), *rows.columns)


def content_hash(table: DataFrame) -> DataFrame:
    """sha256 of a table's content, whatever the order of its rows: of the sums of the parts of each row's hash, and the count."""
    rows = table.select(F.sha2(F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}), 256).alias("h"))
    part = lambda k: F.sum(F.conv(F.substr("h", F.lit(1 + 16 * k), F.lit(15)), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.sha2(F.concat_ws("|", F.count("*"), *(F.coalesce(part(k), F.lit(0)) for k in range(4))), 256).alias("sha256"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("header", True).csv(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    rows.select(*names).na.fill("").write.mode("overwrite").option("header", True).csv(path)


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """path, file, format, sha256, length of the documents in a folder; dotfiles and other formats are skipped."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))
    form = F.when(kind == "pdf", "pdf").when(kind.isin("md", "markdown"), "md")
    return files.select("path", name.alias("file"), form.alias("format"), F.sha2("content", 256).alias("sha256"), "length").where(F.col("format").isNotNull() & ~F.col("file").startswith("."))


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of the Markdown files in a folder."""
    return spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_spans(spans: DataFrame, path: str) -> None:
    """Spans by day; text columns but account_id are redacted."""
    from cairn.functions.text import redact

    for field in spans.schema:
        if field.dataType.simpleString() == "string" and field.name not in ("account_id", "trace_id", "span_id", "parent"):
            spans = spans.withColumn(field.name, redact(F.col(field.name)))
    spans.withColumn("day", F.substring("start", 1, 10)).write.mode("append").partitionBy("day").json(path)


def select_cases(cases: DataFrame, subset: str | None) -> DataFrame:
    """Evaluation cases by category, tag or id; 'routing' means the tag seed-routing."""
    if not subset:
        return cases
    asked = ["seed-routing" if x == "routing" else x for x in subset.split(",")]
    return cases.where(F.col("category").isin(asked) | F.arrays_overlap("tags", F.array(*map(F.lit, asked))) | F.col("id").isin(asked))
