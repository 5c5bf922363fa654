"""A keyed table in versions: new files first, then one switch of the newest version.

Rows are dealt over a fixed number of key partitions. An upsert or a delete writes
only the partitions whose keys it touches; the others' files are shared with
the version before. A version is a small file that lists each partition's folders,
and it comes into being by one rename that fails if the version is there. So a
reader has the old version or the new one, a writer that is killed leaves files
that no version names, and of two writers one is refused.

The rename has to be atomic in the file system, as it is in HDFS and on disks.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.sources.shared import Files

PART = "_part"


class Conflict(RuntimeError):
    """Another writer made the version meanwhile; read again and repeat."""


@dataclass(frozen=True)
class Version:
    number: int
    keys: list[str]
    n_parts: int
    schema: str
    parts: dict[str, list[str]]  # folders by partition
    batches: dict[str, int] = field(default_factory=dict)  # the newest batch of each stream that appended


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: list[str], n_parts: int = 16) -> VersionedTable:
        """An empty table, version 0. Keys may be null; a null key is a key like any other."""
        table = cls(spark, path)
        table._commit(Version(0, keys, n_parts, schema.json(), {}))
        return table

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/versions") if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        number = self.versions()[-1] if number is None else number
        return Version(**json.loads(self.files.read(f"{self.path}/versions/{number:010d}.json")))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named; what is written later doesn't change them."""
        return self._rows(v := self.version(number), list(v.parts)).drop(PART)

    def upsert(self, rows: DataFrame, latest: str | None = None) -> int:
        """The rows, in place of those of the same keys. Of several rows of one key that of the largest ``latest``
        stays, or the largest row, a null being the smallest."""
        now = self.version()
        order = F.struct(*([F.col(latest).alias("_latest")] if latest else []), *rows.columns)
        new = rows.groupBy(*now.keys).agg(F.max(order).alias("row")).select(*(F.col("row")[c].alias(c) for c in self._columns(now)))
        return self._replace(now, new, new)

    def delete(self, keys: DataFrame) -> int:
        now = self.version()
        return self._replace(now, keys, None)

    def append(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """The rows beside those there are; a batch that its stream has appended already is left out."""
        now = self.version()
        if stream is not None and batch is not None and now.batches.get(stream, -1) >= batch:
            return now.number
        added = self._write(now, rows)
        parts = {p: [*now.parts.get(p, []), *added.get(p, [])] for p in {*now.parts, *added}}
        batches = now.batches | ({stream: batch} if stream is not None and batch is not None else {})
        return self._commit(Version(now.number + 1, now.keys, now.n_parts, now.schema, parts, batches))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the newest versions, and the folders that none of those names: only while nothing is being written."""
        numbers = self.versions()
        for n in numbers[:-keep]:
            self.files.delete(f"{self.path}/versions/{n:010d}.json")
        named = {f for n in numbers[-keep:] for some in self.version(n).parts.values() for f in some}
        named |= {f.rsplit("/", 1)[0] for f in named}
        gone = [w for w in self.files.names(f"{self.path}/data") if f"data/{w}" not in named]
        for write in gone:
            self.files.delete(f"{self.path}/data/{write}")
        return gone

    def _columns(self, v: Version) -> list[str]:
        return StructType.fromJson(json.loads(v.schema)).fieldNames()

    def _part(self, v: Version) -> Column:
        return F.pmod(F.xxhash64(*v.keys), F.lit(v.n_parts)).cast("int")

    def _rows(self, v: Version, parts: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(v.schema))
        folders = [f"{self.path}/{f}" for p in parts for f in v.parts.get(p, [])]
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return rows.withColumn(PART, self._part(v))

    def _replace(self, now: Version, keys: DataFrame, new: DataFrame | None) -> int:
        gone = keys.select(*now.keys).distinct()
        touched = [str(r[0]) for r in gone.select(self._part(now)).distinct().collect()]  # at most n_parts
        old = self._rows(now, touched).drop(PART)
        marked = gone.select(*(F.col(k).alias(f"gone_{k}") for k in now.keys))
        same = [F.col(k).eqNullSafe(F.col(f"gone_{k}")) for k in now.keys]
        left = old.join(marked, same, "left_anti")
        written = self._write(now, left if new is None else left.unionByName(new))
        parts = {p: f for p, f in now.parts.items() if p not in touched} | written
        return self._commit(Version(now.number + 1, now.keys, now.n_parts, now.schema, parts, now.batches))

    def _write(self, v: Version, rows: DataFrame) -> dict[str, list[str]]:
        """Step one: files that no version names yet."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.select(*self._columns(v)).withColumn(PART, self._part(v))
        dealt.write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        found = [n for n in self.files.names(f"{self.path}/{folder}") if n.startswith(f"{PART}=")]
        return {n.split("=")[1]: [f"{folder}/{n}"] for n in found}

    def _commit(self, v: Version) -> int:
        """Step two: the version itself."""
        if not self.files.write_once(f"{self.path}/versions/{v.number:010d}.json", json.dumps(asdict(v))):
            raise Conflict(f"version {v.number} of {self.path} is there already")
        return v.number
