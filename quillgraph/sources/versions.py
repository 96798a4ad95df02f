"""Tables of parts in versions: a version is a list of the parts' folders, published by one rename.

Parts are never changed in place. A writer writes new folders, then publishes a version that
names them and the old folders that stay valid; readers take the newest version and see all of
it or none. A writer whose base version is no longer the newest fails and starts again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Outdated(Exception):
    """Another writer published first."""


@dataclass(frozen=True)
class Part:
    """A folder of rows; ``facts`` are what the table's owner notes about it."""

    name: str
    folder: str
    facts: dict = field(default_factory=dict)


class Versions:
    """The versions of the table below ``path``. A version's parts are a short list: partitions or segments, never rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _store(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def newest(self) -> int:
        """The newest version's number, 0 if there is none."""
        store, where = self._store(f"{self.path}/versions")
        if not store.exists(where):
            return 0
        names = [s.getPath().getName() for s in store.listStatus(where)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def parts(self, version: int | None = None) -> list[Part]:
        version = self.newest() if version is None else version
        if not version:
            return []
        text = self.spark.read.text(f"{self.path}/versions/{version:08d}.json", wholetext=True).first()[0]
        return [Part(**p) for p in json.loads(text)]

    def publish(self, parts: list[Part], base: int) -> int:
        """Make ``parts`` the version after ``base``."""
        store, draft = self._store(f"{self.path}/versions/.draft-{uuid.uuid4().hex}")
        _, final = self._store(f"{self.path}/versions/{base + 1:08d}.json")
        out = store.create(draft, False)
        out.write(json.dumps([asdict(p) for p in parts]).encode())
        out.close()
        if store.exists(final) or not store.rename(draft, final):
            store.delete(draft, False)
            raise Outdated(f"version {base + 1} of {self.path} is there already")
        return base + 1

    def folder(self) -> str:
        """A new folder for a part, relative to the table."""
        return f"parts/{uuid.uuid4().hex}"

    def read(self, parts: list[Part], schema: StructType | str) -> DataFrame:
        """The rows of some parts."""
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p.folder}" for p in parts))

    def drop_unused(self, keep: int = 2) -> int:
        """Delete the folders that none of the newest ``keep`` versions names, and older versions; how many folders went."""
        last = self.newest()
        used = {p.folder for v in range(max(1, last - keep + 1), last + 1) for p in self.parts(v)}
        store, where = self._store(f"{self.path}/parts")
        gone = 0
        for s in store.listStatus(where) if store.exists(where) else []:
            if f"parts/{s.getPath().getName()}" not in used:
                store.delete(s.getPath(), True)
                gone += 1
        for v in range(1, last - keep + 1):
            store.delete(self._store(f"{self.path}/versions/{v:08d}.json")[1], False)
        return gone


def merge_collection(versions: Versions, rows: DataFrame, by: str) -> dict[str, int]:
    """Make ``rows`` the table's content, parted by a column; only parts whose content differs are written.

    A part's content is told by its number of rows and two sums of hashes over all columns, so
    neither the order of rows nor that of files matters. Returns how many parts were written,
    kept and dropped. All changed parts are written by one job.
    """
    base = versions.newest()
    old = {p.name: p for p in versions.parts(base)}
    digest = [F.sum(F.xxhash64(*rows.columns, F.lit(i)).cast("decimal(38,0)")).cast("string") for i in (1, 2)]
    told = rows.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("name")).agg(F.count("*").alias("rows"), *(d.alias(f"h{i}") for i, d in enumerate(digest)))
    facts = {r["name"]: {"rows": r["rows"], "digest": [r["h0"], r["h1"]]} for r in told.collect()}  # a row a part
    changed = sorted(n for n, f in facts.items() if n not in old or old[n].facts != f)
    if changed:
        at = versions.folder()
        name = F.coalesce(F.col(by).cast("string"), F.lit(""))
        wanted = versions.spark.createDataFrame([(n,) for n in changed], "part_name string")
        some = rows.withColumn("part_name", name).join(F.broadcast(wanted), "part_name", "left_semi")
        some.withColumn("part", F.md5("part_name")).drop("part_name").repartition("part").write.partitionBy("part").parquet(f"{versions.path}/{at}")
        keys = {r[0]: r[1] for r in wanted.select("part_name", F.md5("part_name")).collect()}
    parts = [Part(n, f"{at}/part={keys[n]}" if n in changed else old[n].folder, facts[n]) for n in sorted(facts)]
    if changed or old.keys() - facts.keys():
        versions.publish(parts, base)
    return {"written": len(changed), "kept": len(facts) - len(changed), "dropped": len(old.keys() - facts.keys())}
