"""Knowledge carried from run to run: versioned folders of Parquet tables and a pointer file.

A version is written whole under v=N and becomes current by replacing the pointer, so readers see the old or the new
state; both lie where Spark reads and writes, so executors share them. Only the last five older versions stay;
`rollback(n)` makes the n-th last current again.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.runtime import SharedFolder

SCHEMA_VERSION = "1"
TABLES = {
    "identities": "hash string, cluster_uid string, confidence double",
    "projects": "uid string, hash string, weight double, last_seen string",
    "frequencies": "hash string, freq long",
    "contradictions": "hash string, identity_a string, identity_b string, strategy string, confidence double, resolved_at string",
    "history": "run string, at string",
}
KEYS = {"identities": ["hash"], "projects": ["uid"], "frequencies": ["hash"]}
KEEP = 5


class KnowledgeStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder, self.tables, self.dirty = spark, SharedFolder(spark, path), {}, False

    def open(self) -> KnowledgeStore:
        pointer = self.folder.read("current.json")
        if pointer is None:
            self.tables = {k: self.spark.createDataFrame([], s) for k, s in TABLES.items()}
            self.version = 0
            return self
        try:
            state = json.loads(pointer)
        except ValueError as e:
            raise ValueError(f"corrupt knowledge pointer in {self.folder.path}") from e
        if not isinstance(state, dict):
            raise ValueError(f"the pointer is not an object: {self.folder.path}")
        if state.get("schema") != SCHEMA_VERSION:
            raise ValueError(f"schema version {state.get('schema')!r}, expected {SCHEMA_VERSION!r}")
        self.version = int(state["version"])
        self.tables = {k: self.spark.read.schema(s).parquet(f"{self.folder.path}/v={self.version}/{k}") for k, s in TABLES.items()}
        return self

    def upsert(self, table: str, rows: DataFrame) -> None:
        """rows replace those with the same key; contradictions and history only grow."""
        rows = rows.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in TABLES[table].split(", ")])
        old = self.tables[table]
        if table in KEYS:
            old = old.join(rows.select(*KEYS[table]).distinct(), KEYS[table], "left_anti")
        self.tables[table] = old.unionByName(rows)
        self.dirty = True

    def add_frequencies(self, hashes: DataFrame) -> None:
        counts = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("freq"))
        self.tables["frequencies"] = self.tables["frequencies"].unionByName(counts).groupBy("hash").agg(F.sum("freq").alias("freq"))
        self.dirty = True

    def _row(self, table: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, TABLES[table])

    def get_identity(self, hash: str) -> str | None:
        found = self.tables["identities"].where(F.col("hash") == hash).select(F.nullif("cluster_uid", F.lit(""))).first()
        return found[0] if found else None

    def set_identity(self, hash: str, cluster_uid: str, confidence: float) -> None:
        self.upsert("identities", self._row("identities", [(hash, cluster_uid, float(confidence))]))

    def get_project(self, uid: str) -> dict[str, float] | None:
        """A project's hashes and weights; one project is one record."""
        rows = self.tables["projects"].where(F.col("uid") == uid).select("hash", "weight").collect()
        return {r.hash: r.weight for r in rows} or None

    def set_project(self, uid: str, fingerprint: dict[str, float]) -> None:
        now = datetime.now(UTC).isoformat()
        self.upsert("projects", self._row("projects", [(uid, h, float(w), now) for h, w in fingerprint.items()]))

    def get_frequency(self, hash: str) -> int:
        found = self.tables["frequencies"].where(F.col("hash") == hash).first()
        return found.freq if found else 0

    def increment_frequency(self, hash: str) -> int:
        self.add_frequencies(self.spark.createDataFrame([(hash,)], "hash string"))
        return self.get_frequency(hash)

    def add_contradiction(self, record: object) -> None:
        """A mapping, or an object with the fields of one; anything else is a TypeError."""
        fields = [f.split()[0] for f in TABLES["contradictions"].split(", ")]
        own = dict(record) if isinstance(record, Mapping) else getattr(record, "__dict__", None)
        if not own or not set(own) & set(fields):
            raise TypeError(f"not a contradiction: {type(record).__name__}")
        values = [own.get(f) for f in fields]
        values[fields.index("confidence")] = float(own.get("confidence") or 0.0)
        self.upsert("contradictions", self._row("contradictions", [tuple(values)]))

    def get_contradictions(self) -> list[dict]:
        """All of them, on the driver; whole tables are in `tables`."""
        return [r.asDict() for r in self.tables["contradictions"].collect()]

    def counts(self) -> dict[str, int]:
        return {"identities": self.tables["identities"].count(), "projects": self.tables["projects"].select("uid").distinct().count(), "contradictions": self.tables["contradictions"].count()}

    def has_data(self) -> bool:
        return any(self.counts().values())

    def close(self, run: str | None = None) -> None:
        """Write the next version if anything changed, then drop versions beyond the kept ones."""
        if not self.dirty:
            return
        if run:
            self.upsert("history", self.spark.createDataFrame([(run, datetime.now(UTC).isoformat())], TABLES["history"]))
        to = max(self._versions(), default=0) + 1
        for name, df in self.tables.items():
            df.write.parquet(f"{self.folder.path}/v={to}/{name}")
        self._point(to)
        for v in self._versions()[: -(KEEP + 1)]:
            self.folder.delete(f"v={v}")
        self.dirty = False
        self.open()

    def rollback(self, n: int = 1) -> None:
        if n < 1:
            raise ValueError("n must be at least 1")
        older = [v for v in self._versions() if v < self.open().version]
        if len(older) < n:
            raise FileNotFoundError(f"no backup {n} in {self.folder.path}")
        self._point(older[-n])
        self.open()

    def _versions(self) -> list[int]:
        return sorted(int(name[2:]) for name in self.folder.names() if name.startswith("v="))

    def _point(self, version: int) -> None:
        self.folder.replace("current.json", json.dumps({"schema": SCHEMA_VERSION, "version": version}))
