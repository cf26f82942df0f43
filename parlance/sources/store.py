"""A store of analysis results on Parquet: entries by key and document, versions, refreshes.

Entries are only ever appended, each with a version above all before it; the latest of a key and
document is the one with the highest. Appends of one analysis are serialised in the driver, and
concurrent requests for the same computation share its result or its error.
"""

from __future__ import annotations

import hashlib
import json
import re
import threading
from collections.abc import Callable
from concurrent.futures import Future
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

SCHEMA = "analysis_key string, entry string, version long, base_version long, computed_at timestamp, error string, data string"
_KEY = re.compile(r"^[0-9a-f]{32}$")
_ENTRY = re.compile(r"^[a-z]+(?:@[0-9a-f]{16})?$")
#: What each document depends on, besides the transcript.
PARTS = {"base": (), "content": (), "decisions": ("chair", "attendees"), "tasks": ("chair", "attendees", "tasks", "meeting_date")}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def analysis_key(payload: object, fingerprint: str) -> str:
    """32 hex digits of the transcript and of what computes the results."""
    return hashlib.sha256(f"{fingerprint}\n{canonical(payload)}".encode()).hexdigest()[:32]


def entry_name(document: str, request: dict) -> str:
    """A document and the hash of only those inputs that it depends on."""
    parts = PARTS[document]
    return document if not parts else f"{document}@{hashlib.sha256(canonical({p: request.get(p) for p in parts}).encode()).hexdigest()[:16]}"


def fingerprint(sources: dict[str, bytes], settings: dict[str, str]) -> str:
    """A hash of code and settings, whose change makes stored results stale."""
    h = hashlib.sha256()
    for name in sorted(sources):
        h.update(name.encode() + b"\0" + hashlib.sha256(sources[name]).digest())
    h.update(canonical(settings).encode())
    return h.hexdigest()


class SingleFlight:
    """Concurrent calls under one name run once and share the result or the error."""

    def __init__(self) -> None:
        self._lock, self._running = threading.Lock(), {}

    def run(self, name: str, compute: Callable[[], object]) -> object:
        with self._lock:
            mine = self._running.get(name) is None
            future = self._running.setdefault(name, Future())
        if not mine:
            return future.result()
        try:
            future.set_result(compute())
        except BaseException as error:
            future.set_exception(error)
        finally:
            with self._lock:
                del self._running[name]
        return future.result()


class AnalysisStore:
    """Entries under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._lock, self._flight = threading.RLock(), SingleFlight()

    def entries(self) -> DataFrame:
        """All versions; a store that doesn't exist yet is empty."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def latest(self) -> DataFrame:
        """The newest entry without an error of each key and name."""
        rows = self.entries().filter("error is null")
        return rows.groupBy("analysis_key", "entry").agg(F.max_by(F.struct("version", "base_version", "computed_at", "data"), "version").alias("e")).select("analysis_key", "entry", "e.*")

    def load(self, key: str, entry: str) -> Row | None:
        self._check(key, entry)
        return self.latest().filter((F.col("analysis_key") == key) & (F.col("entry") == entry)).first()

    def save(self, key: str, entry: str, data: object, base_version: int | None = None, error: str | None = None) -> int:
        """Appends an entry; its version is above all of its analysis."""
        self._check(key, entry)
        with self._lock:
            newest = self.entries().filter(F.col("analysis_key") == key).agg(F.max("version")).first()[0] or 0
            row = [(key, entry, newest + 1, base_version, datetime.now(UTC).replace(tzinfo=None), error, None if data is None else canonical(data))]
            self.spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return newest + 1

    def save_all(self, rows: DataFrame) -> None:
        """Appends many results (analysis_key, entry, base_version, data) at once, each above its analysis' versions."""
        with self._lock:
            newest = self.entries().groupBy("analysis_key").agg(F.max("version").alias("_v"))
            numbered = rows.join(newest, "analysis_key", "left").withColumn("version", F.coalesce("_v", F.lit(0)) + 1)
            numbered.select("analysis_key", "entry", "version", "base_version", F.current_timestamp().alias("computed_at"), F.lit(None).cast("string").alias("error"), "data").write.mode("append").parquet(self.path)

    @staticmethod
    def _check(key: str, entry: str) -> None:
        if not _KEY.match(key) or not _ENTRY.match(entry):
            raise ValueError(f"no valid key: {key}/{entry}")

    def document(self, key: str, document: str, request: dict, base: Callable[[], object], compute: Callable[[object], object], refresh: bool = False, refresh_base: bool = False) -> dict:
        """A document, from the store or computed, and where it is from: cached, computed or stale.

        A document made from an older base is computed again. If that fails and there is an older
        document, it is returned as stale and the error recorded; else the error is raised.
        """

        def run() -> dict:
            b = None if refresh_base else self.load(key, "base")
            if b is None:
                self.save(key, "base", base())
                b = self.load(key, "base")
            name = entry_name(document, request)
            old = self.load(key, name)
            if old is not None and not refresh and old.base_version == b.version:
                return {"data": json.loads(old.data), "version": old.version, "from": "cached"}
            try:
                data = compute(json.loads(b.data))
            except Exception as error:
                self.save(key, name, None, b.version, f"{type(error).__name__}: {error}")
                if old is None or old.base_version != b.version:
                    raise
                return {"data": json.loads(old.data), "version": old.version, "from": "stale"}
            return {"data": data, "version": self.save(key, name, data, b.version), "from": "computed"}

        return self._flight.run(f"{key}/{entry_name(document, request)}/{refresh}/{refresh_base}", run)

    def cached(self, key: str, document: str, request: dict) -> dict | None:
        """A stored document whose base is still the newest, without computing anything."""
        b, old = self.load(key, "base"), self.load(key, entry_name(document, request))
        return json.loads(old.data) if b is not None and old is not None and old.base_version == b.version else None
