"""A keyspace in a folder: log appends, flushes, compactions and snapshots that readers resolve by the manifest alone.

Runs and log slices are Parquet folders that are written completely before the manifest names them. The manifest is a
sequence of numbered JSON versions; a version is written under another name and renamed, which fails where the version
exists, so readers see whole versions only, and a compaction whose inputs changed meanwhile fails and changes nothing.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ENTRY_MEMORY, LEVEL0_TRIGGER, TOMBSTONE, VALUE
from ..plans.latest import by_window
from . import runs as R
from .visibility import global_positions

LOG_SCHEMA = "seq long, key string, op byte, value string"
EMPTY = {"next": 1, "seq": 0, "log": [], "levels": {"0": [], "1": []}, "flushes": 0, "flush_ms": 0, "batches": {}}


class Conflict(RuntimeError):
    """Another writer committed first."""


class Keyspace:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._store().mkdirs(self._at("manifest"))

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _store(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, store = self._at(folder), self._store()
        return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []

    def _version(self) -> tuple[int, dict]:
        found = [int(m[1]) for x in self._names("manifest") if (m := re.fullmatch(r"(\d+)\.json", x))]
        if not found:
            return 0, dict(EMPTY)
        text = self.spark.read.text(f"{self.path}/manifest/{max(found)}.json", wholetext=True).first()[0]
        return max(found), EMPTY | json.loads(text)

    def _commit(self, version: int, state: dict) -> None:
        ready, target = self._at(f"manifest/.{uuid.uuid4().hex}"), self._at(f"manifest/{version + 1}.json")
        out = self._store().create(ready, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._store().getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(ready, target, none)  # fails if the version exists
        except Exception as error:
            self._store().delete(ready, False)
            raise Conflict(f"version {version + 1} exists") from error

    def write(self, records: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Append ``key``, ``op``, ``value`` in the order of column ``order`` (ties in any order).

        ``batch``, a stream's name and the number of its batch, makes an append that is tried again have no effect.
        """
        version, state = self._version()
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return
        number, start = state["next"], state["seq"]
        rows = global_positions(records.select("order", "key", F.col("op").cast("byte").alias("op"), "value"), ["order"])
        path = f"{self.path}/log/{number}"
        rows.select((F.lit(start) + F.col("pos")).alias("seq"), "key", "op", "value").write.mode("overwrite").parquet(path)  # a lost attempt's files go
        written = self.spark.read.schema(LOG_SCHEMA).parquet(path).count()
        batches = state["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._commit(version, state | {"next": number + 1, "seq": start + written, "log": [*state["log"], number], "batches": batches})

    def log_path(self, number: int) -> str:
        return f"{self.path}/log/{number}"

    def _read(self, kind: str, numbers: list[int]) -> DataFrame:
        paths = [f"{self.path}/{kind}/{n}" for n in numbers]
        return self.spark.read.schema(LOG_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], LOG_SCHEMA)

    def records(self) -> DataFrame:
        """All records of the current version."""
        _, s = self._version()
        return self._read("log", s["log"]).unionByName(self._read("run", s["levels"]["0"] + s["levels"]["1"]))

    def live(self) -> DataFrame:
        return by_window(self.records()).where(F.col("op") == VALUE).select("key", "value")

    def get(self, key: str) -> str | None:
        row = by_window(self.records().where(F.col("key") == key)).where(F.col("op") == VALUE).select("value").first()
        return row.value if row else None

    def flush(self) -> None:
        """The log so far becomes one level-0 run, tombstones kept; two level-0 runs start a compaction."""
        began = time.monotonic()
        version, s = self._version()
        if not s["log"]:
            return
        number = s["next"]
        R.write_run(by_window(self._read("log", s["log"])), f"{self.path}/run/{number}")
        spent = int((time.monotonic() - began) * 1000)
        self._commit(version, s | {"next": number + 1, "log": [], "levels": s["levels"] | {"0": [*s["levels"]["0"], number]}, "flushes": s["flushes"] + 1, "flush_ms": spent})
        if len(s["levels"]["0"]) + 1 >= LEVEL0_TRIGGER:
            self.compact()

    def compact(self) -> None:
        """All level-0 runs into one more level-1 run, or into nothing if only spent tombstones were left."""
        version, s = self._version()
        if not s["levels"]["0"]:
            return
        upper = by_window(self._read("run", s["levels"]["0"]))
        below = by_window(self._read("run", s["levels"]["1"])).where(F.col("op") == VALUE).select("key")
        merged = upper.where(F.col("op") == VALUE).unionByName(upper.where(F.col("op") == TOMBSTONE).join(below, "key", "left_semi"))
        number = s["next"]
        R.write_run(merged, f"{self.path}/run/{number}")
        empty = self._read("run", [number]).isEmpty()
        self._commit(version, s | {"next": number + 1, "levels": {"0": [], "1": s["levels"]["1"] + ([] if empty else [number])}})

    def close(self) -> None:
        """A last flush; nothing where nothing was written since the one before."""
        self.flush()

    def vacuum(self) -> list[str]:
        """Delete logs and runs that the current version does not name, for when no reader holds an older one; returns them."""
        _, s = self._version()
        kept = {f"log/{n}" for n in s["log"]} | {f"run/{n}" for n in s["levels"]["0"] + s["levels"]["1"]}
        gone = [f"{kind}/{n}" for kind in ("log", "run") for n in self._names(kind) if f"{kind}/{n}" not in kept]
        for name in gone:
            self._store().delete(self._at(name), True)
        return gone

    def level_size(self, level: int) -> int:
        return len(self._version()[1]["levels"].get(str(level), []))

    def status(self) -> dict:
        _, s = self._version()
        memory = self._read("log", s["log"]).select("key").distinct().count()
        return {"mem_count": memory, "l0_count": len(s["levels"]["0"]), "l1_count": len(s["levels"]["1"]), "flushes": s["flushes"], "flush_ms": s["flush_ms"], "approx_mem_bytes": ENTRY_MEMORY * memory}
