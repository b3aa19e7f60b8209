"""Stored tables with versions: what is written becomes visible by one small file, all tables together.

A table is a folder with a folder per version, and in it one per bucket of its key. The state says which
version of each bucket counts; it is a JSON file in ``_state`` with a running number, written under another name
first and renamed, and the highest number is the one that holds. A write that breaks off leaves folders that no
state names, and the old state in force. A table takes one writer at a time.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from corpusmatch.schemas import conform

BUCKET = "_bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Tables:
    """The tables below one folder that all executors can reach."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._pending: dict | None = None
        self._written: list[str] = []

    # --- state ---

    def _folder(self, path: str):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        at = jvm.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _states(self) -> list[str]:
        system, at = self._folder(f"{self.path}/_state")
        if not system.exists(at):
            return []
        return sorted(s.getPath().getName() for s in system.listStatus(at) if s.getPath().getName()[:1].isdigit())

    def _state(self) -> dict:
        """``tables``: {name: {bucket: [versions]}}; ``notes``: what a writer wants to remember."""
        if self._pending is not None:
            return self._pending
        return self._load(*self._states()[-1:])

    def _load(self, name: str | None = None) -> dict:
        if name is None:
            return {"tables": {}, "notes": {}}
        system, at = self._folder(f"{self.path}/_state/{name}")
        stream = system.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self) -> None:
        before = self._states()
        number = int(before[-1].split(".")[0]) + 1 if before else 0
        system, draft = self._folder(f"{self.path}/_state/draft-{uuid.uuid4().hex}")
        stream = system.create(draft)
        stream.write(bytearray(json.dumps(self._pending).encode()))
        stream.close()
        _, final = self._folder(f"{self.path}/_state/{number:012d}.json")
        if not system.rename(draft, final):
            raise OSError(f"could not publish {final}")

    @contextmanager
    def change(self) -> Iterator[None]:
        """What is written inside is visible inside at once, and outside when the block has ended without an error."""
        if self._pending is not None:
            yield
            return
        self._pending, self._written = copy.deepcopy(self._state()), []
        try:
            yield
            self._publish()
        except BaseException:
            for folder in self._written:
                self._remove(folder)
            raise
        finally:
            self._pending = None
        self._sweep()

    def _remove(self, path: str) -> None:
        system, at = self._folder(path)
        system.delete(at, True)

    def _sweep(self) -> None:
        """Remove versions that neither the state nor the one before it names."""
        states = self._states()
        named = {
            f"{table}/{version}"
            for name in states[-2:]
            for table, buckets in self._load(name)["tables"].items()
            for versions in buckets.values()
            for version in versions
        }
        for table in self._state()["tables"]:
            system, at = self._folder(f"{self.path}/{table}")
            for s in system.listStatus(at):
                if f"{table}/{s.getPath().getName()}" not in named:
                    system.delete(s.getPath(), True)
        for name in states[:-2]:
            self._remove(f"{self.path}/_state/{name}")

    # --- notes ---

    def note(self, name: str) -> str | None:
        return self._state()["notes"].get(name)

    def set_note(self, name: str, value: str) -> None:
        with self.change():
            self._pending["notes"][name] = value

    # --- tables ---

    def read(self, name: str, schema: StructType, only: list[int] | None = None) -> DataFrame:
        """A table, empty when there is none yet; columns it lacks come as NULL. ``only`` these buckets are read."""
        buckets = self._state()["tables"].get(name, {})
        wanted = buckets if only is None else {str(b): buckets.get(str(b), []) for b in only}
        paths = [f"{self.path}/{name}/{v}/{BUCKET}={b}" for b, versions in wanted.items() for v in versions]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return conform(self.spark.read.schema(schema).parquet(*paths), schema)

    def _write(self, name: str, rows: DataFrame, bucket: Column) -> dict[str, str]:
        """{bucket: version} of what was written."""
        version = uuid.uuid4().hex
        folder = f"{self.path}/{name}/{version}"
        self._written.append(folder)
        rows.withColumn(BUCKET, bucket).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(folder)
        system, at = self._folder(folder)
        found = (s.getPath().getName() for s in system.listStatus(at))
        return {n.split("=")[1]: version for n in found if n.startswith(f"{BUCKET}=")}

    def overwrite(self, name: str, rows: DataFrame, schema: StructType, key: str | None = None) -> None:
        """Replace the whole table; ``rows`` may be computed from it."""
        with self.change():
            bucket = F.lit(0) if key is None else bucket_of(F.col(key), self.buckets)
            new = self._write(name, conform(rows, schema), bucket)
            self._pending["tables"][name] = {b: [v] for b, v in new.items()}

    def append(self, name: str, rows: DataFrame, schema: StructType, bucket: Column) -> None:
        with self.change():
            table = self._pending["tables"].setdefault(name, {})
            for b, v in self._write(name, conform(rows, schema), bucket).items():
                table[b] = [*table.get(b, []), v]

    def replace(self, name: str, rows: DataFrame, keys: DataFrame, schema: StructType, key: str) -> None:
        """Replace all rows of the keys in ``keys`` by ``rows``; only the buckets that hold such keys are written.

        The other keys of these buckets are copied. Running the same batch again gives the same table.
        """
        with self.change():
            batch = keys.select(key).distinct()
            hit = [r["b"] for r in batch.select(bucket_of(F.col(key), self.buckets).alias("b")).distinct().collect()]
            kept = self.read(name, schema, hit).join(batch, key, "left_anti")
            new = self._write(name, conform(rows, schema).unionByName(conform(kept, schema)), bucket_of(F.col(key), self.buckets))
            table = {b: v for b, v in self._pending["tables"].get(name, {}).items() if int(b) not in hit}
            self._pending["tables"][name] = table | {b: [v] for b, v in new.items()}
