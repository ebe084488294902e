"""Versioned tables of snapshots: rows by key with a digest of their payload, published by a manifest that appears at once.

A table is a folder: ``data/`` has the Parquet files of each version, ``versions/`` a manifest a version, a small JSON document
that names the version's data, its numbers and the batches that it has taken.  A writer prepares all data first and then makes
the next manifest by a rename that fails where there is one already.  A writer that dies before leaves files that nobody reads;
of two writers one loses and starts again on what the other has published.

A batch is applied once, by its name.  Rows with the same key and digest as before are left as they are, so a batch whose
rows are all known changes nothing, whatever its name.  All goes through Spark's file system classes, so the folder can be in
any store that Spark reads and that renames at once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches that a manifest remembers; a batch that comes again after so many others is known by its rows alone.
REMEMBERED = 1000


class Conflict(Exception):
    """Another writer has published a version in the meantime."""


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()), at


def put(spark: SparkSession, path: str, text: str, replace: bool) -> None:
    """Write a small document so that readers see all of it or none; without ``replace`` an existing one is a Conflict."""
    context, at = _files(spark, path)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    part = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    try:
        out.write(bytearray(text.encode()))
        if hasattr(out, "hsync"):
            out.hsync()
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else getattr(rename, "NONE")
    try:
        context.rename(part, at, how)
    except Exception as e:
        fs.delete(part, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(path) from None
        raise


def get(spark: SparkSession, path: str) -> str | None:
    """A small document, None where there is none."""
    _, at = _files(spark, path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


class Snapshots:
    """A versioned table in a folder; ``key`` are the columns that name a row."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str]) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)

    def manifest(self, version: int | None = None) -> dict:
        """That of a version, or the latest one."""
        if version is None:
            version = self.latest()
        text = get(self.spark, f"{self.path}/versions/{version:012d}.json") if version else None
        return json.loads(text) if text else {"version": 0, "data": None, "rows": 0, "batches": []}

    def latest(self) -> int:
        _, at = _files(self.spark, f"{self.path}/versions")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return 0
        return max([int(f.getPath().getName()[:12]) for f in fs.listStatus(at) if f.getPath().getName()[:1] != "."], default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None before the first one."""
        m = self.manifest(version)
        return self.spark.read.schema(m["schema"]).parquet(f"{self.path}/data/{m['data']}") if m["data"] else None

    def upsert(self, rows: DataFrame, order: Sequence[Column], batch: str, deleted: Column | None = None) -> dict:
        """Apply a batch of rows: of a key's rows the last in ``order`` counts; rows that are ``deleted`` go.  Gives the manifest
        that holds the batch."""
        while True:
            before = self.manifest()
            if batch in before["batches"]:
                return before
            try:
                return self._publish(before, self._applied(before, rows, order, deleted), batch)
            except Conflict:
                continue

    def _applied(self, before: dict, rows: DataFrame, order: Sequence[Column], deleted: Column | None) -> DataFrame:
        payload = [c for c in sorted(rows.columns) if c not in self.key]
        gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
        every = F.struct(*[F.col(c) for c in rows.columns], gone.alias("_gone"))
        last = rows.groupBy(*self.key).agg(F.max_by(every, F.struct(*order)).alias("_r")).select("_r.*")
        digest = F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256) if payload else F.lit("")
        last = last.withColumn("digest", digest)
        now = self.read(before["version"])
        if now is None:
            return last.where("NOT _gone").drop("_gone").withColumn("version", F.lit(1).cast("long"))
        known = now.select(*self.key, F.col("digest").alias("_old"))
        same = [last[c].eqNullSafe(known[c]) for c in self.key]
        fresh = last.join(known, same, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("digest")) | F.col("_gone")).select(*[last[c] for c in last.columns])
        touched = fresh.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(self.key)])
        kept = now.join(touched, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(self.key)], "left_anti")
        return kept.unionByName(fresh.where("NOT _gone").drop("_gone").withColumn("version", F.lit(before["version"] + 1).cast("long")))

    def _publish(self, before: dict, rows: DataFrame, batch: str) -> dict:
        name, version = uuid.uuid4().hex, before["version"] + 1
        rows.write.parquet(f"{self.path}/data/{name}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{name}")
        count, changed = written.agg(F.count(F.lit(1)), F.count_if(F.col("version") == version)).first()
        batches = [*before["batches"], batch][-REMEMBERED:]
        m = {"version": version, "data": name, "rows": count, "changed": changed, "batches": batches, "schema": _ddl(rows)}
        put(self.spark, f"{self.path}/versions/{version:012d}.json", json.dumps(m), replace=False)
        return m

    def sink(self, order: Sequence[Column], stream: str, deleted: Column | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a batch of a stream is applied once, however often it is tried."""
        return lambda rows, batch: self.upsert(rows, order, f"{stream}:{batch}", deleted) and None


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
