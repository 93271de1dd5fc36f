"""Idempotent appends: a table in batches, and a ledger of the batches that are done.

    <path>/data/batch=<id>/…      the rows of a batch
    <path>/ledger/<id>.json       its manifest: rows, digest, rows by partition

A batch is written under its own folder, replacing what an earlier try left there, and then recorded by one file that is renamed into
place, which only one writer can do. Readers see the batches that are recorded, so a job that dies anywhere leaves nothing to see, and
running it again gives one copy of each row. A batch that is recorded isn't written again; `verify` compares what is there with the
manifests."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .io import table_hash

_ID = re.compile(r"[A-Za-z0-9_.-]+")


class Ledger:
    def __init__(self, spark: SparkSession, path: str, parts: list[str] | None = None):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts or []
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, *names: str):
        p = self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return p.getFileSystem(self._conf), p

    def batches(self) -> list[str]:
        """The recorded batches' ids."""
        fs, p = self._at("ledger")
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName()[:-5] for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def manifest(self, batch: str) -> dict:
        fs, p = self._at("ledger", f"{batch}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _folder(self, batch: str) -> str:
        return f"{self.path}/data/batch={batch}"

    def _state(self, batch: str, schema: StructType) -> dict:
        rows = self.spark.read.schema(schema).parquet(self._folder(batch))
        total = table_hash(rows).first()
        counts = {json.dumps([str(r[c]) for c in self.parts]): r["n"] for r in rows.groupBy(*self.parts).agg(F.count("*").alias("n")).collect()} if self.parts else {}
        return {"rows": total["n"], "digest": total["digest"], "partitions": dict(sorted(counts.items())), "schema": schema.json()}

    def append(self, df: DataFrame, batch: str) -> bool:
        """Writes and records the batch; False if it is recorded already. Of two writers of one batch one records it; the other gets
        False, and both have written the same folder, so a batch's id has to stand for the same rows each time."""
        if not _ID.fullmatch(batch):
            raise ValueError("a batch's id has letters, digits, _, . and - only")
        if batch in self.batches():
            return False
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(*self.parts) if self.parts else w).parquet(self._folder(batch))
        return self._record(batch, self._state(batch, df.schema))

    def _record(self, batch: str, state: dict) -> bool:
        fs, final = self._at("ledger", f"{batch}.json")
        fs.mkdirs(final.getParent())
        _, draft = self._at("ledger", f".{batch}-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            return False
        return True

    def read(self) -> DataFrame:
        """All rows of the recorded batches, with their `batch`. Columns that a batch lacks are null."""
        out = None
        groups: dict[str, list[str]] = {}
        for b in self.batches():
            groups.setdefault(self.manifest(b)["schema"], []).append(b)
        for schema, names in groups.items():  # a branch a schema, not a batch
            full = StructType.fromJson(json.loads(schema)).add("batch", "string")
            rows = self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*[self._folder(b) for b in names])
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            raise ValueError("no batch is recorded")
        return out

    def todo(self, df: DataFrame, key: list[str]) -> DataFrame:
        """The rows of `df` whose keys no recorded batch has."""
        return df if not self.batches() else df.join(self.read().select(*key).distinct(), key, "left_anti")

    def verify(self) -> dict[str, list[str]]:
        """Of each recorded batch what differs from its manifest; a batch that is as recorded isn't listed."""
        out = {}
        for b in self.batches():
            held = self.manifest(b)
            now = self._state(b, StructType.fromJson(json.loads(held["schema"])))
            wrong = [k for k in ("rows", "digest", "partitions") if held[k] != now[k]]
            if wrong:
                out[b] = wrong
        return out
