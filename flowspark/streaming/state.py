"""State of a stream's body between micro-batches, safe against a crash at any point."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Version:
    """What one call of the body left: the micro-batch's number, the call's place among all, and its record."""

    no: int
    seq: int
    record: dict
    emitted: bool

    @property
    def name(self) -> str:
        return f"v-{self.no}-{self.seq}"


class StateLog:
    """Tables under one folder, a version for each call.

    A version counts once its mark is there, which is a rename; until then the
    one before it holds.  A micro-batch that Spark runs again starts from the
    newest version of an earlier one.  What a version emits is a table of it,
    so an emission that a crash cut off is made again, under the same version.
    The versions of the last two micro-batches are kept.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[Version]:
        path, fs = self._fs()
        if not fs.exists(path):
            return []
        names = {f.getPath().getName() for f in fs.listStatus(path)}
        out = []
        for n in names:
            if n.startswith("v-") and n.endswith(".mark"):
                no, seq = n[2:-5].rsplit("-", 1)
                out.append(Version(int(no), int(seq), json.loads(self._text(n)), n[:-5] + ".done" in names))
        return sorted(out, key=lambda v: (v.no, v.seq))

    def latest(self, before: int | None = None) -> Version | None:
        """The newest version, or the newest of a micro-batch before ``before``."""
        return next((v for v in reversed(self.versions()) if before is None or v.no < before), None)

    def read(self, version: Version, table: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{version.name}/{table}")

    def keep(self, no: int, tables: dict[str, DataFrame], record: dict) -> Version:
        """A new version; afterwards it holds, whatever happens."""
        seq = 1 + max((v.seq for v in self.versions()), default=-1)
        made = Version(no, seq, record, False)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{made.name}/{name}")
        self._mark(made.name + ".mark", json.dumps(record))
        return made

    def done(self, version: Version) -> None:
        """Its emission went through.  Versions that no run can start from any more go."""
        self._mark(version.name + ".done", "")
        every = self.versions()
        held = sorted({v.no for v in every if v.no <= version.no})[-2:]
        for v in every:
            if v.no < held[0] or (v.no in held and v.no <= version.no and any(w.no == v.no and w.seq > v.seq for w in every if w.seq <= version.seq)):
                for name in (v.name + ".mark", v.name + ".done", v.name):
                    path, fs = self._fs(name)
                    fs.delete(path, True)

    def _mark(self, name: str, text: str) -> None:
        path, fs = self._fs(name + ".part")
        out = fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(path, self._fs(name)[0])

    def _text(self, name: str) -> str:
        path, fs = self._fs(name)
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
