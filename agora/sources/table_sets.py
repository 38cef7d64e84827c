"""Several tables written as one set.

A set is committed by its manifest, a small file that names where every table
of the set lies and is renamed into place last.  Readers follow the newest
manifest, so a write that breaks off leaves the set before it readable and
whole, and a reader never sees tables of different sets.  Data files of a set
are never touched again; ``drop_old_sets`` removes what no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from agora.sources.sinks import read_tsv, write_tsv

FORMATS = ("parquet", "tsv")


class Folder:
    """A folder of whatever file system holds it, through the session."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.system = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, name: str) -> list[str]:
        place = self.at(name)
        return sorted(s.getPath().getName() for s in self.system.listStatus(place)) if self.system.exists(place) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> bool:
        """Whole or not at all; False if the name is taken."""
        temporary = self.at(f".{uuid.uuid4().hex}")
        stream = self.system.create(temporary, False)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        self.system.mkdirs(self.at(name).getParent())
        if not self.system.exists(self.at(name)) and self.system.rename(temporary, self.at(name)):
            return True
        self.system.delete(temporary, False)
        return False

    def delete(self, name: str) -> None:
        self.system.delete(self.at(name), True)


def _number(manifest: str) -> int:
    return int(manifest.split(".")[0])


def write_table_set(tables: dict[str, DataFrame], root: str, formats: dict[str, str] | None = None) -> int:
    """Write all tables, then commit them together; returns the number of the
    set.  ``formats`` names those not written as parquet."""
    if not tables:
        raise ValueError("a set needs a table")
    spark = next(iter(tables.values())).sparkSession
    folder, batch = Folder(spark, root), uuid.uuid4().hex
    entries = {}
    for name, df in tables.items():
        kind = (formats or {}).get(name, "parquet")
        if kind not in FORMATS:
            raise ValueError(kind)
        place = f"data/{batch}/{name}"
        if kind == "tsv":
            write_tsv(df, f"{folder.path}/{place}")
        else:
            df.write.parquet(f"{folder.path}/{place}")
        entries[name] = {"path": place, "format": kind, "schema": json.loads(df.schema.json()), "ddl": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)}
    while True:  # another writer may have taken the number
        number = max(map(_number, folder.names("manifests")), default=0) + 1
        if folder.write_once(f"manifests/{number:012d}.json", json.dumps(entries)):
            return number


def table_sets(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the sets, oldest first."""
    return sorted(map(_number, Folder(spark, root).names("manifests")))


def read_table_set(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of a set, the newest by default."""
    from pyspark.sql.types import StructType

    folder, known = Folder(spark, root), table_sets(spark, root)
    if not known or (number is not None and number not in known):
        raise FileNotFoundError(f"no such table set in {root}")
    entries = json.loads(folder.read(f"manifests/{number or known[-1]:012d}.json"))
    out = {}
    for name, e in entries.items():
        path = f"{folder.path}/{e['path']}"
        out[name] = read_tsv(spark, path, e["ddl"]) if e["format"] == "tsv" else spark.read.schema(StructType.fromJson(e["schema"])).parquet(path)
    return out


def drop_old_sets(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Keep the newest sets; data that no kept manifest names goes."""
    folder = Folder(spark, root)
    for number in table_sets(spark, root)[:-keep]:
        folder.delete(f"manifests/{number:012d}.json")
    named = {e["path"].split("/")[1] for m in folder.names("manifests") for e in json.loads(folder.read(f"manifests/{m}")).values()}
    for batch in folder.names("data"):
        if batch not in named:
            folder.delete(f"data/{batch}")


def write_gated(tables: dict[str, DataFrame], root: str, hopkins: float, least: float = 0.5) -> int | None:
    """S16 behind the gate (C13): written only if the features tend to
    cluster, else nothing is touched and None returned."""
    return write_table_set(tables, root) if hopkins > least else None
