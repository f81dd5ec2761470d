"""Tables as dated versions behind one log of commits.

Every write goes to a new folder. What makes versions current is a commit: one numbered file that names
every table and part of a build, created whole or not at all. Of two writers that want the same number one
gets it, the other takes the next; so a reader sees all tables of a build or none, nothing is overwritten in
place, and a rewrite of one source leaves the folders of all other sources alone.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from listloom.windows import first_per_key

MANIFEST = ("name string, part string, version long, path string, n_rows long, n_bytes long, n_files long, "
            "built_at string, fields array<struct<name:string,type:string>>, commit long")
METADATA = "commit long, key string, value string"
#: Number types from narrow to wide; a value of one fits any later one of its row.
_WIDER = (("tinyint", "smallint", "int", "bigint"), ("tinyint", "smallint", "int", "double"), ("float", "double"), ("date", "timestamp_ntz"))


class Conflict(Exception):
    """Another build has changed a part since it was read."""


class Narrowing(ValueError):
    """A column would lose values that the table holds."""


@dataclass(frozen=True)
class Staged:
    """A written folder that no commit names yet. ``version`` None takes the next one of its part."""

    name: str
    part: str
    path: str
    n_rows: int
    n_bytes: int
    n_files: int
    fields: tuple[tuple[str, str], ...]
    version: int | None = None
    measured: Mapping[str, Any] = field(default_factory=dict)


def _log(root: str) -> str:
    return f"{root.rstrip('/')}/log"


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, files = _hadoop(spark, path)
    return files.exists(target)


def make_folder(spark: SparkSession, path: str) -> None:
    target, files = _hadoop(spark, path)
    files.mkdirs(target)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content; False, and nothing done, where it exists."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    target, files = _hadoop(spark, path)
    own = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    files.mkdirs(target.getParent())
    out = files.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if files.getScheme() == "file":
            os.link(own.toUri().getPath(), target.toUri().getPath())  # a rename on local disks replaces what is there
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(own, target, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except FileExistsError:
        return False
    except Py4JJavaError:
        if files.exists(target) and files.exists(own):
            return False
        raise
    finally:
        files.delete(own, False)
    return True


def last_commit(spark: SparkSession, root: str) -> int:
    """The number of the newest commit; -1 before the first."""
    target, files = _hadoop(spark, _log(root))
    if not files.exists(target):
        return -1
    names = [f.getPath().getName() for f in files.listStatus(target)]
    return max((int(n.removesuffix(".json")) for n in names if n[0] not in "._"), default=-1)


def _entries(spark: SparkSession, root: str, schema: str) -> DataFrame:
    path = _log(root)
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """A row for each version of each part that a commit has made current."""
    return _entries(spark, root, MANIFEST).where("name is not null")


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """(commit, key, value): what builds have noted, and what was measured while they were written (``table.measure``)."""
    return _entries(spark, root, METADATA).where("key is not null")


def builds(spark: SparkSession, root: str) -> DataFrame:
    """commit, built_at, n_tables, n_parts, n_rows, n_bytes, n_files of every build."""
    return manifest(spark, root).groupBy("commit").agg(
        F.max("built_at").alias("built_at"), F.count_distinct("name").alias("n_tables"), F.count("*").alias("n_parts"),
        *(F.sum(c).alias(c) for c in ("n_rows", "n_bytes", "n_files")))


def _fields(schema: T.StructType) -> tuple[tuple[str, str], ...]:
    return tuple((f.name, f.dataType.simpleString()) for f in schema)


def stage(df: DataFrame, root: str, name: str, part: str = "", version: int | None = None, partition_by: Sequence[str] = (),
          fmt: str = "parquet", measures: Mapping[str, Column] | None = None) -> Staged:
    """Write a folder for a coming commit. Rows, and ``measures`` (aggregates by name), are counted on the way."""
    path = f"{root.rstrip('/')}/{name}/part={part or 'all'}/{uuid.uuid4().hex}"
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *(m.alias(f"m_{k}") for k, m in (measures or {}).items()))
    writer = counted.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).format(fmt).save(path)
    target, files = _hadoop(df.sparkSession, path)
    held = files.getContentSummary(target)
    found = dict(seen.get)
    return Staged(name, part, path, found.pop("n_rows"), held.getLength(), held.getFileCount() - 1, _fields(df.schema), version,
                  {k[2:]: v for k, v in found.items()})  # Spark's own mark of success is a file too


def stage_parts(df: DataFrame, root: str, name: str, part_column: str, version: int | None = None) -> list[Staged]:
    """Write a folder for every part (source) that the table holds, in one job; counts come from file footers."""
    path = f"{root.rstrip('/')}/{name}/{uuid.uuid4().hex}"
    # evens out the files: a large part is split over many tasks, small ones share a task
    df.withColumn("part", F.col(part_column)).hint("rebalance", "part").write.mode("errorifexists").partitionBy("part").parquet(path)
    # the folder is read off a file of the part, so odd names keep their escapes
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*/part=[^/]*)/[^/]*$", 1)
    written = df.sparkSession.read.schema(df.schema).parquet(path).select(
        F.col(part_column).alias("part"), folder.alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    files = written.groupBy("part", "path", "file").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    parts = files.groupBy("part", "path").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("files"))
    # a row for each part of the table, of which there are as many as sources
    return [Staged(name, r["part"], r["path"], r["n"], r["size"], r["files"], _fields(df.schema), version) for r in parts.orderBy("part").collect()]


def wider(one: str, other: str) -> str | None:
    """The type that holds the values of both; None if there is none."""
    if one == other or other == "void":
        return one
    if one == "void":
        return other
    for row in _WIDER:
        if one in row and other in row:
            return row[max(row.index(one), row.index(other))]
    if one.startswith("decimal(") and other.startswith("decimal("):
        (p, s), (q, r) = (map(int, x[8:-1].split(",")) for x in (one, other))
        scale = max(s, r)
        size = max(p - s, q - r) + scale
        return f"decimal({size},{scale})" if size <= 38 else None
    return None


def _merged(tables: Sequence[Sequence[tuple[str, str]]], of: str) -> dict[str, str]:
    """Columns in order of first sight with the widest of their types."""
    out: dict[str, str] = {}
    for fields in tables:
        for name, kind in fields:
            both = wider(out[name], kind) if name in out else kind
            if both is None:
                raise Narrowing(f"{of}.{name} is {out[name]}, which {kind} does not fit")
            out[name] = both
    return out


def commit(spark: SparkSession, root: str, staged: Sequence[Staged], built_at: str = "", notes: Mapping[str, str] | None = None,
           base: int | None = None) -> list[Staged]:
    """Make all of ``staged`` current at once; returns what was committed, with versions.

    ``base`` is the commit that the caller's data were read at: if a later one holds a part that is about to be
    written, ``Conflict`` is raised. A version number that a part has reached already is left out, so replays
    change nothing. A new column is welcome, a wider type too; a narrower one is refused (``Narrowing``).
    """
    names = sorted({s.name for s in staged})
    while True:
        number = last_commit(spark, root) + 1
        # a row for each part of the tables written
        held = current_rows(manifest(spark, root).where(F.col("name").isin(names) & (F.col("commit") < number))).collect()
        now = {(r["name"], r["part"]): r for r in held}
        for s in staged:
            row = now.get((s.name, s.part))
            if base is not None and row is not None and row["commit"] > base:
                raise Conflict(f"{s.name} {s.part} was written by commit {row['commit']}, after {base}")
        for name in names:
            kept = _merged([r["fields"] for r in held if r["name"] == name], name)
            for s in (s for s in staged if s.name == name):
                for column, kind in s.fields:
                    if column in kept and wider(kept[column], kind) != kind:
                        raise Narrowing(f"{name}.{column} is {kept[column]} and cannot become {kind}")
        done = []
        for s in staged:
            row = now.get((s.name, s.part))
            latest = -1 if row is None else row["version"]
            if s.version is None or s.version > latest:
                done.append(replace(s, version=latest + 1 if s.version is None else s.version))
        if not done and not notes:
            return []
        lines: list[dict] = [{"commit": number, "name": s.name, "part": s.part, "version": s.version, "path": s.path, "n_rows": s.n_rows, "n_bytes": s.n_bytes, "n_files": s.n_files,
                              "built_at": built_at, "fields": [{"name": n, "type": t} for n, t in s.fields]} for s in done]
        pairs = dict(notes or {}) | {f"{s.name}.{k}": v for s in done for k, v in s.measured.items()}
        lines += [{"commit": number, "key": k, "value": None if v is None else str(v)} for k, v in pairs.items()]
        if put_if_absent(spark, f"{_log(root)}/{number:020d}.json", "".join(json.dumps(line) + "\n" for line in lines)):
            return done


def publish(df: DataFrame, root: str, name: str, part: str = "", built_at: str = "", version: int | None = None,
            partition_by: Sequence[str] = (), fmt: str = "parquet") -> int:
    """Write one version of a table part and make it current; returns its version number.

    Publishing a version number that is already current does nothing, which makes replays harmless.
    """
    spark = df.sparkSession
    if version is not None:
        latest = manifest(spark, root).where((F.col("name") == name) & (F.col("part") == part)).agg(F.max("version")).first()[0]
        if latest is not None and latest >= version:
            return latest
    done = commit(spark, root, [stage(df, root, name, part, version, partition_by, fmt)], built_at)
    return done[0].version if done else version


def publish_together(tables: Mapping[str, DataFrame], root: str, built_at: str = "", notes: Mapping[str, str] | None = None, base: int | None = None,
                     measures: Mapping[str, Mapping[str, Column]] | None = None, version: int | None = None, fmt: str = "parquet") -> list[Staged]:
    """Several tables in one commit: readers see all of them or none. ``measures`` holds aggregates by table and name."""
    spark = next(iter(tables.values())).sparkSession
    staged = [stage(df, root, name, version=version, fmt=fmt, measures=(measures or {}).get(name)) for name, df in tables.items()]
    return commit(spark, root, staged, built_at, notes, base)


def publish_parts(df: DataFrame, root: str, name: str, part_column: str, built_at: str = "",
                  version: int | None = None, base: int | None = None) -> list[Staged]:
    """Write a new version of every part (source) the table holds, in one job and one commit; returns what was committed.

    Parts that already have this version or a later one are left out, so replays change nothing.
    """
    spark = df.sparkSession
    latest = manifest(spark, root).where(F.col("name") == name).groupBy(F.col("part").alias("_p")).agg(F.max("version").alias("_v"))
    if version is None:
        top = latest.agg(F.max("_v")).first()[0]
        version = (top if top is not None else -1) + 1
    todo = df.join(latest.where(F.col("_v") >= version), F.col(part_column) == F.col("_p"), "left_anti")
    return commit(spark, root, stage_parts(todo, root, name, part_column, version), built_at, base=base)


def current_rows(entries: DataFrame) -> DataFrame:
    """Of each part of each table the entry of its highest version."""
    return first_per_key(entries, ["name", "part"], [F.col("version").desc()])


def current_entries(spark: SparkSession, root: str, name: str) -> DataFrame:
    return current_rows(manifest(spark, root).where(F.col("name") == name))


def read_current(spark: SparkSession, root: str, name: str, parts: Sequence[str] | None = None, schema=None, fmt: str = "parquet",
                 defaults: Mapping[str, Any] | None = None, at: int | None = None) -> DataFrame | None:
    """A table, or some of its parts, as of commit ``at`` or now; None when nothing was published.

    Parts of different versions are read by their own columns: types widen to the widest of all, a column
    that a part does not have gives the value in ``defaults``, else null. With ``schema`` all files are read by that
    instead. The number of log entries read here is the number of parts (sources), never of data rows.
    """
    entries = manifest(spark, root).where(F.col("name") == name)
    if at is not None:
        entries = entries.where(F.col("commit") <= at)
    entries = current_rows(entries)
    if parts is not None:
        entries = entries.where(F.col("part").isin(list(parts)))
    found = entries.select("path", "fields", "commit").orderBy("commit", "path").collect()
    if not found:
        return None
    if schema is not None:
        return spark.read.schema(schema).format(fmt).load([r["path"] for r in found])
    shapes: dict[tuple, list[str]] = {}
    for r in found:
        shapes.setdefault(tuple(map(tuple, r["fields"])), []).append(r["path"])
    columns = _merged(list(shapes), name)
    out = None
    for fields, paths in shapes.items():
        own = dict(fields)
        read = spark.read.schema(", ".join(f"`{n}` {t}" for n, t in fields)).format(fmt).load(paths)
        some = read.select(*((F.col(f"`{n}`") if n in own else F.lit((defaults or {}).get(n))).cast(t).alias(n) for n, t in columns.items()))
        out = some if out is None else out.union(some)
    return out


def schema_history(spark: SparkSession, root: str, name: str) -> DataFrame:
    """commit, part, version, position, column, type: the columns that every version of a table was written with."""
    rows = manifest(spark, root).where(F.col("name") == name)
    return rows.select("commit", "part", "version", F.posexplode("fields").alias("position", "f")).select(
        "commit", "part", "version", "position", F.col("f.name").alias("column"), F.col("f.type").alias("type"))


def expired_versions(entries: DataFrame, keep: int = 30) -> DataFrame:
    """Manifest rows beyond the newest ``keep`` versions of each part of each table: what retention may delete.

    The current version of a part, its highest, is never among them, whatever ``keep`` is.
    """
    newest = Window.partitionBy("name", "part").orderBy(F.col("version").desc())
    return entries.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") > max(1, keep)).drop("_rank")
