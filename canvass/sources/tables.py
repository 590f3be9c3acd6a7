"""Keyed tables without a MERGE-capable format: folders of Parquet, and a log of numbered versions.

A write makes new folders beside the old ones and then commits a version that names them, so readers of the old
version are never disturbed and a failed write leaves nothing behind that is read. The log
goes through Hadoop's file systems, as the tables may be in any store that Spark knows; that store must be able to
create a file only where there is none.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass import schemas


#: Name of the copy of the partition column that names folders; the column itself stays in the files.
_FOLDER = "__folder"


class SchemaChange(ValueError):
    """A change of schema that isn't an allowed addition."""


def evolve(rows: DataFrame, wanted: T.StructType, allow_added: bool = True, allow_dropped: bool = False) -> DataFrame:
    """``rows`` with the columns of ``wanted``: new nullable ones as typed nulls, in its order.

    Changed types, new columns that can't be null, and (unless allowed) columns that are gone raise
    ``SchemaChange``; with ``allow_dropped`` those stay at the end.
    """
    now = {f.name: f for f in rows.schema}
    gone = [f for f in now if f not in wanted.names]
    if gone and not allow_dropped:
        raise SchemaChange(f"dropped columns: {', '.join(gone)}")
    out = []
    for f in wanted:
        if f.name in now:
            if now[f.name].dataType != f.dataType:
                raise SchemaChange(f"{f.name}: {now[f.name].dataType.simpleString()} is not {f.dataType.simpleString()}")
            out.append(F.col(f.name))
        elif not allow_added:
            raise SchemaChange(f"new column: {f.name}")
        elif not f.nullable:
            raise SchemaChange(f"new column must be nullable: {f.name}")
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return rows.select(*out, *gone)


def coerce(rows: DataFrame, wanted: T.StructType) -> DataFrame:
    """Exactly the columns of ``wanted``: cast (a value that doesn't fit becomes null), null if missing, others dropped."""
    have = set(rows.columns)
    return rows.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted
    ])


def merged(target: DataFrame, source: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Upsert: rows of ``source`` replace those of ``target`` with their keys; missing columns become null."""
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(source, allowMissingColumns=True)


def merge_counts(target: DataFrame, source: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row: ``inserted`` and ``updated`` (every matched row counts as updated)."""
    hit = source.select(*keys).join(target.select(*keys).distinct().withColumn("__hit", F.lit(1)), list(keys), "left")
    return hit.agg(F.count_if(F.col("__hit").isNull()).alias("inserted"), F.count_if(F.col("__hit").isNotNull()).alias("updated"))


def merged_keeping(target: DataFrame, source: DataFrame, keys: tuple[str, ...], keep_if: str, kept: tuple[str, ...]) -> DataFrame:
    """Upsert in which matched target rows with ``keep_if`` true keep their ``kept`` columns."""
    old = target.where(F.col(keep_if)).select(*keys, *[F.col(c).alias(f"__{c}") for c in kept], F.lit(True).alias("__held"))
    rows = source.join(old, list(keys), "left")
    for c in kept:
        rows = rows.withColumn(c, F.when(F.col("__held"), F.col(f"__{c}")).otherwise(F.col(c)))
    return merged(target, rows.select(*source.columns), keys)


def scope_replaced(target: DataFrame, rows: DataFrame, scope: Column) -> DataFrame:
    """Everything in ``scope`` goes, and ``rows`` come: also where there are none."""
    return target.where(~F.coalesce(scope, F.lit(False))).unionByName(rows, allowMissingColumns=True)


def scoped_delete(target: DataFrame, keys: DataFrame, scope: Column | None = None) -> DataFrame:
    """``target`` without the rows in ``scope`` (all, if none is given) that have one of ``keys`` (all of its columns)."""
    names = keys.columns
    marked = target.join(keys.distinct().withColumn("__gone", F.lit(True)), names, "left")
    inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    return marked.where(~(F.coalesce("__gone", F.lit(False)) & inside)).select(*target.columns)


def partial_update(rows: DataFrame, where: Column, values: dict[str, Column], allowed: tuple[str, ...], touch: str | None = None, now: Column | None = None) -> DataFrame:
    """Rows with the given columns set where true; a column that is not allowed raises an error, ``touch`` gets the time."""
    if bad := sorted(set(values) - set(allowed)):
        raise ValueError(f"not to be updated: {', '.join(bad)}")
    hit = F.coalesce(where, F.lit(False))
    if touch and values:
        values = values | {touch: F.current_timestamp() if now is None else now}
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def backfill(rows: DataFrame, column: str, value: object) -> DataFrame:
    """Nulls of a column become ``value``."""
    return rows.withColumn(column, F.coalesce(column, F.lit(value)))


def backfill_table(table: Table, column: str, value: object) -> dict[str, int]:
    """Backfill a column of a table and verify it: ``rows, before, after`` (nulls). Without nulls nothing is written."""
    count = lambda: table.read().select(F.count(F.lit(1)), F.count_if(F.col(column).isNull())).first()
    n, before = count()
    if before:
        table.overwrite(backfill(table.read(), column, value))
    rows, after = count()
    if after or rows != n:
        raise RuntimeError(f"{table.path}: {after} nulls and {rows} of {n} rows after the backfill")
    return {"rows": n, "before": before, "after": after}


class ConcurrentWrite(RuntimeError):
    """Another writer committed a version since this one read the table."""


class DamagedTable(RuntimeError):
    """There are files of a table but no version that was committed."""


class Table:
    """A keyed table at a path: ``read``, ``merge``, ``replace_scope``, ``delete``, ``overwrite``.

    ``_log`` holds a small file for each version, numbered and created exclusively: it names the folders that
    make up the version, and its schema. The highest whole one counts, so nothing is ever
    deleted or moved to commit, a write that fails leaves the version before it, and of two writers the second gets
    ``ConcurrentWrite``. With ``partition``, a column, each of its values has a folder, and writes replace only the
    folders that they touch.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], schema: T.StructType | None = None, partition: str | None = None):
        self.spark, self.path, self.keys, self.schema, self.partition = spark, path.rstrip("/"), tuple(keys), schema, partition
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def named(cls, spark: SparkSession, root: str, name: str, partition: str | None = None) -> Table:
        """One of the contract's tables under ``root``."""
        return cls(spark, f"{root}/{name}", schemas.KEYS[name], schemas.schema(name), partition)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        where = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _manifest(self, number: int) -> dict | None:
        """What a version says of itself; None if its file was never finished."""
        stream = self._fs.open(self._at(f"_log/{number:020d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def _head(self) -> tuple[int, dict | None]:
        """The highest number taken, and the highest whole version."""
        numbers = [int(x) for x in self._names("_log") if x.isdigit()]
        for n in reversed(numbers):
            if found := self._manifest(n):
                return numbers[-1], found | {"number": n}
        if any(x.startswith("v=") for x in self._names("")):
            raise DamagedTable(f"{self.path}: files but no committed version; vacuum(0) drops what failed writes have left")
        return (numbers[-1] if numbers else -1), None

    def _commit(self, after: int, folders: list[str], schema: T.StructType) -> None:
        content = json.dumps({"folders": folders, "schema": schema.jsonValue()}).encode()
        try:
            stream = self._fs.create(self._at(f"_log/{after + 1:020d}"), False)
        except Exception as e:
            if "exist" in str(e).lower():
                raise ConcurrentWrite(f"{self.path}: version {after + 1} is another writer's") from e
            raise
        stream.write(content)
        stream.close()

    def _write(self, rows: DataFrame) -> list[str]:
        """Write rows beside what is there; the folders that hold them."""
        version = f"v={uuid.uuid4().hex}"
        if self.partition is None:
            rows.write.parquet(f"{self.path}/{version}")
            return [version]
        rows.withColumn(_FOLDER, F.col(self.partition)).hint("rebalance", _FOLDER).write.partitionBy(_FOLDER).parquet(f"{self.path}/{version}")
        return [f"{version}/{x}" for x in self._names(version) if x.startswith(f"{_FOLDER}=")]

    def _folder(self, value: object) -> str:
        utils = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return f"{_FOLDER}=" + (utils.DEFAULT_PARTITION_NAME() if value in (None, "") else utils.escapePathName(str(value)))

    def _rows(self, folders: list[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}" for x in folders])

    def _read(self, found: dict | None) -> DataFrame:
        if found is None:
            if self.schema is None:
                raise FileNotFoundError(self.path)
            return self.spark.createDataFrame([], self.schema)
        return self._rows(found["folders"], T.StructType.fromJson(found["schema"]))

    def version(self) -> int | None:
        found = self._head()[1]
        return found["number"] if found else None

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is, or as a version that ``vacuum`` has left had it; one never written is empty."""
        if version is None:
            return self._read(self._head()[1])
        found = self._manifest(version)
        if not found:
            raise FileNotFoundError(f"{self.path}: version {version}")
        return self._read(found)

    def create(self) -> bool:
        """Make an empty table if there is none; true if it was made."""
        after, found = self._head()
        if found is None:
            self._commit(after, [], self.schema)
        return found is None

    def overwrite(self, rows: DataFrame) -> None:
        after, _ = self._head()
        self._commit(after, self._write(rows), rows.schema)

    def _split(self, found: dict, values: list | None) -> tuple[list[str], list[str]]:
        """The folders with the values of the partition column, and the others; without values, or partitions, all are the first."""
        if self.partition is None or values is None:
            return found["folders"], []
        names = {self._folder(v) for v in values}
        has = lambda folder: "/" not in folder or folder.split("/")[1] in names
        return [x for x in found["folders"] if has(x)], [x for x in found["folders"] if not has(x)]

    def _replace(self, after: int, rows: DataFrame, others: list[str]) -> None:
        self._commit(after, self._write(rows) + others, rows.schema)

    def _values(self, rows: DataFrame) -> list | None:
        """The values of the partition column in rows (as many as there are folders)."""
        return None if self.partition is None else [r[0] for r in rows.select(self.partition).distinct().collect()]

    def merge(self, source: DataFrame) -> dict[str, int]:
        """Upsert by key; the first write makes the table; an empty source changes nothing.

        A key must come once and no part of it may be null. With partitions, the folders of the source's values and
        those where one of its keys is now are written again, and of the others only the keys are read.
        """
        if source.isEmpty():
            return {"inserted": 0, "updated": 0}
        null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in self.keys])
        keys = source.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | null)
        if bad := keys.first():
            raise ValueError(f"{self.path}: a key " + ("occurs more than once in the source" if bad["n"] > 1 else "is null"))
        after, found = self._head()
        if found is None:
            rows = evolve(source, self.schema, allow_dropped=True) if self.schema else source
            self._commit(after, self._write(rows), rows.schema)
            return {"inserted": source.count(), "updated": 0}
        schema = T.StructType.fromJson(found["schema"])
        values = self._values(source)
        touched, others = self._split(found, values)
        if others:
            moved = self._rows(others, schema).select(*self.keys, F.col(self.partition).alias(_FOLDER)).join(source.select(*self.keys), list(self.keys), "left_semi")
            touched, others = self._split(found, values + [r[0] for r in moved.select(_FOLDER).distinct().collect()])
        target = self._rows(touched, schema)
        counts = merge_counts(target, source, self.keys).first().asDict()
        self._replace(after, merged(target, source, self.keys), others)
        return counts

    def merge_view(self, view: str) -> dict[str, int]:
        """``merge`` of a view or table that the session knows by name."""
        return self.merge(self.spark.table(view))

    def replace_scope(self, rows: DataFrame, scope: Column, partitions: list | None = None) -> int:
        """Replace all that is in ``scope`` by ``rows``; returns how many rows went.

        ``partitions`` names values of the partition column outside of which nothing is in scope; rows must have one of them.
        """
        after, found = self._head()
        if found is None:
            self.overwrite(scope_replaced(self._read(None), rows, scope))
            return 0
        touched, others = self._split(found, partitions)
        target = self._rows(touched, T.StructType.fromJson(found["schema"]))
        gone = target.where(scope).count()
        self._replace(after, scope_replaced(target, rows, scope), others)
        return gone

    def delete(self, predicate: Column, partitions: list | None = None) -> int:
        """Delete where true (within ``partitions``, if given); a missing table has nothing to delete."""
        after, found = self._head()
        if found is None:
            return 0
        touched, others = self._split(found, partitions)
        target = self._rows(touched, T.StructType.fromJson(found["schema"]))
        gone = target.where(predicate).count()
        if gone:
            self._replace(after, target.where(~F.coalesce(predicate, F.lit(False))), others)
        return gone

    def delete_keys(self, keys: DataFrame, scope: Column | None = None, partitions: list | None = None) -> int:
        """Delete the rows with the given keys (all columns of ``keys``) that are in ``scope``."""
        after, found = self._head()
        if found is None:
            return 0
        touched, others = self._split(found, partitions)
        target = self._rows(touched, T.StructType.fromJson(found["schema"]))
        kept = scoped_delete(target, keys, scope)
        gone = target.count() - kept.count()
        if gone:
            self._replace(after, kept, others)
        return gone

    def ensure_schema(self, wanted: T.StructType, allow_added: bool = True, allow_dropped: bool = False) -> bool:
        """Add new columns as nulls; true if the table changed. Nothing is rewritten: old files lack them."""
        after, found = self._head()
        rows = self._read(found)
        fresh = evolve(rows, wanted, allow_added, allow_dropped)
        if fresh.columns == rows.columns:
            return False
        self._commit(after, found["folders"] if found else [], fresh.schema)
        return True

    def history(self) -> DataFrame:
        """Versions, the folders of each, and which is current; a file that was never finished is not a version."""
        head = self.version() if self._names("_log") else None
        rows = [(int(n), len(m["folders"]), int(n) == head) for n in self._names("_log") if n.isdigit() and (m := self._manifest(int(n)))]
        return self.spark.createDataFrame(rows, "version long, folders int, current boolean")

    def metadata(self) -> DataFrame:
        """One row: ``path, format, columns, partition, version, first_version, versions, contiguous, num_files, size_in_bytes``."""
        head = self._head()[1]
        numbers = [int(x) for x in self._names("_log") if x.isdigit()]
        files = [s for x in (head["folders"] if head else []) for s in self._fs.listStatus(self._at(x)) if s.getPath().getName().endswith(".parquet")]
        row = (
            self.path, "parquet", json.dumps([f["name"] for f in head["schema"]["fields"]]) if head else None, self.partition, head and head["number"],
            numbers[0] if numbers else None, len(numbers), not numbers or numbers[-1] - numbers[0] + 1 == len(numbers), len(files), sum(s.getLen() for s in files),
        )
        return self.spark.createDataFrame([row], "path string, format string, columns string, partition string, version long, first_version long, versions long, contiguous boolean, num_files long, size_in_bytes long")

    def vacuum(self, keep: int = 1) -> int:
        """Drop the folders that none of the last ``keep`` versions has, and older versions; returns how many folders went.

        Not while somebody writes or reads an older version. With 0, a table without any committed version is emptied.
        """
        numbers = [int(x) for x in self._names("_log") if x.isdigit()]
        whole = [(n, m) for n in numbers if (m := self._manifest(n))]
        if not whole and keep:
            self._head()
        last = whole[-max(keep, 1):]
        held = {x for _, m in last for x in m["folders"]}
        gone = 0
        for top in [x for x in self._names("") if x.startswith("v=")]:
            if not any(x == top or x.startswith(f"{top}/") for x in held):
                gone += self._fs.delete(self._at(top), True)
            elif top not in held:
                for x in self._names(top):
                    if x.startswith(f"{_FOLDER}=") and f"{top}/{x}" not in held:
                        gone += self._fs.delete(self._at(f"{top}/{x}"), True)
        for n, _ in whole:
            if (n, _) not in last:
                self._fs.delete(self._at(f"_log/{n:020d}"), False)
        return gone


def tables_of(spark: SparkSession, root: str) -> DataFrame:
    """The contract's tables under a folder with their metadata, whether or not they have been written."""
    return reduce(DataFrame.union, [Table.named(spark, root, name).metadata().select(F.lit(name).alias("name"), "*") for name in schemas.KEYS])


def export(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Plain Parquet; a folder that isn't empty is refused unless it may be overwritten."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: str = "docket_id") -> None:
    """Overwrite only the partitions that ``rows`` have."""
    rows.write.mode("overwrite").partitionBy(by).option("partitionOverwriteMode", "dynamic").parquet(path)


def replace_in_export(rows: DataFrame, path: str, docket_id: str, by: str = "docket_id") -> dict[str, int]:
    """A docket's rows in a shared export, in place of all it had there: ``deleted`` and ``inserted``.

    Without rows the docket's old ones go as well. Rows of another docket raise an error.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(docket_id)}")
    if not rows.where(~F.col(by).eqNullSafe(F.lit(docket_id))).isEmpty():
        raise ValueError(f"rows of another {by} than {docket_id}")
    deleted, inserted = spark.read.parquet(folder.toString()).count() if fs.exists(folder) else 0, rows.count()
    if inserted:
        replace_partitions(rows, path, by)
    elif deleted:
        fs.delete(folder, True)
    return {"deleted": deleted, "inserted": inserted}


def table_as(rows: DataFrame, name: str) -> DataFrame:
    """CREATE OR REPLACE TABLE name AS: a table of the catalog with just these rows, which may come from the table itself."""
    fresh = f"{name}__{uuid.uuid4().hex[:8]}"
    spark = rows.sparkSession
    rows.write.saveAsTable(fresh)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    return spark.table(name)


def view_over(spark: SparkSession, path: str, name: str, strict: bool = True) -> bool:
    """A view ``name`` over the Parquet at ``path``; where there is none, an error, or with ``strict`` off no view and false."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        if strict:
            raise FileNotFoundError(path)
        return False
    spark.read.parquet(path).createOrReplaceTempView(name)
    return True
