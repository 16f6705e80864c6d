"""Stored tables: partitioned tables that lose rows in place, and the audit log as a committed, append-only table.

Folders are named by URI; whatever Spark reads and writes. Small bookkeeping (listing commits, removing the folders of
partitions that became empty) goes through Hadoop's file system API, as Spark's own writers do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.provenance import append_chain
from .tables import written


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


# ---- A12, A13: rows that leave a partitioned table


def bucket(column: str = "doc_id", buckets: int = 64) -> Column:
    """A partition number by key, for tables that lose rows by that key."""
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def store(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def remove_rows(spark: SparkSession, path: str, by: str, gone: Column | None = None, ids: DataFrame | None = None) -> int:
    """Take rows out of the table at ``path``, partitioned by ``by``: those for which ``gone`` holds, or with the
    key columns of ``ids``. Only partitions that hold such rows are read whole and written again; the others
    keep their files. Returns the number of partitions touched.

    What stays is written aside first, so the table is never read and written in one job; partitions are swapped by
    Spark's dynamic overwrite, and those left without rows are removed last. A job that fails half-way leaves
    each partition as it was or without the rows; run again, it ends the work."""
    table = spark.read.parquet(path)
    doomed = table.where(gone) if ids is None else table.join(ids, ids.columns, "left_semi")
    touched = written(doomed.select(by).distinct())
    kept = table.join(touched, by, "left_semi")
    kept = kept.where(~F.coalesce(gone, F.lit(False))) if ids is None else kept.join(ids, ids.columns, "left_anti")
    kept = written(kept)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for row in touched.join(kept.select(by).distinct(), by, "left_anti").collect():  # at most the number of partitions
        own, fs = _path(spark, f"{path}/{by}={row[0]}")
        fs.delete(own, True)
    return touched.count()


def retain(spark: SparkSession, path: str, by: str, now: Column, days: int, column: str = "created_at") -> int:
    """A12 on a stored table: rows older than the window go. Rows without a time stay."""
    return remove_rows(spark, path, by, F.col(column) < now - F.make_interval(days=F.lit(days)))


# ---- I4 on a stored chain


#: An event's columns in the log.
COLUMNS = {"chain_id": "long", "event_id": "long", "created_at": "timestamp"} | dict.fromkeys(("action", "actor", "actor_role", "doc_id", "run_id", "summary", "detail"), "string")


class StaleHead(RuntimeError):
    """Another writer appended since the heads were read."""


class AuditLog:
    """Audit chains in a folder: events (the columns ``COLUMNS``, null where an append has none) and heads of each append
    in folders of their own, named by a commit.

    A commit is a file ``commits/<number>`` that is created only if it is not there: of two writers that start
    from the same commit one gets it, and the other is refused and leaves nothing that is read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commits(self) -> list[str]:
        """Names of the committed appends, in order."""
        own, fs = _path(self.spark, f"{self.path}/commits")
        if not fs.exists(own):
            return []
        found = sorted(int(s.getPath().getName()) for s in fs.listStatus(own))
        return [self._read(f"{self.path}/commits/{n}") for n in found]

    def _read(self, path: str) -> str:
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])["append"]

    def _table(self, kind: str, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{kind}/{n}" for n in names])

    def events(self) -> DataFrame | None:
        names = self.commits()
        return self._table("events", names) if names else None

    def heads(self, names: list[str] | None = None) -> DataFrame | None:
        """``chain_id, seq, entry_hash``: the last entry of each chain, from the heads that each append left."""
        names = self.commits() if names is None else names
        if not names:
            return None
        last = self._table("heads", names).groupBy("chain_id").agg(F.max_by(F.struct("seq", "entry_hash"), "seq").alias("h"))
        return last.select("chain_id", "h.seq", "h.entry_hash")

    def append(self, events: DataFrame, at: int | None = None, order: list[str] | None = None) -> int:
        """Append events after the heads as of commit number ``at`` (default: now); returns the new number.
        Raises ``StaleHead`` if another append has taken it."""
        names = self.commits()
        at = len(names) if at is None else at
        name = uuid.uuid4().hex
        have = {f.name.lower() for f in events.schema}
        events = events.select(*((F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()))
        chain = append_chain(events, self.heads(names[:at]), order)
        chain.write.parquet(f"{self.path}/events/{name}")
        stored = self._table("events", [name])
        stored.groupBy("chain_id").agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash")).write.parquet(f"{self.path}/heads/{name}")
        own, fs = _path(self.spark, f"{self.path}/commits/{at + 1}")
        try:
            out = fs.create(own, False)
        except Exception as error:
            for kind in ("events", "heads"):
                left, files = _path(self.spark, f"{self.path}/{kind}/{name}")
                files.delete(left, True)
            raise StaleHead(f"commit {at + 1} is taken") from error
        out.write(bytearray(json.dumps({"append": name}).encode()))
        out.close()
        return at + 1


def delete_stored(spark: SparkSession, folder: str, names: list[str], ids: DataFrame, now: Column, log: AuditLog, chain_id: int = 0) -> dict[str, int]:
    """A13 on stored tables: ``documents`` and the tables in ``names`` (all partitioned by ``part``, a bucket of ``doc_id``)
    lose the rows of ``ids`` (``doc_id``), after one ``document.deleted`` event for each, with its hashes and its number of
    runs, went into the audit log. Returns the partitions touched in each table."""
    docs, runs = (spark.read.parquet(f"{folder}/{n}") for n in ("documents", "runs"))
    counts = runs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    lost = docs.join(ids, "doc_id", "left_semi").join(counts, "doc_id", "left")
    detail = F.to_json(F.struct("file_hash", F.coalesce("n", F.lit(0)).alias("runs"), "text_hash"))
    events = lost.select(F.lit(chain_id).cast("long").alias("chain_id"), F.col("doc_id").alias("event_id"), F.lit("document.deleted").alias("action"), F.col("doc_id").cast("string").alias("doc_id"), detail.alias("detail"), now.alias("created_at"))
    log.append(written(events))
    return {n: remove_rows(spark, f"{folder}/{n}", "part", ids=ids) for n in ["documents", *names]}
