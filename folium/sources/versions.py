"""Tables in versions: a commit writes new ones beside the old and then moves one pointer.

A folder holds ``versions/<number>/<table>`` as Parquet, a file ``CURRENT``
that names the tables of the present version with their fingerprints, and
during a commit a file ``JOURNAL``. ``CURRENT`` is replaced by a rename, which
the file system does as one step, so readers see the old version or the new
one and a writer that stops between any two steps leaves one of them; the next
writer clears up after it. Every version keeps the id of the plan that made it,
so a plan is applied once however often it is committed. Tables that a commit
doesn't give are carried over by name, not copied.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.sources.shared import stored

__all__ = ["Stale", "Store", "digest", "stored"]

STEPS = ("journal", "tables", "pointer")


class Stale(Exception):
    """The tables have changed since the plan was made."""


class Interrupted(Exception):
    """A commit that was told to stop after one of its steps."""


def digest(rows: DataFrame) -> Column:
    """A fingerprint of all rows, whatever their order: the count, and sums of two halves of each row's SHA-256."""
    line = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256)
    half = lambda i: F.coalesce(F.sum(F.conv(F.substring(line, i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), half(1), half(16)), 256)


class Store:
    """A folder of versioned tables; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, folder: str, ignored: tuple[str, ...] = ("position",)) -> None:
        self.spark, self.folder, self.ignored = spark, folder.rstrip("/"), ignored
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _json(self, name: str) -> dict | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> None:
        """Writes a file beside its place and renames it there, over what stands there."""
        new, place = self._path(f"{name}.new"), self._path(name)
        stream = self.fs.create(new, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(new, place, options)

    def current(self) -> dict | None:
        """The present version: number, plan_id, and path and fingerprint of each table."""
        return self._json("CURRENT")

    def read(self, table: str) -> DataFrame:
        now = self.current()
        if now is None or table not in now["tables"]:
            raise KeyError(table)
        return self.spark.read.parquet(f"{self.folder}/{now['tables'][table]['path']}")

    def applied(self, plan_id: str) -> bool:
        """Whether the present version or one before it came from the plan."""
        now = self.current()
        return now is not None and any((self._json(f"versions/{n:08d}/PLAN") or {}).get("plan_id") == plan_id for n in range(1, now["number"] + 1))

    def recover(self) -> str:
        """Clears up after a writer that stopped: its version is complete, or it goes."""
        journal = self._json("JOURNAL")
        if journal is None:
            return "clean"
        now = self.current()
        done = now is not None and now["number"] == journal["number"]
        if not done:
            self.fs.delete(self._path(f"versions/{journal['number']:08d}"), True)
        self.fs.delete(self._path("JOURNAL"), False)
        return "completed" if done else "rolled_back"

    def commit(self, plan_id: str, expected: dict[str, str] | None, tables: dict[str, DataFrame | Callable[[], DataFrame]], stop_after: str | None = None) -> str:
        """``applied``, or ``already_applied`` if the plan was committed before.

        ``expected`` gives the fingerprints of the tables that the plan was
        made for; others than the present ones raise ``Stale``. A table may be
        a function, called only when the commit goes ahead.
        """
        self.recover()
        if self.applied(plan_id):
            return "already_applied"
        now = self.current() or {"number": 0, "tables": {}}
        for table, fingerprint in (expected or {}).items():
            if now["tables"].get(table, {}).get("fingerprint") != fingerprint:
                raise Stale(f"{table} has changed since plan {plan_id} was made")
        number = now["number"] + 1
        place = f"versions/{number:08d}"
        self._put("JOURNAL", {"number": number, "plan_id": plan_id})
        self._stop("journal", stop_after)
        entries = dict(now["tables"])
        for table, rows in tables.items():
            (rows() if callable(rows) else rows).write.mode("overwrite").parquet(f"{self.folder}/{place}/{table}")
            written = self.spark.read.parquet(f"{self.folder}/{place}/{table}").drop(*self.ignored)
            entries[table] = {"path": f"{place}/{table}", "fingerprint": written.agg(digest(written)).first()[0]}
        self._put(f"{place}/PLAN", {"plan_id": plan_id})
        self._stop("tables", stop_after)
        self._put("CURRENT", {"number": number, "plan_id": plan_id, "tables": entries})
        self._stop("pointer", stop_after)
        self.fs.delete(self._path("JOURNAL"), False)
        return "applied"

    @staticmethod
    def _stop(step: str, stop_after: str | None) -> None:
        if step == stop_after:
            raise Interrupted(step)
