"""Translation memories and glossaries as JSON, and as tables that are searched and added to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.sources.versions import Store

#: Fields of an entry by kind of table; the first two are required.
KINDS = {"memory": "source string, translation string, context string, tags array<string>", "glossary": "source_term string, preferred_translation string, context string"}


def _fields(kind: str) -> list[str]:
    return [f.split()[0] for f in KINDS[kind].split(", ")]


def load_json(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(entries, errors) of a file or folder: a file that begins with a bracket is one array of entries, any other has one entry a line.

    Entries have position and the fields of their kind; absent contexts are
    empty, absent tags an empty list, other fields are passed over. Errors have
    path, position and error: ``not_json``, or the name of a required field
    that is absent. A file of lines is read in splits, an array as a whole.
    """
    files = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("row"), "value").filter("trim(value) <> ''")
    first = files.groupBy("path").agg(F.min_by("value", "row").alias("head"))
    arrays = [r["path"] for r in first.filter("ltrim(head) LIKE '[%'").select("path").collect()]  # names of files, as the driver lists them anyway
    lines = files.filter(~F.col("path").isin(arrays)).select("path", "row", F.from_json("value", KINDS[kind]).alias("e"))
    whole = spark.read.text(arrays, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value") if arrays else spark.createDataFrame([], "path string, value string")
    parsed = whole.select("path", F.from_json("value", _array(kind)).alias("es"))
    one = parsed.filter("es IS NOT NULL").select("path", F.posexplode("es").alias("row", "e"))
    rows = lines.select("path", "row", "e").unionByName(one.select("path", F.col("row").cast("bigint").alias("row"), "e"))
    required = _fields(kind)[:2]
    lacking = F.coalesce(*[F.when(F.col(f"e.{c}").isNull(), F.lit(c)) for c in required])
    broken = F.col("e").isNull() | (F.col(f"e.{required[0]}").isNull() & F.col(f"e.{required[1]}").isNull() & F.col("e.context").isNull())
    marked = rows.withColumn("error", F.when(broken, "not_json").otherwise(lacking))
    number = F.row_number().over(Window.partitionBy("path").orderBy("row")) - 1
    entries = marked.withColumn("position", number)
    blank = {"context": F.coalesce("e.context", F.lit(""))} | ({"tags": F.coalesce("e.tags", F.array().cast("array<string>"))} if kind == "memory" else {})
    good = entries.filter("error IS NULL").select("path", "position", *[blank.get(c, F.col(f"e.{c}")).alias(c) for c in _fields(kind)])
    bad = entries.filter("error IS NOT NULL").select("path", "position", "error").unionByName(parsed.filter("es IS NULL").select("path", F.lit(0).alias("position"), F.lit("not_json").alias("error")))
    return good, bad


def _array(kind: str) -> str:
    fields = ",".join(":".join(f.split(" ", 1)) for f in KINDS[kind].split(", "))
    return f"array<struct<{fields}>>"


def save_json(entries: DataFrame, path: str, kind: str) -> None:
    """One entry a line, in a folder that appears as a whole or not at all; an existing one is an error."""
    entries.select(*_fields(kind)).write.option("ignoreNullFields", "false").json(path)


class EntryTable:
    """A table of entries in versions: adding makes a new version, searches read the present one."""

    def __init__(self, spark: SparkSession, folder: str, kind: str) -> None:
        self.store, self.kind, self.columns = Store(spark, folder), kind, _fields(kind)

    def add(self, entries: DataFrame, batch: str) -> str:
        """Appends entries once a ``batch``; required fields may not be blank (such rows are left out)."""
        first, second = self.columns[:2]
        fit = entries.select(*self.columns).filter((F.trim(F.coalesce(first, F.lit(""))) != "") & (F.trim(F.coalesce(second, F.lit(""))) != ""))
        grown = lambda: fit if self.store.current() is None else self.store.read(self.kind).unionByName(fit)
        return self.store.commit(batch, None, {self.kind: grown})

    def search(self, text: str) -> DataFrame:
        """Entries whose first field holds the text as it stands."""
        return self.store.read(self.kind).filter(F.contains(self.columns[0], F.lit(text)))

    def lookup(self, terms: DataFrame, term: str = "term") -> DataFrame:
        """(term, fields of its entry): for each term one entry whose first field equals it, the least by the other fields."""
        first = self.columns[0]
        rest = F.struct(*self.columns[1:])
        one = self.store.read(self.kind).groupBy(first).agg(F.min(rest).alias("x")).select(F.col(first).alias(term), "x.*")
        return terms.select(term).distinct().join(one, term)
