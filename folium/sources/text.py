"""Plain text, Markdown, web pages and archive paths as rows of blocks, chapters, scenes and paragraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.functions.text import is_chapter_heading, unix_lines

#: Largest input file that is read.
MAX_FILE_BYTES = 3 << 30
# File suffixes and their formats; lines that part scenes; entities, the ampersand last; hosts of archived works.
FORMATS = {"pdf": "pdf", "epub": "epub", "docx": "docx", "txt": "text", "md": "markdown", "markdown": "markdown"}
SCENE_BREAKS = ("***", "---", "* * *")
ENTITIES = (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))
WORK_HOSTS = ("archiveofourown.org", "archiveofourown.com", "archiveofourown.net", "www.archiveofourown.org", "www.archiveofourown.com", "www.archiveofourown.net", "download.archiveofourown.org", "ao3.org", "www.ao3.org")


def format_of(path: Column) -> Column:
    """Format by the lower-cased suffix; null where it is unknown."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair]), suffix)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, format, content) of supported files within the size bound; ``file_errors`` has the others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") <= MAX_FILE_BYTES).withColumn("format", format_of(F.col("path"))).filter("format IS NOT NULL").select("path", "length", "format", "content")


def file_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of the files that ``read_files`` leaves out; no content is read. Spark's file sources pass over files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    error = F.when(F.col("length") > MAX_FILE_BYTES, "file_too_large").when(format_of(F.col("path")).isNull(), "unsupported_format")
    return files.select("path", error.alias("error")).filter("error IS NOT NULL")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def frontmatter(text: Column) -> Column:
    """Map of the ``key: value`` lines between ``---`` lines at the start; keys lower-cased, values unquoted, empty ones dropped."""
    block = F.regexp_extract(unix_lines(text), r"(?s)^\x{FEFF}?---\n(.*?)\n---", 1)
    pair = lambda line: F.struct(
        F.lower(F.trim(F.regexp_extract(line, r"^([^:]*):(.*)$", 1))).alias("key"),
        F.regexp_replace(F.trim(F.regexp_extract(line, r"^([^:]*):(.*)$", 2)), "^[\"']+|[\"']+$", "").alias("value"),
    )
    pairs = F.filter(F.transform(F.split(block, "\n"), pair), lambda p: (p["key"] != "") & (p["value"] != ""))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(first)


def without_frontmatter(text: Column) -> Column:
    return F.regexp_replace(unix_lines(text), r"(?s)^\x{FEFF}?---\n.*?\n---[^\n]*\n?", "")


def blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", markdown: bool = True) -> DataFrame:
    """Rows (doc_id, block, kind, level, text): headings, paragraphs and scene breaks in order.

    Blank lines end a paragraph; ``#`` to ``######`` (Markdown) or a division
    word at the start of a line makes a heading. Null and empty texts have no blocks.
    """
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(without_frontmatter(F.col(text)) if markdown else unix_lines(F.col(text)), "\n")).alias("pos", "line"))
    t = F.trim("line")
    level = F.length(F.regexp_extract(t, r"^(#{1,6}) ", 1)) if markdown else F.lit(0)
    kind = F.when(t == "", "blank").when(t.isin(*SCENE_BREAKS), "scene_break").when(level > 0, "heading").when(is_chapter_heading(t), "heading").otherwise("paragraph")
    lines = lines.withColumns({"kind": kind, "level": F.when(kind == "heading", F.greatest(level, F.lit(1))).otherwise(0), "t": F.when(level > 0, F.trim(F.regexp_replace(t, r"^#{1,6} ", ""))).otherwise(t)})
    w = Window.partitionBy("doc_id").orderBy("pos")
    starts = (F.col("kind") != "paragraph") | (F.coalesce(F.lag("kind").over(w), F.lit("blank")) != "paragraph")
    grouped = lines.withColumn("g", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("kind <> 'blank'")
    out = grouped.groupBy("doc_id", "g").agg(F.min("pos").alias("pos"), F.min("kind").alias("kind"), F.max("level").alias("level"), F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("parts"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return out.select("doc_id", number.alias("block"), "kind", "level", F.array_join(F.col("parts.t"), " ").alias("text"))


def segment(block_rows: DataFrame) -> DataFrame:
    """Paragraph rows (doc_id, chapter, title, scene, paragraph, text) from ``blocks``.

    A heading starts a chapter; a heading followed by another one has no body
    and gives none. Text before the first heading is a chapter of its own,
    titled by its number. A scene break starts a scene if the current one has text.
    """
    w = Window.partitionBy("doc_id").orderBy("block")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    heading = (F.col("kind") == "heading").cast("int")
    marked = block_rows.withColumn("section", F.sum(heading).over(upto)).withColumn("heading", F.last(F.when(heading == 1, F.col("text")), True).over(upto))
    inside = Window.partitionBy("doc_id", "section").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("cut", F.sum((F.col("kind") == "scene_break").cast("int")).over(inside))
    body = marked.filter("kind = 'paragraph'")
    by_doc, by_section = Window.partitionBy("doc_id").orderBy("section"), Window.partitionBy("doc_id", "section").orderBy("cut")
    in_scene = Window.partitionBy("doc_id", "section", "cut").orderBy("block")
    body = body.withColumns({"chapter": F.dense_rank().over(by_doc), "scene": F.dense_rank().over(by_section), "paragraph": F.row_number().over(in_scene)})
    return body.select("doc_id", "chapter", F.coalesce("heading", F.concat(F.lit("Chapter "), F.col("chapter"))).alias("title"), "scene", "paragraph", "text")


def chapters(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, chapter, title, content, n_paragraphs, n_bytes): scenes joined by a break, paragraphs by a blank line."""
    scenes = paragraphs.groupBy("doc_id", "chapter", "title", "scene").agg(F.array_join(F.array_sort(F.collect_list(F.struct("paragraph", "text")))["text"], "\n\n").alias("body"), F.count(F.lit(1)).alias("n"))
    out = scenes.groupBy("doc_id", "chapter", "title").agg(F.array_join(F.array_sort(F.collect_list(F.struct("scene", "body")))["body"], "\n\n***\n\n").alias("content"), F.sum("n").alias("n_paragraphs"))
    return out.withColumn("n_bytes", F.octet_length("content").cast("bigint"))


def book_blocks(paragraphs: DataFrame) -> DataFrame:
    """The flat form of a book: heading, paragraph and scene-break rows with a dense position."""
    first = F.struct(F.col("chapter"), F.lit(0).alias("scene"), F.lit(0).alias("paragraph"))
    headings = paragraphs.select("doc_id", first.alias("at"), F.lit("heading").alias("kind"), F.col("title").alias("text")).distinct()
    breaks = paragraphs.filter("scene > 1").select("doc_id", F.struct("chapter", "scene", F.lit(0).alias("paragraph")).alias("at"), F.lit("scene_break").alias("kind"), F.lit("***").alias("text")).distinct()
    body = paragraphs.select("doc_id", F.struct("chapter", "scene", "paragraph").alias("at"), F.lit("paragraph").alias("kind"), "text")
    rows = headings.unionByName(breaks).unionByName(body)
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).alias("position"), "kind", "text")


def html_text(html: Column) -> Column:
    """Text of a page: block tags become line ends, other tags vanish, entities are decoded, spaces and blank runs collapse."""
    t = F.regexp_replace(html, r"(?i)</?(p|div|br|h[1-6]|li)(\s[^>]*)?/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    t = entities(t)
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def work_id(*sources: Column) -> Column:
    """Number of an archived work from the first source whose URL names one, without leading zeros; hosts in the order of ``WORK_HOSTS``."""
    number = lambda s, host: F.nullif(F.regexp_extract(F.lower(s), rf"(?:^|//){host.replace('.', '[.]')}/works/0*([0-9]+)", 1), F.lit(""))
    return F.coalesce(*[number(s, host) for s in sources for host in WORK_HOSTS])


def entities(t: Column) -> Column:
    """``t`` with the entities of ``ENTITIES`` decoded."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, t)


def archive_path(base: Column, href: Column) -> Column:
    """``href`` resolved against the folder of ``base``; fragments are dropped, ``..`` steps up."""
    folder = F.regexp_replace(base, r"[^/]*$", "")
    parts = F.split(F.concat(folder, F.regexp_replace(href, "#.*$", "")), "/")
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def clean_pdf_text(text: Column) -> Column:
    """Extracted page text: form feeds part blocks, trailing blanks and NULs go, runs of blank lines collapse."""
    t = F.replace(F.replace(unix_lines(text), F.lit("\x00"), F.lit("")), F.lit("\f"), F.lit("\n\n"))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
