"""Parsers by format: files go to the parser that is registered for their suffix."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.sources import packages
from folium.sources import text as source

Parser = Callable[[DataFrame], DataFrame]
BLOCK = ["doc_id", "block", "kind", "level", "text"]


def _decoded(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))


def _pages(files: DataFrame) -> DataFrame:
    lines = _decoded(files).select("doc_id", F.posexplode(F.split(source.html_text(F.col("text")), "\n")).alias("block", "text")).filter("text <> ''")
    return lines.select("doc_id", (F.col("block") + 1).alias("block"), F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), "text")


class Registry:
    """Formats with their suffixes and parsers; a parser turns files (path, content) into blocks (doc_id, block, kind, level, text)."""

    def __init__(self) -> None:
        self.parsers: dict[str, Parser] = {}
        self.formats: dict[str, str] = {}

    def register(self, name: str, suffixes: tuple[str, ...], parser: Parser) -> None:
        """Adds a format, or puts another parser in place of one; suffixes are compared without case."""
        self.parsers[name] = parser
        self.formats |= {s.lower().removeprefix("."): name for s in suffixes}

    def format_of(self, path: str = "path") -> Column:
        suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
        pairs = [F.lit(x) for p in self.formats.items() for x in p]
        return F.try_element_at(F.create_map(*pairs), suffix) if pairs else F.lit(None).cast("string")

    def ingest(self, files: DataFrame, most_bytes: int = source.MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
        """(blocks, errors) of files (path, content): every file gives blocks or an error.

        Errors have path and error: unsupported_format, file_too_large,
        corrupt_archive (or a member that is too large), empty. Parsers of
        different formats run side by side over the files of their own.
        """
        known = files.withColumns({"format": self.format_of(), "size": F.octet_length("content")})
        refusal = F.when(F.col("format").isNull(), "unsupported_format").when(F.col("size") > most_bytes, "file_too_large")
        fit = known.filter(refusal.isNull())
        parts = [parser(fit.filter(F.col("format") == name).select("path", "content")).select(*BLOCK) for name, parser in self.parsers.items()]
        blocks = reduce(lambda a, b: a.unionByName(b), parts)
        errors = known.select("path", refusal.alias("error")).filter("error IS NOT NULL")
        archives = fit.filter(F.col("format").isin("epub", "docx")).select("path", "content")
        broken = packages.members(archives).filter("error IS NOT NULL").select("path", "error")
        empty = fit.select("path").join(blocks.select(F.col("doc_id").alias("path")).distinct(), "path", "left_anti").join(broken.select("path"), "path", "left_anti").select("path", F.lit("empty").alias("error"))
        return blocks, errors.unionByName(broken).unionByName(empty)


def default_registry() -> Registry:
    """Plain text, Markdown, web pages, EPUB and DOCX."""
    out = Registry()
    out.register("text", ("txt",), lambda f: source.blocks(_decoded(f), markdown=False))
    out.register("markdown", ("md", "markdown"), lambda f: source.blocks(_decoded(f)))
    out.register("html", ("html", "htm", "xhtml"), _pages)
    out.register("epub", ("epub",), lambda f: packages.epub_blocks(packages.members(f)))
    out.register("docx", ("docx",), lambda f: packages.docx_blocks(packages.members(f)))
    return out
