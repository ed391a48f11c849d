"""EPUB and DOCX packages as rows of blocks, and the sinks that write them.

Archives are opened inside tasks, one file at a time; ordering, joins and
checks are DataFrame operations.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator
from html import escape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folium.sources.text import archive_path, entities, html_text, work_id

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Languages written from right to left.
RIGHT_TO_LEFT = ("fa", "ar", "he", "ur", "ps", "ckb")
MEMBER_BYTES = 64 << 20
#: Bytes of values that a task hands on at once.
BATCH_BYTES = 4 << 20
# Elements of a package's metadata, and limits of what is taken over.
PACKAGE_ELEMENTS = ("identifier", "publisher", "source", "description", "rights", "date")
METADATA_CHARS = 16_384
SUBJECTS = 256


def _records(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``BATCH_BYTES``, so that a task holds few books at a time however many come in a batch."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, str | bytes))
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    columns = zip(*held, strict=True) if held else [[] for _ in names]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, made into Python values one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


def _members(files: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for path, content in _each(files):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    if not info.filename.endswith((".xml", ".opf", ".xhtml", ".html", ".htm")):
                        continue
                    if info.file_size > MEMBER_BYTES:
                        yield path, None, None, f"member_too_large:{info.filename}"
                    else:
                        yield path, info.filename, z.read(info).decode("utf-8", "replace"), None
        except zipfile.BadZipFile:
            yield path, None, None, "corrupt_archive"


def members(files: DataFrame) -> DataFrame:
    """(path, member, body, error): text members of the archives of ``read_files``; a corrupt one, and a member over ``MEMBER_BYTES``, gives an error row."""
    names = ["path", "member", "body", "error"]
    return files.select("path", "content").mapInArrow(lambda batches: _records(_members(batches), names, [pa.string()] * 4), "path string, member string, body string, error string")


def epub_items(archive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, id, member) of each manifest, and (path, idref, position) of each spine."""
    opf = archive.filter(F.endswith("member", F.lit(".opf")))
    attribute = lambda tag, name: F.regexp_extract(tag, rf'\s{name}\s*=\s*["\']([^"\']*)["\']', 1)
    items = opf.select("path", "member", F.explode(F.regexp_extract_all("body", F.lit(r"(<(?:\w+:)?item\s[^>]*>)"), 1)).alias("tag"))
    manifest = items.select("path", attribute(F.col("tag"), "id").alias("id"), archive_path(F.col("member"), attribute(F.col("tag"), "href")).alias("member"))
    refs = opf.select("path", F.posexplode(F.regexp_extract_all("body", F.lit(r"(<(?:\w+:)?itemref\s[^>]*>)"), 1)).alias("position", "tag"))
    return manifest, refs.select("path", attribute(F.col("tag"), "idref").alias("idref"), "position")


def epub_metadata(archive: DataFrame) -> DataFrame:
    """(path, title, creator, language, identifier, source) from the package file; absent ones are null."""
    value = lambda name: F.nullif(F.trim(F.regexp_extract("body", rf"(?s)<(?:\w+:)?{name}[^>]*>(.*?)</", 1)), F.lit("")).alias(name)
    return archive.filter(F.endswith("member", F.lit(".opf"))).select("path", *[value(n) for n in ("title", "creator", "language", "identifier", "source")])


def element_texts(xml: Column, name: str) -> Column:
    """Distinct non-empty texts of an element, those with the ``dc`` prefix first: entities decoded, white space collapsed, cut at ``METADATA_CHARS``."""
    bodies = lambda tag: F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?:\s(?:[^>]*[^>/])?)?>(.*?)</{tag}>"), 1)
    cleaned = F.transform(F.concat(bodies(f"dc:{name}"), bodies(name)), lambda x: F.left(F.trim(F.regexp_replace(entities(x), r"(?U)\s+", " ")), F.lit(METADATA_CHARS)))
    return F.array_distinct(F.filter(cleaned, lambda x: x != ""))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once for a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def merge_package_metadata(known: Column, xml: Column) -> Column:
    """``known`` (map, or null) with what a package file says: the first text of each of ``PACKAGE_ELEMENTS``, and the subjects.

    Known entries stay, but for the origin (source_site, source_url,
    ao3_work_id), which an identifier or source with the address of an
    archived work sets. A null package adds nothing.
    """
    entry = lambda pairs: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda x: x["value"].isNotNull()))
    without = lambda m, other: F.map_filter(m, lambda k, v: ~F.map_contains_key(other, k))

    def texts(body: Column) -> Column:
        """The texts of each element, sought once."""
        return F.struct(*[element_texts(body, name).alias(name) for name in (*PACKAGE_ELEMENTS, "subject")])

    def facts(x: Column) -> Column:
        subjects = F.nullif(F.left(F.array_join(F.slice(x["subject"], 1, SUBJECTS), " | "), F.lit(METADATA_CHARS)), F.lit(""))
        work = F.get(F.filter(F.transform(F.concat(x["identifier"], x["source"]), lambda s: work_id(s)), lambda w: w.isNotNull()), 0)
        found = entry([*[(f"epub_{name}", F.get(x[name], 0)) for name in PACKAGE_ELEMENTS], ("epub_subjects", subjects)])
        return F.struct(found.alias("found"), work.alias("work"))

    def merged(x: Column) -> Column:
        work = x["work"]
        place = entry([("source_site", F.when(work.isNotNull(), "archiveofourown.org")), ("source_url", F.concat(F.lit("https://archiveofourown.org/works/"), work)), ("ao3_work_id", work)])
        had = F.coalesce(known, F.create_map().cast("map<string,string>"))
        return F.map_concat(without(had, place), without(x["found"], had), place)

    return _once(_once(_once(F.coalesce(xml, F.lit("")), texts), facts), merged)


def epub_blocks(archive: DataFrame) -> DataFrame:
    """(doc_id, block, kind, level, text) in spine order; a resource without a heading at its start gets one from its name.

    Spine entries that the manifest lacks are skipped.
    """
    manifest, spine = epub_items(archive)
    ordered = spine.join(manifest, (spine["path"] == manifest["path"]) & (spine["idref"] == manifest["id"])).select(spine["path"].alias("path"), "position", "member")
    pages = ordered.join(archive.select("path", "member", "body"), ["path", "member"])
    marked = F.regexp_replace(F.regexp_replace("body", r"(?is)^.*?<body[^>]*>", ""), r"(?i)<h([1-6])[^>]*>", "<h1>\u0001$1 ")
    lines = pages.select("path", "position", "member", F.posexplode(F.split(html_text(marked), "\n")).alias("at", "line")).filter("line <> ''")
    heading = F.startswith("line", F.lit("\u0001"))
    rows = lines.select("path", "position", "at", F.when(heading, "heading").otherwise("paragraph").alias("kind"), F.when(heading, F.substring("line", 2, 1).cast("int")).otherwise(0).alias("level"), F.when(heading, F.trim(F.substring("line", 3, 1 << 30))).otherwise(F.col("line")).alias("text"))
    first = lines.groupBy("path", "position", "member").agg(F.min_by("line", "at").alias("first")).filter(~F.startswith("first", F.lit("\u0001")))
    stem = F.regexp_replace(F.regexp_replace("member", r"^.*/", ""), r"\.[^.]*$", "")
    made = first.select("path", "position", F.lit(-1).alias("at"), F.lit("heading").alias("kind"), F.lit(1).alias("level"), stem.alias("text"))
    number = F.row_number().over(Window.partitionBy("path").orderBy("position", "at"))
    return rows.unionByName(made).select(F.col("path").alias("doc_id"), number.alias("block"), "kind", "level", "text")


def _paragraphs(bodies: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for path, body in _each(bodies):
        for i, p in enumerate(ElementTree.fromstring(body).iter(f"{W}p"), 1):
            text = "".join("\t" if n.tag == f"{W}tab" else "\n" if n.tag == f"{W}br" else (n.text or "") for n in p.iter() if n.tag in (f"{W}t", f"{W}tab", f"{W}br")).strip()
            style = next((s.get(f"{W}val", "") for s in p.iter(f"{W}pStyle")), "").lower()
            level = int(style[7:] or 1) if style.startswith("heading") and style[7:].strip().isdigit() | (style == "heading") else 0
            if text:
                yield path, i, "heading" if level else "paragraph", level, text


def docx_blocks(archive: DataFrame) -> DataFrame:
    """(doc_id, block, kind, level, text) of non-empty paragraphs; the block number counts empty ones too."""
    names, kinds = ["doc_id", "block", "kind", "level", "text"], [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    return archive.filter("member = 'word/document.xml'").select("path", "body").mapInArrow(lambda batches: _records(_paragraphs(batches), names, kinds), "doc_id string, block int, kind string, level int, text string")


def mapping_problems(blocks: DataFrame, mapping: DataFrame) -> DataFrame:
    """(block_id, problem) of translated blocks (block_id, text): unknown, empty or duplicate ids."""
    unknown = mapping.join(blocks.select("block_id"), "block_id", "left_anti").select("block_id", F.lit("unknown").alias("problem"))
    empty = mapping.filter(F.trim(F.coalesce("text", F.lit(""))) == "").select("block_id", F.lit("empty").alias("problem"))
    twice = mapping.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("block_id", F.lit("duplicate").alias("problem"))
    return unknown.unionByName(empty).unionByName(twice)


def docx_bytes(title: str, chapters: list[tuple[str, str]], rtl: bool = True) -> bytes:
    """A package of one book; chapters are (title, content). A book without chapters is an error."""
    if not chapters:
        raise ValueError("a book needs at least one chapter")
    bidi = "<w:bidi/>" if rtl else ""
    run = lambda text: f'<w:r>{"<w:rPr><w:rtl/></w:rPr>" if rtl else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'
    para = lambda text, style="": f"<w:p><w:pPr>{style}{bidi}</w:pPr>{run(text)}</w:p>"
    body = para(title, '<w:pStyle w:val="Title"/>')
    for name, content in chapters:
        body += para(name, '<w:pStyle w:val="Heading1"/>') + "".join(para(x.strip()) for x in content.split("\n\n") if x.strip())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def epub_bytes(title: str, creator: str, language: str, chapters: list[tuple[str, str]]) -> bytes:
    """A package of one book, version 3: a page for each chapter (title, content), in reading order, and a table of contents.

    Content is cut into paragraphs at blank lines. The same book gives the same
    bytes: parts have one fixed date. A book without chapters is an error.
    """
    if not chapters:
        raise ValueError("a book needs at least one chapter")
    direction = ' dir="rtl"' if language.split("-")[0].lower() in RIGHT_TO_LEFT else ""
    page = lambda head, body: f'<?xml version="1.0" encoding="UTF-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="{escape(language)}"{direction}><head><title>{escape(head)}</title></head><body>{body}</body></html>'
    names = [f"chapter-{i:05d}" for i in range(1, len(chapters) + 1)]
    items = "".join(f'<item id="{n}" href="text/{n}.xhtml" media-type="application/xhtml+xml"/>' for n in names)
    identifier = hashlib.sha256("\x1f".join([title, creator, language, *(x for c in chapters for x in c)]).encode()).hexdigest()
    package = (
        '<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">urn:sha256:{identifier}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:creator>{escape(creator)}</dc:creator><dc:language>{escape(language)}</dc:language></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{"".join(f"""<itemref idref="{n}"/>""" for n in names)}</spine></package>'
    )
    contents = "".join(f'<li><a href="text/{n}.xhtml">{escape(t)}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
    parts = {
        "META-INF/container.xml": '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "OEBPS/content.opf": package, "OEBPS/nav.xhtml": page(title, f'<nav epub:type="toc"><ol>{contents}</ol></nav>'),
    }
    for n, (head, content) in zip(names, chapters, strict=True):
        body = "".join(f"<p>{escape(x.strip())}</p>" for x in content.split("\n\n") if x.strip())
        parts[f"OEBPS/text/{n}.xhtml"] = page(head, f"<h1>{escape(head)}</h1>{body}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype", (1980, 1, 1, 0, 0, 0)), "application/epub+zip", zipfile.ZIP_STORED)
        for name, part in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), part, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _written(books: DataFrame, package: Callable[[object, list[dict]], bytes]) -> DataFrame:
    """(doc_id, content): the package of each book (doc_id, chapters)."""
    key = books.schema["doc_id"].dataType
    kinds = [to_arrow_type(key), pa.binary()]
    return books.mapInArrow(lambda batches: _records(((d, package(d, c)) for d, c in _each(batches)), ["doc_id", "content"], kinds), f"doc_id {key.simpleString()}, content binary")


def epub_books(chapters: DataFrame, language: str = "fa", creator: str = "") -> DataFrame:
    """(doc_id, content): an EPUB package for each book of chapter rows (doc_id, chapter, title, content), built in tasks; the id is the book's title."""
    books = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chapter", "title", "content"))).alias("c"))

    return _written(books, lambda d, c: epub_bytes(str(d), creator, language, [(x["title"], x["content"]) for x in c]))


def docx_books(chapters: DataFrame, language: str = "fa") -> DataFrame:
    """(doc_id, content): a DOCX package for each book of chapter rows (doc_id, chapter, title, content), built in tasks."""
    rtl = language in RIGHT_TO_LEFT
    books = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chapter", "title", "content"))).alias("c"))

    return _written(books, lambda d, c: docx_bytes(str(d), [(x["title"], x["content"]) for x in c], rtl))
