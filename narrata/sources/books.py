"""Books as tables of chapters: EPUB and FB2 files and web pages.

A book is one row of ``binaryFile``; the container is opened in a map over rows (one book at a time in memory) and comes out as
one row a document or section. Everything after that, titles, line breaks and grouping by the table of contents, is DataFrame work.
"""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from narrata.functions import clean

DOCUMENTS = "book string, title string, author string, spine_pos int, href string, tag_title string, raw string"
ENTRIES = "book string, entry_pos int, title string, hrefs array<string>"
SECTIONS = "book string, title string, author string, pos int, section_title string, raw string"


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files of a folder; the format follows from the suffix in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", book_format("path").alias("format"))


#: File suffix to format; more can be added, with a function that makes documents or sections of the format's files.
FORMATS: dict[str, str] = {".epub": "epub", ".fb2": "fb2"}


def book_format(path) -> Column:
    """The format of a file by its suffix, in any case; a suffix of no known format is an error."""
    path = F.col(path) if isinstance(path, str) else path
    found = F.coalesce(*[F.when(F.endswith(F.lower(path), F.lit(suffix)), name) for suffix, name in FORMATS.items()])
    return F.coalesce(found, F.raise_error(F.concat(F.lit(f"none of {', '.join(FORMATS)}: "), path)))


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _find(root: ET.Element, *names: str) -> ET.Element | None:
    return next((e for e in root.iter() if _local(e) in names), None)


def _text(e: ET.Element | None) -> str:
    return "".join(e.itertext()) if e is not None else ""


class _Epub:
    """The package of an EPUB container."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        container = ET.fromstring(self.zip.read("META-INF/container.xml"))
        self.opf = next(e.get("full-path") for e in container.iter() if _local(e) == "rootfile")
        self.package = ET.fromstring(self.zip.read(self.opf))
        self.base = posixpath.dirname(self.opf)
        self.items = {e.get("id"): e for e in self.package.iter() if _local(e) == "item"}

    def read(self, href: str) -> bytes:
        return self.zip.read(posixpath.normpath(posixpath.join(self.base, unquote(href))))

    def meta(self, name: str) -> str | None:
        return _text(_find(self.package, name)).strip() or None

    def documents(self) -> list[str]:
        """Hrefs in reading order: the spine, each once, then documents that it doesn't list."""
        pages = {k: e.get("href") for k, e in self.items.items() if "html" in (e.get("media-type") or "") and "nav" not in (e.get("properties") or "").split()}
        spine = [e.get("idref") for e in self.package.iter() if _local(e) == "itemref"]
        return [pages[k] for k in dict.fromkeys([k for k in spine if k in pages] + list(pages))]

    def entries(self) -> list[tuple[str, list[str]]]:
        """Title and hrefs (its own, then its children's) of each entry at the top of the table of contents."""
        ncx = next((e for e in self.items.values() if "ncx" in (e.get("media-type") or "")), None)
        nav = next((e for e in self.items.values() if "nav" in (e.get("properties") or "").split()), None)
        if nav is not None:
            root = ET.fromstring(self.read(nav.get("href")))
            top = next((e for e in root.iter() if _local(e) == "nav" and any(v == "toc" for k, v in e.attrib.items() if k.endswith("type"))), None)
            lists = [e for e in (top if top is not None else root) if _local(e) == "ol"]
            points = [e for o in lists for e in o if _local(e) == "li"]
            title, link, base = (lambda p: next((_text(e).strip() for e in p.iter() if _local(e) in ("a", "span") and _text(e).strip()), "")), (lambda p: [e.get("href") for e in p.iter() if _local(e) == "a" and e.get("href")]), nav.get("href")
        elif ncx is not None:
            root = ET.fromstring(self.read(ncx.get("href")))
            points = [e for e in (_find(root, "navMap") or ()) if _local(e) == "navPoint"]
            title, link, base = (lambda p: next((_text(e).strip() for e in p.iter() if _local(e) == "text" and _text(e).strip()), "")), (lambda p: [e.get("src") for e in p.iter() if _local(e) == "content" and e.get("src")]), ncx.get("href")
        else:
            return []
        return [(title(p), [posixpath.normpath(posixpath.join(posixpath.dirname(base), h)) for h in link(p)]) for p in points]

    def cover(self) -> tuple[bytes, str] | None:
        named = next((e.get("content") for e in self.package.iter() if _local(e) == "meta" and e.get("name") == "cover"), None)
        item = next((e for k, e in self.items.items() if k == named or "cover-image" in (e.get("properties") or "").split()), None)
        return (self.read(item.get("href")), item.get("media-type")) if item is not None else None


def _rows(kind: str, one) -> object:
    """A map over book rows; a book that can't be opened fails with its path."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content, strict=True):
                try:
                    yield pd.DataFrame(one(path, content), columns=[c.split()[0] for c in kind.split(", ")])
                except (zipfile.BadZipFile, ET.ParseError, KeyError, StopIteration) as e:
                    raise ValueError(f"{path} can't be read as a book: {e}") from e

    return run


def epub_documents(books: DataFrame) -> DataFrame:
    """One row a document, in reading order, with the text of its first title, h1, h2 or h3."""
    def one(path, content):
        book = _Epub(content)
        for pos, href in enumerate(book.documents()):
            root = ET.fromstring(book.read(href))
            tag = next((e for e in (_find(root, t) for t in ("title", "h1", "h2", "h3")) if e is not None), None)
            yield path, book.meta("title"), book.meta("creator"), pos, href, _text(tag) if tag is not None else None, _text(root)

    return books.where("format = 'epub'").select("path", "content").mapInPandas(_rows(DOCUMENTS, one), DOCUMENTS)


def epub_entries(books: DataFrame) -> DataFrame:
    def one(path, content):
        for pos, (title, hrefs) in enumerate(_Epub(content).entries()):
            yield path, pos, title, hrefs

    return books.where("format = 'epub'").select("path", "content").mapInPandas(_rows(ENTRIES, one), ENTRIES)


def _fb2_lines(section: ET.Element) -> Iterator[str]:
    for e in section:
        kind = _local(e)
        if kind in ("p", "subtitle"):
            yield _text(e)
        elif kind == "empty-line":
            yield ""
        elif kind == "poem":
            for stanza in (s for s in e if _local(s) == "stanza"):
                yield from (_text(v) for v in stanza if _local(v) == "v")
                yield ""
        elif kind in ("cite", "epigraph"):
            yield from (_text(p) for p in e.iter() if _local(p) == "p")


def _leaves(e: ET.Element) -> Iterator[ET.Element]:
    for s in (s for s in e if _local(s) == "section"):
        if any(_local(x) == "section" for x in s):
            yield from _leaves(s)
        else:
            yield s


def fb2_sections(books: DataFrame) -> DataFrame:
    """Leaf sections of the unnamed bodies, depth first."""
    def one(path, content):
        root = ET.fromstring(content)
        info = _find(root, "title-info")
        title = _text(_find(info, "book-title")).strip() or None if info is not None else None
        author = _find(info, "author") if info is not None else None
        name = " ".join(t for t in (_text(e).strip() for e in author if _local(e).endswith("name")) if t) or None if author is not None else None
        leaves = (s for b in root.iter() if _local(b) == "body" and not b.get("name") for s in _leaves(b))
        for pos, s in enumerate(leaves):
            head = next((e for e in s if _local(e) == "title"), None)
            yield path, title, name, pos, " ".join(t.strip() for t in head.itertext() if t.strip()) if head is not None else "", "\n".join(_fb2_lines(s))

    return books.where("format = 'fb2'").select("path", "content").mapInPandas(_rows(SECTIONS, one), SECTIONS)


def covers(books: DataFrame) -> DataFrame:
    """(book, cover struct<data, media_type>), null where a book has none."""
    import base64

    def one(path, content):
        if content[:2] == b"PK":
            got = _Epub(content).cover()
        else:
            root = ET.fromstring(content)
            page = _find(root, "coverpage")
            image = _find(page, "image") if page is not None else None
            name = next((v.lstrip("#") for k, v in image.attrib.items() if k.endswith("href")), None) if image is not None else None
            blob = next((e for e in root.iter() if _local(e) == "binary" and e.get("id") == name), None)
            got = (base64.b64decode(blob.text or ""), blob.get("content-type")) if blob is not None else None
        yield path, got[0] if got else None, got[1] if got else None

    rows = books.select("path", "content").mapInPandas(_rows("book string, data binary, media_type string", one), "book string, data binary, media_type string")
    return rows.select("book", F.when(F.col("data").isNotNull(), F.struct("data", "media_type")).alias("cover"))


# Chapters --------------------------------------------------------------------------------------------------


def search_and_replace(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Pattern and replacement pairs, in their order."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def document_chapters(documents: DataFrame, break_string: str, newline_mode: str = "double", title_mode: str = "auto", rules: list[tuple[str, str]] = ()) -> DataFrame:
    """(book, chapter_idx, href, title, text): one chapter a document."""
    text = search_and_replace(clean.newline_mode(F.col("raw"), newline_mode, break_string), list(rules))
    rows = documents.withColumn("text", text)
    title = clean.sanitize_title(clean.document_title(F.col("tag_title"), F.col("text"), title_mode), break_string)
    return rows.select("book", F.col("spine_pos").alias("chapter_idx"), "href", title.alias("title"), "text")


def section_chapters(sections: DataFrame, break_string: str, newline_mode: str = "double", rules: list[tuple[str, str]] = ()) -> DataFrame:
    """The same for FB2 sections; blank ones are left out."""
    text = search_and_replace(clean.newline_mode(F.col("raw"), newline_mode, break_string, collapse="spaces"), list(rules))
    rows = sections.withColumn("text", text).where(clean.has_content(F.col("text")))
    title = F.when(F.col("section_title") != "", F.col("section_title")).otherwise(F.substring("text", 1, 60))
    pos = F.row_number().over(W.partitionBy("book").orderBy("pos")) - 1
    return rows.select("book", pos.alias("chapter_idx"), clean.sanitize_title(title, break_string).alias("title"), "text")


def href_forms(href: Column) -> Column:
    """How an href may be written: decoded, without fragment, lower case; then its last part."""
    full = F.lower(F.trim(F.replace(F.substring_index(F.try_url_decode(F.replace(href, F.lit("+"), F.lit("%2B"))), "#", 1), F.lit("\\"), F.lit("/"))))
    return F.filter(F.array_distinct(F.array(full, F.substring_index(full, "/", -1))), lambda h: h != "")


def toc_chapters(chapters: DataFrame, entries: DataFrame, break_string: str) -> DataFrame:
    """Documents grouped by the table of contents.

    Each entry starts at the first document that one of its hrefs names; entries with the same start are one, with
    the first title that isn't empty. A chapter runs to the next start; what comes before the first is left out. Books without a usable entry
    keep a chapter for each document.
    """
    docs = chapters.select("book", "chapter_idx", F.posexplode(href_forms(F.col("href"))).alias("rank", "form"))
    named = docs.groupBy("book", "form").agg(F.min("chapter_idx").alias("doc"))
    asked = entries.select("book", "entry_pos", F.col("title").alias("entry"), F.posexplode("hrefs").alias("h", "href"))
    asked = asked.select("book", "entry_pos", "entry", "h", F.posexplode(href_forms(F.col("href"))).alias("rank", "form"))
    met = asked.join(named, ["book", "form"]).groupBy("book", "entry_pos", "entry", "h").agg(F.min_by("doc", "rank").alias("doc"))
    starts = met.groupBy("book", "entry_pos", "entry").agg(F.min("doc").alias("start"))
    order = F.struct((F.trim("entry") == "").cast("int").alias("blank"), F.col("entry_pos").alias("pos"))
    starts = starts.groupBy("book", "start").agg(F.min_by(F.trim(F.col("entry")), order).alias("entry"))
    ranges = starts.withColumn("next", F.lead("start").over(W.partitionBy("book").orderBy("start")))
    inside = (F.col("c.book") == F.col("r.book")) & (F.col("c.chapter_idx") >= F.col("r.start")) & (F.col("r.next").isNull() | (F.col("c.chapter_idx") < F.col("r.next")))
    joined = chapters.alias("c").join(ranges.alias("r"), inside).groupBy("r.book", "r.start", "r.entry").agg(F.array_sort(F.collect_list(F.struct("c.chapter_idx", "c.title", "c.text"))).alias("docs"))
    joiner = break_string * 2 if break_string else "\n\n"
    texts = F.filter(F.transform("docs", lambda d: clean.strip(d["text"])), lambda t: t != "")
    title = F.when(F.col("entry") != "", clean.sanitize_title(F.col("entry"), break_string)).otherwise(F.col("docs")[0]["title"])
    grouped = joined.select("book", "start", title.alias("title"), F.array_join(texts, joiner).alias("text")).where("text <> ''")
    grouped = grouped.select("book", (F.row_number().over(W.partitionBy("book").orderBy("start")) - 1).alias("chapter_idx"), "title", "text")
    return grouped.unionByName(chapters.join(starts.select("book").distinct(), "book", "left_anti").select("book", "chapter_idx", "title", "text"))


def page_chapters(pages: DataFrame, break_string: str = " @BRK#", title_mode: str = "auto") -> DataFrame:
    """(page_id, title, text) of a table of web pages, without markup, scripts and styles."""
    bare = F.regexp_replace("html", r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    text = F.regexp_replace(bare, r"(?s)<[^>]*>", "\n")
    rows = pages.select("page_id", clean.html_tag_title(F.col("html")).alias("tag"), clean.newline_mode(text, "single", break_string).alias("text"))
    return rows.select("page_id", clean.sanitize_title(clean.document_title(F.col("tag"), F.col("text"), title_mode), break_string).alias("title"), "text")
