"""Parsers: content to blocks (pos, text, block_type, level), chosen by file type."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import block_type, strip

Parser = Callable[[str], list[tuple[str, str, int]]]
#: Characters of blocks that are passed on at once.
BATCH_CHARS = 4 << 20


def parse_text(docs: DataFrame, key: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Paragraphs of plain text, in columns: ``key, pos, text, block_type, level``."""
    pieces = F.filter(F.transform(F.split(text, separator), strip), lambda s: s != "")
    rows = docs.select(key, F.posexplode(pieces).alias("pos", "text"))
    return rows.withColumn("_b", block_type(F.col("text"), tables=False)).select(key, "pos", "text", F.col("_b.type").alias("block_type"), F.col("_b.level").alias("level"))


class _Blocks(HTMLParser):
    """Headings, paragraphs, lists, tables, quotes and divisions as ranges of the page's texts; nested ones have ranges inside others.

    Every text is kept once.  An element is where it begins and ends among the texts, so reading
    is linear in the page, however deep its elements lie and whatever is never closed.
    """

    KINDS = {**{f"h{i}": ("heading", i) for i in range(1, 7)}, "p": ("paragraph", 1), "ul": ("list", 1), "ol": ("list", 1), "table": ("table", 1), "blockquote": ("quote", 1), "div": ("paragraph", 1)}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.opened: Counter[str] = Counter()
        self.texts: list[str] = []
        self.found: list[list] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style"):
            self.silent += 1
        elif tag in self.KINDS:
            if tag == "p" and self.open and self.open[-1][0] == "p":
                self.handle_endtag("p")
            self.open.append((tag, len(self.found)))
            self.opened[tag] += 1
            self.found.append([len(self.texts), None, *self.KINDS[tag]])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif self.opened[tag]:
            while self.open:
                name, at = self.open.pop()
                self.opened[name] -= 1
                self.found[at][1] = len(self.texts)
                if name == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.silent and self.open:
            self.texts.append(data)


def html_elements(content: str) -> tuple[list[str], list[tuple[int, int, str, int]]]:
    """The texts of a page inside its elements, and (begin, end, kind, level) of every element in page order: its texts are those from begin up to end."""
    parser = _Blocks()
    parser.feed(content)
    parser.close()
    end = len(parser.texts)
    return parser.texts, [(a, end if b is None else b, kind, level) for a, b, kind, level in parser.found]


def html_blocks(content: str) -> list[tuple[str, str, int]]:
    texts, elements = html_elements(content)
    blocks = ((" ".join("".join(texts[a:b]).split()), kind, level) for a, b, kind, level in elements)
    return [b for b in blocks if b[0]]


def parse_html_ranges(docs: DataFrame, key: str, html: str) -> DataFrame:
    """``key, texts, elements`` (begin, end, block_type, level) of every page: what ``parse`` has as repeated texts, each text once.

    The text of an element is ``F.array_join(F.slice("texts", begin + 1, end - begin), "")``; so a page
    of many nested or unclosed elements costs no more than its length.  Null pages have neither.
    """
    kind = docs.schema[key].dataType.simpleString()
    fields = [("begin", pa.int32()), ("end", pa.int32()), ("block_type", pa.string()), ("level", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                read = [html_elements(c or "") for c in part.column(1).to_pylist()]
                elements = [[dict(zip(("begin", "end", "block_type", "level"), e, strict=True)) for e in found] for _, found in read]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in read], pa.list_(pa.string())), pa.array(elements, pa.list_(pa.struct(fields)))], names=[key, "texts", "elements"])

    return docs.select(key, html).mapInArrow(run, f"`{key}` {kind}, texts array<string>, elements array<struct<begin:int,end:int,block_type:string,level:int>>")


def markdown_blocks(content: str) -> list[tuple[str, str, int]]:
    """Headings, lists, tables, quotes and paragraphs, told apart by how their lines begin."""
    out: list[tuple[str, str, int]] = []
    lines: list[str] = []

    def kind_of(line: str) -> str:
        s = line.lstrip()
        if s.startswith(("- ", "* ", "+ ")) or s.split(".")[0].isdigit() and ". " in s[:6]:
            return "list"
        return "table" if s.startswith("|") else "quote" if s.startswith(">") else "paragraph"

    def flush() -> None:
        if lines:
            out.append((" ".join(x.strip() for x in lines), kind_of(lines[0]), 1))
            lines.clear()

    for line in content.split("\n"):
        marks = len(line) - len(line.lstrip("#"))
        if 1 <= marks <= 6 and line[marks : marks + 1] == " ":
            flush()
            out.append((line[marks:].strip(), "heading", marks))
        elif not line.strip():
            flush()
        else:
            if lines and kind_of(line) != kind_of(lines[0]) and kind_of(line) != "paragraph":
                flush()
            lines.append(line)
    flush()
    return out


#: Parsers by file type; a format that needs a library of its own is added here by the user.
PARSERS: dict[str, Parser] = {"html": html_blocks, "markdown": markdown_blocks}


def register_parser(file_type: str, parser: Parser) -> None:
    PARSERS[file_type] = parser


def parse(docs: DataFrame, key: str, content: str, file_type: str) -> DataFrame:
    """Blocks of all documents, by the parser of ``file_type``; plain text needs none."""
    if file_type in ("txt", "text"):
        return parse_text(docs, key, content)
    if file_type not in PARSERS:
        raise ValueError(f"no parser for {file_type}: register one")
    parser, kind = PARSERS[file_type], docs.schema[key].dataType.simpleString()
    fields = pa.schema([("pos", pa.int32()), ("text", pa.string()), ("block_type", pa.string()), ("level", pa.int32())])

    def packed(batch: pa.RecordBatch, at: list[int], rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *pa.RecordBatch.from_pylist(rows, schema=fields).columns], names=[key, *fields.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, size = [], [], 0
            contents = batch.column(1)
            for i in range(batch.num_rows):
                blocks = parser(contents[i].as_py() or "")
                at += [i] * len(blocks)
                rows += [{"pos": k, "text": t, "block_type": kind_, "level": level} for k, (t, kind_, level) in enumerate(blocks)]
                size += sum(len(t) for t, _, _ in blocks)
                if rows and (size > BATCH_CHARS or i == batch.num_rows - 1):
                    yield packed(batch, at, rows)
                    at, rows, size = [], [], 0
            if rows:
                yield packed(batch, at, rows)

    return docs.select(key, content).mapInArrow(run, f"`{key}` {kind}, pos int, text string, block_type string, level int")


def read_binary_files(spark, path: str) -> DataFrame:
    """Files with path, checksum and content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("checksum"), "content")


def choose_source(rich: Column, url: Column) -> Column:
    """``{kind, value}``: rich content if there is any, else the url, else null."""
    given = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(None))
    both = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
    return F.when(given(rich).isNotNull(), both("rich_content", rich)).when(given(url).isNotNull(), both("file_url", url))


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, title, links``."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    links = F.regexp_extract_all(html, F.lit(r'(?i)<a[^>]*\shref="([^"]*)"'), F.lit(1))
    return pages.select(key, title.alias("title"), links.alias("links"))


def html_text(c: Column) -> Column:
    """Text without scripts, styles and tags; lines stripped, blank ones dropped."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", ""), r"<[^>]+>", "")
    pieces = F.flatten(F.transform(F.split(bare, "\n"), lambda x: F.split(strip(x), "  ")))
    return F.array_join(F.filter(F.transform(pieces, strip), lambda s: s != ""), "\n")


def read_segments(docs: DataFrame, key: str, json: str) -> DataFrame:
    """Rows of a JSON list of segments {id, order_index, text, page}; broken JSON gives none."""
    schema = "array<struct<id:string,order_index:int,text:string,page:int>>"
    return docs.select(key, F.inline(F.coalesce(F.from_json(json, schema), F.array().cast(schema))))
