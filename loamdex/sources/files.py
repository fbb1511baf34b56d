"""Readers and writers of document files: office formats, books, PDF text layers, JSON lines, tables.

Office files are read from ``binaryFile`` rows (path, content) by mapInPandas, a file at a time, so a task holds one file's
text.  What can't be read gives one row with its failure and no text.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, page int, text string, failure string"
CASES = "id string, slice string, query string, lang string, relevant map<string,int>, none boolean"


def _parts(xml: bytes, tag: str) -> Iterator[ElementTree.Element]:
    return (e for e in ElementTree.fromstring(xml).iter() if e.tag.rpartition("}")[2] == tag)


def _said(e: ElementTree.Element, tag: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if x.tag.rpartition("}")[2] == tag)


def docx(data: bytes) -> list[str]:
    """A Word file as one page: its paragraphs, line by line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ["\n".join(p for p in map(_said, _parts(z.read("word/document.xml"), "p")) if p)]


def xlsx(data: bytes) -> list[str]:
    """Each sheet as a page: its heading, then the cells that are not blank of each row, joined by bars."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [_said(s) for s in _parts(z.read("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") or "" for s in _parts(z.read("xl/workbook.xml"), "sheet")]
        out = []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for title, name in zip(titles, sheets):
            lines = [f"Sheet: {title}"]
            for row in _parts(z.read(name), "row"):
                cells = []
                for c in (x for x in row if x.tag.rpartition("}")[2] == "c"):
                    value = _said(c, "v") or _said(c)
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                if line := " | ".join(c for c in cells if c.strip()):
                    lines.append(line)
            out.append("\n".join(lines))
        return out


def epub(data: bytes) -> list[str]:
    """The chapters of a book in the order of its spine, without markup."""
    import html

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = next(r.get("full-path") for r in _parts(z.read("META-INF/container.xml"), "rootfile"))
        package = z.read(root)
        files = {i.get("id"): i.get("href") for i in _parts(package, "item")}
        base = root.rpartition("/")[0]
        out = []
        for ref in _parts(package, "itemref"):
            name = files.get(ref.get("idref"))
            if name is None:
                continue
            page = z.read(f"{base}/{name}" if base else name).decode("utf-8", "replace")
            page = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>", " ", page)
            out.append(" ".join(html.unescape(re.sub(r"(?s)<[^>]*>", " ", page)).split()))
        return out


_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)\s*Tj|\[(?:\\.|[^\\\]])*\]\s*TJ|T\*|Td|TD|'", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)


def pdf(data: bytes) -> list[str]:
    """The text layer of a simple PDF, a page per content stream; fonts with own encodings are not resolved."""
    out = []
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[2]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        said = []
        for s in _SHOWN.finditer(body):
            strings = _STRING.findall(s[0])
            said.append("".join(re.sub(rb"\\([()\\])", rb"\1", x).decode("latin-1") for x in strings) if strings else "\n")
        out.append(re.sub(r"\n+", "\n", "".join(said)).strip())
    if not out:
        raise ValueError("the PDF has no text layer")
    return out


READERS: dict[str, Callable[[bytes], list[str]]] = {"docx": docx, "xlsx": xlsx, "epub": epub, "pdf": pdf}


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            reader = READERS.get(path.rpartition(".")[2].lower())
            try:
                if reader is None:
                    raise ValueError("unknown format")
                pages = reader(bytes(content))
                yield pd.DataFrame({"path": path, "page": range(len(pages)), "text": pages, "failure": None})
            except Exception as e:  # noqa: BLE001  a broken file is a result
                yield pd.DataFrame({"path": [path], "page": [0], "text": [None], "failure": [f"{type(e).__name__}: {e}"]})


def pages_of(files: DataFrame) -> DataFrame:
    """(path, page, text, failure) of rows (path, content)."""
    return files.select("path", "content").mapInPandas(_read, SCHEMA)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All office files of a folder, recursively."""
    return pages_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,xlsx,epub,pdf}").load(folder))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Graded search cases from JSON lines, with a declared schema."""
    return spark.read.schema(CASES).json(path)


CORPUS = "id string, kind string, lang string, pages array<string>, facts map<string,string>"


def load_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A corpus of JSON lines as the tables that searches run on: items, pages (from 1) and facts."""
    rows = spark.read.schema(CORPUS).json(path)
    return {
        "items": rows.select("id", "kind", "lang"),
        "pages": rows.select("id", F.posexplode("pages").alias("page", "text")).withColumn("page", F.col("page") + 1),
        "facts": rows.select("id", F.explode("facts").alias("kind", "value")),
    }


def read_truth(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated ground truth with a heading line."""
    return spark.read.schema(schema).option("sep", "\t").option("header", "true").csv(path)


def write_report(df: DataFrame, folder: str) -> dict[str, str]:
    """K7: a report as JSON lines, as CSV and as the rows of a Markdown table under its head; the folders written."""
    out = {"json": f"{folder}/json", "csv": f"{folder}/csv", "md": f"{folder}/md"}
    df.write.mode("overwrite").json(out["json"])
    df.write.mode("overwrite").option("header", "true").csv(out["csv"])
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\\|\|", r"\\$0"), r"\s*\n\s*", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, f"| {' | '.join(df.columns)} |"), (1, "|" + "-|" * len(df.columns))], "n int, value string")
    rows = head.unionByName(df.select(F.lit(2).alias("n"), line.alias("value")))
    rows.repartitionByRange(1, "n").sortWithinPartitions("n", "value").select("value").write.mode("overwrite").text(out["md"])  # a report is read by people
    return out


def made_docx(paragraphs: list[str]) -> bytes:
    """A Word file that ``docx`` reads."""
    from xml.sax.saxutils import escape

    clean = (re.sub(r"[^\t\n\r -퟿-�\U00010000-\U0010ffff]", "", p) for p in paragraphs)
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in clean)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return buffer.getvalue()


def packed_docx(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(path, content): one Word file per key, its texts in order."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": [f"{k}.docx" for k in b["k"]], "content": [made_docx(list(t)) for t in b["t"]]})

    grouped = df.groupBy(F.col(key).alias("k")).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("s")).select("k", F.transform("s", lambda x: x[text]).alias("t"))
    return grouped.mapInPandas(pack, "path string, content binary")


def _zipped(parts: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return buffer.getvalue()


def made_xlsx(title: str, rows: list[tuple[int, str]]) -> bytes:
    """A workbook that ``xlsx`` reads: a sheet of (number, name) under a heading, and a sheet with the title."""
    from xml.sax.saxutils import escape

    names = ["key", "name", *[n for _, n in rows]]
    shared = "".join(f"<si><t>{escape(n)}</t></si>" for n in names)
    cell = lambda i: f'<c t="s"><v>{i}</v></c>'
    body = f"<row>{cell(0)}<c/>{cell(1)}</row>" + "".join(f"<row><c><v>{k}</v></c><c t='inlineStr'><is><t> </t></is></c>{cell(i + 2)}</row>" for i, (k, _) in enumerate(rows)) + "<row><c/></row>"
    sheet = "<worksheet><sheetData>{}</sheetData></worksheet>".format
    return _zipped(
        {
            "xl/workbook.xml": "<workbook><sheets><sheet name='Nations'/><sheet name='Region'/></sheets></workbook>",
            "xl/sharedStrings.xml": f"<sst>{shared}</sst>",
            "xl/worksheets/sheet1.xml": sheet(body),
            "xl/worksheets/sheet2.xml": sheet(f"<row><c t='inlineStr'><is><t>{escape(title)}</t></is></c></row>"),
        }
    )


def made_epub(chapters: list[tuple[int, str]]) -> bytes:
    """A book that ``epub`` reads; its spine puts the chapters in falling order."""
    from xml.sax.saxutils import escape

    page = lambda k, name: f"<html><head><title>no</title></head><body><script>no()</script><h1>{escape(name)}</h1> &amp; its people,\n <p>no {k}</p></body></html>"
    items = "".join(f'<item id="c{k}" href="t/c{k}.xhtml"/>' for k, _ in chapters)
    spine = "".join(f'<itemref idref="c{k}"/>' for k, _ in sorted(chapters, reverse=True)) + '<itemref idref="none"/>'
    parts = {"META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/book.opf"/></rootfiles></container>', "o/book.opf": f"<package><manifest>{items}</manifest><spine>{spine}</spine></package>"}
    return _zipped(parts | {f"o/t/c{k}.xhtml": page(k, name) for k, name in chapters})


def _packed(df: DataFrame, key: str, number: str, name: str, ending: str, made: Callable) -> DataFrame:
    """(path, content): one file per key, of its (number, name) rows in order; a file's rows are one task's."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": [f"{k}.{ending}" for k in b["k"]], "content": [made(k, [(int(x["n"]), x["s"]) for x in rows]) for k, rows in zip(b["k"], b["rows"])]})

    one = F.struct(F.col(number).cast("long").alias("n"), F.col(name).alias("s"))
    return df.groupBy(F.col(key).alias("k")).agg(F.array_sort(F.collect_list(one)).alias("rows")).mapInPandas(pack, "path string, content binary")


def packed_xlsx(df: DataFrame, key: str, number: str, name: str) -> DataFrame:
    return _packed(df, key, number, name, "xlsx", made_xlsx)


def packed_epub(df: DataFrame, key: str, number: str, name: str) -> DataFrame:
    return _packed(df, key, number, name, "epub", lambda _, rows: made_epub(rows))


def made_pdf(lines: list[str]) -> bytes:
    """A one-page PDF with a compressed text layer that ``pdf`` reads."""
    said = b" T* ".join(b"(" + re.sub(rb"([()\\])", rb"\\\1", line.encode("latin-1", "replace")) + b") Tj" for line in lines)
    body = zlib.compress(b"BT /F1 12 Tf " + said + b" ET")
    return b"%PDF-1.4\n4 0 obj\n<< /Filter /FlateDecode /Length " + str(len(body)).encode() + b" >>\nstream\n" + body + b"\nendstream\nendobj\n%%EOF"


def packed_pdf(df: DataFrame, key: str, lines: str) -> DataFrame:
    """(path, content): one PDF per row, its lines an array."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": [f"{k}.pdf" for k in b["k"]], "content": [made_pdf(list(t)) for t in b["t"]]})

    return df.select(F.col(key).alias("k"), F.col(lines).alias("t")).mapInPandas(pack, "path string, content binary")
