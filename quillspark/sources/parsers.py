"""Files to sections: PDF, PPTX, text and Markdown, routed by extension."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.segment import sections_markdown, sections_txt

SUPPORTED = ("pdf", "txt", "md", "pptx")
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_SECTIONS = "source_file string, heading string, page_or_slide int, content string"


def _paragraphs(node: ET.Element) -> str:
    lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in node.iter(f"{_A}p")]
    return "\n".join(lines).strip()


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = part.rsplit("/", 1)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    out = {}
    for r in ET.fromstring(z.read(rels)):
        path: list[str] = [] if r.get("Target", "").startswith("/") else folder.split("/")
        for step in r.get("Target", "").strip("/").split("/"):
            path = path[:-1] if step == ".." else [*path, step]
        out[r.get("Id", "")] = "/".join(path)
    return out


def slides(data: bytes, tables: bool = True) -> Iterator[tuple[str, int, str]]:
    """(heading, slide, text) of a PPTX file with the standard library: title, text frames, tables and speaker notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        rels = _targets(z, "ppt/presentation.xml")
        order = [rels[s.get(f"{_R}id")] for s in ET.fromstring(z.read("ppt/presentation.xml")).iter(f"{_P}sldId")]
        for no, part in enumerate(order, 1):
            title, body = "", []
            root = ET.fromstring(z.read(part))
            for shape in root.iter():
                if shape.tag == f"{_P}sp":
                    kind = shape.find(f".//{_P}nvPr/{_P}ph")
                    frame = shape.find(f"{_P}txBody")
                    text = _paragraphs(frame) if frame is not None else ""
                    if kind is not None and kind.get("type") in ("title", "ctrTitle"):
                        title = title or text
                    elif text:
                        body.append(text)
                elif tables and shape.tag == f"{_A}tbl":
                    body += [" | ".join(_paragraphs(c) for c in row.iter(f"{_A}tc")) for row in shape.iter(f"{_A}tr")]
            notes = next((p for p in _targets(z, part).values() if "/notesSlides/" in p), None)
            said = ""
            if notes:
                for shape in ET.fromstring(z.read(notes)).iter(f"{_P}sp"):
                    kind = shape.find(f".//{_P}nvPr/{_P}ph")
                    if kind is not None and kind.get("type") == "body":
                        said = _paragraphs(shape)
            text = "\n".join(body) + (f"\n[Speaker Notes]: {said}" if said else "")
            if text.strip():
                yield title or f"Slide {no}", no, text


def pages(data: bytes) -> Iterator[tuple[str, int, str]]:
    """(heading, page, text) of a PDF file's pages with text."""
    try:
        from PyPDF2 import PdfReader
    except ImportError as e:
        raise ImportError("reading PDF files needs PyPDF2") from e
    for no, page in enumerate(PdfReader(io.BytesIO(data)).pages, 1):
        if text := (page.extract_text() or "").strip():
            yield f"Page {no}", no, text


def _binary(files: DataFrame, parse) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["name"], pdf["content"]):
                yield pd.DataFrame([(name, h, n, t) for h, n, t in parse(bytes(data))], columns=["source_file", "heading", "page_or_slide", "content"])

    return files.select("name", "content").mapInPandas(run, _SECTIONS)


def parse_files(files: DataFrame) -> DataFrame:
    """(source_file, heading, page_or_slide, content) of files (name, content binary); an unknown extension is an error."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    known = F.when(ext.isin(*SUPPORTED), ext).otherwise(F.raise_error(F.concat(F.lit("Unsupported file type: ."), ext)).cast("string"))
    files = files.withColumn("__ext", known)
    # bytes that aren't UTF-8 are replaced, so that one file doesn't stop the others
    text = files.where(F.col("__ext").isin("txt", "md")).withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
    out = sections_txt(text.where("__ext = 'txt'")).unionByName(sections_markdown(text.where("__ext = 'md'")))
    for kind, parse in (("pptx", slides), ("pdf", pages)):
        out = out.unionByName(_binary(files.where(F.col("__ext") == kind), parse))
    return out


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the files in a folder, by name."""
    return spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content").orderBy("name")
