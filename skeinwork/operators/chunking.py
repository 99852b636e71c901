"""Splitting documents into chunks."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import text as T
from skeinwork.operators.ranges import running

SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters (longer only where nothing separates), neighbours sharing up to `overlap`.

    The first separator found in the text cuts it; small cuts are merged greedily, large ones are cut by
    the next separator. Pieces are stripped, empty ones dropped. The rules, merging included, are those of
    the widely used recursive character splitter, whose results have to be met.
    """
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    out: list[str] = []
    small: list[str] = []
    for part in list(text) if sep == "" else [p for p in text.split(sep) if p]:
        if len(part) < size:
            small.append(part)
            continue
        out += _merge(small, sep, size, overlap)
        small = []
        out += split_text(part, size, overlap, finer) if finer else [part]
    return out + _merge(small, sep, size, overlap)


def _merge(parts: list[str], sep: str, size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    total = 0
    for part in parts:
        gap = len(sep) if held else 0
        if held and total + gap + len(part) > size:
            if piece := sep.join(held).strip():
                out.append(piece)
            while held and (total > overlap or total + len(sep) + len(part) > size):
                total -= len(held[0]) + (len(sep) if len(held) > 1 else 0)
                held.pop(0)
        total += len(part) + (len(sep) if held else 0)
        held.append(part)
    if piece := sep.join(held).strip():
        out.append(piece)
    return out


def split_documents(docs: DataFrame, key: str, text: str, title: str | None = None, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Raw chunks id, title, content, contents of documents; ids are key and ordinal, content single-spaced."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text((t or "").strip(), size, overlap))

    heading = F.col(title) if title else F.lit("")
    pieces = docs.select(F.col(key).alias("key"), heading.alias("title"), F.posexplode(split(text)).alias("n", "piece"))
    content = T.collapse_space(F.col("piece"))
    return pieces.select(F.concat_ws("_", "key", "n").alias("id"), "title", content.alias("content"), T.join_title(F.col("title"), content).alias("contents"))


def normalize(raw: DataFrame, source_type: str, separator: str = " -- ", keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunk records from raw chunks (id, title, content, contents), and columns to keep; a null id is an error when the row is read."""
    title, content = F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))
    contents = F.coalesce(F.nullif("contents", F.lit("")), F.concat(title, F.lit(". "), content))
    parts = T.split_title(title, separator) if source_type == "statpearls" else F.struct(title.alias("document"), F.lit(None).cast("string").alias("section"))
    return raw.select(
        F.coalesce("id", F.raise_error(F.lit("a chunk has no id"))).alias("chunk_id"),
        T.drop_reference_marks(contents).alias("text"),
        F.lit(source_type).alias("source_type"),
        parts["document"].alias("document"),
        parts["section"].alias("section"),
        T.token_estimate(contents).alias("token_estimate"),
        *keep,
    )


def _flat(node: ET.Element) -> str:
    """All text of an element in order, pieces stripped and joined by a space."""
    pieces = [(node.text or "").strip()]
    for child in node:
        pieces += [_flat(child), (child.tail or "").strip()]
    return " ".join(p for p in pieces if p)


def _heading(node: ET.Element) -> bool:
    children = list(node)
    return node.tag == "p" and len(children) == 1 and children[0].tag == "bold" and not (children[0].tail or "").strip()


def article_sections(xml: str, name: str, short: int = 200, most: int = 1000) -> list[dict[str, str]]:
    """Chunks of a sectioned article: title -- section [-- heading] as title.

    Within a section a paragraph under `short` characters joins the chunk before it, a list does so
    too, if the result stays under `most`; a longer list is a chunk an item. Sections without a title
    are skipped.
    """
    root = ET.fromstring(xml)
    head = root.find(".//title")
    title = (head.text or "").strip() if head is not None else ""
    out: list[dict[str, str]] = []
    for section in root.iter("sec"):
        named = section.find("./title")
        if named is None or not (named.text or "").strip():
            continue
        base = [title, named.text.strip()]
        path, open_chunk, after_heading = list(base), None, False
        for node in section:
            if _heading(node):
                path, open_chunk, after_heading = [*base, _flat(node)], None, True
                continue
            if node.tag == "p":
                said = _flat(node)
                joins = open_chunk is not None and len(said) < short and len(open_chunk["content"]) + len(said) < most
                pieces = [said]
            elif node.tag == "list":
                items = [_flat(item) for item in node]
                said = " ".join(items)
                joins = open_chunk is not None and len(said) + len(open_chunk["content"]) < most
                pieces = [said] if len(said) < most else items
            else:
                after_heading = False
                continue
            if joins:
                open_chunk["content"] += f" {said}"
            else:
                made = [{"id": "", "title": " -- ".join(path), "content": p} for p in pieces]
                out += made
                open_chunk = made[0] if len(pieces) == 1 and said is pieces[0] else None
            if node.tag == "list" and after_heading:
                path = list(base)
            after_heading = False
    for i, chunk in enumerate(out):
        chunk["id"] = f"{name}_{i}"
        mark = " " if chunk["title"][-1:] in tuple(".?!") else ". "
        chunk["contents"] = f"{chunk['title'].strip()}{mark}{chunk['content'].strip()}"
    return out


def article_chunks(files: DataFrame) -> DataFrame:
    """Raw chunks of sectioned articles; files: name, xml."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [c for name, xml in zip(pdf["name"], pdf["xml"]) for c in article_sections(xml, name)]
            yield pd.DataFrame(rows, columns=["id", "title", "content", "contents"])

    return files.select("name", "xml").mapInPandas(run, "id string, title string, content string, contents string")


_CITED = re.compile(r"<PMID[^>]*>([^<]*)|(<Article[ >].*?</Article>)", re.DOTALL)


def citation_records(xml: str) -> list[tuple[str, str, str]]:
    """(id, title, abstract) of the articles of a citation file; those without abstract are dropped, several abstract parts joined."""
    out = []
    pmid = ""  # the last one before the article, however far up; one pass over the file
    for m in _CITED.finditer(xml):
        if m[2] is None:
            pmid = m[1].strip()
            continue
        title = re.search(r"<ArticleTitle[^>]*>(.*?)</ArticleTitle>", m[2], re.DOTALL)
        abstract = " ".join(re.findall(r"<AbstractText[^>]*>(.*?)</AbstractText>", m[2], re.DOTALL))
        if abstract.strip():
            out.append((pmid, title[1] if title else "", abstract))
    return out


def citation_chunks(files: DataFrame) -> DataFrame:
    """Raw chunks of citation files; files: xml, a record a row (sources.tables.read_xml_records) or a whole file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([r for xml in pdf["xml"] for r in citation_records(xml)], columns=["pmid", "title", "content"])

    rows = files.select("xml").mapInPandas(run, "pmid string, title string, content string")
    return rows.select(F.concat(F.lit("PMID:"), "pmid").alias("id"), "title", "content", T.join_title(F.col("title"), F.col("content")).alias("contents"))


def batch_number(df: DataFrame, order: str, size: int = 10_000) -> DataFrame:
    """df with `batch`, rows numbered by the numeric column `order` in runs of `size`."""
    numbered = running(df.withColumn("__one", F.lit(1)), order, __at="__one")
    return numbered.withColumn("batch", F.floor((F.col("__at") - 1) / size)).drop("__one", "__at")
