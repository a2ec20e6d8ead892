"""TEI editions: the text of the body's paragraphs and verse lines.

Spark reads the files whole and deals them out; each is read by a parser of XML, so that references, CDATA sections, comments,
nested elements and encodings are what XML says they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _name(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def body_text(xml: str | bytes) -> str:
    """The first body that stands directly in a text: its paragraphs, nested ones too, but for those with a head label as a direct
    child, then its verse lines; each trimmed, empty ones left out, joined by a space. Any namespace."""
    root = ElementTree.fromstring(xml)
    body = next((child for text in root.iter() if _name(text) == "text" for child in text if _name(child) == "body"), None)
    if body is None:
        return ""
    headed = lambda p: any(_name(x) == "label" and x.get("type") == "head" for x in p)
    inside = [x for x in body.iter() if x is not body]
    own = [x for x in inside if _name(x) == "p" and not headed(x)] + [x for x in inside if _name(x) == "l"]
    texts = ("".join(x.itertext()).strip() for x in own)
    return " ".join(x for x in texts if x)


def _read(xml: str | bytes | None) -> tuple[str | None, str | None]:
    if xml is None:
        return None, None
    try:
        return body_text(xml), None
    except (ElementTree.ParseError, ValueError, LookupError) as problem:  # LookupError: an encoding that isn't known
        return None, str(problem)


def tei_text(xml: Column) -> Column:
    """struct(text, problem) of a string or binary column: what keeps the document from being XML, or its text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_read(bytes(x) if isinstance(x, bytearray | memoryview) else x) for x in batch], columns=["text", "problem"])

    return F.pandas_udf(run, "text string, problem string")(xml)  # type: ignore[call-overload]



def read_tei(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """file, text, problem of all files of a folder; a file that isn't XML keeps its row, with the parser's problem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), tei_text(F.col("content")).alias("t")).select("file", "t.text", "t.problem")
