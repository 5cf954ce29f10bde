"""Wiki links: scanning, parsing and classifying."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A link doesn't cross lines, and a second "[[" starts it anew.
LINK = re.compile(r"!?\[\[((?:(?!\[\[|\]\])[^\n])*)\]\]")
LINK_TYPE = "array<struct<raw:string,inner:string,line:int,column:int,embed:boolean>>"


def scan(text: str | None) -> list[tuple[str, str, int, int, bool]]:
    """(raw, inner, line, column in UTF-8 bytes, whether it embeds), lines and columns from 0."""
    found, line, begun = [], 0, 0
    for m in LINK.finditer(text or ""):
        if not m[1].split("|")[0].split("#")[0].strip() and "#" not in m[1].split("|")[0]:
            continue
        line += text.count("\n", begun, m.start())
        begun = m.start()
        column = len(text[text.rfind("\n", 0, m.start()) + 1 : m.start()].encode())
        found.append((m[0], m[1], line, column, m[0].startswith("!")))
    return found


def scanned(text: Column) -> Column:
    """An array of links, from Arrow batches."""

    @F.pandas_udf(LINK_TYPE)
    def scans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[dict(zip(("raw", "inner", "line", "column", "embed"), x)) for x in scan(t)] for t in batch])

    return scans(text)


def parsed(inner: Column) -> dict[str, Column]:
    """target, heading, block_ref and display of what stands between the brackets."""
    left = F.substring_index(inner, "|", 1)
    display = F.when(F.instr(inner, "|") > 0, F.trim(F.substr(inner, F.instr(inner, "|") + 1)))
    behind = F.when(F.instr(left, "#") > 0, F.substr(left, F.instr(left, "#") + 1))
    ref = behind.startswith("^")
    return {
        "target": F.trim(F.substring_index(left, "#", 1)),
        "heading": F.when(~ref & (F.trim(behind) != ""), F.trim(behind)),
        "block_ref": F.when(ref, F.trim(F.substr(behind, F.lit(2)))),
        "display": display,
    }


def link_type(embed: Column, block_ref: Column, heading: Column) -> Column:
    kind = F.when(embed, "embed").otherwise("wiki")
    tail = F.when(block_ref.isNotNull(), "_block").when(heading.isNotNull(), "_heading").otherwise("")
    return F.concat(kind, tail)


def links_of(docs: DataFrame, id_col: str = "path", text: str = "content") -> DataFrame:
    """A row for each link of each document."""
    found = docs.select(F.col(id_col).alias("source"), scanned(F.col(text)).alias("found")).select("source", F.inline("found"))
    named = found.withColumns(parsed(F.col("inner")))
    return named.withColumn("link_type", link_type(F.col("embed"), F.col("block_ref"), F.col("heading"))).drop("inner")


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'<a href="([^"]*)"'), F.lit(1))
