"""Markdown documents: front matter, blocks, titles, outlines, sections and anchors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)")
_ITEM = re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_TABLE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_NOTE = re.compile(r" {0,3}\[\^[^\]]+\]:")
_HTML = re.compile(r" {0,3}<(?:[A-Za-z/!?])")
_UNDER = re.compile(r" {0,3}(=+|-+)[ \t]*$")

BLOCK = "array<struct<block_type:string,level:int,content:string,content_hash:string,line:int,order_index:int,user_ref:string>>"


def front_matter(text: str) -> tuple[str | None, str, int]:
    """Front matter, body, and the number of lines before the body."""
    plain = text.lstrip("﻿")
    m = re.match(r"---\n(.*?)\n---(?:\n|(?!.*\n---\n))", plain, re.S) if plain.startswith("---\n") else None
    if m is None:
        return None, plain, 0
    return m[1], plain[m.end() :], plain.count("\n", 0, m.end())


def _kind(lines: list[str], at: int) -> str:
    line = lines[at]
    if _FENCE.match(line):
        return "code"
    if _HEADING.match(line):
        return "heading"
    if _RULE.match(line):
        return "rule"
    if line.lstrip().startswith(">") and len(line) - len(line.lstrip()) < 4:
        return "quote"
    if _ITEM.match(line):
        return "list"
    if _NOTE.match(line):
        return "footnote"
    if line.startswith("    ") or line.startswith("\t"):
        return "code"
    if _HTML.match(line):
        return "html"
    if "|" in line and at + 1 < len(lines) and "-" in lines[at + 1] and _TABLE.match(lines[at + 1]):
        return "table"
    return "paragraph"


def anchor(content: str) -> str | None:
    last = content.splitlines()[-1].strip() if content.strip() else ""
    m = re.fullmatch(r"\^\s*([A-Za-z0-9_-]+)", last)
    return m[1] if m else None


def blocks(body: str) -> list[dict]:
    """Top-level blocks in order, with lines from 0."""
    return list(walked(body))


def walked(body: str) -> Iterator[dict]:
    """``blocks`` one after another, so that who looks for the first of a kind needn't read the rest."""
    lines, at, n = body.split("\n"), 0, 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        kind, start, level = _kind(lines, at), at, 0
        at += 1
        if kind == "heading":
            level = len(_HEADING.match(lines[start])[1])
        elif kind == "code" and (fence := _FENCE.match(lines[start])):
            close = re.compile(r" {0,3}" + re.escape(fence[1][0]) + "{" + str(len(fence[1])) + r",}[ \t]*$")
            while at < len(lines) and not close.match(lines[at]):
                at += 1
            at += 1
        elif kind == "code":
            while at < len(lines) and (not lines[at].strip() or lines[at].startswith(("    ", "\t"))):
                at += 1
        elif kind in ("list", "footnote"):
            while at < len(lines):
                if not lines[at].strip():
                    # A blank line ends a list unless an item or an indented line follows.
                    after = next((k for k in range(at, len(lines)) if lines[k].strip()), None)
                    if after is None or not (lines[after].startswith((" ", "\t")) or kind == "list" and _kind(lines, after) == "list"):
                        break
                    at = after
                elif not lines[at].startswith((" ", "\t")) and _kind(lines, at) not in ("paragraph", "list" if kind == "list" else "paragraph"):
                    break
                else:
                    at += 1
        elif kind != "rule":
            while at < len(lines) and lines[at].strip():
                under = _UNDER.match(lines[at]) if kind == "paragraph" else None
                if under:
                    kind, level, at = "heading", 1 if under[1][0] == "=" else 2, at + 1
                    break
                following = _kind(lines, at)
                if kind == "paragraph" and following in ("heading", "quote", "list", "rule", "html") or following == "code" and _FENCE.match(lines[at]) or kind == "quote" and following in ("heading", "list", "rule"):
                    break
                at += 1
        if kind == "rule":
            continue
        content = "\n".join(lines[start:at]).rstrip("\r\n")
        yield {"block_type": kind, "level": level, "content": content, "content_hash": hashlib.sha256(content.encode()).hexdigest(), "line": start, "order_index": n, "user_ref": anchor(content)}
        n += 1


def heading_text(content: str) -> str:
    return content.split("\n")[0].lstrip("#").strip()


def title(text: str, stem: str, found: list[dict] | None = None) -> str:
    """Front matter's title, else the first heading of level 1, else the file's stem; ``found``: the blocks, if they are known."""
    matter, body, _ = front_matter(text)
    for line in (matter or "").splitlines():
        if line.startswith("title:") and (named := line[6:].strip().strip("\"'")):
            return named
    return next((heading_text(b["content"]) for b in (walked(body) if found is None else found) if b["block_type"] == "heading" and b["level"] == 1), stem)


#: A word with a letter or digit.
_WORD = re.compile(r"\S*\w\S*")


def visible_words(body: str, found: list[dict] | None = None) -> int:
    """Words that a reader sees: markers of blocks and emphasis don't count; ``found``: the blocks, if they are known."""
    n = 0
    for b in blocks(body) if found is None else found:
        lines = b["content"].split("\n")
        if b["block_type"] == "code":
            lines = lines[1:-1] if _FENCE.match(lines[0]) else lines
        for line in lines:
            line = re.sub(r"^\s*(?:>\s*|#{1,6}\s+|(?:[-*+]|\d+[.)])\s+(?:\[[ xX]\]\s+)?)*", "", line) if b["block_type"] != "code" else line
            line = re.sub(r"!?\[([^\]\[]*)\]\([^)]*\)", r"\1", line)
            n += len(_WORD.findall(re.sub(r"[*_`|~]+", " " if b["block_type"] == "table" else "", line)))
    return n


def outline(text: str) -> list[tuple[int, str, int]]:
    _, body, _ = front_matter(text)
    return [(b["level"], heading_text(b["content"]), b["line"]) for b in blocks(body) if b["block_type"] == "heading"]


def section(text: str, heading: str) -> str | None:
    """From a heading to the next one of its level or above."""
    _, body, _ = front_matter(text)
    heads = [b for b in blocks(body) if b["block_type"] == "heading"]
    at = next((k for k, b in enumerate(heads) if heading_text(b["content"]).lower() == heading.strip().lower()), None)
    if at is None:
        return None
    stop = next((b["line"] for b in heads[at + 1 :] if b["level"] <= heads[at]["level"]), None)
    return "\n".join(body.split("\n")[heads[at]["line"] : stop]).rstrip()


def embedded(text: str, heading: str | None = None, block_ref: str | None = None) -> str | None:
    """What an embed shows: the block of an anchor, else a section, else the whole body."""
    _, body, _ = front_matter(text)
    if block_ref is not None:
        return next((b["content"] for b in blocks(body) if b["user_ref"] == block_ref.strip()), None)
    return section(text, heading) if heading is not None else body


def stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


def documents(files: DataFrame) -> DataFrame:
    """files (path, content) to id, path, title, content_hash, words, frontmatter and blocks; lines are the file's."""
    return _read(files, True)


def facts(files: DataFrame) -> DataFrame:
    """``documents`` without their blocks, which needn't leave Python then."""
    return _read(files, False)


def titles(files: DataFrame) -> DataFrame:
    """path, title: a file is read up to what names it."""

    @F.pandas_udf("string")
    def named(path: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([title(c or "", stem(p)) for p, c in zip(path, content)], dtype=object)

    return files.select("path", named("path", "content").alias("title"))


def _read(files: DataFrame, whole: bool) -> DataFrame:
    names = ["id", "path", "title", "content_hash", "size_bytes", "word_count", "frontmatter", "blocks"]
    names = names if whole else names[:-1]

    def each(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                text = content or ""
                matter, body, before = front_matter(text)
                found = blocks(body)
                made = (hashlib.sha256(path.encode()).hexdigest(), path, title(text, stem(path), found), hashlib.sha256(text.encode()).hexdigest(), len(text.encode()), visible_words(body, found), matter)
                rows.append((*made, [b | {"line": b["line"] + before} for b in found]) if whole else made)
            yield pd.DataFrame(rows, columns=names)

    kind = "id string, path string, title string, content_hash string, size_bytes long, word_count long, frontmatter string"
    return files.select("path", "content").mapInPandas(each, f"{kind}, blocks {BLOCK}" if whole else kind)


def block_rows(docs: DataFrame) -> DataFrame:
    """A row for each block, with an identifier that repeats and its file's path (source)."""
    made = docs.select(F.col("id").alias("file_id"), F.col("path").alias("source"), F.inline("blocks"))
    return made.withColumn("block_id", F.sha2(F.concat_ws("|", "file_id", F.col("order_index").cast("string")), 256))


def sections(blocks: DataFrame) -> DataFrame:
    """file_id, heading, level, line, stop of each heading's section: up to the next heading of its level or above (null at
    the end).  A file's headings are gathered; each looks only at those behind it."""
    heads = blocks.where("block_type = 'heading'").select("file_id", F.struct("order_index", "line", "level", F.trim(F.regexp_replace(F.element_at(F.split("content", "\n"), 1), "^#+", "")).alias("heading")).alias("h"))
    gathered = heads.groupBy("file_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    opened = gathered.select("file_id", "hs", F.explode("hs").alias("h"))
    behind = F.filter("hs", lambda o: (o["order_index"] > F.col("h.order_index")) & (o["level"] <= F.col("h.level")))
    return opened.select("file_id", "h.heading", "h.level", "h.line", F.get(behind, F.lit(0))["line"].alias("stop"))


def shown(rows: DataFrame, content: str = "content", heading: str = "heading", block_ref: str = "block_ref") -> DataFrame:
    """rows with shown: what an embed of a text shows, by its heading or anchor."""

    @F.pandas_udf("string")
    def show(text: pd.Series, head: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else embedded(t, h, r) for t, h, r in zip(text, head, ref)])

    return rows.withColumn("shown", show(F.col(content), F.col(heading), F.col(block_ref)))
