"""Commands by name: one dispatcher over DataFrames, and a registry of tools with their parameters."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import markdown
from ..functions import text as T
from ..operators import fulltext, graph, links, mutations, vector
from ..sources import files as sources


def clamped(value: int | None, default: int, low: int, high: int) -> int:
    return max(low, min(high, default if value is None else int(value)))


def substituted(template: str, values: dict[str, str]) -> str:
    """{{name}} by its value; unknown names stay."""
    return re.sub(r"\{\{\s*([^{}]+?)\s*\}\}", lambda m: str(values.get(m[1], m[0])), template)


def filled(template: Column, values: dict[str, Column]) -> Column:
    """``substituted`` as a column: each known name by its value (which isn't looked at again), unknown ones left."""
    parts = F.regexp_extract_all(template, F.lit(r"(?s)(.*?)(?:\{\{\s*([^{}]+?)\s*\}\}|$)"), F.lit(0))
    name = lambda x: F.regexp_extract(x, r"\{\{\s*([^{}]+?)\s*\}\}$", 1)

    def one(x: Column) -> Column:
        out = x
        for key, value in values.items():
            out = F.when(name(x) == key, F.concat(F.regexp_replace(x, r"\{\{\s*[^{}]+?\s*\}\}$", ""), F.coalesce(value, F.lit("")))).otherwise(out)
        return out

    return F.array_join(F.transform(parts, one), "")


def with_related(text: Column, target: Column) -> Column:
    """``related_section`` as a column: the text with a link to target as the last item under its heading "## Related"."""
    item = F.concat(F.lit("- [["), target, F.lit("]]"))
    body = F.regexp_replace(text, r"\n+$", "")
    known = F.array_contains(F.split(text, "\n"), item)
    at = F.regexp_instr(F.concat(F.lit("\n"), body, F.lit("\n")), F.lit(r"\n[ \t]*## Related[ \t]*\n"))  # place in body of its line
    behind = F.substr(body, at)
    rest = F.substr(behind, F.coalesce(F.nullif(F.locate("\n", behind), F.lit(0)), F.length(behind) + 1))
    next_ = F.regexp_instr(rest, F.lit(r"\n#"))
    inside = F.regexp_replace(F.when(next_ > 0, F.substr(rest, F.lit(1), next_ - 1)).otherwise(rest), r"\s+$", "")
    tail = F.when(next_ > 0, F.substr(rest, next_)).otherwise(F.lit(""))
    blank = F.when(inside == "", F.lit("\n")).otherwise(F.lit(""))
    gap = F.when(next_ > 0, F.regexp_extract(F.substr(rest, F.lit(1), next_ - 1), r"(\s*)$", 1)).otherwise(F.lit(""))
    first = F.substr(body, F.lit(1), F.length(body) - F.length(rest))
    put = F.concat(first, inside, blank, F.lit("\n"), item, gap, tail, F.lit("\n"))
    return F.when(known, text).when(at > 0, put).otherwise(F.concat(body, F.lit("\n\n## Related\n\n"), item, F.lit("\n")))


def redacted(text: Column) -> Column:
    """Keys in messages, shortened to their first letters."""
    return F.regexp_replace(text, r"\b(sk-[A-Za-z]{2,4})[A-Za-z0-9_-]{8,}", "$1…")


def valid_url(url: Column) -> Column:
    return url.rlike(r"^https?://[^\s]+$")


def probe(text: Column) -> Column:
    """key=value lines as a map."""
    return F.map_from_entries(F.transform(F.filter(F.split(text, "\n"), lambda x: F.instr(x, "=") > 0), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), F.trim(F.substr(x, F.instr(x, "=") + 1)))))


def related_section(text: str, target: str, alias: str | None = None) -> str:
    """The text with a link to target under its heading "## Related"."""
    item = f"- [[{target}|{alias}]]" if alias else f"- [[{target}]]"
    if item in text.split("\n"):
        return text
    lines = text.rstrip("\n").split("\n")
    at = next((k for k, line in enumerate(lines) if line.strip() == "## Related"), None)
    if at is None:
        return "\n".join([*lines, "", "## Related", "", item]) + "\n"
    stop = next((k for k in range(at + 1, len(lines)) if lines[k].startswith("#")), len(lines))
    while stop > at + 1 and not lines[stop - 1].strip():
        stop -= 1
    return "\n".join([*lines[:stop], *([""] if stop == at + 1 else []), item, *lines[stop:]]) + "\n"


class Engine:
    """The tables of a vault, derived once in one plan: files to documents, blocks and links."""

    def __init__(self, spark: SparkSession, files: DataFrame, encoders: list | None = None):
        """encoders: ones that search by meaning should use before the hashed one, in order; those not ready are passed over."""
        self.spark, self.files = spark, files.where("error IS NULL") if "error" in files.columns else files
        self.encoder, self.requests = vector.chosen(encoders or []), 0
        self.kept = False
        self.documents = markdown.documents(self.files)
        self.raw_links = self._links_in(self.files)
        self._resolve()

    @staticmethod
    def _links_in(files: DataFrame) -> DataFrame:
        return L.links_of(files).withColumn("link_id", F.sha2(F.concat_ws("|", "source", F.col("line").cast("string"), F.col("column").cast("string")), 256))

    def _resolve(self) -> None:
        """Blocks, and all links against the files of now, so none has to be healed later."""
        if not self.kept:
            self.titles = markdown.titles(self.files)  # not by the documents, which read the whole text
        else:
            self.titles = self.documents.select("path", "title")
        self.blocks = markdown.block_rows(self.documents)
        names = self.titles.select(F.col("path").alias("file_id"), "path", "title")
        self.links = links.resolved(self.raw_links, names).withColumn("is_resolved", F.col("file_id").isNotNull())

    def keep(self) -> Engine:
        """Files, documents and links kept, so that what follows doesn't read the vault again."""
        self.files, self.documents, self.raw_links = (graph.checkpointed(x) for x in (self.files, self.documents, self.raw_links))
        self.kept = True
        self._resolve()
        return self

    def index(self, changed: DataFrame, removed: list[str] = ()) -> Engine:
        """Take changed files (as files) in, and removed paths out: only they are parsed, other rows stay as they are kept."""
        files = changed.select(self.files.columns)
        gone = files.select("path").unionByName(self.spark.createDataFrame([(p,) for p in removed], "path string"))
        self.files = mutations.replaced(self.files, files, "path", gone)
        self.documents = mutations.replaced(self.documents, markdown.documents(files), "path", gone)
        self.raw_links = mutations.replaced(self.raw_links, self._links_in(files), "source", gone.withColumnRenamed("path", "source"))
        return self.keep()

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Engine:
        return cls(spark, sources.vault(spark, root))

    def report(self) -> DataFrame:
        return self.files.agg(F.count(F.lit(1)).alias("indexed"))

    def edges(self) -> DataFrame:
        return self.links.where("is_resolved").select(F.col("source").alias("src"), F.col("file_id").alias("dst"))

    def placed_blocks(self) -> DataFrame:
        """Blocks with their file's path as source."""
        return self.blocks

    def contexts(self) -> DataFrame:
        """Every resolved link with its source's title and the block it stands in."""
        made = links.in_context(self.links.where("is_resolved").select("source", "line", "column", "raw", "link_type", "file_id"), self.placed_blocks())
        return made.join(self.titles.select(F.col("path").alias("source"), F.col("title").alias("source_title")), "source")

    def block_targets(self) -> DataFrame:
        """Links to anchors with the block they name."""
        anchors = self.placed_blocks().withColumn("file_id", F.col("source")).drop("source")
        return links.to_blocks(self.links.where(F.col("block_ref").isNotNull()), anchors)

    def embeds(self) -> DataFrame:
        """Every resolved link with the text that an embed of it would show."""
        targets = self.links.where("is_resolved").join(self.files.select(F.col("path").alias("file_id"), "content"), "file_id")
        return markdown.shown(targets).select("source", "line", "column", "file_id", "shown")

    def outline(self) -> DataFrame:
        heads = self.placed_blocks().where("block_type = 'heading'")
        return heads.select(F.col("source").alias("path"), "level", F.trim(F.regexp_replace(F.element_at(F.split("content", "\n"), 1), "^#+", "")).alias("text"), "line")

    def candidates(self, asked: str = "", limit: int | None = None) -> DataFrame:
        """Files whose path or title holds a text, the newest first."""
        named = self.titles.join(self.files.select("path", "modified_at"), "path")
        found = named.where(F.lower("path").contains(asked.lower()) | F.lower("title").contains(asked.lower())) if asked else named
        return found.orderBy(F.desc("modified_at"), "path").limit(clamped(limit, 50, 1, 500))

    def backlinks(self, path: str) -> DataFrame:
        """Links to a file with the block they stand in, by path and line."""
        into = self.contexts().where(F.col("file_id") == path)
        return into.select("source", "source_title", "line", "column", "raw", "link_type", "context").orderBy("source", "line", "column")

    def outgoing(self, path: str) -> DataFrame:
        return self.links.where(F.col("source") == path).orderBy("line", "column")

    def orphans(self) -> DataFrame:
        return links.orphans(self.documents.select(F.col("path").alias("id"), "title"), self.edges()).orderBy(F.lower("title"), "id")

    def degrees(self) -> DataFrame:
        """Files without links included."""
        return self.files.select(F.col("path").alias("id")).join(graph.degrees(self.edges()), "id", "left").fillna(0, ["degree"])

    def link_sources(self) -> DataFrame:
        """Each link with the block it stands in: the last that starts at or before its line."""
        starts = self.blocks.select("source", "line", "block_id")
        return links.as_of(self.links.select("source", "line", "link_id"), starts, "source", "line", "block_id")

    def search(self, query: str, mode: str = "hybrid", limit: int | None = None, media: DataFrame | None = None) -> DataFrame:
        """block_id, score, matched_via, path, title, line, snippet, the best first.

        media (path, description) ranks with the blocks by meaning; such a hit's block_id is its path."""
        n = clamped(limit, 20, 1, 200)
        rows = self.blocks.select("block_id", "content")
        if not query.strip():
            return fulltext.described(rows.limit(0).select("block_id", F.lit(0.0).alias("score"), F.lit("").alias("matched_via")), self._told(media), query)
        full = fulltext.bm25(rows, query, 3 * n)
        tokens = self.spark.range(1).select(T.tokens(F.lit(query)).alias("t")).first()["t"]
        known = rows if media is None else rows.unionByName(media.select(F.col("path").alias("block_id"), F.col("description").alias("content")))
        if not isinstance(self.encoder, vector.Hashed):
            asked = self.encoder.encode(self.spark.createDataFrame([(query,)], "content string"), "content").first()["embedding"]
            near = vector.nearest_to(self.encoder.encode(known, "content"), list(asked), 3 * n, 0.01, "block_id")
        else:
            near = self._near(known, list(tokens), 3 * n)
        legs = {"fts": {"fts": full}, "semantic": {"semantic": near}, "hybrid": {"fts": full, "semantic": near}}[mode]
        return fulltext.described(fulltext.fused(legs, n), self._told(media), query)

    @staticmethod
    def _near(known: DataFrame, tokens: list[str], k: int) -> DataFrame:
        return vector.query_scores(known.select("block_id", T.tokens(F.col("content")).alias("tokens")), tokens).select("block_id", F.round("score", 6).alias("score")).where("score > 0.01").orderBy(F.desc("score"), "block_id").limit(k)

    def _told(self, media: DataFrame | None) -> DataFrame:
        """block_id, path, title, line, content of everything that can be found."""
        told = self.blocks.withColumnRenamed("source", "path").join(self.titles, "path").select("block_id", "path", "title", F.col("line").cast("long").alias("line"), "content")
        return told if media is None else told.unionByName(media.select(F.col("path").alias("block_id"), "path", F.element_at(F.split("path", "/"), -1).alias("title"), F.lit(None).cast("long").alias("line"), F.col("description").alias("content")))

    def read(self, path: str) -> DataFrame:
        if not sources.safe(path):
            raise ValueError("the path leaves the vault")
        return self.files.where(F.col("path") == path)


#: Tools by name: what they do, and their parameters.
TOOLS: dict[str, tuple[str, dict[str, str], Callable]] = {
    "search": ("Search blocks", {"query": "string", "mode": "string", "limit": "integer"}, lambda e, a: e.search(a["query"], a.get("mode", "hybrid"), a.get("limit"))),
    "read_note": ("Read a note", {"path": "string"}, lambda e, a: e.read(a["path"])),
    "list_notes": ("List notes, the newest first", {}, lambda e, a: sources.listing(e.files)),
    "get_backlinks": ("Links to a note", {"path": "string"}, lambda e, a: e.backlinks(a["path"])),
    "get_outgoing": ("Links of a note", {"path": "string"}, lambda e, a: e.outgoing(a["path"])),
    "find_orphans": ("Notes without links", {}, lambda e, a: e.orphans()),
    "degrees": ("Links of every note", {}, lambda e, a: e.degrees()),
}


#: Rows of a tool's result that a response holds, and the protocol's version.
MOST_ROWS, PROTOCOL = 1_000, "2024-11-05"


def dispatch(engine: Engine, request: dict, tools: dict = TOOLS) -> dict:
    """A JSON-RPC request to its response: initialize, ping, tools/list and tools/call, which are counted on the engine.

    A tool's rows are the text of the response's content, as JSON, and its structured content; a result of more than
    MOST_ROWS says that it was cut."""
    at, method, params = request.get("id"), request.get("method"), request.get("params") or {}
    engine.requests += 1
    error = lambda code, text: {"jsonrpc": "2.0", "id": at, "error": {"code": code, "message": text}}
    answer = lambda result: {"jsonrpc": "2.0", "id": at, "result": result}
    if request.get("jsonrpc") != "2.0" or not method:
        return error(-32600, "not a request")
    if method == "initialize":
        return answer({"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "mossgraph", "version": "1"}})
    if method == "ping":
        return answer({})
    if method == "tools/list":
        found = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}}} for n, (d, p, _) in tools.items()]
        return answer({"tools": found})
    if method != "tools/call":
        return error(-32601, "no such method")
    if params.get("name") not in tools:
        return error(-32602, "no such tool")
    try:
        rows = tools[params["name"]][2](engine, params.get("arguments") or {}).limit(MOST_ROWS + 1).toJSON().collect()
    except (KeyError, ValueError) as e:
        return error(-32602, str(e))
    kept = [json.loads(r) for r in rows[:MOST_ROWS]]
    return answer({"content": [{"type": "text", "text": json.dumps(kept, ensure_ascii=False)}], "rows": kept, "truncated": len(rows) > MOST_ROWS, "isError": False})


def answered(requests: DataFrame, tools: list[str], col: str = "request") -> DataFrame:
    """requests with code: what ``dispatch`` would say to each JSON text before it ran a tool (0: it would answer)."""
    field = lambda path: F.get_json_object(col, path)
    method = field("$.method")
    bad = F.try_parse_json(col).isNull()
    unknown = ~F.coalesce(field("$.params.name").isin(tools), F.lit(False))
    code = F.when(bad, -32700).when((F.coalesce(field("$.jsonrpc"), F.lit("")) != "2.0") | (F.coalesce(method, F.lit("")) == ""), -32600).when(method.isin("initialize", "ping", "tools/list"), 0).when(method != "tools/call", -32601).when(unknown, -32602).otherwise(0)
    return requests.withColumn("method", method).withColumn("code", code.cast("long"))
