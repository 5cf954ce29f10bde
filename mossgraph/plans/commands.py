"""The commands of a vault by name: files, links, graph, communities, media, sessions, canvases, workflows and telemetry.

A workspace holds plans, not rows: each command returns a DataFrame (or a small value), and what it writes it writes on
the driver, file by file, into the vault's folder, which all executors can read."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markdown, media
from ..functions import text as T
from ..operators import communities, graph, hyper, links, loop, partitions, state, telemetry, vector
from ..sources import files as sources
from . import api, workflow


class Session:
    """A moving query state: each text moves it, and questions are blended with it."""

    def __init__(self, alpha: float = state.ALPHA):
        self.alpha = alpha
        self.reset()

    def reset(self) -> None:
        self.steps, self.state = 0, np.zeros(T.DIM)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        size = float(np.sqrt((v**2).sum()))
        return v / size if size > 1e-9 else v

    def _vector(self, words: list[str]) -> np.ndarray:
        out = np.zeros(T.DIM)
        for at, n in vector.places(words).items():
            out[at] = n
        return self._unit(out)

    def step(self, words: list[str]) -> float:
        """How well the text fits the state before it."""
        own = self._vector(words)
        fits = float(own @ self.state)
        self.state = self._unit(self.alpha * self.state + (1 - self.alpha) * own)
        self.steps += 1
        return fits

    def fused(self, words: list[str], share: float = 0.5) -> np.ndarray:
        """The question blended with the state; the question alone where they cancel."""
        own = self._vector(words)
        made = self._unit(share * self.state + (1 - share) * own)
        return made if made.any() else own

    def status(self) -> dict:
        return {"steps": self.steps, "norm": float(np.sqrt((self.state**2).sum())), "saturation": float((np.abs(self.state) > 1e-6).mean())}


class Workspace(api.Engine):
    """A vault with what its commands need: a chat model, a downloader and a ledger are given, not built in."""

    def __init__(self, spark: SparkSession, root: str, provider: workflow.Provider | None = None, downloader: Callable[[str, str], str] | None = None, ledger: DataFrame | None = None):
        self.root, self.provider, self.downloader, self.ledger = os.path.abspath(root), provider or workflow.Echo(), downloader, ledger
        self.session, self.network, self.energy, self.themes, self.serving = Session(), None, None, None, False
        super().__init__(spark, sources.vault(spark, self.root))

    def reindex_vault(self) -> DataFrame:
        """indexed, skipped; the plans are made anew, so files that changed are read again."""
        scanned, counted = sources.vault(self.spark, self.root), self.requests
        super().__init__(self.spark, scanned, [self.encoder])
        self.requests = counted
        return scanned.agg(F.count_if(F.col("error").isNull()).alias("indexed"), F.count_if(F.col("error").isNotNull()).alias("skipped"))

    # -- the server of tools, in this process: requests are dicts, and transport is others' work

    def start_mcp_server(self) -> dict:
        self.serving = True
        return self.mcp_status()

    def stop_mcp_server(self) -> dict:
        self.serving = False
        return self.mcp_status()

    def mcp_status(self) -> dict:
        return {"running": self.serving, "requests": self.requests, "tools": sorted(TOOLS)}

    def handle(self, request: dict) -> dict:
        if not self.serving:
            raise ValueError("the server isn't running")
        return api.dispatch(self, request, TOOLS)

    # -- files

    def _at(self, path: str) -> str:
        at = os.path.join(self.root, path)
        if not sources.safe(path) or os.path.commonpath([os.path.realpath(self.root), os.path.realpath(at)]) != os.path.realpath(self.root):
            raise ValueError("the path leaves the vault")
        return at

    def _put(self, path: str, content: str) -> None:
        """Written beside the file and moved over it, so that readers see the old or the new one."""
        at = self._at(path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(f"{at}.part", "w", encoding="utf-8", newline="") as f:
            f.write(content)
        os.replace(f"{at}.part", at)

    def list_files(self) -> DataFrame:
        return sources.listing(self.files)

    def file_tree(self) -> DataFrame:
        return sources.tree(self.files)

    def write_file(self, path: str, content: str) -> DataFrame:
        if not path.endswith(sources.ENDINGS):
            raise ValueError("not a Markdown file")
        self._put(path, content)
        self.reindex_vault()
        return self.documents.where(F.col("path") == path)

    def create_file(self, path: str, content: str | None = None) -> DataFrame:
        if os.path.exists(self._at(path)):
            raise ValueError("the file exists")
        stem = os.path.splitext(os.path.basename(path))[0]
        return self.write_file(path, f"# {stem}\n\n" if content is None else content)

    def delete_file(self, path: str) -> None:
        os.remove(self._at(path))
        self.reindex_vault()

    def rename_file(self, path: str, to: str) -> DataFrame:
        if os.path.exists(self._at(to)):
            raise ValueError("the file exists")
        os.makedirs(os.path.dirname(self._at(to)), exist_ok=True)
        os.rename(self._at(path), self._at(to))
        self.reindex_vault()
        return self.documents.where(F.col("path") == to)

    def _text(self, path: str) -> str:
        row = self.read(path).first()
        if row is None:
            raise ValueError("no such file")
        return row["content"]

    # -- links and blocks

    def get_outline(self, path: str) -> DataFrame:
        return self.outline().where(F.col("path") == path).select("level", "text", "line").orderBy("line")

    def list_link_candidates(self, asked: str = "", limit: int | None = None) -> DataFrame:
        return self.candidates(asked, limit)

    def resolve_embed(self, target: str, heading: str | None = None, block_ref: str | None = None) -> dict | None:
        """Path and text of what an embed shows; null if its target isn't there."""
        asked = self.spark.createDataFrame([(1, target)], "link_id long, target string")
        row = links.resolved(asked, self.documents.select(F.col("path").alias("file_id"), "path", "title")).first()
        if row is None or row["file_id"] is None:
            return None
        return {"path": row["file_id"], "content": markdown.embedded(self._text(row["file_id"]), heading, block_ref)}

    def apply_link_suggestion(self, source: str, target: str, alias: str | None = None) -> DataFrame:
        return self.write_file(source, api.related_section(self._text(source), target, alias))

    # -- graph and communities

    def _nodes(self) -> DataFrame:
        """Files numbered by a 64-bit hash of their path."""
        return self.documents.select(F.xxhash64("path").alias("id"), "path", "title")

    def _pairs(self) -> DataFrame:
        return self.edges().select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"))

    def get_graph_snapshot(self, iterations: int | None = None) -> dict[str, DataFrame]:
        nodes, pairs = self._nodes(), self._pairs()
        placed = graph.layout_frame(self.spark, nodes, pairs, api.clamped(iterations, 250, 20, 1000))
        return {"nodes": nodes.join(placed, "id").select("path", "title", "x", "y", "degree"), "edges": graph.undirected(self.edges()).distinct()}

    def _vectors(self, dim: int = hyper.DIM) -> DataFrame:
        words = self.files.select(F.xxhash64("path").alias("id"), T.tokens(F.col("content")).alias("tokens"))
        return hyper.combined(hyper.encoded(words, dim=dim), self._pairs(), dim)

    def find_related(self, path: str, limit: int | None = None) -> DataFrame:
        """path, score, shared: files by similarity of text and links, without a threshold."""
        vectors, nodes = graph.checkpointed(self._vectors()), self._nodes()
        own = vectors.where(F.col("id") == F.xxhash64(F.lit(path))).first()
        if own is None:
            raise ValueError("no such file")
        near = hyper.related(vectors.where(F.col("id") != own["id"]), bytes(own["hv"]), api.clamped(limit, 10, 1, 50))
        shared = graph.shared_neighbours(self._pairs(), near.select(F.lit(own["id"]).alias("a"), F.col("id").alias("b")), few=True)
        return near.join(shared.select(F.col("b").alias("id"), "shared"), "id").join(nodes, "id").select("path", "title", "score", "shared").orderBy(F.desc("score"), "path")

    def suggest_links(self, least: float | None = None, per_source: int | None = None, total: int | None = None) -> DataFrame:
        found = hyper.suggestions(self._vectors(), self._pairs(), max(0.0, min(1.0, 0.18 if least is None else least)), api.clamped(per_source, 5, 1, 50), api.clamped(total, 100, 1, 500))
        names = lambda side: self._nodes().select(F.col("id").alias(side), F.col("path").alias(f"{side}_path"))
        made = found.join(names("source"), "source").join(names("target"), "target")
        return made.select(F.col("source_path").alias("source"), F.col("target_path").alias("target"), "score", "shared").orderBy(F.desc("score"), "source", "target")

    def rebuild_graph_rag(self, resolution: float = 1.0) -> DataFrame:
        """level, label, members, summary, parent, is_top of every community; kept for the queries after it.

        A component that needs fewer levels than others keeps its last partition as its top."""
        nodes = self._nodes()
        weighted = graph.undirected(self._pairs()).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
        levels = graph.checkpointed(partitions.leiden(nodes.select("id"), weighted, resolution))
        up = levels.select("id", (F.col("level") - 1).alias("level"), F.col("label").alias("parent"))
        grouped = levels.join(up, ["id", "level"], "left").join(nodes, "id")
        lead = self.files.select(F.xxhash64("path").alias("id"), T.leading_text(F.regexp_replace("content", r"(?s)^\x{FEFF}?---\n.*?\n---\n?", ""), communities.LEAD).alias("lead"))
        keyed = grouped.join(lead, "id", "left").withColumn("community", F.concat_ws("/", F.col("level").cast("string"), F.col("label").cast("string")))
        about = keyed.groupBy("community", "level", "label").agg(F.min("parent").alias("parent"))
        self.themes = graph.checkpointed(communities.summaries(keyed, "community", "path").join(about, "community").withColumn("is_top", F.col("parent").isNull()))
        return self.themes

    def _themes(self) -> DataFrame:
        return self.themes if self.themes is not None else self.rebuild_graph_rag()

    def max_community_level(self) -> DataFrame:
        return self._themes().agg(F.coalesce(F.max("level"), F.lit(0)).alias("level"))

    def list_communities_at_level(self, level: int) -> DataFrame:
        """Those of the level, and the tops of components that end below it."""
        return self._themes().where((F.col("level") == level) | (F.col("is_top") & (F.col("level") < level))).orderBy(F.desc("members"), "label")

    def _ranked(self, asked: list[float], k: int) -> DataFrame:
        rows = vector.embedded(self._themes().where("is_top").withColumn("tokens", T.tokens(F.col("summary"))))
        near = vector.nearest_to(rows, asked, k, id_col="community")
        hits = near.join(rows.select("community", "level", "label", "members", "summary"), "community")
        place = F.row_number().over(Window.orderBy(F.desc("score"), "community"))  # at most twenty rows
        return hits.withColumn("rank", place)

    def _words(self, text: str) -> list[str]:
        return list(self.spark.range(1).select(T.tokens(F.lit(text)).alias("t")).first()["t"])

    def graph_rag_query(self, query: str, limit: int | None = None) -> DataFrame:
        """rank, score, members, summary of the communities nearest to a question; none for an empty one."""
        asked = Session()._vector(self._words(query))
        hits = self._ranked(asked.tolist(), api.clamped(limit, 5, 1, 20))
        return hits if asked.any() else hits.limit(0)

    def graph_rag_context(self, query: str, limit: int | None = None) -> DataFrame:
        return communities.context(self.graph_rag_query(query, limit))

    # -- sessions

    def ssm_status(self) -> dict:
        return self.session.status()

    def ssm_reset(self) -> dict:
        self.session.reset()
        return self.session.status()

    def ssm_step_text(self, text: str) -> dict:
        fits = self.session.step(self._words(text))
        return self.session.status() | {"alignment": fits}

    def streaming_chat(self, query: str, limit: int | None = None) -> dict:
        """The state moves first, then the question blended with it finds communities, and the model answers."""
        words = self._words(query)
        self.session.step(words)
        hits = self._ranked(self.session.fused(words).tolist(), api.clamped(limit, 5, 1, 20))
        payload = communities.context(hits).first()["payload"]
        answer = self.provider.chat(f"Answer from these themes and cite them as [C<number>].\n\n{payload}\n\nQuestion: {query}")
        cited = self.spark.createDataFrame([(answer,)], "a string").select(*[c.alias(n) for n, c in communities.citations(F.col("a")).items()]).first()
        return {"answer": answer, "citations": cited.asDict(), "status": self.session.status()}

    # -- media

    def scan_media(self) -> DataFrame:
        """path, kind, size_bytes, modified_at, description, embedding of each media file."""
        found = sources.media_files(self.spark, self.root, [e for group in media.KINDS.values() for e in group])
        described = found.where("error IS NULL").withColumn("kind", media.kind(F.col("path"))).withColumn("description", media.description(F.col("path"), F.col("size_bytes")))

        @F.pandas_udf("array<float>")
        def encode(words, data):
            import pandas as pd

            return pd.Series([media.embedding(list(w), bytes(d)) for w, d in zip(words, data)])

        return described.select("path", "kind", "size_bytes", "modified_at", "description", encode(T.tokens(F.col("description")), F.col("data")).alias("embedding"))

    def list_media(self) -> DataFrame:
        return self.scan_media().drop("embedding").orderBy(F.desc("modified_at"), "path")

    def ingest_media(self, path: str) -> DataFrame:
        self._at(path)
        return self.scan_media().where(F.col("path") == path)

    def ingest_url(self, url: str) -> DataFrame:
        if not self.spark.range(1).select(api.valid_url(F.lit(url)).alias("v")).first()["v"]:
            raise ValueError("not a web address")
        if self.downloader is None:
            raise ValueError("no downloader is set")
        return self.ingest_media(self.downloader(url, self.root))

    def delete_media(self, path: str) -> None:
        if not path.lower().endswith(tuple(f".{e}" for group in media.KINDS.values() for e in group)):
            raise ValueError("not a media file")
        os.remove(self._at(path))

    def media_tools_status(self) -> dict:
        return {"downloader": self.downloader is not None, "kinds": sorted(media.KINDS)}

    # -- canvases

    def list_canvases(self) -> DataFrame:
        return sources.listing(sources.vault(self.spark, self.root, endings=".canvas").where("error IS NULL"))

    def read_canvas(self, path: str) -> DataFrame:
        if not sources.safe(path):
            raise ValueError("the path leaves the vault")
        return sources.canvas(sources.vault(self.spark, self.root, endings=".canvas").where(F.col("path") == path))

    def write_canvas(self, path: str, canvas: dict) -> DataFrame:
        if not path.endswith(".canvas"):
            raise ValueError("not a canvas")
        text = json.dumps(canvas, indent=2, ensure_ascii=False)
        problem = sources.canvas(self.spark.createDataFrame([(path, text)], "path string, content string")).first()["problem"]
        if problem:
            raise ValueError(problem)
        self._put(path, text)
        return self.read_canvas(path)

    def create_canvas(self, path: str) -> DataFrame:
        if os.path.exists(self._at(path)):
            raise ValueError("the file exists")
        return self.write_canvas(path, {"nodes": [], "edges": []})

    # -- the loop

    def start_cortex(self, settings: loop.Settings | None = None) -> dict:
        self.network, self.energy = loop.Network(settings or loop.Settings()), None
        return self.cortex_status()

    def stop_cortex(self) -> dict:
        self.network = None
        return self.cortex_status()

    def send_observation(self, values: list[float]) -> dict:
        if self.network is None:
            raise ValueError("the loop isn't running")
        self.energy = self.network.step(np.asarray(values, dtype=float))
        return self.cortex_status()

    def cortex_status(self) -> dict:
        return {"running": self.network is not None, "tick": self.network.tick if self.network else 0, "energy": self.energy}

    # -- models, skills and workflows

    def embeddings_model_status(self, manifest: DataFrame, folder: str = "models") -> DataFrame:
        return sources.models(sources.media_files(self.spark, self._at(folder), None), manifest)

    def download_embeddings_model(self, name: str, manifest: DataFrame, folder: str = "models") -> DataFrame:
        """Files of a model (name, path, size_bytes, url) that aren't there yet, by the downloader; then the model's status."""
        if self.downloader is None:
            raise ValueError("no downloader is set")
        own = manifest.where(F.col("name") == name).collect()
        if not own:
            raise ValueError("no such model")
        there = {r["path"]: r["size_bytes"] for r in sources.media_files(self.spark, self._at(folder), None).select("path", "size_bytes").collect()}
        for r in own:
            if there.get(r["path"]) != r["size_bytes"]:
                self.downloader(r["url"], self._at(folder))
        return self.embeddings_model_status(manifest.where(F.col("name") == name), folder)

    def list_skills(self, folder: str = "skills") -> DataFrame:
        return sources.skills(sources.vault(self.spark, self._at(folder)))

    def list_workflows(self, folder: str = "workflows") -> DataFrame:
        return sources.workflows(sources.vault(self.spark, self._at(folder), endings=".json"))

    def run_workflow(self, name: str, values: dict[str, str] | None = None, dry_run: bool = True, folder: str = "workflows") -> workflow.Run:
        row = self.list_workflows(folder).where((F.col("name") == name) & F.col("reason").isNull()).first()
        if row is None:
            raise ValueError("no such workflow")
        steps = [{"id": s["id"], "kind": s["kind"], "args": json.loads(s["args"]) if s["args"] else {}} for s in row["steps"]]
        done = workflow.run({"steps": steps}, values or {}, self.provider, None if dry_run else self._put)
        if not dry_run:
            self.reindex_vault()
        return done

    # -- telemetry

    def _ledger(self) -> DataFrame:
        if self.ledger is None:
            raise ValueError("no ledger is set")
        return self.ledger

    def get_cache_stats(self, now: str, hours: int = 24) -> DataFrame:
        return telemetry.cache_ratio(self._ledger(), F.lit(now).cast("timestamp"), hours)

    def get_today_cost_cents(self, now: str) -> DataFrame:
        return telemetry.since_midnight(self._ledger(), F.lit(now).cast("timestamp"))

    def get_recent_audit_log(self, limit: int | None = None) -> DataFrame:
        return self._ledger().orderBy(F.desc("ts"), F.desc("event_id")).limit(api.clamped(limit, 50, 1, 500))


class Desk:
    """The vault that is open, if one is: what opening, closing and asking for it mean in a process."""

    def __init__(self, spark: SparkSession, **given):
        self.spark, self.given, self.workspace = spark, given, None

    def open_vault(self, root: str) -> dict:
        if not os.path.isdir(root):
            raise ValueError("no such folder")
        self.workspace = Workspace(self.spark, root, **self.given)
        return self.current_vault()

    def close_vault(self) -> dict:
        self.workspace = None
        return self.current_vault()

    def current_vault(self) -> dict:
        return {"open": self.workspace is not None, "root": self.workspace.root if self.workspace else None}

    def call(self, name: str, /, **arguments):
        if name in DESK_COMMANDS:
            return getattr(self, name)(**arguments)
        if self.workspace is None:
            raise ValueError("no vault is open")
        return call(self.workspace, name, **arguments)


DESK_COMMANDS = ("open_vault", "close_vault", "current_vault")

#: Commands whose methods are named otherwise, by name.
OTHER_NAMES = {
    "read_file": "read",
    "get_backlinks": "backlinks",
    "get_outgoing_links": "outgoing",
    "search_vault": "search",
    "find_orphan_notes": "orphans",
}
COMMANDS = """reindex_vault list_files read_file write_file create_file delete_file rename_file file_tree get_backlinks get_outgoing_links get_outline
list_link_candidates resolve_embed get_graph_snapshot search_vault find_related rebuild_graph_rag graph_rag_query list_communities_at_level
max_community_level ssm_status ssm_reset ssm_step_text streaming_chat media_tools_status ingest_media ingest_url scan_media list_media delete_media
suggest_links find_orphan_notes apply_link_suggestion list_canvases read_canvas write_canvas create_canvas start_cortex stop_cortex send_observation
cortex_status embeddings_model_status list_skills list_workflows run_workflow get_cache_stats get_today_cost_cents get_recent_audit_log
start_mcp_server stop_mcp_server mcp_status download_embeddings_model""".split()

#: The tools of a workspace: those that read, and a note's writing and questions to communities.
TOOLS = api.TOOLS | {
    "write_note": ("Write a note", {"path": "string", "content": "string"}, lambda w, a: w.write_file(a["path"], a["content"]).select("path", "title", "content_hash")),
    "graph_rag_query": ("Communities near a question", {"query": "string", "limit": "integer"}, lambda w, a: w.graph_rag_query(a["query"], a.get("limit")).select("rank", "score", "members", "summary").orderBy("rank")),
}


def call(workspace: Workspace, name: str, /, **arguments):
    """A command by its name."""
    if name not in COMMANDS:
        raise ValueError("no such command")
    return getattr(workspace, OTHER_NAMES.get(name, name))(**arguments)
