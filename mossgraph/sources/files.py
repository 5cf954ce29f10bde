"""File sources: vaults of Markdown (hidden folders included), canvases, skills, workflows and versioned prompts."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Folders that a vault walk leaves out (an application's own folder comes as an option), and endings it takes; fixed values.
PRUNED = (".git", "node_modules")
ENDINGS = (".md", ".markdown")


def ignored(path: str, patterns: list[str]) -> bool:
    return bool(verdict(path, patterns, False))


def verdict(path: str, patterns: list[str], out: bool | None) -> bool | None:
    """Whether a path is ignored, ``out`` where no pattern fits.  The last pattern that fits decides; a trailing slash means a
    folder, a leading one the top."""
    parts = path.split("/")
    for pattern in patterns:
        keep = pattern.startswith("!")
        p = pattern[1:] if keep else pattern
        folder = p.endswith("/")
        p = p.rstrip("/")
        if p.startswith("/") or "/" in p:
            p = p.lstrip("/")
            hit = any(fnmatch.fnmatch("/".join(parts[:k]), p) for k in range(1, len(parts) + (not folder)))
        else:
            hit = any(fnmatch.fnmatch(x, p) for x in (parts[:-1] if folder else parts))
        out = not keep if hit else out
    return out


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class VaultReader(DataSourceReader):
    """Spark's file index drops hidden files; this walk keeps them.  Content is read by the tasks, not by the walk."""

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.parts = int(options.get("parts", 8))
        self.pruned = {*PRUNED, *options.get("pruned", "").split()}
        self.endings = ("",) if options.get("every") else tuple(options.get("endings", " ".join(ENDINGS)).split())

    def walked(self) -> Iterator[tuple[str, os.stat_result]]:
        """Paths below the root that count, in order.  Each folder's ignore file holds below it, on top of those above; the
        innermost one that says anything about a path decides."""
        rules: dict[str, list[str]] = {}
        for folder, folders, names in os.walk(self.root):
            folders[:] = sorted(f for f in folders if f not in self.pruned)
            here = os.path.relpath(folder, self.root).replace(os.sep, "/")
            here = "" if here == "." else f"{here}/"
            if ".gitignore" in names:
                with open(os.path.join(folder, ".gitignore"), errors="replace") as lines:
                    rules[here] = [x.strip() for x in lines if x.strip() and not x.startswith("#")]
            for name in sorted(names):
                rel = here + name
                if not name.endswith(self.endings):
                    continue
                said = None
                for top in sorted((t for t in rules if rel.startswith(t)), key=len):
                    said = verdict(rel[len(top) :], rules[top], said)
                if not said:
                    try:
                        yield rel, os.stat(os.path.join(folder, name))
                    except OSError:
                        continue  # gone meanwhile

    def partitions(self) -> list[InputPartition]:
        found = [rel for rel, _ in self.walked()]
        return [_Part(found[k :: self.parts]) for k in range(max(1, min(self.parts, len(found))))]  # none at all would be read as one without a name

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for rel in partition.paths:
            at = os.path.join(self.root, rel)
            try:
                with open(at, "rb") as f:
                    data = f.read()
                yield rel, data.decode("utf-8"), len(data), int(os.stat(at).st_mtime * 1000), None
            except (OSError, UnicodeDecodeError) as e:
                yield rel, None, 0, 0, type(e).__name__  # counted as skipped, doesn't end the scan


class Vault(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "path string, content string, size_bytes long, modified_at long, error string"

    def reader(self, schema) -> VaultReader:
        return VaultReader(self.options)


class ChangeReader(SimpleDataSourceStreamReader):
    """What changed in a vault since the last batch: the offset is the list of its files with times and sizes."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"files": {}}

    def now(self) -> dict:
        return {"files": {rel: [int(s.st_mtime * 1000), s.st_size] for rel, s in VaultReader(self.options).walked()}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = self.now()
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        old, new = start["files"], end["files"]
        kind = lambda path: "removed" if path not in new else "created" if path not in old else "modified"
        return iter([(path, kind(path), (new.get(path) or old[path])[0]) for path in sorted({*old, *new}) if old.get(path) != new.get(path)])


class Changes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault_changes"

    def schema(self) -> str:
        return "path string, kind string, modified_at long"

    def simpleStreamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)


def changes(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """A stream of path, kind (created, modified, removed), modified_at; files changed several times between two batches
    count once, so the trigger's interval is the debounce."""
    spark.dataSource.register(Changes)
    return spark.readStream.format("vault_changes").options(path=root, **options).load()


def vault(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """path (below the root), content, size_bytes, modified_at (ms), error.  The root is a folder all executors can read."""
    spark.dataSource.register(Vault)
    return spark.read.format("vault").options(**options).load(root)


class MediaReader(VaultReader):
    """The same walk over files of any kind; bytes as they are."""

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for rel in partition.paths:
            at = os.path.join(self.root, rel)
            try:
                with open(at, "rb") as f:
                    data = f.read()
                yield rel, data, len(data), int(os.stat(at).st_mtime * 1000), None
            except OSError as e:
                yield rel, None, 0, 0, type(e).__name__


class Media(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault_media"

    def schema(self) -> str:
        return "path string, data binary, size_bytes long, modified_at long, error string"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def media_files(spark: SparkSession, root: str, endings: list[str] | None) -> DataFrame:
    """path, data, size_bytes, modified_at, error of files with one of the endings (lower or upper case), or of all files."""
    spark.dataSource.register(Media)
    kept = " ".join(f".{x}" for e in endings for x in (e.lower(), e.upper())) if endings else None
    reader = spark.read.format("vault_media")
    return (reader.option("endings", kept) if kept else reader.option("every", "true")).load(root)


def models(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, present, total_bytes: a model is there if each file of its manifest (name, path, size_bytes) has that very size."""
    found = manifest.join(files.select("path", F.col("size_bytes").alias("own")), "path", "left")
    return found.groupBy("name").agg(F.every(F.coalesce(F.col("own") == F.col("size_bytes"), F.lit(False))).alias("present"), F.sum("size_bytes").alias("total_bytes")).orderBy("name")


def listing(files: DataFrame) -> DataFrame:
    return files.select("path", "size_bytes", "modified_at").orderBy(F.desc("modified_at"), "path")


def tree(files: DataFrame) -> DataFrame:
    """path, name, depth, is_dir of every folder and file; folders first in a folder."""
    parts = F.split("path", "/")
    whole = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), (k < F.size(parts)).alias("is_dir"), k.alias("depth")))).alias("n"))
    named = whole.select("n.path", "n.is_dir", "n.depth").distinct().withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.orderBy("depth", F.desc("is_dir"), F.lower("name"), "path")


CANVAS = "nodes array<struct<id:string,type:string,x:double,y:double,width:double,height:double,file:string,text:string>>, edges array<struct<id:string,fromNode:string,toNode:string,label:string>>"


def canvas(files: DataFrame) -> DataFrame:
    """files (path, content) to path, nodes, edges, problem; an empty file is an empty canvas."""
    read = F.from_json(F.when(F.trim("content") == "", "{}").otherwise(F.col("content")), f"struct<{CANVAS.replace('nodes ', 'nodes:').replace('edges ', 'edges:')}>")
    bad = (F.trim("content") != "") & F.try_parse_json("content").isNull()
    made = files.select("path", read.alias("c"), bad.alias("bad")).select("path", F.coalesce("c.nodes", F.array()).alias("nodes"), F.coalesce("c.edges", F.array()).alias("edges"), "bad")
    ids = F.transform("nodes", lambda n: n["id"])
    missing = F.exists("edges", lambda e: ~F.array_contains(ids, e["fromNode"]) | ~F.array_contains(ids, e["toNode"]))
    problem = F.when(F.col("bad"), "not JSON").when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate node").when(missing, "edge to no node")
    return made.withColumn("problem", problem).drop("bad")


def skills(files: DataFrame) -> DataFrame:
    """SKILL.md files with front matter: path, name, description, body, reason (why one is skipped), by name."""
    matter = F.regexp_extract("content", r"(?s)^\x{FEFF}?---\n(.*?)\n---", 1)
    named = lambda key: F.trim(F.regexp_replace(F.regexp_extract(matter, rf"(?m)^{key}:[ \t]*(.*)$", 1), r"^[\"']|[\"']$", ""))
    made = files.where(F.col("path").rlike(r"(^|/)[^/]+/SKILL\.md$")).select("path", named("name").alias("name"), named("description").alias("description"), F.regexp_replace("content", r"(?s)^\x{FEFF}?---\n.*?\n---\n?", "").alias("body"), (matter == "").alias("none"))
    return made.withColumn("reason", F.when(F.col("none"), "no front matter").when(F.col("name") == "", "no name")).drop("none").orderBy("name", "path")


WORKFLOW = "struct<name:string,description:string,trigger_vector:array<float>,trigger_threshold:double,steps:array<struct<id:string,kind:string,args:string>>>"


def workflows(files: DataFrame) -> DataFrame:
    """JSON workflows: path, name, threshold (0.7 if unset), trigger_vector, steps, reason, by name."""
    made = files.where(F.col("path").endswith(".json")).select("path", F.from_json("content", WORKFLOW).alias("w"))
    reason = F.when(F.col("w").isNull() | (F.col("w.name").isNull() & F.col("w.steps").isNull()), "not a workflow").when(F.trim(F.coalesce("w.name", F.lit(""))) == "", "no name").when(F.size(F.coalesce("w.steps", F.array())) == 0, "no steps")
    return made.select("path", "w.name", F.coalesce("w.trigger_threshold", F.lit(0.7)).alias("threshold"), "w.trigger_vector", "w.steps", reason.alias("reason")).orderBy("name", "path")


def prompts(files: DataFrame, defaults: DataFrame) -> DataFrame:
    """name, version, body of <name>/v<n>.md files; a default (name, body) counts only where no file has its name."""
    at = r"([^/]+)/v(\d+)\.md$"
    found = files.where(F.col("path").rlike(at)).select(F.regexp_extract("path", at, 1).alias("name"), F.regexp_extract("path", at, 2).cast("long").alias("version"), F.col("content").alias("body"))
    rest = defaults.join(found.select("name").distinct(), "name", "left_anti").select("name", F.lit((1 << 32) - 1).cast("long").alias("version"), "body")
    return found.unionByName(rest).orderBy("name", "version")


def safe(path: str) -> bool:
    """Whether a path stays below the root: no null byte, not absolute, no parent step."""
    return bool(path) and "\0" not in path and not os.path.isabs(path) and ".." not in path.replace("\\", "/").split("/") and not path.startswith("~") and ":" not in path.split("/")[0]
