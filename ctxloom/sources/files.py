"""Source trees, git logs, task lists and configuration."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.functions import text as X

#: Directories and files that are never sources (fixed values).
EXCLUDES = ["**/node_modules/**", "**/target/**", "**/build/**", "**/dist/**", "**/.venv/**", "**/bin/**", "**/obj/**", "node_modules/**", "target/**", "build/**", "dist/**", ".venv/**", "bin/**", "obj/**", "*.min.js", "*.lock"]
MOST_BYTES = 2 << 20


class Excluded:
    """Globs over paths with forward slashes; ``**`` spans directories. A bad pattern is an error."""

    def __init__(self, globs: list[str]):
        if bad := [g for g in globs if not g or g.count("[") != g.count("]")]:
            raise ValueError(f"bad pattern: {bad[0]}")
        self.patterns = [re.compile(self._regex(g)) for g in globs]

    @staticmethod
    def _regex(glob: str) -> str:
        if "/" not in glob:
            return r"(?:.*/)?" + fnmatch.translate(glob).replace(r"\z", r"\Z")
        out = ""
        for part in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?)", glob):
            out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
        return out + r"\Z"

    def __call__(self, path: str) -> bool:
        return any(p.match(path) for p in self.patterns)


class Ignored:
    """The patterns of one .gitignore, for paths relative to its folder; the last one that matches decides."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\) +$", "", line)
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!")
            only_folders, anchored = line.endswith("/"), "/" in line.rstrip("/")
            if body := line.strip("/"):
                self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + self._regex(body) + r"\Z", re.S), only_folders, keep))

    @staticmethod
    def _regex(glob: str) -> str:
        out, k = "", 0
        while k < len(glob):
            if glob.startswith("**/", k) and (not k or glob[k - 1] == "/"):
                out, k = out + "(?:.*/)?", k + 3
            elif glob.startswith("**", k) and k + 2 == len(glob) and (not k or glob[k - 1] == "/"):
                out, k = out + ".+", k + 2
            elif glob[k] == "*":
                out, k = out + "[^/]*", k + 1
            elif glob[k] == "?":
                out, k = out + "[^/]", k + 1
            elif glob[k] == "[" and "]" in glob[k + 2 :]:
                end = glob.index("]", k + 2)
                inner = glob[k + 1 : end].replace("\\", "\\\\")
                out, k = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            else:
                k += glob[k] == "\\" and k + 1 < len(glob)
                out, k = out + re.escape(glob[k]), k + 1
        return out

    def verdict(self, path: str, folder: bool) -> bool | None:
        """True if the path is ignored, False if it is kept by name, None if no pattern matches."""
        return next((not keep for p, only_folders, keep in reversed(self.rules) if (folder or not only_folders) and p.match(path)), None)


def list_tree(root: str, excludes: list[str] | None = None) -> Iterator[str]:
    """Relative paths below ``root``: without hidden ones, what a .gitignore of the folder or of one above it names, and excluded directories, which are not entered."""
    out = Excluded(EXCLUDES if excludes is None else excludes)
    above: dict[str, list[tuple[str, Ignored]]] = {"": []}
    for base, dirs, names in os.walk(root):
        rel = os.path.relpath(base, root).replace(os.sep, "/")
        at = "" if rel == "." else rel + "/"
        ignore = Path(base, ".gitignore")
        rules = above.pop(at) + ([(at, Ignored(ignore.read_text(errors="replace")))] if ignore.is_file() else [])

        def skip(name: str, folder: bool, at: str = at, rules: list[tuple[str, Ignored]] = rules) -> bool:
            found = (r.verdict((at + name)[len(of) :], folder) for of, r in reversed(rules))
            return next((v for v in found if v is not None), False)

        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and not skip(d, True) and not out(f"{at}{d}/x"))
        above |= {f"{at}{d}/": rules for d in dirs}
        yield from (at + n for n in sorted(names) if not n.startswith(".") and not skip(n, False) and not out(at + n))


SCAN = "repo string, path string, lang string, bytes bigint, mtime bigint, content_hash string, text string, skipped string"


def scan_tree(spark: SparkSession, repo: str, root: str, excludes: list[str] | None = None, most_bytes: int = MOST_BYTES, slices: int | None = None) -> DataFrame:
    """One row for each file of a known language: hash, time in seconds, and text, or why it was skipped (size, binary).

    Paths are listed on the driver (names only, so that excluded directories cost nothing) and read by the tasks, a file at a time. The tree must be mounted on all
    executors; sources in an object store are read with ``scan_store``.
    """
    paths = [(p,) for p in list_tree(root, excludes)]
    listed = spark.createDataFrame(paths, "path string").withColumn("lang", X.language("path")).where("lang is not null").repartition(slices or spark.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for path, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = {"repo": repo, "path": path, "lang": lang, "bytes": None, "mtime": None, "content_hash": None, "text": None, "skipped": None}
                full = os.path.join(root, path)
                try:
                    st = os.stat(full)
                    row |= {"bytes": st.st_size, "mtime": int(st.st_mtime)}
                    if st.st_size > most_bytes:
                        row["skipped"] = "size"
                    else:
                        raw = Path(full).read_bytes()
                        row |= {"content_hash": hashlib.sha256(raw).hexdigest(), "text": raw.decode("utf-8")}
                except UnicodeDecodeError:
                    row["skipped"] = "binary"
                except OSError:
                    continue
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("repo", pa.string()), ("path", pa.string()), ("lang", pa.string()), ("bytes", pa.int64()), ("mtime", pa.int64()), ("content_hash", pa.string()), ("text", pa.string()), ("skipped", pa.string())]))

    return listed.mapInArrow(read, SCAN)


def scan_store(spark: SparkSession, repo: str, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The same columns by Spark's own reader, from any store it knows."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", ".*?" + re.escape(root.split(":")[-1].rstrip("/")) + "/", "")
    text = F.when(F.col("length") <= most_bytes, F.try_validate_utf8(F.decode("content", "UTF-8")))
    rows = b.select(F.lit(repo).alias("repo"), path.alias("path"), F.col("length").alias("bytes"), F.unix_timestamp("modificationTime").alias("mtime"), X.content_hash("content").alias("content_hash"), text.alias("text"))
    rows = rows.withColumn("lang", X.language("path")).where("lang is not null")
    return rows.withColumn("skipped", F.when(F.col("bytes") > most_bytes, "size").when(F.col("text").isNull(), "binary")).select(*[c.split()[0] for c in SCAN.split(", ")])


def git_head(root: str) -> tuple[str | None, str | None]:
    """(branch, commit) of a work tree; nulls where git or the repository is missing."""
    def ask(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", root, "rev-parse", *args], capture_output=True, text=True, timeout=30)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() or None if done.returncode == 0 else None

    return ask("--abbrev-ref", "HEAD"), ask("HEAD")


def git_log(spark: SparkSession, root: str, most: int = 1000) -> DataFrame:
    """The text of the log as one row, in the form ``history.parse_log`` reads; empty outside a repository."""
    try:
        done = subprocess.run(["git", "-C", root, "log", f"-n{most}", "--name-only", "--no-merges", "--format=%x00%H%x1f%an%x1f%ae%x1f%at%x1f%s"], capture_output=True, text=True, errors="replace", timeout=300)
        text = done.stdout if done.returncode == 0 else ""
    except (OSError, subprocess.TimeoutExpired):
        text = ""
    return spark.createDataFrame([(text,)], "value string")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(task, expect) of a JSON-lines file; blank lines and those with # are skipped, a bad line is an error that names it."""
    rows = spark.read.text(path).withColumn("value", F.trim("value")).where("value <> '' and not startswith(value, '#')")
    parsed = rows.withColumn("x", F.from_json("value", "task string, expect array<string>"))
    bad = F.raise_error(F.concat(F.lit(f"{path}: not a task: "), "value"))
    return parsed.select(F.when(F.col("x.task").isNull(), bad).otherwise(F.col("x.task")).alias("task"), F.coalesce("x.expect", F.array().cast("array<string>")).alias("expect"))


@dataclass
class Config:
    name: str = "solution"
    repos: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDES))
    max_file_bytes: int = MOST_BYTES
    #: The extraction cache loses its oldest quarter beyond this size.
    cache_bytes: int = 1 << 30
    max_commits: int = 1000
    max_candidates: int = 3
    rank: dict[str, float] = field(default_factory=lambda: {"alpha": 0.7, "beta": 0.5, "gamma": 0.3, "delta": 0.4, "epsilon": 0.2})
    terms: dict[str, list[str]] = field(default_factory=dict)
    framework: str | None = None


CONFIG_NAME, SHARED_NAME = "ctxloom.toml", "ctxloom.shared.toml"


def load_config(path: str) -> Config:
    """The local file, over which the shared one beside it lays its index fields one by one and its other sections whole; max_file_bytes and cache_bytes are never shared."""
    c = Config()
    for name, shared in ((path, False), (str(Path(path).with_name(SHARED_NAME)), True)):
        if not Path(name).is_file():
            continue
        text = Path(name).read_text()
        d = tomllib.loads(text)
        solution, index = d.get("solution", {}), d.get("index", {})
        known = {f.name for f in fields(Config)} - ({"max_file_bytes", "cache_bytes"} if shared else set())
        c = replace(c, **{k: v for k, v in index.items() if k in known})
        if not shared:
            c = replace(c, name=solution.get("name", c.name), repos=[str((Path(path).parent / r).resolve()) for r in solution.get("repos", [])])
        if "rank" in d:
            c = replace(c, rank=Config().rank | d["rank"])
        if "semantic" in d:
            c = replace(c, terms={k.lower(): v for k, v in d["semantic"].get("terms", {}).items()})
        if "framework" in d:
            c = replace(c, framework=text)
    return c


def save_config(path: str, c: Config, shared: bool = False) -> None:
    """Writes a file that ``load_config`` reads; the shared form holds no paths."""
    q = lambda xs: "[" + ", ".join(f'"{x}"' for x in xs) + "]"
    out = [] if shared else ["[solution]", f'name = "{c.name}"', f"repos = {q(c.repos)}", ""]
    out += ["[index]", f"languages = {q(c.languages)}", f"exclude = {q(c.exclude)}", f"max_commits = {c.max_commits}", f"max_candidates = {c.max_candidates}"]
    out += [] if shared else [f"max_file_bytes = {c.max_file_bytes}", f"cache_bytes = {c.cache_bytes}"]
    out += ["", "[rank]", *(f"{k} = {v}" for k, v in c.rank.items()), "", "[semantic.terms]", *(f'"{k}" = {q(v)}' for k, v in c.terms.items()), ""]
    Path(path).write_text("\n".join(out))


def find_config(start: str) -> str | None:
    """The nearest configuration file in a directory or above it."""
    for d in (Path(start).resolve(), *Path(start).resolve().parents):
        if (d / CONFIG_NAME).is_file():
            return str(d / CONFIG_NAME)
    return None


def census(paths: Iterator[str], least: int = 3) -> list[str]:
    """Code languages with ``least`` files or more, the most frequent first."""
    count: dict[str, int] = {}
    for p in paths:
        lang = X.LANGUAGES.get(p.rsplit(".", 1)[-1].lower()) if "." in p else None
        if lang in X.CODE:
            count[lang] = count.get(lang, 0) + 1
    return [k for k, n in sorted(count.items(), key=lambda x: (-x[1], x[0])) if n >= least]


def init(folder: str, repos: list[str], name: str | None = None, force: bool = False) -> str:
    """A first configuration with the languages that occur; an existing one is kept unless ``force``."""
    path = Path(folder, CONFIG_NAME)
    if path.exists() and not force:
        raise FileExistsError(f"{path} exists")
    langs = census(p for r in repos for p in list_tree(r))
    save_config(str(path), Config(name=name or Path(repos[0]).resolve().name, repos=[str(Path(r).resolve()) for r in repos], languages=langs))
    return str(path)
