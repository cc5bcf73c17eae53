"""Source trees: listing under ignore rules, reading with size, time and hash, and snapshots of whole trees."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import scalars as X
from quillgraph.model import LANGUAGES


class TooManyFiles(RuntimeError):
    pass


@dataclass(frozen=True)
class Config:
    """Settings of a project, with their defaults."""

    languages: tuple[str, ...] = ("typescript", "javascript", "csharp")
    max_file_size_bytes: int = 2 * 1024 * 1024
    max_total_files: int = 50_000
    follow_symlinks: bool = False
    include_hidden: bool = False
    debounce_ms: int = 750
    max_wait_ms: int = 5000
    full_reindex_threshold_percent: int = 25
    default_limit: int = 50
    max_limit: int = 500
    allow_reindex: bool = False
    unknown: tuple[str, ...] = field(default=(), compare=False)

    _PLACES = {"languages": "index", "max_file_size_bytes": "index", "max_total_files": "index", "follow_symlinks": "index", "include_hidden": "index", "debounce_ms": "index.watch", "max_wait_ms": "index.watch", "full_reindex_threshold_percent": "index.watch", "default_limit": "queries", "max_limit": "queries", "allow_reindex": "mcp"}

    @classmethod
    def from_toml(cls, text: str) -> Config:
        """Sections and keys that are missing have their defaults; unknown ones are passed over."""
        data = tomllib.loads(text)
        out = {}
        for key, place in cls._PLACES.items():
            section = data
            for part in place.split("."):
                section = section.get(part, {}) if isinstance(section, dict) else {}
            if isinstance(section, dict) and key in section:
                out[key] = tuple(section[key]) if key == "languages" else section[key]
        return replace(cls(), **out)

    def to_toml(self) -> str:
        groups: dict[str, list[str]] = {}
        for key, place in self._PLACES.items():
            v = getattr(self, key)
            groups.setdefault(place, []).append(f"{key} = {json.dumps(list(v) if isinstance(v, tuple) else v)}")
        return "\n".join(f"[{g}]\n" + "\n".join(lines) + "\n" for g, lines in groups.items())


def init_project(root: str) -> Path:
    """Writes the default configuration of a tree; refuses if there is one."""
    path = Path(root).resolve() / ".quillgraph" / "config.toml"
    if path.exists():
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(Config().to_toml())
    return path


class Ignore:
    """Rules of one ignore file, for paths below its folder."""

    def __init__(self, lines: list[str]):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in lines:
            line = line.rstrip("\n").rstrip()
            if not line or line.startswith("#"):
                continue
            negative = line.startswith("!")
            line = line.removeprefix("!").removeprefix("\\")
            folder = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            parts = []
            for p in line.lstrip("/").split("/"):
                parts.append(".*" if p == "**" else re.sub(r"\.\*", "[^/]*", fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")))
            body = "/".join(parts).replace(".*/", "(?:.*/)?")
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z"), negative, folder))

    def verdict(self, path: str, is_folder: bool) -> bool | None:
        """True to ignore, False to keep, None where no rule speaks; the last rule that does counts."""
        out = None
        for pattern, negative, folder in self.rules:
            if (is_folder or not folder) and pattern.match(path):
                out = not negative
        return out


def _load(path: Path) -> Ignore | None:
    return Ignore(path.read_text(errors="replace").splitlines()) if path.is_file() else None


def list_tree(root: str, config: Config = Config()) -> list[str]:
    """Relative paths of the sources of a tree, sorted."""
    base = Path(root).resolve()
    found: list[str] = []
    top = [(Path("."), x) for x in (_load(base / ".git" / "info" / "exclude"), _load(Path.home() / ".config" / "git" / "ignore")) if x]

    def walk(folder: Path, rules: list) -> None:
        own = [(folder, x) for x in (_load(base / folder / ".gitignore"), _load(base / folder / ".ignore")) if x]
        rules = rules + own
        for e in sorted(os.scandir(base / folder), key=lambda e: e.name):
            if e.is_symlink() and not config.follow_symlinks:
                continue
            if e.name == ".git" or (e.name.startswith(".") and not config.include_hidden):
                continue
            path = folder / e.name
            is_folder = e.is_dir()
            said = None
            for at, r in rules:
                v = r.verdict(path.relative_to(at).as_posix(), is_folder)
                said = v if v is not None else said
            if said:
                continue
            if is_folder:
                walk(path, rules)
            else:
                language = LANGUAGES.get(e.name.rpartition(".")[2]) if "." in e.name else None
                if language and (not config.languages or language in config.languages) and e.stat().st_size <= config.max_file_size_bytes:
                    found.append(path.as_posix())
                    if config.max_total_files and len(found) > config.max_total_files:
                        raise TooManyFiles(f"over {config.max_total_files} files")

    walk(Path("."), top)
    return sorted(found)


def discover(files: DataFrame, config: Config = Config(), enforce: bool = True) -> DataFrame:
    """files(relative_path, size_bytes, ...) that are sources of an enabled language and not too large, by path, with their language; more than max_total_files raise."""
    known = files.drop("language").withColumn("language", X.language_of(F.col("relative_path"))).where(F.col("language").isNotNull() & (F.col("size_bytes") <= config.max_file_size_bytes))
    if config.languages:
        known = known.where(F.col("language").isin(*config.languages))
    if not config.include_hidden:
        known = known.where(~F.col("relative_path").rlike(r"(^|/)\.[^/]"))
    if enforce and config.max_total_files and known.limit(config.max_total_files + 1).count() > config.max_total_files:
        raise TooManyFiles(f"over {config.max_total_files} files")
    return known.orderBy("relative_path")


def read_sources(spark: SparkSession, root: str, paths: list[str] | None = None, config: Config = Config()) -> DataFrame:
    """(relative_path, language, size_bytes, modified_ns, content_hash, source) of a tree's files; those that aren't UTF-8 are left out."""
    base = str(Path(root).resolve())
    paths = list_tree(root, config) if paths is None else paths
    schema = "relative_path string, language string, size_bytes long, modified_ns long, content_hash string, source string"
    if not paths:
        return spark.createDataFrame([], schema)
    raw = spark.read.format("binaryFile").load([f"file://{base}/{p}" for p in paths])
    rel = F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(base) + 2})")
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.decode("content", "UTF-8")
    out = raw.select(rel.alias("relative_path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), F.sha2(F.col("content"), 256).alias("content_hash"), text.alias("source"))
    return out.where("source is not null").select("relative_path", X.language_of(F.col("relative_path")).alias("language"), "size_bytes", "modified_ns", "content_hash", "source")


def file_meta(files: DataFrame) -> DataFrame:
    """(relative_path, language, size_bytes, content_hash) of files(relative_path, language, source)."""
    return files.select("relative_path", "language", F.octet_length("source").cast("long").alias("size_bytes"), F.sha2("source", 256).alias("content_hash"))


def tree_snapshot(files: DataFrame, path: str, text: str, group: str) -> DataFrame:
    """(group, files, snapshot): one hash for each tree, of the hashes of its paths and texts in order of path."""
    h = files.select(group, F.struct(F.col(path).alias("p"), F.sha2(F.concat(F.col(path), F.lit("|"), F.coalesce(text, F.lit(""))), 256).alias("h")).alias("e"))
    g = h.groupBy(group).agg(F.array_sort(F.collect_list("e")).alias("e"))
    return g.select(group, F.size("e").cast("long").alias("files"), F.sha2(F.array_join(F.col("e.h"), ""), 256).alias("snapshot"))


def tsconfig_aliases(text: str | None) -> list[tuple[str, str]]:
    """(pattern, replacement) of the first "paths" of a tsconfig, the first entry of each; nothing where anything is odd."""
    try:
        data = json.loads(re.sub(r",(\s*[}\]])", r"\1", re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text or "", flags=re.S)))
        paths = data["compilerOptions"]["paths"]
        return [(k, v[0]) for k, v in paths.items() if isinstance(v, list) and v and isinstance(v[0], str)]
    except (ValueError, KeyError, TypeError, AttributeError):
        return []
