"""Reading a repository of text files: its root, identity and settings, and a scan by include and exclude patterns."""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extractors.base import Corpus, diagnostic_rows
from ..schema import DIAGNOSTIC, empty

CONFIG_FILE, INDEX_FOLDER = "graphloom.config.json", ".graphloom"
# What marks a root, what is read, what is left out, and the manifests that are read in any case.
ROOT_MARKERS = (".git", CONFIG_FILE, "package.json", "Cargo.toml", "tsconfig.json", "jsconfig.json")
INCLUDE = (
    "**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.mts", "**/*.cts", "**/*.rs", "README.md", "**/*.md", "**/package.json", "**/Cargo.toml", "**/tauri.conf.json", "**/src-tauri/capabilities/*.json",
    "**/src-tauri/capability/*.json", "**/tsconfig.json", "**/jsconfig.json", "**/*.config.json", "**/.eslintrc.json", "**/.prettierrc.json",
)
EXCLUDE = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/out/**", "**/target/**", "**/coverage/**", "**/.git/**", f"**/{INDEX_FOLDER}/**", "**/vendor/**", "**/generated/**", "**/.generated/**", "**/*.generated.*", "**/Cargo/registry/**")
MANIFESTS = ("**/package.json", "**/Cargo.toml", "**/tsconfig.json", "**/jsconfig.json", "**/tauri.conf.json", "**/tauri.conf.json5")
ADAPTERS = ("typescript", "rust", "react", "tauri", "markdown", "packageJson", "cargoToml", "tauriConfig", "tauriCapability", "tests", "semanticLinker")


def resolve_root(path: str, cwd: str | None = None) -> str:
    """The nearest folder upwards that has a root marker; the folder itself where none has."""
    start = Path(cwd or os.getcwd(), path).resolve()
    if not start.exists():
        raise FileNotFoundError(f"no such folder: {start}")
    start = start if start.is_dir() else start.parent
    return str(next((p for p in (start, *start.parents) if any((p / m).exists() for m in ROOT_MARKERS)), start))


def identity_of(root: str) -> str:
    return hashlib.sha256(root.encode()).hexdigest()[:16]


def commit_of(root: str) -> str | None:
    """The commit that HEAD names, where there is one: advice only."""
    try:
        head = Path(root, ".git", "HEAD").read_text().strip()
        return Path(root, ".git", head[5:]).read_text().strip() if head.startswith("ref: ") else head
    except OSError:
        return None


@dataclass(frozen=True)
class Config:
    include: tuple[str, ...] = INCLUDE
    exclude: tuple[str, ...] = EXCLUDE
    adapters: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(ADAPTERS, True))

    def digest(self) -> str:
        return hashlib.sha256(json.dumps({"include": self.include, "exclude": self.exclude, "adapters": self.adapters}, separators=(",", ":")).encode()).hexdigest()


def load_config(root: str) -> tuple[Config, str | None]:
    """The settings of a root and, where the file is no JSON object, what is wrong with it (then the defaults hold)."""
    try:
        given = json.loads(Path(root, CONFIG_FILE).read_text())
        if not isinstance(given, dict):
            raise ValueError("not an object")
    except FileNotFoundError:
        return Config(), None
    except (OSError, ValueError) as e:
        return Config(), f"{CONFIG_FILE}: {e}"
    return Config(tuple(given.get("include") or INCLUDE), (*EXCLUDE, *(given.get("exclude") or ())), {a: bool((given.get("adapters") or {}).get(a, True)) for a in ADAPTERS}), None


def write_config(root: str) -> str:
    """Write the default settings; an existing file is never replaced."""
    path = Path(root, CONFIG_FILE)
    with path.open("x") as f:
        json.dump({"include": INCLUDE, "exclude": [], "adapters": dict.fromkeys(ADAPTERS, True)}, f, indent=2)
    return str(path)


def glob_pattern(glob: str) -> str:
    """A glob over paths as an anchored regular expression: ** stands for any folders, * and ? stay within one."""
    out = ""
    for token in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|[^*?]+", glob):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token, re.escape(token))
    return f"^{out}$"


def matching(path: Column, globs: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(glob_pattern(g)) for g in globs], F.lit(False))


@dataclass(frozen=True)
class Scan:
    corpus: Corpus
    diagnostics: DataFrame
    config: Config
    excluded: int


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, content as bytes) of all files below root; executors read them, and only those whose content is asked for."""
    base = root if "://" in root else Path(root).resolve().as_uri()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(base)
    # the listing's own form of the root, whatever slashes and scheme it has
    tail = F.regexp_replace("path", "^" + re.escape(re.sub(r"^([a-z]+):/*", r"\1:/", base.rstrip("/"))) + "/", "")
    return files.withColumn("path", F.regexp_replace("path", r"^([a-z]+):/+", "$1:/")).withColumn("path", F.try_url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))))


def scan(spark: SparkSession, root: str, config: Config | None = None) -> Scan:
    """The text files that the settings admit, manifests included; files that are no UTF-8 text become diagnostics."""
    trouble = None
    if config is None:
        config, trouble = load_config(root)
    everything = listed(spark, root)
    path = F.col("path")
    wanted, left_out = matching(path, config.include), matching(path, config.exclude)
    counts = everything.select("path").where(wanted).agg(F.count("*").alias("all"), F.count_if(~left_out).alias("kept")).first()
    taken = everything.where((wanted | matching(path, MANIFESTS)) & ~left_out)
    decoded = taken.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    told = diagnostic_rows(decoded.where("content is null"), "repository", "unreadable-file", "warning", F.concat(F.lit("Unable to read "), "path"), path)
    if trouble:
        told = told.unionByName(diagnostic_rows(spark.range(1), "repository", "invalid-configuration", "error", F.lit(trouble), F.lit(CONFIG_FILE)))
    corpus = Corpus(decoded.where("content is not null"), identity_of(root), os.path.basename(root.rstrip("/")) or "repository")
    return Scan(corpus, told if told is not None else empty(spark, DIAGNOSTIC), config, max(0, counts["all"] - counts["kept"]))
