"""Scanning a corpus: classification, exclusion, verdict, change detection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, count_words

#: Extensions by type of file, excluded folders and files, patterns of sensitive paths and of papers.
EXTENSIONS = {
    "code": (
        ".py", ".ts", ".js", ".jsx", ".tsx", ".mjs", ".ejs", ".go", ".rs", ".java", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".rb", ".swift", ".kt", ".kts",
        ".cs", ".scala", ".php", ".lua", ".toc", ".zig", ".ps1", ".ex", ".exs", ".m", ".mm", ".jl", ".vue", ".svelte", ".dart", ".v", ".sv", ".sql", ".r",
    ),
    "document": (".md", ".mdx", ".txt", ".rst", ".html", ".yaml", ".yml"),
    "paper": (".pdf",),
    "image": (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg"),
    "office": (".docx", ".xlsx"),
    "video": (".mp4", ".mov", ".webm", ".mkv", ".avi", ".m4v", ".mp3", ".wav", ".m4a", ".ogg"),
}
NOISE = (
    "venv", ".venv", "env", ".env", "node_modules", "__pycache__", ".git", "dist", "build", "target", "out", "site-packages", "lib64",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".eggs",
)
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock", "go.sum", "go.work.sum")
SENSITIVE = (
    r"(?i)(^|[\\/])\.(env|envrc)(\.|$)",
    r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$",
    r"(?i)(credential|secret|passwd|password|token|private_key)",
    r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(?i)(\.netrc|\.pgpass|\.htpasswd)$",
)
PAPER_SIGNALS = (
    r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b",
    r"\\cite\{", r"\[\d+\]", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b",
)
ASSET_BUNDLES = (".imageset", ".xcassets", ".appiconset", ".colorset", ".launchimage")


def is_noise(path: Column) -> Column:
    """Whether one of the folders of a path is excluded."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda d: d.isin(list(NOISE)) | F.rlike(d, F.lit(r"(_venv|_env|\.egg-info)$")))


def is_lock_file(path: Column) -> Column:
    return basename(path).isin(list(LOCK_FILES))


def is_sensitive(path: Column) -> Column:
    out = F.lit(False)
    for p in SENSITIVE:
        out = out | F.rlike(path, F.lit(p))
    return out


def paper_signals(text: Column) -> Column:
    """How many signs of a paper the first 3000 characters show."""
    head, out = F.substring(F.coalesce(text, F.lit("")), 1, 3000), F.lit(0)
    for p in PAPER_SIGNALS:
        out = out + F.rlike(head, F.lit(p)).cast("int")
    return out


def is_shebang(text: Column) -> Column:
    return F.rlike(F.substring(F.coalesce(text, F.lit("")), 1, 128), F.lit(r"^#!.*(python|node|bash|sh|ruby|perl)"))


def classify(path: Column, text: Column | None = None) -> Column:
    """Type of a file by its extension; documents that look like papers are papers, assets in bundles are nothing."""
    low = F.lower(path)
    ext = F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))
    bundle = F.rlike(low, F.lit("|".join(re.escape(m) + "(/|$)" for m in ASSET_BUNDLES)))
    doc = F.lit("document") if text is None else F.when(paper_signals(text) >= 3, "paper").otherwise("document")
    out = F.when(F.endswith(low, F.lit(".blade.php")), "code").when(ext.isin(list(EXTENSIONS["code"])), "code")
    out = out.when(ext.isin(list(EXTENSIONS["paper"])) & ~bundle, "paper").when(ext.isin(list(EXTENSIONS["image"])), "image")
    return out.when(ext.isin(list(EXTENSIONS["document"])), doc).when(ext.isin(list(EXTENSIONS["office"])), "document").when(ext.isin(list(EXTENSIONS["video"])), "video")


def glob_pattern(glob: str) -> str:
    """A regular expression for an ignore rule, anchored at slashes or ends."""
    kinds = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "(^|/)" + "".join(kinds.get(x) or re.escape(x) for x in re.findall(r"\*\*|.", glob, re.S)) + "($|/)"


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that fits ignores the path; rules that start with ! take it back."""
    out = F.lit(False)
    for rule in (r.strip() for r in rules):
        if rule and not rule.startswith("#"):
            pattern = glob_pattern(rule.lstrip("!").strip("/"))
            out = F.when(F.rlike(path, F.lit(pattern)) | F.rlike(basename(path), F.lit(pattern)), not rule.startswith("!")).otherwise(out)
    return out


def verdict(files: DataFrame) -> DataFrame:
    """n_files, n_words, size class and whether a graph is worth it, of files(words)."""
    sums = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("words"), F.lit(0)).alias("n_words"))
    size = F.when(F.col("n_words") < 50_000, "small").when((F.col("n_words") >= 500_000) | (F.col("n_files") >= 200), "large").otherwise("medium")
    return sums.select("*", size.alias("verdict"), (F.col("n_words") >= 50_000).alias("needs_graph"))


def incremental_diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, state (new, changed, unchanged, deleted) of files(path, mtime, hash) against manifest(path, mtime, hash)."""
    m = manifest.select("path", F.col("mtime").alias("m_mtime"), F.col("hash").alias("m_hash"), F.lit(True).alias("known"))
    both = files.withColumn("present", F.lit(True)).join(m, "path", "full_outer")
    same = (F.col("mtime") == F.col("m_mtime")) | (F.col("hash") == F.col("m_hash"))
    state = F.when(F.col("present").isNull(), "deleted").when(F.col("known").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return both.select("path", state.alias("state"))


def word_counts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", count_words(F.col("text")).alias("words"))
