"""Paths, languages, names and signatures, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by language.
LANGUAGES = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".py": "python", ".java": "java", ".go": "go", ".rs": "rust", ".vue": "vue", ".svelte": "svelte", ".astro": "astro"}
SCANNED = (".ts", ".tsx", ".js", ".jsx", ".json", ".yaml", ".yml")
SKIPPED_DIRS = ("node_modules", ".git", "dist", "build", "coverage", ".nyc_output", "tmp", "temp")
IGNORED = ("node_modules/", "dist/", "build/", "target/", ".next/", ".git/", "vendor/", "__pycache__/", "*.log", "*.tmp", "*.cache")
MINED = (".go", ".js", ".ts", ".jsx", ".tsx", ".py", ".java", ".c", ".cpp", ".h", ".hpp", ".rb", ".php", ".swift", ".kt", ".scala", ".rs", ".dart", ".vue", ".svelte")
CONFIGS = ("package.json", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "Dockerfile", "docker-compose.yml", "Makefile", "CMakeLists.txt")
WATCHED = (".ts", ".tsx", ".js", ".jsx", ".json", ".yaml", ".yml")
UNWATCHED = ("node_modules", ".git", "dist", "build", "coverage", "*.log", "*.tmp")
BUILTIN_TYPES = ("string", "number", "boolean", "object", "undefined", "null", "void", "any", "unknown", "never", "bigint", "symbol", "Array", "Promise", "Date", "RegExp", "Error")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def basename(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit("unsupported"))


def scanned(path: Column) -> Column:
    return extension(path).isin(*SCANNED)


def skipped(path: Column) -> Column:
    """Whether some directory on the path is skipped (by its whole name, so template.ts stays)."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_DIRS)))


def file_type(path: Column) -> Column:
    base, ext = F.lower(basename(path)), extension(path)
    return F.when(base.contains("test") | base.contains("spec"), "test").when(base.contains("config") | ext.isin(".json", ".yaml", ".yml"), "config").otherwise("source")


def generated(path: Column) -> Column:
    base = basename(path)
    return base.contains("generated") | base.contains("auto") | base.endswith(".gen.ts") | base.endswith(".generated.ts")


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob in which * matches within a path segment and ? one character."""
    return "^" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern) + "$"


def matches(path: Column, pattern: str) -> Column:
    """A directory pattern (ending in /) or a plain one matches anywhere in the path; one with * matches the base name or the whole path."""
    if "*" in pattern and not pattern.endswith("/"):
        return basename(path).rlike(glob_regex(pattern)) | path.rlike(glob_regex(pattern))
    return path.contains(pattern)


def matches_any(path: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(path, p)
    return out


def mined(path: Column, ignored=IGNORED) -> Column:
    """Whether pair mining takes a file: not hidden, not ignored, and a source or a known configuration file."""
    return ~path.startswith(".") & ~matches_any(path, ignored) & (extension(path).isin(*MINED) | basename(path).isin(*CONFIGS))


def neighborhood_file(path: Column, tests: bool = True, docs: bool = False, configs: bool = False) -> Column:
    keep = ~path.startswith(".")
    if not tests:
        keep = keep & ~path.contains("_test.")
    if not docs:
        keep = keep & ~extension(path).isin(".md", ".txt")
    return keep if configs else keep & ~extension(path).isin(".json", ".yaml")


def watched(path: Column) -> Column:
    return extension(path).isin(*WATCHED) & ~matches_any(path, UNWATCHED)


def naming_patterns(name: Column) -> Column:
    """Patterns of a name: its first and last three letters, and its case."""
    case = F.when(F.substring(name, 1, 1).rlike("[A-Z]"), "title_case").otherwise("lower_case")
    long = F.length(name) >= 3
    found = F.array(F.when(long, F.concat(F.lit("prefix_"), F.substring(name, 1, 3))), F.when(long, F.concat(F.lit("suffix_"), F.right(name, F.lit(3)))), case)
    return F.array_compact(found)


def type_references(signature: Column) -> Column:
    """Types named after colons in a signature, builtins left out."""
    parts = F.slice(F.split(signature, ":"), 2, 1_000_000)
    names = F.transform(parts, lambda p: F.regexp_extract(F.trim(p), r"^([A-Za-z_][A-Za-z0-9_]*)", 1))
    return F.array_distinct(F.filter(names, lambda n: (n != "") & ~n.isin(*BUILTIN_TYPES)))


def import_candidates(source: Column, target: Column) -> Column:
    """Where a relative import may lead, in order of preference; empty for other imports."""
    base = F.concat_ws("/", F.when(directory(source) != "", directory(source)), F.regexp_replace(target, r"^\./", ""))
    up = base
    for _ in range(8):  # a/b/../c is a/c
        up = F.regexp_replace(up, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    ends = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    return F.when(target.startswith("./") | target.startswith("../"), F.array(*(F.concat(up, F.lit(e)) for e in ends))).otherwise(F.array().cast("array<string>"))
