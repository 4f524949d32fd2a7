"""Source trees as tables of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import paths as P

#: Text in a line that tells a framework, in order of preference within a line.
IMPORT_MARKERS = [
    ("React", ("from 'react'", 'from "react"', "import React")),
    ("Next.js", ("from 'next/", 'from "next/', "from 'next'", 'from "next"')),
    ("Vue", ("from 'vue'", 'from "vue"')),
    ("Nuxt", ("from '#app'", 'from "#app"', "from 'nuxt/")),
    ("Angular", ("@angular/core", "@angular/common")),
    ("Svelte", ("from 'svelte", 'from "svelte')),
    ("SvelteKit", ("$app/", "@sveltejs/kit")),
    ("Astro", ("astro:",)),
]
PYTHON_MARKERS = [("Django", ("from django", "import django")), ("Flask", ("from flask", "import flask")), ("FastAPI", ("from fastapi", "import fastapi"))]
JAVA_MARKERS = [("Spring Boot", ("org.springframework", "@SpringBootApplication", "@RestController", "@Service"))]
#: Packages of a manifest that tell a framework, in order of preference.
MANIFEST_MARKERS = [("next", "Next.js"), ("nuxt", "Nuxt"), ("@sveltejs/kit", "SvelteKit"), ("astro", "Astro"), ("react", "React"), ("vue", "Vue"), ("svelte", "Svelte"), ("@angular/core", "Angular")]


def scan(spark: SparkSession, root: str, scanned_only: bool = True) -> DataFrame:
    """(path, content, modified) of the files below a folder, without skipped directories; filters come before contents are decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace(".", r"\.").lstrip("/") + "/", "")
    out = files.select(relative.alias("path"), "content", F.col("modificationTime").alias("modified")).where(~P.skipped(F.col("path")))
    out = out.where(P.scanned(F.col("path"))) if scanned_only else out
    return out.withColumn("content", F.decode("content", "UTF-8"))


def facts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Size in bytes, lines, language, kind and content hash of each file."""
    p, c = F.col(path), F.col(content)
    return files.select(
        p.alias("path"), P.language(p).alias("language"), F.octet_length(c).cast("long").alias("size"), line_count(c).alias("lines"),
        P.file_type(p).alias("file_type"), (P.file_type(p) == "test").alias("is_test"), P.generated(p).alias("is_generated"), F.sha2(c, 256).alias("hash"),
    )


def line_count(content: Column) -> Column:
    return (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("long")


def first_marker(content: Column, markers, separator: str = "\n") -> Column:
    """The name of the first line's first marker, in order of preference within the line; null without one."""
    def named(line: Column) -> Column:
        out = None
        for name, texts in markers:
            hit = F.lit(False)
            for t in texts:
                hit = hit | F.contains(line, F.lit(t))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out

    return F.try_element_at(F.filter(F.transform(F.split(content, separator), named), lambda x: x.isNotNull()), F.lit(1))


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, ending with the root (empty)."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n <= 1, F.array(F.lit(""))).otherwise(F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))


def nearest(files: DataFrame, manifests: DataFrame, path: str = "path", manifest_dir: str = "dir") -> DataFrame:
    """(path, dir): the nearest directory above each file that has a manifest; files without one are left out."""
    ups = files.select(F.col(path).alias("path")).withColumn("above", ancestors(F.col("path"))).select("path", F.posexplode("above").alias("up", "dir"))
    found = ups.join(manifests.select(F.col(manifest_dir).alias("dir")).distinct(), "dir")
    return found.groupBy("path").agg(F.min_by("dir", "up").alias("dir"))


def manifest_framework(dependencies: Column) -> Column:
    """The framework that a manifest's dependencies (a map) tell."""
    out = None
    for package, name in MANIFEST_MARKERS:
        hit = F.map_contains_key(dependencies, package)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def frameworks(files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """(path, framework): by extension, then by imports, then by the nearest manifest (dir, dependencies map), then by Python or Java markers."""
    p, c = F.col("path"), F.col("content")
    base = P.basename(p)
    by_ext = F.when(P.extension(p) == ".vue", "Vue").when(P.extension(p) == ".svelte", "Svelte").when(P.extension(p) == ".astro", "Astro").when(base.contains(".component.") & (base.contains(".ts") | base.contains(".js")), "Angular")
    script = P.language(p).isin("typescript", "javascript")
    out = files.select("path", by_ext.alias("by_ext"), F.when(script, first_marker(c, IMPORT_MARKERS)).alias("by_import"), F.when(P.language(p) == "python", first_marker(c, PYTHON_MARKERS)).when(P.language(p) == "java", first_marker(c, JAVA_MARKERS)).alias("by_language"))
    if manifests is None:
        return out.select("path", F.coalesce("by_ext", "by_import", "by_language").alias("framework"))
    told = nearest(files, manifests).join(manifests.select("dir", manifest_framework(F.col("dependencies")).alias("by_manifest")), "dir").select("path", "by_manifest")
    return out.join(told, "path", "left").select("path", F.coalesce("by_ext", "by_import", F.when(P.language(p).isin("typescript", "javascript"), F.col("by_manifest")), "by_language").alias("framework"))


def ignore_patterns(lines: list[str] | None) -> list[str]:
    """Patterns of an ignore file's lines, without comments and blanks; the defaults where there is no file."""
    if lines is None:
        return list(P.IGNORED)
    return [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]
