"""Version-control history as tables.

A log is read one commit to a row, by a separator that git writes between commits, so that a log of any
length is split over tasks; nothing numbers the lines of a whole file in order.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "\x1e"
FORMAT = "%x1e%H|%an|%ae|%at|%s"


def write_log(repository: str, path: str, since_days: int = 30, statuses: bool = False) -> None:
    """Save ``git log`` of a local repository as text with a separator before each commit."""
    kind = "--name-status" if statuses else "--name-only"
    with open(path, "w") as out:
        subprocess.run(["git", "-C", repository, "log", kind, f"--pretty=format:{FORMAT}", f"--since={since_days} days ago", "--no-merges"], stdout=out, check=True)


def repository_info(repository: str) -> dict[str, str]:
    """Branch and origin of a local repository; empty strings where there is none."""

    def said(*args: str) -> str:
        out = subprocess.run(["git", "-C", repository, *args], capture_output=True, text=True)
        return out.stdout.strip() if out.returncode == 0 else ""

    return {"inside": said("rev-parse", "--is-inside-work-tree"), "branch": said("rev-parse", "--abbrev-ref", "HEAD"), "origin": said("config", "--get", "remote.origin.url")}


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(record): a row for each commit of a saved log."""
    return spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").alias("record")).where(F.trim("record") != "")


def parse_log(records: DataFrame) -> DataFrame:
    """(hash, author, email, ts, message, files[]) of commit records: a header of five fields, then lines of a path or of a status, a tab and a path.

    A message keeps its bars. A record without five fields in its header is left out.
    """
    lines = F.split(F.trim("record"), "\r?\n")
    head = F.split(lines[0], r"\|", 5)
    named = F.transform(F.filter(F.slice(lines, 2, 1_000_000), lambda x: F.trim(x) != ""), lambda x: F.struct(F.when(x.rlike(r"^[AMDRC][0-9]*\t"), F.substring(x, 1, 1)).otherwise("M").alias("change"), F.regexp_replace(x, r"^[AMDRC][0-9]*\t(?:[^\t]*\t(?=[^\t]*$))?", "").alias("path")))
    out = records.where(F.size(head) == 5).select(head.alias("h"), named.alias("files"))
    return out.select(F.col("h")[0].alias("hash"), F.col("h")[1].alias("author"), F.col("h")[2].alias("email"), F.timestamp_seconds(F.col("h")[3].cast("long")).alias("ts"), F.col("h")[4].alias("message"), "files")


def file_changes(commits: DataFrame) -> DataFrame:
    """(hash, path, ts, change, author): a row for each file of each commit."""
    return commits.select("hash", "ts", "author", F.explode("files").alias("f")).select("hash", "f.path", "ts", "f.change", "author")
