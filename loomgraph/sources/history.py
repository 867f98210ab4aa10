"""Version history and ignore rules as relations and filters."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "commit_id string, ts timestamp, author string, file string"
#: A reference that may be given to git: no option, no white space, no shell marks.
SAFE_REFERENCE = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_./~^@{}-]*")


def git(root: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, check=True, timeout=120).stdout


def commits(spark: SparkSession, root: str, since_days: int = 30, reference: str = "HEAD") -> DataFrame:
    """``(commit_id, ts, author, file)``, a row per file of each commit of the last days."""
    if not SAFE_REFERENCE.fullmatch(reference):
        raise ValueError(f"not a reference: {reference!r}")
    log = git(root, "log", reference, f"--since={int(since_days)} days ago", "--name-only", "--format=%x01%H%x02%ct%x02%an")
    rows = []
    for entry in log.split("\x01")[1:]:
        head, _, names = entry.partition("\n")
        commit_id, seconds, author = head.split("\x02")
        rows += [(commit_id, int(seconds), author, name) for name in names.split("\n") if name]
    found = spark.createDataFrame(rows, "commit_id string, seconds long, author string, file string")
    return found.select("commit_id", F.timestamp_seconds("seconds").alias("ts"), "author", "file")


def status_rows(lines: DataFrame) -> DataFrame:
    """``(status, file)`` of ``git status --porcelain`` lines; a rename names its new path."""
    path = F.regexp_replace(F.substring("line", 4, 100_000), "^.* -> ", "")
    return lines.select(F.trim(F.substring("line", 1, 2)).alias("status"), F.regexp_replace(path, '^"|"$', "").alias("file"))


def ignore_pattern(rule: str) -> str | None:
    """A gitignore rule as a regular expression over relative paths; None for comments."""
    rule = rule.rstrip()
    if not rule or rule.startswith("#"):
        return None
    rule = rule.removeprefix("!")
    anchored, folder = "/" in rule.rstrip("/"), rule.endswith("/")
    parts = re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?|\[[^]]*\])", rule.strip("/"))
    known = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(known.get(p, p if p.startswith("[") and p.endswith("]") else re.escape(p)) for p in parts)
    return ("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)")


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that fits a path ignores it."""
    verdict = F.lit(False)
    for rule in rules:
        pattern = ignore_pattern(rule)
        if pattern is not None:
            verdict = F.when(path.rlike(pattern), F.lit(not rule.startswith("!"))).otherwise(verdict)
    return verdict
