"""Incremental synchronisation: what changed against the last state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


def difference(disk: DataFrame, state: DataFrame, key: str = "rel_path") -> DataFrame:
    """(key, action, checksum): NEW, CHANGED, UNCHANGED or DELETED, by one full outer join."""
    d = disk.select(key, F.col("checksum").alias("_now"))
    s = state.select(key, F.col("checksum").alias("_was"))
    action = (
        F.when(F.col("_was").isNull(), "NEW").when(F.col("_now").isNull(), "DELETED")
        .when(F.col("_now") == F.col("_was"), "UNCHANGED").otherwise("CHANGED")
    )
    return d.join(s, key, "full").select(key, action.alias("action"), F.coalesce("_now", "_was").alias("checksum"))


def next_state(diff: DataFrame, done: DataFrame, state: DataFrame, key: str = "rel_path") -> DataFrame:
    """The state after a pass: what is done takes its new checksum, what is deleted goes, the rest stays."""
    moved = diff.where("action in ('NEW', 'CHANGED')").join(done.select(key), key, "left_semi").select(key, "checksum")
    gone = diff.where("action = 'DELETED'").select(key)
    return state.select(key, "checksum").join(gone, key, "left_anti").join(moved.select(key), key, "left_anti").union(moved)


def ignored(path: Column, patterns: list[str]) -> Column:
    """S3: whether a relative path meets any rule: ``dir/`` and ``dir/*`` by prefix, else a glob on its last parts."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        if p.endswith("/"):
            out = out | (path == p.rstrip("/")) | path.startswith(p.rstrip("/") + "/")
            continue
        if p.endswith("/*"):
            out = out | path.startswith(p[:-1])
        out = out | path.rlike(glob_pattern(p))
    return out


def glob_pattern(glob: str) -> str:
    """A Java pattern of a glob that matches a path's last parts; from its start where the glob is anchored."""
    anchored, glob = glob.startswith("/"), glob.lstrip("/")
    body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\Q" + c + "\\E" for c in glob)
    return ("^" if anchored else "(^|/)") + body + "$"


def with_domain(files: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """F10 with explicit overrides first."""
    out = F.lit(None).cast("string")
    for path, domain in (overrides or {}).items():
        out = F.when(F.col("rel_path") == path, domain).otherwise(out)
    return files.withColumn("domain", F.coalesce(out, T.infer_domain(F.col("rel_path"))))


def decoded(files: DataFrame) -> DataFrame:
    """(rel_path, text, checksum) of files that aren't empty and are UTF-8."""
    text = files.where("length > 0").withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    return text.where("text is not null").select("rel_path", "text", T.checksum(F.col("text")).alias("checksum"))
