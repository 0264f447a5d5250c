"""Source text: files of a tree, ownership rules, change history, project manifests, cached facts."""

from __future__ import annotations

import re
import subprocess
import tomllib
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import glob_regex, owner_rule_regex

EXTENSIONS = (".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".java", ".rs")
SKIPPED = ("target", "node_modules", "__pycache__")


def source_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(file, text) of all files below ``root`` with these extensions; not in hidden or built folders, and only UTF-8."""
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    base = str(Path(root).resolve()) if "://" not in root else root
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.replace(path, F.lit(base), F.lit("")), "^/", "")
    hidden = F.exists(F.slice(F.split(relative, "/"), 1, F.greatest(F.size(F.split(relative, "/")) - 1, F.lit(0))), lambda d: F.startswith(d, F.lit(".")) | d.isin(*SKIPPED))
    wanted = F.rlike(relative, F.lit(f"({'|'.join(re.escape(e) for e in extensions)})$"))
    return files.select(relative.alias("file"), F.expr("try_validate_utf8(cast(content AS string))").alias("text")).filter(wanted & ~hidden & F.col("text").isNotNull())


def ownership_rules(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(ord, pattern, regex, owners) of an ownership file's lines; later rules override earlier ones."""
    rows = []
    for i, line in enumerate(lines):
        words = re.sub(r"(^|\s)#.*$", "", line).split()
        if words:
            rows.append((i, words[0], owner_rule_regex(words[0]), words[1:]))
    return spark.createDataFrame(rows, "ord int, pattern string, regex string, owners array<string>")


def find_ownership_file(root: str) -> list[str]:
    for place in (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS"):
        if (p := Path(root, place)).is_file():
            return p.read_text(encoding="utf-8").splitlines()
    return []


def read_blame(text: str) -> list[tuple[int, str, int, str]]:
    """(line, hash, time, zone) of ``git blame --line-porcelain`` output."""
    out, now, time, zone = [], None, None, None
    for row in text.split("\n"):
        if m := re.match(r"^([0-9a-f]{40,64}) \d+ (\d+)", row):
            now = (int(m[2]), m[1])
        elif row.startswith("committer-time "):
            time = int(row.split(" ")[1])
        elif row.startswith("committer-tz "):
            zone = row.split(" ")[1]
        elif row.startswith("\t") and now:
            out.append((now[0], now[1], time, zone))
            now = None
    return out


def blame(files: DataFrame, root: str) -> DataFrame:
    """(file, line, hash, time, zone) of each of ``files``; the tree must be at ``root`` on all executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file in part["file"]:
                done = subprocess.run(["git", "-C", root, "blame", "--line-porcelain", "--", file], capture_output=True)
                if done.returncode == 0:
                    rows += [(file, *r) for r in read_blame(done.stdout.decode(errors="replace"))]
            yield pd.DataFrame(rows, columns=["file", "line", "hash", "time", "zone"])

    return files.select("file").distinct().mapInPandas(run, "file string, line int, hash string, time bigint, zone string")


def read_log(text: str) -> list[tuple[str, str, str, str]]:
    """(hash, author, date, subject) of log output with records after 0x1e and fields between 0x1f; patches are left out."""
    out = []
    for record in text.split("\x1e")[1:]:
        fields = record.split("\n", 1)[0].split("\x1f")
        if len(fields) == 4:
            out.append(tuple(fields))
    return out


def history(root: str, file: str, first: int, last: int) -> list[tuple[str, str, str, str]]:
    """Commits that changed these lines, newest first."""
    done = subprocess.run(["git", "-C", root, "log", "--format=%x1e%H%x1f%an%x1f%aI%x1f%s", "-s", "-L", f"{first},{last}:{file}"], capture_output=True)
    if done.returncode:
        raise ValueError(done.stderr.decode(errors="replace").strip())
    return read_log(done.stdout.decode(errors="replace"))


def iso_time(epoch: F.Column, zone: F.Column) -> F.Column:
    """Epoch seconds with a zone such as +0130 as ISO text."""
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    shift = sign * (F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 4, 2).cast("int") * 60)
    local = F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_dt_interval(secs=epoch + shift)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))


MANIFEST_KEYS = {"name": str, "languages": list, "roots": list, "modules": dict, "policy": dict, "lint": dict}
POLICY = {"unknown": ("warn", "error"), "stale": ("warn", "error"), "undeclared_effects": ("warn", "off")}


class ManifestError(ValueError):
    """code: E0401 unknown key, E0403 bad value."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def find_manifest(start: str, name: str = "intent.toml") -> Path | None:
    """The nearest manifest in the folder or those above it."""
    here = Path(start).resolve()
    return next((p / name for p in (here, *here.parents) if (p / name).is_file()), None)


def read_manifest(text: str) -> dict:
    """A project's manifest; keys keep their order, unknown ones are errors."""
    from ..operators.lint import OVERRIDABLE

    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ManifestError("E0403", str(e)) from e
    for key, value in data.items():
        if key not in MANIFEST_KEYS:
            raise ManifestError("E0401", f"unknown key {key}")
        if not isinstance(value, MANIFEST_KEYS[key]):
            raise ManifestError("E0403", f"{key} must be of type {MANIFEST_KEYS[key].__name__}")
    for key, value in data.get("policy", {}).items():
        if key not in POLICY:
            raise ManifestError("E0401", f"unknown policy {key}")
        if value not in POLICY[key]:
            raise ManifestError("E0403", f"{key} is one of {POLICY[key]}")
    for code, level in data.get("lint", {}).items():
        if code not in OVERRIDABLE:
            raise ManifestError("E0401", f"{code} can't be overridden")
        if level != "off":
            raise ManifestError("E0403", f"{code} can only be off")
    if any(not isinstance(m, str) for m in data.get("modules", {}).values()):
        raise ManifestError("E0403", "modules maps globs to names")
    return data


def module_globs(spark: SparkSession, manifest: dict) -> DataFrame:
    """(ord, glob, regex, module), in the manifest's order."""
    rows = [(i, g, glob_regex(g), m) for i, (g, m) in enumerate(manifest.get("modules", {}).items())]
    return spark.createDataFrame(rows, "ord int, glob string, regex string, module string")


def with_cache(sources: DataFrame, path: str, version: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``extract`` of (file, text), keyed by version, file and text: what the cache at ``path`` has is read, the rest computed and added.

    Facts are rows with a column ``file``. A file without facts is known by its row in ``path``/keys.
    """
    spark = sources.sparkSession
    key = F.sha2(F.concat_ws("\x1f", F.lit(version), F.col("file"), F.col("text")), 256)
    keyed = sources.withColumn("key", key)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/keys")
    known = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    missing = keyed.join(spark.read.parquet(f"{path}/keys").select("key"), "key", "left_anti") if known else keyed
    facts = extract(missing.select("file", "text")).join(missing.select("file", "key"), "file")
    facts.write.mode("append").parquet(f"{path}/facts")
    missing.select("key").write.mode("append").parquet(f"{path}/keys")
    return spark.read.parquet(f"{path}/facts").join(keyed.select("key").distinct(), "key", "left_semi").drop("key")
