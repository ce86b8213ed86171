"""Sources: manifests, file corpora, and the target each file belongs to."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What every scan leaves out, and the fields a manifest may have.
DEFAULT_EXCLUDES = ["**/target/**", "**/build/**", "**/node_modules/**", "**/.git/**", "**/generated/**", "**/generated-sources/**", "**/out/**", "**/bin/**", "**/.idea/**"]
TARGET_FIELDS = {"name", "path", "java_version", "exclude", "type"}


@dataclass(frozen=True)
class ScanTarget:
    name: str
    path: str
    java_version: str = "17"
    exclude: tuple[str, ...] = field(default=())


def parse_manifest(text: str) -> dict:
    """The subset of YAML that manifests use: nested maps by indentation, lists of maps or words."""

    def scalar(v: str):
        v = v.strip()
        if v[:1] in "\"'" and v[-1:] == v[:1]:
            return v[1:-1]
        if v.startswith("[") and v.endswith("]"):
            return [scalar(x) for x in v[1:-1].split(",") if x.strip()]
        return {"true": True, "false": False, "null": None, "~": None, "": None}.get(v, v)

    lines = [(len(raw) - len(raw.lstrip()), raw.strip()) for raw in text.splitlines() if raw.strip() and not raw.strip().startswith("#")]

    def block(i: int, indent: int):
        if i < len(lines) and lines[i][1].startswith("- ") or i < len(lines) and lines[i][1] == "-":
            out: list = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("-"):
                rest = lines[i][1][1:].strip()
                if re.match(r"[\w.-]+\s*:(\s|$)", rest):
                    shift = lines[i][0] + len(lines[i][1]) - len(lines[i][1][1:].lstrip())
                    lines[i] = (shift, rest)
                    item, i = block(i, shift)
                    out.append(item)
                else:
                    out.append(scalar(rest))
                    i += 1
            return out, i
        found: dict = {}
        while i < len(lines) and lines[i][0] == indent and not lines[i][1].startswith("- "):
            key, _, value = lines[i][1].partition(":")
            i += 1
            if value.strip():
                found[key.strip()] = scalar(value)
            elif i < len(lines) and (lines[i][0] > indent or lines[i][0] == indent and lines[i][1].startswith("-")):
                found[key.strip()], i = block(i, lines[i][0])
            else:
                found[key.strip()] = None
        return found, i

    return block(0, lines[0][0])[0] if lines else {}


def validate_manifest(manifest: dict, exists: Callable[[str], bool] | None = None) -> list[tuple[str, str]]:
    """(level, message) of each fault; no ERROR means that it can be scanned.

    exists: tells whether a path is there; without it paths are not looked at.
    """
    found: list[tuple[str, str]] = []
    targets = manifest.get("targets")
    if not isinstance(targets, list) or not targets:
        return [("ERROR", "targets must be a list with entries")]
    for i, target in enumerate(targets):
        if not isinstance(target, dict):
            found.append(("ERROR", f"targets[{i}] must be a map"))
            continue
        for name in ("name", "path"):
            if not target.get(name):
                found.append(("ERROR", f"targets[{i}].{name} is required"))
        found += [("WARNING", f"targets[{i}].{name} is not known") for name in sorted(set(target) - TARGET_FIELDS)]
        if exists and target.get("path") and not exists(target["path"]):
            found.append(("WARNING", f"targets[{i}].path {target['path']} does not exist"))
    return found


def targets_of(manifest: dict) -> list[ScanTarget]:
    return [ScanTarget(t["name"], t["path"].rstrip("/"), str(t.get("java_version") or "17"), tuple(t.get("exclude") or ())) for t in manifest["targets"]]


def glob_regex(glob: str) -> str:
    """A regular expression for a whole relative path; a leading ``**/`` fits no folder as well."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def excluded(relative: Column, globs: list[str]) -> Column:
    flag = F.lit(False)
    for g in globs:
        flag = flag | relative.rlike(glob_regex(g))
    return flag


def split_excluded(files: DataFrame, relative: str, globs: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files kept, files left out, number of each)."""
    flagged = files.withColumn("excluded", excluded(F.col(relative), globs))
    return flagged.where("NOT excluded").drop("excluded"), flagged.where("excluded").drop("excluded"), flagged.groupBy("excluded").agg(F.count("*").alias("n"))


def any_case(ending: str) -> str:
    """A glob for names that end so, in letters of either case."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ending)


def read_files(spark: SparkSession, targets: list[ScanTarget], pattern: str = "*.java") -> DataFrame:
    """(path, relative, target_name, content, content_hash): each file once, under its first target.

    Excluded paths are dropped before their content is read on, since only the path is looked at.
    """
    out = None
    for i, t in enumerate(targets):
        raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(t.path)
        path = F.regexp_replace("path", "^file:", "")
        one = raw.select(path.alias("path"), F.expr(f"substring(regexp_replace(path, '^file:', ''), {len(t.path) + 2})").alias("relative"), F.lit(t.name).alias("target_name"), F.lit(i).alias("target_ordinal"), F.decode("content", "UTF-8").alias("content"))
        one = one.where(~excluded(F.col("relative"), [*DEFAULT_EXCLUDES, *t.exclude]))
        out = one if out is None else out.unionByName(one)
    first = out.groupBy("path").agg(F.min_by(F.struct("relative", "target_name", "content"), "target_ordinal").alias("f"))
    return first.select("path", "f.relative", "f.target_name", "f.content", F.sha2(F.col("f.content").cast("binary"), 256).alias("content_hash"))


def assign_target(files: DataFrame, targets: list[ScanTarget], path: str = "path") -> DataFrame:
    """files with the name of the first target whose folder holds them; null if none does."""
    name = F.lit(None).cast("string")
    for t in reversed(targets):
        name = F.when(F.col(path).startswith(t.path + "/"), t.name).otherwise(name)
    return files.withColumn("target_name", name)


def language_level(version: str | None) -> int:
    """The language level of a Java version: 8, 11, 14 to 18, otherwise 17."""
    digits = re.sub(r"^1\.", "", str(version or "")).split(".")[0]
    return int(digits) if digits in {"8", "11", "14", "15", "16", "17", "18"} else 17


def level_of(version: Column) -> Column:
    """language_level as a column expression."""
    digits = F.split(F.regexp_replace(F.coalesce(version, F.lit("")), r"^1\.", ""), r"\.")[0]
    return F.when(digits.isin("8", "11", "14", "15", "16", "17", "18"), digits.try_cast("int")).otherwise(17)
