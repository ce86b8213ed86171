"""Pairing by ranked candidates: the first candidate that exists wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_existing(items: DataFrame, candidates: Column, existing: DataFrame, key: str, found: str = "found") -> DataFrame:
    """items with the earliest candidate that is a key of existing, and its rank from 0; null if none is.

    candidates: an array in order of preference.  Existence is a join, not a file check.
    """
    ids = items.columns
    tried = items.select(*ids, F.posexplode(candidates).alias("rank", "candidate"))
    hits = tried.join(existing.select(F.col(key).alias("candidate")).distinct(), "candidate", "left_semi")
    best = hits.groupBy(*ids).agg(F.min(F.struct("rank", "candidate")).alias("_best"))
    return items.join(best, ids, "left").select(*ids, F.col("_best.candidate").alias(found), F.col("_best.rank").cast("long").alias("rank"))


def test_candidates(path: Column, suffixes: tuple[str, ...] = ("Test", "Tests", "IT"), prefixes: tuple[str, ...] = ("Test",)) -> Column:
    """Where a test of a source file can lie: beside it, then in the test trees."""
    folder = F.regexp_replace(path, "[^/]*$", "")
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.java$", "")
    beside = [F.concat(folder, name, F.lit(f"{s}.java")) for s in suffixes] + [F.concat(folder, F.lit(p), name, F.lit(".java")) for p in prefixes]
    trees = []
    for tree, end in (("src/test/java", ".java"), ("src/test/groovy", ".groovy")):
        moved = F.replace(folder, F.lit("src/main/java"), F.lit(tree))
        trees += [F.concat(moved, name, F.lit(s + end)) for s in suffixes] + [F.concat(moved, F.lit(p), name, F.lit(end)) for p in prefixes]
    return F.array(*beside, *trees)


#: Endings and beginnings of test class names.
SUFFIXES, PREFIXES = ("Test", "Tests", "IT"), ("Test",)


def _named_as_test(fqn: Column) -> Column:
    name = F.element_at(F.split(fqn, r"\."), -1)
    return name.rlike(r"(?:" + "|".join(SUFFIXES) + r")$") | name.rlike(r"^(?:" + "|".join(PREFIXES) + ")")


def _under(path: Column, folder: str) -> Column:
    return F.concat(F.lit("/"), path).contains(folder)


def is_test_class(path: Column, fqn: Column) -> Column:
    """Whether a file is a test: by its folder, or by the name of its first type."""
    return _under(path, "/src/test/") | _under(path, "/src/integration-test/") | _named_as_test(fqn)


def test_index(file_types: DataFrame, imports: DataFrame, library: list[str]) -> DataFrame:
    """(fqn, test_file): the classes a test file imports, and those its name stands for.

    Test files are those named so outside of src/main.  Library classes, wildcard and
    static imports say nothing.
    """
    tests = file_types.where(~_under(F.col("file_path"), "/src/main/") & _named_as_test(F.col("fqn"))).select(F.col("file_path").alias("test_file"), "fqn")
    foreign = F.col("fqn").rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in library) + ")")
    imported = imports.where(~foreign & ~F.col("fqn").endswith(".*")).select(F.col("file_path").alias("test_file"), "fqn").join(tests.select("test_file"), "test_file", "left_semi")
    package, name = F.regexp_extract("fqn", r"^(.*\.)?([^.]*)$", 1), F.element_at(F.split("fqn", r"\."), -1)
    bare = [F.when(name.endswith(s) & (F.length(name) > len(s)), F.concat(package, F.expr(f"substring(element_at(split(fqn, '[.]'), -1), 1, length(element_at(split(fqn, '[.]'), -1)) - {len(s)})"))) for s in SUFFIXES]
    bare += [F.when(name.startswith(p) & (F.length(name) > len(p)), F.concat(package, F.expr(f"substring(element_at(split(fqn, '[.]'), -1), {len(p) + 1})"))) for p in PREFIXES]
    inferred = tests.select("test_file", F.explode(F.array_compact(F.array(*bare))).alias("fqn"))
    return imported.select("fqn", "test_file").unionByName(inferred.select("fqn", "test_file")).distinct()


def first_tests(file_types: DataFrame, index: DataFrame) -> DataFrame:
    """(source_file, test_file): of each file that is no test, the first test by path that the index has for its class."""
    sources = file_types.where(~is_test_class(F.col("file_path"), F.col("fqn"))).select(F.col("file_path").alias("source_file"), "fqn")
    return sources.join(index.groupBy("fqn").agg(F.min("test_file").alias("test_file")), "fqn").select("source_file", "test_file")


def resolve_paths(names: DataFrame, name: str, files: DataFrame, path: str = "path") -> DataFrame:
    """names with the file each stands for: as written, with an ending, dots as slashes, by file name alone.

    Candidates are compared with the ends of paths: every path is split into its endings
    once, so the join is an equi-join.
    """
    slashed = F.replace(F.col(name), F.lit("."), F.lit("/"))
    tries = F.array_distinct(F.array(F.col(name), F.concat(F.col(name), F.lit(".java")), slashed, F.concat(slashed, F.lit(".java")), F.regexp_extract(F.col(name), "[^/]*$", 0)))
    parts = F.split(F.col(path), "/")
    tails = files.select(F.col(path).alias("_path"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("tail"))
    tails = tails.unionByName(files.select(F.col(path).alias("_path"), F.col(path).alias("tail"))).distinct()
    tried = names.select(name, F.posexplode(tries).alias("rank", "tail"))
    best = tried.join(tails, "tail").groupBy(name).agg(F.min(F.struct("rank", "_path")).alias("_best"))
    return names.join(best, name, "left").select(*names.columns, F.col("_best._path").alias("resolved_path"), F.col("_best.rank").alias("strategy"))
