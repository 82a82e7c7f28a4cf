"""File sources: markdown trees, transcripts, graphs, images, project signals, model registries."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mime
from ..operators.graph import ENTITY, RELATION

# Files that tell what a project is.
MARKERS = {"Cargo.toml": ("rust", None), "package.json": ("javascript", None), "tsconfig.json": ("typescript", None), "pyproject.toml": ("python", None), "requirements.txt": ("python", None), "go.mod": ("go", None), "pom.xml": ("java", "maven"), "build.gradle": ("java", "gradle"), "build.gradle.kts": ("kotlin", "gradle"), "composer.json": ("php", None), "Gemfile": ("ruby", None), "Package.swift": ("swift", None), "build.zig": ("zig", None), "CMakeLists.txt": ("cpp", "cmake")}
IMAGES = ("png", "jpg", "jpeg", "webp", "gif", "bmp")


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all .md files below a folder."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def exports(spark: SparkSession, root: str, form: str) -> DataFrame:
    """(source_id, format, payload) of transcript exports."""
    t = texts(spark, root, "*.jsonl" if form == "jsonl" else "*.json")
    return t.select(F.col("path").alias("source_id"), F.lit(form).alias("format"), F.col("content").alias("payload"))


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a graph file; a missing one is empty."""
    cast = lambda kind: "array<struct<" + re.sub(r"(\w+) (\w+)", r"\1:\2", kind).replace(", ", ",") + ">>"
    try:
        raw = spark.read.schema(f"entities {cast(ENTITY)}, relations {cast(RELATION)}").json(path, multiLine=True)
        raw.limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ENTITY), spark.createDataFrame([], RELATION)
    return raw.select(F.explode("entities").alias("x")).select("x.*"), raw.select(F.explode("relations").alias("x")).select("x.*")


def save_graph(entities: DataFrame, relations: DataFrame, folder: str) -> None:
    """Relations once per triple regardless of case."""
    keys = [F.lower(c).alias(f"_{i}") for i, c in enumerate(("source", "target", "relation_type"))]
    entities.write.mode("overwrite").json(f"{folder}/entities")
    relations.select("*", *keys).dropDuplicates(["_0", "_1", "_2"]).drop("_0", "_1", "_2").write.mode("overwrite").json(f"{folder}/relations")


def images(spark: SparkSession, root: str, most_bytes: int | None = None) -> DataFrame:
    """Images below a folder without dot folders: id by content, size, time, in order of path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    ok = raw.where(ext.isin(*IMAGES) & ~F.col("path").rlike(r"/\.[^/]+/"))
    if most_bytes is not None:
        ok = ok.where(F.col("length") <= most_bytes)
    return ok.select(F.sha2("content", 256).alias("id"), F.col("path").alias("source_path"), F.col("length").alias("file_size"), F.unix_seconds("modificationTime").alias("mtime_epoch")).orderBy("source_path")


def file_listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return raw.select("path", F.col("length").alias("bytes"), mime("path").alias("mime")).where(~F.col("path").contains("/.trash/")).orderBy("path")


def fingerprint(spark: SparkSession, root: str) -> DataFrame:
    """One hash over names, lengths and bytes of the project's signal files."""
    raw = spark.read.format("binaryFile").load(root).withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").isin(*MARKERS))
    part = F.concat_ws(":", "name", F.col("length").cast("string"), F.sha2("content", 256))
    return raw.agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(part))), 256).alias("fingerprint"))  # a few files of one folder


def profile(spark: SparkSession, root: str) -> DataFrame:
    """(language, framework) that the project's files tell of."""
    rows = [(k, *v) for k, v in MARKERS.items()]
    known = spark.createDataFrame(rows, "name string, language string, framework string")
    raw = spark.read.format("binaryFile").load(root).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return raw.join(F.broadcast(known), "name").select("name", "language", "framework").orderBy("name")


def models(spark: SparkSession, text: str, user: str | None = None) -> DataFrame:
    """Models of a TOML registry, a user's over the built-in ones by name; exactly one default."""
    rows = {m["name"]: m for m in tomllib.loads(text).get("models", [])}
    rows |= {m["name"]: m for m in (tomllib.loads(user).get("models", []) if user else [])}
    if sum(bool(m.get("default")) for m in rows.values()) != 1:
        raise ValueError("a registry needs exactly one default model")
    return spark.createDataFrame([(m["name"], m.get("tier"), int(m.get("dims", 0)), bool(m.get("default"))) for m in rows.values()], "name string, tier string, dims int, is_default boolean")
