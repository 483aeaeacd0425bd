"""Source trees as tables of path and content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of paths that are never scanned, and endings of shader files (fixed values).
EXCLUDED = ("/node_modules/", "/ThirdParty/", "/Build/", "/Specs/", "/Workers/")
SHADERS = (".glsl", ".glsl.js", ".frag", ".vert")


def scan(spark: SparkSession, root: str, glob: str = "*.js", below: tuple[str, ...] = (), excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, content) of the files below a root, paths relative to it; hidden folders are left out.

    below: only files under one of these folders. One file is one row, so a file must fit in memory.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    relative = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + _quoted(_plain(root)) + "/*", ""), r"\\", "/")
    rows = files.select(relative.alias("path"), F.col("content").cast("string").alias("content"))
    rows = rows.where(~F.col("path").rlike(r"(^|/)\.[^/]+/"))
    for part in excluded:
        rows = rows.where(~F.contains(F.concat(F.lit("/"), "path"), F.lit(part)))
    if below:
        inside = F.lit(False)
        for folder in below:
            inside = inside | F.startswith("path", F.lit(folder.rstrip("/") + "/"))
        rows = rows.where(inside)
    return rows


def _plain(root: str) -> str:
    return "/" + root.split(":", 1)[-1].strip("/")


def _quoted(part: str) -> str:
    import re

    return re.escape(part)


def scripts(spark: SparkSession, root: str, below: tuple[str, ...] = ()) -> DataFrame:
    return scan(spark, root, "*.js", below).where(~F.endswith("path", F.lit(".glsl.js")))


def shaders(spark: SparkSession, root: str) -> DataFrame:
    """Shader files of any of the known endings, each once."""
    ending = F.lit(False)
    for e in SHADERS:
        ending = ending | F.endswith("path", F.lit(e))
    return scan(spark, root, "*.{glsl,js,frag,vert}", excluded=()).where(ending).dropDuplicates(["path"])
