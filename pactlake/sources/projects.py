"""Source trees of calling code and their scanner settings, as tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of source files, and folders that hold no code of the project's own.
ENDINGS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
SKIPPED = ("node_modules", "dist", "build", "out", "coverage", ".git")
CONFIG_NAME = "scanner.json"
CONFIG = "repo string, base_url string, name string, url_argument int, body_argument int, method_argument int, problem string"


class ScanTargetError(ValueError):
    """What was named can't be scanned: an empty result would read as if nothing were affected."""


class ConfigError(ValueError):
    """Settings that would silently find nothing."""


def read_project(spark: SparkSession, root: str, repo: str | None = None, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(repo, file, content) of the source files below a folder of any store that Spark reads; file is relative to it.

    Skipped folders are pruned when files are listed, so nothing of them is read. A folder that is missing, no folder, or
    without source files raises ScanTargetError.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise ScanTargetError(f"no such folder: {root}")
    if not fs.getFileStatus(path).isDirectory():
        raise ScanTargetError(f"not a folder: {root}")
    base = fs.getFileStatus(path).getPath().toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}").load(root)
    below = f"/({'|'.join(map(re.escape, skipped))})/"
    inner = lambda c: F.expr(f"substring({c}, instr({c}, '{_quoted(base)}/') + {len(base)})")
    kept = files.filter(~inner("_metadata.file_path").rlike(below))
    found = kept.select(F.lit(repo if repo is not None else root).alias("repo"), F.expr(f"url_decode(replace({_relative('path', base)}, '+', '%2B'))").alias("file"), F.decode("content", "UTF-8").alias("content"))
    if found.select("file").isEmpty():
        raise ScanTargetError(f"no source files below {root}, so nothing could be scanned")
    return found


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _relative(column: str, base: str) -> str:
    return f"substring({column}, instr({column}, '{_quoted(base)}/') + {len(base) + 1})"


def parse_config(raw: object, where: str = CONFIG_NAME) -> tuple[str | None, list[tuple[str, int, int | None, int | None]]]:
    """(base URL, (name, URL argument, body argument, method argument) of each request function) of parsed settings."""
    if not isinstance(raw, dict):
        raise ConfigError(f"{where}: expected a JSON object")
    base = raw.get("baseUrl")
    if base is not None and not isinstance(base, str):
        raise ConfigError(f"{where}: baseUrl must be a string")
    declared = raw.get("requestFunctions", [])
    if not isinstance(declared, list):
        raise ConfigError(f"{where}: requestFunctions must be an array")
    out = []
    for i, entry in enumerate(declared):
        at = f"{where}: requestFunctions[{i}]"
        if not isinstance(entry, dict):
            raise ConfigError(f"{at} must be an object")
        name = entry.get("name")
        if not isinstance(name, str) or not name:
            raise ConfigError(f"{at}.name must be a non empty string")
        places = []
        for key in ("urlArgument", "bodyArgument", "methodArgument"):
            n = entry.get(key)
            if (n is not None or key == "urlArgument") and (isinstance(n, bool) or not isinstance(n, int) or n < 0):
                raise ConfigError(f"{at}.{key} must be a non negative integer")
            places.append(n)
        out.append((name, *places))
    return base, out


def config_table(configs: DataFrame) -> DataFrame:
    """CONFIG rows of settings files (repo, content): one for each request function, one with a problem where a file is not
    valid, one with nothing but base_url where it names no function. Null contents are no files."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for repo, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    base, functions = parse_config(json.loads(content))
                    rows += [(repo, base, *f, None) for f in functions or [(None,) * 4]]
                except ValueError as e:
                    rows.append((repo, *[None] * 5, str(e)))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            names = [c.split()[0] for c in CONFIG.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return configs.filter("content IS NOT NULL").select(F.col("repo").cast("string").alias("repo"), "content").mapInArrow(run, CONFIG)


def read_config(spark: SparkSession, root: str, repo: str | None = None, name: str = CONFIG_NAME) -> DataFrame:
    """CONFIG rows of a project's settings file; none where it has no such file. Settings that are not valid raise ConfigError."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CONFIG)
    content = spark.read.text(path.toString(), wholetext=True).select(F.lit(repo if repo is not None else root).alias("repo"), F.col("value").alias("content"))
    found = config_table(content)
    bad = found.filter("problem IS NOT NULL").select("problem").first()
    if bad:
        raise ConfigError(bad[0])
    return found
