"""File sources: repository scan, Markdown sections, status lines."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.text import extension, glob_regex
from waymark.sources.walk import contents, walk

# Folders, suffixes and extensions of a repository scan.
SKIP_DIRS = (
    ".git", "node_modules", "dist", "target", "build", "out", ".pylibs",
    "test-results", "playwright-report", "blob-report", "uploads",
    "__pycache__", ".venv", "venv", ".idea", ".vscode", "coverage",
    ".next", ".angular", "shots", "preview-page",
)
SKIP_SUFFIXES = (".min.js", ".min.css", ".map", ".lock", "-lock.json")
SECRET_FILES = (".env",)
SOURCE_EXTS = (
    ".java", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py",
    ".go", ".rs", ".cs", ".rb", ".php", ".swift", ".kt", ".kts",
    ".scala", ".dart", ".ex", ".exs", ".cpp", ".cc", ".cxx", ".h",
    ".hpp", ".c", ".vue", ".svelte", ".sql", ".properties", ".yml",
    ".yaml", ".toml", ".ini", ".cfg", ".json", ".xml", ".html",
    ".css", ".md", ".http", ".proto", ".graphql", ".gql",
)
CONFIG_NAMES = ("Dockerfile", "docker-compose.yml", "Makefile", "go.mod", "Cargo.toml", "pom.xml", "package.json", "requirements.txt")
MAX_FILE_BYTES = 1024 * 1024


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern names the path: `dir/` a prefix, with * a glob over the whole path, else equal."""
    out = F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            out = out | path.startswith(p) | (path == p[:-1])
        elif "*" in p:
            out = out | path.rlike(glob_regex(p))
        else:
            out = out | (path == p)
    return out


def wanted(path: Column, length: Column, skip_dirs: tuple[str, ...] = SKIP_DIRS, patterns: list[str] | None = None,
           max_bytes: int = MAX_FILE_BYTES) -> Column:
    """The scan's filter on path and length; it needs no content, so it holds before a file is read."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    bad_end = F.lit(False)
    for s in SKIP_SUFFIXES:
        bad_end = bad_end | name.endswith(s)
    known = extension(path).isin(*SOURCE_EXTS) | name.isin(*CONFIG_NAMES)
    skipped = F.exists(folders, lambda d: d.isin(*skip_dirs) | d.startswith(".shots"))
    return known & ~name.isin(*SECRET_FILES) & ~bad_end & ~skipped & (length <= max_bytes) & ~ignored(path, patterns or [])


def small_file(spark: SparkSession, path: str) -> str:
    """The text of one small file beside the sources, hidden ones included; empty if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return ""
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def scan_config(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """(ignore patterns, most bytes) of a JSON configuration; the defaults where it is missing or no
    object, or where a value has another type."""
    try:
        config = json.loads(small_file(spark, path) or "{}")
    except ValueError:
        config = {}
    config = config if isinstance(config, dict) else {}
    patterns, most = config.get("ignore"), config.get("max_file_bytes")
    patterns = [p for p in patterns if isinstance(p, str)] if isinstance(patterns, list) else []
    return patterns, most if isinstance(most, int) and most > 0 else MAX_FILE_BYTES


def own_prefixes(root: str, install: str | None = None) -> list[str]:
    """Path prefixes of this engine's own install, as ignore patterns, where it lies below ``root``."""
    install = install or os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    rel = os.path.relpath(install, os.path.abspath(root)).replace(os.sep, "/")
    return [] if rel == "." or rel == ".." or rel.startswith("../") else [rel.rstrip("/") + "/"]


def scan_tree(spark: SparkSession, root: str, map_dir: str | None = None) -> DataFrame:
    """scan() as a map is built: with the folder names of the root's .gitignore, the patterns and the
    size of the map's configuration, and without the map's and this engine's own folders."""
    patterns, most = scan_config(spark, f"{root}/{map_dir}/config.json") if map_dir else ([], MAX_FILE_BYTES)
    lines = [(x,) for x in small_file(spark, f"{root}/.gitignore").splitlines()]
    ignore = [r["name"] for r in gitignore_dirs(spark.createDataFrame(lines, "value string")).collect()]
    folders = (*SKIP_DIRS, *ignore, *([map_dir.split("/")[0]] if map_dir else []))
    return scan(spark, root, patterns + own_prefixes(root), most, folders)


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES,
         skip_dirs: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """(path, length, content, sha256) of the wanted files below ``root``. Skipped folders are never
    listed, and only wanted files are opened. Files and folders with a leading dot or underscore count."""
    seen = walk(spark, root, skip_dirs, (".shots",))
    files = seen.where(~F.col("folder") & wanted(F.col("path"), F.col("length"), skip_dirs, patterns, max_bytes))
    return contents(files.select("path", "length"), root).select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def gitignore_dirs(text: DataFrame) -> DataFrame:
    """(name): entries of a .gitignore (value) without slash inside and without *; no negations."""
    line = F.trim("value")
    name = F.rtrim(line, F.lit("/"))
    return text.where((line != "") & ~line.startswith("#") & ~line.startswith("!") & ~name.contains("/") & ~name.contains("*")).select(name.alias("name")).distinct()


def lines_of(docs: DataFrame) -> DataFrame:
    """(path, line, text) with 1-based lines; a last empty line is none."""
    pieces = F.split("text", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    pieces = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return docs.select("path", F.posexplode(pieces).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")


def markdown_sections(docs: DataFrame) -> DataFrame:
    """(path, line, text, level, title, heading_line, in_fence): each line with the heading above it."""
    rows = lines_of(docs)
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("text").rlike(r"^\s*```")
    rows = rows.withColumn("in_fence", (F.sum(fence.cast("int")).over(upto) % 2 == 1) | fence)
    head = F.when(~F.col("in_fence") & F.col("text").rlike(r"^#{1,6}\s+\S"), F.struct(
        F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"),
        F.trim(F.regexp_extract("text", r"^#+\s+(.*)$", 1)).alias("title"), F.col("line").alias("at"),
    ))
    rows = rows.withColumn("h", F.last(head, ignorenulls=True).over(upto))
    return rows.select("path", "line", "text", "h.level", "h.title", F.col("h.at").alias("heading_line"), "in_fence")


def porcelain_path(line: Column) -> Column:
    """Path of a status line (format v1); a rename gives its destination; quoted names are unquoted,
    octal escapes decoded. Null for anything else."""
    body = F.substring_index(F.substring(line, 4, 1 << 30), " -> ", -1)
    quoted = body.startswith('"') & body.endswith('"') & (F.length(body) >= 2)
    inner = F.regexp_replace(F.substring(body, 2, 1 << 30), '"$', "")
    pieces = F.regexp_extract_all(inner, F.lit(r"(\\[0-3][0-7]{2}|\\.|[^\\]+)"), F.lit(1))
    # Bytes in hex: an octal escape is one byte, other escapes name a character.
    byte = lambda p: F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0")
    text = lambda p: F.hex(F.encode(F.when(p == "\\t", "\t").when(p == "\\n", "\n").when(p.startswith("\\"), F.substring(p, 2, 1)).otherwise(p), "UTF-8"))
    hexed = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\\[0-3][0-7]{2}$"), byte(p)).otherwise(text(p))), "")
    decoded = F.decode(F.unhex(hexed), "UTF-8")
    ok = (F.length(line) >= 4) & (F.substring(line, 3, 1) == " ")
    return F.when(ok, F.when(quoted, decoded).otherwise(body))
