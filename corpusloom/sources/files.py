"""File sources: inventories, pages, text, XML text, parser hooks."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import constants as K
from ..functions import paths as P
from ..plans.ranking import global_rank
from ..session import scratch_path

C = F.lit


def _plain(path) -> Column:
    """File URI to path: scheme dropped, percent escapes decoded."""
    bare = F.regexp_replace(path, "^[a-z0-9]+:/+", "/")
    return bare


def _decoded(path) -> Column:
    return F.url_decode(F.replace(_plain(path), C("+"), C("%2B")))


def _hidden(spark: SparkSession, root: str) -> tuple[list[str], list]:
    """(folders, file states) below root whose name starts with ``_`` or ``.``.

    Spark's readers pass over such names. Only names are listed here, level by
    level.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    every = lambda pattern: fs.globStatus(jvm.org.apache.hadoop.fs.Path(pattern)) or []
    folders, files, level = [], [], _escaped(root.rstrip("/"))
    while True:
        for s in every(level + "/{_,.}*"):
            if s.isDirectory():
                folders.append(s.getPath().toString())
            else:
                files.append(s)
        level += "/*"
        if not any(s.isDirectory() for s in every(level)):
            return folders, files


def _escaped(path: str) -> str:
    return "".join("\\" + c if c in "\\[]{}*?" else c for c in path)


def _binary(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime, content of all files below root.

    Files that Spark's readers pass over for their name are copied to the
    shared folder under plain names first.
    """
    folders, files = _hidden(spark, root)
    read = lambda paths: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    raw = read([_escaped(root), *map(_escaped, folders)]).select("path", "length", "modificationTime", "content")
    if not files:
        return raw
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place, rows = scratch_path(spark, "files"), []
    for i, s in enumerate(files):
        to = jvm.org.apache.hadoop.fs.Path(f"{place}/f{i}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(s.getPath().getFileSystem(conf), s.getPath(), to.getFileSystem(conf), to, False, conf)
        rows.append((f"f{i}", s.getPath().toString(), s.getModificationTime()))
    names = spark.createDataFrame(rows, "copy string, own string, ms long")
    copies = read(place).withColumn("copy", P.basename("path")).join(F.broadcast(names), "copy").select(
        F.col("own").alias("path"), "length", F.timestamp_millis("ms").alias("modificationTime"), "content")
    return raw.unionByName(copies)


def inventory(spark: SparkSession, root: str, hashes: bool = True) -> DataFrame:
    """path, rel_path, name, ext, kind, size, modified (md5, sha256) of files.

    kind: parseable, image, unsupported, or hidden (dot-files no parser
    takes). Without hashes the contents are not read. Files and folders that
    start with ``_`` or ``.`` are listed like others.
    """
    raw = _binary(spark, root)
    ext = P.suffix("path")
    kind = (
        F.when(ext.isin(K.PARSEABLE_EXTS), "parseable").when(ext.isin(K.IMAGE_EXTS), "image")
        .when(F.startswith(P.basename("path"), C(".")), "hidden").otherwise("unsupported"))
    cols = [
        "path", P.relative_to("path", C(root)).alias("rel_path"), P.basename("path").alias("name"), ext.alias("ext"),
        kind.alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if hashes:
        cols += [F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256")]
    return raw.withColumn("path", _plain("path")).select(*cols)


def sorted_inventory(files: DataFrame) -> DataFrame:
    """Adds ``rn``: the place of a file in a sorted walk of the folders."""
    return global_rank(files.withColumn("_walk", P.walk_order("rel_path")), ["_walk"]).drop("_walk")


def vault_pages(spark: SparkSession, root: str, exclude: list[str] = K.MOC_EXCLUDE_DIRS) -> DataFrame:
    """rel_path, path, note_name, content of all Markdown pages below root.

    exclude: folders left out; each consumer has its own set in ``constants``.
    Dot folders are left out always.
    """
    folders = [f for f in _hidden(spark, root)[0] if "/." not in f[len(root):]]
    raw = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
        .text([_escaped(root), *map(_escaped, folders)], wholetext=True)
        .select(_decoded("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )
    pages = raw.withColumn("rel_path", P.relative_to("path", C(root)))
    return pages.filter(~P.excluded("rel_path", exclude)).select(
        "rel_path", "path", P.stem("path").alias("note_name"), "content")


def text_files(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """path, text of whole files, trimmed; CSV files are text here."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
        .select(_decoded("_metadata.file_path").alias("path"), P.strip("value").alias("text"))
    )


# ---- bytes to text -----------------------------------------------------------------

def decode_bytes(raw: bytes) -> str:
    for code in ("utf-8", "gbk"):
        try:
            return raw.decode(code).strip()
        except UnicodeDecodeError:
            pass
    return ""


def _harvest(elem) -> Iterator[str]:
    """Texts of an element tree; a text element gives its subtree's twice."""
    yield elem.text or ""
    if "text" in elem.tag:
        for part in elem.iter():
            yield part.text or ""
    for child in elem:
        yield from _harvest(child)


def xml_text(raw: bytes) -> str:
    """All element texts of XML, one per line; '' when it is malformed."""
    try:
        found = (t.strip() for t in _harvest(ET.fromstring(raw)))
        return "\n".join(t for t in found if t)
    except Exception:
        return ""


@F.pandas_udf(StringType())
def decode_any(content: pd.Series) -> pd.Series:
    return content.map(lambda b: decode_bytes(bytes(b)))


def binary_text(content) -> Column:
    """UTF-8 text stays in the JVM; only other bytes go to Python (GBK)."""
    c = F.col(content) if isinstance(content, str) else content
    good = F.is_valid_utf8(c.cast("string"))
    return F.when(good, P.strip(c.cast("string"))).otherwise(C(None))


def decode_files(files: DataFrame) -> DataFrame:
    """Adds ``text`` to files with a ``content`` column."""
    text = files.withColumn("text", binary_text("content"))
    return text.filter("text IS NOT NULL").unionByName(
        text.filter("text IS NULL").withColumn("text", decode_any("content")))


Parser = Callable[[bytes], str]
PARSERS: dict[str, Parser] = {
    ".md": decode_bytes, ".markdown": decode_bytes, ".csv": decode_bytes, ".svg": xml_text,
}


def parse_files(files: DataFrame, parsers: dict[str, Parser] = PARSERS) -> DataFrame:
    """path, ext, text, error of files with an extension some parser takes.

    files: path, ext, content. A parser is any function from bytes to text;
    an error stays with its file. Other extensions are dropped before Python.
    """

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors = [], []
            for ext, raw in zip(pdf["ext"], pdf["content"]):
                try:
                    texts.append(parsers[ext](bytes(raw)))
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": pdf["path"], "ext": pdf["ext"], "text": texts, "error": errors}).astype(object)

    picked = files.filter(F.col("ext").isin(list(parsers))).select("path", "ext", "content")
    return picked.mapInPandas(step, "path string, ext string, text string, error string")


def read_contents(spark: SparkSession, root: str) -> DataFrame:
    """path, rel_path, ext, content of all files below root."""
    raw = _binary(spark, root).withColumn("path", _plain("path"))
    return raw.select("path", P.relative_to("path", C(root)).alias("rel_path"), P.suffix("path").alias("ext"), "content")
