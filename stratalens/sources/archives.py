"""Archives of documents, read by Spark: listing, members, revisions, and plain trees.

Archives are read as binary files, one task per file, and unpacked in memory; nothing is
written to a local disk. An archive is a unit of work, so corpora should keep them to what a
task can hold.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators.filters import Refused
from ..operators.revisions import parse_labels

MEMBERS = "archive string, path string, size long, content binary, problem string"


def archives_in(spark: SparkSession, directory: str, suffix: str = ".zip") -> DataFrame:
    """Every archive of a directory: (archive, name, size), refused if there is none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(directory)
    out = found.select(F.col("path").alias("archive"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))
    if out.isEmpty():
        raise Refused(f"{directory} holds no archive")
    return out


def members(spark: SparkSession, directory: str, suffix: str = ".zip") -> DataFrame:
    """Members of every archive; a damaged or empty one is a row with its problem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(directory).select("path", "content")

    def run(batches):
        for b in batches:
            for archive, content in zip(b.column(0), b.column(1)):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        for info in sorted(z.infolist(), key=lambda i: i.filename):
                            if not info.is_dir():
                                rows.append((archive.as_py(), info.filename, info.file_size, z.read(info), None))
                    problem = None if rows else "empty archive"
                except (zipfile.BadZipFile, OSError, RuntimeError, EOFError) as e:
                    problem = f"unreadable archive: {str(e)[:100]}"
                if problem:
                    rows.append((archive.as_py(), None, None, None, problem))
                kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["archive", "path", "size", "content", "problem"])

    return files.mapInArrow(run, MEMBERS)


def ending_with(found: DataFrame, suffix: str) -> DataFrame:
    return found.filter(F.endswith("path", F.lit(suffix))).orderBy("path")


def revisions_in(spark: SparkSession, directory: str) -> DataFrame:
    """Archives with a version label in their name, in the order of the labels."""
    named = archives_in(spark, directory)
    return named.join(parse_labels(named.select("name")), "name").orderBy("major", "minor")


def documents(spark: SparkSession, directory: str, suffix: str = ".md") -> DataFrame:
    """(revision, path, text) of the documents in every labelled archive, first segment cut."""
    found = members(spark, directory).filter(F.endswith("path", F.lit(suffix)))
    label = F.regexp_extract(F.element_at(F.split("archive", "/"), -1), r"(v[0-9]+\.[0-9]+)", 1)
    return found.select(label.alias("revision"), X.strip_first_segment("path").alias("path"), F.decode("content", "UTF-8").alias("text")).filter("revision <> ''")


def volumes(documents_df: DataFrame, prefix: str = "domain-volumes/") -> DataFrame:
    return documents_df.filter(F.startswith("path", F.lit(prefix)))


def text_tree(spark: SparkSession, root: str, known: dict[str, str]) -> DataFrame:
    """Files under a root whose extension is known: (path, language, text)."""
    from ..operators.filters import by_extension

    out = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return by_extension(out, known)
