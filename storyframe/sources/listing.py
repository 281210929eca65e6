"""Listings of upload folders."""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyframe.functions import text as T
from storyframe.session import cut_lineage

# Video suffixes in the order in which their files are taken.
VIDEO_ORDER = {".mp4": 0, ".mov": 1}
LISTED = "*.{mp4,mov,srt}"
# Names in one batch of a listing.
ROWS = 10_000


def qualified(spark: SparkSession, path: str) -> str:
    """`path` with its scheme, as Spark writes the paths of files."""
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString().rstrip("/")


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, and the path in it."""
    return fs.FileSystem.from_uri("/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri)


def hidden(name: str, is_folder: bool) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    odd = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return odd and not (is_folder and name.startswith(("_common_metadata", "_metadata")))


def named_like(name: str, pattern: str) -> bool:
    """Whether a name matches a pattern with `*`, `?`, `[..]` and one list of endings or the like in braces."""
    head, brace, rest = pattern.replace("[^", "[!").partition("{")
    inside, _, tail = rest.partition("}")
    return any(fnmatchcase(name, head + option + tail) for option in (inside.split(",") if brace else [""]))


def entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """What is in a folder and not hidden, one after the other: names and bytes, which are None for a folder within.

    Of a local folder no list is made, so it may have any number of files. A folder or file that has gone is left out.
    """
    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            is_folder = info.type == fs.FileType.Directory
            if not hidden(info.base_name, is_folder):
                yield info.base_name, None if is_folder else info.size
        return
    try:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    is_folder = entry.is_dir()
                    if not hidden(entry.name, is_folder):
                        yield entry.name, None if is_folder else entry.stat().st_size
                except FileNotFoundError:
                    continue
    except FileNotFoundError:
        return


def files_below(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """`path, length` of the files below `path`, in folders of any depth, whose names are like `pattern`; a written table.

    Folders are listed by tasks, those of one depth at a time, and the driver holds none of them.
    """
    root = qualified(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        for batch in batches:
            rows = ((f"{folder}/{name}", length) for folder in batch.column(0).to_pylist()
                    for name, length in entries(system, base + folder[len(root):])
                    if length is None or named_like(name, pattern))
            while some := list(islice(rows, ROWS)):
                paths, lengths = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], ["path", "length"])

    system, base = file_system(root)
    if system.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    folders, found = spark.createDataFrame([(root,)], "path string"), []
    while True:
        found.append(cut_lineage(folders.mapInArrow(run, "path string, length bigint")))
        folders = found[-1].filter("length IS NULL").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, found).filter("length IS NOT NULL")
        folders = folders.repartition(4 * spark.sparkContext.defaultParallelism, "path")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Files of `<path>/<media_id>/`, none of deeper folders; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", LISTED).option("recursiveFileLookup", True)
    return listing(files.load(path).select("path", "length", "modificationTime"), qualified(spark, path))


def listing(files: DataFrame, root: str) -> DataFrame:
    """`media_id` and `name` of the files whose path is `<root>/<media_id>/<name>`."""
    below = F.substring("path", len(root) + 2, 2**31 - 1)
    inside = F.startswith("path", F.lit(f"{root}/")) & below.rlike("^[^/]+/[^/]+$")
    return files.filter(inside).withColumns({
        "media_id": F.regexp_extract(below, "^([^/]+)/", 1), "name": T.file_name(F.col("path"))})


def list_folders(works: DataFrame, path: str) -> DataFrame:
    """`media_id, found, name, length`: a row per file of each work's folder `<path>/<media_id>`, and one per folder.

    The row of a folder has no name; `found` tells whether it is there. Each task lists the folders of its works, so no list of
    all folders or files is ever in one place. Folders within a folder are not entered, and any file name counts.
    """
    root = qualified(works.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        for batch in batches:
            rows: list[tuple] = []
            for media_id in batch.column(0).to_pylist():
                folder = f"{base}/{media_id}"
                found = system.get_file_info(folder).type == fs.FileType.Directory
                rows.append((media_id, found, None, None))
                if found:
                    rows += [(media_id, True, info.base_name, info.size) for info in system.get_file_info(
                        fs.FileSelector(folder)) if info.type == fs.FileType.File]
            columns = zip(*rows, strict=True) if rows else ([],) * 4
            types = (pa.string(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             ["media_id", "found", "name", "length"])

    ids = works.select(F.col("media_id").cast("string").alias("media_id")).distinct()
    return ids.mapInArrow(run, "media_id string, found boolean, name string, length bigint")


def videos(files: DataFrame) -> DataFrame:
    """Video files with stem, suffix, sequence number and the rank of their suffix; suffixes count by case."""
    ext = T.file_ext(F.col("name"))
    rank = F.when(ext == ".mp4", VIDEO_ORDER[".mp4"]).when(ext == ".mov", VIDEO_ORDER[".mov"])
    named = files.withColumns({"stem": T.file_stem(F.col("name")), "ext": ext, "ext_rank": rank})
    return named.filter("ext_rank IS NOT NULL").withColumn("sequence_number", T.stem_number(F.col("stem")))


def video_counts(files: DataFrame) -> DataFrame:
    """Number of videos found per work."""
    return videos(files).groupBy("media_id").agg(F.count(F.lit(1)).alias("n_videos"))


def subtitles(files: DataFrame) -> DataFrame:
    """Subtitle files by the stem they belong to."""
    return files.filter(F.col("name").endswith(".srt")).select(
        "media_id", F.regexp_replace("name", r"\.srt$", "").alias("stem"), F.col("name").alias("srt_name"))
