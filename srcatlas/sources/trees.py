"""Source trees: which files there are, and their bytes.

Listing and reading are two steps. Listing is spread over directories and yields
paths only; between the two the optimiser applies the language filter, and the
paths are spread over all tasks anew, so that a large repository or directory
is read by many. Spark's own file listing is of no use here: it hides names
that start with a dot or an underscore.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas import rules
from srcatlas.functions import columns as C
from srcatlas.session import cut

# Entries a task lists before it hands the directories it has not seen back.
ENTRIES_PER_TASK = 200_000

# Bytes a task reads.
BYTES_PER_TASK = 128 << 20

_LISTED = "repo string, root string, path string, size bigint, is_dir boolean"


def _entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    """(name, size, is directory) of a folder; links are entries, not followed."""
    if "://" not in folder:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    is_dir = entry.is_dir(follow_symlinks=False)
                    size = 0 if is_dir else entry.stat(follow_symlinks=False).st_size
                except OSError:
                    continue  # gone, or not to be looked at
                yield entry.name, size, is_dir
        return
    filesystem, base = pafs.FileSystem.from_uri(folder)
    for info in filesystem.get_file_info(pafs.FileSelector(base)):
        yield info.base_name, info.size or 0, info.type == pafs.FileType.Directory


def _walk(ignored: list[str], budget: int):
    """Lists folders depth first; what is over the budget comes back as folders to do."""
    skip = set(ignored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["repo", "root", "path", "size", "is_dir"]
            )
            rows.clear()
            return batch

        seen = 0
        for batch in batches:
            for row in batch.to_pylist():
                todo = [row["path"]]
                while todo:
                    folder = todo.pop()
                    if seen >= budget:
                        rows.append((row["repo"], row["root"], folder, 0, True))
                        continue
                    full = row["root"].rstrip("/") + "/" + folder if folder else row["root"]
                    for name, size, is_dir in _entries(full):
                        seen += 1
                        path = f"{folder}/{name}" if folder else name
                        if not is_dir:
                            rows.append((row["repo"], row["root"], path, size, False))
                        elif name not in skip:
                            todo.append(path)
                        if len(rows) >= 10_000:
                            yield flush()
            # A task lists at least one folder, so every round gets on.
        yield flush()

    return run


def list_files(
    roots: DataFrame, ignore_dirs: dict[str, bool] | None = None, entries_per_task: int = ENTRIES_PER_TASK
) -> DataFrame:
    """All files below each root: repo, root, path (relative, with slashes), size.

    ``roots``: repo, root. A root that does not exist is an error. Folders named in
    the ignore list are not entered; a root is entered whatever its name. Each task
    lists up to ``entries_per_task`` entries; the folders left over are spread over
    all tasks for another round, so a lopsided tree does not stay with one task. Each
    round may list twice as many as the one before: the number of rounds, and with it
    what they report to the driver, grows with the logarithm of the entries.
    """
    spark = roots.sparkSession
    ignored = rules.ignored_dir_names(ignore_dirs)
    todo = roots.select("repo", "root", F.lit("").alias("path"), F.lit(0).cast("bigint").alias("size"), F.lit(True).alias("is_dir"))
    found = spark.createDataFrame([], _LISTED)
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    budget = entries_per_task
    while True:
        spread = todo.repartition(tasks, F.xxhash64("root", "path"))
        listed = cut(spread.mapInArrow(_walk(ignored, budget), _LISTED))
        budget *= 2
        found = found.unionByName(listed.filter(~F.col("is_dir")))
        todo = listed.filter("is_dir")
        if todo.isEmpty():
            return found.select("repo", "root", "path", "size")


def prune_dirs(files: DataFrame, ignore_dirs: dict[str, bool] | None = None) -> DataFrame:
    """Drop files below a folder of an ignored name, at any depth."""
    names = rules.ignored_dir_names(ignore_dirs)
    if not names:
        return files
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return files.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, names))))


def filter_languages(files: DataFrame, languages: list[str] | None) -> DataFrame:
    """Keep the named languages; none named means all, an unknown name matches nothing."""
    return files.filter(F.col("language").isin(list(languages))) if languages else files


def scan_inventory(
    files: DataFrame, languages: list[str] | None = None, ignore_dirs: dict[str, bool] | None = None
) -> DataFrame:
    """Adds ``language`` to files (repo, path, ...) and keeps those of a known, wanted one."""
    known = prune_dirs(files, ignore_dirs).withColumn("language", C.detect_language(F.col("path")))
    return filter_languages(known.filter("language <> 'unknown'"), languages)


# Bytes that fit a value of a table.
MOST_BYTES = (1 << 31) - 1


def _content(row: pa.RecordBatch, most: int) -> bytes:
    """The bytes of a file; OSError where it cannot be read or has more than ``most``."""
    full = row.column("root")[0].as_py().rstrip("/") + "/" + row.column("path")[0].as_py()
    if "://" in full:
        filesystem, name = pafs.FileSystem.from_uri(full)
        with filesystem.open_input_stream(name) as source:
            content = source.read(most + 1)
    else:
        with open(full, "rb") as source:
            content = source.read(most + 1)
    if len(content) > most:
        raise OSError(f"more than {most} bytes")
    return content


_ATTEMPT = "repo string, path string, language string, size bigint, content binary, reason string"


def _attempt(most: int):
    """Adds the bytes of each file, or the reason why it has none: it cannot be read, or is too large for a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                content = reason = None
                try:
                    content = _content(row, most)
                except OSError as e:
                    reason = e.strerror or str(e)
                yield pa.RecordBatch.from_arrays(
                    [row.column(c) for c in ("repo", "path", "language", "size")] + [pa.array([content], pa.binary()), pa.array([reason], pa.string())],
                    ["repo", "path", "language", "size", "content", "reason"],
                )

    return run


def _attempts(files: DataFrame, most: int) -> DataFrame:
    """Open every file of an inventory, in as many tasks as its bytes ask for."""
    # By bytes to read: the paths themselves are too small to tell how many tasks there should be.
    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, total // BYTES_PER_TASK + 1)
    spread = files.repartition(tasks, F.xxhash64("repo", "path"))
    return spread.select("repo", "root", "path", "language", "size").mapInArrow(_attempt(most), _ATTEMPT)


def read_source_files(
    roots: DataFrame,
    languages: list[str] | None = None,
    ignore_dirs: dict[str, bool] | None = None,
    include_content: bool = True,
    entries_per_task: int = ENTRIES_PER_TASK,
) -> DataFrame:
    """``source_files`` of the trees at ``roots`` (repo, root); without bytes if not wanted."""
    listed = list_files(roots, ignore_dirs, entries_per_task)
    files = scan_inventory(listed, languages, ignore_dirs)
    if not include_content:
        return files.select("repo", "path", "language", "size")
    return _attempts(files, MOST_BYTES).filter("reason IS NULL").drop("reason")


def read_once(
    roots: DataFrame, languages: list[str] | None = None, ignore_dirs: dict[str, bool] | None = None, most_bytes: int = MOST_BYTES
) -> tuple[DataFrame, DataFrame]:
    """What ``read_source_files`` and ``skipped_files`` give, as a written table: every file is opened once."""
    tried = cut(_attempts(scan_inventory(list_files(roots, ignore_dirs), languages, ignore_dirs), most_bytes))
    return tried.filter("reason IS NULL").drop("reason"), tried.filter("reason IS NOT NULL").select("repo", "path", "reason")


def skipped_files(
    roots: DataFrame, languages: list[str] | None = None, ignore_dirs: dict[str, bool] | None = None, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """repo, path, reason of the files that ``read_source_files`` leaves out; ``read_once`` tells both from one reading."""
    files = scan_inventory(list_files(roots, ignore_dirs), languages, ignore_dirs)
    return _attempts(files, most_bytes).filter("reason IS NOT NULL").select("repo", "path", "reason")


def read_source_table(
    spark: SparkSession, path: str, languages: list[str] | None = None, ignore_dirs: dict[str, bool] | None = None
) -> DataFrame:
    """``source_files`` from a Parquet table with repo, path and content."""
    files = spark.read.parquet(path)
    if "size" not in files.columns:
        files = files.withColumn("size", F.length("content").cast("bigint"))
    return scan_inventory(files, languages, ignore_dirs).select("repo", "path", "language", "size", "content")


def _ship_by_value() -> None:
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
