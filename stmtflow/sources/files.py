"""Document files listed and read by tasks.

Spark's own file readers list on the driver and pass over files without content. Here the tree is listed by
jobs, one round per level of folders, so the driver sees neither folders nor files, only how many folders are left;
and the files are packed into tasks by their listed bytes, so that many small files share a task, empty ones are read like
any other, and a very large file has a task of its own. Folders and files are opened through ``pyarrow.fs``, which
knows local paths and the usual stores by their URI; for other stores there is ``documents.read_binary_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

TASK_BYTES = 64 << 20
FILE_COST = 1 << 20    # opening a file counts as so many bytes
BATCH_BYTES = 16 << 20  # of content in an output batch, or one file
LISTED = "path string, length bigint, modified timestamp"


def known_store(path: str) -> bool:
    """Whether ``pyarrow.fs`` can open the path."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(_uri(path))
    except Exception:  # noqa: BLE001 - unknown schemes and missing client libraries alike
        return False
    return True


def _uri(path: str) -> str:
    """Hadoop writes local URIs with one slash, Arrow reads them with three."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[len("file:"):]
    return path


def _opened(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(_uri(path))
    return store, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def list_files(spark: SparkSession, path: str, path_glob: str | None = None) -> DataFrame:
    """(path, length, modified) of all files below a folder, or of the one file; names that begin with ``_`` or ``.`` are left out.

    ``path_glob`` is matched against the file's name. Folders are listed in parallel, level by level; what was
    found is kept in the shared folder.
    """
    def listed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                store, inner, prefix = _opened(folder)
                own = store.get_file_info(inner)
                found = store.get_file_info(fs.FileSelector(inner)) if own.type == fs.FileType.Directory else [own]
                for info in found:
                    if info.type == fs.FileType.NotFound:
                        raise FileNotFoundError(folder)
                    is_folder = info.type == fs.FileType.Directory
                    if info is own or not info.base_name.startswith(("_", ".")) and (
                            is_folder or path_glob is None or fnmatchcase(info.base_name, path_glob)):
                        rows.append((prefix + info.path, None if is_folder else info.size, info.mtime, is_folder))
            cols = list(zip(*rows)) or [()] * 4
            types = (pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["path", "length", "modified", "folder"])

    folders, files = spark.createDataFrame([(path,)], "path string"), None
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        found = cut(folders.mapInArrow(listed, f"{LISTED}, folder boolean"))
        here = found.where("NOT folder").drop("folder")
        files = here if files is None else files.unionByName(here)
        folders = found.where("folder").select("path")
        if folders.isEmpty():
            return files
        folders = folders.repartition(n)


def packed(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``files`` with ``bin``: files of one bin are read by one task, about ``task_bytes`` of content and opening together."""
    cost = F.col("length") + FILE_COST
    total = files.agg(F.sum(cost)).first()[0] or 0
    bins = max(1, -(-total // task_bytes))
    # Sizes are summed up within as many hash parts as there are bins; each part's running sum is cut at full tasks.
    parted = files.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(bins)))
    before = Window.partitionBy("_part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    step = F.floor(F.coalesce(F.sum(cost).over(before), F.lit(0)) / task_bytes)
    return parted.withColumn("bin", F.xxhash64("_part", step)).drop("_part")


def read_files(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, length, modified, content) of every listed file, whole; ``length`` is that of the content."""
    spark = files.sparkSession

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def record(held: list) -> pa.RecordBatch:
            cols = list(zip(*held))
            types = (pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["path", "length", "modified", "content"])

        held, size = [], 0
        for batch in batches:
            for path, modified in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, inner, _ = _opened(path)
                with store.open_input_stream(inner) as stream:
                    content = stream.read()
                held.append((path, len(content), modified, content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield record(held)
                    held, size = [], 0
        if held:
            yield record(held)

    binned = packed(files, task_bytes)
    n = max(1, binned.select("bin").distinct().count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return binned.repartition(n, "bin").select("path", "modified").mapInArrow(read, "path string, length bigint, modified timestamp, content binary")
