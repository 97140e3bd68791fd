"""Headers of binary model files, by a data source that reads the first bytes of each file only."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from likeness.runtime import ship

# Fixed values of the file format: magic, version, flags, checksum of these, length of what follows; big-endian.
MAGIC, HEADER, VERSION, COMPRESSED = b"FRCM", 28, 1, 1
SCHEMA = "path string, size long, is_model boolean, version int, compressed boolean, data_length long, problem string"
#: Files of one task.
PER_TASK = 2000


def parsed(head: bytes) -> tuple[bool, int | None, bool | None, int | None, str | None]:
    """is_model, version, compressed, data_length, and what is wrong with the header, if anything."""
    if len(head) < HEADER:
        return False, None, None, None, "too short"
    if head[:4] != MAGIC:
        return False, None, None, None, "other magic"
    version, flags, check, length = struct.unpack(">iiqq", head[4:HEADER])
    wrong = "unsupported version" if version > VERSION else "checksum mismatch" if check != zlib.crc32(head[:12]) else None
    return True, version, bool(flags & COMPRESSED), length, wrong


def _opened(uri: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


@dataclass
class _Files(InputPartition):
    root: str
    files: list[tuple[str, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.root, self.only = options["path"], options.get("onlymodels", "false").lower() == "true"
        self.suffix = options.get("suffix", "")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, at = _opened(self.root)
        if system.get_file_info(at).type == fs.FileType.File:
            found = [system.get_file_info(at)]
        else:
            found = system.get_file_info(fs.FileSelector(at, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix))
        return [_Files(self.root, files[i : i + PER_TASK]) for i in range(0, len(files), PER_TASK)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _opened(partition.root)
        for path, size in partition.files:
            try:
                with system.open_input_file(path) as f:
                    row = parsed(f.read(HEADER))
            except OSError as e:
                row = (False, None, None, None, f"unreadable: {type(e).__name__}")
            if row[0] or not self.only:
                yield (path, size, *row)


class ModelHeaders(DataSource):
    """``path``: a file or a folder, local or of any store that Arrow opens; ``suffix``; ``onlyModels``: leave out files of another magic."""

    @classmethod
    def name(cls) -> str:
        return "model_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def model_headers(spark: SparkSession, path: str, suffix: str = "", only_models: bool = False) -> DataFrame:
    """A row for each file under ``path`` with what its header says; 28 bytes of a file are read, whatever its size.

    A file that is too short, has another magic or cannot be opened stays with its
    ``problem``; a folder without files gives no rows.
    """
    ship(spark)
    spark.dataSource.register(ModelHeaders)
    return spark.read.format("model_headers").option("suffix", suffix).option("onlyModels", str(only_models)).load(path)
