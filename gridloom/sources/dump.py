"""Where arrays go that are written without a path, how they are written, and a log of them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from gridloom.model import GridArray
from gridloom.plans.geometry import CHUNK_LENGTH, chunk_shape
from gridloom.sources.store import CODECS, list_arrays, normal_name, write_array

LOG = "time timestamp, name string, path string, dim array<bigint>, type string, chunkdim array<bigint>, level int"


@dataclass
class Dump:
    """Settings of a session. Names are given once, and are unique over processes and machines."""

    folder: str
    chunk_length: int = CHUNK_LENGTH
    chunk_shape: str = "scale"
    level: int = 6
    #: One folder for all arrays, in place of one for each session's automatic names.
    fixed: str | None = None
    _name: str | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.set_level(self.level)

    def set_level(self, level: int) -> None:
        if level not in CODECS:
            raise ValueError(f"compression level {level}: 0 to 9")
        self.level = level

    def set_folder(self, folder: str) -> None:
        """Automatic places below another folder; a fixed one is given up."""
        self.folder, self.fixed = folder.rstrip("/"), None

    def set_file(self, path: str) -> None:
        """A fixed place for all arrays that follow; with a slash at its end it is a folder of automatic places."""
        if path.endswith("/"):
            self.set_folder(path)
        else:
            self.fixed = path

    @property
    def place(self) -> str:
        """Where the next array goes."""
        return self.fixed or self.folder

    def set_name(self, name: str | None) -> None:
        self._name = None if name is None else normal_name(name).lstrip("/")

    def name(self, for_use: bool = False) -> str:
        """The next name; asking does not use it up."""
        if self._name is None:
            self._name = f"auto-{uuid.uuid4().hex}"
        found = self._name
        if for_use:
            self._name = None
        return found

    def chunkdim(self, dim: tuple[int, ...]) -> tuple[int, ...]:
        return chunk_shape(dim, self.chunk_length, self.chunk_shape)

    def write(self, x: GridArray, as_sparse: bool | None = None) -> GridArray:
        spark, name = x.cells.sparkSession, self.name(for_use=True)
        out = write_array(x, f"{self.place}/{name}", None if x.is_sparse else self.chunkdim(x.dim), self.level, as_sparse)
        row = [(datetime.now(UTC).replace(tzinfo=None), name, f"{self.place}/{name}", list(out.dim), out.type, None if out.chunkdim is None else list(out.chunkdim), self.level)]
        spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/_log")
        return out

    def log(self, spark: SparkSession) -> DataFrame:
        from gridloom.sources.store import Files

        if not Files(spark).exists(f"{self.folder}/_log"):
            return spark.createDataFrame([], LOG)
        return spark.read.schema(LOG).parquet(f"{self.folder}/_log")

    def arrays(self, spark: SparkSession) -> DataFrame:
        return list_arrays(spark, self.place).where("kind = 'array'")
