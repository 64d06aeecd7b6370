"""Places that need credentials: a handle of a path, and what Spark's file systems have to know to reach it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Place:
    """A path on a local or shared file system, or in an object store with its region and key. Keys are not shown."""

    path: str
    region: str | None = None
    key_id: str | None = field(default=None, repr=False)
    key: str | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if not self.path:
            raise ValueError("a place needs a path")
        if any(v is not None for v in self.credentials) and (None in self.credentials or not self.in_store):
            raise ValueError("credentials are a region, a key's id and the key, of a path in an object store")

    @property
    def credentials(self) -> tuple[str | None, str | None, str | None]:
        return self.region, self.key_id, self.key

    @property
    def in_store(self) -> bool:
        return self.path.split("://")[0] in ("s3", "s3a", "s3n")

    @property
    def url(self) -> str:
        """The path as Hadoop's file systems name it."""
        return "s3a://" + self.path.split("://", 1)[1] if self.in_store else self.path

    def conf(self) -> dict[str, str]:
        """Hadoop settings of this place's bucket alone."""
        if self.region is None:
            return {}
        bucket = self.url.removeprefix("s3a://").split("/", 1)[0]
        return {f"fs.s3a.bucket.{bucket}.{k}": v for k, v in zip(("endpoint.region", "access.key", "secret.key"), self.credentials, strict=True)}

    def open(self, spark: SparkSession) -> str:
        """Make the place known to the session; returns the path to read or write."""
        for k, v in self.conf().items():
            spark._jsc.hadoopConfiguration().set(k, v)
        return self.url

    def close(self, spark: SparkSession) -> None:
        for k in self.conf():
            spark._jsc.hadoopConfiguration().unset(k)
