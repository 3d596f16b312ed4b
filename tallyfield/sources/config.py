"""Where data lies: local folders, object stores or FTP, as Hadoop URIs."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import SparkSession


class SourceError(ValueError):
    """A source that is described incompletely."""


@dataclass(frozen=True)
class SourceConfig:
    """source: filesystem, s3 or ftp, with what each needs. Folders may use | for /."""

    source: str = "filesystem"
    folder: str | None = None
    bucket: str | None = None
    access_key_id: str | None = None
    secret_access_key: str | None = None
    s3_host: str | None = None
    s3_port: int | None = None
    ftp_host: str | None = None
    ftp_user: str | None = None
    ftp_pass: str | None = None

    def validate(self) -> SourceConfig:
        needs = {"filesystem": ("folder",), "s3": ("bucket", "access_key_id", "secret_access_key"), "ftp": ("ftp_host", "ftp_user", "ftp_pass")}
        if self.source not in needs:
            raise SourceError(f"unknown source {self.source!r}")
        if missing := [n for n in needs[self.source] if not getattr(self, n)]:
            raise SourceError(f"source {self.source} needs {', '.join(missing)}")
        return self

    def uri(self, *parts: str) -> str:
        """A path that Spark can open."""
        self.validate()
        folder = (self.folder or "").replace("|", "/")
        tail = "/".join(str(PurePosixPath(p)) for p in parts)
        if self.source == "s3":
            return "/".join(x for x in (f"s3a://{self.bucket}", folder.strip("/"), tail) if x)
        if self.source == "ftp":
            return "/".join(x for x in (f"ftp://{self.ftp_host}", folder.strip("/"), tail) if x)
        return "/".join(x for x in (folder.rstrip("/"), tail) if x)

    def options(self) -> dict[str, str]:
        """Hadoop settings of the source."""
        if self.source == "s3":
            out = {"fs.s3a.access.key": self.access_key_id, "fs.s3a.secret.key": self.secret_access_key}
            if self.s3_host:
                out["fs.s3a.endpoint"] = f"{self.s3_host}:{self.s3_port}" if self.s3_port else self.s3_host
                out["fs.s3a.path.style.access"] = "true"
            return out
        if self.source == "ftp":
            return {f"fs.ftp.user.{self.ftp_host}": self.ftp_user, f"fs.ftp.password.{self.ftp_host}": self.ftp_pass}
        return {}

    def apply(self, spark: SparkSession) -> SourceConfig:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for k, v in self.options().items():
            conf.set(k, v)
        return self


def split_list(text: str | None) -> list[str]:
    """Items of a list written with |."""
    return [x.strip() for x in (text or "").split("|") if x.strip()]


def _fs(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = _fs(spark, uri)
    return fs.exists(path)


def list_files(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Names in a folder that begin with ``prefix``, without ``prefix.csv`` itself, in order."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n for n in names if n.startswith(prefix) and n != f"{prefix}.csv")


def read_json_config(spark: SparkSession, uri: str) -> dict:
    """A small JSON document."""
    text = "\n".join(r[0] for r in spark.read.text(uri, wholetext=True).collect())
    return json.loads(text)


def locked(spark: SparkSession, folder: str) -> bool:
    """Whether a write.lock asks writers to leave the folder alone."""
    return exists(spark, f"{folder.rstrip('/')}/write.lock")
