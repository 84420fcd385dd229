"""Connectors: what a source of claims offers, a registry of them, and a folder of files as a data source of Spark."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from . import extract, scan


@dataclass
class Metadata:
    type: str
    display_name: str
    description: str
    auth: str = "none"
    enabled: bool = True
    file_types: tuple[str, ...] = ()


@dataclass
class Tested:
    accessible: bool
    found: bool = False
    error: str | None = None
    details: dict = field(default_factory=dict)


class Connector(Protocol):
    """A source of claims: whether it can be reached, its files as a DataFrame, and the claims of these."""

    metadata: Metadata

    def test(self, spark: SparkSession, **options) -> Tested: ...

    def fetch(self, spark: SparkSession, **options) -> DataFrame: ...

    def claims(self, files: DataFrame) -> DataFrame: ...


class Registry:
    """Connectors by type, in any case."""

    def __init__(self) -> None:
        self._of: dict[str, Connector] = {}

    def register(self, connector: Connector) -> None:
        key = connector.metadata.type.lower()
        if key in self._of:
            raise ValueError(f"a connector for {connector.metadata.type} is registered already")
        self._of[key] = connector

    def get(self, kind: str) -> Connector | None:
        return self._of.get(kind.lower())

    def require(self, kind: str) -> Connector:
        found = self.get(kind)
        if found is None:
            raise LookupError(f"no connector for {kind}")
        return found

    def has(self, kind: str) -> bool:
        return kind.lower() in self._of

    def list(self) -> list[Metadata]:
        return [c.metadata for c in self._of.values()]

    def set_enabled(self, kind: str, enabled: bool) -> None:
        self.require(kind).metadata.enabled = enabled

    def health(self, spark: SparkSession, kind: str | None = None) -> DataFrame:
        """(type, status, accessible, error) of one connector or of all; one that raises is unhealthy."""
        rows = []
        for c in [self.require(kind)] if kind else self._of.values():
            try:
                got = c.test(spark)
            except Exception as e:  # whatever a connector raises is its state
                got = Tested(False, error=str(e))
            rows.append((c.metadata.type, "healthy" if got.accessible else "unhealthy", got.accessible, got.error))
        return spark.createDataFrame(rows, "type string, status string, accessible boolean, error string")

    def clear(self) -> None:
        self._of.clear()


class DocumentConnector:
    def __init__(self, roots: list[str] | None = None, max_bytes: int = scan.MAX_BYTES) -> None:
        self.roots, self.max_bytes = roots, max_bytes
        self.metadata = Metadata("document", "Documents", "Files of a folder", file_types=("md", "txt", "json", "yaml", "yml", "csv", "eml", "docx"))

    def test(self, spark: SparkSession, folder: str | None = None) -> Tested:
        if folder is None:
            return Tested(True)
        try:
            n = scan.listing(spark, folder).count()
        except Exception as e:  # a missing folder is an answer
            return Tested(False, error=str(e).split("\n")[0])
        return Tested(True, n > 0, details={"files": n})

    def fetch(self, spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
        files = scan.listing(spark, folder, glob)
        files = files.where(files["length"] <= self.max_bytes)
        if self.roots:
            files = files.where(scan.inside(files["path"], [scan._qualified(spark, r) for r in self.roots]))
        route = scan.document_route(files["path"])
        return files.withColumnRenamed("modificationTime", "modified").withColumn("route", route).where("route <> 'pdf'").select("path", "modified", "route", "content")

    def claims(self, files: DataFrame) -> DataFrame:
        return scan.routed_claims(files, self.max_bytes)


class RepositoryConnector:
    """Files of repositories out of a table (repository, path, content, encoding) that something else has fetched."""

    def __init__(self, table: str) -> None:
        self.table = table
        self.metadata = Metadata("github", "Repositories", "Files of repositories from a table", "optional", file_types=("package.json", "Dockerfile", "README", "workflows"))

    def test(self, spark: SparkSession, repository: str | None = None) -> Tested:
        rows = spark.read.parquet(self.table)
        return Tested(True, not (rows if repository is None else rows.where(rows["repository"] == repository)).isEmpty())

    def fetch(self, spark: SparkSession, repository: str | None = None) -> DataFrame:
        rows = spark.read.parquet(self.table)
        return rows if repository is None else rows.where(rows["repository"] == repository)

    def claims(self, files: DataFrame) -> DataFrame:
        return scan.repository_claims(files)


class WebsiteConnector:
    """Pages out of a table (page_id, url, html); urls that must not be fetched are left out."""

    def __init__(self, table: str) -> None:
        self.table = table
        self.metadata = Metadata("website", "Web pages", "Pages from a table", file_types=("html",))

    def test(self, spark: SparkSession) -> Tested:
        return Tested(True, not spark.read.parquet(self.table).isEmpty())

    def fetch(self, spark: SparkSession) -> DataFrame:
        pages = spark.read.parquet(self.table)
        return pages.where(extract.fetchable(pages["url"]))

    def claims(self, files: DataFrame) -> DataFrame:
        return extract.page_claims(files)


# --- a folder as a data source -----------------------------------------------------------------------------------


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


class FolderSource(DataSource):
    """``spark.read.format("claim_files").option("folder", ...).load()``: (path, extension, length, content) of files.

    Files are dealt to ``numPartitions`` readers by size. Filters on extension, length and the beginning of the path are taken over: a file that
    they rule out is not opened. ``maxBytes`` leaves larger files out. The folder may be a path or a URI that Arrow's file systems know.
    """

    @classmethod
    def name(cls) -> str:
        return "claim_files"

    def schema(self) -> str:
        return "path string, extension string, length long, content binary"

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        low = {k.lower(): v for k, v in options.items()}
        self.folder = low.get("folder") or low.get("path")
        if not self.folder:
            raise ValueError("the option folder is missing")
        self.parts = int(low.get("numpartitions", "8"))
        self.max_bytes = int(low.get("maxbytes", scan.MAX_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", None)
            if isinstance(f, (EqualTo, In)) and name in (("extension",), ("path",)) or isinstance(f, StringStartsWith) and name == ("path",) or isinstance(f, (LessThan, LessThanOrEqual)) and name == ("length",):
                self.filters.append(f)
            else:
                yield f

    def _kept(self, path: str, size: int) -> bool:
        own = {("path",): path, ("extension",): _extension(path), ("length",): size}
        for f in self.filters:
            x = own[f.attribute]
            if isinstance(f, EqualTo) and x != f.value or isinstance(f, In) and x not in f.value or isinstance(f, StringStartsWith) and not x.startswith(f.value):
                return False
            if isinstance(f, LessThan) and not x < f.value or isinstance(f, LessThanOrEqual) and not x <= f.value:
                return False
        return True

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder) if "://" in self.folder else (pafs.LocalFileSystem(), self.folder)

    def partitions(self) -> list[InputPartition]:
        fs, root = self._open()
        files = [(x.size, x.path) for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File and x.size <= self.max_bytes and self._kept(x.path, x.size)]
        dealt: list[list[str]] = [[] for _ in range(max(1, min(self.parts, len(files))))]
        load = [0] * len(dealt)
        for size, path in sorted(files, reverse=True):  # the largest first, each to the reader that has least
            k = load.index(min(load))
            dealt[k].append(path)
            load[k] += size + 4096
        return [_Files(tuple(x)) for x in dealt]

    def read(self, partition: _Files) -> Iterator[tuple]:
        fs, _ = self._open()
        for path in partition.paths:
            with fs.open_input_stream(path) as f:
                content = f.read()
            yield path, _extension(path), len(content), content


def _extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def register_formats(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
