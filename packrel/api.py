"""The public operations: create, extract, list and verify archives."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from packrel.config import CreationConfig, ExtractionOptions, SecurityConfig
from packrel.operators.verify import listed_entries, verify_entries
from packrel.sources.archive import read_archives
from packrel.sources.errors import ArchiveError
from packrel.sources.extract import ExtractionReport, extract_archive
from packrel.sources.writer import CreationReport, Progress, create_archive

__all__ = ["Archive", "ArchiveBuilder", "ArchiveCreator", "ArchiveError", "CreationConfig", "CreationReport", "ExtractionOptions", "ExtractionReport", "SecurityConfig", "create_archive", "extract_archive", "list_archives", "verify_archives"]


def list_archives(spark: SparkSession, path: str, config: SecurityConfig | None = None, strict: bool = False) -> DataFrame:
    """Entries of all archives under a path, each with the error for which a listing would stop there.

    strict: raise the first of these errors.
    """
    config = config or SecurityConfig()
    found = listed_entries(read_archives(spark, path, budget=config.max_tar_metadata_bytes), config)
    if strict and (bad := found.filter("error IS NOT NULL").orderBy("archive", "entry_idx").select("error").first()):
        raise ArchiveError(bad["error"]["code"], bad["error"]["message"])
    return found


def verify_archives(spark: SparkSession, path: str, config: SecurityConfig | None = None, with_issues: bool = True) -> DataFrame:
    """One report row an archive.  An archive that can't be listed at all has status FAIL and its error."""
    config = config or SecurityConfig()
    return verify_entries(read_archives(spark, path, budget=config.max_tar_metadata_bytes), config, with_issues)


class Archive:
    """An archive and the policy under which it is read."""

    def __init__(self, spark: SparkSession, path: str, config: SecurityConfig | None = None):
        self.spark, self.path, self.config = spark, path, config or SecurityConfig()

    def entries(self) -> DataFrame:
        return list_archives(self.spark, self.path, self.config)

    def verify(self) -> DataFrame:
        return verify_archives(self.spark, self.path, self.config)

    def extract(self, destination: str, options: ExtractionOptions | None = None, progress: Progress | None = None) -> ExtractionReport:
        return extract_archive(self.spark, self.path, destination, self.config, options, progress)


class ArchiveBuilder:
    """Archive and destination, step by step."""

    def __init__(self, spark: SparkSession):
        self.spark, self._path, self._out, self._config = spark, None, None, SecurityConfig()

    def archive(self, path: str) -> ArchiveBuilder:
        self._path = path
        return self

    def output_dir(self, path: str) -> ArchiveBuilder:
        self._out = path
        return self

    def config(self, config: SecurityConfig) -> ArchiveBuilder:
        self._config = config
        return self

    def extract(self, options: ExtractionOptions | None = None) -> ExtractionReport:
        if not self._path or not self._out:
            raise ArchiveError("INVALID_CONFIGURATION", "invalid configuration: archive path and output directory are needed")
        return extract_archive(self.spark, self._path, self._out, self._config, options)


class ArchiveCreator:
    """Sources and options of a new archive, step by step: creator.output(p).source(s).set(level=9).create()."""

    def __init__(self, spark: SparkSession):
        self.spark, self._out, self._sources, self._config = spark, None, [], CreationConfig()

    def output(self, path: str) -> ArchiveCreator:
        self._out = path
        return self

    def source(self, *paths: str) -> ArchiveCreator:
        self._sources += paths
        return self

    def exclude(self, *patterns: str) -> ArchiveCreator:
        return self.set(exclude_patterns=self._config.exclude_patterns + patterns)

    def set(self, **options) -> ArchiveCreator:
        self._config = replace(self._config, **options)
        return self

    def create(self, overwrite: bool = False, progress: Progress | None = None) -> CreationReport:
        if not self._out or not self._sources:
            raise ArchiveError("INVALID_CONFIGURATION", "invalid configuration: output and sources are needed")
        return create_archive(self.spark, self._out, self._sources, self._config, overwrite, progress)

