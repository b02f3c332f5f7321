"""Limits and options.  Frozen; a value that makes no sense is refused when the object is made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

MIB = 1024 * 1024
# The banned names, and the fields and defaults below, which must match for right results.
BANNED = (".git", ".ssh", ".gnupg", ".aws", ".kube", ".docker", ".env")


class InvalidConfiguration(ValueError):
    """A configuration that can't be used."""


def _entry_ok(x: str) -> bool:
    return 1 <= len(x.encode()) <= 255 and "\0" not in x


@dataclass(frozen=True)
class SecurityConfig:
    """What an archive may hold; everything that isn't allowed is denied."""

    max_file_size: int = 50 * MIB
    max_total_size: int = 500 * MIB
    max_compression_ratio: float = 100.0
    max_file_count: int = 10_000
    max_path_depth: int = 32
    allow_symlinks: bool = False
    allow_hardlinks: bool = False
    allow_absolute_paths: bool = False
    allow_world_writable: bool = False
    preserve_permissions: bool = False
    allowed_extensions: tuple[str, ...] = ()
    banned_path_components: tuple[str, ...] = BANNED
    allow_solid_archives: bool = False
    max_solid_block_memory: int = 512 * MIB
    max_tar_metadata_bytes: int = 4 * MIB

    def __post_init__(self) -> None:
        for name in ("max_file_size", "max_total_size", "max_file_count", "max_path_depth", "max_solid_block_memory", "max_tar_metadata_bytes"):
            if getattr(self, name) <= 0:
                raise InvalidConfiguration(f"{name} must be greater than zero")
        if not math.isfinite(self.max_compression_ratio) or self.max_compression_ratio <= 0:
            raise InvalidConfiguration("max_compression_ratio must be finite and greater than zero")
        for name in ("allowed_extensions", "banned_path_components"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
            for x in getattr(self, name):
                if not _entry_ok(x):
                    raise InvalidConfiguration(f"{name} holds an entry that is empty, too long or has a null byte")

    @classmethod
    def permissive(cls) -> SecurityConfig:
        """For archives whose origin is trusted; limits of size, count and depth stay."""
        return cls(
            max_compression_ratio=1000.0,
            allow_symlinks=True,
            allow_hardlinks=True,
            allow_absolute_paths=True,
            allow_world_writable=True,
            preserve_permissions=True,
            banned_path_components=(),
            allow_solid_archives=True,
            max_solid_block_memory=1024 * MIB,
            max_tar_metadata_bytes=16 * MIB,
        )

    def but(self, **changes) -> SecurityConfig:
        return replace(self, **changes)

    def for_listing_before_verify(self) -> SecurityConfig:
        """File size isn't a reason to stop the listing that a verification starts from."""
        return replace(self, max_file_size=2**63 - 1)


@dataclass(frozen=True)
class ExtractionOptions:
    """replace: an atomic extraction may take the place of a folder that is already there."""

    atomic: bool = False
    skip_duplicates: bool = True
    replace: bool = False


@dataclass(frozen=True)
class CreationConfig:
    follow_symlinks: bool = False
    include_hidden: bool = False
    max_file_size: int | None = None
    exclude_patterns: tuple[str, ...] = field(default=(".git", ".DS_Store", "*.tmp"))
    strip_prefix: str | None = None
    compression_level: int | None = 6
    preserve_permissions: bool = True
    format: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "exclude_patterns", tuple(self.exclude_patterns))
        if self.compression_level is not None and not 1 <= self.compression_level <= 9:
            raise InvalidConfiguration(f"invalid compression level {self.compression_level}, must be 1-9")
