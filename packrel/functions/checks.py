"""The policy's tests, each a column that is null or an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packrel.config import SecurityConfig

from . import paths as P
from .errors import error, issue, no_error, octal

SET_ID, WORLD_WRITE = 0o6000, 0o002
ZIP_METHODS = [0, 8, 12, 93]
SUSPICIOUS = ["exe", "dll", "sh", "bat", "cmd"]


def path_error(path: Column, config: SecurityConfig) -> Column:
    """The first rule that a path breaks, in the order in which the rules stand.

    Names are read from left to right, so that of '..' and a banned name the one in front counts.
    """
    parts = P.components(path)
    step = P.first_where(parts, lambda c: c == "..")
    ban = P.first_where(parts, lambda c: P.is_banned(c, config.banned_path_components))
    traversal = error("PATH_TRAVERSAL", path)
    banned = error("SECURITY_VIOLATION", F.concat(F.lit("banned path component: "), F.try_element_at(parts, ban.cast("int"))))
    deep = error("SECURITY_VIOLATION", F.concat(F.lit("path depth "), F.size(parts).cast("string"), F.lit(f" exceeds maximum {config.max_path_depth}")))
    root_denied = F.lit(not config.allow_absolute_paths)
    return (
        F.when(path.isNull() | (path == ""), error("SECURITY_VIOLATION", F.lit("empty path not allowed")))
        .when(P.is_here(path), no_error())
        .when(P.has_nul(path), error("SECURITY_VIOLATION", F.concat(F.lit("path contains null bytes: "), path)))
        .when(P.is_absolute(path) & root_denied, traversal)
        .when((step > 0) & ((ban == 0) | (step < ban)), traversal)
        .when(ban > 0, banned)
        .when(F.size(parts) == 0, traversal)
        .when(F.size(parts) > config.max_path_depth, deep)
        .otherwise(no_error())
    )


def ratio_error(compressed: Column, size: Column, config: SecurityConfig) -> Column:
    """Nothing is tested where the compressed size isn't known."""
    ratio = size.cast("double") / compressed.cast("double")
    sizes = F.concat(F.lit("(compressed="), compressed.cast("string"), F.lit(", uncompressed="), size.cast("string"), F.lit(")"))
    bomb = error(
        "ZIP_BOMB",
        F.concat(
            F.lit("potential zip bomb: compressed="), compressed.cast("string"), F.lit(" bytes, uncompressed="), size.cast("string"),
            F.lit(" bytes (ratio: "), F.format_string("%.2f", ratio), F.lit(")"),
        ),
        F.concat(F.lit("Potential zip bomb: "), F.format_string("%.1f", ratio), F.lit("x compression ratio "), sizes),
    )
    empty = error("INVALID_ARCHIVE", F.lit("compressed_size is 0 but uncompressed_size > 0 (invalid archive metadata)"))
    return F.when(compressed.isNull(), no_error()).when((compressed == 0) & (size > 0), empty).when((compressed > 0) & (ratio > config.max_compression_ratio), bomb).otherwise(no_error())


def sanitized_mode(mode: Column, config: SecurityConfig) -> Column:
    drop = SET_ID | (0 if config.allow_world_writable else WORLD_WRITE)
    return mode.bitwiseAND(F.lit(0x7FFFFFFF & ~drop))


def mode_error(path: Column, mode: Column, config: SecurityConfig) -> Column:
    bad = error(
        "INVALID_PERMISSIONS",
        F.concat(F.lit("invalid permissions for "), path, F.lit(": "), octal(mode)),
        F.concat(F.lit("Invalid permissions: "), path, F.lit(" (mode: "), octal(mode), F.lit(")")),
    )
    return F.when(mode.isNotNull() & (sanitized_mode(mode, config) != mode), bad).otherwise(no_error())


def symlink_error(path: Column, target: Column, config: SecurityConfig) -> Column:
    """Without a file system: the target, followed from the link's folder, must not leave the root."""
    names = P.normal_components(target)
    ban = P.first_where(names, lambda c: P.is_banned(c, config.banned_path_components))
    denied = lambda text: error("SECURITY_VIOLATION", F.lit(text))
    escape = error("SYMLINK_ESCAPE", path)
    parent_depth = F.greatest(F.size(P.components(path)) - 1, F.lit(0))
    return (
        F.when(F.lit(not config.allow_symlinks), denied("symlinks not allowed"))
        .when(target.isNull() | (target == ""), denied("symlink target is empty"))
        .when(P.has_nul(target), denied("symlink target contains null bytes"))
        .when(P.is_absolute(target), escape)
        .when(ban > 0, error("SECURITY_VIOLATION", F.concat(F.lit("symlink target contains banned component: "), F.try_element_at(names, ban.cast("int")))))
        .when(F.size(names) > config.max_path_depth, error("SECURITY_VIOLATION", F.concat(F.lit("symlink target depth "), F.size(names).cast("string"), F.lit(f" exceeds maximum {config.max_path_depth}"))))
        .when(P.escapes(parent_depth, target), escape)
        .otherwise(no_error())
    )


def hardlink_error(path: Column, target: Column, config: SecurityConfig) -> Column:
    """As extraction tests it: the target is followed from the root."""
    denied = lambda text: error("SECURITY_VIOLATION", F.lit(text))
    escape = error("HARDLINK_ESCAPE", path)
    return (
        F.when(F.lit(not config.allow_hardlinks), denied("hardlinks not allowed"))
        .when(target.isNull() | (target == ""), denied("hardlink target is empty"))
        .when(P.has_nul(target), denied("hardlink target contains null bytes"))
        .when(P.is_absolute(target), escape)
        .when(P.escapes(F.lit(0), target), escape)
        .otherwise(no_error())
    )


def link_target_error(target: Column) -> Column:
    """What a listing refuses in a link's target."""
    return F.when(target.isNull() | (target == ""), error("INVALID_ARCHIVE", F.lit("link target is empty"))).when(P.has_nul(target), error("SECURITY_VIOLATION", F.lit("link target contains null bytes"))).otherwise(no_error())


def listing_path_error(path: Column, config: SecurityConfig) -> Column:
    """What a listing refuses in a path: null bytes, '..' always, a root unless allowed."""
    bad = P.has_parent_step(path) | (P.is_absolute(path) & F.lit(not config.allow_absolute_paths))
    return F.when(P.has_nul(path), error("SECURITY_VIOLATION", F.concat(F.lit("path contains null bytes: "), path))).when(bad, error("PATH_TRAVERSAL", path)).otherwise(no_error())


def extension_allowed(path: Column, config: SecurityConfig) -> Column:
    """With an allow-list, a path without extension isn't allowed."""
    if not config.allowed_extensions:
        return F.lit(True)
    allowed = [x.lower() if x.isascii() else x for x in config.allowed_extensions]
    return F.coalesce(P.ascii_fold(P.extension(path)).isin(allowed), F.lit(False))


def raw_path_error(path: Column) -> Column:
    return F.when(F.octet_length(path) > 4096, error("SECURITY_VIOLATION", F.lit("path is longer than 4096 bytes"))).when(P.has_nul(path), error("SECURITY_VIOLATION", F.lit("path contains null bytes"))).otherwise(no_error())


def is_suspicious_extension(path: Column) -> Column:
    return F.coalesce(P.extension(path).isin(SUSPICIOUS), F.lit(False))


def zip_method_supported(method: Column) -> Column:
    return method.isin(ZIP_METHODS)


def zip_is_symlink(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(0o170000)) == 0o120000


def is_encrypted(flag_bits: Column) -> Column:
    return flag_bits.bitwiseAND(F.lit(1)) == 1


def heuristics(path: Column, raw_path: Column, entry_type: Column, mode: Column) -> list[Column]:
    """Null, or an issue: executable file, suspicious extension, name that isn't UTF-8."""
    runs = (entry_type == "File") & (mode.bitwiseAND(F.lit(0o111)) != 0)
    return [
        F.when(runs, issue("Low", "ExecutableFile", path, F.concat(F.lit("Executable file: "), path), F.concat(F.lit("mode: "), octal(mode)))),
        F.when(is_suspicious_extension(path), issue("Info", "SuspiciousPath", path, F.concat(F.lit("Suspicious extension: "), path))),
        F.when(
            ~F.is_valid_utf8(raw_path),
            issue("Medium", "SuspiciousPath", path, F.concat(F.lit("Entry name is not valid UTF-8; extraction may fail where names must be UTF-8: "), path)),
        ),
    ]
