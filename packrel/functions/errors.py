"""Errors as values: a struct of code, message and what an issue shows of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packrel.schemas import RANK

ERROR = "struct<code:string,message:string,issue:string,severity:string,severity_rank:int,category:string>"
# Codes, severities, categories and texts, which must match for right results.
#: code -> severity, category and kind of the issue it becomes.
ISSUES = {
    "PATH_TRAVERSAL": ("Critical", "PathTraversal", "PathTraversal"),
    "SYMLINK_ESCAPE": ("Critical", "SymlinkEscape", "SymlinkEscape"),
    "HARDLINK_ESCAPE": ("Critical", "HardlinkEscape", "HardlinkEscape"),
    "ZIP_BOMB": ("Critical", "ZipBomb", "ZipBomb"),
    "QUOTA_EXCEEDED": ("High", "QuotaExceeded", "QuotaExceeded"),
    "INVALID_PERMISSIONS": ("Medium", "InvalidPermissions", "InvalidPermissions"),
    "IO_ERROR": ("High", "InvalidArchive", "Io"),
    "INVALID_ARCHIVE": ("High", "InvalidArchive", "InvalidArchive"),
    "SECURITY_VIOLATION": ("High", "SuspiciousPath", "SecurityViolation"),
    "SOURCE_NOT_FOUND": ("High", "InvalidArchive", "SourceNotFound"),
    "SOURCE_NOT_ACCESSIBLE": ("High", "InvalidArchive", "SourceNotAccessible"),
    "OUTPUT_EXISTS": ("Medium", "InvalidArchive", "OutputExists"),
    "INVALID_COMPRESSION_LEVEL": ("Medium", "InvalidArchive", "InvalidCompressionLevel"),
    "UNKNOWN_FORMAT": ("High", "InvalidArchive", "UnknownFormat"),
    "INVALID_CONFIGURATION": ("High", "InvalidArchive", "InvalidConfiguration"),
}
SECURITY = ["PATH_TRAVERSAL", "SYMLINK_ESCAPE", "HARDLINK_ESCAPE", "ZIP_BOMB", "INVALID_PERMISSIONS", "QUOTA_EXCEEDED", "SECURITY_VIOLATION"]
RECOVERABLE = ["PATH_TRAVERSAL", "SYMLINK_ESCAPE", "HARDLINK_ESCAPE", "INVALID_PERMISSIONS", "SECURITY_VIOLATION"]
SECURITY_CATEGORIES = ["PathTraversal", "SymlinkEscape", "HardlinkEscape", "ZipBomb", "InvalidPermissions", "QuotaExceeded"]
#: code -> what stands before the detail in a message, and in an issue.
TEXTS = {
    "PATH_TRAVERSAL": ("path traversal detected: ", "Path traversal detected: "),
    "SYMLINK_ESCAPE": ("symlink target outside extraction directory: ", "Symlink escape: "),
    "HARDLINK_ESCAPE": ("hardlink target outside extraction directory: ", "Hardlink escape: "),
    "QUOTA_EXCEEDED": ("quota exceeded: ", "quota exceeded: "),
    "INVALID_ARCHIVE": ("invalid archive: ", "Invalid archive: "),
    "SECURITY_VIOLATION": ("operation denied by security policy: ", "Security violation: "),
    "IO_ERROR": ("I/O error: ", "I/O error: "),
    "SOURCE_NOT_FOUND": ("source path not found: ", "Source not found: "),
    "SOURCE_NOT_ACCESSIBLE": ("source path is not accessible: ", "Source not accessible: "),
    "OUTPUT_EXISTS": ("output file already exists: ", "Output already exists: "),
    "UNKNOWN_FORMAT": ("cannot determine archive format from: ", "Unknown format: "),
    "INVALID_CONFIGURATION": ("invalid configuration: ", "Invalid configuration: "),
}


def no_error() -> Column:
    return F.lit(None).cast(ERROR)


def error(code: str, detail: Column, issue: Column | None = None) -> Column:
    before, issue_before = TEXTS.get(code, ("", ""))
    return raw_error(code, F.concat(F.lit(before), detail), issue if issue is not None else F.concat(F.lit(issue_before), detail))


def raw_error(code: str, message: Column, issue: Column) -> Column:
    """An error whose texts are given whole."""
    severity, category, _ = ISSUES[code]
    return F.struct(
        F.lit(code).alias("code"),
        message.alias("message"),
        issue.alias("issue"),
        F.lit(severity).alias("severity"),
        F.lit(RANK[severity]).alias("severity_rank"),
        F.lit(category).alias("category"),
    )


def octal(mode: Column) -> Column:
    return F.concat(F.lit("0o"), F.conv(mode.cast("string"), 10, 8))


def _lookup(code: Column, n: int) -> Column:
    out = None
    for name, row in ISSUES.items():
        out = F.when(code == name, row[n]) if out is None else out.when(code == name, row[n])
    return out


def severity_of(code: Column) -> Column:
    return _lookup(code, 0)


def category_of(code: Column) -> Column:
    return _lookup(code, 1)


def kind_of(code: Column) -> Column:
    """The name that JSON output gives an error."""
    return _lookup(code, 2)


def is_security(code: Column) -> Column:
    return code.isin(SECURITY)


def is_recoverable(code: Column) -> Column:
    return code.isin(RECOVERABLE)


#: Errors whose path is the host's and not the archive's.
HOST_PATHS = ["SOURCE_NOT_FOUND", "SOURCE_NOT_ACCESSIBLE", "OUTPUT_EXISTS", "UNKNOWN_FORMAT"]
ENTRY_PATHS = ["PATH_TRAVERSAL", "SYMLINK_ESCAPE", "HARDLINK_ESCAPE", "INVALID_PERMISSIONS"]
#: How a reason begins that an option of the caller could lift.
RELAXABLE = ["symlinks not allowed", "hardlinks not allowed", "solid archives are not allowed", "banned path component:", "symlink target contains banned component:"]


def redacted_path(code: Column, path: Column) -> Column:
    """Entry paths as they are; of host paths the last name alone; null for errors without a path."""
    return F.when(code.isin(HOST_PATHS), F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)).when(code.isin(ENTRY_PATHS), path)


def is_relaxable(reason: Column) -> Column:
    """By the beginning of the reason, which no archive can forge."""
    out = F.lit(False)
    for x in RELAXABLE:
        out = out | F.startswith(reason, F.lit(x))
    return out


def issue(severity: str, category: str, path: Column, message: Column, context: Column | None = None) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(RANK[severity]).alias("severity_rank"),
        F.lit(category).alias("category"),
        path.alias("entry_path"),
        message.alias("message"),
        (context if context is not None else F.lit(None).cast("string")).alias("context"),
    )


def issue_of_error(err: Column, path: Column) -> Column:
    shown = F.struct(
        err["severity"].alias("severity"), err["severity_rank"].alias("severity_rank"), err["category"].alias("category"), path.alias("entry_path"), err["issue"].alias("message"), F.lit(None).cast("string").alias("context")
    )
    return F.when(err.isNotNull(), shown)
