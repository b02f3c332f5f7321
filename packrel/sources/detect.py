"""Which format a file has: by its leading bytes, else by its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packrel.functions import paths as P

# Names and leading bytes of the formats, which must match for right results.
#: Names of what is a ZIP file in all but name.
ZIP_FAMILY = ("jar", "war", "ear", "nar", "nbm", "apk", "aab", "ipa", "appx", "msix", "whl", "vsix", "xpi", "epub")
EXTENSIONS = {
    "tar": "Tar", "tgz": "TarGz", "bz2": "TarBz2", "tbz": "TarBz2", "tbz2": "TarBz2", "xz": "TarXz", "txz": "TarXz",
    "zst": "TarZst", "tzst": "TarZst", "zip": "Zip", "7z": "SevenZ",
}
#: (offset, bytes, format)
MAGIC = [
    (0, b"\x1f\x8b", "TarGz"), (0, b"BZh", "TarBz2"), (0, b"\xfd7zXZ\x00", "TarXz"), (0, b"\x28\xb5\x2f\xfd", "TarZst"),
    (0, b"PK\x03\x04", "Zip"), (0, b"PK\x05\x06", "Zip"), (0, b"PK\x07\x08", "Zip"), (0, b"7z\xbc\xaf\x27\x1c", "SevenZ"), (257, b"ustar", "Tar"),
]
HEADER = 262


def format_of_name(name: str) -> str | None:
    parts = name.rsplit("/", 1)[-1].lower().split(".")
    if len(parts) < 2 or not parts[0] and len(parts) == 2:
        return None
    if parts[-1] == "gz":
        return "TarGz" if len(parts) > 2 and parts[-2] == "tar" else None
    return "Zip" if parts[-1] in ZIP_FAMILY else EXTENSIONS.get(parts[-1])


def format_of_bytes(head: bytes) -> str | None:
    return next((f for at, magic, f in MAGIC if head[at : at + len(magic)] == magic), None)


def format_of(path: Column) -> Column:
    """The same by name, as a column."""
    ext = P.ascii_fold(P.extension(path))
    out = F.when(ext == "gz", F.when(P.ascii_fold(P.file_name(path)).rlike(r".\.tar\.gz$"), "TarGz")).when(ext.isin(list(ZIP_FAMILY)), "Zip")
    for name, f in EXTENSIONS.items():
        out = out.when(ext == name, f)
    return out


def format_of_content(content: Column) -> Column:
    """The same by leading bytes, as a column."""
    out = None
    for at, magic, f in MAGIC:
        test = F.substring(content, at + 1, len(magic)) == F.lit(bytearray(magic))
        out = F.when(test, f) if out is None else out.when(test, f)
    return out


def detected(path: Column, content: Column) -> Column:
    """Leading bytes win over the name."""
    return F.coalesce(format_of_content(content), format_of(path))


def is_empty_sevenz(length: Column, content: Column) -> Column:
    return (length == 32) & (F.substring(content, 1, 6) == F.lit(bytearray(MAGIC[7][1])))
