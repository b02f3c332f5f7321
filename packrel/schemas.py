"""Schemas of the relations."""

from __future__ import annotations

ENTRIES = (
    "archive string, format string, entry_idx long, path string, raw_path binary, entry_type string, size decimal(20,0), "
    "compressed_size long, mode int, modified timestamp, symlink_target string, hardlink_target string, "
    "typeflag string, method int, encrypted boolean, is_solid boolean, scan_error string"
)
ENTRIES_WITH_CONTENT = ENTRIES + ", content binary"
ISSUE = "struct<severity:string,severity_rank:int,category:string,entry_path:string,message:string,context:string>"
SEVERITIES = ["Info", "Low", "Medium", "High", "Critical"]
RANK = {name: k for k, name in enumerate(SEVERITIES)}
U64_MAX = 2**64 - 1
