"""Path algebra as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(x: Column) -> Column:
    """Lower case of A-Z alone; lower() would also fold letters that merely look alike."""
    return F.translate(x, _UPPER, _LOWER)


def components(path: Column) -> Column:
    """Names between slashes, without empty ones and single dots; '..' stays."""
    return F.filter(F.split(path, "/"), lambda c: (c != "") & (c != "."))


def normal_components(path: Column) -> Column:
    return F.filter(components(path), lambda c: c != "..")


def is_absolute(path: Column) -> Column:
    return F.startswith(path, F.lit("/"))


def is_here(path: Column) -> Column:
    """The path names its own folder: '.', './' and the like."""
    return F.startswith(path, F.lit(".")) & (F.size(components(path)) == 0)


def depth(path: Column) -> Column:
    return F.size(normal_components(path))


def normalized(path: Column) -> Column:
    """The path without empty parts and dots, relative."""
    return F.array_join(components(path), "/")


def file_name(path: Column) -> Column:
    """The last name; null if there is none or it is '..'."""
    parts = components(path)
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(last != "..", last)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, if anything stands before that dot; else null."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.substring_index(name, ".", -1))


def parents(path: Column) -> Column:
    """All proper ancestors, longest last: a/b/c gives [a, a/b]."""
    parts = components(path)
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    )


def has_nul(x: Column) -> Column:
    return F.instr(x, "\0") > 0


def has_parent_step(path: Column) -> Column:
    return F.array_contains(components(path), "..")


def starts_with_path(path: Column, base: str) -> Column:
    """Component-wise prefix."""
    want = [c for c in base.split("/") if c not in ("", ".")]
    if not want:
        return F.lit(True)
    return F.slice(components(path), 1, len(want)) == F.array(*map(F.lit, want))


def strip_prefix(path: Column, prefix: str) -> Column:
    """The path below the prefix where that matches, component by component; else the path."""
    n = len([c for c in prefix.split("/") if c not in ("", ".")])
    parts = components(path)
    rest = F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts), F.lit(1))), "/")
    return F.when(starts_with_path(path, prefix), rest).otherwise(path) if n else path


def first_where(parts: Column, test) -> Column:
    """Place (from 1) of the first part that passes; 0 if none does."""
    return F.array_position(F.transform(parts, test), True)


def is_banned(part: Column, banned: Sequence[str]) -> Column:
    return ascii_fold(part).isin([b.translate(str.maketrans(_UPPER, _LOWER)) for b in banned]) if banned else F.lit(False)


def escapes(parent_depth: Column, target: Column) -> Column:
    """Whether a relative target, followed from a folder of that depth, ever leaves the root."""
    start = F.struct(parent_depth.cast("int").alias("depth"), F.lit(True).alias("ok"))

    def step(a, c):
        deeper = a["depth"] + F.when(c == "..", -1).otherwise(1)
        return F.struct(deeper.alias("depth"), (a["ok"] & (deeper >= 0)).alias("ok"))

    return ~F.aggregate(components(target), start, step)["ok"]


def matches_pattern(x: Column, pattern: str) -> Column:
    """Exactly, or 'prefix*', or '*suffix', tested in that order; a star elsewhere is a star."""
    out = x == pattern
    if pattern.endswith("*"):
        return out | F.startswith(x, F.lit(pattern[:-1]))
    if pattern.startswith("*"):
        return out | F.endswith(x, F.lit(pattern[1:]))
    return out


def is_excluded(path: Column, patterns: Sequence[str], include_hidden: bool = False) -> Column:
    """Hidden (by its own name only), or a pattern matches the whole path or any of its names."""
    out = F.lit(False) if include_hidden else F.coalesce(F.startswith(file_name(path), F.lit(".")), F.lit(False))
    parts = components(path)

    def any_name(pattern: str) -> Column:
        return F.exists(parts, lambda c: matches_pattern(c, pattern))

    for p in patterns:
        out = out | matches_pattern(path, p) | any_name(p)
    return out
