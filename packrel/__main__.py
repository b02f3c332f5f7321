"""python -m packrel extract|create|list|verify"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from packrel import api
from packrel.config import CreationConfig, ExtractionOptions, SecurityConfig
from packrel.operators import joins
from packrel.sources.archive import existing_paths

EXIT = {"PASS": 0, "FAIL": 1, "WARNING": 2}


def byte_size(text: str) -> int:
    text = text.strip().upper()
    factor = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}.get(text[-1:], 1)
    number = text[:-1] if factor > 1 else text
    if not number.isdigit() or int(number) * factor >= 2**64:
        raise argparse.ArgumentTypeError(f"not a size: {text}")
    return int(number) * factor


def extensions(text: str) -> tuple[str, ...]:
    return tuple(x for x in (p.strip().lstrip(".").lower() for p in text.split(",")) if x)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="packrel", description="Archives as relations.")
    p.add_argument("--json", action="store_true")
    p.add_argument("--quiet", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("extract", "list", "verify"):
        c = sub.add_parser(name)
        c.add_argument("archive")
        c.add_argument("--max-total-size", type=byte_size)
        c.add_argument("--max-file-size", type=byte_size)
        c.add_argument("--max-files", type=int)
        if name == "extract":
            c.add_argument("output", nargs="?", default=".")
            for flag in ("--allow-symlinks", "--allow-hardlinks", "--allow-solid-archives", "--atomic", "--overwrite", "--force"):
                c.add_argument(flag, action="store_true")
            c.add_argument("--allowed-extensions", type=extensions, default=())
            c.add_argument("--banned", action="append")
    c = sub.add_parser("create")
    c.add_argument("output")
    c.add_argument("sources", nargs="+")
    c.add_argument("--level", type=int, default=6)
    c.add_argument("--exclude", action="append", default=[])
    c.add_argument("--strip-prefix")
    for flag in ("--force", "--follow-symlinks", "--include-hidden"):
        c.add_argument(flag, action="store_true")
    c = sub.add_parser("completion")
    c.add_argument("shell", choices=["bash", "zsh", "fish"])
    return p


def completion(shell: str) -> str:
    """A script that completes commands and their options."""
    sub = next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction))
    options = {name: [o for a in p._actions for o in a.option_strings if o.startswith("--")] for name, p in sub.choices.items()}
    if shell == "fish":
        lines = [f"complete -c packrel -n __fish_use_subcommand -a {name}" for name in options]
        lines += [f"complete -c packrel -n '__fish_seen_subcommand_from {name}' -l {o[2:]}" for name, own in options.items() for o in own]
        return "\n".join(lines)
    cases = "\n".join(f'    {name}) COMPREPLY=($(compgen -f -W "{" ".join(own)}" -- "$cur")) ;;' for name, own in options.items())
    script = f"""_packrel() {{
  local cur="${{COMP_WORDS[COMP_CWORD]}}"
  case "${{COMP_WORDS[1]}}" in
{cases}
    *) COMPREPLY=($(compgen -W "{" ".join(options)}" -- "$cur")) ;;
  esac
}}
complete -F _packrel packrel"""
    return ("autoload -U +X bashcompinit && bashcompinit\n" if shell == "zsh" else "") + script


#: What an error that a setting can lift says besides.
HINTS = {
    "QUOTA_EXCEEDED": "raise --max-files, --max-total-size or --max-file-size if the archive is trusted",
    "SYMLINK_ESCAPE": "--allow-symlinks lets links that stay inside the destination pass",
    "HARDLINK_ESCAPE": "--allow-hardlinks lets links to files of the archive pass",
    "OUTPUT_EXISTS": "--force replaces what is there",
    "UNKNOWN_FORMAT": "the format is told from the leading bytes and the name; check both",
}


def refuse_conflicts(spark: SparkSession, archive: str, destination: str, config: SecurityConfig) -> None:
    """Stop before anything is written if files of the archive are already there."""
    destination_files = spark.createDataFrame(((x,) for x in existing_paths(destination)), "path string")
    found, n_more = joins.first_conflicts(api.list_archives(spark, archive, config), destination_files)
    first = [r["path"] for r in found.collect()]
    if first:
        more = f" ... and {n_more} more" if n_more else ""
        raise api.ArchiveError("OUTPUT_EXISTS", f"files already exist in {destination}: {', '.join(first)}{more}; --force extracts all the same")


def policy(a: argparse.Namespace) -> SecurityConfig:
    given = {"max_total_size": a.max_total_size, "max_file_size": a.max_file_size, "max_file_count": a.max_files}
    if a.command == "extract":
        given |= {"allow_symlinks": a.allow_symlinks, "allow_hardlinks": a.allow_hardlinks, "allow_solid_archives": a.allow_solid_archives, "allowed_extensions": a.allowed_extensions}
        if a.banned is not None:  # empty strings alone switch the defaults off
            given["banned_path_components"] = tuple(x for x in a.banned if x)
    return SecurityConfig(**{k: v for k, v in given.items() if v is not None})


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "completion":
        print(completion(a.shell))
        return 0
    spark = spark or SparkSession.builder.appName("packrel").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.command == "create":
            config = CreationConfig(compression_level=a.level, exclude_patterns=(*CreationConfig().exclude_patterns, *a.exclude), strip_prefix=a.strip_prefix, follow_symlinks=a.follow_symlinks, include_hidden=a.include_hidden)
            out, code = asdict(api.create_archive(spark, a.output, a.sources, config, a.force)), 0
        elif a.command == "extract":
            if not (a.atomic or a.force or a.overwrite):
                refuse_conflicts(spark, a.archive, a.output, policy(a))
            out, code = asdict(api.extract_archive(spark, a.archive, a.output, policy(a), ExtractionOptions(a.atomic, not (a.overwrite or a.force), a.force))), 0
        elif a.command == "list":
            rows = api.list_archives(spark, a.archive, policy(a), strict=True).select("path", "entry_type", "size").orderBy("archive", "entry_idx")
            out, code = [r.asDict() for r in rows.toLocalIterator()], 0
        else:
            reports = [r.asDict(True) for r in api.verify_archives(spark, a.archive, policy(a)).collect()]
            out, code = reports, max((EXIT[r["status"]] for r in reports), key=lambda c: (0, 2, 1).index(c), default=0)
    except api.ArchiveError as e:
        hint = HINTS.get(e.code)
        told = {"error": e.code, "message": str(e)} | ({"hint": hint} if hint else {})
        print(json.dumps(told) if a.json else f"error: {e}" + (f"\nhint: {hint}" if hint else ""), file=sys.stderr)
        return 1
    if not a.quiet:
        print(json.dumps(out, default=str) if a.json else "\n".join(map(str, out if isinstance(out, list) else [out])))
    return code


if __name__ == "__main__":
    sys.exit(main())
