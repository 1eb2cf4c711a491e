"""What a pull request touches: path flags, changed lines, trivial or gated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The path patterns and the line bound that decide triviality.
# All are matched without case; \z because Java's $ also matches before a final newline.
TRIVIAL_PATHS = [
    r"\.md\z",
    r"\.txt\z",
    r"\.rst\z",
    r"^docs/",
    r"(^|/)(LICENSE|CHANGELOG|CODEOWNERS)",
    r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|go\.sum|poetry\.lock|composer\.lock)\z",
    r"^\.github/",
    r"\.editorconfig\z",
    r"\.gitignore\z",
]
GENERATED_PATHS = [
    r"(^|/)(dist|build|out|coverage|vendor|node_modules|generated)/",
    r"\.min\.(js|css)\z",
    r"\.snap\z",
    r"\.map\z",
]
TINY_CHANGE_LINES = 8

TRIVIAL_RE = "(?i)" + "|".join(TRIVIAL_PATHS)
GENERATED_RE = "(?i)" + "|".join(GENERATED_PATHS)
EITHER_RE = "(?i)" + "|".join(TRIVIAL_PATHS + GENERATED_PATHS)


def is_trivial_path(path: Column) -> Column:
    return path.rlike(TRIVIAL_RE)


def is_generated_path(path: Column) -> Column:
    return path.rlike(GENERATED_RE)


def added_lines(diff: Column) -> Column:
    """Lines that start with ``+`` but not ``+++``."""
    return _lines(diff, r"(?md)^\+(?!\+\+)")


def removed_lines(diff: Column) -> Column:
    """Lines that start with ``-`` but not ``---``."""
    return _lines(diff, r"(?md)^-(?!--)")


def _lines(diff: Column, pattern: str) -> Column:
    # (?d): only \n ends a line. A count of matches builds no array of all lines.
    return F.coalesce(F.regexp_count(diff, F.lit(pattern)), F.lit(0))


def meaningful_files(files: Column) -> Column:
    """How many paths are neither trivial nor generated."""
    return F.size(F.filter(files, lambda f: ~f.rlike(EITHER_RE)))


def classification(files: Column, meaningful: Column, changed: Column) -> Column:
    """``struct(trivial, reason)`` of one change; when unsure the change is gated."""

    def result(trivial: bool, reason: Column) -> Column:
        return F.struct(F.lit(trivial).alias("trivial"), reason.alias("reason"))

    return (
        F.when(
            files.isNull() | (F.size(files) == 0), result(True, F.lit("no files changed"))
        )
        .when(meaningful == 0, result(True, F.lit("only docs/lockfile/generated files")))
        .when(
            changed <= TINY_CHANGE_LINES,
            result(True, F.format_string("tiny change (%d lines)", changed)),
        )
        .otherwise(
            result(
                False,
                F.format_string("%d substantive file(s), %d changed lines", meaningful, changed),
            )
        )
    )
