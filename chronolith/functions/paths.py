"""Paths as columns: extension, source and ignore tests, modules, languages, rename notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import IGNORED_PATHS, LANGUAGES, ROOT_MODULE, SOURCE_EXTENSIONS, TEST_MODULES, Settings


def any_of(patterns: tuple[str, ...]) -> str:
    """One pattern for all; those that begin alike share their beginning, so that most places fail at one character."""
    heads = ("(^|/)", r"\.", "^")
    groups = {h: [p.removeprefix(h) for p in patterns if p.startswith(h) and not any(p.startswith(g) for g in heads[: heads.index(h)])] for h in heads}
    rest = [p for p in patterns if not p.startswith(heads)]
    joined = [f"{h}(?:{'|'.join(f'(?:{p})' for p in ps)})" for h, ps in groups.items() if ps]
    return "|".join(f"(?:{p})" for p in joined + rest)


def extension(path: Column) -> Column:
    """The last suffix of the file name, lower-cased, with its dot; empty if none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def is_source(path: Column) -> Column:
    return extension(path).isin(*SOURCE_EXTENSIONS)


def is_ignored(path: Column) -> Column:
    return path.rlike(any_of(IGNORED_PATHS))


def is_test_module(module: Column) -> Column:
    return module.rlike(any_of(TEST_MODULES))


def language_of(path: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[extension(path)]


def module_of(path: Column, settings: Settings) -> Column:
    """The first directories of a path, less one leading source prefix that a directory follows; null if ignored."""

    def name(parts: Column) -> Column:
        skip = F.when((F.size(parts) > 2) & F.get(parts, F.lit(0)).isin(*settings.strip_prefixes), 1).otherwise(0)
        depth = F.least(F.lit(max(1, settings.module_depth)), F.size(parts) - 1 - skip)
        return F.when(depth > 0, F.array_join(F.slice(parts, skip + 1, F.greatest(depth, F.lit(0))), "/")).when(F.size(parts) > 0, ROOT_MODULE)

    parts = F.array_remove(F.split(path, "/"), "")
    # As a lambda variable the parts are made once.
    named = F.element_at(F.transform(F.array(parts), name), 1)
    return F.when(path.isNotNull() & ~is_ignored(path), named)


def renamed(raw: Column) -> Column:
    """Struct (path, old_path) of a numstat path: `dir/{a => b}/f`, `a => b`, or a plain path."""
    braces = r"^(.*)\{(.*) => (.*)\}(.*)$"
    side = lambda k: F.regexp_replace(F.concat(F.regexp_extract(raw, braces, 1), F.regexp_extract(raw, braces, k), F.regexp_extract(raw, braces, 4)), "//", "/")
    plain = F.split(raw, " => ", 2)
    return F.when(raw.rlike(braces), F.struct(side(3).alias("path"), side(2).alias("old_path"))).when(
        raw.contains(" => "), F.struct(F.trim(F.get(plain, F.lit(1))).alias("path"), F.trim(F.get(plain, F.lit(0))).alias("old_path"))
    ).otherwise(F.struct(raw.alias("path"), F.lit(None).cast("string").alias("old_path")))
