"""Units to lines: splitting, PEM blocks, and the tests that decide which rules see a unit or a line."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigilite.catalog import DOTENV_NAMES, DOTENV_TEMPLATES, HASH_CONTEXT, Config
from sigilite.functions.text import slashed, strip

_MARK = r"-----(?:BEGIN|END) [A-Z0-9 ]+-----[^\S\n]*(?:\n|\z)"
_OPENS = r"(?U)\A-----BEGIN [A-Z0-9 ]+-----[^\S\n]*(?:\n|\z)"


def explode_lines(units: DataFrame, text: str = "text", line: str = "line", raw: str = "raw", in_pem: str | None = "in_pem") -> DataFrame:
    """One row per line: its number from 1, the line without its \\r, and whether it lies in a PEM block.

    Only \\n ends a line. A block begins with its BEGIN line and ends before its END line. Blocks are cut
    out before the lines are, at every BEGIN and END, so that no state has to be carried from line to
    line: nothing is shuffled, and the work stays linear in the text. Null texts have no lines, an empty
    one has one empty line."""
    others = [c for c in units.columns if c != text]
    # the lines come out of the generator as they are used: a projection on top would be copied into every test of a line
    cut = lambda t: F.split(F.regexp_replace(t, r"\r(?=\n|\z)", ""), "\n", -1)
    if in_pem is None:
        lines = units.select(*others, F.posexplode(cut(F.col(text))).alias("__i", raw))
        return lines.select(*others, (F.col("__i") + 1).alias(line), raw)
    parts = F.when(F.col(text).contains("-----BEGIN "), F.split(text, rf"(?U)(?<=\n)(?={_MARK})", -1)).otherwise(F.array(text))
    # lines before each part; the list is as long as there are marks
    first = F.aggregate(
        "__parts", F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))))
    )
    # whatever is taken from a part is taken before its lines are: a column that is used behind a generator
    # goes along with every row it makes
    rows = (
        units.where(F.col(text).isNotNull())
        .withColumn("__parts", parts)
        .withColumn("__first", F.when(F.size("__parts") == 1, F.array(F.lit(0))).otherwise(first))
        .withColumn("__n", F.size("__parts"))
        .select(*others, "__n", F.posexplode(F.arrays_zip(F.col("__parts").alias("t"), F.slice("__first", 1, F.col("__n")).alias("at"))).alias("__p", "__z"))
        # a part that isn't the last ends in \n, which belongs to its last line
        .select(
            *others, F.col("__z.at").alias("__at"), F.col("__z.t").rlike(_OPENS).alias(in_pem),
            F.when(F.col("__p") + 1 < F.col("__n"), F.regexp_replace("__z.t", r"\n\z", "")).otherwise(F.col("__z.t")).alias("__t"),
        )
        .select(*others, "__at", in_pem, F.posexplode(cut(F.col("__t"))).alias("__i", raw))
    )
    return rows.select(*others, (F.col("__at") + F.col("__i") + 1).alias(line), raw, in_pem)


def base_name(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def _glob(name: Column, pattern: str) -> Column:
    """A name against a pattern with stars at its ends only."""
    body = pattern.strip("*")
    if pattern.startswith("*"):
        return name.contains(body) if pattern.endswith("*") else name.endswith(body)
    return name.startswith(body) if pattern.endswith("*") else name == body


def name_matches(path: Column, wanted: tuple[str, ...], unwanted: tuple[str, ...] = ()) -> Column:
    """Whether the file name, in lower case, fits one of ``wanted`` and none of ``unwanted``."""
    # the text after the last slash: a backslash is part of a name here, as everywhere where files are opened
    name = F.lower(F.substring_index(path, "/", -1))
    out = F.lit(False)
    for p in wanted:
        out = out | _glob(name, p)
    for p in unwanted:
        out = out & ~_glob(name, p)
    return F.coalesce(out, F.lit(False))


def is_synthetic(path: Column) -> Column:
    """<...>: the unit has no file name."""
    return path.rlike(r"\A<[^>]*>\z")


def looks_like_dotenv(text: Column) -> Column:
    """Of the first 400 lines, those neither blank nor comments are NAME=value in three fifths of all cases or more."""
    useful = F.filter(F.slice(F.split(text, "\n", -1), 1, 400), lambda x: x.rlike(r"(?U)[^\s\x1c-\x1f]") & ~x.rlike(r"(?U)\A[\s\x1c-\x1f]*#"))
    named = F.filter(useful, lambda x: x.rlike(r"(?U)\A[ \t]*(?:export[ \t]+)?[A-Z_][A-Z0-9_]*=(?![\s\x22'])"))
    return (F.size(useful) > 0) & (F.size(named) * 5 >= F.size(useful) * 3)


def is_dotenv(path: Column, text: Column) -> Column:
    """By the name; by the content where there is no name. A null path is no environment file."""
    return F.when(is_synthetic(path), looks_like_dotenv(text)).otherwise(name_matches(path, DOTENV_NAMES, DOTENV_TEMPLATES))


def is_test_path(path: Column) -> Column:
    """A folder for tests on the way, or the name of a test file, whatever the letter case."""
    # Names of test folders and files.
    folder = r"(?i)(?:\A|/)(?:tests|test|__tests__|testing)(?:/|\z)"
    name = r"(?i)\A(?:test_.*\.py|.*_test\.py|conftest\.py|locustfile\.py|.*\.(?:test|spec)\.[jt]sx?|test_.*\.(?:js|ts))\z"
    return F.coalesce(slashed(path).rlike(folder) | base_name(path).rlike(name), F.lit(False))


def _words(words: tuple[str, ...]) -> str:
    """Any of the words not followed by a letter or digit. No boundary is asked for before them."""
    return rf"(?Ui)(?:{'|'.join(map(re.escape, words))})(?![A-Za-z0-9])"


def has_word(raw: Column, words: tuple[str, ...]) -> Column:
    return raw.rlike(_words(words))


def has_hash_context(raw: Column) -> Column:
    return has_word(raw, HASH_CONTEXT)


def is_allowed(raw: Column, config: Config) -> Column:
    low = F.lower(raw)
    out = F.lit(False)
    for mark in config.allow_markers:
        out = out | low.contains(mark)
    return out


def is_payload(raw: Column) -> Column:
    """A whole line of base64."""
    return strip(raw).rlike(r"\A[A-Za-z0-9+/]{40,}={0,2}\z")


def is_noise_file(path: Column, config: Config) -> Column:
    name = F.lower(base_name(path))
    out = name.isin(*sorted(config.noise_files))
    for s in config.noise_suffixes:
        out = out | name.endswith(s)
    return F.coalesce(out, F.lit(False)) & F.lit(not config.scan_noise_files)


def has_binary_ext(path: Column, config: Config) -> Column:
    """By the last ending; a name that only begins with a dot has none."""
    return F.coalesce(F.lower(F.regexp_extract(base_name(path), r"\A.+(\.[^.]+)\z", 1)).isin(*sorted(config.binary_exts)), F.lit(False))


def skip_reason(path: Column, size: Column, config: Config) -> Column:
    """Why a file isn't read: binary, noise or size, in this order; null where it is."""
    return F.when(has_binary_ext(path, config), "binary").when(is_noise_file(path, config), "noise").when(size > config.max_file_size, "size")
