"""Measures of a string as Columns: entropy, alphabet, shape, redaction. All stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings shorter than this are never random tokens by themselves.
MIN_TOKEN = 24
#: Share of the alphabet's full entropy that a random string reaches.
HIGH_SHARE = 0.80
#: Guards comparisons of doubles whose logarithms may differ in the last bit.
EPSILON = 1e-12

# Forms of identifiers that are no secrets.
UUID = r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
SHA1 = r"\A[0-9a-fA-F]{40}\z"

_SPACE = r"[\s\x1c-\x1f]"


def strip(s: Column) -> Column:
    """Without white space (of any script) at the ends."""
    return F.regexp_replace(s, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def has_space(s: Column) -> Column:
    return s.rlike(rf"(?U){_SPACE}")


def shannon_entropy(s: Column) -> Column:
    """Bits per character; an empty string has 0, null stays null."""
    n = F.length(s).cast("double")

    def add(total: Column, c: Column) -> Column:
        p = (n - F.length(F.replace(s, c, F.lit("")))) / n
        return total - p * F.log2(p)

    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), add)).when(n == 0, 0.0)


def distinct_chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.size(F.array_distinct(F.split(s, "")))).otherwise(0)


def corrected_entropy(s: Column) -> Column:
    """Shannon entropy with the bias correction of Miller and Madow for short strings."""
    n = F.length(s)
    return F.when(n > 0, shannon_entropy(s) + (distinct_chars(s) - 1) / (2 * n * math.log(2))).when(n == 0, 0.0)


def alphabet_size(s: Column) -> Column:
    """16 for hex digits, 36 for one letter case with digits, else 64."""
    return F.when(s.rlike(r"\A[0-9a-fA-F]*\z"), 16).when(s.rlike(r"\A(?:[a-z0-9]*|[A-Z0-9]*)\z"), 36).when(s.isNotNull(), 64)


def is_high_entropy(s: Column, share: float = HIGH_SHARE, min_length: int = MIN_TOKEN) -> Column:
    return (F.length(s) >= min_length) & (corrected_entropy(s) >= share * F.log2(alphabet_size(s).cast("double")) - EPSILON)


def consonant_run(s: Column) -> Column:
    """The longest run of consonants, in characters; y is one."""
    runs = F.regexp_extract_all(F.lower(s), F.lit(r"[bcdfghj-np-tv-z]+"), F.lit(0))
    return F.when(s.isNotNull(), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)))


def char_classes(s: Column) -> Column:
    """How many of lower case, upper case, digit and anything else occur."""
    kinds = (r"\p{Lower}", r"\p{Upper}", r"\p{IsDigit}", r"[^\p{IsAlphabetic}\p{IsDigit}]")
    return sum((s.rlike(f"(?U){k}").cast("int") for k in kinds[1:]), s.rlike(f"(?U){kinds[0]}").cast("int"))


def is_code_identifier(s: Column) -> Column:
    """Built of readable words: two segments or more, all but one of them words, covering seven tenths."""
    parts = F.filter(F.split(s, r"[_\-.]+|(?<=[a-z0-9])(?=[A-Z])"), lambda p: p != "")
    words = F.filter(parts, lambda p: p.rlike(r"\A\p{L}{2,12}\z") & p.rlike("[aeiouyAEIOUY]"))
    covered = F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))
    return (F.size(parts) >= 2) & (F.size(words) >= 2) & (F.size(words) >= F.size(parts) - 1) & (covered * 10 >= F.length(s) * 7)


def is_url_encoded(s: Column) -> Column:
    """Six tenths of the characters or more are %XX."""
    return F.regexp_count(s, F.lit("%[0-9A-Fa-f]{2}")) * 30 >= F.length(s) * 6


def is_hash_or_id(s: Column) -> Column:
    """A UUID or exactly 40 hex digits; 32 and 64 are lengths of real keys too."""
    return s.rlike(UUID) | s.rlike(SHA1)


def redact(s: Column, keep: int = 4) -> Column:
    """The ends of a long value, the first character of a short one, nothing of an empty one."""
    t = strip(s)
    n = F.length(t)
    return F.when(n == 0, "").when(n <= 2 * keep + 4, F.concat(F.substring(t, 1, 1), F.lit("…"))).otherwise(
        F.concat(F.substring(t, 1, keep), F.lit("…"), F.right(t, F.lit(keep)))
    )


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def fingerprint(rule_id: Column, path: Column, redacted: Column) -> Column:
    """16 hex digits over rule, path and redacted value: neither the line nor the secret goes in. Null parts count as empty."""
    nul = F.lit("\0")
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.sha2(F.concat(part(rule_id), nul, part(slashed(path)), nul, part(redacted)), 256), 1, 16)


def location(path: Column, line: Column, commit: Column) -> Column:
    return F.concat(path, F.lit(":"), line.cast("string"), F.when(commit.isNotNull(), F.concat(F.lit("@"), commit)).otherwise(""))


def cwe_link(cwe: Column) -> Column:
    number = F.regexp_extract(cwe, r"(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html")))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high): the score interval of k successes in n trials, within [0, 1]; (0, 0) without trials."""
    n = n.cast("double")
    p = F.try_divide(k.cast("double"), n)
    scale = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    zero = F.lit(0.0)
    return F.struct(
        F.when(n > 0, F.greatest(zero, mid - half)).otherwise(zero).alias("low"), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(zero).alias("high")
    )


def below(path: Column, *folders: str) -> Column:
    """The path from the first of the named folders on; whole where it lies in none. Backslashes are read as slashes."""
    p = slashed(path)
    inner = F.regexp_extract(p, rf"(?:\A|/)((?:{'|'.join(folders)})/.*)\z", 1)
    return F.when(inner != "", inner).otherwise(p)


def filled(template: Column, seed: Column) -> Column:
    """A template with every {N} replaced by N letters and digits, the same for the same seed, up to 128 each."""
    pool = F.translate(F.concat(*[F.base64(F.unhex(F.md5(F.concat(F.lit(f"{i}:"), seed.cast("string"))))) for i in range(6)]), "+/=", "pq")
    sizes = F.regexp_extract_all(template, F.lit(r"\{(\d+)\}"), F.lit(1))
    return F.aggregate(
        sizes, template, lambda text, n: F.regexp_replace(text, F.concat(F.lit(r"\{"), n, F.lit(r"\}")), F.substring(pool, F.lit(1), n.cast("int")))
    )
