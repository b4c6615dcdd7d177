"""Whether a value looks like a real secret, as Columns. Values are never null here; null gives null."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigilite.functions import text as T

# Examples in vendors' documentation, in two parts so that no scanner trips over this file.
DOC_EXAMPLES = ("AKIAIOSFODNN7" + "EXAMPLE", "wJalrXUtnFEMI/K7MDENG/" + "bPxRfiCYEXAMPLEKEY")
# Weak passwords as whole values.
WEAK_VALUES = (
    "password", "password123", "passw0rd", "p@ssw0rd", "mypassword", "secret", "secret123", "supersecret", "topsecret", "test",
    "test123", "admin", "admin123", "changeme", "letmein", "hunter2", "qwerty", "123456", "12345678", "1234567890",
)
# Parts of a value that mark a placeholder.
PLACEHOLDER_PARTS = (
    "example", "exemplo", "change-me", "placeholder", "your_", "your-", "yourkey", "yourtoken", "dummy", "sample", "redacted",
    "test-key", "test_key", "notreal", "xxxxxxxx", "foobar", "0000000000000000", "fakekey", "fake-", "fake_", "mock", "stub",
)
# Parts of a value that mark a test.
TEST_PARTS = ("teste", "senha", "segredo", "test", "fixture", "example", "exemplo", "dummy", "sample", "changeme", "placeholder", "fake", "mock")
# Users and passwords of example URLs.
URL_USERS = ("", "user", "username", "test", "foo", "bar", "me")
URL_PASSWORDS = ("pass", "password", "passwd", "secret", "changeme", "test", "foo", "bar", "123456")
URL_PASSWORD_PARTS = ("changeme", "example", "pass", "secret")
# Hosts of example URLs.
EXAMPLE_HOST = (
    r"\A(?:localhost|127\.\d+\.\d+\.\d+|0\.0\.0\.0|::1|\[::1\]|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+"
    r"|example\.(?:com|org|net)|.+\.(?:example|test|local|localhost|invalid))\z"
)
# What a template puts where a value will be.
TEMPLATE = r"\$\{|\{\{|\{[A-Z][A-Z0-9_]{2,}\}|<[A-Za-z][A-Za-z0-9_-]*>"

URL_PARTS = r"(?Ui)\A[a-z][a-z0-9+.\-]*://([^:@/\s]*):([^@/\s]+)@([^/:\s]+)"
LOGIN_URL = r"(?Ui)\Ahttps?://([^:@/\s]*):([^@/\s]+)@([^/\s?#'\x22]*)"


def any_of(parts: tuple[str, ...]) -> str:
    """One pattern for many plain parts."""
    return "|".join(map(re.escape, parts))


def holds_any(s: Column, parts: tuple[str, ...]) -> Column:
    """Plain searches, which are several times faster than one pattern of as many branches."""
    return reduce(lambda a, b: a | b, [s.contains(p) for p in parts])


def password_looks_real(pw: Column) -> Column:
    plain = pw.isin(*URL_PASSWORDS) | pw.rlike(r"\Ax*\z") | holds_any(pw, URL_PASSWORD_PARTS)
    return ~plain & (T.is_high_entropy(pw, min_length=12) | (T.char_classes(pw) >= 3) | (T.consonant_run(pw) >= 6))


def is_example_url(s: Column) -> Column:
    """A URL whose login is a template, a placeholder, or a plain password for an example host."""
    user, pw, host = (F.lower(F.regexp_extract(s, URL_PARTS, g)) for g in (1, 2, 3))
    template = user.rlike(r"\{|%25") | pw.rlike(r"\{|%25")
    plain_user = user.isin(*URL_USERS) | user.rlike(r"\Ax*\z")
    plain_pw = pw.isin(*URL_PASSWORDS) | pw.rlike(r"\Ax*\z") | holds_any(pw, URL_PASSWORD_PARTS)
    verdict = F.when(template, True).when(host.rlike(EXAMPLE_HOST), ~password_looks_real(pw)).otherwise(plain_user & plain_pw)
    return F.when(s.rlike(URL_PARTS), verdict).otherwise(False)


def is_obvious_fake(s: Column) -> Column:
    # the URL test is by far the dearest, so it comes last and only for values of that shape
    return s.isin(*DOC_EXAMPLES) | F.lower(s).isin(*WEAK_VALUES) | s.rlike(r"\A(.)\1{7,}\z") | s.rlike(TEMPLATE) | (s.contains("://") & is_example_url(s))


def looks_like_placeholder(s: Column) -> Column:
    return holds_any(F.lower(s), PLACEHOLDER_PARTS) | is_obvious_fake(s)


def looks_like_secret_value(s: Column) -> Column:
    """The value given to a sensitive name: random, or mixed like a password, and not marked as a test."""
    marked = looks_like_placeholder(s) | holds_any(F.lower(s), TEST_PARTS)
    return (
        F.when(T.has_space(s) | T.is_url_encoded(s), False)
        .when(T.is_high_entropy(s) | s.rlike(r"\A[0-9a-fA-F]{32,}\z"), True)
        .when(marked, False)
        .otherwise((T.char_classes(s) >= 3) | ((F.length(s) >= T.MIN_TOKEN) & (T.consonant_run(s) >= 6)))
    )


def looks_like_secret_token(s: Column) -> Column:
    """A lone string: long, random or unpronounceable, and neither an id nor an identifier."""
    return (F.length(s) >= T.MIN_TOKEN) & ~T.is_hash_or_id(s) & ~T.is_code_identifier(s) & (T.is_high_entropy(s) | (T.consonant_run(s) >= 6))


def login_url_leaks(s: Column) -> Column:
    """Whether a URL with user and password gives a real login away."""
    pw, host = F.regexp_extract(s, LOGIN_URL, 2), F.regexp_extract(s, LOGIN_URL, 3)
    short_host = F.length(F.substring_index(host, ":", 1)) < 4
    verdict = F.when(is_example_url(s), False).when(short_host, T.is_high_entropy(pw, min_length=12)).otherwise(password_looks_real(pw))
    return F.when(s.rlike(LOGIN_URL), verdict).otherwise(True)
