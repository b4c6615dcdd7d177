"""Credentials embedded in source code, configuration, notes and messages.

Lines with an anchor (a sensitive word, a scheme, a vendor prefix, a long encoded run) are scanned by
the detectors below. Encoded runs are decoded layer by layer (base64, hex, percent, backslash
escapes) and each layer is scanned again by the same detectors, until a layer holds nothing encoded (every
layer is shorter than the one around it); binary layers are parsed as key containers (DER, OpenSSH). What is found in a layer is redacted by replacing the enclosing encoded
literal, so the code around it stays whole.
"""

from __future__ import annotations

import base64
import binascii
import functools
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigilite.llm.scanning import build, cued_lines, replace_spans
from sigilite.session import spread

_CUES = {
    **{c: "word" for c in ("pass", "pwd", "senha", "secret", "segredo", "token", "chave", "key", "cred", "auth", "bearer", "login", "sig=", "signature=", "assinatura=", "jwt", "pin=", "-u ", "--user", "dsn")},
    **{c: "url" for c in ("://",)},
    **{c: "pem" for c in ("private key", "-----begin")},
    # Prefixes of vendor tokens, lower-cased.
    **{c: "vendor" for c in ("akia", "asia", "agpa", "aida", "aroa", "aipa", "anpa", "anva", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "npm_", "aiza", "xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-", "hooks.slack.com", "sg.", "dop_v1_", "doo_v1_", "dor_v1_", "hf_", "app_usr-", "sk_live_", "rk_live_", "shpat_", "shpca_", "shppa_", "shpss_", "dp.pt.", "lin_api_", "eyj", "sk-")},
}

# Forms of vendor tokens.
_VENDOR = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[A-Z0-9]{16}(?![A-Za-z0-9_])"
    r"|gh[pousr]_[A-Za-z0-9]{36,255}(?![A-Za-z0-9_])|github_pat_[A-Za-z0-9_]{22,255}(?![A-Za-z0-9_])"
    r"|glpat-[A-Za-z0-9_-]{20,50}(?![A-Za-z0-9_])|npm_[A-Za-z0-9]{36}(?![A-Za-z0-9_])"
    r"|AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_])|xox[baprs]-[A-Za-z0-9-]{10,72}(?![A-Za-z0-9_])"
    r"|SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}(?![A-Za-z0-9_-])|SK[0-9a-f]{32}(?![A-Za-z0-9_])"
    r"|do[por]_v1_[0-9a-f]{64}(?![A-Za-z0-9_])|hf_[A-Za-z0-9]{34,64}(?![A-Za-z0-9_])"
    r"|APP_USR-\d+-\d{6}-[0-9a-f]{32}-\d+(?![A-Za-z0-9_])|[sr]k_live_[A-Za-z0-9]{24,99}(?![A-Za-z0-9_])"
    r"|shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}(?![A-Za-z0-9_])|dp\.pt\.[A-Za-z0-9]{43}(?![A-Za-z0-9_])"
    r"|lin_api_[A-Za-z0-9]{40}(?![A-Za-z0-9_])"
    r"|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
    r"|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{32,}(?![A-Za-z0-9_])"
    r")|https://hooks\.slack\.com/services/T[A-Za-z0-9_]+/B[A-Za-z0-9_]+/[A-Za-z0-9_]{16,}"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*://([^\s:/@\"'`<>]*):([^\s@\"'`<>]+)@(?=[A-Za-z0-9\[])")
_CONNECTION = re.compile(r"(?:(?<=[;\"'=\s])|^)(?:Password|PWD|Pwd|Senha)\s*=\s*([^;\"'\s]+)", re.I)
_QUERY = re.compile(r"[?&;](?:[A-Za-z_]*(?:chave|token|key|secret|senha|pass(?:word|wd)?|sig|signature|assinatura))=([^&\s\"'`<>#;]+)", re.I)
_HEADER = re.compile(r"(?:Authorization|Proxy-Authorization)[\"']?\s*[:=]\s*[\"']?(?:Bearer|Basic|Token)\s+([A-Za-z0-9._~+/=-]+)|\bBearer\s+([A-Za-z0-9._~+/=-]{16,})", re.I)
_FLAG = re.compile(r"(?<![\w-])--?(?:password|passwd|pass|senha|token|secret|api-?key|chave|segredo)[= ]+[\"']?([^\s\"']+)", re.I)
_CURL = re.compile(r"(?<![\w-])(?:-u|--user)[= ]+[\"']?[\w.@-]+:([^\s\"':]+)")

#: Words that make a name sensitive.
_SENSITIVE = (
    r"pass(?:word|wd|phrase)?|pwd|senha|secret|segredo|token|jeton|api[_-]?key|apikey|access[_-]?key(?:[_-]?id)?|secret[_-]?key|signing[_-]?key|private[_-]?key|"
    r"encryption[_-]?key|auth[_-]?key|master[_-]?key|account[_-]?key|shared[_-]?key|deploy[_-]?key|chave|credencial|credential|auth"
)
# The name may go on with a qualifier of the credential itself, never with a property of it.
# One character or digit a round: runs of them inside a repeated group make failing matches exponential.
_ASSIGN = re.compile(
    rf"(?<![A-Za-z0-9])(?P<name>(?:[A-Za-z0-9][_.-]?)*?(?:{_SENSITIVE})(?:[_-]?(?:admin|api|acesso|access|privada|pem|id|prod|db|root|user|app|key|b64|base64|value|valor|\d))*)"
    r"[\"'\]]{0,2}(?:\s*:\s*(?:str|string|String))?\s*(?::=|=>|[:=])\s*(?:\(\s*)?(?P<value>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|[^\s\"'`,;)}\]<>]+)",
    re.I,
)
_HAS_SENSITIVE = re.compile(_SENSITIVE, re.I)
_XML = re.compile(rf"<(?P<tag>[\w.-]*(?:{_SENSITIVE})[\w.-]*)>([^<]+)</|(?:key|name)=\"[\w.-]*(?:{_SENSITIVE})(?:[_.-]?\w+)?\"\s+value=\"([^\"]+)\"", re.I)
_TABLE = re.compile(r"\|\s*([^\s|]{8,})\s*\|[^|]*(?:senha|password|token|secret|credencial|chave)|(?:senha|password|token|secret|chave|credencial)[^|\n]*\|\s*([^\s|]{8,})\s*\|", re.I)
_CSV = re.compile(rf"(?:^|[;,\t])\"?[\w.-]*(?:{_SENSITIVE})(?:[_-]?\w+)?\"?[;,\t]\"?([^;,\t\"]+)", re.I)
_PROSE = re.compile(
    r"(?:senha|password|passwd|segredo|secret|token|chave|key|passphrase|credencial)\s+(?:\w+\s+){0,2}?(?:é|e|is|era|was|=|:|->)\s+[\"'`]?([^\s\"'`,;]{6,})"
    r"|(?:usar|use|usando|using|com|with)\s+(?:a |o |the )?(?:senha|password|token|segredo|secret|chave|key)\s+[\"'`]?([^\s\"'`,;]{6,})"
    r"|\blogin\s+[\w.@-]+\s*/\s*([^\s\"'`]{6,})|\b(?:user|usu[aá]rio)\s+[\w.@-]+\s*[/,]\s*(?:senha|password|pass)?:?\s*([^\s\"'`]{6,})",
    re.I,
)

#: Names that end in a property of a credential, not in one.
_PROPERTY = re.compile(
    r"(?:url|uri|len|length|min|max|name|nome|count|rotation|rotacao|ttl|expir\w*|type|tipo|file|path|arquivo|header|policy|hint|reset|field|campo|id_field|limite|modo|public|publica|pub|hash|digest|fingerprint|ref|referencia|size|prefix|version|lifetime|algorithm|format|label|title|param|endpoint|provider|mode|format|status|index|idx)$",
    re.I,
)
_PUBLIC = re.compile(r"public|pub_?key|publica|publishable|foreign|primary|partition|cache_?key|sort_?key|keyboard|keyword|monkey|author", re.I)

#: What stands where a credential would.
_PLACEHOLDER = re.compile(
    r"^(?:(?:x|X|\*|\.|-|_|0|•|#|\?)+|changeme|change[_-]?me|change[_-]?it|placeholder|example|exemplo|sample|dummy|redacted|removed|removid[oa]|secret|password|passwd|senha|token|key|chave|"
    r"segredo|none|null|nil|undefined|true|false|test|teste|todo|tbd|n/a|empty|vazi[oa]|default|root|admin|user|string|str|str\(\)|bool|int|required|optional|value|valor|yes|no|sim|nao|não|"
    r"your[_-].*|seu[_-].*|sua[_-].*|my[_-].*|meu[_-].*|minha[_-].*|troque.*|trocar.*|substitua.*|replace.*|insert.*|fake.*|mock.*|.*placeholder.*|.*changeme.*|.*example.*|.*exemplo.*|test[_-].*|xxx.*|<.*|.*\.\.\.|\[.*\])$",
    re.I | re.S,
)
_REFERENCE = re.compile(
    r"^(?:\$|%\(|%[A-Z_]+%|\{\{|\{[A-Za-z_]|#\{|@\{|<%|\$\(|!|&|\*[a-z])|^(?:os\.|process\.|System\.|getenv|env\b|ENV\b|config\.|cfg\.|settings\.|self\.|this\.|secrets?\.|vault[:.]|arn:|ssm:|sm://|op://|ref\+|file://|data\.|var\.|local\.|"
    r"args\.|params\.|request\.|req\.|ctx\.|options\.|opts\.|input\.|props\.|state\.|get\(|load|read|fetch|cofre|vem\b|from\b)|\(\)|\w\(|\[|vault\.|environ|process\.env|getenv|\$\{|\{\{",
)
_PHRASE = re.compile(r"phrase|frase", re.I)
_UUID = re.compile(r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", re.I)
_DIGEST_NAME = re.compile(r"hash|md5|sha-?\d+|checksum|digest|etag|integrity|fingerprint|revision|commit|idempot|nonce|uuid|trace|request_id|lote_id", re.I)


def usable(value: str, name: str = "") -> bool:
    """Whether a value given to a credential's name looks like one that works."""
    v = value.strip().strip("\"'`").strip()
    if any(c.isspace() for c in v):
        # a pass phrase is words, but only where the name says so
        parts = v.split()
        return len(parts) >= 4 and bool(_PHRASE.search(name)) and len(set(map(str.lower, parts))) == len(parts) and not _PLACEHOLDER.match(v)
    if len(v) < 6 or len(set(v)) < 4:
        return False
    if _PLACEHOLDER.match(v) or _REFERENCE.search(v) or _UUID.match(v):
        return False
    if v.startswith(("/", "./", "~/", "http://", "https://", "-----")) or "://" in v:
        return False
    lower, upper, digit = (any(f(c) for c in v) for f in (str.islower, str.isupper, str.isdigit))
    symbol = any(not c.isalnum() for c in v)
    if not digit and not symbol:
        # letters only: mixed case without the shape of an identifier, and long
        return lower and upper and len(v) >= 16 and not re.fullmatch(r"(?:[A-Z]?[a-z]+)+", v)
    if not digit:
        # words joined by _ - . are names
        return not re.fullmatch(r"[A-Za-zÀ-ÿ]+(?:[_.:/-]+[A-Za-zÀ-ÿ]+)*[.:,;]?", v) and lower
    if re.fullmatch(r"[\d.,:/+-]+", v) or re.fullmatch(r"v?\d+(?:\.\d+)+[\w.-]*", v):
        return False
    if re.fullmatch(r"[a-z]+(?:[_-][a-z]+)*[_-]?\d{1,4}", v) or re.fullmatch(r"[\w.-]+\.(?:py|js|ts|go|java|json|ya?ml|sql|sh|md|txt|env|pem|csv|log|internal|example|test|local)(?::\d+)?", v):
        return False
    return lower + upper + digit + symbol >= (2 if len(v) >= 8 else 3)


def _sensitive_name(name: str) -> bool:
    return not (_PROPERTY.search(name) or _PUBLIC.search(name) or _DIGEST_NAME.search(name))


# --- encoded layers -------------------------------------------------------------------------------

_BASE64 = re.compile(r"(?<![A-Za-z0-9+/=_-])(?:[A-Za-z0-9+/]{12,}={0,2}|[A-Za-z0-9_-]{16,}={0,2})(?![A-Za-z0-9+/=_-])")
_HEX = re.compile(r"(?<![A-Za-z0-9])(?:0x)?((?:[0-9a-fA-F]{2}){8,})(?![A-Za-z0-9])")
# From the first escape on; what stands before it is found by walking left, since a pattern that begins
# with a run would try every place of a long one.
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2}[A-Za-z0-9._~:/?&=+@;!*-]*){2,}")
_BEFORE_PERCENT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._~:/?&=+@;!*-")
_ESCAPED = re.compile(r"(?:\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[0-7]{3})[^\s\"'`\\]*){4,}")
_NOT_BEFORE_ESCAPED = frozenset(" \t\r\n\"'`\\")
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|([0-7]{3}))")


def der_private_key(data: bytes) -> bool:
    """Whether bytes are a private key container: PKCS#1, PKCS#8 (plain or encrypted), SEC 1 or OpenSSH."""
    if data.startswith(b"openssh-key-v1\x00"):
        return True
    body = _tlv(data, 0, 0x30)
    if body is None or body[1] < len(data) - 2:
        return False
    at, end = body
    version = _tlv(data, at, 0x02)
    if version and version[1] - version[0] == 1 and data[version[0]] in (0, 1):
        nxt = version[1]
        if _tlv(data, nxt, 0x02):  # PKCS#1: modulus, exponent, ...
            modulus = _tlv(data, nxt, 0x02)
            return modulus[1] - modulus[0] >= 32 and _tlv(data, modulus[1], 0x02) is not None
        if _tlv(data, nxt, 0x04):  # SEC 1: the key as an octet string
            return True
        algorithm = _tlv(data, nxt, 0x30)  # PKCS#8: algorithm, then the key
        return bool(algorithm and _tlv(data, algorithm[0], 0x06) and _tlv(data, algorithm[1], 0x04))
    algorithm = _tlv(data, at, 0x30)  # encrypted PKCS#8: PBES2 and an octet string, nothing else
    if algorithm and (oid := _tlv(data, algorithm[0], 0x06)) and data[oid[0] : oid[1]].startswith(b"\x2a\x86\x48\x86\xf7\x0d\x01"):
        octets = _tlv(data, algorithm[1], 0x04)
        return bool(octets and octets[1] == end and data[oid[0] : oid[1]][7:8] in (b"\x05", b"\x0c"))
    return False


def _tlv(data: bytes, at: int, tag: int) -> tuple[int, int] | None:
    """(start, end) of the contents of the DER element at ``at``, if it has ``tag`` and fits."""
    if at + 2 > len(data) or data[at] != tag:
        return None
    size, start = data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > len(data):
            return None
        size, start = int.from_bytes(data[start : start + n], "big"), start + n
    return (start, start + size) if start + size <= len(data) else None


def _layers(line: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, decoded bytes) of every encoded literal of a line."""
    for m in _BASE64.finditer(line):
        raw = m.group().rstrip("=")
        if len(raw) % 4 == 1:
            continue
        try:
            data = base64.b64decode(raw.replace("-", "+").replace("_", "/") + "=" * (-len(raw) % 4))
        except (binascii.Error, ValueError):
            continue
        yield m.start(), m.end(), data
    for m in _HEX.finditer(line):
        yield m.start(1), m.end(1), bytes.fromhex(m.group(1))
    at = 0
    for m in _PERCENT.finditer(line):
        lo = m.start()
        while lo > at and line[lo - 1] in _BEFORE_PERCENT:
            lo -= 1
        at = m.end()
        yield lo, at, unquote_to_bytes(line[lo:at])
    at = 0
    for m in _ESCAPED.finditer(line):
        lo = m.start()
        while lo > at and line[lo - 1] not in _NOT_BEFORE_ESCAPED:
            lo -= 1
        at = m.end()
        text = _ESCAPE.sub(lambda e: chr(int(e[1] or e[2], 16) if e[1] or e[2] else int(e[3], 8)), line[lo:at])
        yield lo, at, text.encode("utf-8", "replace")


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if len(text) >= 6 and all(c.isprintable() or c in "\r\n\t" for c in text) else None


@functools.cache
def _automaton():
    return build(_CUES)


def find_in_line(line: str, depth: int = 0) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every credential that begins on a line."""
    out = [(m.start(), m.end(), "vendor") for m in _VENDOR.finditer(line) if not _PLACEHOLDER.match(m.group()[6:])]
    for m in _PEM.finditer(line):
        end = line.find("-----END", m.end())
        out.append((m.start(), end if end > 0 else len(line) if "\\n" in line[m.end() :] else m.end(), "private-key"))
    for m in _URL.finditer(line):
        pw = m.group(2)
        if not (_PLACEHOLDER.match(pw) or _REFERENCE.search(pw)) and len(pw) >= 4 and not (pw.isdigit() and (len(pw) < 6 or pw in "01234567890123456789")):
            out.append((m.start(2), m.end(2), "url"))
    # names in markup, assignments and columns hold a sensitive word, which one search tells
    named = bool(_HAS_SENSITIVE.search(line))
    patterns = [("connection", _CONNECTION), ("query", _QUERY), ("header", _HEADER), ("flag", _FLAG), ("flag", _CURL), ("markup", _XML), ("table", _TABLE), ("prose", _PROSE)]
    for kind, pattern in patterns:
        if pattern is _XML and not named:
            continue
        for m in pattern.finditer(line):
            for g in range(1, (m.lastindex or 0) + 1):
                value = m.group(g)
                if value and g != pattern.groupindex.get("tag") and usable_or_decoded(value, depth):
                    name = m.group()[: m.start(g) - m.start()]
                    if kind == "markup" and not _sensitive_name(re.sub(r"[^\w-]*(?:value)?[^\w-]*$", "", name)):
                        continue
                    out.append((m.start(g), m.end(g), kind))
    for m in _ASSIGN.finditer(line) if named and ("=" in line or ":" in line) else ():
        value, lo = m.group("value"), m.start("value")
        if value[0] in "\"'`":
            value, lo = value[1:-1], lo + 1
        if not _sensitive_name(m.group("name")) or value.startswith("-----"):
            continue
        if value[:1] == "$" or line[m.end() :].startswith(("(", "[")) or (m.group("value")[0] not in "\"'`" and line[m.end() : m.end() + 1] in ("(", "[", "}")):
            continue
        if usable_or_decoded(value, depth, m.group("name")):
            out.append((lo, lo + len(value), "assignment"))
    if depth == 0 and named:
        for m in _CSV.finditer(line):
            if line.count(";") + line.count("\t") + line.count(",") >= 3 and _sensitive_name(m.group()[: m.start(1) - m.start()].strip("\";,\t")) and usable_or_decoded(m.group(1), depth):
                out.append((m.start(1), m.end(1), "table"))
    for lo, hi, data in _layers(line):
        if der_private_key(data):
            out.append((lo, hi, "key-container"))
        elif (text := _readable(data)) is not None and len(text) < hi - lo and _holds(text):
            out.append((lo, hi, "encoded"))
    return out


@functools.lru_cache(maxsize=4096)
def _holds(text: str) -> bool:
    """Whether a decoded layer holds a credential, in it or in a layer below."""
    return any(find_in_line(part, 1) for part in text.split("\n"))


def usable_or_decoded(value: str, depth: int, name: str = "") -> bool:
    """Whether a value works as a credential; an encoded one must do so after decoding."""
    if not usable(value, name):
        return False
    v = value.strip("\"'`")
    for lo, hi, data in _layers(v):
        if lo == 0 and hi == len(v) and (text := _readable(data)) is not None and text.isascii() and 6 <= len(text) < len(v):
            # an encoded text: the words inside decide
            return usable(text) or _holds(text) or not (_PLACEHOLDER.match(text.strip()) or _REFERENCE.search(text) or re.fullmatch(r"[A-Za-z][A-Za-z _.,:-]*", text))
    return True


#: Kinds that are told by their own form, wherever they stand.
_FORMS = frozenset(("vendor", "private-key", "key-container", "url"))
_TEMPLATE_FILE = re.compile(r"\.(?:example|sample|template|dist|tpl|exemplo|modelo)$", re.I)
_LOCK_FILE = re.compile(r"(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|uv\.lock|cargo\.lock|composer\.lock|gemfile\.lock|go\.sum|pipfile\.lock)$", re.I)


def find(text: str | None, path: str | None = None) -> list[tuple[int, int, int, str]]:
    """(line, start, end, kind) of every credential; offsets are those of the text.

    In a template of a configuration file and in a lock file only what is told by its own form counts:
    values given to names there are examples and digests."""
    if not text:
        return []
    p = (path or "").replace("\\", "/")
    forms_only = bool(_TEMPLATE_FILE.search(p) or _LOCK_FILE.search(p))
    out = [(n, lo, hi, "key-container") for n, lo, hi in _wrapped(text)]
    taken = [(lo, hi) for _, lo, hi, _ in out]
    for number, lo, hi in _candidates(text):
        if any(a <= lo < b for a, b in taken):
            continue
        out += [(number, lo + a, lo + b, kind) for a, b, kind in find_in_line(text[lo:hi]) if not forms_only or kind in _FORMS]
    return sorted(out, key=lambda x: x[1])


_RUN = re.compile(
    r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{12,}={0,2}(?![A-Za-z0-9+/=_-])|(?:%[0-9A-Fa-f]{2}[^%\s\"']{0,40}){2}"
    r"|(?:\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[0-7]{3})[^\s\"'`\\]{0,40}){4}"
)


def _encoded(run: str) -> bool:
    """Whether a run may be an encoding of something: identifiers and paths aren't."""
    if run[0] in "%\\" or run.endswith("="):
        return True
    if run.isalpha() and (run.islower() or run.isupper()):
        return False
    if any(c in "_-" for c in run[1:-1]) and not any(c.isdigit() for c in run):
        return False
    lower, upper, digit = any(map(str.islower, run)), any(map(str.isupper, run)), any(map(str.isdigit, run))
    return (lower and upper and (digit or len(run) >= 24)) or (digit and len(run) >= 16 and all(c in "0123456789abcdefABCDEF" for c in run))


_BLOCK = re.compile(r"(?m)^[ \t]*[A-Za-z0-9+/]{40,}\r?\n(?:[ \t]*[A-Za-z0-9+/]{40,}\r?\n)*[ \t]*[A-Za-z0-9+/]+={0,2}[ \t]*\r?$")


def _wrapped(text: str) -> Iterator[tuple[int, int, int]]:
    """(line, start, end) of base64 over several lines that holds a key or a credential. Bodies between
    BEGIN and END lines belong to those."""
    number, at = 1, 0
    for m in _BLOCK.finditer(text):
        number, at = number + text.count("\n", at, m.start()), m.start()
        head = text[:at].rstrip("\r\n")[-80:] if at < 4096 else text[max(0, at - 80) : at].rstrip("\r\n")
        if head.endswith("-----"):
            continue
        raw = "".join(m.group().split()).rstrip("=")
        if len(raw) % 4 == 1:
            continue
        data = base64.b64decode(raw + "=" * (-len(raw) % 4))
        if der_private_key(data) or ((inner := _readable(data)) is not None and _holds(inner)):
            yield number, at + len(m.group()) - len(m.group().lstrip()), m.end()


def _candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """Lines with a cue or a run that may be encoded, in order, each once."""
    seen = {lo: (number, lo, hi) for number, lo, hi, _ in cued_lines(_automaton(), text)}
    number, at = 1, 0
    for m in _RUN.finditer(text):
        if not _encoded(m.group()):
            continue
        lo = text.rfind("\n", 0, m.start()) + 1
        if lo not in seen:
            number, at = number + text.count("\n", at, lo), lo
            hi = text.find("\n", m.end())
            seen[lo] = (number, lo, len(text) if hi < 0 else hi)
    return iter(sorted(seen.values(), key=lambda x: x[1]))


def mask(secret: str, keep: int = 4) -> str:
    """The form of findings.redacted: the ends of a long value, the first character of a short one."""
    s = secret.strip()
    if not s:
        return ""
    return s[:1] + "…" if len(s) <= 2 * keep + 4 else s[:keep] + "…" + s[-keep:]


_PEM_MARK = r"-----{} (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_PEM_BEGIN, _PEM_END = re.compile(_PEM_MARK.format("BEGIN")), re.compile(_PEM_MARK.format("END"))
#: What may follow a BEGIN mark in a block: headers, and base64 with whatever quotes and joins its lines.
_PEM_BODY = re.compile(r"(?:(?:\\n|\\r|[\s\"'+,]|[A-Za-z-]+: [^\n]*(?=\n))*[A-Za-z0-9+/=]{16,}(?![A-Za-z0-9+/=]))+")


def _pem_blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what stands between BEGIN and END of private keys; without an END before the next
    BEGIN, of the base64 that follows directly, if any."""
    for m in _PEM_BEGIN.finditer(text):
        after = _PEM_BEGIN.search(text, m.end())
        end = _PEM_END.search(text, m.end(), after.start() if after else len(text))
        if end:
            yield m.end(), end.start()
        elif body := _PEM_BODY.match(text, m.end()):
            yield m.end(), body.end()


def redact(text: str | None, path: str | None = None) -> str | None:
    """The text with credentials masked in place. Of a private key block every body line is masked, its
    markers, line ends and indentation stay."""
    found = find(text, path)
    if not found:
        return text
    lines = lambda part: re.sub(r"[A-Za-z0-9+/=]{8,}", lambda b: mask(b.group()), part)
    # of a literal over several lines each line is masked, so that line ends and indentation stay
    spans = [(lo, hi, mask(text[lo:hi]) if "\n" not in text[lo:hi] else lines(text[lo:hi])) for _, lo, hi, kind in found if kind != "private-key"]
    spans += [(lo, hi, lines(text[lo:hi])) for lo, hi in _pem_blocks(text)]
    return replace_spans(text, spans)


def find_credentials(df: DataFrame, key: str = "unit_seq", text: str = "text", path: str = "path") -> DataFrame:
    """(key, line, kind), one row per line and kind on which a usable-looking credential begins.

    Lines count from 1 and are split at \\n only. Null and empty texts give no rows; a null or absent
    path tells nothing; a row listed twice under one key gives its rows twice; a text of any length is
    scanned whole. Further columns are left out."""
    of = dict(df.dtypes)[key]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *x) for k, p, t in zip(batch["__key"], batch["__path"], batch["__text"]) for x in sorted({(n, kind) for n, _, _, kind in find(t, p)})]
            yield pd.DataFrame(rows, columns=["__key", "line", "kind"])

    place = F.col(path) if path in df.columns else F.lit(None).cast("string")
    rows = spread(df.select(F.col(key).alias("__key"), place.alias("__path"), F.col(text).alias("__text")).where("__text IS NOT NULL"))
    return rows.mapInPandas(scan, f"__key {of}, line int, kind string").withColumnRenamed("__key", key)


def redact_credentials(df: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """``df`` with credentials in ``text`` masked; all other columns, rows, nulls and texts stay as they are."""

    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([redact(t, p) if isinstance(t, str) else None for t, p in zip(texts, paths)], dtype=object)

    place = F.col(path) if path in df.columns else F.lit(None).cast("string")
    return spread(df).withColumn(text, F.pandas_udf(run, "string")(F.col(text), place))
