"""The rules a scan applies, as data, and the settings of a scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession

from sigilite.functions import taxid, verdicts

# Severities from the lowest to the highest; the index is the rank.
SEVERITIES = ("info", "low", "medium", "high", "critical")

OWASP_EDITION = "2025"
# Names of the classes.
_OWASP = {
    "A01": "A01:2025 Broken Access Control", "A02": "A02:2025 Security Misconfiguration", "A03": "A03:2025 Software Supply Chain Failures",
    "A04": "A04:2025 Cryptographic Failures", "A07": "A07:2025 Authentication Failures",
}

_REVOKE = "Revoke or rotate it now: a secret stays in the history after its removal. Then load it from the environment or a vault."

# Names that make an assignment sensitive, after a boundary and inside a camelCase name.
SENSITIVE = r"password|passwd|pwd|secret[_-]?key|secret|token|api[_-]?key|apikey|access[_-]?key|client[_-]?secret|auth[_-]?token|private[_-]?key"
SENSITIVE_CAMEL = r"password|passwd|secret[_-]?key|client[_-]?secret|api[_-]?key|apikey|access[_-]?key|auth[_-]?token|private[_-]?key"
# Words one of which a line must hold for a long random string to count.
SECRET_CONTEXT = (
    "secret", "token", "key", "keys", "password", "passwd", "passphrase", "pwd", "pass", "apikey", "access", "auth", "authorization",
    "authtoken", "oauth", "credential", "cred", "bearer", "private", "encrypt", "encryption",
)
# Words that make a random string on their line a digest.
HASH_CONTEXT = ("hash", "md5", "sha1", "sha256", "sha512", "checksum", "digest", "etag", "integrity", "fingerprint", "revision", "commit", "idempotency")
# Names of environment files, and what turns one into a template.
DOTENV_NAMES = (".env", ".env.*", "*.env", ".envrc")
DOTENV_TEMPLATES = ("*.example", "*.sample", "*.template", "*.dist")
# Valid numbers known from tutorials.
TUTORIAL_CPF = ("123.456.789-09", "111.444.777-35")

#: Rules whose findings weigh one rank less in test files.
SOFT_IN_TESTS = ("generic-assignment", "high-entropy-string")
#: Why something wasn't scanned.
SKIP_REASONS = ("directory", "size", "noise", "binary", "long_line")


#: What one test for all rules of vendors' tokens looks for before any of them is tried.
LONG_RUN = r"[A-Za-z0-9_.-]{15}"
#: Parts of all sensitive names.
_NAME_PARTS = "passw|pwd|secret|token|key"


@dataclass(frozen=True)
class Rule:
    """``before``, ``secret`` and ``after`` are parts of one pattern (Java syntax); ``literals`` are strings
    one of which any matching line holds, letter case included; ``folded`` is a pattern for the same, blind to
    case; ``long_run`` says that any match holds a run of LONG_RUN letters, digits and ``_.-``. ``validator`` maps the secret to a boolean Column."""

    id: str
    severity: str
    secret: str
    before: str = ""
    after: str = ""
    literals: tuple[str, ...] = ()
    folded: str = ""
    long_run: bool = False
    category: str = "secret"
    cwe: str | None = "CWE-798"
    owasp: str | None = _OWASP["A02"]
    title: str = ""
    recommendation: str = _REVOKE
    min_entropy: float | None = None
    keywords: tuple[str, ...] = ()
    validator: Callable[[Column], Column] | None = None
    only_files: tuple[str, ...] = ()
    not_files: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.title:
            tail = " number in text" if self.category == "pii" else " exposed"
            object.__setattr__(self, "title", self.id.replace("-", " ").capitalize() + tail)
        if self.severity not in SEVERITIES:
            raise ValueError(f"{self.id}: unknown severity {self.severity}")

    @property
    def rank(self) -> int:
        return SEVERITIES.index(self.severity)

    @property
    def pattern(self) -> str:
        """Group 1 is what precedes the secret, group 2 the secret. (?d): only \\n ends a line; (?U): classes of all scripts."""
        return f"(?Ud)({self.before})({self.secret}){self.after}"


def _vendor(id: str, secret: str, literals: tuple[str, ...], severity: str = "high", after: str = r"\b", owasp: str = "A02", **other) -> Rule:
    return Rule(id, severity, secret, r"\b", after, literals, owasp=_OWASP[owasp], **{"long_run": True, **other})


# Ids, severities, classes and patterns of all rules.
RULES = (
    Rule("private-key", "critical", "-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY-----", literals=("PRIVATE KEY-----",), cwe="CWE-321", owasp=_OWASP["A04"]),
    _vendor("aws-access-key-id", "(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[A-Z0-9]{16}", ("AKIA", "ASIA", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA")),
    Rule("aws-secret-access-key", "high", "[0-9a-zA-Z/+]{40}", r"(?i:aws.{0,24}?(?:secret|sk)[^\n]{0,24}?)['\x22]", r"['\x22]", ("'", '"'), "aws", min_entropy=4.2),
    _vendor("github-token", "(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,255}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), owasp="A07"),
    _vendor("github-pat-fine-grained", "github_pat_[0-9A-Za-z_]{22,255}", ("github_pat_",), owasp="A07"),
    _vendor("gitlab-pat", "glpat-[0-9A-Za-z_-]{20,50}", ("glpat-",), owasp="A07"),
    _vendor("npm-token", "npm_[0-9A-Za-z]{36}", ("npm_",), owasp="A03"),
    _vendor("google-api-key", r"AIza[0-9A-Za-z_\-]{35}", ("AIza",)),
    _vendor("slack-token", "xox[baprs]-[0-9A-Za-z-]{10,48}", ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("slack-webhook", "medium", r"https://hooks\.slack\.com/services/T[A-Za-z0-9_]+/B[A-Za-z0-9_]+/[A-Za-z0-9_]{16,}", literals=("hooks.slack.com",), long_run=True, cwe="CWE-200", owasp=_OWASP["A01"]),
    _vendor("sendgrid-api-key", r"SG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}", ("SG.",), after="(?![0-9A-Za-z_-])"),
    _vendor("twilio-api-key", "SK[0-9a-f]{32}", ("SK",)),
    _vendor("digitalocean-token", "(?:dop|doo|dor)_v1_[0-9a-f]{64}", ("dop_v1_", "doo_v1_", "dor_v1_")),
    _vendor("huggingface-token", "hf_[A-Za-z0-9]{34,64}", ("hf_",), owasp="A03"),
    _vendor("mercadopago-access-token", r"APP_USR-\d+-\d{6}-[0-9a-f]{32}-\d+", ("APP_USR-",), severity="critical"),
    _vendor("stripe-secret-key", "(?:sk|rk)_live_[0-9a-zA-Z]{24,99}", ("sk_live_", "rk_live_"), severity="critical"),
    _vendor("shopify-token", "shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}", ("shpat_", "shpca_", "shppa_", "shpss_")),
    _vendor("doppler-token", r"dp\.pt\.[A-Za-z0-9]{43}", ("dp.pt.",), severity="critical"),
    _vendor("linear-api-key", "lin_api_[A-Za-z0-9]{40}", ("lin_api_",), owasp="A07"),
    _vendor("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", ("eyJ",), severity="medium", owasp="A07", cwe="CWE-522"),
    _vendor(
        "db-connection-uri",
        r"(?:postgres|postgresql|mysql|mongodb(?:\+srv)?|redis|rediss|amqp|amqps)(?:\+[a-z0-9]+)?://[^:@\s/]*:[^@\s/]+@[^\s'\x22]+",
        ("://",),
        after="",
        long_run=False,
    ),
    _vendor(
        "basic-auth-url", r"https?://[^:@\s/]*:[^@\s/]{3,}@[^\s'\x22]+", ("http://", "https://"), severity="medium", after="", owasp="A07", cwe="CWE-522",
        long_run=False, validator=verdicts.login_url_leaks,
    ),
    Rule(
        "generic-assignment", "medium", r"[^\x22'\n]{8,}",
        rf"(?:(?<![A-Za-z0-9])(?i:{SENSITIVE})|(?<=[a-z0-9])(?=[A-Z])(?i:{SENSITIVE_CAMEL}))(?![A-Za-z0-9])[\x22' ]?\s*[:=]\s*[\x22']", r"[\x22']",
        ("'", '"'), _NAME_PARTS, validator=verdicts.looks_like_secret_value,
    ),
    Rule("secret-in-path", "medium", "[A-Za-z0-9+_=-]{24,}", "/", r"(?=[/\x22'\s?#]|\z)", ("/",), category="entropy"),
    Rule(
        "dotenv-assignment", "high", r"[^\s\x22'\n(){}\[\]$;,<>]{8,80}",
        rf"^[ \t]*(?:export[ \t]+)?[A-Za-z0-9_]*(?<![A-Za-z0-9])(?i:{SENSITIVE})(?![A-Za-z0-9])[A-Za-z0-9_]*[ \t]*=[ \t]*", r"[ \t]*\z",
        ("=",), _NAME_PARTS, only_files=DOTENV_NAMES, not_files=DOTENV_TEMPLATES,
    ),
    Rule("high-entropy-string", "medium", "[A-Za-z0-9+/_-]{24,}={0,2}", "(?<![A-Za-z0-9+/_-])", "(?![A-Za-z0-9+/_-])", category="entropy", keywords=SECRET_CONTEXT),
    Rule(
        "cpf", "low", r"\d{3}\.\d{3}\.\d{3}-\d{2}", r"\b", r"\b", (".",), category="pii", cwe="CWE-359", owasp="A04:2025 / LGPD art. 46",
        validator=lambda s: taxid.cpf_valid(s) & ~s.isin(*TUTORIAL_CPF), recommendation="Personal data in plain text. Remove, mask or pseudonymise it.",
    ),
    Rule(
        "cnpj", "info", r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}", r"\b", r"\b", (".",), category="pii", cwe="CWE-359", owasp="A04:2025 / LGPD",
        validator=taxid.cnpj_valid, recommendation="Company number in plain text. Check whether it must be kept here.",
    ),
)


@dataclass(frozen=True)
class Config:
    """Settings of a scan. ``rules`` replaces the catalog; ids in it must be unique."""

    rules: tuple[Rule, ...] = RULES
    max_file_size: int = 5_000_000
    max_line_length: int = 4_000
    use_entropy: bool = True
    only: frozenset[str] = frozenset()
    skip: frozenset[str] = frozenset()
    skip_categories: frozenset[str] = frozenset()
    demote_tests: bool = True
    scan_noise_files: bool = False
    #: Marks of a line that is to be left alone, in lower case.
    allow_markers: tuple[str, ...] = ("sigilite:allow", "sigilite: allow", "pragma: allowlist secret")
    # Folders, names, endings of what isn't scanned.
    exclude_dirs: frozenset[str] = frozenset(
        ".git .hg .svn node_modules .venv venv env site-packages __pycache__ .mypy_cache .pytest_cache .ruff_cache dist build .idea .gradle target vendor".split()
    )
    noise_files: frozenset[str] = frozenset(
        "uv.lock poetry.lock pipfile.lock package-lock.json packages.lock.json yarn.lock pnpm-lock.yaml npm-shrinkwrap.json composer.lock gemfile.lock "
        "cargo.lock go.sum flake.lock deno.lock bun.lockb .git-blame-ignore-revs .terraform.lock.hcl".split()
    )
    noise_suffixes: tuple[str, ...] = (".lock", ".min.js", ".min.css", ".map", ".snap")
    binary_exts: frozenset[str] = frozenset(
        ".png .jpg .jpeg .gif .webp .ico .pdf .zip .gz .tar .7z .rar .jar .war .class .exe .dll .so .dylib .woff .woff2 .ttf .eot .mp3 .mp4 .mov .pyc".split()
    )
    unknown: tuple[str, ...] = field(default=(), init=False)

    def __post_init__(self):
        ids = [r.id for r in self.rules]
        if len(set(ids)) < len(ids):
            raise ValueError("rule ids must be unique")
        bad = sorted((self.only | self.skip) - set(ids)) + sorted(self.skip_categories - {r.category for r in self.rules})
        object.__setattr__(self, "unknown", tuple(bad))

    def enabled(self, rule: Rule) -> bool:
        """``only`` leaves nothing else; then ids, categories and the entropy switch take rules away."""
        if self.only and rule.id not in self.only:
            return False
        return rule.id not in self.skip and rule.category not in self.skip_categories and (self.use_entropy or rule.category != "entropy")

    def active(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if self.enabled(r))

    def with_rules(self, *rules: Rule) -> Config:
        return replace(self, rules=(*self.rules, *rules))


def rules_frame(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The catalog as a table; a few dozen rows, so it may be broadcast."""
    rows = [(i, r.id, r.title, r.severity, r.rank, r.category, r.cwe, r.owasp, r.recommendation) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_no int, rule_id string, title string, severity string, severity_rank int, category string, cwe string, owasp string, recommendation string")
