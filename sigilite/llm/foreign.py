"""Units that nobody here wrote by hand: generated, minified or vendored code and data saved as code.

Linear support-vector classifiers, one per kind, on hashed character n-grams and path components decide.
They are trained on a bounded sample of the table itself, labelled by what gives a unit away (a generator's
notice, a third-party head or folder, minified lines, a body of literals). Each sample goes in twice, as it
is and with those giveaways masked, so that units without them are recognised by their body and place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigilite.session import spread

KINDS = ("generated", "vendored", "minified", "data")
#: Hashed features of each part of a unit: its body, its head and its path.
DIMENSIONS = 1 << 17
#: Units of code the classifiers are trained on, about: the bound of what is collected. Every unit is classified.
SAMPLE = 4000
#: Lines that count as the head of a unit.
HEAD_LINES = 12

# Endings of code, which alone can be a case; what has another ending is prose, data or configuration.
_CODE = re.compile(r"\.(?:py|pyi|js|mjs|cjs|jsx|ts|tsx|go|java|kt|scala|groovy|c|h|cc|cpp|cxx|hpp|cs|rs|rb|php|pl|lua|swift|m|mm|dart|r|jl|sh|bash|sql|css|scss|less|vue|f90|pas|asm|s)$", re.I)
_COMMENT = r"^\s*(?://|#|/\*|\*|--|<!--|;|%)+!?\s*"
_GENERATED = re.compile(
    _COMMENT + r"(?:.*\b(?:code|file|arquivo|c[oó]digo)\b.*\b(?:(?:auto-?|automatically )generated|generated (?:by|from|automatically)|gerado automaticamente|gerado por)|.*\bauto-?generated\b|.*@generated\b|.*<auto-?generated"
    r"|.*\bdo not (?:edit|modify)\b|.*\bn[ãa]o (?:edite|modifique)\b|.*\bgenerated by\b.*\bdo not\b|.*\bmodify by hand\b|.*\b(?:created|written) by (?:the )?(?:tool|script)\b|.*\bcriad[oa] (?:pela ferramenta|pelo script)\b|.*\bfile - changes will be lost)",
    re.I,
)
_CREDIT = re.compile(_COMMENT + r".*\bcopyright\b.*\b(?:contributors|authors)\b", re.I)
_THIRD_DIR = re.compile(r"(?:^|/)(?:vendor(?:ed|s)?|third[_-]?party|3rd[_-]?party|node_modules|bower_components|jspm_packages|externals?|terceiros|site-packages|dist-packages|pods|carthage|godeps)/", re.I)
_HEAD = re.compile(_COMMENT + r"(?:.*\bcopyright\b.*\b(?:contributors|authors)\b|upstream:|.*\bcopied without (?:change|modification)|.*\b(?:MIT|BSD|Apache|Mozilla Public|ISC) Licen[cs]e\b|.*SPDX-License-Identifier)", re.I)
_BUILT = re.compile(r"(?:\.min\.(?:js|css)|\.bundle\.js|\.prod\.js|_pb2(?:_grpc)?\.py|\.pb\.(?:go|cc|h)|\.generated\.\w+|\.designer\.cs)$|[-.][0-9a-f]{8,}\.(?:js|css)$|(?:^|/)(?:gen|generated|dist|proto)/", re.I)
_LITERAL = re.compile(r"(?:0x[0-9A-Fa-f]+|-?\d+(?:\.\d+)?)\s*(?:,|\]|\})\s*|(?:\\x[0-9A-Fa-f]{2})+|\\u[0-9A-Fa-f]{4}|[A-Za-z0-9+/]{48,}={0,2}|\{\"\w+\": |\"\w+\": (?:\"[^\"]*\"|-?[\d.]+)[,}]\s*")
_MASK = re.compile(r"\w")


def plain_evidence(path: str | None, text: str) -> str | None:
    """The label of a unit: what path and text show plainly, or None."""
    p = (path or "").replace("\\", "/")
    lines = text.split("\n")
    head = lines[:HEAD_LINES]
    if any(_GENERATED.match(x) for x in head):
        return "generated"
    if _THIRD_DIR.search(p) or any(_CREDIT.match(x) for x in head) or sum(bool(_HEAD.match(x)) for x in head) >= 2:
        return "vendored"
    size = len(text.strip())
    if size < 200:
        return None
    code = [x for x in lines if x.strip()]
    if re.search(r"\.(?:js|mjs|cjs|css)$", p, re.I):
        space = sum(map(text.count, " \t\r\n")) / len(text)
        if size / len(code) > 200 and space < 0.1:
            return "minified"
    if sum(len(m.group()) for m in _LITERAL.finditer(text)) > 0.6 * size:
        return "data"
    return None


def masked(path: str | None, text: str) -> tuple[str, str]:
    """Path and text without what gives the unit away: notices and credits in the head, folders of third parties."""
    lines = text.split("\n")
    head = ["" if _GENERATED.match(x) or _CREDIT.match(x) or _HEAD.match(x) else x for x in lines[:HEAD_LINES]]
    return _THIRD_DIR.sub("/", (path or "").replace("\\", "/")), "\n".join(head + lines[HEAD_LINES:])


def _is_code(path: str | None, text: str) -> bool:
    """By the ending; a unit without a path is code if it isn't prose: a third of its lines end like statements."""
    p = (path or "").replace("\\", "/")
    if p and not p.startswith("<"):
        return bool(_CODE.search(p))
    if p.startswith("<mens"):
        return False
    code = [x.rstrip() for x in text.split("\n") if x.strip()]
    return len(text.lstrip()) > 0 and text.lstrip()[0] not in "<{[" and sum(x.endswith((";", "{", "}", ":", ")", ",")) for x in code) * 3 > len(code)


def _grams(text: str, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of the distinct character n-grams of a text, in lower case with every digit as 0."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    raw = np.where((raw >= 48) & (raw <= 57), 48, raw).astype(np.uint32)
    out = []
    for n in sizes:
        if len(raw) >= n:
            h = np.full(len(raw) - n + 1, n * 2654435761 % (1 << 32), np.uint32)
            for k in range(n):
                h = (h ^ raw[k : len(raw) - n + 1 + k]) * np.uint32(16777619)
            h ^= h >> np.uint32(15)
            out.append(h)
    return np.unique(np.concatenate(out) % np.uint32(DIMENSIONS)) if out else np.zeros(0, np.uint32)


def features(path: str | None, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): character n-grams of the body and of the head, and path components, each part of length one."""
    lines = text.split("\n")
    parts = [_grams(text, (3, 5)), _grams("\n".join(x for x in lines[:HEAD_LINES] if re.match(_COMMENT, x) or x.startswith("/*")), (4, 6))]
    p = (path or "").replace("\\", "/").lower()
    pieces = {f"dir {x}" for x in p.split("/")[:-1]} | {f"part {re.sub(r'[0-9][0-9a-z]*$', '0', x)}" for x in re.split(r"[/._-]+", p) if x} | {f"end {x}" for x in re.findall(r"\.[a-z]+", p.split("/")[-1])}
    parts.append(np.unique(np.fromiter((zlib.crc32(x.encode("utf-8", "replace")) % DIMENSIONS for x in pieces), np.uint32, len(pieces))))
    index = np.concatenate([x.astype(np.int64) + i * DIMENSIONS for i, x in enumerate(parts)])
    value = np.concatenate([np.full(len(x), 1 / np.sqrt(len(x)) if len(x) else 0.0) for x in parts])
    return index.astype(np.int32), value.astype(np.float32)


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: list[bool], rounds: int = 12, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear SVM by subgradient steps, averaged over the last half of the rounds.

    Errors on the rarer class weigh more, up to four times. With one class only there is nothing to learn:
    the bias lets no unit, or every unit, through."""
    n = len(samples)
    w = np.zeros(3 * DIMENSIONS)
    if len(set(labels)) < 2:
        return w, 1.0 if any(labels) else -1.0
    up = min(4.0, max(1.0, labels.count(False) / labels.count(True)))
    scale, bias, step = 1.0, 0.0, 0
    mean, bias_mean, kept = np.zeros_like(w), 0.0, 0
    order = np.random.RandomState(0)
    for r in range(rounds):
        for i in order.permutation(n):
            x, v = samples[i]
            y = 1.0 if labels[i] else -1.0
            step += 1
            rate = 1 / (decay * (step + n))
            short = y * (scale * float(w[x] @ v) + bias) < 1
            scale *= 1 - rate * decay
            if short:
                move = min(rate, 1.0) * y * (up if y > 0 else 1.0)
                w[x] += move * v / scale
                bias += 0.05 * move
        if r >= rounds // 2:
            mean += scale * w
            bias_mean += bias
            kept += 1
    return mean / kept, bias_mean / kept


Model = dict[str, tuple[np.ndarray, float]]


def classify(model: Model, path: str | None, text: str) -> tuple[str, float]:
    """(kind, margin) of the classifier that is surest; a unit is that kind if the margin is above 0."""
    x, v = features(path, text)
    scores = {k: float(w[x] @ v) + b for k, (w, b) in model.items()}
    kind = max(scores, key=scores.__getitem__)
    return kind, scores[kind]


def repository(path: str | None) -> str:
    """What stands for a repository where a table names none: the first two folders of the path."""
    return "/".join((path or "").replace("\\", "/").split("/")[:-1][:2])


def fit(rows: list[tuple[str | None, str, str | None]]) -> Model:
    """Classifiers from (path, text, label), each row as it is and masked."""
    samples, labels = [], []
    for path, text, label in rows:
        samples.append(features(path, text))
        labels.append(label)
        if label in ("generated", "vendored"):
            samples.append(features(*masked(path, text)))
            labels.append(label)
    return _fit(samples, labels)


def _fit(samples: list, labels: list) -> Model:
    # a kind's own examples against hand-written units and the other kinds
    return {k: train(samples, [y == k for y in labels]) for k in KINDS}


def validate(rows: list[tuple[str | None, str, str | None]], folds: int = 4) -> dict[str, float]:
    """Recall and precision against the labels over held-out repositories, as they are and masked."""
    out = {"n": 0, "cases": 0, "hits": 0, "found": 0, "masked_cases": 0, "masked_hits": 0}
    for f in range(folds):
        held = [zlib.crc32(repository(p).encode()) % folds == f for p, _, _ in rows]
        model = fit([r for r, h in zip(rows, held) if not h])
        for (p, t, y), h in zip(rows, held):
            if not h:
                continue
            hit = classify(model, p, t)[1] > 0
            out["n"] += 1
            out["cases"] += y is not None
            out["found"] += hit
            out["hits"] += hit and y is not None
            if y in ("generated", "vendored"):
                out["masked_cases"] += 1
                out["masked_hits"] += classify(model, *masked(p, t))[1] > 0
    return {**out, "recall": out["hits"] / max(1, out["cases"]), "precision": out["hits"] / max(1, out["found"]), "masked_recall": out["masked_hits"] / max(1, out["masked_cases"])}


def _sampled(rows: DataFrame) -> list[tuple]:
    """Features and labels of about SAMPLE units of code, drawn by the hash of the key; at most twice as many come to the driver."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, p, t in zip(batch["__key"], batch["__path"], batch["__text"]):
                if not _is_code(p, t):
                    continue
                kind = plain_evidence(p, t)
                # a place where tools write, without plain evidence: neither a case nor a counterexample
                if kind is None and _BUILT.search((p or "").replace("\\", "/")):
                    continue
                for path, text in [(p, t)] + ([masked(p, t)] if kind in ("generated", "vendored") else []):
                    x, v = features(path, text)
                    out.append((k, kind or "", x.tobytes(), v.tobytes()))
            yield pd.DataFrame(out, columns=["k", "y", "x", "v"])

    n = max(1, rows.count())
    kept = rows.where(F.pmod(F.xxhash64("__key"), F.lit(n)) < SAMPLE)
    # each key once, however often it is listed
    kept = kept.groupBy("__key").agg(F.max(F.struct("__path", "__text")).alias("r")).select("__key", "r.__path", "r.__text")
    got = kept.mapInPandas(label, f"k {dict(rows.dtypes)['__key']}, y string, x binary, v binary").collect()
    got.sort(key=lambda r: (str(r.k), r.y, len(r.x), bytes(r.x[:64])))
    return [(np.frombuffer(bytes(r.x), np.int32), np.frombuffer(bytes(r.v), np.float32), r.y or None) for r in got]


def foreign_units(df: DataFrame, key: str = "unit_seq", path: str = "path", text: str = "text") -> DataFrame:
    """(key, kind, margin) of the units of code that weren't written by hand here.

    Null keys count as one key in the sample. Null and empty texts give no rows; a row
    listed twice under one key gives its rows twice; a table without any labelled unit gives none. Texts
    of any length are read whole. Further columns are left out."""
    rows = spread(df.select(F.col(key).alias("__key"), F.col(path).alias("__path"), F.col(text).alias("__text")).where("__text IS NOT NULL"))
    got = _sampled(rows)
    model = rows.sparkSession.sparkContext.broadcast(_fit([(x, v) for x, v, _ in got], [y for _, _, y in got]))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, p, t in zip(batch["__key"], batch["__path"], batch["__text"]):
                if _is_code(p, t):
                    kind, margin = classify(model.value, p, t)
                    if margin > 0:
                        out.append((k, kind, margin))
            yield pd.DataFrame(out, columns=["__key", "kind", "margin"])

    return rows.mapInPandas(scan, f"__key {dict(rows.dtypes)['__key']}, kind string, margin double").withColumnRenamed("__key", key)
