"""Personal information inside free text, by anchor expansion.

One Aho-Corasick pass over a text finds at-signs, number cues, street words, titles and given names.
Only lines with such an anchor are looked at again, by the deterministic parsers of the anchor's kind,
which expand it to the whole item and validate it (check digits, domain form, house number).
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigilite.llm.scanning import build, cued_lines, replace_spans
from sigilite.session import spread

TYPES = ("email", "phone", "id_number", "address", "person_name")

#: Given names (Portuguese and English); a parameter of every function here.
GIVEN_NAMES = tuple(
    """Adriana Alberto Alice Amanda Ana André Andreia Anna Antônio António Artur Beatriz Bernardo Bianca Bruna Bruno Camila
    Carla Carlos Catarina Cecília Celina Cíntia Clara Cláudia Cristina Daniel Daniela Davi David Débora Diego Diogo Edgar
    Edson Eduardo Elena Elisa Eliza Emily Emma Fábio Fabiana Felipe Fernanda Fernando Francisco Gabriel Gilda Gilberto
    Guilherme Gustavo Heitor Helen Helena Henrique Igor Inês Irene Isabel Ivo James Jane Joana João John Jorge José Joseph
    Juliana Júlia Júlio Karen Kátia Laís Lara Laura Leandro Letícia Lígia Linda Lívia Lucas Lúcia Luís Luísa Luiz Luiza
    Marcelo Márcia Marcos Margaret Maria Mariana Marina Mário Marta Martha Mary Matheus Michael Miguel Mônica Natália Nélson
    Nilo Nina Norma Olga Oscar Otávio Patrícia Paula Paulo Pedro Peter Quitéria Rafael Raquel Raul Regina Renata Renato
    Ricardo Rita Robert Roberto Rodrigo Rogério Rosana Rui Ruth Samuel Sandra Sara Sérgio Sílvia Simon Simone Sofia Sônia
    Susan Tânia Teresa Thiago Thomas Tiago Úrsula Valéria Vanessa Vera Vicente Vinícius Vítor Vitória Wagner Wanda William
    Yara Yasmin Zeca Zélia""".split()
)

_TITLES = r"Sra?|Dra?|Mr|Mrs|Ms|Sr\.ª|Prof|Profa"
#: Words before a person in notes, headers and messages.
_ROLES = (
    r"titular|falar com|[Cc]ontat(?:e|o|ar)|contacto|[Aa]uthor:|[Rr]esponsável:|[Rr]esponsavel:|Signed-off-by:|Co-authored-by:|Reviewed-by:|[Rr]eported by|[Ss]hip to|"
    r"Atenciosamente,|[Rr]egards,|o registro de|a registro de|nome=|name=|assinado por|autor:|Autora?:|responsavel:|responsável:"
)

_CUES = {
    **{c: "email" for c in ("@", "arroba", "(at)", "[at]", "{at}", " at ", "&#64;", "%40")},
    **{f"{d}-": "number" for d in "0123456789"},
    **{c: "number" for c in ("(", "+", "0xx", " 9", "cpf", "cnpj", "rg ", "rg:", "rg.", "/000", "doc", "tel", "fone", "itular", "identidade")},
    **{f"{d} ": "number" for d in "0123456789"},
    **{f"{d}.": "number" for d in "0123456789"},
    **{c: "address" for c in ("rua ", "r. ", "av. ", "av ", "avenida ", "travessa ", "tv. ", "alameda ", "al. ", "praça ", "praca ", "pç. ", "rodovia ", "estrada ", "largo ", "viela ", "ladeira ", "beco ", " street", " st.", " st ", " lane", " road", " rd.", " rd", " ave", " avenue", " drive", " dr.", " boulevard", " blvd", " court", " way", " place", " square")},
    **{c: "name" for c in ("sra.", "sr.", "dra.", "dr.", "sra ", "mr.", "mrs.", "ms.", "prof", "titular", "falar com", "author:", "autor", "responsável", "responsavel", "signed-off-by", "-by:", "reported by", "ship to", "atenciosamente", "regards", "registro de", "nome=", "name=", "contat", "assinado")},
}


def _folded(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))


@functools.cache
def _spellings(names: tuple[str, ...]) -> tuple[str, ...]:
    """Names with and without their accents, each once."""
    return tuple(dict.fromkeys([*names, *map(_folded, names)]))


@functools.cache
def _automaton(names: tuple[str, ...]):
    return build({**_CUES, **{n.lower(): "name" for n in _spellings(names)}})


# --- emails ---------------------------------------------------------------------------------------

_AT = r"(?:@|\s*[\[({](?:at|arroba)[\])}]\s*|\s+arroba\s+|&#64;|%40)"
_DOT = r"(?:\.|\s*[\[({](?:dot|ponto)[\])}]\s*)"
_EMAIL = re.compile(rf"(?<![\w.+@/-])([A-Za-z0-9](?:[\w.+'-]*[\w+])?)({_AT})([A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[\w-]*[A-Za-z0-9])?)*{_DOT}([A-Za-z]{{2,24}}))(?![\w@])")


def emails(line: str) -> Iterator[tuple[int, int]]:
    """Addresses, also written with [at] and [dot] words. Not: the user part of a URL, a remote
    (user@host:path), a package version (its domain ends in a number), a name of a file."""
    for m in _EMAIL.finditer(line):
        before, after = line[: m.start()], line[m.end() :]
        token = re.search(r"\S*$", before).group()
        if "://" in token and "mailto:" not in token.lower():
            continue
        if re.match(r":(?!\s|$)[\w~/.]", after) and not re.match(r":\d+\b", after):
            continue
        if after[:1] == "/" or (token.endswith(":") and "://" in before[-120:] and " " not in before[before.rfind("://") :]):
            continue
        yield m.start(), m.end()


# --- phones and identity numbers ------------------------------------------------------------------

_PHONE = re.compile(
    r"(?<![\w+/.-])(?:"
    r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d[ .-]?\d{3,4}[ .-]?\d{3,4}"
    r"|\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,5}[ .-]?\d{3,5}"
    r"|\+\d{1,3}[ .-]\d{2,4}[ .-]\d?[ .-]?\d{3,5}[ .-]?\d{3,5}"
    r"|\+\d{11,13}"
    r"|\(\d{2,3}\)[ .-]?(?:9[ .-]?)?\d{4}[ .-]?\d{4}"
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}"
    r"|0xx?[ -]?\(?\d{2}\)?[ .-]?9?\d{4}[ .-]?\d{4}"
    r"|0?\d{2}[ ]9[ ]?\d{4}[ .-]?\d{4}"
    r"|\d{2}[ ][2-5]\d{3}[.-]\d{4}"
    r"|9\d{4}-\d{4}"
    r")(?![\w+/=-]|[.,]\d)"
)
_CPF = re.compile(r"(?<![\w./+-])(?:\d{3}([ .])\d{3}\1\d{3}[ .-]?\d{2}|\d{9}-\d{2}|\d{11})(?![\w/+=-]|\.\d)")
_CNPJ = re.compile(r"(?<![\w.+-])(?:\d{2}[ .]\d{3}[ .]\d{3}[/ ]\d{4}[- ]?\d{2}|\d{8}/\d{4}-?\d{2}|\d{12}-\d{2}|\d{14})(?![\w/+=-]|\.\d)")
_RG = re.compile(r"(?<![A-Za-z0-9_])(?:RG|R\.G\.|[Ii]dentidade)[ :.nº°]*\d{1,2}\.?\d{3}\.?\d{3}-?[\dXx](?!\w)")
_ID_WORD = re.compile(r"cpf|cnpj|\bdoc|documento|titular", re.I)


def _mod11(digits: list[int], weights: range | list[int]) -> int:
    rest = sum(d * w for d, w in zip(digits, weights)) % 11
    return 0 if rest < 2 else 11 - rest


def valid_cpf(text: str) -> bool:
    d = [int(c) for c in text if c.isdigit()]
    return len(d) == 11 and len(set(d)) > 1 and _mod11(d, range(10, 1, -1)) == d[9] and _mod11(d, range(11, 1, -1)) == d[10]


def valid_cnpj(text: str) -> bool:
    d = [int(c) for c in text if c.isdigit()]
    w = [*range(5, 1, -1), *range(9, 1, -1)]
    return len(d) == 14 and len(set(d)) > 1 and _mod11(d, w) == d[12] and _mod11(d, [6, *w]) == d[13]


def id_numbers(line: str) -> Iterator[tuple[int, int]]:
    """CPF and CNPJ with right check digits, and RG after its name. Bare digits need a word for them."""
    for pattern, valid, bare in ((_CPF, valid_cpf, 11), (_CNPJ, valid_cnpj, 14)):
        for m in pattern.finditer(line):
            if valid(m.group()) and (len(m.group()) > bare or _ID_WORD.search(line)):
                yield m.span()
    for m in _RG.finditer(line):
        yield m.span()


def phones(line: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(line):
        if not any(m.start() < hi and lo < m.end() for lo, hi in taken):
            yield m.span()


# --- addresses ------------------------------------------------------------------------------------

_STREET_NAME = (
    r"(?:(?:[Rr]ua|R\.|[Aa]venida|[Aa]v\.?|[Tt]ravessa|Tv\.|[Aa]lameda|Al\.|[Pp]raça|[Pp]raca|Pç\.|[Rr]odovia|[Ee]strada|[Ll]argo|[Vv]iela|[Ll]adeira|[Bb]eco)\s+"
    r"(?:(?:d[aeo]s?|e)\s+)?[A-ZÀ-Ý\d][\w'À-ÿ.]*(?:\s+(?:(?:d[aeo]s?|e)\s+)?[A-ZÀ-Ý][\w'À-ÿ.]*)*)"
)
_STREET = re.compile(r"(?<!\w)" + _STREET_NAME)
_ADDRESS = re.compile(
    r"(?<!\w)" + _STREET_NAME + r"\s*,?\s*(?:(?:n|N)\S{0,3}\s*)?\d{1,5}(?!\d)(?:\s*\([^)]{1,20}\))?(?:,?\s*(?:apto|ap\.|bloco|sala|casa|CEP)\s*[\w-]+)*"
)
_ENGLISH = re.compile(
    r"(?<![\w.-])\d{1,5}\s+(?:[A-Z][a-z'A-Z]+\s+){1,4}(?:Street|St\.?|Lane|Ln\.?|Road|Rd\.?|Avenue|Ave\.?|Drive|Dr\.?|Boulevard|Blvd\.?|Court|Ct\.?|Way|Place|Square|Terrace)(?![a-z])(?:,?\s*(?:Unit|Apt\.?|Suite|Flat)\s*\w+)?"
)


def addresses(line: str) -> Iterator[tuple[int, int]]:
    """Street and number; a street name without a number is no address."""
    for p in (_ADDRESS, _ENGLISH):
        for m in p.finditer(line):
            yield m.span()


# --- names ----------------------------------------------------------------------------------------

_WORD = r"[A-ZÀ-Ý][a-zà-ÿ'’]+(?:-[A-ZÀ-Ý][a-zà-ÿ]+)?"
_LINK = r"(?:\s+(?:d[aeo]s?|de la|e|von|van))?"
_REST = rf"(?:(?:\s+[A-Z]\.)*{_LINK}\s+{_WORD})"


@functools.cache
def _name_patterns(names: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    names = _spellings(names)
    given = "|".join(sorted(map(re.escape, names), key=len, reverse=True))
    upper = "|".join(sorted((re.escape(n.upper()) for n in names), key=len, reverse=True))
    edge, end = r"(?<![\wÀ-ÿ.@/\\-])", r"(?![\wÀ-ÿ@=(\[]|[-.][\w])"
    plain = re.compile(rf"{edge}(?:(?!Atenciosamente|Regards|Cordialmente){_WORD}, )?(?:{given}){_REST}*{end}")
    capitals = re.compile(rf"{edge}(?:[A-ZÀ-Ý]{{3,}}, )?(?:{upper})(?:\s+[A-Z]\.)*(?:\s+(?:D[AEO]S?))?(?:\s+[A-ZÀ-Ý]{{3,}})+(?!\w)")
    cued = re.compile(rf"(?<!\w)(?:(?:{_TITLES})\.?\s+|(?:{_ROLES})\s*)((?:{_WORD}, )?{_WORD}{_REST}*)(?![\wÀ-ÿ@])")
    return plain, capitals, cued


#: Capitalised words that follow a title or role without being a person.
_NOT_NAMES = frozenset("Team Time Equipe Grupo Turma Squad Guilda Comitê Núcleo Server Servidor Tuesday Monday".split())


def person_names(line: str, taken: list[tuple[int, int]], names: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Full names or one part of a name, outside street names and email addresses."""
    taken = [*taken, *(m.span() for m in _STREET.finditer(line))]
    plain, capitals, cued = _name_patterns(names)
    spans = [m.span() for p in (plain, capitals) for m in p.finditer(line)]
    spans += [m.span(1) for m in cued.finditer(line) if m.group(1).split()[0].strip(",") not in _NOT_NAMES]
    for lo, hi in spans:
        if not any(lo < b and a < hi for a, b in taken):
            yield lo, hi


def find_in_line(line: str, kinds: set[str], names: tuple[str, ...] = GIVEN_NAMES) -> list[tuple[int, int, str]]:
    """(start, end, type) of the items in a line whose anchors are of ``kinds``."""
    out = [(lo, hi, "email") for lo, hi in emails(line)] if "email" in kinds else []
    if "address" in kinds:
        out += [(lo, hi, "address") for lo, hi in addresses(line)]
    if "number" in kinds:
        ids = list(id_numbers(line))
        out += [(lo, hi, "id_number") for lo, hi in ids]
        out += [(lo, hi, "phone") for lo, hi in phones(line, [*ids, *((a, b) for a, b, t in out if t == "address")])]
    if "name" in kinds:
        # an @ without a valid address around it still isn't a place for a name
        mails = [m.span() for m in re.finditer(r"\S*(?:@|\[arroba\]|\(at\)|\[at\])\S*", line)]
        out += [(lo, hi, "person_name") for lo, hi in person_names(line, [(a, b) for a, b, t in out if t in ("email", "address")] + mails, names)]
    return out


def find(text: str | None, names: tuple[str, ...] = GIVEN_NAMES) -> list[tuple[int, int, int, str]]:
    """(line, start, end, type) of every item; offsets are those of the text."""
    if not text:
        return []
    out = []
    for number, lo, hi, kinds in cued_lines(_automaton(names), text):
        out += [(number, lo + a, lo + b, t) for a, b, t in find_in_line(text[lo:hi], kinds, names)]
    return out


def redact(text: str | None, names: tuple[str, ...] = GIVEN_NAMES) -> str | None:
    """The text with each item replaced by <EMAIL>, <PHONE>, <ID_NUMBER>, <ADDRESS> or <PERSON_NAME>."""
    found = find(text, names)
    return replace_spans(text, [(lo, hi, f"<{t.upper()}>") for _, lo, hi, t in found]) if found else text


def find_personal(df: DataFrame, key: str = "unit_seq", text: str = "text", names: tuple[str, ...] = GIVEN_NAMES) -> DataFrame:
    """(key, line, pii_type), one row per type and line of each input row; lines count from 1, split at \\n.

    Null and empty texts give no rows; a row listed twice under one key gives its rows twice."""
    kind = dict(df.dtypes)[key]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *x) for k, t in zip(batch["__key"], batch["__text"]) for x in sorted({(n, kind) for n, _, _, kind in find(t, names)})]
            yield pd.DataFrame(rows, columns=["__key", "line", "pii_type"])

    rows = spread(df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where("__text IS NOT NULL"))
    return rows.mapInPandas(scan, f"__key {kind}, line int, pii_type string").withColumnRenamed("__key", key)


def redact_personal(df: DataFrame, text: str = "text", names: tuple[str, ...] = GIVEN_NAMES) -> DataFrame:
    """``df`` with the items in ``text`` replaced; all other columns, rows, nulls and texts stay as they are."""
    udf = F.pandas_udf(lambda texts: texts.map(lambda t: redact(t, names) if isinstance(t, str) else None), "string")
    return spread(df).withColumn(text, udf(F.col(text)))
