"""Garbled text from a wrong character encoding.

Characters are mapped back to the bytes of a legacy code page. A byte-structure automaton marks the
maximal spans of well-formed multibyte UTF-8, and only those spans are decoded, again and again while
that changes anything (text garbled twice). Lines whose characters come from one single-byte code page
read as another are found by the shapes such a mix-up leaves inside words and decoded as a whole.
U+FFFD marks what is lost: the line is found, but not restored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigilite.session import spread

#: Code pages by which UTF-8 may have been read.
MULTIBYTE_PAGES = ("cp1252", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "iso8859_15", "koi8_r")
#: Code pages by which single-byte Western text may have been read.
SINGLE_PAGES = ("mac_roman", "cp850", "cp437", "cp1251", "koi8_r", "cp1250")
#: What plain Western text uses beyond ASCII.
WESTERN = frozenset("áâãàäåçéêèëíîìïñóôõòöúûùüýÿÁÂÃÀÄÅÇÉÊÈËÍÎÌÏÑÓÔÕÒÖÚÛÙÜÝßæÆøØœŒºª°§«»“”‘’–—…€£©®¿¡·")

_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_RUN = re.compile(r"[^\x00-\x7f]+")


@functools.cache
def page(name: str) -> dict[str, int]:
    """Character -> byte for the upper half of a code page. Bytes that cp1252 leaves open are read as C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if name == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


def utf8_spans(data: list[int]) -> Iterator[tuple[int, int]]:
    """Maximal spans of well-formed multibyte sequences; -1 stands for a character without a byte.

    States: 0 between sequences, else the number of continuation bytes still due, with the range
    the next of them must lie in (no overlong forms, surrogates or values past U+10FFFF)."""
    start = begin = -1
    due, lo, hi = 0, 0x80, 0xBF
    for i, b in enumerate([*data, -1]):
        if due:
            if lo <= b <= hi:
                due, lo, hi = due - 1, 0x80, 0xBF
                if due == 0 and start < 0:
                    start = begin
                continue
            if start >= 0:
                yield start, begin
                start = -1
            due = 0
        if 0xC2 <= b <= 0xF4:
            begin = i
            due = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            lo, hi = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
        elif start >= 0:
            yield start, i
            start = -1


_CLOSING = frozenset("»”’“‘«›")


def _likely(text: str, source: str, before: str, after: str, table: dict[str, int]) -> bool:
    """Whether a decoded span is what people write, rather than a chance hit on correct text (an accented
    capital before a closing quote, say).

    Plain are Latin-1, punctuation, and characters of the page itself (text garbled twice). Characters of
    other ranges need a second one beside them, three bytes or more (no chance hit is that long), or a place
    a letter could have: between letters, or by itself without a quote as its last byte."""
    if all(c <= "ÿ" or "‐" <= c <= "™" or c in table for c in text):
        return True
    if not all(c in table or c > "ÿ" for c in text):
        return False
    if len(text) > 1 or len(source) >= 3:
        return all(c in table or c > "ʯ" for c in text) or len(source) >= 3 or before.isalpha() or after.isalpha()
    if not text.isalpha():
        return False
    if after.isalpha() and (not before or before.isalpha() or before.isspace()):
        return True
    return source[-1] not in _CLOSING and not after.isalpha() and (before.isalpha() and before.islower() or not before.isalpha())


def decode_spans(line: str, name: str) -> tuple[str, int]:
    """(line with its spans decoded, number of characters gained by it)."""
    table = page(name)
    out, at, gained = [], 0, 0
    for run in _RUN.finditer(line):
        data = [table.get(c, -1) for c in run.group()]
        for lo, hi in utf8_spans(data):
            # spans reach past a run only over characters that aren't bytes of the page
            text = bytes(data[lo:hi]).decode("utf-8")
            a, b = run.start() + lo, run.start() + hi
            if _likely(text, line[a:b], line[a - 1 : a], line[b : b + 1], table):
                out += [line[at:a], text]
                at = b
                gained += hi - lo - len(text)
    return "".join(out) + line[at:], gained


#: U+FFFD stands for what was lost beside the letters of a word, or in a row; alone between signs it is a literal.
_LOST = re.compile("[^\\W_]�|�[^\\W_]|��")


# A letter of a word that case or script rules out: an upper-case accented letter between lower-case
# letters, a symbol or foreign letter inside a Latin word.
_UPPER_INSIDE = re.compile(r"[a-zà-öø-ÿ][À-ÖØ-Þ][a-zà-öø-ÿ]|(?<![A-Za-zÀ-ÿ])[a-z]+[À-ÖØ-Þ](?![A-Za-zÀ-ÿ])")
_SYMBOL_INSIDE = re.compile(r"[A-Za-zÀ-ÿ][„‡†‰‹›•˜¸˛˚˝ˇ·¬±¤¾½¼³²¹¶ƒ√≈∆∫≠≤≥¥∂∑∏π┬├─│┤╡╢╖╕╣║╗╝╜╛┐└┴┼╞╟╚╔╩╦╠═╬▒▓░█▄▌▐▀±⌐¢«»¿¡®™´ˆˉ˘˙¨÷×þÞðÐ]+[A-Za-zÀ-ÿ]")
_SYMBOL_ENDS = re.compile(r"(?<![^\s'\"(=>`])[„‡†‰•˜˛˚ˇ·¾ƒ√┌└┬├´¨þ][a-zA-Z]{2,}|[a-z]{2}[„‡†•˛˚ˇ·¾ƒ√¶þ](?![^\s'\".,;:!?)<`])")
_FOREIGN_INSIDE = re.compile(r"[A-Za-z][Ѐ-ӿͰ-Ͽ]+[A-Za-z]|[A-Za-z]{2}[Ѐ-ӿͰ-Ͽ](?![Ѐ-ӿͰ-Ͽ])|(?<![Ѐ-ӿͰ-Ͽ])[Ѐ-ӿͰ-Ͽ][A-Za-z]{2,}")


def _misshapen(line: str) -> int:
    return sum(len(p.findall(line)) for p in (_UPPER_INSIDE, _SYMBOL_INSIDE, _SYMBOL_ENDS, _FOREIGN_INSIDE))


def _single_byte(line: str) -> str | None:
    """The line decoded as Western text, where one other code page explains all its odd characters."""
    worst = _misshapen(line)
    if not worst:
        return None
    best = None
    for name in SINGLE_PAGES:
        table = page(name)
        odd = set(_NON_ASCII.findall(line))
        if not odd <= table.keys():
            continue
        text = _NON_ASCII.sub(lambda m, t=table: bytes([t[m.group()]]).decode("cp1252", "replace"), line)
        left = _misshapen(text)
        letters = sum(c in "áâãàçéêíóôõúüÁÂÃÀÇÉÊÍÓÔÕÚ" for c in text)
        if left < worst and set(_NON_ASCII.findall(text)) <= WESTERN:
            score = (left, -letters)
            if best is None or score < best[0]:
                best = (score, text)
    return best[1] if best else None


def repair_line(line: str) -> tuple[str, str | None]:
    """(restored line, kind): utf8, page or lost for a garbled line, None for a correct one."""
    if line.isascii():
        return line, None
    kind = None
    tried = []
    for order, name in enumerate(MULTIBYTE_PAGES):
        text = line
        for _ in range(4):
            text, gained = decode_spans(text, name)
            if not gained:
                break
        if text != line:
            tried.append((sum(c not in WESTERN for c in _NON_ASCII.findall(text)), len(text), order, text))
    if tried:
        # the page that leaves the plainest line
        line, kind = min(tried)[3], "utf8"
    if "�" in line and _LOST.search(line):
        return line, "lost"
    if kind is None and (text := _single_byte(line)) is not None:
        return text, "page"
    return line, kind


def repair(text: str | None) -> tuple[str | None, int, int]:
    """(restored text, garbled lines, lines that stay lost)."""
    if not text or text.isascii():
        return text, 0, 0
    out, bad, lost = [], 0, 0
    for line in text.split("\n"):
        line, kind = repair_line(line)
        bad += kind is not None
        lost += kind == "lost"
        out.append(line)
    return ("\n".join(out) if bad else text), bad, lost


def repair_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text`` restored where it can be, and the columns garbled_lines and lost_lines.

    Null and empty texts, repeated rows and other columns stay as they are. A line that mixes correct
    and garbled characters keeps the correct ones: only well-formed spans are decoded. ASCII texts
    never leave the JVM's side of the plan for more than a comparison."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repair(t) for t in texts], columns=["text", "bad", "lost"])

    udf = F.pandas_udf(run, "text string, bad int, lost int")
    odd = F.when(F.col(text).rlike(r"[^\x00-\x7f]"), F.col(text))
    return (
        spread(df)
        .withColumn("__fixed", udf(odd))
        .withColumns({text: F.coalesce(F.col("__fixed.text"), F.col(text)), "garbled_lines": F.coalesce(F.col("__fixed.bad"), F.lit(0)), "lost_lines": F.coalesce(F.col("__fixed.lost"), F.lit(0))})
        .drop("__fixed")
    )
