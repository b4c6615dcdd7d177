"""Splitting oversized items at natural boundaries.

Only the tokenizer is Python: for a text over the limit it returns one letter per token, the strength
of the boundary after it, and the character offset at which it ends. One letter being one token, a
bounded quantifier over that string counts tokens exactly: a regular expression whose alternatives
are ordered by boundary strength consumes up to the limit, with a fallback to any character. The
pieces, their overlap and their text then come from SQL array functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigilite.llm import tokens
from sigilite.session import spread

#: Letters for what a cut after the token would be: before a heading, after a paragraph, a line, a
#: sentence, a word, any character; x is inside a character, where no cut is possible.
LETTERS = "HPLSWcx"


def boundaries(text: str, ids: list[int], sizes: np.ndarray) -> tuple[str, np.ndarray]:
    """The letter of each token and the number of characters up to its end."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.append((raw & 0xC0) != 0x80, True)
    ends = np.cumsum(sizes[np.asarray(ids)])
    chars = np.append(0, np.cumsum(starts[:-1]))[ends]
    whole = starts[ends]
    padded = np.concatenate(([10, 10, 10], cp, [10]))
    last, before, third, nxt = padded[chars + 2], padded[chars + 1], padded[chars], padded[chars + 3]
    blank = lambda a: (a == 32) | (a == 10) | (a == 9) | (a == 13)
    paragraph = (last == 10) & ((before == 10) | ((before == 13) & (third == 10))) & (nxt != 10)
    heading = (last == 10) & (nxt == ord("#"))
    stop = np.isin(last, [ord(c) for c in ".!?…。！？"]) & blank(nxt)
    letter = np.select(
        [~whole, heading, paragraph, (last == 10) & (nxt != 10), stop, blank(nxt) | blank(last)],
        [ord(c) for c in "xHPLSW"],
        ord("c"),
    ).astype(np.uint8)
    return letter.tobytes().decode(), chars.astype(np.int32)


def pattern(fresh: int) -> str:
    """The rest if it fits; else the last boundary of the strongest kind in the upper half of the
    limit; else any boundary; else any whole character."""
    most, half = fresh - 1, fresh // 2
    kinds = [f".{{{half},{most}}}{k}" for k in "HPLSW"]
    return "|".join([f".{{1,{fresh}}}\\z", *kinds, f".{{0,{most}}}[HPLSW]", f".{{1,{fresh}}}(?<!x)"])


def profile(df: DataFrame, key: str, text: str, limit: int, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """(key, text, n_tokens, letters, ends) of the rows of more than ``limit`` tokens.

    A token has at least one byte, so texts of no more than ``limit`` bytes need no tokenizer."""
    kind = dict(df.dtypes)[key]
    schema = f"__id {kind}, __text string, n_tokens int, letters string, ends array<int>"
    rows = df.select(F.col(key).alias("__id"), F.col(text).alias("__text")).where(F.octet_length(text) > limit)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, sizes = tokens.encoding(folder), tokens.token_bytes(folder)
        for batch in batches:
            out = []
            for i, t in zip(batch["__id"], batch["__text"]):
                ids = enc.encode_ordinary(t)
                if len(ids) > limit:
                    out.append((i, t, len(ids), *boundaries(t, ids, sizes)))
            if out:
                yield pd.DataFrame(out, columns=["__id", "__text", "n_tokens", "letters", "ends"])

    return spread(rows).mapInPandas(scan, schema)


#: Pieces that are summed up at a time: growing one array by all pieces of a text would copy it as often.
BLOCK = 512


def _blocks() -> Column:
    return F.sequence(F.lit(0), F.floor((F.size("lens") - 1) / BLOCK).cast("int"))


def _block(b: Column) -> Column:
    return F.slice("lens", b * BLOCK + 1, F.lit(BLOCK))


def _running(lens: Column, start: Column) -> Column:
    """``start`` and the sums of it and the first 1, 2, 3, ... lengths."""
    return F.aggregate(lens, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def split_oversized(
    df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 2048, overlap: int = 128, slack: int = 16, folder: str = tokens.TOKENIZERS
) -> DataFrame:
    """Pieces of every text of more than ``limit`` tokens.

    Returns (key, piece, start_token, end_token, text): consecutive pieces share exactly ``overlap``
    tokens, and cover the text without a gap. ``slack`` tokens of the limit stay unused, since a piece
    tokenized by itself may split its first or last word otherwise. Texts up to the limit, empty and
    null ones give no rows; rows that repeat a key are split each by itself; an empty table gives none."""
    fresh = limit - overlap - slack
    if fresh < 8:
        raise ValueError("the limit must exceed the overlap and the slack by 8 tokens at least")
    found = F.regexp_extract_all("letters", F.lit(pattern(fresh)), F.lit(0))
    at = lambda token: F.when(token > 0, F.get("ends", token - 1)).otherwise(0)

    def piece(cut: Column, i: Column) -> Column:
        start = F.greatest(cut - F.lit(overlap), F.lit(0))
        end = F.get("cuts", i + 1)
        return F.struct(
            i.alias("piece"),
            start.alias("start_token"),
            end.alias("end_token"),
            F.substring("__text", at(start) + 1, at(end) - at(start)).alias("text"),
        )

    return (
        profile(df, key, text, limit, folder)
        .withColumn("lens", F.transform(found, F.length))
        .withColumn("offsets", _running(F.transform(_blocks(), lambda b: F.aggregate(_block(b), F.lit(0), lambda n, x: n + x)), F.lit(0)))
        .withColumn("cuts", F.concat(F.array(F.lit(0)), F.flatten(F.transform(_blocks(), lambda b: F.slice(_running(_block(b), F.get("offsets", b)), 2, BLOCK)))))
        .select(F.col("__id").alias(key), F.inline(F.transform(F.slice("cuts", 1, F.size("cuts") - 1), piece)))
    )
