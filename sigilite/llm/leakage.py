"""Evaluation texts leaking into training text.

The test items, as sequences of normalised words, form one generalised suffix automaton. Each
document is streamed through it and the length of the longest match ending at every word is
tracked; where it reaches ``min_words`` the items that hold the match are reported, each with the length
of its own longest match.

One automaton is broadcast while the items have at most ``item_words`` words. Beyond that, texts and items
that may share a passage are brought together on the cluster: of the hashes of k consecutive words every
window of w keeps the least, so that a passage of k + w - 1 words leaves at least one hash on either side
that is the same; pairs found so are put through an automaton of the item. Both ways are exact.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigilite.session import spread

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ]")


def normalise(text: str) -> str:
    """Lower case without accents. Changes lengths only where characters decompose."""
    text = text.lower()
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text))


def words(text: str) -> list[str]:
    return _WORD.findall(normalise(text))


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items below each state of at least ``min_words``."""

    def __init__(self, items: dict[int, list[str]], min_words: int):
        self.min_words = min_words
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[set[int]] = [set()]
        for item, text in items.items():
            last = 0
            for word in text:
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)), ends)
            # every prefix end carries the item; the loop below passes it on to all suffixes
            state = 0
            for word in text:
                state = self.next[state][self.ids[word]]
                ends[state].add(item)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        self.items = {s: tuple(sorted(ends[s])) for s in range(1, len(self.link)) if self.length[s] >= min_words}

    def _new(self, length: int, ends: list[set[int]]) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _clone(self, p: int, q: int, w: int, ends: list[set[int]]) -> int:
        c = self._new(self.length[p] + 1, ends)
        self.next[c] = dict(self.next[q])
        self.link[c] = self.link[q]
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int, ends: list[set[int]]) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w, ends)
        cur = self._new(self.length[last] + 1, ends)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w, ends)
        return cur

    def by_item(self, state: int, matched: int) -> Iterator[tuple[int, int]]:
        """(item, length of its longest match) of all items that share the last min_words words or more.

        Items of the state share all that is matched; those that come in along the suffix links share as
        much as their class spans."""
        seen: set[int] = set()
        while matched >= self.min_words:
            for item in self.items[state]:
                if item not in seen:
                    seen.add(item)
                    yield item, matched
            state = self.link[state]
            matched = self.length[state] if state > 0 else 0

    def matches(self, tokens: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) at each word where the longest match spans min_words or more.

        A match can't hold a word that no item has, so the stream skips to known stretches: it looks
        at every min_words-th word and reads a stretch only if that word is known."""
        known = list(map(self.ids.get, tokens))
        need, n = self.min_words, len(known)
        nxt, link, length = self.next, self.link, self.length
        i = need - 1
        while i < n:
            if known[i] is None:
                i += need
                continue
            lo = i
            while lo and known[lo - 1] is not None:
                lo -= 1
            hi = i + 1
            while hi < n and known[hi] is not None:
                hi += 1
            if hi - lo >= need:
                state = matched = 0
                for j in range(lo, hi):
                    w = known[j]
                    while state and w not in nxt[state]:
                        state = link[state]
                        matched = length[state]
                    if w in nxt[state]:
                        state = nxt[state][w]
                        matched += 1
                    if matched >= need:
                        yield j + 1, matched, state
            i = hi + need


Spans = list[tuple[int, int]]


def spans_by_item(a: SuffixAutomaton, tokens: list[str]) -> dict[int, tuple[int, Spans]]:
    """item -> (words of its longest passage, spans of words inside shared passages, in order and apart)."""
    out: dict[int, list] = {}
    for end, n, state in a.matches(tokens):
        for item, length in a.by_item(state, n):
            best = out.setdefault(item, [0, []])
            best[0] = max(best[0], length)
            spans = best[1]
            lo = end - length
            while spans and spans[-1][0] >= lo:
                spans.pop()
            if spans and spans[-1][1] >= lo:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((lo, end))
    return {i: (n, s) for i, (n, s) in out.items()}


def _size(items: DataFrame) -> int:
    """Words of all items, from above: there are at most half as many words as characters, and one more."""
    return items.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0))).first()[0]


def _one_automaton(items: DataFrame, min_words: int) -> SuffixAutomaton:
    """The automaton of items whose size was checked. Rows under one id are passages of one item."""
    texts: dict[int, list[str]] = {}
    for row in items.where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text").collect():
        # words that occur in no text keep passages of one id apart
        texts.setdefault(row[0], []).extend([*words(row[1]), "\n"])
    return SuffixAutomaton(texts, min_words)


def winnow(tokens: list[str], min_words: int) -> np.ndarray:
    """Hashes of which any passage of ``min_words`` words leaves at least one, wherever it stands."""
    k = (min_words + 1) // 2
    w = min_words - k + 1
    if len(tokens) < min_words:
        return np.zeros(0, np.int64)
    cache: dict[str, int] = {}
    h = np.array([cache.get(t) or cache.setdefault(t, zlib.crc32(t.encode()) * 0x9E3779B97F4A7C15 % (1 << 64)) for t in tokens], dtype=np.uint64)
    grams = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        grams = grams * np.uint64(0x100000001B3) + h[i : len(h) - k + 1 + i]
    grams ^= grams >> np.uint64(29)
    return np.unique(np.lib.stride_tricks.sliding_window_view(grams, w).min(axis=1)).view(np.int64)


def _hashes(df: DataFrame, key: str, kind: str, min_words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, h) for k, t in zip(batch[key], batch["text"]) for h in winnow(words(t), min_words)]
            yield pd.DataFrame(rows, columns=[key, "h"])

    return df.select(key, "text").mapInPandas(run, f"{key} {kind}, h long").distinct()


_FOUND = "longest int, covered int, spans array<struct<lo:int,hi:int>>"


def _found(a: SuffixAutomaton, text: str) -> Iterator[tuple[int, int, int, Spans]]:
    for item, (longest, spans) in spans_by_item(a, words(text)).items():
        yield item, longest, sum(hi - lo for lo, hi in spans), spans


def passages(texts: DataFrame, items: DataFrame, min_words: int, item_words: int) -> DataFrame:
    """(digest, item_id, longest, covered, spans) of texts (digest, text) that share passages with items."""
    spark = texts.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    schema = f"digest string, item_id long, {_FOUND}"
    if _size(items) <= item_words:
        shared = spark.sparkContext.broadcast(_one_automaton(items, min_words))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(d, *x) for d, t in zip(batch["digest"], batch["text"]) for x in _found(shared.value, t)]
                if rows:
                    yield pd.DataFrame(rows, columns=["digest", "item_id", "longest", "covered", "spans"])

        return texts.mapInPandas(scan, schema)
    texts = texts.dropDuplicates(["digest"])
    pairs = _hashes(texts, "digest", "string", min_words).join(_hashes(items, "item_id", "long", min_words), "h").select("digest", "item_id").distinct()
    rows = pairs.join(texts, "digest").join(items.withColumnRenamed("text", "item"), "item_id")
    # pairs of one item share its automaton; an item of very many texts is spread over tasks
    rows = rows.repartition(F.col("item_id"), F.pmod(F.xxhash64("digest"), F.lit(64))).sortWithinPartitions("item_id", "item")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, a = None, None
        for batch in batches:
            out = []
            for i, d, t, item in zip(batch["item_id"], batch["digest"], batch["text"], batch["item"]):
                if (i, item) != last:
                    last, a = (i, item), SuffixAutomaton({i: words(item)}, min_words)
                out += [(d, *x) for x in _found(a, t)]
            yield pd.DataFrame(out, columns=["digest", "item_id", "longest", "covered", "spans"])

    return rows.select("item_id", "digest", "text", "item").mapInPandas(verify, schema)


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 15, item_words: int = 400_000) -> DataFrame:
    """One row per (doc_id, item_id) that share a passage of at least ``min_words`` words.

    Returns (doc_id, item_id, longest, covered): the longest passage shared with that item and the words
    of the document inside passages shared with it. Letter case, accents, punctuation, markup signs, spacing
    and line breaks don't count. Null or empty texts and null ids of items give no rows; a document or an
    item listed twice under one id gives one row with the largest figures; empty tables give no rows."""
    docs = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL"))
    if _size(items) <= item_words:
        # the id goes along in place of the digest
        found = passages(docs.select(F.col("doc_id").cast("string").alias("digest"), "text"), items, min_words, item_words).withColumn("doc_id", F.col("digest").cast("long"))
    else:
        keyed = docs.withColumn("digest", F.sha2("text", 256))
        found = passages(keyed.select("digest", "text"), items, min_words, item_words).join(keyed.select("digest", "doc_id"), "digest")
    return found.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("covered").alias("covered"))


def remove_leaks(documents: DataFrame, items: DataFrame, min_words: int = 15, max_share: float = 0.5, item_words: int = 400_000) -> DataFrame:
    """``documents`` with leaked spans cut out of ``text``, and the columns removed_words and dropped.

    A document whose leaked words exceed ``max_share`` of its words is dropped: its text becomes null.
    Other columns, rows, null texts and texts without leaks stay as they are."""
    docs = spread(documents).withColumn("__digest", F.sha2("text", 256))
    found = passages(docs.where("text IS NOT NULL").select(F.col("__digest").alias("digest"), "text"), items, min_words, item_words)
    # one text's spans only: their number is bounded by its words
    spans = found.select("digest", F.explode("spans").alias("s")).groupBy("digest").agg(F.sort_array(F.collect_set("s")).alias("__spans")).withColumnRenamed("digest", "__digest")

    def clean(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cut(t, s, max_share) for t, s in zip(texts, spans)], columns=["text", "removed", "dropped"])

    cut = F.pandas_udf(clean, "text string, removed int, dropped boolean")(F.col("text"), F.col("__spans"))
    out = docs.join(spans, "__digest", "left").withColumn("__cut", F.when(F.col("__spans").isNotNull(), cut))
    kept = F.col("__spans").isNull()
    return out.withColumns({
        "text": F.when(kept, F.col("text")).otherwise(F.col("__cut.text")),
        "removed_words": F.coalesce("__cut.removed", F.lit(0)),
        "dropped": F.coalesce("__cut.dropped", F.lit(False)),
    }).select(*documents.columns, "removed_words", "dropped")


def _cut(text: str | None, shared, max_share: float) -> tuple[str | None, int, bool]:
    if not isinstance(text, str) or shared is None:
        return text, 0, False
    # words with their places in the text as given, a word at a time so that decomposition keeps places
    places = [(m.start(), m.end()) for m in re.finditer(r"(?:[^\W_]|[\u0300-\u036f])+", text)]
    owner = [k for k, (lo, hi) in enumerate(places) for _ in words(text[lo:hi])]
    spans: Spans = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in shared):
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
        else:
            spans.append((lo, hi))
    gone = sum(hi - lo for lo, hi in spans)
    if gone > max_share * len(owner):
        return None, gone, True
    out, at = [], 0
    for lo, hi in spans:
        out.append(text[at : places[owner[lo]][0]])
        at = places[owner[hi - 1]][1]
    return "".join(out) + text[at:], gone, False
