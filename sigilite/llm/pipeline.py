"""The operators of this subpackage one after the other, from raw tables to pieces of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigilite.llm import credentials, foreign, leakage, mojibake, personal, splitting
from sigilite.session import materialise


def prepare_blobs(blobs: DataFrame) -> DataFrame:
    """Own text units with their text restored, credentials masked and personal data replaced.

    Columns as given, and garbled_lines, lost_lines. Units nobody wrote here by hand are left out; null texts
    stay. Credentials are masked before personal data, so that an address inside a connection string
    is still seen as part of it."""
    repaired = materialise(mojibake.repair_texts(blobs))  # read for training, for classifying and for what follows
    own = repaired.join(foreign.foreign_units(repaired).select("unit_seq").distinct(), "unit_seq", "left_anti")
    return personal.redact_personal(credentials.redact_credentials(own)).select(repaired.columns)


def prepare_documents(documents: DataFrame, items: DataFrame, limit: int = 2048, overlap: int = 128) -> DataFrame:
    """(doc_id, piece, text): documents restored, without leaked passages, without personal data, in pieces up to the limit.

    Documents that fit are one piece, number 0; those without text, or dropped for leaks, give none."""
    texts = mojibake.repair_texts(documents.select("doc_id", "text"))
    clean = leakage.remove_leaks(texts, items).where("NOT dropped AND text <> ''").select("doc_id", "text")
    clean = materialise(personal.redact_personal(credentials.redact_credentials(clean)))
    pieces = splitting.split_oversized(clean, limit=limit, overlap=overlap).select("doc_id", "piece", "text")
    short = clean.join(pieces.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("piece"), "text")
    return short.unionByName(pieces)
