"""Counting and placing tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np

#: Folder with the vocabulary files; the files aren't part of the repository.
TOKENIZERS = os.environ.get("SIGILITE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the pre-splitting pattern that belongs to this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def token_bytes(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Bytes of each token id."""
    enc = encoding(folder, vocabulary)
    out = np.zeros(enc.n_vocab + 1, dtype=np.int32)
    for token in enc.token_byte_values():
        out[enc.encode_single_token(token)] = len(token)
    return out


def count(text: str | None, folder: str = TOKENIZERS) -> int:
    return 0 if not text else len(encoding(folder).encode_ordinary(text))
