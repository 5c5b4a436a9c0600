"""Byte-pair ids of texts, through the rank file beside a byte-level vocabulary."""

from __future__ import annotations

import base64
import functools
import json
import os
from collections.abc import Callable

import public_tokenizers
import tiktoken


@functools.lru_cache(maxsize=2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    """The rank file beside a vocabulary, with the vocabulary's added tokens; both give the same ids."""
    path = public_tokenizers.path(vocabulary)
    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(
        "corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added
    )


def token_ids(vocabulary: str) -> Callable[[str], bytes]:
    """Ids of a text as little-endian 32-bit numbers; the name of an added token in it is that token."""
    encode = encoding(vocabulary).encode_to_numpy
    return lambda text: encode(text, allowed_special="all").astype("<u4").tobytes()
