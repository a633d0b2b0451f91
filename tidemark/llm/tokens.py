"""Token ids of a public byte-level BPE vocabulary.

The vocabulary's rank file, with the tokenizer file's added token ``ADDED`` that is
found in plain text, gives the same ids as the tokenizer file several times faster
(`tests/llm/test_packing.py` compares them).  ``added=False`` takes that token's
characters as plain text.
"""

from __future__ import annotations

import base64

import numpy as np


#: The added token of the public 50k byte-level vocabulary and its id.
ADDED = {"<|endoftext|>": 50256}
_LITERALS = tuple(t.encode() for t in ADDED)


class Encoder:
    """Encoder for the rank file at ``path``, by default that of the public 50k byte-level vocabulary."""

    def __init__(self, path: str | None = None, added: bool = True):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._enc = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED if added else {})
        self._added = added

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> list[list[int]]:
        """Ids of each text of one chunk."""
        raw = buf.tobytes()
        if self._added and any(t in raw for t in _LITERALS):
            return [self._enc.encode(raw[a:b].decode(), allowed_special="all") for a, b in zip(offs[:-1], offs[1:])]
        return [self._enc.encode_ordinary(raw[a:b].decode()) for a, b in zip(offs[:-1], offs[1:])]
