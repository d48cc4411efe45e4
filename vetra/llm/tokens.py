"""The byte-level tokenizer, by whichever library encodes it faster."""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np


def byte_bpe(path: str | None = None) -> Callable[[str], np.ndarray]:
    """text -> ids (uint32), as `tokenizers` has them with add_special_tokens=False.

    Without a path: the public 50k vocabulary. Its ranks file encodes the same ids several times as fast; a text that holds one
    of the vocabulary's special strings, or any text under another path, goes to `tokenizers` itself.
    """
    from tokenizers import Tokenizer

    if path:
        own = Tokenizer.from_file(path)
        return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)

    import public_tokenizers
    import tiktoken

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text)

    return encode


def byte_decode() -> Callable[[np.ndarray], str]:
    """ids of the public 50k byte-level vocabulary -> text."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        of = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return lambda ids: b"".join(map(of.__getitem__, ids.tolist())).decode()
