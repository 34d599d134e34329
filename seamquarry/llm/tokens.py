"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

VOCABULARY = os.environ.get("SEAMQUARRY_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how byte-level BPE vocabularies of this family split text into words before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ready: dict[str, Callable[[str], int]] = {}


def counter(vocabulary: str = VOCABULARY) -> Callable[[str], int]:
    """A function from a text to its number of tokens. Special tokens' strings in a text are ordinary text."""
    if vocabulary not in _ready:
        if vocabulary.endswith(".model"):
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
            _ready[vocabulary] = lambda t: len(p.encode(t, num_threads=1))
        elif vocabulary.endswith(".json"):
            from tokenizers import Tokenizer

            k = Tokenizer.from_file(vocabulary)
            k.encode_special_tokens = True
            _ready[vocabulary] = lambda t: len(k.encode(t, add_special_tokens=False).ids)
        else:
            import tiktoken

            with open(vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            _ready[vocabulary] = lambda t: len(e.encode_ordinary(t))
    return _ready[vocabulary]
