"""Token ids of a public byte-level BPE vocabulary.

The ids are those of ``tokenizers`` on the JSON vocabulary. The rank file of
the same vocabulary gives the same ids several times faster, but its library
classifies rare characters by another Unicode version and knows no special
tokens; texts with such characters, or with a special token's string, go
through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

#: Ranges in which both libraries agree on letters, digits and white space.
PLAIN_TEXT = re.compile(r"[\x00-ſ‐-‧€]*\Z")
SPECIAL = "<|endoftext|>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def _load(path: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    exact = Tokenizer.from_file(path)
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return exact, None
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return exact, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


def token_ids(text: str, path: str) -> list[int]:
    """Ids of a whole text without special tokens added."""
    exact, fast = _load(path)
    if fast is None or SPECIAL in text or not PLAIN_TEXT.match(text):
        return exact.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)
