"""Byte-level BPE ids of whole texts, with a bounded memory of what was seen.

In byte-level BPE a single space between two other characters always starts a
new pre-token, so the parts between such spaces have the same ids in any text.
Their ids are kept in a dictionary of bounded size; a text is the joined ids of
its parts. Texts with other arrangements of white space are encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

#: Characters whose Unicode class no release has changed; others go to the slower library that defines the ids.
PLAIN = re.compile(r"[\n -~¡-ɏ]*")
#: The pre-token pattern of byte-level BPE vocabularies of 50k ids (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(vocabulary: str) -> dict[bytes, int]:
    """Byte strings of the vocabulary file with their ids.

    The file writes bytes that do not print as the characters from U+0100 on, in order.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    with open(vocabulary, encoding="utf-8") as file:
        held = json.load(file)
    special = {x["id"] for x in held.get("added_tokens", ())}
    return {bytes(map(byte_of.__getitem__, t)): i for t, i in held["model"]["vocab"].items() if i not in special}


def encoder(vocabulary: str, kept: int = 400_000) -> Callable[[list[str]], list[bytes]]:
    """Texts to ids, four bytes each, little-endian. kept: parts remembered before the memory is emptied."""
    import numpy as np
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
    ranks = byte_ranks(vocabulary)
    fast = tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    width[list(ranks.values())] = [len(token) for token in ranks]
    known: dict[str, bytes] = {}

    def raw(text: str) -> bytes:
        if PLAIN.fullmatch(text):
            return np.array(fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(new: list[str]) -> None:
        # all new parts in one call; the bytes of the tokens tell where a part ends
        ids = np.frombuffer(raw(" " + " ".join(new)), "<u4")
        ends = np.cumsum(np.fromiter((len(part.encode()) for part in new), np.int64, len(new)) + 1)
        stops = 4 * (np.searchsorted(np.cumsum(width[ids]), ends) + 1)
        data = ids.tobytes()
        cuts = [0, *stops.tolist()]
        known.update(zip(new, (data[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)), strict=True))

    def encode(texts: list[str]) -> list[bytes]:
        parts = [
            # one space or line feed between words, and no other white space
            text.split(" ") if len(text.split()) == text.count(" ") + text.count("\n") + 1 else None
            for text in texts
        ]
        used = set().union(*(p[1:] for p in parts if p))
        new = used - known.keys()
        if len(known) + len(new) > kept:
            known.clear()
            new = used
        if new:
            learn(list(new))
        return [
            raw(p[0]) + b"".join(map(known.__getitem__, p[1:])) if p else raw(text)
            for p, text in zip(parts, texts, strict=True)
        ]

    return encode
