"""Pre-splitting of texts for the byte-level vocabulary, shared by encoding and packing."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import regex

# White space as Unicode defines it, and the published split pattern of the
# byte-level vocabulary with that class written out.
WHITE = r"\t-\r \x85\xa0  -     　"
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
# The same split for texts in Latin letters, by the faster module; ODD finds any other character.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
ODD = re.compile("[^\x00-\x1b\x20-\x7fÀ-ɏ‐-‧]")
LATIN_WORDS = re.compile(
    rf" ?[{LATIN}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+"
)
WORDS_KEPT = 350_000  # by a worker, twice that at most


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def vocabulary(content: bytes) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """Ids by bytes, merges in order of priority, and ids of the special strings."""
    model = json.loads(content)
    to_byte = byte_symbols()

    def spelled(token: str) -> bytes:
        return bytes(to_byte[c] for c in token)

    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ids = {spelled(t): i for t, i in model["model"]["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    return ids, [(spelled(a), spelled(b)) for a, b in merges], special


class Packed(dict):
    """Packed ids (little-endian, four bytes each) by word.

    When it is full, its entries become the old ones, from which those still in use come back.
    """

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.pop(word, None)
        if ids is None:
            ids = self.encode(word)
            if len(word) > 64:  # rare ones would fill the memory
                return ids
        if len(self) >= WORDS_KEPT:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


def cut(text: str, special: dict[str, int]) -> Iterator[tuple[bool, str]]:
    """The text in parts, special strings apart (flagged), longest first where several fit."""
    if not any(s in text for s in special):
        yield False, text
        return
    names = "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))
    for i, part in enumerate(re.split(f"({names})", text)):
        if part:
            yield bool(i % 2), part


def packed_ids(text: str | None, cache: Packed, special: dict[str, int]) -> bytes:
    """All ids of a text; null counts as empty."""
    out = []
    for is_special, part in cut(text or "", special):
        if is_special:
            out.append(special[part].to_bytes(4, "little"))
        else:
            words = (WORDS if ODD.search(part) else LATIN_WORDS).findall(part)
            out.extend(map(cache.__getitem__, words))
    return b"".join(out)
