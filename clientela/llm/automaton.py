"""Encoding and decoding by a deterministic automaton compiled from the merges of a vocabulary.

The automaton reads tokens. It starts as one state that any byte leads back to. Merges are applied
in order of priority; the gadget of a merge (u, v) takes v away from the state that u leads to (a
new state, as the old one may serve other tokens), and lets the merged token lead where v leads
from every state that still has u. What remains are exactly the token sequences that merging
yields, one for each word, so that a word is encoded by following the arcs that spell it, and
decoded by joining the labels of its arcs.
"""

from __future__ import annotations

import functools
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Packed, packed_ids, vocabulary
from .shipping import ship

NEVER = 1 << 30
STEP = 2_000  # rows handed back at a time
TABLE_ENTRIES = 500_000  # transitions kept; beyond that the table starts anew


class MergeAutomaton:
    """States and arcs in implicit form, and a table of the transitions met so far.

    A state is known by the token that leads to it. It lacks a label if the gadget of some merge
    took it away: a merge of an end of that token with a start of the label, applied while both
    were still apart. Arcs are worked out from this when a word first needs them and then kept.
    """

    def __init__(self, content: bytes):
        ids, merges, self.special = vocabulary(content)
        self.label = {i: b for b, i in ids.items()} | {
            i: s.encode() for s, i in self.special.items()
        }
        size = max(self.label) + 1
        self.left, self.right = array("i", [-1]) * size, array("i", [-1]) * size
        self.born = array("i", [-1]) * size
        self.applied: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for spelled, i in ids.items():
            if len(spelled) == 1:
                self._spell(spelled, i)
        for rank, (u, v) in enumerate(merges):
            self._gadget(ids[u], ids[v], u + v, ids[u + v], rank)
        self.size = array("i", [0]) * size
        self.shorter = array("i", [-1]) * size
        for spelled, i in ids.items():
            self.size[i] = len(spelled)
            for k in range(len(spelled) - 1, 0, -1):
                if spelled[:k] in ids and self._live(ids[spelled[:k]]):
                    self.shorter[i] = ids[spelled[:k]]
                    break

    def _live(self, token: int) -> bool:
        return self.born[token] >= 0 or len(self.label[token]) == 1

    def _gadget(self, u: int, v: int, spelled: bytes, merged: int, rank: int) -> None:
        if self._missing(u, v):  # u never leads to v: nothing to merge
            return
        self.left[merged], self.right[merged], self.born[merged] = u, v, rank
        self.applied[u << 24 | v] = rank
        self._spell(spelled, merged)

    def _spell(self, spelled: bytes, token: int) -> None:
        node = 0
        for byte in spelled:
            if byte not in self.trie[node]:
                self.trie[node][byte] = len(self.trie)
                self.trie.append({})
                self.ends.append(-1)
            node = self.trie[node][byte]
        self.ends[node] = token

    def _missing(self, token: int, label: int) -> bool:
        """Whether the state behind ``token`` lacks ``label``."""
        end, until = token, NEVER
        while end >= 0:
            start, before = label, NEVER
            while start >= 0:
                rank = self.applied.get(end << 24 | start, NEVER)
                if rank < until and rank <= before:
                    return True
                before, start = self.born[start], self.left[start]
            until, end = self.born[end], self.right[end]
        return False

    def _longest(self, word: bytes, start: int) -> int:
        """The longest token that the word spells from ``start`` on."""
        trie, ends, node, found = self.trie, self.ends, 0, -1
        for byte in word[start:]:
            node = trie[node].get(byte, -1)
            if node < 0:
                break
            if ends[node] >= 0:
                found = ends[node]
        return found

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-split word.

        From each state the longest arc that spells what follows is tried first, then shorter
        ones. There is one path for a word, so whichever reaches its end is right; places from
        which none does are entered once.
        """
        arcs, size, n = self.arcs, self.size, len(word)
        path: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, self._longest(word, 0)
        while at < n:
            while token >= 0:
                end = at + size[token]
                if not dead[end]:
                    if not path:
                        break
                    key = path[-1] << 24 | token
                    missing = arcs.get(key)
                    if missing is None:
                        if len(arcs) >= TABLE_ENTRIES:
                            arcs.clear()
                        missing = arcs[key] = self._missing(path[-1], token)
                    if not missing:
                        break
                token = self.shorter[token]
            if token >= 0:
                path.append(token)
                at = end
                token = self._longest(word, at) if at < n else -1
            else:
                dead[at] = 1
                token = path.pop()
                at -= size[token]
                token = self.shorter[token]
        return path


class Coder:
    def __init__(self, content: bytes):
        self.automaton = MergeAutomaton(content)
        self.special = self.automaton.special
        self.words = Packed(lambda w: array("I", self.automaton.encode(w.encode())).tobytes())

    def ids(self, text: str | None) -> bytes:
        return packed_ids(text, self.words, self.special)


def joined_labels(packed: bytes | None, label: dict[int, bytes]) -> str:
    ids = array("I")
    ids.frombytes(packed or b"")
    return b"".join(map(label.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def coder(content: bytes) -> Coder:
    """One for each worker process; compiling the merges takes a second."""
    return Coder(content)


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, read by the driver and broadcast: its size doesn't depend on the data."""
    with open(path, "rb") as file:
        return file.read()


def vocabulary_everywhere(df: DataFrame, path: str):
    ship(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(read_vocabulary(path))


def encode(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    round_trip: bool = False,
) -> DataFrame:
    """``id_col`` and ``ids``: little-endian unsigned 32-bit ids of the whole text.

    A null text counts as empty and has no ids. Every row gives one row, repeated ids included;
    other columns, whatever their names, are left out. With ``round_trip`` the ids are decoded in
    the same pass, as ``decoded``.
    """
    content = vocabulary_everywhere(df, path)

    def batches(frames):
        import pandas as pd

        code = coder(content.value)
        label = code.automaton.label
        for frame in frames:
            for at in range(0, len(frame), STEP):
                part = frame.iloc[at : at + STEP]
                ids = [code.ids(t) for t in part["text"]]
                out = {id_col: part[id_col].astype(object), "ids": ids}
                if round_trip:
                    out["decoded"] = [joined_labels(x, label) for x in ids]
                yield pd.DataFrame(out, index=part.index)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInPandas(
        batches, f"`{id_col}` {kind}, ids binary" + ", decoded string" * round_trip
    )


def decode(df: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``ids``, ``decoded``: the joined labels of ``ids``, read as UTF-8; null ids give
    an empty text."""
    content = vocabulary_everywhere(df, path)

    def batches(frames):
        ids, _, special = vocabulary(content.value)
        label = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in special.items()}
        for frame in frames:
            frame[id_col] = frame[id_col].astype(object)
            frame["decoded"] = [joined_labels(x, label) for x in frame["ids"]]
            yield frame

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, "ids").mapInPandas(
        batches, f"`{id_col}` {kind}, ids binary, decoded string"
    )
