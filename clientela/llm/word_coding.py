"""Byte-level BPE by a shuffle of distinct words.

Texts are split into pre-tokens. A chunk of documents has a dictionary of its distinct pre-tokens,
and each document the positions of its own as numbers in that dictionary. The dictionaries, in
packets by a hash of the word, are shuffled so that all copies of a word meet in one task, which
encodes it once; however frequent a word is, a chunk sends it once, so there are no hot words. The
ids go back to the chunks, and documents are put together again by position. For decoding,
the ids that a chunk has used are joined with the table of the tokens' bytes.
"""

from __future__ import annotations

import base64
import functools
import heapq
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import vocabulary_everywhere
from .pieces import LATIN_WORDS, ODD, WORDS

CHUNK_BYTES, CHUNK_ROWS = 10 << 20, 100_000  # a chunk ends at either; a text is never cut
LEAST_BUCKETS = 1024  # packets of a chunk; more if there are more shuffle partitions
WORDS_KEPT = 1_000_000  # by an encoding task, of at most WORD_BYTES; the rest are encoded again
WORD_BYTES = 64
CHUNK = (
    "chunk long, docs array<{kind}>, sizes binary, codes binary, sorted binary, "
    "buckets array<int>, packets array<binary>"
)


@functools.lru_cache(maxsize=1)
def ranks_of(content: bytes) -> dict[bytes, int]:
    """Ids by token, from lines of a token in base 64 and its rank."""
    lines = (line.split() for line in content.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the adjacent pair of least rank becomes one, the leftmost first, until no pair
    has a rank."""
    if word in ranks:
        return [ranks[word]]
    size = len(word)
    end = list(range(1, size + 1))  # of the part that starts here; 0 if none does
    before = list(range(-1, size - 1))  # start of the part before

    def pair(at: int) -> int | None:
        middle = end[at]
        return ranks.get(word[at : end[middle]]) if middle < size else None

    heap = [(r, at) for at in range(size) if (r := pair(at)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, at = heapq.heappop(heap)
        if not end[at] or pair(at) != rank:
            continue
        middle = end[at]
        end[at], end[middle] = end[middle], 0
        if end[at] < size:
            before[end[at]] = at
        for start in (at, before[at]):
            if start >= 0 and (r := pair(start)) is not None:
                heapq.heappush(heap, (r, start))
    ids, at = [], 0
    while at < size:
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return ids


def split(text: str) -> list[str]:
    return (WORDS if ODD.search(text) else LATIN_WORDS).findall(text)


def packed_numbers(numbers: Iterable[int]) -> bytes:
    """Compressed by byte of equal weight, as most are small."""
    planes = np.asarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(planes.tobytes(), 1)


def unpacked_numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def packed_strings(strings: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, strings), dtype="<u4", count=len(strings))
    head = len(strings).to_bytes(4, "little")
    return zlib.compress(b"".join([head, sizes.tobytes(), *strings]), 1)


def unpacked_strings(packed: bytes) -> list[bytes]:
    content = zlib.decompress(packed)
    count = int.from_bytes(content[:4], "little")
    sizes = np.frombuffer(content, dtype="<u4", count=count, offset=4).tolist()
    ends = list(accumulate(sizes, initial=4 + 4 * count))
    return [content[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Dictionary(dict):
    """Numbers by word, in order of first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _chunk(number: int, docs: list, sizes: list[int], codes: list[np.ndarray], words: Dictionary,
           n_buckets: int) -> pd.DataFrame:
    spelled = [w.encode() for w in words]
    bucket = np.fromiter((zlib.crc32(w) for w in spelled), dtype=np.int64, count=len(spelled)) % n_buckets
    by_bucket = np.argsort(bucket, kind="stable")
    used, starts = np.unique(bucket[by_bucket], return_index=True)
    packets = [packed_strings([spelled[i] for i in part]) for part in np.split(by_bucket, starts)[1:]]
    return pd.DataFrame({
        "chunk": [number],
        "docs": [docs],
        "sizes": [packed_numbers(sizes)],
        "codes": [packed_numbers(np.concatenate(codes) if codes else [])],
        "sorted": [packed_numbers(by_bucket)],
        "buckets": [used.tolist()],
        "packets": [packets],
    })


def _chunks(
    frames: Iterator[pd.DataFrame], n_buckets: int, chunk_bytes: int
) -> Iterator[pd.DataFrame]:
    """One row for each chunk. Its number tells partition and place, both the same in a repeated task."""
    number = TaskContext.get().partitionId() << 33
    docs, sizes, codes, words, size = [], [], [], Dictionary(), 0
    for frame in frames:
        for doc, text in zip(frame["doc"].astype(object), frame["text"], strict=True):
            parts = split(text or "")
            docs.append(None if doc is pd.NA else doc)
            sizes.append(len(parts))
            codes.append(np.fromiter(map(words.__getitem__, parts), dtype="<u4", count=len(parts)))
            size += len(text or "")
            if size >= chunk_bytes or len(docs) >= CHUNK_ROWS:
                yield _chunk(number, docs, sizes, codes, words, n_buckets)
                number += 1
                docs, sizes, codes, words, size = [], [], [], Dictionary(), 0
    if docs:
        yield _chunk(number, docs, sizes, codes, words, n_buckets)


def _packets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for chunk, buckets, packets in zip(frame["chunk"], frame["buckets"], frame["packets"], strict=True):
            yield pd.DataFrame({"bucket": buckets, "chunk": chunk, "words": list(packets)})


class Encoded(dict):
    """Ids by word, four bytes each."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: bytes) -> bytes:
        ids = np.asarray(merged(word, self.ranks), dtype="<u4").tobytes()
        if len(word) <= WORD_BYTES:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = ids
        return ids


def _encoded(frames: Iterator[pd.DataFrame], content: bytes) -> Iterator[pd.DataFrame]:
    """A reply to each packet, and after those of a chunk the ids used in them."""
    known = Encoded(ranks_of(content))
    chunk, used = None, np.zeros(max(known.ranks.values()) + 1, dtype=bool)

    def tokens() -> tuple:
        found = np.flatnonzero(used).tolist()
        used[:] = False
        return chunk, -1, None, found

    for frame in frames:
        rows = []
        for number, bucket, words in zip(frame["chunk"], frame["bucket"], frame["words"], strict=True):
            if chunk is not None and number != chunk:
                rows.append(tokens())
            chunk = number
            ids = [known[w] for w in unpacked_strings(words)]
            used[np.frombuffer(b"".join(ids), dtype="<u4")] = True
            rows.append((number, bucket, packed_strings(ids), None))
        yield pd.DataFrame(rows, columns=["chunk", "bucket", "ids", "tokens"])
    if chunk is not None:
        yield pd.DataFrame([tokens()], columns=["chunk", "bucket", "ids", "tokens"])


def _reassembled(chunks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """Each document's ids from those of its words, and its bytes from those of its ids."""
    (row,) = chunks.to_dict("records")  # both sides have every chunk
    of_packets = sorted((p["bucket"], p["ids"]) for r in replies["replies"] if r is not None for p in r)
    ids = [ids for _, packet in of_packets for ids in unpacked_strings(packet)]
    by_bucket = unpacked_numbers(row["sorted"]).tolist()
    if len(ids) != len(by_bucket):
        raise RuntimeError(f"{len(ids)} of {len(by_bucket)} words came back to a chunk")
    of_word: list[bytes] = [b""] * len(ids)
    for number, found in zip(by_bucket, ids, strict=True):
        of_word[number] = found
    tokens = replies[replies["token"].notna()]
    label = dict(zip(tokens["token"].astype(int), tokens["bytes"], strict=True))
    codes, ends = unpacked_numbers(row["codes"]), np.cumsum(unpacked_numbers(row["sizes"]), dtype=np.int64)
    coded, decoded = [], []
    for end, part in zip(ends, np.split(codes, ends[:-1]), strict=True):
        whole = b"".join(map(of_word.__getitem__, part.tolist()))
        coded.append(whole)
        decoded.append(b"".join(map(label.__getitem__, np.frombuffer(whole, dtype="<u4").tolist())))
    return pd.DataFrame({"doc": pd.Series(list(row["docs"]), dtype=object), "ids": coded, "decoded": decoded})


def token_table(df: DataFrame, path: str) -> DataFrame:
    """``token, bytes``: as many rows as the vocabulary has, whatever the data."""
    with open(path, "rb") as file:
        ranks = ranks_of(file.read())
    rows = pd.DataFrame({"token": list(ranks.values()), "bytes": list(ranks)})
    return df.sparkSession.createDataFrame(rows, "token int, bytes binary")


def encode(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``id_col``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` (bytes, from the ids).

    ``path`` is a file of ranks. A null text counts as empty and has no ids. Every row gives one
    row, null and repeated ids included; other columns, whatever their names, are left out. A
    text is held whole by the tasks that split and reassemble it, as it is by the one that reads it.
    """
    content = vocabulary_everywhere(df, path)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(LEAST_BUCKETS, partitions)
    kind = df.schema[id_col].dataType.simpleString()
    # The one exchange by chunk is read twice: every column is read each time, so that Spark
    # finds the two alike and splits the texts once.
    chunks = (
        df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
        .mapInPandas(lambda frames: _chunks(frames, n_buckets, chunk_bytes), CHUNK.format(kind=kind))
        .repartition("chunk")
    )
    replies = (
        chunks.mapInPandas(_packets, "bucket int, chunk long, words binary")
        .repartition("bucket")
        .sortWithinPartitions("chunk")
        .mapInPandas(
            lambda frames: _encoded(frames, content.value),
            "chunk long, bucket int, ids binary, tokens array<int>",
        )
        .repartition("chunk")
    )
    # For each chunk a row with all its replies, and one for each token it has used.
    gathered = replies.groupBy("chunk").agg(
        F.collect_list(F.when(F.col("bucket") >= 0, F.struct("bucket", "ids"))).alias("replies"),
        F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"),
    )
    nothing = F.lit(None).cast("array<struct<bucket:int,ids:binary>>")
    rows = F.concat(
        F.array(F.struct(F.lit(None).cast("int").alias("token"), F.col("replies"))),
        F.transform("tokens", lambda t: F.struct(t.alias("token"), nothing.alias("replies"))),
    )
    asked = gathered.select("chunk", F.explode(rows).alias("row")).select("chunk", "row.*")
    answered = asked.join(F.broadcast(token_table(df, path)), "token", "left")
    done = (
        chunks.groupBy("chunk")
        .cogroup(answered.groupBy("chunk"))
        .applyInPandas(_reassembled, f"doc {kind}, ids binary, decoded binary")
    )
    return done.withColumnRenamed("doc", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``decoded``: the joined bytes of the numbers in the array column ``ids``.

    A row's ids are joined with the token table and put together by position. Rows without ids
    (null or empty) have no bytes; each must have an id of its own in ``id_col``.
    """
    parts = df.select(id_col, F.posexplode("ids").alias("at", "token")).join(
        F.broadcast(token_table(df, path)), "token"
    )
    ordered = F.sort_array(F.collect_list(F.struct("at", F.hex("bytes").alias("part"))))
    spelled = F.unhex(F.array_join(F.transform(ordered, lambda p: p["part"]), ""))
    whole = parts.groupBy(id_col).agg(spelled.alias("decoded"))
    nothing = F.lit("").cast("binary")
    return df.select(id_col).join(whole, id_col, "left").withColumn("decoded", F.coalesce("decoded", nothing))
