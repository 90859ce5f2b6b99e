"""Byte-level BPE: encoding by merge ranks through a rank queue, and decoding.

A text is cut by the tokenizer's split pattern; every match is merged on its
own. Its bytes form a linked list; the pairs that can merge wait in one bucket
of list positions per rank, and a bitmap of words under one top word tells
which buckets are filled. The next merge is the first set bit
from the top down, at the leftmost position of that bucket; an entry
whose pair has changed since is stale and skipped. A match of n bytes costs
O(n log n), however long it is, and many short ones share one list and queue.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.pieces import Remembered, steps, whole_pieces

#: Bytes of text that a task encodes or decodes at a time, and bytes of matches that share a list: a worker
#: holds strings and lists of one step beside its Arrow batch.
STEP = 1 << 20
JOINT = 1 << 16
#: A word of the rank bitmap has 2**WORD bits; one more word tells which words are filled.
WORD = 8
LOW = (1 << WORD) - 1


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern)
        self.token = {i: t for t, i in self.ranks.items()}
        self.pair_rank = np.array([self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)])
        self.byte_rank = np.array([self.ranks[bytes((a,))] for a in range(256)])
        self.words = [0] * ((max(self.token) >> WORD) + 1)       # all clear between merges
        self.matches = Remembered(self._merge_all)
        self.heads = Remembered(self._piece_ids)                 # the first piece of a text has no space before it
        self.pieces = Remembered(lambda pieces: self._piece_ids([" " + p for p in pieces]))

    def merge(self, matches: list[bytes]) -> list[np.ndarray]:
        """Ids of matches of the split pattern, each merged on its own. They lie end to end in one
        linked list and share the queue; no pair reaches over a border."""
        data = b"".join(matches)
        n = len(data)
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        stops = np.cumsum([len(m) for m in matches])
        border = bytearray(n + 1)                # border[i]: a match begins or ends at i
        border[0] = 1
        for i in stops.tolist():
            border[i] = 1
        rank_of = self.ranks.get
        tokens = self.byte_rank[raw].tolist()    # tokens[i]: id of the symbol that begins at i
        end = list(range(1, n + 1))              # end[i]: where it ends
        begin = list(range(-1, n))               # begin[i]: where the symbol that ends at i begins
        first_ranks = np.full(n, -1)
        first_ranks[:-1] = self.pair_rank[raw[:-1] << 8 | raw[1:]]
        first_ranks[stops - 1] = -1
        waits = first_ranks.tolist()             # waits[i]: rank under which the pair at i is queued
        # the queue: ascending positions by rank; a bit in a word for each bucket, one in top for each filled word
        order = np.argsort(first_ranks, kind="stable")
        found, at = np.unique(first_ranks[order], return_index=True)
        buckets = {r: order[a:b].tolist() for r, a, b in zip(found.tolist(), at, [*at[1:], n]) if r >= 0}
        words, top = self.words, 0
        for r in buckets:
            words[r >> WORD] |= 1 << (r & LOW)
            top |= 1 << (r >> WORD)
        while top:
            low = top & -top                     # find first set: the word, then the rank in it
            place = low.bit_length() - 1
            word = words[place]
            bit = word & -word
            rank = (place << WORD) + bit.bit_length() - 1
            bucket = buckets.pop(rank)
            words[place] = word = word ^ bit
            if not word:
                top ^= low
            bucket.sort()                        # leftmost first; later pairs came in any order
            for done, i in enumerate(bucket, 1):
                if waits[i] != rank:
                    continue                     # stale
                mid = end[i]
                end[i] = stop = end[mid]
                tokens[i] = rank
                waits[mid] = -2                  # no symbol begins there any more
                back = False
                if border[stop]:
                    waits[i] = -1
                else:
                    begin[stop] = i
                    waits[i] = r = rank_of(data[i:end[stop]], -1)
                    if r >= 0:
                        try:
                            buckets[r].append(i)
                        except KeyError:
                            buckets[r] = [i]
                            words[r >> WORD] |= 1 << (r & LOW)
                            top |= 1 << (r >> WORD)
                        back = r <= rank
                if not border[i]:
                    left = begin[i]
                    waits[left] = r = rank_of(data[left:stop], -1)
                    if r >= 0:
                        try:
                            buckets[r].append(left)
                        except KeyError:
                            buckets[r] = [left]
                            words[r >> WORD] |= 1 << (r & LOW)
                            top |= 1 << (r >> WORD)
                        back = back or r <= rank
                if back and done < len(bucket):  # an earlier merge has come up: the rest waits
                    if rank in buckets:
                        buckets[rank] += bucket[done:]
                    else:
                        buckets[rank] = bucket[done:]
                        words[place] |= bit
                        top |= low
                    break
        lives = np.array(waits) != -2
        ids = np.array(tokens, "<i4")[lives]
        upto = np.concatenate([[0], np.cumsum(lives)])[np.concatenate([[0], stops])]
        return [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]

    def _merge_all(self, matches: list[str]) -> list[bytes]:
        """Packed ids of distinct matches; one that is a token as it stands needs no merge."""
        raw = [m.encode() for m in matches]
        got = [self.ranks.get(m) for m in raw]
        out = [b"" if r is None else struct.pack("<i", r) for r in got]
        left = [i for i, r in enumerate(got) if r is None]
        for lo, hi in steps([len(raw[i]) for i in left], JOINT):
            for i, ids in zip(left[lo:hi], self.merge([raw[i] for i in left[lo:hi]])):
                out[i] = ids.tobytes()
        return out

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        return [b"".join(ids) for ids in self.matches.values([self.split.findall(p) for p in pieces])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        rows = [whole_pieces(t) for t in texts]
        heads = self.heads.values([pieces[:1] for pieces in rows])
        for pieces in rows:
            del pieces[0]
        return [np.frombuffer(b"".join(a + b), "<i4") for a, b in zip(heads, self.pieces.values(rows))]

    def decode(self, ids) -> bytes:
        """The bytes of ``ids``."""
        return b"".join(map(self.token.__getitem__, ids.tolist()))


def _lengths(texts: pa.Array) -> list[int]:
    """Bytes of each text (null: none), without making strings of them."""
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


_OPEN: dict[tuple[str, str], ByteBpe] = {}


def opened(path: str, pattern: str) -> ByteBpe:
    """The tokenizer of this Python worker."""
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = ByteBpe(path, pattern)
    return _OPEN[path, pattern]


def encoded_steps(bpe: ByteBpe, batches, key: str):
    """(key, ids) of batches of (key, text), a step of texts at a time."""
    for b in batches:
        for lo, hi in steps(_lengths(b.column(1)), STEP):
            ids = bpe.encode([t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], names=[key, "ids"])


def decoded_steps(bpe: ByteBpe, batches, key: str):
    """(key, ids, bytes) of batches of (key, ids), a step of ids at a time."""
    for b in batches:
        lists = b.column(1)
        at = lists.offsets.to_numpy().tolist()               # null ids have no values
        ids = lists.values.to_numpy()
        for lo, hi in steps([4 * (y - x) for x, y in zip(at[:-1], at[1:])], STEP):
            raw = [bpe.decode(ids[x:y]) for x, y in zip(at[lo:hi], at[lo + 1:hi + 1])]
            yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(raw, pa.binary())],
                                             names=[key, "ids", "bytes"])


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(``key``, ids) of every whole text of ``docs``: each match of ``pattern`` is merged
    separately by the ranks of the file at ``path`` (found on every machine), without special tokens.

    A null text counts as empty and has no ids; null and repeated keys stay as they
    are, one row for each row; other columns are left out, an empty table gives none. Texts need no shuffle."""
    def run(batches):
        yield from encoded_steps(opened(path, pattern), batches, key)

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(
        run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``encoded`` with the column ``bytes``: what the ids of every row stand for (null ids: none)."""
    def run(batches):
        yield from decoded_steps(opened(path, pattern), batches, key)

    return encoded.select(key, "ids").mapInArrow(
        run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document of ``docs``: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space)
    and decoded_sha256 (of the bytes that decoding the ids gives)."""
    both = decode_ids(encode_texts(docs, path, pattern), path, pattern)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))
