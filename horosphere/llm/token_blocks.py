"""Token ids in patched frame-of-reference (PFOR) blocks.

File format: Parquet rows, one per chunk of consecutive whole documents in
ascending doc_id order (files and chunks in (shard, chunk) order):

    shard, chunk     place of the chunk; shards are ascending doc_id ranges
    first            ids of the shard before this chunk
    doc_ids, n_tokens  the documents and their id counts, end id included
    blocks           byte offset of every block in payload (the block index)
    payload          the blocks

A block holds up to BLOCK ids: header ``<IIBI`` (count, minimum, width, number
of exceptions), the differences to the minimum packed in ``width`` bits each (low bit
first), then the exceptions' positions (uint16) and whole differences
(uint32). The width is that of a percentile of the block's differences; larger
ones are exceptions. Chunks are whole rows, written and committed by Spark, so
a lost executor's tasks are simply run again.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from horosphere.llm.shingles import runs, utf8, words
from horosphere.session import scratch_path

BLOCK = 4096
CHUNK = 1 << 16          # ids after which a chunk ends
PERCENTILE = 0.95
END_ID = 2
KNOWN = 400_000           # pieces whose ids a task remembers at a time
SCHEMA = ("shard int, chunk int, first long, doc_ids array<long>, n_tokens array<int>, "
          "blocks array<int>, payload binary")
_HEAD = struct.Struct("<IIBI")


def _pack(d: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of every value, low bit first."""
    if not width:
        return b""
    if width > 16:
        bits = (d[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    # eight values are ``width`` bytes: two halves of four values, 4 * width bits each
    v = np.zeros((len(d) + 7) // 8 * 8, np.uint64)
    v[:len(d)] = d & np.uint32((1 << width) - 1)
    v = (v.reshape(-1, 2, 4) << (np.arange(4, dtype=np.uint64) * np.uint64(width))).sum(2, dtype=np.uint64)
    out = np.empty((len(v), 16), np.uint8)
    half = np.uint64(4 * width)
    out[:, :8] = (v[:, 0] | (v[:, 1] << half if width < 16 else np.uint64(0)))[:, None].view(np.uint8)
    out[:, 8:] = (v[:, 1] >> (np.uint64(64) - half))[:, None].view(np.uint8)
    return out[:, :width].tobytes()[:(len(d) * width + 7) // 8]


def _unpack(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    """``n`` values of ``width`` bits from packed bytes."""
    if not width:
        return np.zeros(n, np.uint32)
    if width > 16:
        bits = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
        return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)
    rows = (n + 7) // 8
    full = np.zeros(rows * width, np.uint8)
    full[:len(raw)] = raw
    wide = np.zeros((rows, 16), np.uint8)
    wide[:, :width] = full.reshape(rows, width)
    lo, hi = wide.view("<u8").T
    half = np.uint64(4 * width)
    if width < 16:
        v = np.stack([lo & np.uint64((1 << 4 * width) - 1), (lo >> half) | (hi << (np.uint64(64) - half))], 1)
    else:
        v = np.stack([lo, hi], 1)
    v = (v[:, :, None] >> (np.arange(4, dtype=np.uint64) * np.uint64(width))) & np.uint64((1 << width) - 1)
    return v.reshape(-1)[:n].astype(np.uint32)


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One PFOR block of up to BLOCK ids (uint32)."""
    low = int(ids.min())
    d = (ids - np.uint32(low)).astype(np.uint32)
    width = int(np.partition(d, k := min(len(d) - 1, int(percentile * len(d))))[k]).bit_length()
    over = np.flatnonzero(d >= np.uint64(1) << np.uint64(width))
    return b"".join((_HEAD.pack(len(d), low, width, len(over)), _pack(d, width),
                     over.astype("<u2").tobytes(), d[over].astype("<u4").tobytes()))


def unpack_block(buf: memoryview) -> np.ndarray:
    """The ids of the block that begins at the start of ``buf``."""
    n, low, width, m = _HEAD.unpack_from(buf)
    at, size = _HEAD.size, (n * width + 7) // 8
    d = _unpack(np.frombuffer(buf, np.uint8, size, at), n, width)
    if m:
        where = np.frombuffer(buf, "<u2", m, at + size)
        d[where] = np.frombuffer(buf, "<u4", m, at + size + 2 * m)
    return d + np.uint32(low)


# Fixed values of the lower-casing word tokenizer: how it normalises and splits text.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_JOIN = 512              # pieces encoded in one call
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() and chr(b) != "'" for b in range(256)])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _told_apart(low: np.ndarray, begin: np.ndarray, end: np.ndarray, one: np.ndarray, place: np.ndarray):
    """``one`` and ``place`` (first piece of every hash, hash of every piece) after the bytes of
    pieces with equal hashes are compared: those that differ from the first become hashes of their own."""
    rep = one[place]
    n = end - begin
    other = n != n[rep]
    n = np.where(other, 0, n)
    at = np.cumsum(n) - n
    step = np.arange(int(n.sum()))
    differ = low[np.repeat(begin - at, n) + step] != low[np.repeat(begin[rep] - at, n) + step]
    if differ.any():
        other[np.repeat(np.arange(len(n)), n)[differ]] = True
    if other.any():
        new = np.flatnonzero(other)
        place = place.copy()
        place[new] = len(one) + np.arange(len(new))
        one = np.concatenate([one, new])
    return one, place


class WordEncoder:
    """Ids of whole texts, each distinct piece of a batch looked up once.

    The lower-casing word tokenizer parts text at white space and between ASCII
    letters and ASCII marks (but for the apostrophe, which can belong to a
    contraction), and a piece's ids do not depend on its neighbours or on ASCII case.
    So a batch is cut there in numpy, its distinct pieces are found by a hash
    and a comparison of their bytes, encoded by the tokenizers library unless remembered (at most KNOWN, then
    afresh), and the ids are gathered back. Texts with a special token's string
    and all texts of a tokenizer of another make are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        spec = json.loads(self.tok.to_str())
        norm, pre = spec["normalizer"] or {}, (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.by_piece = ([n["type"] for n in norm.get("normalizers", [])] == _NORMALIZERS
                         and pre[0].get("pattern") == {"Regex": _SPLIT} and pre[-1]["type"] == "ByteLevel"
                         and spec["model"].get("end_of_word_suffix") == "</w>"
                         and all(a["content"].startswith("<|") for a in spec["added_tokens"]))
        self.letters = Tokenizer(self.tok.model)       # for pieces of lower-case letters, which
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()   # the other steps leave as they are
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)      # ids that end a word
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
        hidden = [b for b in range(256) if b not in shown]
        self.bytes = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _learn(self, new: list[bytes], words: list[str], letters: bool) -> None:
        """Encode ``words`` in few calls and remember them as ``new``; ``letters``:
        each is one run of letters in lower case."""
        for at in range(0, len(new), _JOIN):
            part = words[at:at + _JOIN]
            if letters:
                raw = " ".join([w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes) for w in part])
                ids = np.array(self.letters.encode(raw, add_special_tokens=False).ids, np.uint32)
                where = np.flatnonzero(self.last[ids]) + 1
            else:                                                # by place in the text
                e = self.tok.encode(" ".join(part), add_special_tokens=False)
                ids = np.array(e.ids, np.uint32)
                begin = np.cumsum([len(w) + 1 for w in part])
                where = np.searchsorted(np.array([o[0] for o in e.offsets], np.int64), begin)
            raw, a = ids.astype("<u4").tobytes(), 0
            for k, b in zip(new[at:at + _JOIN], (where * 4).tolist(), strict=True):
                self.known[k] = raw[a:b]
                a = b

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces in ASCII lower case."""
        if len(self.known) > KNOWN:
            self.known = {}
        got = [self.known.get(p) for p in pieces]
        new = [p for p, ids in zip(pieces, got) if ids is None]
        if new:
            plain, other = ([], []), ([], [])
            for p in new:
                w = p.decode()
                # lower() looks at the neighbours of a sigma and makes two of a dotted I
                low = w if w.isascii() else w.lower() if "\u03a3" not in w and "\u0130" not in w else ""
                to, w = (plain, low) if low.isalpha() else (other, w)
                to[0].append(p)
                to[1].append(w)
            self._learn(*plain, True)
            self._learn(*other, False)
            got = [self.known[p] for p in pieces]
        return got

    def encode(self, arr: pa.Array) -> list[np.ndarray]:
        """The ids (uint32) of each text of a string array; null counts as empty."""
        raw, off = utf8(arr)
        whole = lambda r: np.array(self.tok.encode(bytes(raw[off[r]:off[r + 1]]).decode(),
                                                   add_special_tokens=False).ids, np.uint32)
        if not self.by_piece:
            return [whole(r) for r in range(len(off) - 1)]
        out: list[np.ndarray] = []
        for lo, hi in runs(off, 1 << 21):
            o = off[lo:hi + 1] - off[lo]
            b = raw[off[lo]:off[hi]]
            letter, mark = _LETTER[b], _MARK[b]
            cuts = np.flatnonzero(letter[1:] & mark[:-1] | mark[1:] & letter[:-1]) + 1
            h, begin, end, first = words(b, o, _BLANK, cuts)
            if len(h) == 0:
                out += [np.zeros(0, np.uint32)] * (hi - lo)
                continue
            _, one, place = np.unique(h, return_index=True, return_inverse=True)
            one, place = _told_apart(_LOWER[b], begin, end, one, place)
            text = bytes(b).lower()                              # ASCII letters only
            ids = self._ids([text[x:y] for x, y in zip(begin[one].tolist(), end[one].tolist())])
            size = np.array([len(i) // 4 for i in ids])
            start = np.cumsum(size) - size
            flat = np.frombuffer(b"".join(ids), "<u4")
            n = size[place]
            upto = np.concatenate([[0], np.cumsum(n)])
            full = flat[np.repeat(start[place] - upto[:-1], n) + np.arange(upto[-1])]
            rows = upto[first]
            out += [full[x:y] for x, y in zip(rows[:-1].tolist(), rows[1:].tolist())]
            for r in np.unique(np.searchsorted(o, np.flatnonzero((b[:-1] == 60) & (b[1:] == 124)), "right") - 1):
                out[lo + r] = whole(lo + r)                      # may hold a special token
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _write(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext
        enc, end = _encoder(path), np.array([end_id], np.uint32)
        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal chunk, first, ids, held, size
            counts = [len(h) + 1 for h in held]
            flat = np.concatenate([x for h in held for x in (h, end)])
            blocks = [pack_block(flat[i:i + BLOCK]) for i in range(0, len(flat), BLOCK)]
            starts = np.cumsum([0, *[len(b) for b in blocks]])[:-1]
            row = {"shard": shard, "chunk": chunk, "first": first, "doc_ids": ids, "n_tokens": counts,
                   "blocks": starts.tolist(), "payload": b"".join(blocks)}
            out = pa.RecordBatch.from_pylist([row], pa.schema([
                ("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()),
                ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())),
                ("blocks", pa.list_(pa.int32())), ("payload", pa.binary())]))
            chunk, first, ids, held, size = chunk + 1, first + len(flat), [], [], 0
            return out

        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                for i, got in zip(part.column(0).to_pylist(), enc.encode(part.column(1))):
                    ids.append(i)
                    held.append(got)
                    size += len(got) + 1
                    if size >= CHUNK:
                        yield flush()
        if ids:
            yield flush()
        enc.known = {}           # a worker outlives its tasks; its memory should not
    return run


def write_token_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every whole text and write the block files under ``path``.

    Documents go out in ascending doc_id order (null first; rows that repeat a
    doc_id in text order). Null texts are empty and still get the end id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    (rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(_write(tokenizer, end_id), SCHEMA).write.parquet(path))


def _read(batches):
    names = ["doc_id", "shard", "at", "n_tokens", "ids_crc32"]
    for b in batches:
        c = {n: b.column(i) for i, n in enumerate(["shard", "first", "doc_ids", "n_tokens", "blocks", "payload"])}
        for r in range(b.num_rows):
            payload = memoryview(c["payload"][r].as_buffer())
            flat = np.concatenate([unpack_block(payload[s:]) for s in c["blocks"][r].as_py()]).astype("<u4")
            n = np.array(c["n_tokens"][r].as_py(), np.int64)
            at = np.concatenate([[0], np.cumsum(n)])
            raw = memoryview(flat.tobytes())
            crc = [zlib.crc32(raw[4 * at[i]:4 * at[i + 1]]) for i in range(len(n))]
            yield pa.RecordBatch.from_arrays(
                [c["doc_ids"][r].values, pa.array([c["shard"][r].as_py()] * len(n), pa.int32()),
                 pa.array(at[:-1] + c["first"][r].as_py()), pa.array(n), pa.array(crc, pa.int64())], names)


def read_token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back: (doc_id, start, n_tokens, ids_crc32) per document."""
    t = spark.read.schema(SCHEMA).parquet(path)
    docs = t.select("shard", "first", "doc_ids", "n_tokens", "blocks", "payload").mapInArrow(
        _read, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
    total = t.select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")) \
        .groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row per written partition
    return docs.join(base, "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back with the ids themselves: (doc_id, ids)."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                payload = memoryview(b.column(3)[r].as_buffer())
                flat = np.concatenate([unpack_block(payload[s:]) for s in b.column(2)[r].as_py()])
                at = np.concatenate([[0], np.cumsum(b.column(1)[r].as_py())]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[r].values, pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int64)))],
                    ["doc_id", "ids"])
    return spark.read.schema(SCHEMA).parquet(path).select("doc_ids", "n_tokens", "blocks", "payload") \
        .mapInArrow(run, "doc_id long, ids array<long>")


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write the block files (into the shared folder unless ``path`` is given) and read them back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-blocks")
    write_token_blocks(docs, path, tokenizer, end_id)
    return read_token_blocks(spark, path)
