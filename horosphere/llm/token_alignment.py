"""Links between the tokens of two tokenizers, counted over a corpus by inverted pair bitmaps.

Every text is encoded by a byte-level vocabulary (A) and a space-marking one
(B); an A and a B occurrence whose byte ranges overlap are a link of their id
pair. Documents are numbered within blocks of at most BLOCK rows. For each pair of a
block one posting is kept: bitmaps over the block's documents, one per bit of
the link count (multiplicity planes), each stored as a sorted array of
16-bit numbers or as plain bits, whichever is smaller. The OR of the planes
popcounted is the number of documents that hold the pair; planes popcounted
and weighted give the number of links. Blocks have documents of their own, so counts
of a pair add up over its postings, on the map side first. The corpus-wide
counts are then joined to the postings, and each block's postings return
the scores to its documents. Neither texts nor tokens are shuffled.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.pieces import Remembered, steps, whole_pieces
from horosphere.llm.tables import kept

#: Documents of a block and characters of text after which it ends; rows beyond join the next block.
BLOCK = 8192
BLOCK_CHARS = 24 << 20
STEP = 2 << 20            # characters worked on at a time
_BITS = 0xFFFF            # in place of a plane's length: plain bits follow
_WORDS = BLOCK // 16      # 16-bit words of a plain plane
_B_PLACES = 1 << 32       # pair = a * 2**32 + b

SCHEMA = ("block long, doc int, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "pair long, n_docs long, pair_links long, planes binary")


def _byte_of() -> dict[str, int]:
    """Bytes by the characters that byte-level vocabularies write them as (a fixed rule of the format)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TwoTokenizers:
    """Tokens, groups and links of pieces of text, each distinct piece worked out once."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True              # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_of()
        self.a_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
                        for t, i in self.a.get_vocab().items()}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.found = Remembered(self._work_out)

    def tokens(self, pieces: list[str]):
        """A ids and B ids of space + piece, for each piece."""
        a = [e.ids for e in self.a.encode_batch([" " + p for p in pieces], add_special_tokens=False)]
        b = self.b.encode(pieces, num_threads=1)         # puts the space before by itself
        # it puts none before an empty text, and a text of tokens is never empty here
        return a, b

    def _work_out(self, pieces: list[str]) -> list[tuple]:
        """(A tokens, B tokens, groups, links, groups as text, pairs) of each; zeros and None
        where the tokens' bytes are not the text."""
        out = []
        for p, a, b in zip(pieces, *self.tokens(pieces)):
            text = (" " + p).encode()
            ta, tb = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
            if b"".join(ta) != text or b"".join(tb) != text:
                out.append((0, 0, 0, 0, None, b""))
                continue
            pairs, groups, at = [], [], 0
            i = j = from_i = from_j = 0
            ea, eb = len(ta[0]), len(tb[0])
            while True:
                pairs.append(a[i] * _B_PLACES + b[j])
                if ea == eb:
                    groups.append(",".join(map(str, a[from_i:i + 1])) + "|" + ",".join(map(str, b[from_j:j + 1])))
                    i, j = i + 1, j + 1
                    if i == len(a):
                        break
                    from_i, from_j = i, j
                    ea += len(ta[i])
                    eb += len(tb[j])
                elif ea < eb:
                    i += 1
                    ea += len(ta[i])
                else:
                    j += 1
                    eb += len(tb[j])
            out.append((len(a), len(b), len(groups), len(pairs), ";".join(groups), np.array(pairs, "<i8").tobytes()))
        return out

    def align(self, texts: list[str]):
        """(counts [n_a, n_b, n_groups, n_links], groups_sha256, pairs as bytes) of each whole text;
        zeros, '' and no pairs for an empty one and where the tokens' bytes are not the text."""
        for found in self.found.values([whole_pieces(t) if t else [] for t in texts]):
            if not found or any(x[4] is None for x in found):
                yield (0, 0, 0, 0), "", b""
                continue
            na, nb, ng, nl, groups, pairs = zip(*found)
            yield ((sum(na), sum(nb), sum(ng), sum(nl)), hashlib.sha256(";".join(groups).encode()).hexdigest(),
                   b"".join(pairs))


_OPEN: dict[tuple[str, str], TwoTokenizers] = {}


def opened(a_path: str, b_path: str) -> TwoTokenizers:
    """The two tokenizers of this Python worker."""
    if (a_path, b_path) not in _OPEN:
        _OPEN[a_path, b_path] = TwoTokenizers(a_path, b_path)
    return _OPEN[a_path, b_path]


def pack_planes(pair: np.ndarray, doc: np.ndarray, times: np.ndarray):
    """Postings of (pair, doc, times) entries, each (pair, doc) once, sorted by both: the distinct
    pairs, their documents and links, and the packed planes of all end to end with their offsets in bytes."""
    pairs, at, n_docs = np.unique(pair, return_index=True, return_counts=True)
    links = np.add.reduceat(times, at) if len(pairs) else np.zeros(0, np.int64)
    place = np.repeat(np.arange(len(pairs)), n_docs)
    planes = int(times.max(initial=1)).bit_length()
    where = [np.flatnonzero(times >> k & 1) for k in range(planes)]
    key = np.concatenate([place[w] * planes + k for k, w in enumerate(where)])
    docs = np.concatenate([doc[w] for w in where])
    order = np.argsort(key, kind="stable")
    key, docs = key[order], docs[order]
    # every plane of a pair up to its highest is there, empty ones too: a plane's weight is its place
    top = np.zeros(len(pairs), np.int64)
    np.maximum.at(top, key // planes, key % planes)
    segment = np.repeat(np.arange(len(pairs)) * planes, top + 1) + np.arange(int((top + 1).sum())) \
        - np.repeat(np.cumsum(top + 1) - top - 1, top + 1)
    first = np.searchsorted(key, segment)
    n = np.searchsorted(key, segment, "right") - first
    dense = n > _WORDS
    size = 1 + np.where(dense, _WORDS, n)
    start = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), "<u2")
    flat[start] = np.where(dense, _BITS, n)
    listed = np.repeat(~dense, n)
    to = np.repeat(start + 1 - first, n) + np.repeat(first, n) + (np.arange(len(key)) - np.repeat(first, n))
    flat[to[listed]] = docs[listed]
    for s in np.flatnonzero(dense).tolist():
        bits = np.zeros(BLOCK, np.uint8)
        bits[docs[first[s]:first[s] + n[s]]] = 1
        flat[start[s] + 1:start[s] + 1 + _WORDS] = np.packbits(bits, bitorder="little").view("<u2")
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(top + 1)])]
    return pairs, n_docs, links, flat, ends * 2


def unpack_planes(flat: np.ndarray, offsets: np.ndarray):
    """Entries (row, doc, weight) of packed planes; a document's times are the sum of its weights."""
    at, stop = offsets[:-1] // 2, offsets[1:] // 2
    rows, weight = np.arange(len(at)), 1
    while len(rows):
        n = flat[at].astype(np.int64)
        dense = n == _BITS
        listed = np.where(dense, 0, n)
        src = np.repeat(at + 1 - (np.cumsum(listed) - listed), listed) + np.arange(int(listed.sum()))
        yield np.repeat(rows, listed), flat[src].astype(np.int64), weight
        for r, a in zip(rows[dense].tolist(), at[dense].tolist()):
            docs = np.flatnonzero(np.unpackbits(flat[a + 1:a + 1 + _WORDS].view(np.uint8), bitorder="little"))
            yield np.full(len(docs), r), docs, weight
        at = at + 1 + np.where(dense, _WORDS, n)
        more = at < stop
        rows, at, stop, weight = rows[more], at[more], stop[more], weight * 2


def _batch(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema],
                                      schema=schema)


def _postings(a_path: str, b_path: str, id_type: pa.DataType):
    long, text = pa.int64(), pa.string()
    schema = pa.schema([("block", long), ("doc", pa.int32()), ("doc_id", id_type), ("n_a", long), ("n_b", long),
                        ("n_groups", long), ("n_links", long), ("groups_sha256", text), ("pair", long),
                        ("n_docs", long), ("pair_links", long), ("planes", pa.binary())])

    def run(batches):
        both = opened(a_path, b_path)
        block, rows, chars = TaskContext.get().partitionId() << 32, 0, 0
        pairs, docs, times = [], [], []

        def posted():
            """The postings of the block at hand: entries of its steps merged by pair."""
            p, d, t = np.concatenate(pairs), np.concatenate(docs), np.concatenate(times)
            order = np.argsort(p, kind="stable")         # documents ascend from step to step
            p, n_docs, links, flat, ends = pack_planes(p[order], d[order], t[order])
            for lo in range(0, len(p), 1 << 16):
                hi = min(len(p), lo + (1 << 16))
                off = (ends[lo:hi + 1] - ends[lo]).astype(np.int32)
                raw = flat[ends[lo] // 2:ends[hi] // 2]
                yield _batch(schema, hi - lo, block=pa.array(np.full(hi - lo, block)), pair=pa.array(p[lo:hi]),
                             n_docs=pa.array(n_docs[lo:hi]), pair_links=pa.array(links[lo:hi]),
                             planes=pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(off),
                                                                                pa.py_buffer(raw)]))

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                room = texts[at:at + BLOCK - rows]
                lo, hi = next(steps([len(t) for t in room], STEP))
                part = texts[at:at + hi]
                counts, shas, found = zip(*both.align(part))
                n = len(part)
                table = np.array(counts, np.int64)
                yield _batch(schema, n, block=pa.array(np.full(n, block)),
                             doc=pa.array(np.arange(rows, rows + n, dtype=np.int32)), doc_id=b.column(0).slice(at, n),
                             groups_sha256=pa.array(shas),
                             **{c: pa.array(table[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))})
                code = np.frombuffer(b"".join(found), "<i8")
                # by pair, then document; one number holds both (ids of A are below 2**18, of B below 2**32)
                owner = np.repeat(np.arange(rows, rows + n), table[:, 3])
                a, low = code >> 32, code & (_B_PLACES - 1)
                both_of, t = np.unique((a << 45) | (low << 13) | owner, return_counts=True)
                pairs.append((both_of >> 45 << 32) | (both_of >> 13 & (_B_PLACES - 1)))
                docs.append(both_of & (BLOCK - 1))
                times.append(t)
                rows, at, chars = rows + n, at + n, chars + sum(map(len, part))
                if rows == BLOCK or chars >= BLOCK_CHARS:
                    yield from posted()
                    block, rows, chars = block + 1, 0, 0
                    pairs, docs, times = [], [], []
        if rows:
            yield from posted()

    return run


def pair_postings(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The inverted index of ``docs``: a row for each document (``doc`` not null: its block, number and
    token counts) and a row for each pair of a block (``pair`` not null: documents, links and bitmaps).

    Every row is a document of its own, also where doc_ids are null or repeat; a null text counts as
    empty. Other columns are left out. Written once, so that block numbers stay."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema["doc_id"].dataType
    return kept(docs.select("doc_id", "text").mapInArrow(
        _postings(a_path, b_path, to_arrow_type(kind)), SCHEMA.format(id=kind.simpleString())), "pair-postings")


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a, b, pair, n_docs, n_links, best) of every linked id pair of the corpus: documents that hold it, links,
    and whether no other pair of its A id is held by more."""
    pairs = (postings.where("pair is not null").groupBy("pair")
             .agg(F.sum("n_docs").alias("n_docs"), F.sum("pair_links").alias("n_links"))
             .withColumn("a", F.shiftright("pair", 32).cast("int"))
             .withColumn("b", F.col("pair").bitwiseAND(F.lit(_B_PLACES - 1)).cast("int")))
    most = pairs.groupBy("a").agg(F.max("n_docs").alias("most"))     # an A id has at most as many pairs as B has ids
    return (pairs.join(most, "a").withColumn("best", F.col("n_docs") == F.col("most")).drop("most")
            .select("a", "b", "pair", "n_docs", "n_links", "best"))


def document_scores(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document of the index its token counts, n_best (links whose pair is its A id's best) and count_sum
    (the pairs' document counts over its links)."""
    kind = postings.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    posted = postings.where("pair is not null")
    # only (block, pair) meets the counts; the bitmaps move once, to their block
    scored = posted.select("block", "pair").join(counts.select("pair", F.col("n_docs").alias("held"), "best"), "pair")
    rows = postings.where("doc is not null").select(
        "block", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    both = (rows.unionByName(posted.select("block", "pair", "planes"), allowMissingColumns=True)
            .unionByName(scored.select("block", "pair", "held", "best"), allowMissingColumns=True))

    def one_block(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        listed = t.filter(t["doc"].is_valid())
        posted = t.filter(t["planes"].is_valid())
        doc = listed["doc"].to_numpy()
        total, good = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
        if len(posted):
            planes = posted["planes"].combine_chunks()
            planes = planes.chunk(0) if isinstance(planes, pa.ChunkedArray) else planes
            _, off, raw = planes.buffers()
            wide = np.int64 if pa.types.is_large_binary(planes.type) else np.int32
            off = np.frombuffer(off, wide)[planes.offset:planes.offset + len(planes) + 1].astype(np.int64)
            flat = np.frombuffer(raw, "<u2", count=off[-1] // 2)
            found = t.filter(t["held"].is_valid())
            order = np.argsort(found["pair"].to_numpy())
            order = order[np.searchsorted(found["pair"].to_numpy()[order], posted["pair"].to_numpy())]
            held = found["held"].to_numpy()[order]
            best = found["best"].to_numpy(zero_copy_only=False).astype(np.int64)[order]
            for r, d, weight in unpack_planes(flat, off):
                np.add.at(total, d, held[r] * weight)
                np.add.at(good, d, best[r] * weight)
        return pa.table([*(listed[c] for c in names[:5]), pa.array(good[doc]), pa.array(total[doc]),
                         listed["groups_sha256"]], names=names)

    # a block is a bounded number of documents and of their pairs
    return both.groupBy("block").applyInArrow(
        one_block, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                   "groups_sha256 string")


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path`` is a byte-level vocabulary of the tokenizers library, ``b_path`` a model of the sentencepiece
    library; A encodes space + text and B the text. Texts that are null, empty or not restored by the tokens' bytes
    (a U+2581 in them) have no tokens: zeros and ''. Rows with a null or repeated doc_id are documents of their own."""
    postings = pair_postings(docs, a_path, b_path)
    return document_scores(postings, kept(pair_counts(postings), "pair-counts"))
