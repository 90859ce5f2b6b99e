"""Benchmark decontamination by spaced seeds.

A seed mask reads some of the words from a position and ignores the others, so
its hash survives a substitution in an ignored place. Every (mask, position) of
the benchmark texts is hashed; documents are hashed the same way where they are
read, a fixed-size Bloom filter of the benchmark's hashes drops nearly all
positions, and what is left is joined with the benchmark's hashes. Each hit fixes
an alignment without gaps; it counts if some stretch of L = min(item words,
STRETCH) aligned words agrees in at least SHARE of its words. Items under
LEAST_WORDS words are too short for a mask: one hash of the whole item finds them, and all
words must agree.

Fixed values: the three masks of five words each find every stretch of 8 to 13
words in which at most a fifth is substituted (all cases were tried).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.shingles import NOT_ALNUM, mix, runs, utf8, words
from horosphere.llm.tables import kept

MASKS = ("110111", "11100011", "101010011")
SPAN = max(map(len, MASKS))
LEAST_WORDS = 8      # shorter items match whole, without a substitution
STRETCH = 13
SHARE = 0.8
BLOOM_BITS = 1 << 25  # fixed: 4 MiB, whatever the benchmark's size
_U = np.uint64
_PLACES = [np.array([i for i, c in enumerate(m) if c == "1"]) for m in MASKS]
_MULT = mix(np.arange(1, 64, dtype=np.uint64)) | _U(1)


def _seeds(h: np.ndarray, first: np.ndarray, short=()):
    """(hash, position) arrays of every mask at every place inside a row, and of
    all stretches of the lengths ``short``."""
    out = []
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for m, at in [*enumerate(_PLACES), *((STRETCH + n, np.arange(n)) for n in short)]:
        span = int(at[-1]) + 1
        if len(h) < span:
            continue
        n = len(h) - span + 1
        acc = np.full(n, _U(m + 1))
        for j, p in enumerate(at):
            acc += h[p:p + n] * _MULT[j]
        inside = np.flatnonzero(row[:n] == row[span - 1:])
        out.append((mix(acc[inside]), inside))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _items(batches):
    for b in batches:
        raw, off = utf8(b.column(1))
        h, _, _, first = words(raw, off, NOT_ALNUM)
        rows = []
        for r, i in enumerate(b.column(0).to_pylist()):
            own = h[first[r]:first[r + 1]]
            if not len(own):
                continue
            s, at = _seeds(own, np.array([0, len(own)]), [len(own)] if len(own) < LEAST_WORDS else [])
            if len(own) < LEAST_WORDS:
                s, at = s[-1:], at[-1:]            # the whole item, not its masks
            rows.append({"item_id": i, "w": own.view(np.int64).tolist(), "h": s.view(np.int64).tolist(), "at": at.tolist()})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([
            ("item_id", pa.int64()), ("w", pa.list_(pa.int64())), ("h", pa.list_(pa.int64())), ("at", pa.list_(pa.int64()))]))


def bloom(hashes: DataFrame) -> np.ndarray:
    """BLOOM_BITS bits, three per hash of column ``h``, as a numpy bit array."""
    bit = F.explode(F.array(*[F.expr(f"(shiftrightunsigned(h, {21 * j}) & {BLOOM_BITS - 1 >> 4 * (j == 2)}) + 1")
                              for j in range(3)]))
    got = hashes.select(bit.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    out = np.zeros(BLOOM_BITS // 8, np.uint8)          # at most BLOOM_BITS / 32768 rows came
    for r in got:
        lo = (r["b"] - 1) * 4096                       # value p + 1: bucket 1 holds bits 0 to 32767
        out[lo:lo + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _hits(bits, short):
    def run(batches):
        filt = bits.value
        for b in batches:
            raw, off = utf8(b.column(1))
            ids = b.column(0).to_pylist()
            rows = []
            for lo, hi in runs(off):
                o = off[lo:hi + 1]
                h, _, _, first = words(raw[o[0]:o[-1]], o - o[0], NOT_ALNUM)
                s, at = _seeds(h, first, short)
                for j in range(3):
                    p = (s >> _U(21 * j)) & _U((BLOOM_BITS - 1) >> (4 * (j == 2)))
                    ok = (filt[p >> _U(3)] >> (p & _U(7)).astype(np.uint8)) & 1 == 1
                    s, at = s[ok], at[ok]
                if not len(s):
                    continue
                order = np.argsort(at, kind="stable")
                s, at = s[order], at[order]
                owner = np.searchsorted(first, at, "right") - 1
                # hits near each other are one stretch, carried with the words around it
                cut = np.flatnonzero((np.diff(at) > 2 * STRETCH) | (np.diff(owner) > 0)) + 1
                for x, y in zip(np.concatenate([[0], cut]), np.append(cut, len(at))):
                    d = owner[x]
                    a = max(first[d], at[x] - STRETCH)
                    z = min(first[d + 1], at[y - 1] + SPAN + STRETCH)
                    rows.append({"doc_id": ids[lo + d], "start": int(a - first[d]),
                                 "w": h[a:z].view(np.int64).tolist(), "h": s[x:y].view(np.int64).tolist(),
                                 "at": (at[x:y] - first[d]).tolist()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([
                    ("doc_id", pa.int64()), ("start", pa.int64()), ("w", pa.list_(pa.int64())),
                    ("h", pa.list_(pa.int64())), ("at", pa.list_(pa.int64()))]))
    return run


def _best(item: np.ndarray, doc: np.ndarray, shift: int):
    """(most agreeing words, stretch, item place) when item word i lies on doc word i + shift."""
    size = min(len(item), STRETCH)
    at = np.arange(len(item)) + shift
    inside = (at >= 0) & (at < len(doc))
    same = np.zeros(len(item) + 1, np.int64)
    same[1:][inside] = item[inside] == doc[at[inside]]
    total = np.cumsum(same)
    run = total[size:] - total[:-size]
    i = int(run.argmax())
    return int(run[i]), size, i


def _verify(batches):
    names = ["doc_id", "item_id", "words", "same", "word_pos"]
    for b in batches:
        out = []
        for r in range(b.num_rows):
            doc_id, item_id, start, shift, w, d = (c[r] for c in b.columns)
            item, doc = (np.asarray(x.values) for x in (w, d))
            same, size, i = _best(item, doc, shift.as_py())
            if same >= (SHARE if size >= LEAST_WORDS else 1) * size:
                out.append((doc_id.as_py(), item_id.as_py(), size, same, start.as_py() + shift.as_py() + i))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names)


def contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = 1) -> DataFrame:
    """One row per (doc_id, item_id) whose texts share a stretch of the item:
    words (its length), same (agreeing words) and word_pos (its place in the document) of the best
    one, earliest first.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other
    columns are ignored. Words are lower-cased and part at white space and ASCII punctuation. Items of under LEAST_WORDS
    words match where all their words follow each other; those of under ``least_words`` are left out (by default none is:
    an item of one common word is found in every document that has the word). Null or empty texts match nothing, an empty
    table on either side gives no rows, rows that repeat an id count as one
    document or item with several texts.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text")).mapInArrow(
        _items, "item_id long, w array<long>, h array<long>, at array<long>")
    items = kept(items.where(F.size("w") >= least_words).withColumn("uid", F.xxhash64("item_id", "w")), "benchmark-seeds")
    short = sorted(r[0] for r in items.select(F.size("w")).where(F.size("w") < LEAST_WORDS).distinct().collect())  # 7 at most
    seeds = items.select("uid", F.explode(F.arrays_zip("h", "at")).alias("x")).select(
        "uid", F.col("x.h").alias("h"), F.col("x.at").alias("item_at"))
    bits = spark.sparkContext.broadcast(bloom(seeds.select("h")))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text")).mapInArrow(
        _hits(bits, short), "doc_id long, start long, w array<long>, h array<long>, at array<long>")
    found = kept(found.withColumn("did", F.xxhash64("doc_id", "start", "w")), "seed-hits")
    aligned = (found.select("did", "start", F.explode(F.arrays_zip("h", "at")).alias("x"))
               .select("did", "start", F.col("x.h").alias("h"), F.col("x.at").alias("at")).join(seeds, "h")
               .select("did", "uid", (F.col("at") - F.col("item_at") - F.col("start")).alias("shift")).distinct())
    ok = (aligned.join(found.select("did", "doc_id", "start", F.col("w").alias("dw")), "did")
          .join(items.select("uid", "item_id", "w"), "uid")
          .select("doc_id", "item_id", "start", "shift", "w", "dw")
          .mapInArrow(_verify, "doc_id long, item_id long, words long, same long, word_pos long"))
    best = ok.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        (F.col("same") / F.col("words")).alias("share"), (-F.col("word_pos")).alias("late"), "words", "same")).alias("m"))
    return best.select("doc_id", "item_id", "m.words", "m.same", (-F.col("m.late")).alias("word_pos"))
