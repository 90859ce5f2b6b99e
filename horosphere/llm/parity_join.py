"""N-gram Jaccard self-join by parity sketches: every link, no pair lost.

Sets are the distinct word shingles of a text. Two sets of sizes a <= b whose
Jaccard similarity is at least num/den differ in at most

    d(a, b) = floor((den - num) * (a + b) / (den + num))

elements, and b <= a * den / num. A *parity sketch* has one bit per position;
each shingle flips the bit of its hash, so the sketches of two sets differ in
at most as many bits as the sets differ in elements.

* Sizes are cut into bands. All pairs whose smaller set lies in a band use one
  sketch of k segments, k > d for every such pair, so at least k - d segments
  agree (pigeonhole). Segments are 2**32 bits wide and nearly empty, so they are
  kept as the XOR of the fingerprints of their odd positions.
* A set puts out only d + 1 + x of its segments, x being a number of its
  band: the fullest ones first, then by hash. That order is the same for all
  sets, so by the prefix argument two linked sets still share 1 + x of them. Sets
  with too few non-empty segments put out all, the empty ones too if even d + 1
  are not reached, which covers pairs of such sets.
* Equal sets are one class and take part once.
* The sets in each bucket of equal segments are counted. Each set then leaves
  the x buckets of its own that hold most sets (ties by key). Of the 1 + x shared
  buckets the one with fewest sets stays for both, so no link is lost, while
  buckets made by a passage or line that many texts share empty out. Sets with too few
  segments leave none.
* In each bucket of equal segments one member, chosen by hash, is the hub and
  is paired with the others; the pairs are verified on the exact shingle sets
  and linked classes joined to components. Only buckets that still hold more
  than one component are looked at again, and there only pairs of different
  components: pairs inside a component cannot change it. Both steps grow with the
  bucket where its members are copies of each other.

Before the exact check, dense 512-bit parity sketches drop pairs whose Hamming
distance already exceeds d.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horosphere.llm.graph import components
from horosphere.llm.shingles import mix, shingle_sets
from horosphere.llm.tables import kept

BAND = 1.5           # ratio of a size band's ends
SPARE = 0.15         # spare segments of a band's sketch, as a share
LEAVE = 0.15         # segments put out beyond d + 1, as a share of the band's least d + 1
FILTER_BITS = 1 << 23  # fixed size of the candidate filter (1 MiB)
_U = np.uint64


class Bands:
    """Size bands and segment counts for one similarity threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
        self.edges = np.array(edges)
        self.k, self.leave = [], []
        for i in range(len(edges) - 1):
            a = edges[i + 1] - 1
            d = self.d(a, a * den // num)
            low = self.d(edges[i], edges[i])
            self.leave.append(max(1, -int(-(LEAVE * (low + 1)) // 1)))
            self.k.append(d + 1 + max(2, -int(-(SPARE * (d + 1)) // 1)))

    def d(self, a: int, b: int) -> int:
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def roles(self, n: int):
        """(band, most differing elements) for each band in which n can be paired."""
        i = int(np.searchsorted(self.edges, n, "right")) - 1
        yield i, self.d(n, n * self.den // self.num)
        least = -(-n * self.num // self.den)
        j = i - 1
        while j >= 0 and least < self.edges[j + 1]:
            yield j, self.d(int(self.edges[j + 1]) - 1, n)
            j -= 1


def segment_keys(s: np.ndarray, bands: Bands) -> list[tuple[np.ndarray, int]]:
    """For each role of the set ``s`` (sorted, distinct): the keys of the
    segments it puts out and how many of them it may leave."""
    out = []
    n = len(s)
    low = mix(s & _U(0xFFFFFFFF))
    for band, d in bands.roles(n):
        if d == 0:                                  # only equal sets, which are one class
            continue
        k, leave = bands.k[band], bands.leave[band]
        seg = ((s >> _U(32)) * _U(k)) >> _U(32)     # rises with s
        at = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        odd = np.bitwise_xor.reduceat(low, at)
        full = np.diff(np.append(at, n)).astype(np.uint64)
        tag = _U((band + 1) << 40)
        key = mix(mix(odd + full * _U(0x9E3779B97F4A7C15)) ^ (seg[at] + tag))
        if len(key) > d + leave:
            out.append((key[np.lexsort((key, -full.astype(np.int64)))[:d + 1 + leave]], leave))
        else:
            if len(key) <= d:
                empty = np.setdiff1d(np.arange(k, dtype=np.uint64), seg[at])
                key = np.concatenate([key, mix(empty + tag + _U(1 << 63))])
            out.append((key, 0))
    return out


def _signatures(width: int, num: int, den: int):
    def run(batches):
        bands = Bands(num, den)
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = []
            for r, s in shingle_sets(b.column(1), width):
                m = mix(s)
                odd = np.packbits(np.bincount((s & _U(511)).astype(np.int64), minlength=512) & 1)
                roles = segment_keys(s, bands)
                keys = np.concatenate([k for k, _ in roles]) if roles else np.zeros(0, np.uint64)
                tags = np.concatenate([np.full(len(k), i << 24 | x) for i, (k, x) in enumerate(roles)]) if roles \
                    else np.zeros(0, np.int64)
                rows.append((ids[r], len(s), int(s.sum().view(np.int64)), int(m.sum().view(np.int64)),
                             odd.view(np.int64), keys.view(np.int64), tags))
                if len(rows) == 512:
                    yield _sig_batch(rows)
                    rows = []
            if rows:
                yield _sig_batch(rows)
    return run


def _lists(parts, kind=pa.int64()) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(parts), kind))


def _sig_batch(rows) -> pa.RecordBatch:
    c = list(zip(*rows))
    keys, tags = _lists(c[5]), _lists(c[6], pa.int32())
    both = pa.ListArray.from_arrays(keys.offsets, pa.StructArray.from_arrays([keys.values, tags.values], ["key", "tag"]))
    return pa.RecordBatch.from_arrays(
        [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()),
         pa.array(c[3], pa.int64()), _lists(c[4]), both],
        ["doc_id", "n", "h1", "h2", "odd", "keys"])


def _sets(width: int):
    def run(batches):
        for b in batches:
            ids = b.column(0)
            at, got = [], []
            for r, s in shingle_sets(b.column(1), width):
                at.append(r)
                got.append(s.tobytes())
                if len(got) == 256:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(got, pa.binary())],
                                                     ["doc_id", "s"])
                    at, got = [], []
            if got:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(got, pa.binary())],
                                                 ["doc_id", "s"])
    return run


def _linked(num: int, den: int):
    def run(batches):
        for b in batches:
            sa, sb = b.column(2), b.column(3)
            keep = []
            for i in range(b.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (sa, sb))
                if len(x) > len(y):
                    x, y = y, x
                p = np.searchsorted(y, x)
                p[p == len(y)] = 0
                both = int((y[p] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            t = b.select([0, 1])
            yield t.filter(pa.array(keep, pa.bool_()))
    return run


def marked(df: DataFrame, ids: DataFrame) -> DataFrame:
    """``df`` with a column ``marked``: false only where doc_id is surely not among
    ``ids``. A bitmap over their hashes has FILTER_BITS bits however many ids there
    are, hence the broadcast; rows are tested before any shuffle."""
    pos = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(FILTER_BITS))
    bits = ids.select(pos.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")) \
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    hit = F.expr("shiftright(cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as int),"
                 " cast(at % 8 as int)) & 1 = 1")
    return (df.withColumn("p", pos).withColumn("bucket", F.expr("bitmap_bucket_number(p)"))
            .withColumn("at", F.expr("bitmap_bit_position(p)")).join(F.broadcast(bits), "bucket", "left")
            .withColumn("marked", F.coalesce(hit, F.lit(False))).select(*df.columns, "marked"))


def _close(na: str, nb: str, oa: str, ob: str, num: int, den: int):
    """Sizes and sketches that a linked pair must have: size ratio, and a Hamming
    distance of the 512-bit sketches no greater than the most differing elements."""
    far = reduce(lambda x, y: x + y, [F.bit_count(F.col(oa)[i].bitwiseXOR(F.col(ob)[i])) for i in range(8)])
    return ((F.least(na, nb) * den >= F.greatest(na, nb) * num)
            & (far * (den + num) <= (F.col(na) + F.col(nb)) * (den - num)))


def verify(near: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have Jaccard similarity >= num/den."""
    near = kept(near, "near-pairs")
    ids = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = kept(marked(docs, ids).where("marked").select("doc_id", "text").join(ids, "doc_id", "left_semi")
                .mapInArrow(_sets(width), "doc_id long, s binary"), "shingle-sets")
    full = (near.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
            .select("a", "b", "sa", "sb"))
    return kept(full.mapInArrow(_linked(num, den), "a long, b long"), "verified")


def near_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id).

    ``docs`` needs doc_id and text; other columns are ignored. Null or blank
    texts have no shingles and link with nothing. Of rows that repeat a doc_id
    each is labelled by its own text. A null doc_id is returned with a null
    component and links with nothing. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = kept(docs.mapInArrow(_signatures(width, num, den),
                               "doc_id long, n long, h1 long, h2 long, odd array<long>, "
                               "keys array<struct<key: long, tag: int>>"),
               "signatures")
    live = sig.where("n > 0 and doc_id is not null")
    classes = kept(live.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "n", "h1", "h2")
    copies = live.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"]).where("doc_id <> rep")
    own = marked(live.where(F.size("keys") > 0).select("doc_id", "n", "h1", "h2", "keys"), copies.select("doc_id"))
    # what is surely no copy needs no join
    own = own.where("not marked").drop("marked").unionByName(
        own.where("marked").drop("marked").join(reps, ["doc_id", "n", "h1", "h2"], "left_semi").select("doc_id", "n", "h1", "h2", "keys"))
    keys = own.select(F.explode("keys").alias("x"), "doc_id", "n").select("x.key", "x.tag", "doc_id", "n")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    bucket = kept(keys.join(shared, "key"), "buckets")
    # each set leaves the fullest of its buckets, as many as its role may leave
    crowd = Window.partitionBy("doc_id", "n", "tag").orderBy(F.desc("c"), "key")
    bucket = bucket.withColumn("r", F.row_number().over(crowd)).where(F.col("r") > F.col("tag").bitwiseAND(F.lit(0xFFFFFF))) \
        .select("key", "doc_id", "n")
    bucket = kept(bucket, "left-buckets")
    hubs = bucket.groupBy("key").agg(
        F.min(F.struct(F.xxhash64("key", "doc_id").alias("h"), F.col("doc_id"))).alias("hub"),
        F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.col("hub.doc_id").alias("hub"))
    bucket = kept(bucket.join(hubs, "key"), "hub-buckets")
    side = lambda c: sig.where("n > 0").select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"),
                                               F.col("odd").alias(f"o{c}"))
    first = (bucket.where("doc_id <> hub")
             .select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct())
    first = kept(first.join(side("a"), "a").join(side("b"), "b").where(_close("na", "nb", "oa", "ob", num, den))
                 .select("a", "b").distinct(), "hub-pairs")
    links = verify(first, docs, width, num, den)
    part = components(links)

    placed = bucket.join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left") \
        .withColumn("component", F.coalesce("component", "doc_id"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                      F.count(F.lit(1)).alias("c")).where("lo <> hi and c > 2").select("key")
    left = placed.join(split, "key", "left_semi").join(sig.where("n > 0").select("doc_id", "n", "odd"), ["doc_id", "n"])
    left = kept(left, "split-buckets")
    x, y = (left.select("key", "hub", F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"o{c}"),
                        F.col("component").alias(f"c{c}")) for c in "ab")
    more = (x.join(y.drop("hub"), (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
                   & (F.col("a") != F.col("hub")) & (F.col("b") != F.col("hub")) & _close("na", "nb", "oa", "ob", num, den))
            .select("a", "b").distinct().join(first, ["a", "b"], "left_anti"))
    part = components(links.unionByName(verify(more, docs, width, num, den)))

    return (sig.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2", "n")
            .join(classes, ["h1", "h2", "n"], "left")
            .join(part.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(
                "component", "rep", "doc_id")).alias("component_id")))
