"""Exact dedup, source mixture and sharding against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from itertools import accumulate

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from horosphere.llm.exact_dedup import exact_dedup
from horosphere.llm.minimax_shards import Packing, minimax_shards
from horosphere.llm.mixture import mix_sources
from tests.llm.conftest import docs_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def skewed(spark, n=900):
    """A third of the rows are one text and one source."""
    rnd = random.Random(1)
    return [(i, "same text again" if i % 3 == 0 else " ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.randint(0, 12))),
             "en", "hot" if i % 3 == 0 else rnd.choice(["b", "c", "d", None])) for i in range(n)]


@pytest.mark.parametrize("top", [1, 256])
def test_dedup(spark, top):
    rows = skewed(spark)
    got = {r.doc_id: r for r in exact_dedup(docs_frame(spark, rows), top, 64).collect()}
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t].append(i)
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        g = groups[t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(g), len(g), i == max(g))
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_dedup_odd(odd, odd_rows, none):
    got = exact_dedup(odd).collect()
    groups = defaultdict(list)
    for i, t, *_ in odd_rows:
        groups[t or ""].append(i)
    assert len(got) == len(odd_rows) and sum(r.kept for r in got) == len(groups)
    for r in got:
        g = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(g) and r.keep_id == max((x for x in g if x is not None), default=None)
    assert exact_dedup(none).count() == 0


def fair(sizes, weights, share, most):
    """Targets by resharing until none is above its cap, source by source."""
    todo, out = {s for s in sizes}, {}
    left = share * sum(sizes.values())
    while todo:
        level = left / sum(weights[s] for s in todo)
        full = {s for s in todo if most * sizes[s] < level * weights[s]}
        if not full:
            return out | {s: level * weights[s] for s in todo}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        todo -= full
    return out


def check_mix(got, rows):
    size = {}
    for i, t, _, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = fair(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * int(r["size"])
    assert len(got) == len(rows)
    for s in size:
        assert taken[s] == math.floor(want[s] + 1e-9)


def test_mixture(spark):
    rows = skewed(spark)
    df = docs_frame(spark, rows)
    got = mix_sources(df).collect()
    check_mix(got, rows)
    again = mix_sources(df.repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    # at most one document of a source is taken in part
    part = defaultdict(int)
    for r in got:
        part[r.source] += bool(r["size"]) and r.taken % r["size"] > 0
    assert max(part.values()) <= 1


def test_mixture_odd(odd, odd_rows, none):
    check_mix(mix_sources(odd).collect(), odd_rows)
    assert mix_sources(none).count() == 0


def best_capacity(sizes, shards):
    lo, hi = max([1, *sizes]), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        n = u = 1
        u = 0
        for v in sizes:
            if u + v > mid:
                n, u = n + 1, 0
            u += v
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


def check_shards(got, rows, shards):
    sizes, where = {}, defaultdict(set)
    for i, t, *_ in rows:
        k = hashlib.sha256((t or "").encode()).hexdigest()
        sizes[k] = sizes.get(k, 0) + len((t or "").encode()) + 1
    load, slots = defaultdict(int), defaultdict(list)
    text = defaultdict(set)
    for i, t, *_ in rows:
        text[zlib.crc32((t or "").encode())].add(t or "")
    for r in got:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert len(got) == len(rows)
    assert all(len(w) == 1 for c, w in where.items() if len(text[c]) == 1)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) == best_capacity([sizes[k] for k in sorted(sizes)], shards)


@pytest.mark.parametrize("shards", [3, 16])
def test_shards(spark, shards):
    rows = skewed(spark, 3000)
    check_shards(minimax_shards(docs_frame(spark, rows), shards).collect(), rows, shards)


def test_shards_odd(odd, odd_rows, none):
    check_shards(minimax_shards(odd, 16).collect(), odd_rows, 16)
    assert minimax_shards(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(1, 6))
def test_packing_of_atoms_is_optimal(sizes, shards):
    p = Packing([(f"{i:03}", s, True) for i, s in enumerate(sizes)])
    cap = p.least(shards, False)
    assert cap == best_capacity(sizes, shards) == p.least(shards, True)
    cut = [0, *p.cuts(cap, shards, False), len(sizes)]
    at = [0, *accumulate(sizes)]
    assert max(at[b] - at[a] for a, b in zip(cut, cut[1:])) <= cap
