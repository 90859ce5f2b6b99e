import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from horosphere.llm.parity_join import Bands, near_components, segment_keys
from horosphere.llm.shingles import mix
from tests.llm.conftest import docs_frame
from tests.llm.test_shingles_graph import plain_set, union_find


def brute(rows, k, num):
    sets = {i: plain_set(t, k) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    both = Counter(p for ids in where.values() for p in combinations(sorted(ids), 2))
    links = [p for p, c in both.items() if 100 * c >= num * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    return {i: (len(s), c) for (i, s), c in zip(sets.items(), union_find(sets, links).values())}, links


def edited(rnd, base, n):
    w = base.split()
    for _ in range(n):
        at = rnd.randrange(len(w))
        rnd.choice([lambda: w.__setitem__(at, f"new{rnd.random()}"), lambda: w.insert(at, "more"),
                    lambda: w.pop(at) if len(w) > 2 else None])()
    return " ".join(w)


@pytest.mark.parametrize("k, num", [(4, 85), (5, 80)])
def test_all_links_found(spark, docs, k, num):
    rnd = random.Random(k)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    line = " ".join(texts[0].split()[:30])
    texts += [edited(rnd, texts[j % 20], e) for j in range(60) for e in (1, 3, 8, 20)]
    texts += [line + " " + " ".join(f"w{rnd.randrange(200)}" for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    texts += [" ".join(f"v{rnd.randrange(12)}" for _ in range(rnd.randint(1, 9))) for _ in range(80)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    want, links = brute([(r[0], r[1]) for r in rows], k, num)
    assert len(links) > 100
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(docs_frame(spark, rows), k, num, 100).collect()}
    assert got == want


def test_linked_sets_share_enough_segments():
    """Of linked sets' keys one stays shared whichever buckets each of them leaves by a common order."""
    rng = np.random.default_rng(4)
    bands, tried = Bands(85, 100), 0
    for _ in range(4000):
        n = int(rng.integers(6, 500))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drop, add = (int(x) for x in rng.integers(0, n // 6 + 2, 2))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or both == max(len(a), len(b)) or 100 * both < 85 * len(np.union1d(a, b)):
            continue
        tried += 1
        left = []
        for s in (a, b):
            for keys, leave in segment_keys(s, bands):
                order = np.sort(mix(keys))             # some order of all keys
                left.append((id(s), set(order[leave:].tolist()), leave))
        assert any(p[1] & q[1] for p in left for q in left if p[0] != q[0])
    assert tried > 500


def test_odd_rows(spark, odd, odd_rows, none):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_components(odd, 4, 85, 100).collect()]
    assert len(got) == len(odd_rows)
    want, _ = brute([(r[0], r[1]) for r in odd_rows if r[0] is not None], 4, 85)
    for i, n, c in got:
        if i is not None:
            assert (n, c) == want[i]
    assert sorted((n, c) for i, n, c in got if i is None) == [(0, None), (37, None)]
    assert near_components(none).count() == 0


def test_group_of_many_near_copies(spark):
    rnd = random.Random(2)
    base = " ".join(f"b{i}" for i in range(120))
    rows = [(i, edited(rnd, base, 1), "en", "a") for i in range(300)]
    got = {r.component_id for r in near_components(docs_frame(spark, rows), 5, 80, 100).collect()}
    assert got == {0}
