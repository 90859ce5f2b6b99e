"""Word and shingle hashes against Python's own words; components against union-find."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from horosphere.llm.graph import components
from horosphere.llm.shingles import shingle_sets, utf8, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\n\x0b\x1fé中.", max_size=40)), max_size=8))
def test_words_and_sets(texts):
    arr = pa.array(texts, pa.string())
    raw, off = utf8(arr)
    h, begin, end, first = words(raw, off)
    for i, t in enumerate(texts):
        got = [bytes(raw[a:z]).decode().translate(LOWER) for a, z in zip(begin[first[i]:first[i + 1]], end[first[i]:first[i + 1]])]
        assert got == WORD.findall((t or "").translate(LOWER))
    seen = {}
    for k in (3, 5):
        for i, s in shingle_sets(arr, k):
            want = plain_set(texts[i], k)
            assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()
            key = frozenset(want)
            assert seen.setdefault((k, key), s.tobytes()) == s.tobytes()
    keys = [v for (k, _), v in seen.items() if k == 3]
    assert len(set(keys)) == len(keys)


def test_components_of_random_graph_and_long_path(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(0, 300)] + [(rnd.randint(400, 900), rnd.randint(400, 900)) for _ in range(300)]
    links += [(1000, i) for i in range(1001, 1200)] + [(950, 950)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == union_find(nodes, [x for x in links if x[0] != x[1]])


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
