"""License scan and decontamination against brute force over every place."""

import random
import re

from horosphere.llm.decontaminate import LEAST_WORDS, SHARE, STRETCH, contaminated
from horosphere.llm.license_scan import CONTAINED, SHINGLE, TEMPLATES, license_scan
from tests.llm.conftest import docs_frame

ALNUM = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")


def wordlist(text):
    return ALNUM.findall((text or "").lower())


def grams(w):
    return {tuple(w[i:i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}


def licenses(text):
    w, out = wordlist(text), set()
    for name, t in TEMPLATES:
        tw = wordlist(t)
        need, n = grams(tw), len(tw)
        slack = n // 8 + 1
        for a in range(-slack, len(w)):
            if len(need & grams(w[max(0, a - slack):a + n + slack])) >= CONTAINED * len(need):
                out.add(name)
                break
    return out


def test_licenses(spark, odd, none):
    rnd = random.Random(3)
    fill = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(160):
        name, t = TEMPLATES[i % len(TEMPLATES)]
        w = t.split()
        for _ in range(rnd.choice([0, 0, 1, 2]) if len(w) > 25 else 0):
            w[rnd.randrange(len(w))] = "changed"
        if i % 5 == 4:
            w = w[:len(w) // 2]
        rows.append((i, " ".join(rnd.choices(fill, k=rnd.randint(0, 60)) + w + rnd.choices(fill, k=rnd.randint(0, 60))), "en", "a"))
    rows += [(200 + i, " ".join(rnd.choices(fill + "the of in license under to and".split(), k=300)), "en", "a") for i in range(20)]
    got = {}
    for r in license_scan(docs_frame(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.license_id)
        assert CONTAINED <= r.containment <= 1
    want = {i: x for i, t, *_ in rows if (x := licenses(t))}
    assert got == want and len(want) > 20
    assert license_scan(odd).count() == 0 and license_scan(none).count() == 0


def leaks(text, item):
    w, x = wordlist(text), wordlist(item)
    if not x:
        return False
    n = min(len(x), STRETCH)
    need = SHARE * n if n >= LEAST_WORDS else n
    return any(sum(p == q for p, q in zip(w[a:a + n], x[b:b + n])) >= need
               for a in range(len(w) - n + 1) for b in range(len(x) - n + 1))


def test_leaks(spark, odd, none):
    rnd = random.Random(8)
    fill = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(fill, k=rnd.randint(5, 60)))) for i in range(24)] + [(90, None), (91, "")]
    rows = []
    for i in range(140):
        x = (items[i % 24][1]).split()
        a = rnd.randrange(max(1, len(x) - 14))
        x = x[a:a + rnd.choice([8, 13, 20, 60])]
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
            x[rnd.randrange(len(x))] = "other"
        x = [w.upper() + rnd.choice(["", ",", ".!!"]) for w in x] if i % 4 == 0 else x
        rows.append((i, " ".join(rnd.choices(fill, k=rnd.randint(0, 40)) + x + rnd.choices(fill, k=rnd.randint(0, 40))), "en", "a"))
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs_frame(spark, rows), bench).collect()}
    want = {(i, j) for i, t, *_ in rows for j, x in items if leaks(t, x)}
    assert got == want and len(want) > 60
    assert contaminated(odd, bench).count() == 0 and contaminated(none, bench).count() == 0
    assert contaminated(odd, bench.limit(0)).count() == 0


def test_leak_of_odd_text(spark, odd, odd_rows):
    short = odd_rows[4][1]
    bench = spark.createDataFrame([(1, short), (1, short), (2, "one two three")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id) for r in contaminated(odd, bench).collect())
    assert got == [(-1, 1), (5, 1), (6, 1), (7, 1), (8, 2)]


def test_short_items_match_whole(spark):
    """Items of one to seven words are found where all their words follow each other, at any place."""
    rnd = random.Random(4)
    fill = [f"w{i}" for i in range(5)]
    items = [(i, " ".join(rnd.choices(fill, k=1 + i % 9))) for i in range(45)]
    rows = [(i, " ".join(rnd.choices(fill, k=rnd.randint(0, 60))), "en", "a") for i in range(80)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for least in (1, 4):
        got = {(r.doc_id, r.item_id): r for r in contaminated(docs_frame(spark, rows), bench, least).collect()}
        want = {(i, j) for i, t, *_ in rows for j, x in items if len(x.split()) >= least and leaks(t, x)}
        assert set(got) == want and len(want) > 20
        for (i, j), r in got.items():
            x = wordlist(items[j][1])
            if len(x) < LEAST_WORDS:
                w = wordlist(rows[i][1])
                assert r.words == r.same == len(x) and w[r.word_pos:r.word_pos + len(x)] == x
                assert all(w[a:a + len(x)] != x for a in range(r.word_pos))       # the earliest


def test_license_with_words_inserted_in_its_middle(spark):
    from horosphere.llm.license_scan import TEMPLATES, license_scan
    text = next(t for name, t in TEMPLATES if name == "MIT" and t.startswith("Permission")).split()
    half, extra = len(text) // 2, [f"inserted{i}" for i in range(60)]
    rows = [(1, " ".join(text[:half] + extra + text[half:])), (2, " ".join(["before"] * 50 + text + extra)),
            (3, " ".join(text[:half] + extra)), (4, " ".join(text[:half] + extra * 9 + text[half:]))]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
           if r.license_id == "MIT"}
    assert set(got) == {1, 2}
    assert got[1].containment > 0.9 and got[1].word_pos == 0 and got[2].containment == 1
