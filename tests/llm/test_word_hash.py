"""Words that collide under every polynomial hash modulo a power of two stay different."""
import numpy as np
import pyarrow as pa
import pytest

from horosphere.llm import token_blocks as TB
from horosphere.llm.parity_join import near_components
from horosphere.llm.shingles import shingle_sets, utf8, words
from horosphere.llm.tables import tokenizer_path
from tests.llm.conftest import docs_frame


def thue_morse(n, letters="ab"):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_hashes_and_shingles_differ(n):
    a, b = thue_morse(n)
    raw, off = utf8(pa.array([a, b, a.upper()]))
    h = words(raw, off)[0]
    assert h[0] != h[1] and h[0] == h[2]
    sets = [s.tolist() for _, s in shingle_sets(pa.array([f"one two {w} three" for w in (a, b)]), 3)]
    assert not set(sets[0]) & set(sets[1])


def test_encoder_ids(monkeypatch):
    texts = [w for n in (1024, 2048, 4096, 8192) for w in thue_morse(n)]
    enc = TB.WordEncoder(tokenizer_path())
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode(pa.array(texts))] == want
    # even a hash without any use gives the library's ids: bytes are compared
    plain = TB.words

    def useless(*args):
        h, *rest = plain(*args)
        return np.zeros_like(h), *rest

    monkeypatch.setattr(TB, "words", useless)
    texts += ["some short text, and Some SHORT text", "other"]
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in TB.WordEncoder(tokenizer_path()).encode(pa.array(texts))] == want


def test_no_false_link(spark):
    rows = [(i, w, None, None) for i, w in enumerate(w for n in (1024, 8192) for w in thue_morse(n))]
    got = {r.doc_id: r.component_id for r in near_components(docs_frame(spark, rows), 4, 85, 100).collect()}
    assert got == {i: i for i in range(4)}


def test_long_words_take_remainders(monkeypatch):
    from horosphere.llm import shingles as SH
    rng = np.random.default_rng(0)
    text = pa.array(["".join(rng.choice(list("abc d"), 5000))])
    want = words(*utf8(text))[0]
    monkeypatch.setattr(SH, "_PLAIN", 10)
    assert (words(*utf8(text))[0] == want).all()
