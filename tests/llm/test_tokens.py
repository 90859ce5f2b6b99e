import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from horosphere.llm.tables import tokenizer_path
from horosphere.llm.token_blocks import (WordEncoder, pack_block, read_ids, token_blocks, unpack_block,
                                         write_token_blocks)
from horosphere.session import scratch_path


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=300), st.floats(0, 0.999))
def test_block_round_trip(ids, percentile):
    x = np.array(ids, np.uint32)
    assert (unpack_block(memoryview(pack_block(x, percentile) + b"tail")) == x).all()


@pytest.mark.parametrize("width", range(33))
def test_every_width(width):
    x = np.random.default_rng(width).integers(0, 1 << width, 777, dtype=np.uint64).astype(np.uint32)
    assert (unpack_block(memoryview(pack_block(x))) == x).all()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAbZ .,'!s0\n\t\xa0éÉ́ßİΣ中<|endoftxr>", max_size=60))
@example("it's I'LL !'s 's' <|endoftext|> a<|b 1st x² ½ Σ ΑΣ İ é́ \u2014 a\u2014b a\u00a0b")
def test_encoder_equals_the_library(text):
    enc = test_encoder_equals_the_library.__dict__.setdefault("enc", WordEncoder(tokenizer_path()))
    other = text.upper() + "." + text
    for t, got in zip((text, other, text), enc.encode(pa.array([text, other, text]))):
        assert got.tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    enc = WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    texts = ["Some text, here.", "", "  two  spaces\n"]
    assert not enc.by_piece
    assert [x.tolist() for x in enc.encode(pa.array(texts))] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]


def expected(rows):
    tok = Tokenizer.from_file(tokenizer_path())
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, out = 0, []
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(x):
    return x[1]


def test_documents_read_back(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, token_blocks(docs.repartition(5), tokenizer_path()).collect()), key=key)
    assert got == expected(rows)


def test_odd_rows(odd, odd_rows, none):
    got = sorted(map(tuple, token_blocks(odd, tokenizer_path()).collect()), key=key)
    assert got == expected(odd_rows)
    assert token_blocks(none, tokenizer_path()).count() == 0


def test_ids_read_back(spark, docs):
    path = scratch_path(spark, "ids-test")
    write_token_blocks(docs.limit(20), path, tokenizer_path())
    tok = Tokenizer.from_file(tokenizer_path())
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in read_ids(spark, path).collect():
        assert r.ids == [*tok.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
