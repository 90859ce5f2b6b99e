"""Byte-level BPE and token alignment against the tokenizer libraries and plain counting."""
import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from horosphere.llm import token_alignment as TA
from horosphere.llm.byte_bpe import ByteBpe, decode_ids, decoded_steps, encode_texts, encoded_steps, round_trip
from horosphere.llm.pieces import whole_pieces
from horosphere.llm.tables import split_pattern, tokenizer_path

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")
A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ALPHABET = "aAbZ .,'!s0\n\t\xa0éÉ́ßΣ中\x1c\x85▁　 ½٣😀<|endoftx>/"


@pytest.fixture(scope="module")
def own():
    return ByteBpe(RANKS, split_pattern())


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=60))
@example(" " * 40 + "a" + " " * 7 + "\n \n")
@example("aaaaaaaaaaaaaaaaa" * 30 + " it's I'LL x" + "é" * 99)
def test_encoder_equals_the_library(own, library, text):
    other = text[::-1] + " " + text
    for t, ids in zip((text, other, text), own.encode([text, other, text])):
        assert ids.tolist() == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_a_queue_over_one_long_match(own, library):
    rnd = random.Random(3)
    for n in (2, 9_000, 60_000):
        t = "".join(rnd.choice("ethaoinsr") for _ in range(n))
        assert own.encode([t])[0].tolist() == library.encode_ordinary(t)
    assert not any(own.words)                            # the bitmap is clear again


def test_merges_out_of_order(tmp_path):
    """A vocabulary in which a merge makes an earlier one possible: the queue goes back to it."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bcab", b"ab", b"cab", b"aba", b"abab"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    own = ByteBpe(str(path), split_pattern())
    enc = tiktoken.Encoding("odd", pat_str=split_pattern(), mergeable_ranks={t: i for i, t in enumerate(tokens)},
                            special_tokens={})
    rnd = random.Random(0)
    texts = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    assert [x.tolist() for x in own.encode(texts)] == [enc.encode_ordinary(t) for t in texts]


@given(st.text(alphabet=" \n\tab\xa0", max_size=30))
def test_pieces_are_the_whole_text(text):
    assert " ".join(whole_pieces(text)) == text


def test_round_trip_of_documents(library, odd, odd_rows, docs, none):
    def want(rows):
        return sorted(((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                        hashlib.sha256((t or "").encode()).hexdigest())
                       for i, t, *_ in rows for ids in [library.encode_ordinary(t or "")]), key=str)
    assert sorted(map(tuple, round_trip(odd, RANKS, split_pattern()).collect()), key=str) == want(odd_rows)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, round_trip(docs, RANKS, split_pattern()).collect()), key=str) == want(rows)
    assert round_trip(none, RANKS, split_pattern()).count() == 0
    ids = encode_texts(docs, RANKS, split_pattern())
    back = {r.doc_id: bytes(r.bytes).decode() for r in decode_ids(ids, RANKS, split_pattern()).collect()}
    assert back == dict(rows)


def test_a_worker_takes_a_large_batch_in_steps(own, monkeypatch):
    """op12: of one Arrow batch, only a step of texts or ids is held as strings, lists and bytes at a time."""
    texts = [None if i % 50 == 0 else "many é words of text %d " % i * 400 for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts)], names=["doc_id", "text"])
    sizes, encode = [], own.encode
    monkeypatch.setattr(own, "encode", lambda rows: sizes.append(sum(len(t.encode()) for t in rows)) or encode(rows))
    encoded = pa.Table.from_batches(encoded_steps(own, [batch], "doc_id")).combine_chunks().to_batches()
    assert len(encoded) == 1 and len(sizes) > 4 and max(sizes) <= 1 << 20
    back = list(decoded_steps(own, encoded, "doc_id"))
    assert len(back) > 1 and max(4 * len(b.column(1).flatten()) for b in back) <= 1 << 20
    assert [(r["doc_id"], r["bytes"].decode()) for b in back for r in b.to_pylist()] == [(i, t or "") for i, t in enumerate(texts)]


def plain_alignment(texts):
    """(counts, groups) and all links of every text, from whole-text encodings."""
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    both = TA.opened(A, B)
    out = []
    for t in texts:
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        ta, tb = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
        if not t or b"".join(ta) != (" " + t).encode() or b"".join(tb) != (" " + t).encode():
            out.append(([], [], [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        links, j = [], 0
        for i, stop in enumerate(ea):
            begin = ea[i - 1] if i else 0
            while eb[j] <= begin:
                j += 1
            k = j
            while k < len(b) and (eb[k - 1] if k else 0) < stop:
                links.append((a[i], b[k]))
                k += 1
        groups, x, y = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            u, v = ea.index(end, x) + 1, eb.index(end, y) + 1
            groups.append(",".join(map(str, a[x:u])) + "|" + ",".join(map(str, b[y:v])))
            x, y = u, v
        out.append((a, b, groups, links))
    return out


def expected(rows):
    found = plain_alignment([t or "" for _, t, *_ in rows])
    held = Counter(p for *_, links in found for p in set(links))
    most: dict = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    return sorted(((i, len(a), len(b), len(g), len(links), sum(held[p] == most[p[0]] for p in links),
                    sum(held[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
                   for (i, *_), (a, b, g, links) in zip(rows, found)), key=str)


def test_odd_documents(odd, odd_rows, none, spark):
    from tests.llm.conftest import docs_frame
    got = TA.align_documents(odd.repartition(3), A, B)
    assert sorted(map(tuple, got.collect()), key=str) == expected(odd_rows)
    assert TA.align_documents(none, A, B).count() == 0
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 50))), None, None) for i in range(300)]
    rows += [(1000, "<|endoftext|> </s> <0x41>", None, None), (1001, " a  ", None, None), (1002, "a▁b", None, None)]
    assert sorted(map(tuple, TA.align_documents(docs_frame(spark, rows), A, B).collect()), key=str) == expected(rows)


def test_blocks_add_up(docs, monkeypatch):
    """Many small blocks give the counts of one."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(TA, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(TA, "STEP", 5_000)
    postings = TA.pair_postings(docs.repartition(2), A, B)
    assert postings.where("doc is not null").select("block").distinct().count() > 5
    counts = TA.pair_counts(postings)
    links = [p for *_, x in plain_alignment([t for _, t in rows]) for p in x]
    assert {(r.a, r.b): r.n_links for r in counts.collect()} == Counter(links)
    assert sorted(map(tuple, TA.document_scores(postings, counts).collect()), key=str) == expected(rows)


def test_planes_round_trip():
    rnd = random.Random(6)
    x = np.array(sorted((p, d) for p in range(40) for d in rnd.sample(range(TA.BLOCK), rnd.choice([1, 2, 300, 3000]))))
    times = np.array([rnd.choice([1, 1, 2, 5, 200]) for _ in x])
    times[x[:, 0] == 7] = 4
    pairs, n_docs, links, flat, ends = TA.pack_planes(x[:, 0], x[:, 1], times)
    got: Counter = Counter()
    for r, d, weight in TA.unpack_planes(flat, ends):
        for a, b in zip(r.tolist(), d.tolist()):
            got[int(pairs[a]), b] += weight
    assert got == {(int(a), int(b)): int(t) for (a, b), t in zip(x, times)}
    assert n_docs.sum() == len(x) and links.sum() == times.sum()
