import zlib

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from burstseries.llm.bpe import byte_bpe, default_vocabulary
from burstseries.llm.packing import cut_points, pack, packing_plan, token_pieces


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def check(df, plain, capacity=1024):
    texts = {}
    for r in df.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    got = pack(df, capacity=capacity).collect()
    want, have = [], []
    for d, ts in texts.items():
        for t in ts:
            ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
            for k, (s, n) in enumerate(cut_points(len(ids), capacity)):
                want.append((str(d), k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
    for r in got:
        have.append((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert sorted(have) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(by), sum(n for *_, n, _ in want)


def test_pieces_and_places(docs, plain):
    bins, tokens = check(docs, plain)
    assert bins <= 1.02 * -(-tokens // 1024) + 1


def test_odd_rows(odd, none, plain):
    check(odd, plain)
    check(odd, plain, capacity=7)
    assert pack(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), max_size=25))
def test_plan_is_a_packing(counts):
    place, ranks = {}, {}
    for n, r0, r1, first, per, at in packing_plan(counts, 60):
        for r in range(r0, r1):
            assert r not in ranks.setdefault(n, set())
            ranks[n].add(r)
            k = r - r0
            place.setdefault(first + k // per, []).append((at + n * (k % per), n))
    assert {n: len(r) for n, r in ranks.items()} == counts
    for spans in place.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 60
        assert sum(3 * n > 60 for _, n in spans) <= 2
    low = max(-(-sum(n * c for n, c in counts.items()) // 60), -(-sum(c for n, c in counts.items() if 3 * n > 60) // 2))
    low = max(low, sum(c for n, c in counts.items() if 2 * n > 60))
    assert len(place) <= 1.5 * low + 1


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_as_the_tokenizers_file(text):
    bpe = byte_bpe(*default_vocabulary())
    tok = Tokenizer.from_file(default_vocabulary()[1]) if not hasattr(check, "tok") else check.tok
    check.tok = tok
    for t in (text, text + " <|endoftext|> " + text):
        ids = bpe.ids(t)
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids
    assert bpe.lengths[bpe.ids(text)].sum() == len(text.encode())


def test_ids_of_pieces(docs):
    rows = token_pieces(docs.limit(20), with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in rows)
