import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from burstseries.llm.alignment import Aligned, aligned_documents, default_vocabularies, runs, signs_of, tokenizer_pair


@pytest.fixture(scope="module")
def plain():
    """Tokens with the bytes they spell, from the contract's own forms of both vocabularies."""
    import sentencepiece
    from tokenizers import Tokenizer, pre_tokenizers

    json_form = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    json_form.encode_special_tokens = True
    # byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    assert set(letters) == set(pre_tokenizers.ByteLevel.alphabet())
    pieces = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))

    def first(text):
        ids = json_form.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(letters[c] for c in json_form.id_to_token(i))) for i in ids]

    def second(text):
        out = []
        for i in pieces.encode(text):
            p = pieces.id_to_piece(i)
            out.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
        return out

    return first, second


def plain_groups(a, b):
    """Groups from the set of bytes where both end."""

    def ends(tokens):
        out, at = [], 0
        for _, x in tokens:
            at += len(x)
            out.append(at)
        return out

    ea, eb = ends(a), ends(b)
    both = sorted(set(ea) & set(eb))
    pa, pb = ({e: k for k, e in enumerate(x)} for x in (ea, eb))
    groups, i, j = [], 0, 0
    for end in both:
        i2, j2 = pa[end] + 1, pb[end] + 1
        groups.append(([x for x, _ in a[i:i2]], [x for x, _ in b[j:j2]]))
        i, j = i2, j2
    return groups


def check(docs, plain, **kw):
    first, second = plain
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    every, per_row = Counter(), []
    for _, text in rows:
        a, b = (first(text), second(text)) if text else ([], [])
        want = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            per_row.append(None)
            continue
        groups = plain_groups(a, b)
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        every.update(set(links))
        per_row.append((len(a), len(b), groups, links))
    top = {}
    for (a, _), n in every.items():
        top[a] = max(top.get(a, 0), n)
    want = []
    for (doc, _), got in zip(rows, per_row, strict=True):
        if got is None:
            want.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, groups, links = got
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        best = sum(t for p, t in links.items() if every[p] == top[p[0]])
        total = sum(t * every[p] for p, t in links.items())
        want.append((doc, na, nb, len(groups), sum(links.values()), best, total, hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in aligned_documents(docs, **kw).collect()]
    key = str
    assert sorted(got, key=key) == sorted(want, key=key)


def test_documents_against_sets_of_ends(docs, plain):
    check(docs, plain)


def test_cold_pairs_by_join(docs, plain):
    check(docs.limit(60), plain, hot_pairs=50)
    check(docs.limit(20), plain, hot_pairs=0)


def test_odd_rows(odd, plain):
    check(odd, plain)


def test_special_and_strange_texts(spark, plain):
    texts = ["<|endoftext|> and <s> </s> <unk> <0x41>", "▁ is no space", "  two  spaces \t\t tab", "a" * 3000, "\U0001f600" * 200, "日本語のテキスト" * 50,
             "\x00\x01\x02", " ", "\n", "é́", "ab▁cd", "x" * 50 + "▁" * 50, "1234567890" * 300]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), plain)


def test_empty_table(none):
    assert aligned_documents(none).collect() == []


def test_very_long_text_without_white_space(plain):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(200_000))
    first, second = tokenizer_pair(*default_vocabularies())
    assert first.encode([text])[0] == [i for i, _ in plain[0](text)]
    assert second.encode([text])[0] == [i for i, _ in plain[1](text)]


cuts = st.sets(st.integers(1, 120), max_size=80)


@settings(max_examples=300, deadline=None)
@given(cuts, cuts)
def test_runs(x, y):
    ea, eb = sorted(x | {121}), sorted(y | {121})
    groups, i, j = [], 0, 0
    for end in sorted(set(ea) & set(eb)):
        i2, j2 = ea.index(end) + 1, eb.index(end) + 1
        groups.append((i, i2, j, j2))
        i, j = i2, j2
    got = []
    flat = runs(ea, eb)
    for a, a2, b, b2 in (flat[k : k + 4] for k in range(0, len(flat), 4)):
        if a2 - a == b2 - b and ea[a] == eb[b]:
            got += [(a + k, a + k + 1, b + k, b + k + 1) for k in range(a2 - a)]
        else:
            got.append((a, a2, b, b2))
    assert got == groups


def test_large_groups_count_pairs_as_listed():
    a, b = np.array([k % 7 for k in range(100)]), np.array([k % 5 for k in range(90)])
    ea, eb = np.array(list(range(2, 200, 2)) + [1001]), np.array(list(range(1, 179, 2)) + [1001])
    assert not set(ea[:-1]) & set(eb[:-1])
    got = Aligned(a, b, ea, eb, signs_of(7, 5))
    want = Counter((int(x) << 32) + int(y) for x in a for y in b)
    assert dict(zip(got.pairs.tolist(), got.times.tolist(), strict=True)) == dict(want)
    assert (got.groups, got.links) == (1, 9000)
    assert got.text == ",".join(map(str, a)) + "|" + ",".join(map(str, b))
