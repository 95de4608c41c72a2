import numpy as np
import pytest
from tokenizers import Tokenizer

from burstseries.llm.bpe import default_vocabulary
from burstseries.llm.token_counts import attribute, field_token_counts, section_token_counts


def plain(tok, text, rule):
    """Character by character, with the offsets of the other tokenizer library."""
    data = text.encode()
    lines = data.splitlines(keepends=True) if b"\r" not in data else None
    lines = [x + b"\n" for x in data.split(b"\n")]
    lines[-1] = lines[-1][:-1]
    if len(lines) > 1 and not lines[-1]:
        lines.pop()
    of = [i for i, x in enumerate(lines) for _ in x]
    counts = [0] * len(lines)
    at = 0
    for t in tok.encode(text, add_special_tokens=False).tokens:
        n = len(t)  # one character of the printable alphabet per byte
        mine = of[at : at + n]
        at += n
        pick = {"first": mine[0], "last": mine[-1], "most": max(sorted(set(mine)), key=lambda s: (mine.count(s), -s))}
        counts[pick[rule]] += 1
    assert at == len(data)
    return counts


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_lines(docs, odd, rule):
    tok = Tokenizer.from_file(default_vocabulary()[1])
    for df in (docs.limit(60), odd.dropDuplicates(["doc_id"])):
        got = {}
        for r in section_token_counts(df, rule=rule).collect():
            got.setdefault(r["doc_id"], {})[r["section"]] = r
        for r in df.collect():
            text = r["text"] or ""
            want = plain(tok, text, rule) if text else [0]
            mine = got[r["doc_id"]]
            assert [mine[i]["n_tokens"] for i in range(len(mine))] == want
            assert sum(x["n_chars"] for x in mine.values()) == len(text)


def test_crossing_rule():
    lengths, starts = np.array([2, 3, 5]), np.array([0, 3, 3, 6])
    assert attribute(lengths, starts, "first")[0].tolist() == [2, 0, 1, 0]
    assert attribute(lengths, starts, "last")[0].tolist() == [1, 0, 1, 1]
    assert attribute(lengths, starts, "most")[0].tolist() == [1, 0, 1, 1]
    assert attribute(lengths, starts)[1].tolist() == [1, 1, 2, 1]


def test_fields(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = field_token_counts(df, ["conv_id", "turn"], ["role", "text"]).collect()
    tok = Tokenizer.from_file(default_vocabulary()[1])
    texts = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in df.collect()}
    for r in got[:50]:
        role, text = texts[(r["conv_id"], r["turn"])]
        whole = len(tok.encode((role or "") + "\n" + (text or ""), add_special_tokens=False).ids)
        assert r["role_tokens"] + r["text_tokens"] == whole


def test_empty(none):
    assert section_token_counts(none).count() == 0
