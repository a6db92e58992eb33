from fractions import Fraction

import numpy as np
import pytest
from quillstone.llm import byte_bpe, token_counts

PATH, PATTERN = byte_bpe.public_vocabulary()


def brute(text, bounds, rule):
    coder = byte_bpe.encoder(PATH, PATTERN)
    owner = [i for i, c in enumerate(text) for _ in c.encode()]
    counts, outside, at = [Fraction(0)] * len(bounds), 0, 0
    for t in coder.encode(text):
        touched = sorted(set(owner[at : at + len(coder.bytes_of[t])]))
        at += len(coder.bytes_of[t])
        share = [sum(a <= c < b for c in touched) for a, b in bounds]
        if not any(share):
            outside += 1
        elif rule == "split":
            counts = [x + Fraction(s, sum(share)) for x, s in zip(counts, share)]
        else:
            k = share.index(max(share)) if rule == "most" else next(i for c in touched for i, (a, b) in enumerate(bounds) if a <= c < b)
            counts[k] += 1
    return [float(c) for c in counts], outside


TEXTS = ["Hello world\nsecond line\n\nlast", "été 🙂🙂 漢字\n\n\n  x", "a" * 50, "\n", "  \n \n word", "one"]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allocation_equals_a_plain_loop(rule):
    rng = np.random.default_rng(4)
    for text in TEXTS:
        lines = token_counts._line_bounds(text)
        cuts = np.sort(rng.integers(0, len(text) + 1, 8))
        for lows, highs in (lines, (cuts[::2], cuts[1::2]), (cuts[::-1][:4], cuts[::-1][:4] + 3), (cuts * 0, cuts), (cuts[4:], cuts[:4] + 9)):
            counts, outside = token_counts.allocate(*token_counts.spans(text, PATH, PATTERN), lows, highs, rule)
            want, left = brute(text, list(zip(lows.tolist(), highs.tolist())), rule)
            assert np.allclose(counts, want) and outside == left


def test_rows(spark):
    docs = spark.createDataFrame([(1, TEXTS[0], "a", [(0, 3), (3, 3), (20, 25)]), (2, None, "b", None), (2, "", "c", []), (None, "x y", "d", None)], "doc_id long, text string, section string, fields array<struct<start:int,end:int>>")
    lines = token_counts.attribute(docs, PATH, PATTERN).collect()
    assert sum(r.n_tokens for r in lines if r.doc_id == 1) == len(byte_bpe.encoder(PATH, PATTERN).encode(TEXTS[0]))
    assert [(r.section, r.n_tokens) for r in lines if r.doc_id == 2] == [(None, 0), (None, 0)]
    assert [(r.section, r.start, r.end, r.n_tokens) for r in lines if r.doc_id is None] == [(0, 0, 3, 2)]
    fields = token_counts.attribute(docs, PATH, PATTERN, sections="fields").collect()
    want, outside = brute(TEXTS[0], [(0, 3), (3, 3), (20, 25)], "most")
    assert [r.n_tokens for r in fields if r.doc_id == 1] == [*want, outside]
    assert token_counts.attribute(docs.limit(0), PATH, PATTERN).count() == 0


def test_a_very_long_text(spark):
    text = "word, another 12 é\n" * 60_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = token_counts.attribute(docs, PATH, PATTERN).collect()
    each = {r.n_tokens for r in got if r.section not in (None, 60_000)}
    assert len(got) == 60_001 and len(each) == 1 and each.pop() * 60_000 == len(byte_bpe.encoder(PATH, PATTERN).encode(text))
