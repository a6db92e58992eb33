import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from quillstone.llm import byte_bpe

PATH, PATTERN = byte_bpe.public_vocabulary()


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.encoder(PATH, PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(3)
    yield from ("", " ", "a" * 5000, "ab" * 3000, " " * 700 + "x", "é" * 999, "漢字" * 400, "<|endoftext|>", "don't\r\n\r\n  we'll", "\x00\x01", "🙂" * 300, "0123456789" * 300)
    for size in (10, 60, 300, 2000):
        for letters in ("ab", "aeiournst", "etaoin shrdlu\n", "éèàüßñ a", "#*=-", "0123456789"):
            for _ in range(6):
                yield "".join(rng.choice(letters) for _ in range(size))


def test_tree_reduction_equals_the_library(coder, library):
    for text in texts():
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_ids_come_from_joins_in_the_tree(library):
    own = byte_bpe.Encoder(byte_bpe.read_ranks(PATH), PATTERN)
    text = "An unremarkable paragraph about quillwork, stonemasonry and gooseberries."
    assert own.encode(text) == library.encode_ordinary(text)
    pieces = [p for p in own.pattern.findall(text) if p.encode() not in own.ranks]
    assert len(pieces) >= 4 and 20 < own.joins <= sum(len(p.encode()) - 1 for p in pieces)  # equal subtrees are joined once
    for p in own.pattern.findall(text):  # the tree alone gives the same as a look-up of the whole piece
        assert own._tree(p.encode()) == tuple(library.encode_ordinary(p))


def test_concatenation_up_a_tree():
    for n in range(20):
        assert byte_bpe.up([bytes([k]) for k in range(n)]) == bytes(range(n))
        assert byte_bpe.up([(k,) for k in range(n)], ()) == tuple(range(n))


def test_every_token_encodes_as_itself(coder):
    assert all(coder.merge(token) == [rank] for token, rank in coder.ranks.items())


def test_long_merge_equals_short_merge(coder):
    rng = random.Random(5)
    for _ in range(200):
        data = bytes(rng.choice(b"aeinst er") for _ in range(rng.randint(0, 150)))
        assert coder._merge_long(data) == coder.merge(data)


def test_query_shape(spark, library):
    rows = [(1, "Some text, and more.", 5), (2, None, 6), (3, "", 7), (3, "", 7), (None, "x" * 9000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(byte_bpe.round_trip(docs, PATH, PATTERN).collect(), key=str)
    assert len(got) == 5
    for r in got:
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_columns_round_trip_and_empty(spark):
    docs = spark.createDataFrame([(1, "Eins zwei"), (2, None)], "doc_id long, text string")
    back = byte_bpe.decode_column(byte_bpe.encode_column(docs, PATH, PATTERN), PATH, PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {1: b"Eins zwei", 2: b""}
    assert byte_bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0


def test_columns_with_the_new_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "Eins zwei", "old", 4, b"x")], "doc_id long, text string, IDS string, decoded_sha256 int, decoded binary")
    coded = byte_bpe.encode_column(docs, PATH, PATTERN)
    assert coded.columns == ["doc_id", "text", "decoded_sha256", "decoded", "ids"]
    back = byte_bpe.decode_column(coded, PATH, PATTERN)
    assert back.columns == ["doc_id", "text", "decoded_sha256", "ids", "decoded"] and bytes(back.first().decoded) == b"Eins zwei"
    checked = byte_bpe.encode_and_check(docs, PATH, PATTERN)
    assert checked.columns == ["doc_id", "decoded", "ids", "decoded_sha256"]
    assert checked.first().decoded_sha256 == hashlib.sha256(b"Eins zwei").hexdigest()
