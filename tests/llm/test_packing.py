import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenlex.llm import packing as P
from lumenlex.llm import tokens

PARTS = ["a", "b", " ", "  ", "\n", "\t", "foo", "don't", "é", "　", " ", "1", "漢", "!", "<|endoftext|>", "\r", "\x1c", "’", "ß", "x.", "y,", "z.,"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_cached_encoding_is_exact(reference):
    bpe, r = tokens.load(tokens.default_files()), random.Random(1)
    for _ in range(4000):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == reference(text), repr(text)


def test_a_full_cache_changes_nothing(reference):
    bpe = tokens.Bpe(*tokens.default_files(), cached_words=3)
    text = " ".join(f"word{i % 7}, wert{i}." for i in range(50))
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == reference(text)


def test_held_words_are_bounded(reference):
    """A worker keeps its encoder while other stages run; 250,000 words once took 32 MB of it."""
    bpe, words = tokens.Bpe(*tokens.default_files()), [f"w{i}x" for i in range(250_000)]
    whole = bpe.encode(" ".join(words))
    held = sys.getsizeof(bpe.cache) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in bpe.cache.items())
    assert held < 24e6
    for some in (words[:300], words[-300:]):  # those in the cache and those that found it full
        assert np.frombuffer(bpe.encode(" ".join(some)), "<u4").tolist() == reference(" ".join(some))
    assert whole.endswith(bpe.encode(" " + " ".join(words[-300:])))


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 2047, 5000])
def test_pieces(n):
    found = P.pieces(n)
    assert [s for s, _ in found] == [sum(x for _, x in found[:i]) for i in range(len(found))]
    assert sum(x for _, x in found) == n and all(x & (x - 1) == 0 and x <= 1024 for _, x in found)


def test_round_trip(docs_of, reference):
    texts = {1: "Hello there, world. " * 700, 2: None, 3: "", 4: "x", 5: "é " * 90}
    docs = docs_of([*texts.items(), (4, "x")]).withColumns({c: F.lit(0) for c in ("start", "length", "ids", "offset", "sequence_id")})
    rows = P.pack(docs).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    by = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and r["offset"] == 0 and r["length"] == 1 << r["bucket"] == 1 << (r["sequence_id"] >> 56)
        by[r["doc_id"]].append(r)
    for doc, text in texts.items():
        pieces = sorted(by[doc], key=lambda r: r["start"])
        if doc == 4:
            assert len(pieces) == 2
            continue
        want = [*reference(text or ""), 0]
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in pieces), "<u4").tolist() == want
        assert [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces[:-1])]).tolist()
        assert {r["doc_tokens"] for r in pieces} == {len(want)}


def test_empty_table_and_checksums(docs_of):
    assert P.pack(docs_of([])).collect() == []
    for r in P.pack(docs_of([(1, "some words here")])).withColumn("c", F.crc32("ids")).collect():
        assert r["c"] == zlib.crc32(bytes(r["ids"]))
    with pytest.raises(ValueError):
        P.pack(docs_of([]), window=1000)
