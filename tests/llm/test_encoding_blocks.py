"""Blocks of texts: ids as Arrow arrays, a word learnt once, whatever marks follow it, and no word looked at again."""

import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidemill.llm.encoding import Encoder
from tidemill.llm.packing import pieces

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = ["a", "B", " ", "  ", "\n", "\n\n", "\r\n", ".", ",", "é", "'s", "'", "1", "\t", "***", "the", "x;", "O'Neil", "\xa0", "\x0b", "\x1c", "\x85", "\u3000", "\u2003", "\u2028", "\u202f", "\u205f", "\u1680"]
PARTS += ["р", "с", "中", "À", "W\u030a", "\u0301", "\u0338", "=", "<", ">", "|", "<|endoftext|>", "<|startoftext|>", "Σ", "ΑΣ", "İ", "\x00", "\ufeff", "🙂"]


@pytest.mark.parametrize("name", NAMES)
def test_cuts_are_exact(name):
    rng = random.Random(11)
    own = Encoder(public_tokenizers.path(name), 1, remember=2000)
    for at_once in (50, 5000, 1_000_000):
        texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(2500)]
        got = [x for block in own.arrays(pa.array(texts), at_once) for x in block.to_pylist()]
        want = own.tokenizer.encode_batch(texts, add_special_tokens=False)
        for text, ids, whole in zip(texts, got, want, strict=True):
            assert np.frombuffer(ids, own.dtype).tolist() == [*whole.ids, 1], text


@pytest.mark.parametrize("name", NAMES)
def test_a_word_is_learnt_once(name, monkeypatch):
    own, learnt = Encoder(public_tokenizers.path(name), 1), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda pieces: learnt.append(len(pieces)) or learn(pieces))
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(200)]
    texts = pa.array([None, *(" ".join(rng.choice(words) + rng.choice(["", ",", ".", ";", "!?"]) for _ in range(400)) for _ in range(50)), ""])
    first, again = list(own.arrays(texts)), list(own.arrays(texts.slice(1, 50)))
    assert learnt[0] < 2 * len(words) + 10 and learnt[1:] == [0]
    assert [len(x) for x in first] == [52] and first[0].slice(1, 50).equals(again[0])
    assert first[0][0].as_py() == first[0][51].as_py() == np.array([1], own.dtype).tobytes()
    assert list(own.arrays(pa.array([], pa.string()))) == []
    bare = Encoder(public_tokenizers.path(name), None)
    assert list(bare.encode_all(["", None])) == [b"", b""]


def test_pieces_over_several_blocks(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["the", "of", "and,", "Was.", "is\n"], k=n)) for n in (1_200_000, 10, 900_000, 1_000_000)]
    rows = [(7, texts[0]), (None, None), (5, texts[1]), (5, texts[2]), (3, ""), (2, texts[3])]
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, want = Encoder(path, 2), collections.Counter()
    for doc, text in rows:
        ids = np.array([*own.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want.update((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(itertools.pairwise(cuts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sum(len(t) for t in texts) > 8_000_000
    assert collections.Counter(tuple(r) for r in pieces(df, path, 2, 1024).collect()) == want
