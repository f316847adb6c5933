import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from gridloom.llm import tokens  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_same_ids_as_plain_encoding(monkeypatch):
    rng = random.Random(1)
    plain, own = Tokenizer.from_file(PATH), tokens.ChunkTokenizer(PATH)
    parts = ["a", " ", "\n", "\t", "  ", "é", "\xa0", "1", "'s", "!!", "<|endoftext|>", " ", "\x1c", "\x85", "B", "。", "​", " x", "\r\n", "word", "'re ", ",", ".)", "<|", "|>", "²", "x,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + [None, "", "a " * 50_000, "z" * 30_000]
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 3_000)
    for at in range(0, len(texts), 2_000):
        some = texts[at : at + 2_000]
        flat, offsets = own.encode(some, 2)
        for i, text in enumerate(some):
            assert flat[offsets[i] : offsets[i + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2]


def test_without_end_id():
    flat, offsets = tokens.tokenizer(PATH).encode(["", "a b", None])
    assert offsets.tolist() == [0, 0, 2, 2] and flat.dtype == np.uint32
