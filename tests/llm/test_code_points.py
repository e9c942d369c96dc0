"""Every code point of the fast paths for Latin texts, and some beyond, against the tokenizers' own libraries."""

import random

import numpy as np
import public_tokenizers
import pytest

from quillgraph.llm.byte_bpe import encode_words, read_ranks, words_of
from quillgraph.llm.packing import encoder
from quillgraph.llm.token_counts import count_text

LETTERS = [chr(c) for c in range(0x260)] + list("ΑΣςאम語한🙂\u2003\u3000\u212a\u1e9e\u0307")
CAPITALS = "ƁƆƉƊƏƐƓƔƖƗƜƝƟƦƩƮƱƲƷȺȾɄɅ"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    alone = [form for c in LETTERS for form in (c, f"a{c}b", f" {c} {c}{c}x", f"{c}'s 1{c}")]
    mixed = ["".join(rng.choice(LETTERS[32:]) if rng.random() < 0.3 else rng.choice("aeiou nrstAE  12,.'\n") for _ in range(rng.randint(1, 80))) for _ in range(600)]
    return alone + mixed + [f"{c}a B{c}" for c in CAPITALS]


def test_packing_ids(texts):
    own = encoder(str(public_tokenizers.path("word_bpe_49k.json")))
    got = [np.frombuffer(raw, dtype="<u4").tolist() for raw in own.encode(texts)]
    want = [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_byte_ids(texts):
    import tiktoken

    path = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    assert [t for t in texts if [i for ids in encode_words(words_of(t), path) for i in ids] != library.encode_ordinary(t)] == []


def test_counts(texts):
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [t for t in texts if count_text(t, path) != len(library.encode(t))] == []
