"""BPE coding: any text against the library, another vocabulary, bounded memories, reuse of chunks."""

import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "\n", "\t ", "\x1c", "\x85", "\xa0", "　", "the", "Word", "it's", "'ll", "12.5%", "é", "É", "ß", "İ", "Σς", "́", "漢字", "م", "😀", "...", "<|endoftext|>", "<|startoftext|>", "x" * 300]


@pytest.fixture(scope="module")
def coders():
    return Tokenizer.from_file(PATH), bpe.ChunkCoder(PATH, cut_bits=3, most_words=20_000, most_bytes=20_000)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=6)), max_size=30))
def test_any_text(coders, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    plain, coder = coders
    want = plain.encode(text, add_special_tokens=False).ids
    ids, decoded = coder.code(text.encode())
    assert np.frombuffer(ids, np.uint32).tolist() == want and decoded == plain.decode(want, skip_special_tokens=False)


def test_another_vocabulary_goes_to_the_library_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["Two  words\n and more", "", "it's É 漢字 " * 50]
    rows = bpe.encode_decode(spark.createDataFrame([(t,) for t in texts], "text string"), path).collect()
    assert [r["ids"] for r in rows] == [plain.encode(t, add_special_tokens=False).ids for t in texts] and [r["decoded"] for r in rows] == texts


def test_memories_are_bounded_in_bytes():
    def real(key, entry):
        return 104 + sum(map(sys.getsizeof, (key, entry, *entry)))

    coder = bpe.ChunkCoder(PATH, most_words=100_000, most_bytes=50_000)
    for k in range(300):
        coder.code(" ".join(f"word{k}x{i} É{k}Ж{i} {'漢' * 10}{i} {'Ж' * 16}" for i in range(200)).encode())
        for memory, most in ((coder.words, 100_000), (coder.pieces, 100_000), (coder.chunks, 50_000)):
            assert sum(real(*e) for e in memory.items()) <= most
    assert all(real(*e) <= bpe.WORD_ENTRY for memory in (coder.words, coder.pieces) for e in memory.items())


def test_shared_passages_are_encoded_once():
    """Chunks of a passage that documents share are met again, wherever it stands."""
    passage = " ".join(f"shared{i * i}" for i in range(3000))
    coder = bpe.ChunkCoder(PATH, most_bytes=64 << 20)
    coder.code(passage.encode())
    used = coder.used
    for k in range(10):
        coder.code(f"{'own ' * (k * 7 + 1)}{passage} end {k}".encode())
    assert coder.used > 10 * used * 0.9 and coder.used - coder.made > 0.9 * (coder.used - used)
