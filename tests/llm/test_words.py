"""How op7 takes words from a chunk, against a plain definition."""

from __future__ import annotations

import re

import numpy as np

from voxloom.llm import recompression


def test_words_end_at_documents_and_at_six_characters_only():
    texts = [b"", b" ", b"a", b"b c\t\x0b\x0c\r\nd", "   x \x1c\x1d\x85\xa0y".encode(), b" e ", b"f"]
    plain = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in texts]
    names, counts, _ = recompression._units(np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts))), b"k" * 16)
    assert list(recompression._split(b"".join(texts), np.array(list(map(len, texts))))) == plain
    assert counts.tolist() == list(map(len, plain)) and len(names) == sum(map(len, plain))
    assert len(set(names.tolist())) == len({w for own in plain for w in own})
