"""Public tokenizers by file name, loaded once a process, for texts of any length."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import cache

END_OF_TEXT = "<|endoftext|>"
#: The byte that no byte-level vocabulary spells by itself stands for: printable bytes are their own letters.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


@cache
def _ranks(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


@cache
def _json(name: str, plain: bool):
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.encode_special_tokens = plain
    return found


@cache
def _pieces(name: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))


def byte_ids(text: str, name: str = "byte_bpe_50k.tiktoken", plain: bool = True) -> list[int]:
    """Ids of a byte-level vocabulary. ``plain``: ``<|endoftext|>`` inside a text is ordinary text.

    The rank form is the faster one, but its pattern matcher gives up on blank runs of about a million;
    the same vocabulary in JSON form has no such limit and takes those texts.
    """
    try:
        found = _ranks(name)
        return found.encode(text, allowed_special=set() if plain else "all", disallowed_special=())
    except ValueError:
        return _json(name.replace(".tiktoken", ".json"), plain).encode(text, add_special_tokens=False).ids


def encoder(name: str) -> Callable[[list[str]], list[list[int]]]:
    """From texts to ids, special strings as ordinary text, one blank before each text."""
    if name.endswith(".model"):
        found = _pieces(name)  # puts the blank itself
        return lambda texts: found.encode(texts, num_threads=1)
    return lambda texts: [byte_ids(f" {t}", name) for t in texts]


@cache
def spelling(name: str) -> list[bytes]:
    """The bytes of each id."""
    if name.endswith(".model"):
        found = _pieces(name)
        texts = [found.id_to_piece(i) for i in range(found.get_piece_size())]
        return [bytes([int(t[3:-1], 16)]) if found.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(texts)]
    found = _ranks(name)
    return [found.decode_single_token_bytes(i) for i in range(found.max_token_value)]


def letters() -> dict[str, int]:
    """Letter to byte, as byte-level vocabularies in JSON form write their entries."""
    hidden = [b for b in range(256) if b not in set(_PLAIN)]
    return {chr(b): b for b in _PLAIN} | {chr(256 + k): b for k, b in enumerate(hidden)}
