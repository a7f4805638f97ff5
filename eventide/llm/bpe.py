"""Byte-level BPE ids of whole texts, equal to those of the tokenizers library.

The vocabulary file is a parameter. A text made of ordinary Latin characters is encoded by a second
implementation of the same vocabulary (same merges, same split pattern) that is several times faster;
any other text goes to the tokenizers library itself, because libraries follow different Unicode
versions. Both give the same ids, which the tests compare.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Characters on which every Unicode version agrees; other texts take the reference path.
_UNUSUAL = re.compile("[^\x00-\x7e¡-§©-¬®-ɏ‐-‧€]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def library_tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=4)
def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte, as byte-level vocabularies write their pieces."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return table


@lru_cache(maxsize=4)
def id_to_piece(path: str) -> list[tuple[int, bytes]]:
    """(id, bytes) of every vocabulary entry; the vocabulary's size bounds the list."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = special_tokens(path)
    alphabet = byte_alphabet()
    rows = {i: bytes(alphabet[c] for c in piece) for piece, i in model["model"]["vocab"].items() if piece not in special}
    rows |= {i: s.encode() for s, i in special.items()}
    return sorted(rows.items())


@lru_cache(maxsize=4)
def fast_encoding(path: str):
    import public_tokenizers
    import tiktoken

    special = special_tokens(path)
    ids = set(special.values())
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in id_to_piece(path) if i not in ids}, special_tokens=special)


def encode_texts(texts: list[str], path: str) -> list[np.ndarray]:
    """uint32 ids of each text, in order."""
    fast, out, odd = fast_encoding(path), [], []
    for k, text in enumerate(texts):
        if _UNUSUAL.search(text):
            odd.append(k)
            out.append(None)
        else:
            out.append(np.array(fast.encode(text, allowed_special="all"), dtype=np.uint32))
    if odd:
        tok = library_tokenizer(path)
        for k, e in zip(odd, tok.encode_batch([texts[k] for k in odd], add_special_tokens=False)):
            out[k] = np.array(e.ids, dtype=np.uint32)
    return out
