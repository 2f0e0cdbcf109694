"""Public tokenizers inside Python workers: loaded once per process, never trained, their files never copied."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
import re

#: Characters on which both libraries' regular expressions agree (ASCII and Latin letters, common marks).
_PLAIN = re.compile("[\t\n\r -~ -ɏΑ-ΡΣ-ωА-я‐-―‘-”†-•…€]*")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


@functools.lru_cache(maxsize=8)
def tokenizer_version(name: str) -> str:
    """The digest that names a tokenizer's version: SHA-256 of its file."""
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@functools.lru_cache(maxsize=4)
def library_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(maxsize=4)
def _ranks(name: str):
    """The same vocabulary as ranks, in the faster library, where the file has such a twin."""
    import public_tokenizers as public
    import tiktoken

    twin = name.removesuffix(".json") + ".tiktoken"
    try:
        path = tokenizer_path(twin)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except (OSError, KeyError, ValueError):  # no twin: the library alone is used
        return None
    return tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _specials(name: str) -> tuple[str, ...]:
    """The added tokens' strings, from the file alone: most workers never load the library's tokenizer."""
    with open(tokenizer_path(name), "rb") as f:
        return tuple(x["content"] for x in json.load(f).get("added_tokens", ()))


def encode(name: str, texts: list[str]) -> list[list[int]]:
    """The ids that the library gives for each text, without added special tokens.

    Texts of plain characters without a special token's string go through the equal rank table,
    which is several times faster; all others, and files without such a table, through the library.
    """
    if name.endswith(".model"):
        return sentence_pieces(name).encode(texts, num_threads=1)
    quick, specials = _ranks(name), _specials(name)
    out: list = [None] * len(texts)
    rest = []
    for i, text in enumerate(texts):
        if quick is not None and _PLAIN.fullmatch(text) and not any(s in text for s in specials):
            out[i] = quick.encode_ordinary(text)
        else:
            rest.append(i)
    for i in rest:
        out[i] = library_tokenizer(name).encode(texts[i], add_special_tokens=False).ids
    return out


@functools.lru_cache(maxsize=4)
def sentence_pieces(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
