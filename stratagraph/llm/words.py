"""Word streams that do not depend on case, punctuation, markup, escapes or layout."""

from __future__ import annotations

import ast
import base64
import html
import os
import re
import unicodedata

import numpy as np
import xxhash

#: Where public tokenizers lie, and the one used; both are parameters of the operators.
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"

_CODE = re.compile(r"\\u([0-9a-fA-F]{4})")
_ESCAPE = re.compile(r"\\[nrt]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
#: A word hyphenated over a line end, with the quote, list or comment marks of the next line.
_WRAPPED = re.compile(r"(?<=\w)-[ \t]*\r?\n[\s>*#|/]*(?=\w)")
_WORD = re.compile(r"[^\W_]+")


def plain_words(text: str) -> list[str]:
    """The words of a text: runs of letters and digits, lower case, unescaped, unwrapped, without markup."""
    text = _ESCAPE.sub(" ", _CODE.sub(lambda m: chr(int(m[1], 16)), text))
    text = _INVISIBLE.sub("", _TAG.sub(" ", html.unescape(text)))
    return _WORD.findall(_WRAPPED.sub("", unicodedata.normalize("NFKC", text).lower()))


class Hasher:
    """64-bit hashes of words, remembered up to a bound (memory only, no effect on results)."""

    def __init__(self, keep: int = 200_000) -> None:
        self.seen: dict[str, int] = {}
        self.keep = keep

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.keep:
            seen.clear()
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            out[i] = h
        return out


def split_pattern(tokenizers: str) -> str:
    """The pattern that the folder of tokenizers states as ``PATTERN``; its file is read as text, not run."""
    with open(os.path.join(tokenizers, "__init__.py"), encoding="utf-8") as f:
        for node in ast.parse(f.read()).body:
            if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "PATTERN" for t in node.targets):
                return ast.literal_eval(node.value)
    raise ValueError(f"{tokenizers} states no pattern")


def load_encoding(tokenizers: str, ranks: str):
    """The tokenizer of a rank file, with the pattern that its folder states."""
    import tiktoken

    with open(os.path.join(tokenizers, ranks), "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=split_pattern(tokenizers), mergeable_ranks=merges, special_tokens={})
