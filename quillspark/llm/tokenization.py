"""Token ids of a public byte-level BPE vocabulary, kept once in each Python worker."""

from __future__ import annotations

import json
import re

import numpy as np

#: Outside these ranges the two libraries might know different versions of Unicode; such texts go to `tokenizers`.
_PLAIN = re.compile("[\x09-\x0d\x20-\x7e\xa0-ɏ‐-‧‰-⁞₠-₿]*")


class Encoder:
    """Ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` of `tokenizers` gives them.

    `tiktoken` encodes the same vocabulary several times faster; it is used for texts of plain Latin characters in which
    no special token is written out.
    """

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        special = {t.content for t in self.exact.get_added_tokens_decoder().values()}
        # the vocabulary writes each byte as a printable character: the bytes that print, then 256 and on for the others
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        if set(byte_of) != set(ByteLevel.alphabet()):
            raise ValueError(f"{path} isn't a byte-level vocabulary")
        self.special = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)")
        ranks = {bytes(byte_of[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def ids(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and not self.special.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
