"""Public tokenizers as worker-side encoders: ids of a text, and the bytes that each id stands for.

A vocabulary file is read once on the driver and its content, of bounded size, travels to the workers
with the function, so executors need no file. ``ByteLevel`` is the byte-level BPE of a ``tokenizers``
file. Texts of code points below U+0240 go through ``tiktoken`` with the same vocabulary, which gives
the same ids several times faster (a test holds every such code point against ``tokenizers``); other
texts, those with a special token's string, and those with very long runs of white space go through
``tokenizers``. ``Pieces`` is a sentencepiece model.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np

#: Fixed value: the pattern by which byte-level vocabularies split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The lead byte of U+0200 to U+023F in UTF-8; no byte of a lower code point is greater.
_LAST_LEAD = 0xC8
_LONG_SPACE = re.compile(r"\s{20000}")
_BUILT: dict = {}


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """``encode`` gives ids, ``tokens`` the bytes of each id, ``sizes`` their lengths. Built once in a worker process."""

    def __init__(self, content: bytes):
        self.content = content

    @classmethod
    def from_file(cls, path: str, **options) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read(), **options)

    def __getstate__(self) -> dict:
        return {"content": self.content} | ({"specials": self.specials} if hasattr(self, "specials") else {})

    def key(self) -> tuple:
        return (type(self).__name__, hashlib.sha256(self.content).hexdigest())

    def worker(self) -> Vocabulary:
        """The one instance of this vocabulary in this process."""
        key = self.key()
        if key not in _BUILT:
            self.build()
            self.sizes = np.array([len(t) for t in self.tokens], np.int64)
            _BUILT[key] = self
        return _BUILT[key]

    def joined(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def exactly(self, text: str, data: bytes) -> np.ndarray | None:
        """The ids of a text, or None where their joined bytes aren't ``data``."""
        ids = self.encode(text)
        return np.array(ids, "<u4") if self.joined(ids) == data else None


class ByteLevel(Vocabulary):
    """specials: whether a special token's string inside a text is that token, or plain text."""

    def __init__(self, content: bytes, specials: bool = False):
        super().__init__(content)
        self.specials = specials

    def key(self) -> tuple:
        return (*super().key(), self.specials)

    def build(self) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(self.content)
        self.exact = Tokenizer.from_str(self.content.decode())
        self.exact.encode_special_tokens = not self.specials
        vocab, back = spec["model"]["vocab"], byte_of_char()
        added = {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*vocab.values(), *added]))
        for token, i in vocab.items():
            self.tokens[i] = bytes(map(back.__getitem__, token))
        for i, token in added.items():
            self.tokens[i] = token.encode()
        self.named = [re.escape(x) for x in added.values()] if self.specials else []
        self.named = re.compile("|".join(self.named)) if self.named else None
        self.fast = self._ranked(spec, vocab)

    def _ranked(self, spec: dict, vocab: dict):
        """The same merges by rank, where ids are in the order of merges and the pattern is ``SPLIT``; else None."""
        split = spec["pre_tokenizer"] or {}
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in spec["model"]["merges"]]
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["normalizer"] or spec["model"].get("ignore_merges") or any(a >= b for a, b in zip([255, *merged], merged)):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={self.tokens[i]: i for i in vocab.values()}, special_tokens={})

    def exactly(self, text: str, data: bytes) -> np.ndarray | None:
        if self.fast is None or self.named is not None or text.encode() != data:
            return super().exactly(text, data)
        # without names of special tokens every token is the bytes of some piece of the text, in order, so they are all of them if they are as many
        ids = np.array(self.encode(text, data), "<u4")
        return ids if self.sizes[ids].sum() == len(data) else None

    def encode(self, text: str, utf8: bytes | None = None) -> list[int]:
        utf8 = text.encode() if utf8 is None else utf8
        if not utf8:
            return []
        plain = self.fast is not None and np.frombuffer(utf8, np.uint8).max() <= _LAST_LEAD
        if plain and not (self.named and self.named.search(text)) and not (len(text) >= 20000 and _LONG_SPACE.search(text)):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


class Pieces(Vocabulary):
    """U+2581 in a piece is a space, <0xHH> a byte."""

    def build(self) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=self.content)
        n = self.model.get_piece_size()
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.model.id_to_piece(list(range(n))))]

    def encode(self, text: str, utf8: bytes | None = None) -> list[int]:
        return self.model.encode(text)
