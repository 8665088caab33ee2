"""Cached encoding with the public word BPE vocabulary.

White space and the vocabulary's splitting rule cut a normalized text into pieces
(letter runs, single digits, runs of other signs) that are encoded one by one.
Pieces repeat, so each worker keeps a cache from piece to ids and hands only new pieces
to the tokenizers library.  The cache is bounded in bytes, as a worker lives through
many tasks beside the executor's JVM.
A text with any character outside the plain Latin range, or with what may be a
special token, goes to the library as a whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

END_ID = 1
#: Latin-1 characters for which normalizing is lower-casing alone.
_PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *(x for x in range(0xC0, 0x100) if x not in (0xD7, 0xF7))])
#: The vocabulary's splitting pattern, narrowed to those characters, letters first (fixed value).
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\\sa-z0-9ß-öø-ÿ]+")


class Generations:
    """A cache of ids in two dictionaries; when the newer is full it replaces the older.

    What is met again in the older moves to the newer, so frequent keys stay and those
    met once go.  Both together hold ``max_bytes`` at most, beside one batch of keys.
    """

    #: Bytes of an entry besides its characters and ids: two object heads and a slot.
    ENTRY = 170

    def __init__(self, max_bytes: int):
        self.half, self.size = max_bytes // 2, 0
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def add(self, found: dict[str, bytes]) -> None:
        if self.size > self.half:
            self.old, self.new, self.size = self.new, {}, 0
        self.new.update(found)
        self.size += len("".join(found)) + len(b"".join(found.values())) + self.ENTRY * len(found)


class PieceEncoder:
    """Encodes whole texts (UTF-8 bytes) to ids as little-endian bytes."""

    def __init__(self, path: str | None = None, dtype: str = "<u4", cache_bytes: int = 96 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.whole = Tokenizer.from_file(path)
        #: The same model for pieces that are already normalized and split; ASCII bytes stand for themselves.
        self.model, self.latin = self.whole.model, Tokenizer(self.whole.model)
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.dtype = np.dtype(dtype)
        vocab = self.whole.get_vocab()
        if max(vocab.values()) > np.iinfo(self.dtype).max:
            raise ValueError(f"ids of {path} do not fit {dtype}")
        width, every = self.dtype.itemsize, np.arange(max(vocab.values()) + 1, dtype=self.dtype).tobytes()
        self.raw = [every[i : i + width] for i in range(0, len(every), width)]
        self.pieces = Generations(cache_bytes)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the newer cache does not hold."""
        old, tokenize, raw, learned = self.pieces.old.get, self.model.tokenize, self.raw, {}
        for p in pieces:
            ids = old(p)
            if ids is None:
                found = [t.id for t in tokenize(p)] if p.isascii() else self.latin.encode(p, add_special_tokens=False).ids
                ids = b"".join([raw[i] for i in found])
            learned[p] = ids
        self.pieces.add(learned)
        return learned

    @staticmethod
    def _plain(text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, _PLAIN) and "<|" not in text
        except UnicodeEncodeError:
            return False

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each whole text, without an end id."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            group: list[tuple[list[bytes], list[tuple[int, str]]]] = []
            size = 0
            while at < len(texts) and (not group or size + len(texts[at]) <= 2_000_000):
                text = texts[at].decode("utf-8", "replace")
                if self._plain(text):
                    pieces = _PIECES.findall(text.lower())
                    ids = list(map(self.pieces.new.get, pieces))
                    group.append((ids, [(i, pieces[i]) for i, x in enumerate(ids) if x is None]))
                else:
                    group.append(([self._whole(text)], []))
                size += len(text)
                at += 1
            new = {p for _, gaps in group for _, p in gaps}
            learned = self._learn(new) if new else {}
            for ids, gaps in group:
                for i, p in gaps:
                    ids[i] = learned[p]
                out.append(b"".join(ids))
        return out


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str | None = None, dtype: str = "<u4") -> PieceEncoder:
    """The worker's own encoder, kept between tasks."""
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = PieceEncoder(path, dtype)
    return _encoders[path, dtype]
