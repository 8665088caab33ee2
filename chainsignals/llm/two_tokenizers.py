"""Both tokenizations of a text in one stream, cached by chunk.

A chunk is a run of spaces with what follows up to the next space.  A space after a sign
that is no white space begins a new token in either vocabulary: byte-level splitting never
joins white space to what stands before it, and no piece of the other vocabulary has its
space mark behind another sign (checked as it is loaded).  So chunks are encoded one by
one and those met before come from a cache bounded in bytes; a text without such spaces
is a single chunk.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .tokenize import Generations

#: Ids of the second vocabulary are stored from here on; ids of the first are below.
SHIFT = 1 << 16
#: Marks a chunk whose tokens do not give its bytes back.
BROKEN = np.array([0xFFFFFFFF], "<u4").tobytes()
#: Chunks that go to the lockstep as one segment.
SLICE = 64
#: Longer chunks are not kept in the cache.
_CACHED = 128
_LOOSE, _BREAK = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")
_SPACE_MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """Signs of byte-level vocabularies to bytes: printable Latin-1 signs are themselves, other bytes follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TwoTokenizers:
    """Encodes texts by a byte-level vocabulary (A) and a piece vocabulary (B)."""

    def __init__(self, first: str | None = None, second: str | None = None, cache_bytes: int = 96 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        if first is None or second is None:
            import public_tokenizers

            first = first or public_tokenizers.path("byte_bpe_50k.json")
            second = second or public_tokenizers.path("piece_bpe_32k.model")
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        alphabet = byte_alphabet()
        entries = {i: entry for entry, i in self.a.get_vocab().items()}
        self.a_bytes = [self._byte_level(entries.get(i, ""), alphabet) for i in range(max(entries) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if len(self.a_bytes) > SHIFT or len(self.b_bytes) > SHIFT:
            raise ValueError("ids of a vocabulary do not fit 16 bits")
        self.space = self.b.piece_to_id(_SPACE_MARK)
        self.by_chunk = not any(b" " in x.lstrip(b" ") for x in self.b_bytes)
        self.a_width, self.b_width = (np.array([len(x) for x in known], np.int64) for known in (self.a_bytes, self.b_bytes))
        self.chunks = Generations(cache_bytes)

    @staticmethod
    def _byte_level(entry: str, alphabet: dict[str, int]) -> bytes:
        return bytes(map(alphabet.__getitem__, entry)) if all(c in alphabet for c in entry) else entry.encode()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE_MARK, " ").encode()

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, A before B; a chunk stands without the space that it begins with."""
        spaced = [" " + c for c in chunks]
        first = [x.ids for x in self.a.encode_batch(spaced, add_special_tokens=False)]
        # the library gives an empty text no space mark
        second = [ids if c else [self.space] for c, ids in zip(chunks, self.b.encode(chunks, num_threads=1), strict=True)]
        out = []
        for raw, a, b in zip(map(str.encode, spaced), first, second, strict=True):
            whole = b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])
            out.append(np.array([*a, *(i + SHIFT for i in b)], "<u4").tobytes() if whole else BROKEN)
        return out

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        old, learned = self.chunks.old.get, {}
        for c in chunks:
            if (ids := old(c)) is not None:
                learned[c] = ids
        new = [c for c in chunks if c not in learned]
        for at in range(0, len(new), 4096):
            learned.update(zip(new[at : at + 4096], self._encoded(new[at : at + 4096]), strict=True))
        self.chunks.add({c: x for c, x in learned.items() if len(c) <= _CACHED})
        return learned

    def _chunks(self, text: str) -> list[str]:
        if not self.by_chunk:
            return [text]
        spaced = " " + text
        if _LOOSE.search(spaced) is None:
            return text.split(" ")
        return [c[1:] for c in _BREAK.split(spaced)]

    def segments(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in one array, where each segment ends in it, and the number of its text.

        A segment is a slice of a text's chunks.  Empty texts, and those that hold a chunk
        whose tokens do not give its bytes back, have no segment.
        """
        found = []
        new: set[str] = set()
        for text in texts:
            chunks = self._chunks(text) if text else []
            ids = list(map(self.chunks.new.get, chunks))
            gaps = [(i, chunks[i]) for i, x in enumerate(ids) if x is None]
            new.update(c for _, c in gaps)
            found.append((ids, gaps))
        learned = self._learn(new) if new else {}
        parts, of = [], []
        for number, (ids, gaps) in enumerate(found):
            for i, c in gaps:
                ids[i] = learned[c]
            slices = [b"".join(ids[at : at + SLICE]) for at in range(0, len(ids), SLICE)]
            broken = any(BROKEN in s and 0xFFFFFFFF in np.frombuffer(s, "<u4") for s in slices)
            if not broken:
                parts += slices
                of += [number] * len(slices)
        ends = np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)
        return np.frombuffer(b"".join(parts), "<u4"), ends, np.array(of, np.int64)


_loaded: dict[tuple, TwoTokenizers] = {}


def two_tokenizers(first: str | None = None, second: str | None = None) -> TwoTokenizers:
    """The worker's own pair, kept between tasks."""
    if (first, second) not in _loaded:
        _loaded[first, second] = TwoTokenizers(first, second)
    return _loaded[first, second]
