"""keccak256 (the padding before SHA-3), in batches with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 136


def _round_constants() -> list[np.uint64]:
    """From the linear feedback shift register x^8 + x^6 + x^5 + x^4 + 1."""
    out, register = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            if register & 1:
                value |= 1 << ((1 << j) - 1)
            register = (register << 1) ^ (0x171 if register & 0x80 else 0)
        out.append(np.uint64(value))
    return out


def _rotations() -> np.ndarray:
    """Offsets of lane (x, y), walking the lanes as the specification does."""
    r, x, y = np.zeros((5, 5), int), 1, 0
    for t in range(24):
        r[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return r


_CONSTANTS, _OFFSETS = _round_constants(), _rotations()


def _rotate(lane: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return lane << np.uint64(by) | lane >> np.uint64(64 - by) if by else lane


def _permute(state: np.ndarray) -> np.ndarray:
    """keccak-f[1600] of many states at once; shape (5, 5, n), indexed x, y."""
    for constant in _CONSTANTS:
        column = np.bitwise_xor.reduce(state, axis=1)
        theta = np.stack([column[(x - 1) % 5] ^ _rotate(column[(x + 1) % 5], 1) for x in range(5)])
        state = state ^ theta[:, None]
        moved = np.empty_like(state)
        for x in range(5):
            for y in range(5):
                moved[y, (2 * x + 3 * y) % 5] = _rotate(state[x, y], int(_OFFSETS[x, y]))
        state = moved ^ (~np.roll(moved, -1, axis=0) & np.roll(moved, -2, axis=0))
        state[0, 0] ^= constant
    return state


def keccak256(messages: list[bytes]) -> list[str]:
    """Hex digests; messages of an equal number of blocks run together."""
    out: list[str] = [""] * len(messages)
    by_blocks: dict[int, list[int]] = {}
    for i, m in enumerate(messages):
        by_blocks.setdefault(len(m) // RATE + 1, []).append(i)
    for blocks, rows in by_blocks.items():
        raw = np.zeros((len(rows), blocks * RATE), np.uint8)
        for k, i in enumerate(rows):
            raw[k, : len(messages[i])] = np.frombuffer(messages[i], np.uint8)
            raw[k, len(messages[i])] ^= 0x01
            raw[k, -1] ^= 0x80
        words = raw.view("<u8").reshape(len(rows), blocks, RATE // 8)
        state = np.zeros((5, 5, len(rows)), np.uint64)
        for b in range(blocks):
            for w in range(RATE // 8):
                state[w % 5, w // 5] ^= words[:, b, w]
            state = _permute(state)
        digest = np.stack([state[w % 5, w // 5] for w in range(4)], axis=1).astype("<u8")
        for k, i in enumerate(rows):
            out[i] = digest[k].tobytes().hex()
    return out


def keccak_hex(text: Column) -> Column:
    """0x and the keccak256 of a text's UTF-8 bytes."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        out = pd.Series([None] * len(texts), dtype=object)
        out[known.to_numpy()] = ["0x" + x for x in keccak256([t.encode() for t in texts[known]])]
        return out

    return digest(text)
