"""Static range asymmetric numeral system over token ids (numpy; all lanes of all blocks step together).

A block holds up to LANES * STEPS ids; id i belongs to lane i % LANES at step i // LANES. Lanes are
independent coders with a 64-bit state that share one stream of 32-bit words, laid out in the order
in which a decoder asks for them. The states at every EVERY-th step are kept as checkpoints with
their place in the stream, so decoding can start there; the first one starts the block. Each block
has a CRC-32 over its words and states.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

U64, U32 = np.uint64, np.uint32
LANES, STEPS, EVERY = 32, 512, 256
BITS = 20
LOW = U64(1 << 31)


@dataclass
class Table:
    """Frequencies that sum to 2**BITS, shared by all blocks; symbols that never occur have none."""

    freq: np.ndarray

    def __post_init__(self):
        self.freq = np.asarray(self.freq, U64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(U64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=U32), self.freq.astype(np.int64))
        self.filler = int(np.argmax(self.freq))

    @staticmethod
    def fit(counts: np.ndarray) -> Table:
        """Scales counts; every symbol that occurs keeps one slot at least."""
        counts = np.asarray(counts, np.float64)
        there = counts > 0
        if not there.any():
            counts, there = np.ones(1), np.ones(1, bool)
        spare = (1 << BITS) - int(there.sum())
        if spare < 0:
            raise ValueError("more symbols than slots")
        share = counts / counts.sum() * spare
        freq = np.where(there, 1 + np.floor(share), 0).astype(np.int64)
        rest = (1 << BITS) - int(freq.sum())
        order = np.argsort(-(share - np.floor(share)), kind="stable")
        freq[order[:rest]] += 1
        return Table(freq)


def encode(blocks: list[np.ndarray], table: Table) -> list[dict]:
    """blocks: ids of 1..LANES * STEPS each. One dict per block: n, words, states, at, crc."""
    out: list[dict] = [{} for _ in blocks]
    by_steps: dict[int, list[int]] = {}
    for i, ids in enumerate(blocks):
        by_steps.setdefault(-(-len(ids) // LANES), []).append(i)
    for steps, which in by_steps.items():
        width = len(which)
        data = np.full((width, steps * LANES), table.filler, np.int64)
        for row, i in enumerate(which):
            data[row, : len(blocks[i])] = blocks[i]
        data = data.reshape(width, steps, LANES).transpose(1, 0, 2)
        x = np.full((width, LANES), LOW, U64)
        words = np.empty((steps, width, LANES), U32)
        emits = np.empty((steps, width, LANES), bool)
        marks = {}
        for t in range(steps - 1, -1, -1):
            f, c = table.freq[data[t]], table.start[data[t]]
            emit = x >= f << U64(63 - BITS)
            words[t], emits[t] = x.astype(U32), emit
            x = np.where(emit, x >> U64(32), x)
            q = x // f
            x = (q << U64(BITS)) + (x - q * f) + c
            if t % EVERY == 0:
                marks[t] = x
        for row, i in enumerate(which):
            mask = emits[:, row, :]
            stream = words[:, row, :][mask].tobytes()
            count = np.concatenate([[0], np.cumsum(mask.sum(axis=1))])
            at = sorted(marks)
            states = np.concatenate([marks[t][row] for t in at]).tobytes()
            out[i] = {"n": len(blocks[i]), "words": stream, "states": states, "at": [int(count[t]) for t in at], "crc": zlib.crc32(states, zlib.crc32(stream))}
    return out


def decode(blocks: list[dict], table: Table, mark: int = 0) -> list[np.ndarray]:
    """Ids of each block from its checkpoint number `mark` on."""
    out: list[np.ndarray] = [np.zeros(0, U32)] * len(blocks)
    by_steps: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        if zlib.crc32(b["states"], zlib.crc32(b["words"])) != b["crc"]:
            raise ValueError("a block's checksum differs")
        steps = -(-b["n"] // LANES) - mark * EVERY
        if steps > 0:
            by_steps.setdefault(steps, []).append(i)
    mask, high = U64((1 << BITS) - 1), U64(32)
    for steps, which in by_steps.items():
        stream = np.frombuffer(b"".join(blocks[i]["words"] for i in which) + b"\0\0\0\0", U32)
        size = [len(blocks[i]["words"]) // 4 for i in which]
        ends = np.cumsum([0, *size])
        place = np.array([ends[r] + blocks[i]["at"][mark] for r, i in enumerate(which)], np.int64)
        x = np.stack([np.frombuffer(blocks[i]["states"], U64)[mark * LANES : (mark + 1) * LANES] for i in which])
        got = np.empty((steps, len(which), LANES), U32)
        for t in range(steps):
            slot = x & mask
            s = table.symbol[slot.astype(np.int64)]
            got[t] = s
            x = table.freq[s] * (x >> U64(BITS)) + slot - table.start[s]
            need = x < LOW
            rank = np.cumsum(need, axis=1)
            word = stream[np.minimum(place[:, None] + rank - 1, len(stream) - 1)]
            x = np.where(need, (x << high) | word.astype(U64), x)
            place += rank[:, -1]
        if not (x == LOW).all():
            raise ValueError("a block doesn't end where it should")
        for r, i in enumerate(which):
            out[i] = got[:, r, :].reshape(-1)[: blocks[i]["n"] - mark * EVERY * LANES]
    return out
