"""A static range asymmetric numeral system over token ids, in numpy.

One frequency table is shared by all blocks. A block deals its ids out to
``LANES`` coder states in turn, so that one numpy step codes ``LANES`` ids, and
is independent of the others: it has its own checksum, and checkpoints (all
states and the place in the words) from which decoding can begin inside it.

States are 64 bits wide and give off 32-bit words; the encoder runs from the
last step to the first, the decoder from the first to the last.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 18  # frequencies add up to 2 ** SCALE
LANES = 1024
CHECKPOINT = 128  # steps
_U = np.uint64
_LOW = 1 << 32
_HEAD = struct.Struct("<IIIII")  # ids, lanes, words, steps between checkpoints, crc32 of the rest


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to add up to ``2 ** scale``, at least 1 for each id that occurs."""
    total, whole = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.int64)
    seen = counts > 0
    if seen.sum() > whole:
        raise ValueError("more ids than the scale can tell apart")
    out = np.where(seen, np.maximum(1, np.floor(counts * (whole / total)).astype(np.int64)), 0)
    over = int(out.sum()) - whole
    if over < 0:
        out[int(counts.argmax())] -= over
    while over > 0:  # taken from the most frequent, in proportion
        spare = np.where(out > 1, out - 1, 0)
        take = np.minimum(spare, -(-spare * over // int(spare.sum())))
        take = np.where(np.cumsum(take) <= over, take, np.maximum(0, over - (np.cumsum(take) - take)))
        out -= take
        over = int(out.sum()) - whole
    return out


class Table:
    """Frequencies, their running sum, and the id of each slot."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale = scale
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.id_of = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    @property
    def crc(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
        """One block."""
        steps = -(-len(ids) // lanes)
        freq, start = self.freq[ids], self.start[ids]
        if len(ids) and not freq.all():
            raise ValueError("an id isn't in the frequency table")
        x = np.full(lanes, _LOW, np.uint64)
        words, saved, written = [], [], []
        for step in range(steps - 1, -1, -1):
            a, b = step * lanes, min(len(ids), (step + 1) * lanes)
            f, y = freq[a:b], x[:b - a]
            full = (y >> _U(64 - self.scale)) >= f
            out = y[full].astype(np.uint32)
            y[full] >>= _U(32)
            q = y // f
            x[:b - a] = (q << _U(self.scale)) + (y - q * f) + start[a:b]
            words.append(out)
            if step % every == 0:
                saved.append(x.copy())
                written.append(step)
        words, saved = words[::-1], saved[::-1]
        places = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype("<u4")[::every][:len(saved)]
        body = places.tobytes() + b"".join(s.astype("<u8").tobytes() for s in saved) + b"".join(w.astype("<u4").tobytes() for w in words)
        return _HEAD.pack(len(ids), lanes, sum(map(len, words)), every, zlib.crc32(body)) + body

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids ``first`` to ``last`` of a block, begun at the checkpoint before ``first``."""
        n, lanes, n_words, every, crc = _HEAD.unpack_from(block)
        body = memoryview(block)[_HEAD.size:]
        if zlib.crc32(body) != crc:
            raise ValueError("a block doesn't match its checksum")
        last = n if last is None else min(last, n)
        if first >= last:
            return np.zeros(0, np.uint32)
        steps = -(-n // lanes)
        saved = -(-steps // every)
        places = np.frombuffer(body, "<u4", saved)
        states = np.frombuffer(body, "<u8", saved * lanes, saved * 4).reshape(saved, lanes)
        words = np.frombuffer(body, "<u4", n_words, saved * (4 + 8 * lanes))
        begin = first // lanes // every
        x, at = states[begin].astype(np.uint64), int(places[begin])
        out = np.empty((steps - begin * every) * lanes, np.uint32)
        mask, scale = _U((1 << self.scale) - 1), _U(self.scale)
        end = -(-last // lanes)
        for step in range(begin * every, end):
            live = min(lanes, n - step * lanes)
            y = x[:live]
            slot = y & mask
            ids = self.id_of[slot]
            y = self.freq[ids] * (y >> scale) + slot - self.start[ids]
            low = y < _U(_LOW)
            k = int(low.sum())
            y[low] = (y[low] << _U(32)) | words[at:at + k]
            at += k
            x[:live] = y
            to = (step - begin * every) * lanes
            out[to:to + live] = ids
        base = begin * every * lanes
        return out[first - base:last - base]
