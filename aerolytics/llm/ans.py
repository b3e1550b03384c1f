"""Static range asymmetric numeral coding of integer symbols, vectorised over many independent blocks.

A frequency table of 2^bits slots is shared by all blocks.  A block's symbols are dealt to ``LANES`` interleaved states of 64
bits; position p belongs to lane p mod LANES, and a state that would overflow gives its low 32 bits to the block's one
stream of words.  Blocks know nothing of each other: each is its lanes' last states and its words, and can be decoded
alone.  NumPy steps through many blocks at once, so the cost of a step is shared by all their lanes.
"""

from __future__ import annotations

import numpy as np

LANES = 4
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
#: Padded symbols that one pass of NumPy steps goes through.
TOGETHER = 4 << 20


class Table:
    """Frequencies of the symbols 0 .. V-1, scaled to a sum of 2^bits; every symbol that occurs keeps at least one slot."""

    def __init__(self, freq: np.ndarray, bits: int):
        if int(freq.sum()) != 1 << bits:
            raise ValueError("frequencies don't add up to the table's slots")
        self.bits = bits
        # One more symbol fills all slots: coding it leaves a state as it is.  It pads short blocks.
        self.freq = np.append(freq, 1 << bits).astype(np.uint64)
        self.start = np.append(np.cumsum(freq) - freq, 0).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """The symbol of each slot."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq) - 1, dtype=np.uint32), self.freq[:-1].astype(np.int64))
        return self._slots

    def to_bytes(self) -> bytes:
        return np.array([self.bits], "<u4").tobytes() + self.freq[:-1].astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Table":
        found = np.frombuffer(data, "<u4")
        return cls(found[1:].astype(np.int64), int(found[0]))


def scaled_table(counts: np.ndarray) -> Table:
    """The table of exact counts: at least 16 slots for each symbol in use, 2^14 to 2^24 in all."""
    used = np.flatnonzero(counts)
    bits = min(max(14, int(len(used)).bit_length() + 4), 24)
    freq = np.zeros(len(counts), np.int64)
    if not len(used):
        freq[0] = 1 << bits
        return Table(freq, bits)
    if len(used) > 1 << bits:
        raise ValueError("more symbols than slots")
    freq[used] = np.maximum(1, np.floor(counts[used] / counts.sum() * (1 << bits))).astype(np.int64)
    over = int(freq.sum()) - (1 << bits)
    order = used[np.argsort(-freq[used], kind="stable")]
    if over <= 0:
        freq[order[0]] -= over
    for symbol in order:
        if over <= 0:
            break
        taken = min(over, int(freq[symbol]) - 1)
        freq[symbol] -= taken
        over -= taken
    return Table(freq, bits)


def _groups(sizes: np.ndarray):
    """Index runs of the blocks by falling size, each of bounded padded size."""
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        width = -(-int(max(sizes[order[at]], 1)) // LANES) * LANES
        count = max(1, TOGETHER // width)
        yield order[at : at + count], width
        at += count


def encode(blocks: list[np.ndarray], table: Table) -> list[bytes]:
    """The payload of each block of symbols; a symbol must have a slot."""
    out: list[bytes] = [b""] * len(blocks)
    sizes = np.array([len(b) for b in blocks], np.int64)
    bits, room, pad = np.uint64(table.bits), np.uint64(63 - table.bits), len(table.freq) - 1
    for of, width in _groups(sizes):
        symbols = np.full((len(of), width), pad, np.int64)
        for row, b in enumerate(of):
            symbols[row, : sizes[b]] = blocks[b]
        steps = -(-sizes[of] // LANES)
        live = np.searchsorted(-steps, -np.arange(width // LANES), "left")  # blocks with more than t steps come first
        symbols = np.ascontiguousarray(symbols.reshape(len(of), -1, LANES).swapaxes(0, 1))  # a step's symbols side by side
        f_of, start_of = table.freq[symbols], table.start[symbols]
        if not f_of.all():
            raise ValueError("a symbol without a slot")
        state = np.full((len(of), LANES), LOW, np.uint64)
        words, place = np.zeros((len(of), width), np.uint32), np.full(len(of), width, np.int64)
        for t in range(width // LANES - 1, -1, -1):
            n = live[t]
            x, f = state[:n], f_of[t, :n]
            full = x >= (f << room)
            flat = np.flatnonzero(full)
            if len(flat):
                rank = np.cumsum(full, axis=1)
                place[:n] -= rank[:, -1]
                rows, given = flat // LANES, x.reshape(-1)[flat]
                words[rows, place[rows] + rank.reshape(-1)[flat] - 1] = given.astype(np.uint32)  # the low half
                x.reshape(-1)[flat] = given >> WORD
            q = x // f
            state[:n] = x + q * ((np.uint64(1) << bits) - f) + start_of[t, :n]
        states = state.astype("<u8")
        for row, b in enumerate(of):
            out[b] = states[row].tobytes() + words[row, place[row] :].astype("<u4").tobytes()
    return out


def decode(payloads: list[bytes], sizes: np.ndarray, table: Table) -> list[np.ndarray]:
    """The symbols of each block of the given sizes; a payload that doesn't fit its size is an error."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(payloads)
    sizes = np.asarray(sizes, np.int64)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    head = 8 * LANES
    for of, width in _groups(sizes):
        state = np.stack([np.frombuffer(payloads[b][:head], "<u8") for b in of]).astype(np.uint64)
        lengths = np.array([(len(payloads[b]) - head) // 4 for b in of], np.int64)
        words = np.concatenate([np.frombuffer(payloads[b], "<u4", offset=head) for b in of] + [np.zeros(1, np.uint32)])
        ends = np.cumsum(lengths)
        place, steps, own = ends - lengths, -(-sizes[of] // LANES), sizes[of]
        live = np.searchsorted(-steps, -np.arange(width // LANES + 1), "left")
        symbols = np.zeros((width // LANES, len(of), LANES), np.uint32)
        for t in range(width // LANES):
            n, whole = live[t], live[t + 1]
            x = state[:n]
            slot = x & mask
            s = symbols[t, :n] = table.slots[slot.view(np.int64)]
            x = table.freq[s] * (x >> bits) + slot - table.start[s]
            if whole < n:  # the last step of some blocks: lanes beyond their end stay
                x[whole:] = np.where(t * LANES + np.arange(LANES) < own[whole:n, None], x[whole:], state[whole:n])
            short = x < LOW
            flat = np.flatnonzero(short)
            if len(flat):
                rank = np.cumsum(short, axis=1)
                at = place[flat // LANES] + rank.reshape(-1)[flat] - 1
                x.reshape(-1)[flat] = (x.reshape(-1)[flat] << WORD) | words[np.minimum(at, len(words) - 1)].astype(np.uint64)
                place[:n] += rank[:, -1]
            state[:n] = x
        symbols = symbols.swapaxes(0, 1).reshape(len(of), width)
        if (state != LOW).any() or (place != ends).any():
            raise ValueError("a block that doesn't end as it began: the payload is damaged")
        for row, b in enumerate(of):
            out[b] = symbols[row, : sizes[b]]
    return out
