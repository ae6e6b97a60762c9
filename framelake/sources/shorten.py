"""Decoding of shorten streams (versions 1 and 2), as they stand behind the header of compressed NIST files.

A stream is bits: Rice codes of a unary part, a one and some low bits. A block's
residuals follow each other at places that only their own lengths tell; places
are found for all of a block at once by doubling jumps over an array of where each
code would end, and values are read by array arithmetic. The polynomial
predictors are repeated sums; only linear prediction goes sample by sample.
"""

from __future__ import annotations

#: Commands and field widths of the format (fixed values).
DIFF0, DIFF1, DIFF2, DIFF3, QUIT, BLOCKSIZE, BITSHIFT, QLPC, ZERO, VERBATIM = range(10)
COMMAND_BITS, SIZE_BITS, ENERGY_BITS, SHIFT_BITS, ORDER_BITS, COEFFICIENT_BITS, LENGTH_BITS, BYTE_BITS, SKIP_BITS = 2, 2, 3, 2, 2, 5, 5, 8, 7
#: Offsets that a channel's mean begins with, by the type of the file: signed and mu-law 0, unsigned 8 and 16 bits half of their range.
START = {2: 0x80, 4: 0x8000, 6: 0x8000}
MAGIC = b"ajkg"


class _Bits:
    def __init__(self, data: bytes):
        import numpy as np

        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        ones = np.flatnonzero(self.bits)
        # of each place the next one at or behind it; past the last there is none
        self.one = np.full(len(self.bits) + 1, len(self.bits), np.int64)
        if len(ones):
            at = np.searchsorted(ones, np.arange(len(self.bits)))
            self.one[:-1] = np.where(at < len(ones), ones[np.minimum(at, len(ones) - 1)], len(self.bits))
        self.at = 0

    def number(self, low: int) -> int:
        """One unsigned code with ``low`` low bits."""
        end = int(self.one[self.at])
        if end + low >= len(self.bits):
            raise ValueError("the stream ends early")
        value = end - self.at
        for b in self.bits[end + 1 : end + 1 + low].tolist():
            value = value << 1 | b
        self.at = end + 1 + low
        return value

    def signed(self, low: int) -> int:
        v = self.number(low + 1)
        return ~(v >> 1) if v & 1 else v >> 1

    def long(self) -> int:
        return self.number(self.number(SIZE_BITS))

    def block(self, count: int, low: int):
        """``count`` signed codes with ``low`` low bits and a sign."""
        import numpy as np

        low += 1
        size = count * (low + 4)
        while True:
            stop = min(self.at + size, len(self.bits))
            # where a code that begins at each place of the window ends; the window's end stands for all beyond
            ends = np.minimum(self.one[self.at : stop] + 1 + low, stop) - self.at
            jump, starts = np.append(ends, stop - self.at), np.zeros(1, np.int64)
            while len(starts) <= count:  # doubles: the places after n codes, then after 2 n
                starts = np.concatenate([starts, jump[starts]])
                jump = jump[jump]
            starts = starts[: count + 1]
            if starts[-2] < stop - self.at and starts[-1] <= stop - self.at and (starts[-1] < stop - self.at or int(self.one[self.at + starts[-2]]) + 1 + low <= stop):
                break
            if stop == len(self.bits):
                raise ValueError("the stream ends early")
            size *= 2
        first = self.at + starts[:-1]
        one = self.one[first]
        value = one - first
        for k in range(low):
            value = value << 1 | self.bits[one + 1 + k]
        self.at = int(one[-1]) + 1 + low
        return np.where(value & 1, ~(value >> 1), value >> 1)


def _quotient(a: int, b: int) -> int:
    """Integer division towards zero."""
    return abs(a) // b * (1 if a >= 0 else -1)


def unshorten(data: bytes) -> tuple[object, dict]:
    """(samples by channel as integers, header) of a stream."""
    import numpy as np

    if data[:4] != MAGIC:
        raise ValueError("not a shorten stream")
    version = data[4]
    if version not in (1, 2):
        raise ValueError(f"version {version} is not known")
    bits = _Bits(data[5:])
    kind, channels, size, order, means, skip = (bits.long() for _ in range(6))
    for _ in range(skip):
        bits.number(SKIP_BITS)
    shift, past = 0, max(3, order)
    before = [np.zeros(past, np.int64) for _ in range(channels)]
    mean = [[START.get(kind, 0)] * max(means, 1) for _ in range(channels)]
    out: list[list] = [[] for _ in range(channels)]
    channel = 0
    while (command := bits.number(COMMAND_BITS)) != QUIT:
        if command == BLOCKSIZE:
            size = bits.long()
            continue
        if command == BITSHIFT:
            shift = bits.number(SHIFT_BITS)
            continue
        if command == VERBATIM:
            for _ in range(bits.number(LENGTH_BITS)):
                bits.number(BYTE_BITS)
            continue
        if command > ZERO:
            raise ValueError(f"command {command} is not known")
        low = bits.number(ENERGY_BITS) if command != ZERO else 0
        if not means:
            offset = mean[channel][0]
        elif version < 2:
            offset = _quotient(sum(mean[channel]), means)
        else:
            total = _quotient(means // 2 + sum(mean[channel]), means)
            offset = total if not shift else (total >> (shift - 1)) >> 1
        last = before[channel]
        if command == ZERO:
            x = np.zeros(size, np.int64)
        elif command == QLPC:
            weights = [bits.signed(COEFFICIENT_BITS) for _ in range(bits.number(ORDER_BITS))]
            held = (last[past - len(weights) :] - offset).tolist() if weights else []
            base = (1 << COEFFICIENT_BITS) if version > 1 else 0
            for e in bits.block(size, low).tolist():
                held.append(e + (base + sum(w * held[-1 - j] for j, w in enumerate(weights)) >> COEFFICIENT_BITS))
            x = np.array(held[len(weights) :], np.int64) + offset
        else:
            x = bits.block(size, low)
            if command == DIFF0:
                x = x + offset
            # sums of sums, each begun by the difference of that order of the samples before
            for k in range(command, 0, -1):
                x = np.cumsum(x) + np.diff(last, n=k - 1)[-1]
        if means:
            total = int(x.sum()) + (0 if version < 2 else size // 2)
            mean[channel] = [*mean[channel][1:], _quotient(total, size) << (0 if version < 2 else shift)]
        before[channel] = np.concatenate([last, x])[-past:]
        out[channel].append(x << shift)
        channel = (channel + 1) % channels
    joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    n = min(map(len, joined))
    return np.stack([c[:n] for c in joined], axis=1), {"version": version, "kind": kind, "channels": channels}
