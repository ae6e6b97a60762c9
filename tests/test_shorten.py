"""Shorten streams against an encoder that states the format the other way round."""

import random

import numpy as np
import pytest


class Writer:
    def __init__(self):
        self.bits = []

    def number(self, v, low):
        self.bits += [0] * (v >> low) + [1] + [v >> k & 1 for k in range(low - 1, -1, -1)]

    def signed(self, v, low):
        self.number(v * 2 if v >= 0 else ~v * 2 + 1, low + 1)

    def long(self, v):
        n = v.bit_length()
        self.number(n, 2)
        self.number(v, n)

    def bytes(self):
        return np.packbits(self.bits + [0] * (-len(self.bits) % 32)).tobytes()


def cut(a, b):
    return int(a / b)


def encode(x, r, version=2, kind=5, size=32, order=4, means=4, shift=0):
    """x: (samples, channels), a whole number of blocks but for the last, which is announced."""
    w, n, channels = Writer(), len(x), x.shape[1]
    for v in (kind, channels, size, order, means, 2):
        w.long(v)
    for v in (3, 5):
        w.number(v, 7)
    past = [[0] * max(3, order) for _ in range(channels)]
    mean = [[{2: 0x80, 4: 0x8000, 6: 0x8000}.get(kind, 0)] * max(means, 1) for _ in range(channels)]
    w.number(9, 2)
    w.number(2, 5)
    w.number(77, 8)
    w.number(200, 8)
    if shift:
        w.number(6, 2)
        w.number(shift, 2)
    for lo in range(0, n, size):
        some = x[lo : lo + size]
        if len(some) < size:
            w.number(5, 2)
            w.long(len(some))
        for c in range(channels):
            block, last = [int(v) >> shift for v in some[:, c]], past[c]
            total = sum(mean[c]) + (means // 2 if version > 1 else 0)
            offset = mean[c][0] if not means else cut(total, means)
            if means and version > 1 and shift:
                offset = (offset >> (shift - 1)) >> 1
            command = 8 if not any(block) else r.choice([0, 1, 2, 3, 7])
            w.number(command, 2)
            if command != 8:
                low = r.randrange(0, 9)
                w.number(low, 3)
                held = last + block
                at = len(last)
                if command == 7:
                    k = r.randrange(0, order + 1)
                    weights = [r.randrange(-20, 30) for _ in range(k)]
                    w.number(k, 2)
                    for v in weights:
                        w.signed(v, 5)
                for i in range(len(block)):
                    y = held[at + i]
                    if command == 0:
                        e = y - offset
                    elif command == 1:
                        e = y - held[at + i - 1]
                    elif command == 2:
                        e = y - 2 * held[at + i - 1] + held[at + i - 2]
                    elif command == 3:
                        e = y - 3 * held[at + i - 1] + 3 * held[at + i - 2] - held[at + i - 3]
                    else:
                        e = y - offset - (((32 if version > 1 else 0) + sum(v * (held[at + i - 1 - j] - offset) for j, v in enumerate(weights))) >> 5)
                    w.signed(e, low)
            if means:
                total = cut(sum(block) + (len(block) // 2 if version > 1 else 0), len(block))
                mean[c] = [*mean[c][1:], total << (shift if version > 1 else 0)]
            past[c] = (last + block)[-len(last) :]
    w.number(4, 2)
    return b"ajkg" + bytes([version]) + w.bytes()


@pytest.mark.parametrize("seed", range(12))
def test_streams_are_read_back(seed):
    from framelake.sources.shorten import unshorten

    r, g = random.Random(seed), np.random.default_rng(seed)
    channels, shift, kind = r.choice([1, 2]), r.choice([0, 0, 3]), r.choice([5, 3, 2, 4])
    n = r.choice([1, 31, 32, 200, 333])
    x = np.cumsum(g.integers(-60, 60, (n, channels)), axis=0) + {2: 128, 4: 32768}.get(kind, 0)
    x = (x >> shift) << shift
    x[40:80] = 0
    found, head = unshorten(encode(x, r, version=r.choice([1, 2]), kind=kind, order=r.choice([0, 2, 8]), means=r.choice([0, 1, 4]), shift=shift))
    assert (found == x).all() and head["kind"] == kind and head["channels"] == channels


def test_long_codes_and_broken_streams():
    from framelake.sources.shorten import unshorten

    r = random.Random(1)
    x = np.array([[0], [30000], [-30000], [5]] * 16)  # unary parts of many thousand bits
    data = encode(x, r, size=64)
    assert (unshorten(data)[0] == x).all()
    with pytest.raises(ValueError, match="ends early"):
        unshorten(data[: len(data) // 2])
    with pytest.raises(ValueError, match="version 3"):
        unshorten(b"ajkg\x03" + data[5:])
    with pytest.raises(ValueError, match="not a shorten"):
        unshorten(b"RIFF" + data[4:])


def sphere(data, coding, count, channels=1):
    fields = f"NIST_1A\n   1024\nsample_count -i {count}\nsample_n_bytes -i 2\nchannel_count -i {channels}\nsample_byte_format -s2 01\nsample_rate -i 20000\nsample_coding -s{len(coding)} {coding}\nend_head\n"
    return fields.encode().ljust(1024, b" ") + data


def test_compressed_files(spark, tmp_path):
    from framelake.sources.feature_files import parse_sphere, read_sphere

    r, g = random.Random(3), np.random.default_rng(3)
    for k in range(3):
        x = np.cumsum(g.integers(-200, 200, (500, 2)), axis=0)
        (tmp_path / f"{k}.sph").write_bytes(sphere(encode(x, r), "pcm,embedded-shorten-v2.00", 490, 2))
        (tmp_path / f"{k}.raw").write_bytes(x.astype("<i2").tobytes())
    rows = read_sphere(spark, f"file://{tmp_path}/*.sph").collect()
    assert len(rows) == 6
    for row in rows:
        want = np.frombuffer((tmp_path / row["path"].rsplit("/", 1)[1].replace("sph", "raw")).read_bytes(), "<i2").reshape(-1, 2)[:490, row["channel"]]
        assert np.array_equal(np.round(np.array(row["samples"]) * 32768), want) and row["rate"] == 20000
    x = np.arange(64)[:, None]
    with pytest.raises(ValueError, match="64 of 900"):
        parse_sphere(sphere(encode(x, r), "pcm,embedded-shorten-v2.00", 900))
    with pytest.raises(ValueError, match="channels"):
        parse_sphere(sphere(encode(x, r), "pcm,embedded-shorten-v2.00", 64, 2))
    with pytest.raises(ValueError, match="kind 7"):
        parse_sphere(sphere(encode(x, r, kind=7), "pcm,embedded-shorten-v2.00", 64))
    with pytest.raises(ValueError, match="coded as"):
        parse_sphere(sphere(b"", "pcm,embedded-wavpack", 0))
