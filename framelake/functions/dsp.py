"""Signal and array functions as column expressions; constants are literal arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def matrix_times(rows: list[list[float]], x: Column) -> Column:
    """A constant matrix times an array."""
    return F.array(*(dot(doubles(r), x) for r in rows))


def hz_to_mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1.0 + hz / 700.0)


def mel_to_hz(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1.0)


def mel_breaks(n: int, low: float, high: float, rounded: bool = False) -> list[float]:
    """n + 2 points equally spaced in mel."""
    mel = lambda f: 2595.0 * math.log10(1.0 + f / 700.0)
    at = [mel(low) + (mel(high) - mel(low)) * k / (n + 1) for k in range(n + 2)]
    hz = [700.0 * (10.0 ** (m / 2595.0) - 1.0) for m in at]
    return [float(int(f + 0.5)) for f in hz] if rounded else hz


def mel_filters(n: int, bins: int, rate: float, low: float, high: float) -> list[list[float]]:
    """Triangular weights of n filters over the bins of half a spectrum, linear in mel."""
    mel = lambda f: 2595.0 * math.log10(1.0 + f / 700.0)
    edge = [mel(f) for f in mel_breaks(n, low, high)]
    out = []
    for k in range(n):
        a, b, c = edge[k : k + 3]
        m = [mel(i * rate / (2 * (bins - 1))) for i in range(bins)]
        out.append([max(0.0, min((v - a) / (b - a), (c - v) / (c - b))) for v in m])
    return out


def dct_rows(n_in: int, n_out: int, first: int = 0) -> list[list[float]]:
    """sqrt(2/n) cos(pi/n i (j + 1/2)); row 0 is not rescaled."""
    return [[math.sqrt(2.0 / n_in) * math.cos(math.pi / n_in * i * (j + 0.5)) for j in range(n_in)] for i in range(first, first + n_out)]


def lifter(x: Column, length: int) -> Column:
    """x_i (1 + L/2 sin(pi (i + 1) / L))."""
    return F.transform(x, lambda v, i: v * (1.0 + length / 2.0 * F.sin(math.pi * (i + 1) / length)))


def hamming(n: int) -> list[float]:
    return [0.54 - 0.46 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)] if n > 1 else [1.0]


def kaiser(n: int, beta: float) -> list[float]:
    import numpy as np

    return np.kaiser(n, beta).tolist()


def remove_dc(x: Column) -> Column:
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    return F.transform(x, lambda v: v - mean)


def normalise_l1(x: Column) -> Column:
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return F.transform(x, lambda v: v / total)


def power_of_two(x: Column) -> Column:
    """The least power of two not below x; 1 up to 1. By integers, so without rounding error."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.expr("1L").cast("long") * F.pow(F.lit(2.0), F.length(F.bin((F.ceil(x) - 1).cast("long")))).cast("long"))


def component_abs(x: Column) -> Column:
    return F.transform(x, F.abs)


def component_log(x: Column, floor: float = 0.0) -> Column:
    return F.transform(x, lambda v: F.ln(F.greatest(v, F.lit(floor)) if floor else v))


def band_level(x: Column, ref: float) -> Column:
    """10 log10(sum x^2 / ref) within 0..140; silence is 0."""
    power = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    return F.when(power <= 0, 0.0).otherwise(F.least(F.greatest(10.0 * F.log10(power / ref), F.lit(0.0)), F.lit(140.0)))


def log_sum_exp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.ln(F.aggregate(F.transform(x, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v))


def safe_log_divide(a: Column, b: Column) -> Column:
    """ln(a / b); 0 / 0 is the log of zero (-inf), anything else over 0 raises."""
    inf = F.lit(float("-inf"))
    return F.when((a == 0) & (b == 0), inf).when(b == 0, F.raise_error(F.lit("division by zero")).cast("double")).when(a == 0, inf).otherwise(F.ln(a / b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance_sq(a, b))


def distance_sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def factors(n: Column) -> Column:
    """All divisors of a positive integer, ascending."""
    small = F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt(n)).cast("long")), lambda k: F.try_mod(n, k) == 0)
    return F.array_sort(F.array_distinct(F.concat(small, F.transform(small, lambda k: F.floor(n / k).cast("long")))))


def is_prime(n: Column) -> Column:
    return (n > 1) & (F.size(factors(F.greatest(n, F.lit(1)))) == 2)


def prime_factors(n: Column) -> Column:
    """Prime divisors, ascending, without repeats."""
    return F.filter(factors(n), is_prime)


def cumulative_index(shares: Column, x: Column) -> Column:
    """The first index whose running sum exceeds x; -1 beyond the end."""
    sums = F.transform(shares, lambda v, i: F.aggregate(F.slice(shares, F.lit(1), i + 1), F.lit(0.0), lambda s, w: s + w))
    return (F.array_position(F.transform(sums, lambda v: v > x), True) - 1).cast("int")


def bit_fields(value: Column, widths: list[int]) -> Column:
    """An integer split into fields, the first from the highest bits."""
    out, left = [], sum(widths)
    for w in widths:
        left -= w
        out.append(F.shiftright(value, left).bitwiseAND(F.lit((1 << w) - 1).cast("long")))
    return F.array(*out)


def float_hex(value: Column) -> Column:
    """Exact text of doubles: 0x1.<13 hexadecimal digits>p<exponent>; inf and -inf; null for NaN."""
    v, sign = F.abs(value), F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    two = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    guess = F.greatest(F.floor(F.log2(v)), F.lit(-1022)).cast("int")  # one off at most, next to powers of two
    half = F.floor(guess / 2).cast("int")  # in two steps, as a power of 1074 is out of range
    scaled = v * two(-half) * two(half - guess)
    e = guess + F.when(scaled >= 2, 1).when((scaled < 1) & (guess > -1022), -1).otherwise(0)
    half = F.floor(e / 2).cast("int")
    m = v * two(-half) * two(half - e)
    whole = F.when(m >= 1, F.lit(1)).otherwise(F.lit(0))
    digits = F.lpad(F.lower(F.hex(((m - whole) * F.lit(2.0**52)).cast("long"))), 13, "0")
    text = F.concat(sign, F.lit("0x"), whole.cast("string"), F.lit("."), digits, F.lit("p"), F.when(e < 0, F.lit("")).otherwise(F.lit("+")), e.cast("string"))
    return F.when(F.isnan(value) | value.isNull(), F.lit(None)).when(v == float("inf"), F.concat(sign, F.lit("inf"))).when(v == 0, F.lit("0x0.0p+0")).otherwise(text)


def hex_float(text: Column) -> Column:
    """The double that ``float_hex`` wrote; null for other text."""
    pattern = r"^(-?)0x([01])\.([0-9a-f]+)p([+-]\d+)$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    e = F.expr("1") * F.when(part(4) == "", None).otherwise(part(4)).cast("int")
    half = F.floor(e / 2).cast("int")
    m = part(2).cast("double") + F.conv(F.rpad(part(3), 13, "0"), 16, 10).cast("double") / F.lit(2.0**52)
    value = m * F.pow(F.lit(2.0), half.cast("double")) * F.pow(F.lit(2.0), (e - half).cast("double"))
    value = F.when(part(1) == "-", -value).otherwise(value)
    return F.when(text.rlike(pattern), value).when(text.isin("inf", "-inf"), text.cast("double"))


def spectrum(n: int | None = None):
    """A UDF for the magnitude of half a spectrum, zero-padded to a power of two (or n)."""

    @F.pandas_udf("array<double>")
    def magnitude(signals):
        import numpy as np
        import pandas as pd

        sizes = signals.map(len)
        full = sizes.map(lambda k: n or 1 << max(0, (k - 1).bit_length()))
        out = pd.Series([None] * len(signals), index=signals.index, dtype=object)
        for k, size in set(zip(sizes, full)):  # signals of one length are one array
            mine = signals[(sizes == k) & (full == size)]
            rows = np.abs(np.fft.rfft(np.array(mine.tolist(), float).reshape(len(mine), -1), size, axis=1))
            out[mine.index] = pd.Series(list(rows), index=mine.index)
        return out

    return magnitude


def cepstra(rate: float, n_fft: int, channels: int = 24, n_ceps: int = 12, low: float = 0.0, high: float | None = None, lift: int = 22, alpha: float = 0.97, power: bool = False, with_zero: bool = False):
    """A UDF from an array of samples of one window to mel cepstra.

    Preemphasis within the window (its first sample by 1 - alpha), Hamming, spectrum, mel filters, log, DCT,
    lifter; with_zero appends C0.  ``compat`` shapes follow by slicing.
    """
    import numpy as np

    bank = np.array(mel_filters(channels, n_fft // 2 + 1, rate, low, high or rate / 2))
    rows = np.array(dct_rows(channels, n_ceps, 1))
    lift_w = np.array([1 + lift / 2 * math.sin(math.pi * (i + 1) / lift) if lift else 1.0 for i in range(n_ceps)])
    zero = np.array(dct_rows(channels, 1, 0))

    @F.pandas_udf("array<double>")
    def ceps(signals):
        import numpy as np
        import pandas as pd

        sizes = signals.map(len)
        out = pd.Series([None] * len(signals), index=signals.index, dtype=object)
        for k in set(sizes):  # signals of one length are one array
            mine = signals[sizes == k]
            x = np.array(mine.tolist(), float).reshape(len(mine), -1)
            x = np.concatenate([x[:, :1] * (1 - alpha), x[:, 1:] - alpha * x[:, :-1]], axis=1)
            mag = np.abs(np.fft.rfft(x * np.array(hamming(k)), n_fft, axis=1))
            logs = np.log(np.maximum((mag * mag if power else mag) @ bank.T, 1e-10))
            c = (logs @ rows.T) * lift_w
            out[mine.index] = pd.Series(list(np.concatenate([c, logs @ zero.T], axis=1) if with_zero else c), index=mine.index)
        return out

    return ceps
