"""Features of audio by a table of parameters: spectra, filter banks, cepstra by cosine transform or linear prediction, deltas.

A chain takes one channel's samples through dither, preemphasis, windows, removal
of the mean, Hamming, spectrum, mel filters and what the target kind asks for.
Each file is one row and is worked on by whole-array operations in one task.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dsp import dct_rows, hamming, mel_filters

#: Names and defaults of the configuration variables, as the format's public manual lists them.
DEFAULTS = {
    "ACCWINDOW": 2, "ADDDITHER": 0.0, "AUDIOSIG": 0, "BYTEORDER": None, "CEPLIFTER": 22, "CMEANDIR": None, "CMEANMASK": None, "CMEANPATHMASK": None, "COMPRESSFACT": 0.33,
    "DELTAWINDOW": 2, "DOUBLEFFT": False, "ENORMALISE": True, "ESCALE": 0.1, "HEADERSIZE": None, "HIFREQ": -1.0, "LINEIN": True, "LINEOUT": True, "LOFREQ": -1.0, "LPCORDER": 12,
    "MATTRANFN": None, "MEASURESIL": True, "MICIN": False, "NATURALREADORDER": False, "NATURALWRITEORDER": False, "NSAMPLES": None, "NUMCEPS": 12, "NUMCHANS": 20, "OUTSILWARN": True,
    "PHONESOUT": True, "PREEMCOEF": 0.97, "RAWENERGY": True, "SAVECOMPRESSED": False, "SAVEWITHCRC": True, "SILENERGY": 0.0, "SILFLOOR": 50.0, "SILGLCHCOUNT": 2, "SILMARGIN": 40,
    "SILSEQCOUNT": 100, "SIMPLEDIFFS": False, "SOURCEFORMAT": None, "SOURCEKIND": None, "SOURCERATE": 0.0, "SPCGLCHCOUNT": 0, "SPCSEQCOUNT": 10, "SPEAKEROUT": False, "SPEECHTHRESH": 9.0,
    "STEREOMODE": None, "TARGETFORMAT": None, "TARGETKIND": None, "TARGETRATE": 0.0, "TRACE": 0, "USEHAMMING": True, "USEPOWER": False, "USESILDET": False, "V1COMPAT": False,
    "VARSCALEDIR": None, "VARSCALEFN": None, "VARSCALEMASK": None, "VARSCALEPATHMASK": None, "VQTABLE": None, "WARPFREQ": 1.0, "WARPLCUTOFF": None, "WINDOWSIZE": 256000.0, "ZMEANSOURCE": False,
}
#: Variables that the chain acts on; the others must keep their defaults.
USED = {"ACCWINDOW", "ADDDITHER", "CEPLIFTER", "COMPRESSFACT", "DELTAWINDOW", "DOUBLEFFT", "ENORMALISE", "ESCALE", "HIFREQ", "LOFREQ", "LPCORDER", "NUMCEPS", "NUMCHANS", "PREEMCOEF", "RAWENERGY", "SAVEWITHCRC", "SIMPLEDIFFS", "SOURCEFORMAT", "SOURCEKIND", "SOURCERATE", "STEREOMODE", "TARGETKIND", "TARGETRATE", "USEHAMMING", "USEPOWER", "WINDOWSIZE", "ZMEANSOURCE"}
MANDATORY = {"ENORMALISE": False, "SOURCEKIND": "WAVEFORM", "SAVEWITHCRC": False}
KINDS, QUALIFIERS = {"MFCC", "PLP", "FBANK", "MELSPEC"}, {"0", "E", "D", "A", "Z"}


def parse_specs(text: str, comment: str = "#") -> dict:
    """``NAME = value`` or ``NAME value`` lines; none, true and false words and numbers are taken as such."""
    out: dict = {}
    for line in text.splitlines():
        parts = line.split()
        if not parts or parts[0].startswith(comment):
            continue
        if len(parts) > 1 and parts[1] == "=":
            del parts[1]
        if len(parts) != 2:
            raise ValueError(f"not a name and a value: {line.strip()!r}")
        name, value = parts
        words = {"none": None, "null": None, "true": True, "t": True, "false": False, "f": False}
        if value.lower() in words:
            out[name] = words[value.lower()]
        elif value[0].isdigit() or value[0] in "+-." and value[1:2].isdigit():
            out[name] = float(value) if any(c in value.lower() for c in ".e") else int(value)
        else:
            out[name] = value
    return out


def extraction_specs(kind: str, coefficients: int, period: float = 0.01, window: float = 0.025) -> dict:
    """The specs for ``coefficients`` values a frame of a kind such as ``PLP_0_D_A``: statics are their share, less one for C0."""
    parts = kind.split("_")[1:]
    ceps = coefficients // (3 if "A" in parts and "D" in parts else 2 if "D" in parts else 1) - ("0" in parts)
    return {**MANDATORY, "TARGETKIND": kind, "TARGETRATE": int(1e7 * period), "WINDOWSIZE": int(1e7 * window), "USEHAMMING": True, "PREEMCOEF": 0.97, "NUMCHANS": 32, "CEPLIFTER": 22, "NUMCEPS": ceps, "USEPOWER": False, "LPCORDER": 12, "SOURCEFORMAT": "WAVE"}


def plp_specs() -> dict:
    """Twelve linear-prediction cepstra and C0 from 24 channels of the power spectrum."""
    return {**MANDATORY, "TARGETKIND": "PLP_0", "TARGETRATE": 100000, "WINDOWSIZE": 250000, "USEHAMMING": True, "PREEMCOEF": 0.97, "NUMCHANS": 24, "CEPLIFTER": 22, "NUMCEPS": 12, "USEPOWER": True, "LPCORDER": 12, "SOURCEFORMAT": "WAVE"}


def checked_specs(specs: dict) -> dict:
    """``specs`` over the defaults; unknown names, values that the chain does not act on and missing mandatory ones raise."""
    if unknown := sorted(set(specs) - set(DEFAULTS)):
        raise ValueError(f"unexpected configuration parameters: {' '.join(unknown)}")
    if idle := sorted(k for k in set(specs) - USED if specs[k] != DEFAULTS[k]):
        raise ValueError(f"parameters that must keep their defaults: {' '.join(idle)}")
    for k, v in MANDATORY.items():
        if k not in specs or specs[k] != v:
            raise ValueError(f"{k} must be given as {v}")
    out = {**DEFAULTS, **specs}
    if not out["TARGETKIND"]:
        raise ValueError("TARGETKIND must be given")
    base, *parts = out["TARGETKIND"].split("_")
    if bad := [*({base} - KINDS), *sorted(set(parts) - QUALIFIERS)]:
        raise ValueError(f"unexpected target kinds: {' '.join(bad)}")
    if "A" in parts and "D" not in parts:
        raise ValueError("accelerations need deltas")
    return out


def deltas(x, window: int, simple: bool = False):
    """Regression over ``window`` frames to both sides, ends replicated; simple: the difference over 2 * window frames."""
    import numpy as np

    n = len(x)
    at = lambda k: x[np.clip(np.arange(n) + k, 0, n - 1)]
    if simple:
        return (at(window) - at(-window)) / (2 * window)
    return sum(k * (at(k) - at(-k)) for k in range(1, window + 1)) / (2 * sum(k * k for k in range(1, window + 1)))


def linear_prediction(r, order: int):
    """(coefficients, gain) by Levinson's and Durbin's recursion on rows of autocorrelations: x[t] is predicted as -sum a[k] x[t-k]."""
    import numpy as np

    a, gain = np.zeros((len(r), order + 1)), r[:, 0].copy()
    a[:, 0] = 1
    for i in range(1, order + 1):
        k = -(a[:, :i] * r[:, i:0:-1]).sum(axis=1) / np.maximum(gain, 1e-300)
        a[:, 1 : i + 1] = a[:, 1 : i + 1] + k[:, None] * a[:, i - 1 :: -1][:, :i] if i > 1 else k[:, None]
        gain = gain * (1 - k * k)
    return a[:, 1:], gain


class Chain:
    """Features of one channel's samples at ``rate`` per second."""

    def __init__(self, specs: dict, rate: float):
        import numpy as np

        self.s = s = checked_specs(specs)
        self.base, *self.parts = s["TARGETKIND"].split("_")
        tick = round(1e9 / rate)  # nanoseconds, to which times are rounded
        self.slide, self.window = max(1, round(100 * s["TARGETRATE"] / tick)), max(1, round(100 * s["WINDOWSIZE"] / tick))
        self.n_fft = 1 << max(1, (self.window - 1).bit_length()) + bool(s["DOUBLEFFT"])
        low, high = max(0.0, s["LOFREQ"]), s["HIFREQ"] if s["HIFREQ"] > 0 else rate / 2
        self.bank = np.array(mel_filters(s["NUMCHANS"], self.n_fft // 2 + 1, rate, low, high))
        n, lift = s["NUMCEPS"], s["CEPLIFTER"]
        self.dct, self.zero = np.array(dct_rows(s["NUMCHANS"], n, 1)), np.array(dct_rows(s["NUMCHANS"], 1, 0))
        self.lift = np.array([1 + lift / 2 * math.sin(math.pi * (i + 1) / lift) if lift else 1.0 for i in range(n)])
        mel = lambda f: 1127 * np.log1p(f / 700)
        centre = 700 * np.expm1((mel(low) + (mel(high) - mel(low)) * np.arange(1, s["NUMCHANS"] + 1) / (s["NUMCHANS"] + 1)) / 1127)
        sq = centre**2
        self.loudness = (sq / (sq + 1.6e5)) ** 2 * (sq + 1.44e6) / (sq + 9.61e6)

    def statics(self, samples, seed: int = 0):
        import numpy as np

        s, x = self.s, np.asarray(samples, float)
        if s["ADDDITHER"]:
            x = x + np.random.default_rng(seed).uniform(-s["ADDDITHER"], s["ADDDITHER"], len(x))
        n = 1 + (len(x) - self.window) // self.slide if len(x) >= self.window else 0
        cut = lambda v: np.lib.stride_tricks.sliding_window_view(v, self.window)[:: self.slide][:n] if n else np.zeros((0, self.window))
        raw = cut(x)
        if s["PREEMCOEF"] and len(x) > 1:
            y = x[1:] - s["PREEMCOEF"] * x[:-1]
            x = np.concatenate([y[:1], y])
        frames = cut(x)
        if s["ZMEANSOURCE"]:
            frames = frames - frames.mean(axis=1, keepdims=True)
        energy = np.log(np.maximum(((raw if s["RAWENERGY"] else frames) ** 2).sum(axis=1), 1e-10))
        if s["USEHAMMING"]:
            frames = frames * np.array(hamming(self.window))
        spectrum = np.abs(np.fft.rfft(frames, self.n_fft, axis=1))
        mel = (spectrum**2 if s["USEPOWER"] or self.base == "PLP" else spectrum) @ self.bank.T
        if self.base in ("MELSPEC", "FBANK"):
            out, zero = mel if self.base == "MELSPEC" else np.log(np.maximum(mel, 1e-10)), None
        elif self.base == "MFCC":
            logs = np.log(np.maximum(mel, 1e-10))
            out, zero = (logs @ self.dct.T) * self.lift, (logs @ self.zero.T)[:, 0]
        else:
            out, zero = self._predicted(mel)
        if "Z" in self.parts:
            out = out - out.mean(axis=0)
        extra = ([zero] if "0" in self.parts and zero is not None else []) + ([energy] if "E" in self.parts else [])
        return np.column_stack([out, *extra]) if extra else out

    def _predicted(self, mel):
        """(cepstra, C0) of an all-pole model of the loudness spectrum."""
        import numpy as np

        s = self.s
        heard = (np.maximum(mel, 1e-10) * self.loudness) ** s["COMPRESSFACT"]
        heard = np.concatenate([heard[:, :1], heard, heard[:, -1:]], axis=1)  # the edges twice
        m = heard.shape[1] - 1
        angle = np.cos(np.pi * np.outer(np.arange(s["LPCORDER"] + 1), np.arange(m + 1)) / m)
        weight = np.full(m + 1, 2.0)
        weight[[0, -1]] = 1
        a, gain = linear_prediction(heard @ (angle * weight).T / (2 * m), s["LPCORDER"])
        n, p = s["NUMCEPS"], s["LPCORDER"]
        c = np.zeros((len(a), n))
        for i in range(1, n + 1):
            total = a[:, i - 1].copy() if i <= p else np.zeros(len(a))
            for k in range(max(1, i - p), i):
                total += k / i * c[:, k - 1] * a[:, i - k - 1]
            c[:, i - 1] = -total
        return c * self.lift, np.log(np.maximum(gain, 1e-10))

    def features(self, samples, seed: int = 0):
        import numpy as np

        x = self.statics(samples, seed)
        out = [x]
        if "D" in self.parts and len(x):
            out.append(deltas(x, self.s["DELTAWINDOW"], self.s["SIMPLEDIFFS"]))
            if "A" in self.parts:
                out.append(deltas(out[1], self.s["ACCWINDOW"], self.s["SIMPLEDIFFS"]))
        return np.concatenate(out, axis=1)


def extract(audio: DataFrame, specs: dict, name: str = "path") -> DataFrame:
    """(name, frame, features) of audio rows (name, rate, channel, samples): the left or only channel, or that of STEREOMODE.

    Dither is drawn by a seed from the name, so a repeated task gives the same frames.
    """
    mode = checked_specs(specs)["STEREOMODE"]
    channel = 1 if str(mode).upper() == "RIGHT" else 0
    kind = dict(audio.dtypes)[name]

    def work(batches):
        import pyarrow as pa

        chains: dict = {}
        for batch in batches:
            for who, rate, samples in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2)):
                rate = 1e7 / specs["SOURCERATE"] if specs.get("SOURCERATE") else rate
                if rate not in chains:
                    chains[rate] = Chain(specs, rate)
                x = chains[rate].features(samples.values.to_numpy(zero_copy_only=False) if samples.is_valid else [], zlib.crc32(str(who).encode()))
                for lo in range(0, len(x), 4096):
                    part = x[lo : lo + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([who] * len(part)), pa.array(range(lo + 1, lo + len(part) + 1), pa.int32()), pa.array(list(part), pa.list_(pa.float64()))], names=[name, "frame", "features"])

    return audio.where(F.col("channel") == channel).select(name, "rate", "samples").mapInArrow(work, f"{name} {kind}, frame int, features array<double>")
