"""Binary feature files: a 12-byte header (samples, period in 100 ns, bytes a sample, kind), then vectors.

Big-endian 4-byte floats, or 2-byte integers with scale and offset a dimension when
compressed.  Kind: the low six bits name the base kind, the others are qualifiers.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the format's base kinds and qualifier bits (octal)
BASE_KINDS = ("WAVEFORM", "LPC", "LPREFC", "LPCEPSTRA", "LPDELCEP", "IREFC", "MFCC", "FBANK", "MELSPEC", "USER", "DISCRETE", "PLP")
QUALIFIERS = {"E": 0o100, "N": 0o200, "D": 0o400, "A": 0o1000, "C": 0o2000, "Z": 0o4000, "K": 0o10000, "0": 0o20000, "V": 0o40000, "T": 0o100000}
FRAMES = "utt string, frame int, period_100ns long, kind int, features array<float>"


def kind_code(name: str) -> int:
    """MFCC_D_A_0 and the like as a number."""
    base, *quals = name.split("_")
    return BASE_KINDS.index(base) | sum(QUALIFIERS[q] for q in quals)


def kind_name(code: int) -> str:
    return "_".join([BASE_KINDS[code & 0o77], *(q for q, bit in QUALIFIERS.items() if code & bit)])


def decode(data: bytes):
    """(vectors, period, kind). Either byte order, the one whose header fits the length; checksums are left off."""
    import numpy as np

    for order in "><":
        n, period, size, kind = struct.unpack(f"{order}IIHH", data[:12])
        kind &= 0xFFFF
        packed, crc = bool(kind & QUALIFIERS["C"]), 2 if kind & QUALIFIERS["K"] else 0
        base = kind & 0o77
        if base < len(BASE_KINDS) and size and 12 + n * size + crc == len(data):
            break
    else:
        raise ValueError("not a feature file")
    body = data[12 : len(data) - crc]
    if base == BASE_KINDS.index("IREFC"):
        return np.frombuffer(body, f"{order}i2").reshape(n, -1) / 32767.0, period, kind
    if packed:
        d = size // 2
        scale, offset = (np.frombuffer(body, f"{order}f4", d, 4 * d * k) for k in (0, 1))
        values = np.frombuffer(body, f"{order}i2", offset=8 * d).reshape(-1, d)  # the header counts four samples for the scales
        return (values + offset) / scale, period, kind & ~QUALIFIERS["C"]
    kind_of = f"{order}i2" if base in (0, BASE_KINDS.index("DISCRETE")) else f"{order}f4"
    return np.frombuffer(body, kind_of).reshape(n, -1), period, kind


def encode(vectors, period: int, kind: int) -> bytes:
    """An uncompressed big-endian file."""
    import numpy as np

    m = np.asarray(vectors, ">f4")
    m = m.reshape(len(m), -1)
    return struct.pack(">IIHH", len(m), period, 4 * m.shape[1], kind & ~QUALIFIERS["C"] & ~QUALIFIERS["K"] & 0xFFFF) + m.tobytes()


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row a frame of all files under ``path``; a file is one task's at most."""
    return decoded_files(spark.read.format("binaryFile").load(path).select("path", "content"))


def decoded_files(files: DataFrame) -> DataFrame:
    """The frames of files given as (path, content)."""

    def work(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                m, period, kind = decode(content)
                utt = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pd.DataFrame({"utt": utt, "frame": range(1, len(m) + 1), "period_100ns": period, "kind": kind, "features": [r.astype("float32") for r in m]})

    return files.mapInPandas(work, FRAMES)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Header fields only, by bytes and number functions."""
    h = lambda a, n: F.conv(F.hex(F.substring("content", a, n)), 16, 10).cast("long")
    return spark.read.format("binaryFile").load(path).select("path", h(1, 4).alias("samples"), h(5, 4).alias("period_100ns"), h(9, 2).alias("sample_bytes"), h(11, 2).cast("int").alias("kind"))


def encoded_files(frames: DataFrame, utt: str = "utt", frame: str = "frame", x: str = "features", period: int = 100000, kind: int = 9) -> DataFrame:
    """(utt, content): the bytes of each utterance's file; ``write_features`` stores them."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(frame)
        return pd.DataFrame({"utt": [pdf[utt].iloc[0]], "content": [encode(pdf[x].tolist(), period, kind)]})

    return frames.select(utt, frame, x).groupBy(utt).applyInPandas(run, "utt string, content binary")


def write_features(files: DataFrame, folder: str, suffix: str = ".fea") -> DataFrame:
    """Store (utt, content) as files in a folder that all nodes mount; returns (utt, bytes)."""

    def work(batches):
        import os

        import pandas as pd

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            for u, c in zip(pdf["utt"], pdf["content"]):
                part = os.path.join(folder, f".{u}{suffix}.part")
                with open(part, "wb") as f:
                    f.write(c)
                os.replace(part, os.path.join(folder, f"{u}{suffix}"))
            yield pd.DataFrame({"utt": pdf["utt"], "bytes": pdf["content"].map(len)})

    return files.mapInPandas(work, "utt string, bytes long")


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """PCM WAV files: path, rate, channel, samples (a float array a channel, full scale 1)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches):
        import io
        import wave

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with wave.open(io.BytesIO(content)) as w:
                    n, c, b = w.getnframes(), w.getnchannels(), w.getsampwidth()
                    raw = w.readframes(n)
                if b == 3:
                    x = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                    x = ((x[:, 0] << 8 | x[:, 1] << 16 | x[:, 2] << 24) >> 8) / 2.0**23
                else:
                    x = (np.frombuffer(raw, "u1").astype(float) - 128) / 128 if b == 1 else np.frombuffer(raw, f"<i{b}") / 2.0 ** (8 * b - 1)
                x = x.reshape(-1, c)
                yield pd.DataFrame({"path": name, "rate": w.getframerate(), "channel": range(c), "samples": [x[:, k].astype("float32") for k in range(c)]})

    return files.mapInPandas(work, "path string, rate int, channel int, samples array<float>")


def parse_sphere(content: bytes) -> tuple[dict, object]:
    """(header, samples by channel) of a NIST file of linear or mu-law samples, or linear ones in a shorten stream; others raise. Full scale is 1."""
    import numpy as np

    from .shorten import START, unshorten

    if content[:7] != b"NIST_1A":
        raise ValueError("not a NIST file")
    size, head = int(content[8:16].split()[0]), {}
    for line in content[16:size].decode("latin-1").split("\n"):
        parts = line.split(None, 2)
        if parts[:1] == ["end_head"]:
            break
        if len(parts) == 3 and parts[1][:2] in ("-i", "-r", "-s"):
            head[parts[0]] = int(parts[2]) if parts[1] == "-i" else float(parts[2]) if parts[1] == "-r" else parts[2][: int(parts[1][2:])]
    coding, width, channels = head.get("sample_coding", "pcm"), head.get("sample_n_bytes", 2), head.get("channel_count", 1)
    if coding == "pcm":
        order = ">" if head.get("sample_byte_format", "01") == "10" else "<"
        x = np.frombuffer(content, f"{order}i{width}", (len(content) - size) // width, size) / 2.0 ** (8 * width - 1)
    elif coding in ("ulaw", "mu-law"):
        u = ~np.frombuffer(content, np.uint8, len(content) - size, size)
        level = (((u & 15).astype(int) << 3) + 132 << ((u >> 4) & 7)) - 132
        x = np.where(u & 128, -level, level) / 32768.0
    elif coding.startswith("pcm,embedded-shorten-v"):
        x, found = unshorten(content[size:])
        if not 1 <= found["kind"] <= 6 or found["channels"] != channels:
            raise ValueError(f"a stream of kind {found['kind']} and {found['channels']} channels")
        if len(x) < head.get("sample_count", 0):
            raise ValueError(f"{len(x)} of {head['sample_count']} samples")
        x = ((x - START.get(found["kind"], 0)) / 2.0 ** (8 * width - 1)).ravel()
    else:
        raise ValueError(f"samples are coded as {coding}")
    x = x[: len(x) // channels * channels].reshape(-1, channels)
    return head, x[: head.get("sample_count", len(x))]


def read_sphere(spark: SparkSession, path: str, start: float = 0.0, stop: float | None = None) -> DataFrame:
    """NIST files: path, rate, channel, samples, from ``start`` to ``stop`` seconds."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def work(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                head, x = parse_sphere(content)
                rate = head["sample_rate"]
                x = x[round(start * rate) : None if stop is None else round(stop * rate)]
                yield pd.DataFrame({"path": name, "rate": rate, "channel": range(x.shape[1]), "samples": [x[:, k].astype("float32") for k in range(x.shape[1])]})

    return files.mapInPandas(work, "path string, rate int, channel int, samples array<float>")
