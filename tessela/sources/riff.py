"""Wave files: headers and samples of byte ranges.

Everything works on files that ``pyarrow.fs`` opens (mounts, HDFS, object stores) and
reads no more than it returns.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np
from pyarrow import fs

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: A data size that a writer leaves while it does not know the end.
UNKNOWN = {0, 0xFFFFFFFF}


class Wave(NamedTuple):
    """Where and how a file holds its samples; ``frames`` are those that are there, ``closed``
    tells whether more may come."""

    rate: int
    channels: int
    width: int
    floating: bool
    data_at: int
    frames: int
    closed: bool


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Spark path, which may write file:/ with one slash."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def opened(path: str):
    system, at = place(path)
    return system.open_input_file(at)


def header(f) -> Wave | None:
    """The format of an open file, or None if it is no wave file that can be read."""
    size = f.size()
    f.seek(0)
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    form, at = None, 12
    while at + 8 <= size:
        f.seek(at)
        name, n = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            raw = f.read(min(n, 40))
            if len(raw) < 16:
                return None
            kind, channels, rate, _, step, bits = struct.unpack("<HHIIHH", raw[:16])
            if kind == EXTENSIBLE and len(raw) >= 26:
                kind = struct.unpack("<H", raw[24:26])[0]
            form = kind, channels, rate, step, bits // 8
        elif name == b"data":
            if form is None:
                return None
            kind, channels, rate, step, width = form
            known = (kind == PCM and width in (1, 2, 3, 4)) or (kind == FLOAT and width in (4, 8))
            if not known or not channels or not rate or step != channels * width:
                return None
            there, open_end = size - at - 8, n in UNKNOWN
            held = there if open_end else min(n, there)
            return Wave(rate, channels, width, kind == FLOAT, at + 8, held // step, not open_end and there >= n)
        at += 8 + n + (n & 1)
    return None


def samples(raw: bytes, w: Wave) -> np.ndarray:
    """First channel of raw frames, as doubles in -1..1."""
    if w.floating:
        x = np.frombuffer(raw, f"<f{w.width}").astype(np.float64)
    elif w.width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif w.width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float64) / (1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{w.width}").astype(np.float64) / (1 << (8 * w.width - 1))
    return x[:: w.channels]


def read_frames(f, w: Wave, first: int, n: int) -> np.ndarray:
    step = w.channels * w.width
    f.seek(w.data_at + first * step)
    return samples(f.read(min(n, max(0, w.frames - first)) * step), w)


def written_wave(x: np.ndarray, rate: int, closed: bool = True) -> bytes:
    """A mono 16-bit file of samples in -1..1; one that is still written has no size yet."""
    data = np.clip(np.floor(np.asarray(x, np.float64) * 32768 + 0.5), -32768, 32767).astype("<i2").tobytes()
    n = len(data) if closed else 0
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, PCM, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", n) + data
