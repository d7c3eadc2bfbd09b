"""Small media files made at test time."""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np


def write_y4m(path: Path, luma: np.ndarray, chroma: str = "444", declared: int | None = None) -> np.ndarray:
    """Frames (n, h, w) of luma with neutral chroma. Returns the grey levels a decoder should see."""
    n, h, w = luma.shape
    tags = f"YUV4MPEG2 W{w} H{h} F30000:1001 Ip A1:1 C{chroma}" + (f" XFRAMES={declared}" if declared else "")
    rows, cols = {"444": (h, w), "420jpeg": (-(-h // 2), -(-w // 2)), "422": (h, -(-w // 2)), "mono": (0, 0)}[chroma]
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as out:
        out.write(tags.encode() + b"\n")
        for frame in luma:
            out.write(b"FRAME\n" + frame.astype(np.uint8).tobytes() + bytes([128]) * (2 * rows * cols))
    if chroma == "mono":
        return luma.astype(np.uint8)
    levels = (luma.astype(np.float32) - 16.0) * np.float32(255 / 219)
    return np.clip(levels + 0.5, 0, 255).astype(np.uint8)


def write_bmp(path: Path, rgb: np.ndarray) -> None:
    """24-bit BMP, bottom row first, rows padded to 4 bytes."""
    h, w, _ = rgb.shape
    pad = bytes(-(w * 3) % 4)
    body = b"".join(row[:, ::-1].astype(np.uint8).tobytes() + pad for row in rgb[::-1])
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(head + info + body)
