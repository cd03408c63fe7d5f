"""Durations and tags from MP3 bytes (A9, A10), by the public formats of MPEG audio frames and ID3v2."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kilobits a second of layer III and samples a second, by their codes in a frame's head.
BITRATES = {1: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], 2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


def _tag_size(raw: bytes) -> int:
    """Bytes of the ID3v2 tag at the start, 0 without one."""
    if raw[:3] != b"ID3" or len(raw) < 10:
        return 0
    size = 0
    for b in raw[6:10]:
        size = size << 7 | b & 0x7F
    return size + 10 + (10 if raw[5] & 0x10 else 0)


def duration_ms(raw: bytes | None) -> int | None:
    """Milliseconds of all layer III frames, truncated; None for null bytes and for bytes without a frame."""
    if raw is None:
        return None
    at, seconds, frames = _tag_size(raw), 0.0, 0
    while at + 4 <= len(raw):
        a, b, c = raw[at], raw[at + 1], raw[at + 2]
        version, layer = b >> 3 & 3, b >> 1 & 3
        bitrate, rate = c >> 4, c >> 2 & 3
        if a != 0xFF or b & 0xE0 != 0xE0 or version == 1 or layer != 1 or bitrate in (0, 15) or rate == 3:
            if frames:
                break  # a trailer, or the end of the audio
            at += 1
            continue
        samples = 1152 if version == 3 else 576
        hertz = RATES[version][rate]
        at += samples // 8 * BITRATES[1 if version == 3 else 2][bitrate] * 1000 // hertz + (c >> 1 & 1)
        seconds += samples / hertz
        frames += 1
    return int(seconds * 1000) if frames else None


def text_frames(raw: bytes | None) -> dict[str, str]:
    """Text frames (T*, COMM) of an ID3v2.3 or 2.4 tag, and the kinds of others with an empty text; none without a tag."""
    out: dict[str, str] = {}
    if raw is None or not (end := _tag_size(raw)):
        return out
    at, safe = 10, raw[3] >= 4
    while at + 10 <= min(end, len(raw)) and raw[at : at + 1].isalnum():
        kind = raw[at : at + 4].decode("latin-1")
        size = 0
        for b in raw[at + 4 : at + 8]:
            size = size << (7 if safe else 8) | b
        body = raw[at + 10 : at + 10 + size]
        text = ""
        if body and (kind[0] == "T" or kind == "COMM"):
            codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            content = body[4:] if kind == "COMM" else body[1:]
            text = content.decode(codec, "replace").strip("\0").split("\0")[-1 if kind == "COMM" else 0].lstrip("﻿")
        out[kind] = text
        at += 10 + size
    return out


def _mapped(f, kind: T.DataType) -> Column:
    @F.pandas_udf(kind)
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([f(None if x is None else bytes(x)) for x in s], dtype="object")

    return apply


def mp3_duration_ms(content: Column) -> Column:
    """BIGINT milliseconds of MP3 bytes; NULL for NULL and for bytes without an audio frame."""
    return _mapped(duration_ms, T.LongType())(content)


def id3_frames(content: Column) -> Column:
    """A10: MAP<STRING, STRING> of a file's tag; empty without one and for NULL."""
    return _mapped(text_frames, T.MapType(T.StringType(), T.StringType()))(content)
