"""Signatures of texts in bulk: SimHash and MinHash of character shingles, and partitioned SimHash tables."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.encoding import code_points

SHINGLE_CHARS = 4  # character shingles need no word borders, so any script works
HAMMING = 20  # bits of 64; texts that are 0.8 similar differ in 9.7 on average, with a deviation of 2.9
BLOCK = 2  # bits of a block of the signature
BLOCKS = 7  # blocks that make a table's key
PORTION = 1000  # texts signed at a time
TABLES = 40  # of 0.8 similar pairs one in a hundred shares no key


def shingles(text: str) -> set[str]:
    """Character shingles; a short text is one."""
    n = SHINGLE_CHARS
    return {text[i : i + n] for i in range(len(text) - n + 1)} or {text}


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the shingles."""
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


@F.pandas_udf(T.DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity of the character shingles of two columns."""
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(by)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each character with the ones after it in its text, and where each text starts.

    Past the end of a text stand line ends, so texts of any length have a shingle.
    """
    codes, starts = code_points(texts)
    ends = np.append(starts[1:], len(codes)) - 1
    left = np.repeat(ends, np.diff(np.append(starts, len(codes)))) - np.arange(len(codes))
    wide = codes.astype(np.uint64)
    h = wide * np.uint64(0x9E3779B97F4A7C15)
    for k, by in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (3, 0x27D4EB2F165667C5)):
        after = np.concatenate([wide[k:], np.full(min(k, len(wide)), 10, dtype=np.uint64)])
        h = h + np.where(left > k, after, np.uint64(10)) * np.uint64(by)
    return _mixed(h, 0xD6E8FEB86659FD93), starts


# For each byte its bits, a byte lane each: lanes are summed eight at a time.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint8).view(np.uint64).ravel()


def simhashes(texts: list[str]) -> np.ndarray:
    """64-bit SimHash of each text, as signed integers."""
    if len(texts) > PORTION:  # what stays in the processor's cache is done twice as fast
        return np.concatenate([simhashes(texts[i : i + PORTION]) for i in range(0, len(texts), PORTION)])
    if not texts:
        return np.zeros(0, dtype=np.int64)
    h, starts = shingle_hashes(texts)
    lengths = np.diff(np.append(starts, len(h)))
    parts = -(-lengths // 255)  # a lane holds a byte, so long texts are summed in parts
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    at = np.repeat(starts, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(first, parts))
    raw = h.view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(texts), 64), dtype=bool)
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[raw[:, byte]], at).view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        out[:, 8 * byte : 8 * byte + 8] = 2 * sums > lengths[:, None]
    return np.packbits(out, axis=1, bitorder="little").view(np.int64).ravel()


def minhash_bands(texts: list[str], bands: int, rows: int) -> np.ndarray:
    """A key for each text and band: equal where the least hashes of all the band's permutations are.

    Texts of similarity s share a band with probability s ** rows.  A key holds its band's number.
    """
    if len(texts) > PORTION:
        return np.concatenate([minhash_bands(texts[i : i + PORTION], bands, rows) for i in range(0, len(texts), PORTION)])
    if not texts:
        return np.zeros((0, bands), dtype=np.int64)
    h, starts = shingle_hashes(texts)
    dice, columns = random.Random(12), []
    for b in range(bands):
        key = np.full(len(texts), b, dtype=np.uint64)
        for _ in range(rows):
            by = np.uint64(dice.getrandbits(64) | 1)
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h * by, starts), 0x9FB21C651E98DF25)
        columns.append(key)
    return np.stack(columns, axis=1).view(np.int64)


def table_masks(tables: int = TABLES) -> list[int]:
    """The bits of a signature that make the key of each table.

    A signature is cut into blocks; a table's key is made of some of them, chosen by a fixed
    seed so that each block serves as many tables.  Near signatures agree on all blocks of
    some table.
    """
    dice, pool, masks = random.Random(64), [], []
    for _ in range(tables):
        while len(pool) < BLOCKS:
            pool += [b for b in dice.sample(range(64 // BLOCK), 64 // BLOCK) if b not in pool]
        picked, pool = pool[:BLOCKS], pool[BLOCKS:]
        mask = sum(((1 << BLOCK) - 1) << (BLOCK * b) for b in picked)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def in_tables(df: DataFrame, signature: str) -> DataFrame:
    """``df`` with a row a table: ``mask`` names the table, ``key`` is the signature's key in it."""
    masks = F.array(*[F.lit(m).cast("bigint") for m in table_masks()])
    return df.withColumn("mask", F.explode(masks)).withColumn("key", F.col(signature).bitwiseAND(F.col("mask")))


def hamming(a: str, b: str) -> Column:
    """Number of bits in which two signature columns differ."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
