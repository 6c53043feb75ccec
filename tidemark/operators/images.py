"""Screenshots: perceptual hashes, near duplicates and crops.

Near duplicates meet by bands of their bits, twice over: two 64-bit hashes that differ
in at most three bits share one of four bands, and one of four parts of the rest. The
join loses no pair, and even hashes that share a common band are told apart.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import hamming
from ..session import staged

#: Bits that may differ, and positions a guarded crawl tries when looking for a crop.
NEAR_BITS = 3
MAX_POSITIONS = 8192


def decode_png(data: bytes) -> np.ndarray | None:
    """8-bit greyscale, RGB, palette or alpha PNG as (height, width, 3); None if it is none."""
    if not data or data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    try:
        at, raw, palette, head = 8, b"", None, None
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            at += 12 + size
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                raw += body
            elif kind == b"IEND":
                break
        width, height, depth, colour, _, _, interlace = head
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        if depth != 8 or interlace:
            return None
        rows = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(height, 1 + width * channels)
        out = np.zeros((height, width * channels), np.uint8)
        for y in range(height):
            out[y] = _unfilter(rows[y, 0], rows[y, 1:], out[y - 1] if y else np.zeros(width * channels, np.uint8), channels)
        image = out.reshape(height, width, channels)
        if colour == 3:
            return palette[image[:, :, 0]]
        return np.repeat(image[:, :, :1], 3, axis=2) if channels <= 2 else image[:, :, :3].copy()
    except (struct.error, zlib.error, ValueError, KeyError, TypeError, IndexError):
        return None


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + up
    out = line.astype(np.int32)
    above = up.astype(np.int32)
    for i in range(len(out)):
        left = out[i - step] if i >= step else 0
        corner = above[i - step] if i >= step else 0
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + above[i]) // 2
        else:
            p = left + above[i] - corner
            a, b, c = abs(p - left), abs(p - above[i]), abs(p - corner)
            guess = left if a <= b and a <= c else above[i] if b <= c else corner
        out[i] = (out[i] + guess) & 255
    return out.astype(np.uint8)


def _resize(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear reduction with a triangle filter as wide as the scale, in two passes."""

    def axis(n: int, m: int) -> np.ndarray:
        scale = n / m
        support = max(scale, 1.0)
        w = np.zeros((m, n))
        for i in range(m):
            centre = (i + 0.5) * scale
            lo, hi = max(int(centre - support + 0.5), 0), min(int(centre + support + 0.5), n)
            k = np.maximum(0.0, 1 - np.abs((np.arange(lo, hi) + 0.5 - centre) / support))
            w[i, lo:hi] = k / k.sum()
        return w

    wide = np.floor(grey @ axis(grey.shape[1], width).T + 0.5)
    return np.floor(axis(grey.shape[0], height) @ wide + 0.5)


def dhash(image: np.ndarray | None) -> int | None:
    """64 bits, one per pixel whose right neighbour is brighter in a 9 by 8 thumbnail, as a signed number."""
    if image is None or image.size == 0:
        return None
    rgb = image.astype(np.int64)
    grey = (rgb[:, :, 0] * 19595 + rgb[:, :, 1] * 38470 + rgb[:, :, 2] * 7471 + 0x8000) >> 16
    small = _resize(grey.astype(float), 9, 8)
    bits = (small[:, 1:] > small[:, :-1]).flatten()
    value = 0
    for b in bits:
        value = value << 1 | int(b)
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(T.LongType())
def perceptual_hash(png: pd.Series) -> pd.Series:
    """dHash of an encoded image; null for what can't be decoded."""
    return pd.Series([dhash(decode_png(bytes(p))) if p is not None else None for p in png], dtype="Int64")


def find_crop(small: np.ndarray, big: np.ndarray, most: int | None = None) -> tuple[int, int] | None:
    """(x, y) of the topmost, then leftmost place where ``small`` is exactly part of ``big``.

    The first place left is compared whole; the pixel that differs there then rules out all places
    that differ in it as well. ``most`` (:data:`MAX_POSITIONS` in a guarded crawl) bounds the places
    that share the first pixel; by default all are tried.
    """
    sh, sw = small.shape[:2]
    bh, bw = big.shape[:2]
    if small.size == 0 or sh > bh or sw > bw:
        return None
    ys, xs = (v[:most] for v in np.nonzero((big[: bh - sh + 1, : bw - sw + 1] == small[0, 0]).all(axis=-1)))
    while len(ys):
        y, x = ys[0], xs[0]
        wrong = np.argwhere((big[y : y + sh, x : x + sw] != small).any(axis=-1))
        if not len(wrong):
            return int(x), int(y)
        dy, dx = wrong[0]
        left = (big[ys + dy, xs + dx] == small[dy, dx]).all(axis=-1)
        ys, xs = ys[left], xs[left]
    return None


@F.pandas_udf(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))
def crop_position(clip: pd.Series, page: pd.Series) -> pd.DataFrame:
    """Where a clip's pixels lie in a page's picture; null fields where they don't."""
    out = []
    for c, p in zip(clip, page):
        small, big = decode_png(bytes(c)) if c is not None else None, decode_png(bytes(p)) if p is not None else None
        at = find_crop(small, big) if small is not None and big is not None else None
        out.append(at or (None, None))
    return pd.DataFrame(out, columns=["x", "y"]).astype("Int32")


def _part(x: Column, i: int, width: int) -> Column:
    return F.shiftrightunsigned(x, width * i).bitwiseAND(F.lit((1 << width) - 1))


def _without(x: Column, i: int) -> Column:
    """The 48 bits of a hash besides its i-th 16-bit band."""
    low = x.bitwiseAND(F.lit((1 << 16 * i) - 1)) if i else F.lit(0).cast("bigint")
    high = F.shiftleft(F.shiftrightunsigned(x, 16 * (i + 1)), 16 * i) if i < 3 else F.lit(0).cast("bigint")
    return high.bitwiseOR(low)


def _first_zero(parts: list[Column]) -> Column:
    out = F.lit(None).cast("int")
    for i in reversed(range(len(parts))):
        out = F.when(parts[i] == 0, F.lit(i)).otherwise(out)
    return out


def bands(hashes: DataFrame) -> DataFrame:
    """Each hash under sixteen 28-bit keys: a 16-bit band, and a 12-bit band of the rest.

    Hashes that differ in at most three bits share a whole band, and then, since the
    rest differs in at most three bits too, one of its four parts.
    """
    keys = [
        F.struct(F.lit(i).alias("band"), F.lit(j).alias("sub"), F.shiftleft(_part(F.col("hash"), i, 16), 12).bitwiseOR(_part(_without(F.col("hash"), i), j, 12)).alias("bits"))
        for i in range(4)
        for j in range(4)
    ]
    return hashes.select("*", F.inline(F.array(*keys)))


def near_pairs(hashes: DataFrame, bits: int = NEAR_BITS) -> DataFrame:
    """(grp, a, b, distance) of hashes in a group that differ in at most ``bits`` (3 at most), a before b.

    Equal hashes are joined as one representative first (the smallest seq), so copies
    don't multiply; a pair is reported under its first common key only.
    """
    if bits > 3:
        raise ValueError("the keys find pairs of at most three differing bits")
    reps = hashes.filter("hash is not null").groupBy("grp", "hash").agg(F.min("seq").alias("seq"))
    x = bands(reps)
    left = x.select("grp", "band", "sub", "bits", F.col("hash").alias("h1"), F.col("seq").alias("a"))
    right = x.select("grp", "band", "sub", "bits", F.col("hash").alias("h2"), F.col("seq").alias("b"))
    xor = F.col("h1").bitwiseXOR(F.col("h2"))
    band = _first_zero([_part(xor, i, 16) for i in range(4)])
    sub = F.lit(None).cast("int")
    for i in range(4):
        sub = F.when(F.col("band") == i, _first_zero([_part(_without(xor, i), j, 12) for j in range(4)])).otherwise(sub)
    near = left.join(right, ["grp", "band", "sub", "bits"]).filter("a < b").withColumn("distance", hamming(F.col("h1"), F.col("h2"))).filter(F.col("distance") <= bits)
    return near.filter((F.col("band") == band) & (F.col("sub") == sub)).select("grp", "a", "b", "distance")


def resolve_pictures(shots: DataFrame) -> DataFrame:
    """(grp, seq, kept): the earlier picture each one reuses, or itself.

    ``shots``: grp, seq, key (of the bytes), hash. The same bytes reuse the first; else the
    first kept picture within three bits; a flat picture (hash 0) only by its bytes. What is
    kept depends on what came before, so decisions run in rounds: a picture without an
    undecided earlier neighbour is decided, until none is left.
    """
    first = shots.groupBy("grp", "key").agg(F.min("seq").alias("first"), F.min_by("hash", "seq").alias("hash"))
    real = first.filter("hash is not null and hash != 0").select("grp", F.col("first").alias("seq"), "hash")
    reps = real.groupBy("grp", "hash").agg(F.min("seq").alias("seq"))
    pairs = staged(near_pairs(reps), "near_pairs").select("grp", "a", "b")
    kept = reps.select("grp", "seq").join(pairs.select("grp", F.col("b").alias("seq")).distinct(), ["grp", "seq"], "left_anti").select("grp", "seq", F.col("seq").alias("kept"))
    kept = staged(kept, "pictures")  # decisions are staged once and only added
    while True:
        todo = reps.select("grp", "seq").join(kept.select("grp", "seq"), ["grp", "seq"], "left_anti")
        if not todo.limit(1).count():
            break
        open_ = pairs.join(todo.select("grp", F.col("seq").alias("b")), ["grp", "b"])
        state = open_.join(kept.select("grp", F.col("seq").alias("a"), "kept"), ["grp", "a"], "left")
        per = state.groupBy("grp", "b").agg(
            F.min(F.when(F.col("kept") == F.col("a"), F.col("a"))).alias("near"),
            F.min(F.when(F.col("kept").isNull(), F.col("a"))).alias("wait"),
        )
        ready = per.filter(F.col("wait").isNull() | (F.col("near") < F.col("wait")))
        kept = kept.unionByName(staged(ready.select("grp", F.col("b").alias("seq"), F.coalesce("near", "b").alias("kept")), "pictures"))
    by_hash = real.join(reps.select("grp", "hash", F.col("seq").alias("rep")), ["grp", "hash"]).select("grp", F.col("seq").alias("first"), "rep")
    final = by_hash.join(kept.select("grp", F.col("seq").alias("rep"), "kept"), ["grp", "rep"]).select("grp", "first", "kept")
    rows = shots.select("grp", "seq", "key").join(first.select("grp", "key", "first"), ["grp", "key"])
    return rows.join(final, ["grp", "first"], "left").select("grp", "seq", F.coalesce("kept", "first").alias("kept"))
