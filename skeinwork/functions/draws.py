"""Reproducible draws: uniforms and orders taken from digests of (seed, key, position).

Results depend on the data alone, not on partitions, retries or the run. One SHA-256 digest holds
eight 32-bit draws, so a token array needs a digest per eight positions. Draws stay hexadecimal
text: eight digits of equal length compare as text the way their numbers compare.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.functions.arrays import let

DIGITS = 8
SHARED_BITS, SHARED_MASK = 3, 7
RANGE = 1 << 32


def _joined(*parts) -> Column:
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in columns])


def order_digest(seed, key: Column) -> Column:
    """md5 that orders rows: even over all rows, whatever the keys look like."""
    return F.md5(_joined(seed, key).cast("binary"))


def draw(digest_hex: Column, slot) -> Column:
    """The draw number ``slot`` (0..7) of a digest, as eight hexadecimal digits."""
    start = slot * DIGITS + 1 if isinstance(slot, Column) else F.lit(slot * DIGITS + 1)
    return F.substr(digest_hex, start, F.lit(DIGITS))


def below(probability: float) -> str:
    """Bound such that ``draw < bound`` happens with this probability (0 <= p < 1)."""
    if not 0 <= probability < 1:
        raise ValueError("probability must be in [0, 1)")
    return format(int(probability * RANGE), "08x")


def as_number(draw_hex: Column) -> Column:
    return F.conv(draw_hex, 16, 10).cast("bigint")


def digest(prefix: Column, position: Column) -> Column:
    """Digest of one position; ``prefix`` is the joined seed and key."""
    return F.sha2(F.concat(prefix, F.lit(":"), position.cast("string")).cast("binary"), 256)


def prefix(seed, key: Column) -> Column:
    return _joined(seed, key)


def digests(seed, key: Column, size: Column) -> Column:
    """Array of digests that covers ``size`` positions, eight each."""
    last = F.shiftright(F.greatest(size, F.lit(1)) - 1, SHARED_BITS)
    return let(prefix(seed, key), lambda p: F.transform(F.sequence(F.lit(0), last), lambda block: digest(p, block)))


def position_draw(all_digests: Column, position: Column) -> Column:
    """The draw of one position from ``digests``."""
    return draw(F.get(all_digests, F.shiftright(position, SHARED_BITS)), position.bitwiseAND(SHARED_MASK))
