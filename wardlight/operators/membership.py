"""A membership filter of bounded size, tested on values before they are shuffled.

The filter is a bitmap of hashes, ``BITS_PER_VALUE`` bits for each value of the
table but at most ``MAX_BITS`` (16 MB) in all, whatever the table: that is what
may be broadcast, in pieces of 4 KB.  A value meets the one piece that its hash
falls in, so no row ever carries the whole bitmap.  A value without its bit is
certainly not in the table; others still have to be joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.session import checkpointed

BITS_PER_VALUE = 1024
MAX_BITS = 1 << 27
#: Bits of one piece of Spark's bitmap aggregate.
PIECE = 32_768


def filter_bits(values: int) -> int:
    """Bits of the filter of a table: a power of two, so that pieces are whole."""
    return min(MAX_BITS, max(PIECE, 1 << max(0, values * BITS_PER_VALUE - 1).bit_length()))


def bitmap_of(table: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """(rows of ``_piece`` and its ``_bits``, number of bits): the hashes of a table's rows.

    A piece without a hash has no row.
    """
    bits = filter_bits(table.count())
    place = _place(columns, bits) + 1  # Spark numbers pieces and bits from one
    pieces = table.select(place.alias("place")).groupBy((F.bitmap_bucket_number("place") - 1).alias("_piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits")
    )
    return checkpointed(pieces), bits


def _place(columns: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits))


def sifted(values: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``values`` that may be in ``table`` by ``columns``."""
    pieces, bits = bitmap_of(table, columns)
    placed = values.withColumn("_place", _place(columns, bits))
    placed = placed.withColumn("_piece", F.shiftright("_place", PIECE.bit_length() - 1))
    at = (F.col("_place") % PIECE).cast("int")
    byte = F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))
    number = F.conv(F.hex(byte), 16, 10).cast("int")
    met = placed.join(F.broadcast(pieces), "_piece")  # at most MAX_BITS
    return met.where(F.getbit(number, at % 8) != 0).select(*values.columns)
