"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Genomes in a word of a mask: the sign bit stays free. A mask of up to WORD genomes is a long, one of more an array of words.
WORD = 63


def words(n: int) -> int:
    return -(-n // WORD)


def is_wide(rows: DataFrame, mask: str = "mask") -> bool:
    """Whether the masks of rows are arrays of words."""
    return isinstance(rows.schema[mask].dataType, T.ArrayType)


def pan_count(rows: DataFrame, mask: str = "mask") -> Column:
    """How many genomes are in a mask of rows."""
    return F.aggregate(mask, F.lit(0), lambda s, w: s + F.bit_count(w)) if is_wide(rows, mask) else F.bit_count(mask)


def no_genome(n: int) -> Column:
    """The empty mask for n genomes."""
    zero = F.lit(0).cast("long")
    return zero if n <= WORD else F.array_repeat(zero, words(n))


def mask_of(ids: list[int], n: int = WORD) -> Column:
    """The mask of the genomes ids, of n."""
    if not all(0 <= i < n for i in ids):
        raise ValueError(f"genome ids must be 0 to {n - 1}")
    parts = [sum(1 << i % WORD for i in ids if i // WORD == w) for w in range(words(n))]
    return F.lit(parts[0]).cast("long") if n <= WORD else F.array(*(F.lit(x).cast("long") for x in parts))


def bit(mask: Column, i: Column, n: int = WORD) -> Column:
    """0 or 1: whether genome i is in the mask of n genomes."""
    return (F.getbit(mask, i) if n <= WORD else F.getbit(F.get(mask, F.floor(i / WORD).cast("int")), i % WORD)).cast("int")


def one_bit(i: Column) -> Column:
    """The mask of genome i; an error for an id that has no place in a word."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))
    return F.when((i >= 0) & (i < WORD), one).otherwise(F.raise_error(F.lit(f"a genome id is not within 0 to {WORD - 1}: give the number of genomes")).cast("long"))


def members(mask: Column, n: int) -> Column:
    """Array of the genome ids in a mask of n genomes."""
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: bit(mask, i, n) == 1)


def rounded(x: Column, digits: int) -> Column:
    """Half-even rounding of x * 10^digits, as numpy rounds."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def attribute(attr: Column, name: str) -> Column:
    """Value of a GFF attribute, matched anywhere and in any case; null if there is none."""
    return F.nullif(F.regexp_extract(attr, f"(?i){name}=([^;]+)", 1), F.lit(""))


def region(text: Column) -> Column:
    """Struct of genome, chr, start, end from genome:chr:start-end or chr:start-end."""
    p = r"^(?:([^:]+):)?([^:]+):(\d+)-(\d+)$"
    part = lambda i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    return F.struct(part(1).alias("genome"), part(2).alias("chr"), part(3).cast("long").alias("start"), part(4).cast("long").alias("end"))


def valid_name(name: Column) -> Column:
    return name.rlike("^[A-Za-z0-9_-]+$")
