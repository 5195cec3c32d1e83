"""Words of a text as bytes, shared by the operators that compare documents with benchmark items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_word_byte(b: int) -> int:
    if ord("A") <= b <= ord("Z"):
        return b + 32
    keeps = ord("0") <= b <= ord("9") or ord("a") <= b <= ord("z") or b >= 128
    return b if keeps else ord(" ")


#: Lower-cases A-Z and turns every other ASCII byte that is no letter or digit into a space; lengths stay.
TO_WORDS = bytes(map(_as_word_byte, range(256)))


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of digits, ASCII letters (in lower case) and whatever is not ASCII."""
    return text.translate(TO_WORDS).split()


def utf8(text: str) -> Column:
    """A text column as its bytes; null is empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
