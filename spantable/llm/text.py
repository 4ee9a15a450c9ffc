"""Words and letters as all operators of this package see them."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Maps A-Z to a-z and the six ASCII spaces to a plain space; all else stays.
FOLD = {**{c: c + 32 for c in range(65, 91)}, **dict.fromkeys((9, 10, 11, 12, 13), 32)}
FOLD_BYTES = bytes(FOLD.get(i, i) for i in range(256))


_owner: list[str] = []
_forget: list[Callable[[], None]] = []


def take_over(owner: str) -> None:
    """Called in a worker when an operator begins: what another operator remembered there is freed."""
    if _owner != [owner]:
        _owner[:] = [owner]
        for f in _forget:
            f()
        gc.collect()  # memories of words refer to the encoders that hold them
        give_back()


def give_back() -> None:
    """Hand memory that is free in this process back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def forget_with(f: Callable[[], None]) -> None:
    """Register what frees an operator's memory of words."""
    _forget.append(f)


def n_words(text: Column) -> Column:
    """Words in a text, as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, in UTF-8."""
    return [] if text is None else [w for w in text.encode("utf-8", "surrogatepass").translate(FOLD_BYTES).split(b" ") if w]
