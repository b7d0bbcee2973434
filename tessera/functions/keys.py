"""Several columns as one text key and back, for any text they hold."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SEP, _ESC = "\u0001", "\u0002"


def packed_key(columns: list[Column]) -> Column:
    """One text that tells the columns apart whatever they hold; NULL is a value of its own."""

    def safe(c: Column) -> Column:
        marked = F.replace(F.replace(c, F.lit(_ESC), F.lit(_ESC + "e")), F.lit(_SEP), F.lit(_ESC + "s"))
        return F.when(c.isNull(), F.lit(_ESC + "n")).when((F.instr(c, _SEP) == 0) & (F.instr(c, _ESC) == 0), c).otherwise(marked)

    return F.concat_ws(_SEP, *[safe(c) for c in columns])


def unpacked_key(key: Column, n: int) -> list[Column]:
    """The n columns of a packed key, as texts."""

    def plain(c: Column) -> Column:
        restored = F.replace(F.replace(c, F.lit(_ESC + "s"), F.lit(_SEP)), F.lit(_ESC + "e"), F.lit(_ESC))
        return F.when(F.instr(c, _ESC) == 0, c).when(c != _ESC + "n", restored)

    parts = F.split(key, _SEP, -1)
    return [plain(parts[i]) for i in range(n)]
