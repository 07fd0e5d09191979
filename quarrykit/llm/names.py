"""Names for columns that an operator adds for its own use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free(docs: DataFrame, *names: str) -> list[str]:
    """Each name, behind as many underscores as it takes for no column of ``docs`` to have it (in any case of letters)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns(docs: DataFrame) -> list[Column]:
    """All columns of ``docs``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
