"""Many byte patterns in a payload at once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 1_000_000


def automaton(patterns: list[bytes]) -> ahocorasick.Automaton:
    """Finds every pattern in one pass; of equal patterns the first counts."""
    out = ahocorasick.Automaton()
    for place, pattern in enumerate(patterns):
        text = pattern.decode("latin-1")
        if text and not out.exists(text):
            out.add_word(text, (place, len(text)))
    out.make_automaton()
    return out


def first_pattern(payload: Column, patterns: list[bytes]) -> Column:
    """Which pattern of the list occurs in the payload (binary), the earliest of the list where several do, and where it begins
    first: struct of place and at, both from 0, null where none does. One pass over a payload however long the list is; the list goes
    to each worker, which makes its automaton once, so it must be rules (MOST at most), not data."""
    if len(patterns) > MOST:
        raise ValueError(f"{len(patterns)} patterns are more than {MOST}")
    if not any(patterns):
        return F.lit(None).cast("struct<place:int,at:int>")

    @F.pandas_udf("place int, at int")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = automaton(patterns)
        for payloads in batches:
            out = []
            for raw in payloads:
                best = (None, None)
                for end, (place, size) in words.iter(bytes(raw).decode("latin-1")) if raw is not None else ():
                    if best[0] is None or place < best[0]:
                        best = (place, end - size + 1)
                out.append(best)
            yield pd.DataFrame(out, columns=["place", "at"]).astype("Int32")

    told = found(payload)
    return F.when(told["place"].isNotNull(), told)
