"""Words of whole texts as bytes, and batches of texts cut into slices; used inside Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that a task looks at together; a longer text is looked at whole.
BYTES_AT_ONCE = 1 << 20


def split_words(text: str) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` in UTF-8; `bytes.split` parts at exactly these six blanks."""
    return text.encode("utf-8", "surrogatepass").split()


def slices(frame: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
    """The rows in order, in groups of about BYTES_AT_ONCE characters of `text`."""
    ends = np.cumsum([0, *map(len, frame[text])])
    first = 0
    while first < len(frame):
        upto = max(first + 1, int(np.searchsorted(ends, ends[first] + BYTES_AT_ONCE, side="right")) - 1)
        yield frame.iloc[first:upto]
        first = upto


def per_slice(work: Callable[[pd.DataFrame], pd.DataFrame], kind: str, *columns: Column) -> Column:
    """A struct column of type `kind`: `work` gets slices of the columns, named c0, c1, ..., the first one the text."""
    names = [f"c{i}" for i in range(len(columns))]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [work(part) for part in slices(frame, "c0")]
            yield pd.concat(parts, ignore_index=True) if parts else work(frame)

    batches.__annotations__ = {"frames": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(batches, kind)(F.struct(*[c.alias(n) for c, n in zip(columns, names)]))


def split_by(values: np.ndarray, sizes: np.ndarray) -> pd.Series:
    """`values` cut into consecutive arrays of these sizes."""
    return pd.Series(np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else [], dtype=object)
