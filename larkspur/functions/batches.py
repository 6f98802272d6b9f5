"""What Python functions of texts share: batches in parts of bounded size, so that a task's memory doesn't grow with its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

# Fixed value: characters of the texts of a part, about; a longer text is a part of its own.
PART_CHARS = 1 << 20


def parts(texts: pd.Series, chars: int = PART_CHARS) -> Iterator[slice]:
    """Where to cut a batch of texts, null ones included, so that each part has at most about `chars` characters besides its first text."""
    size = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    edges = (np.flatnonzero(np.diff(np.cumsum(size) // chars)) + 1).tolist()
    for a, z in zip([0, *edges], [*edges, len(texts)], strict=True):
        if a < z:
            yield slice(a, z)


def in_parts(run: Callable[..., pd.Series | pd.DataFrame]) -> Callable[[Iterator], Iterator[pd.Series | pd.DataFrame]]:
    """A function over batches of a function over series, the first of which are texts: it is called for a part at a time.

    Freed memory goes back to the system when a task ends, as the worker lives on.
    """

    def batches(many: Iterator) -> Iterator[pd.Series | pd.DataFrame]:
        try:
            for batch in many:
                columns = batch if isinstance(batch, tuple) else (batch,)
                for at in parts(columns[0]):
                    yield run(*(c.iloc[at] for c in columns))
        finally:
            pa.default_memory_pool().release_unused()

    return batches
