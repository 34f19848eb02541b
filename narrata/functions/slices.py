"""Arrow UDFs whose Python objects are those of a slice of a batch: a batch has up to 10,000 rows, and lists of strings take many times its bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of texts or samples at which a slice ends, with the row that passes them.
SLICE = 1 << 20


def slices(batch: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """A batch of strings or of lists of numbers in parts of about ``most`` bytes."""
    nested = pa.types.is_list(batch.type) or pa.types.is_large_list(batch.type)
    sizes = pc.fill_null(pc.list_value_length(batch) if nested else pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64) * (8 if nested else 1)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for lo, hi in zip(cuts, cuts[1:]):  # noqa: B905  neighbours
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def each(text: Column, f: Callable[[str], object], kind: DataType) -> Column:
    """``f`` of every text; null stays null."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                yield pa.array([f(t.as_py()) if t.is_valid else None for t in part], arrow)

    return run(text)
