"""Looks rows up in the bitmaps of dropped rows that common.without_rows writes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import functions as F

BITMAP_ROWS = 32_768  # rows of a bitmap, as Spark's bitmap functions have it
HELD = 8  # files whose bitmaps a task remembers


def bit_reader(path: str):
    """Whether a row (file, at) has no bit in the bitmaps at path; a task reads those of the files that it meets."""

    @F.pandas_udf("boolean")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fs, place = pafs.FileSystem.from_uri(path)
        held: dict[int, dict[int, np.ndarray]] = {}

        def bits(file: int) -> dict[int, np.ndarray]:
            if file not in held:
                while len(held) >= HELD:
                    held.pop(next(iter(held)))
                folder = f"{place}/file={file}"
                found: dict[int, np.ndarray] = {}
                if fs.get_file_info(folder).type == pafs.FileType.Directory:
                    for f in fs.get_file_info(pafs.FileSelector(folder)):
                        if f.path.endswith(".parquet"):
                            with fs.open_input_file(f.path) as opened:
                                t = pq.read_table(opened, columns=["bucket", "bits"])
                            found |= {b: np.frombuffer(x, np.uint8) for b, x in zip(t["bucket"].to_pylist(), t["bits"].to_pylist(), strict=True)}
                held[file] = found
            return held[file]

        for files, places in batches:
            f, at = files.to_numpy(), places.to_numpy()
            out = np.ones(len(f), bool)
            for file in np.unique(f):
                own = np.flatnonzero(f == file)
                bucket, pos = at[own] // BITMAP_ROWS + 1, at[own] % BITMAP_ROWS
                for b in np.unique(bucket):
                    if (x := bits(int(file)).get(int(b))) is not None:
                        k = own[bucket == b]
                        p = pos[bucket == b]
                        out[k] = (x[p >> 3] >> (p & 7)) & 1 == 0
            yield pd.Series(out)

    return kept
