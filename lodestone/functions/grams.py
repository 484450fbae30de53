"""Character trigrams of texts in Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts that are held in Python at once.
AT_ONCE = 64


def distinct_trigrams(text: str) -> list[str]:
    """The distinct runs of three characters in order of their first places; a shorter text is its own."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("<i8")
    if len(c) < 3:
        return [text]
    codes = (c[:-2] << 42) + (c[1:-1] << 21) + c[2:]
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.sort(order[np.append(True, codes[1:] != codes[:-1])])
    whole = c[first[:, None] + np.arange(3)].astype("<u4").tobytes().decode("utf-32-le")
    return [whole[k : k + 3] for k in range(0, len(whole), 3)]


def padded_trigrams(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """distinct_trigrams of batches of texts, null for null; as in chunking, a batch stays an Arrow buffer."""
    for batch in batches:
        for k in range(0, max(1, len(batch)), AT_ONCE):
            texts = batch.slice(k, AT_ONCE).cast(pa.binary()).to_pylist()
            yield pa.array([None if t is None else distinct_trigrams(t.decode("utf-8", "replace")) for t in texts], pa.list_(pa.string()))
