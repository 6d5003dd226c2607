"""What the corpus operators share: batch scans of texts, stable hashes, and the library's tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import discard, materialise, shared_path, shared_root, standing_on  # noqa: F401

#: Bytes that part words, `[\x20\x09-\x0D]`; bytes.split() without arguments splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"
#: Byte table: A-Z lower-cased, everything outside `[0-9A-Za-z]` and the bytes from 0x80 up made a space.
WORD_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


#: Bytes of text of which Python objects are made at once; a longer text is alone.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, *texts: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts (columns by position) have about `most` bytes together, one row at least."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for k in texts:
        sizes += pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False)
    upto, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def scan_texts(
    df: DataFrame,
    text: str,
    keep: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[bytes | None]], list[list]]],
) -> DataFrame:
    """`keep` columns and one column per field, computed batch by batch from the whole text's UTF-8 bytes.

    `make` runs once a task and gives a function from some texts (bytes or None) to one list per field. A column of `keep`
    with a field's name is replaced by it. No shuffle; Spark bounds a batch by its bytes, Python takes it slice by slice.
    """
    new = {f.name for f in fields}
    keep = [k for k in keep if k not in new]
    schema = T.StructType([df.schema[k] for k in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        work = make()
        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for part in slices(batch, 0):
                texts = part.column(0).cast(pa.binary()).to_pylist()
                made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(work(texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=schema.names)

    own = F.col(f"`{text}`").cast("string").alias("__text")
    return df.select(own, *[F.col(f"`{k}`") for k in keep]).mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered up to a bound (some MB) so that memory stays flat."""

    def __init__(self, most: int = 1 << 15):
        super().__init__()
        import xxhash

        self._hash, self._most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._most:
            self.clear()
        self[word] = found = self._hash(word)
        return found


def unit_interval(*columns, seed: int) -> F.Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return (F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11)).cast("double") / F.lit(float(1 << 53))
