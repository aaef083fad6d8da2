"""Documents to words: any extractor over the bytes of files, giving the word table that layout operators read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an extractor yields for every word: page, text, x0, x1, top, bottom, bold.
Word = tuple[int, str, float, float, float, float, bool]
WORDS = "document long, page int, text string, x0 double, x1 double, top double, bottom double, bold boolean, error string"


def words_of(files: DataFrame, extract: Callable[[bytes], Iterator[Word]], first_page: int = 1, last_page: int | None = None) -> DataFrame:
    """files (document, content) -> the word table, of the pages asked for; one row with an ``error`` for a file that can't be read.

    ``extract`` runs in the executors, a file at a time, and may be any library's; its pages count from 1. Null contents give no rows.
    """

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for document, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content is None:
                    continue
                try:
                    rows = [(document, *w, None) for w in extract(content) if first_page <= w[0] <= (last_page or w[0])]
                except Exception as e:  # noqa: BLE001  whatever an extractor raises is an error of its file, not of the run
                    rows = [(document, *[None] * 7, f"{type(e).__name__}: {e}")]
                kinds = (pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 4, pa.bool_(), pa.string())
                names = [c.split()[0] for c in WORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return files.select(F.col("document").cast("long"), F.col("content").cast("binary")).mapInArrow(some, WORDS)
