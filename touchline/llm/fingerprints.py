"""64-bit SimHash fingerprints of word shingles (used by the near-duplicate operator)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import chunks, doc_rows, importable, release

SEED = 42


def simhash(words: list[bytes], shingle: int) -> int:
    """A bit is 1 if it is set in over half the shingle hashes (repeats included); no words: zero."""
    n = len(words)
    if n == 0:
        return 0
    if n <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, max(1, n - shingle + 1))
    ones = bit_counts(h)
    bits = 2 * ones > len(h)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, lowest first."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        out += np.unpackbits(h[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, bits`` (the fingerprint as a signed long) of every whole text; null text: zero."""
    def run(batches):
        release()
        for b in batches:
            ids, bits = [], []
            for part in chunks(doc_rows([b])):
                for doc_id, text in part:
                    ids.append(doc_id)
                    bits.append(simhash(text.lower().split(), shingle))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(bits, np.uint64).view(np.int64))],
                                             names=["doc_id", "bits"])

    return importable(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, bits bigint")
