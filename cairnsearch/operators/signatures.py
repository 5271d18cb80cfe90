"""Three-letter signatures of documents: most documents that lack a query's words are ruled out without their contents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnsearch.functions.text import unicode_trim

BITS = 4096
SIGNATURE_SCHEMA = "id long, signature binary"
#: The lengths up to which the rule of ``lexically_confirmed`` asks for the whole query, and for any word.
WHOLE, ANY_WORD = 30, 50


def letter_triples(text: str) -> np.ndarray:
    """The places in a signature of every three characters in a row."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    if len(points) < 3:
        return np.empty(0, dtype=np.uint32)
    h = points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA77) + points[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS.bit_length() + 1)


def build_signatures(documents: DataFrame) -> DataFrame:
    """``(id, signature)`` of ``documents(id, title, content)``: ``BITS`` bits, set for the letter triples they hold."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for texts in zip(batch.column("title").to_pylist(), batch.column("content").to_pylist()):
                bits = np.zeros(BITS, dtype=np.uint8)
                for text in texts:
                    bits[letter_triples(text)] = 1
                found.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "signature"])

    lowered = [F.coalesce(F.lower(c), F.lit("")).alias(c) for c in ("title", "content")]
    return documents.select("id", *lowered).mapInArrow(sign, SIGNATURE_SCHEMA)


def may_hold(query: Column, signature: Column) -> Column:
    """False only for documents that ``lexically_confirmed`` would turn down for ``query``; a null signature may hold all."""

    @F.pandas_udf("boolean")
    def check(lowered: pd.Series, length: pd.Series, signatures: pd.Series) -> pd.Series:
        asked: dict[str, np.ndarray] = {}

        def held(text: str, bits: np.ndarray) -> bool:
            if text not in asked:
                asked[text] = np.unique(letter_triples(text))
            return bool(bits[asked[text]].all())

        out = []
        for text, n, packed in zip(lowered, length, signatures):
            if text is None or packed is None or n > ANY_WORD:
                out.append(True)
                continue
            bits = np.unpackbits(np.frombuffer(packed, dtype=np.uint8))
            if len(text) <= WHOLE:
                out.append(held(text, bits))
            else:
                out.append(any(held(word, bits) for word in text.split() if len(word) > 1))
        return pd.Series(out, dtype=bool)

    trimmed = unicode_trim(query)
    return check(F.lower(trimmed), F.length(trimmed), signature)
