"""Text embedding: any callable of a batch of texts; the default hashes terms into a unit vector."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from ..functions.text import embed_prefix, prefix_of

Embedder = Callable[[list[str]], np.ndarray]


class HashingEmbedder:
    """Deterministic: signed term hashes and their pairs, L2-normalised float32; an empty text is the zero vector."""

    def __init__(self, dimension: int = 64, model: str = "hashing"):
        self.dimension, self.model = dimension, model

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in (text or "").lower().replace("_", " ").split():
                h = zlib.crc32(w.strip(".,:;()[]{}'\"").encode())
                row[h % self.dimension] += 1 if h >> 16 & 1 else -1
            row /= max(float(np.linalg.norm(row)), 1e-9)
        return out


def embed_query(text: str, embedder: Embedder) -> list[float]:
    """The vector of one query, with the model's query prefix."""
    prefix = prefix_of(getattr(embedder, "model", ""), True)
    return [float(x) for x in embedder([text if text.startswith(prefix) else prefix + text])[0]]


def embed(df: DataFrame, text: str, out: str, embedder: Embedder, batch: int = 256, query: bool = False) -> DataFrame:
    """Adds the vectors of a text column; the embedder works once a batch in each worker."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    df = df.withColumn(out, embed_prefix(F.col(text), getattr(embedder, "model", ""), query))
    schema = T.StructType([f if f.name != out else T.StructField(out, T.ArrayType(T.FloatType())) for f in df.schema.fields])

    def run(pdfs: Iterator) -> Iterator:
        for pdf in pdfs:
            vectors: list = []
            texts = pdf[out].tolist()
            for at in range(0, len(texts), batch):
                vectors += list(embedder(texts[at : at + batch]))
            pdf[out] = vectors
            yield pdf

    return df.mapInPandas(run, schema)
