"""Model-backed maps behind pluggable functions: embedding, enrichment, their gates."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

LEAST_CHARS, PROMPT_CHARS, IN_FLIGHT = 80, 2500, 4


def enrich_gate(chunks: DataFrame) -> DataFrame:
    """Chunks worth a model call: eligible kinds of at least LEAST_CHARS characters, trimmed."""
    eligible = F.col("enrich_eligible") if "enrich_eligible" in chunks.columns else F.lit(True)
    return chunks.where(eligible & (F.length(F.regexp_replace("text", r"\A\s+|\s+\z", "")) >= LEAST_CHARS))


def pending(chunks: DataFrame, *asked: DataFrame) -> DataFrame:
    """Chunks without a summary or an attempt (tables with a chunk_id): the incremental job's input."""
    for done in asked:
        chunks = chunks.join(done.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_anti")
    return chunks


def hashed_embedding(text: str, size: int = 64) -> np.ndarray:
    """Deterministic default where no model is installed: signed hashes of terms, unit length."""
    import zlib

    v = np.zeros(size, np.float32)
    for t in (text or "").lower().split():
        h = zlib.crc32(t.encode())
        v[h % size] += 1 if h & 0x80000000 else -1
    return v / max(float(np.linalg.norm(v)), 1e-12)


def embed(column: Column, model: Callable[[], Callable[[list[str]], list[np.ndarray]]] | None = None) -> Column:
    """Embedding column; the model factory runs once per Python worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        apply = model() if model else lambda texts: [hashed_embedding(t) for t in texts]
        for s in batches:
            yield pd.Series(list(apply(s.fillna("").tolist())))

    return run(column)


def _patient(model: Callable[[str], str], attempts: int, pause: float) -> Callable[[str], str]:
    """An empty answer is asked for once more, an error up to ``attempts`` times with growing pauses; then the
    answer is empty: one chunk's failure is its own."""

    def ask(text: str) -> str:
        empty = 0
        for n in range(attempts):
            try:
                answer = model(text)
                if answer or empty:
                    return answer or ""
                empty = 1
            except Exception:  # noqa: BLE001
                time.sleep(pause * 2**n)
        return ""

    return ask


def enrich(chunks: DataFrame, model: Callable[[str], str], in_flight: int = IN_FLIGHT, attempts: int = 3, pause: float = 0.5) -> DataFrame:
    """id, technical, business, keywords. ``model`` maps a prompt text to labelled sections. Every task keeps up to
    ``in_flight`` requests open, so an executor has at most that many times its task slots (spark.executor.cores), and the whole
    job grows with the executors; answers return in the order of the chunks, a batch is never held twice."""
    limit, prompt = in_flight, PROMPT_CHARS

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        patient = _patient(model, attempts, pause)
        with ThreadPoolExecutor(limit) as pool:
            for texts in batches:
                yield pd.Series(list(pool.map(patient, (t[:prompt] for t in texts))), dtype=object)

    answered = enrich_gate(chunks).select("id", ask("text").alias("answer"))
    return answered.select("id", *(X.labelled_section(F.col("answer"), k).alias(k.lower()) for k in ("TECHNICAL", "BUSINESS", "KEYWORDS")))
