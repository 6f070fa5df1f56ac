"""Text operators that SQL cannot state: sequence-matcher similarity, prefix token matching, paragraph chunking, full
Unicode folding. Each is an Arrow-batched function over columns, with the row function beside it for tests."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK, OVERLAP, LEAST, ROWS = 1000, 200, 100, 256


def fold(text: str | None) -> str:
    """Lower case without combining marks, straight quotes, single spaces."""
    text = (text or "").replace("’", "'").replace("‘", "'").lower()
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(bare.split())


def ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp similarity of two names."""
    return SequenceMatcher(None, a or "", b or "").ratio()


def lexical_similarity(a: str, b: str) -> float:
    """0.6 of the token Jaccard similarity and 0.4 of the character similarity of two normalised names."""
    x, y = set(a.split()), set(b.split())
    return 0.6 * (len(x & y) / len(x | y) if x | y else 0.0) + 0.4 * ratio(a, b)


def prefix_matches(a: set[str], b: set[str], least: int = 5) -> int:
    """Tokens of ``a`` that find a partner of their own in ``b``: equal, or alike in the first letters; in order."""
    free, found = sorted(b), 0
    for token in sorted(a):
        partner = next((x for x in free if x == token or x[:least] == token[:least] and min(len(x), len(token)) >= least), None)
        if partner is not None:
            free.remove(partner)
            found += 1
    return found


def windows(text: str, size: int = CHUNK, step: int = CHUNK - OVERLAP) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), step)]


def paragraph_chunks(text: str | None, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Pack paragraphs into chunks. A paragraph that is too long alone is cut into windows at once, ahead of what is being
    packed; a full chunk hands its last letters to the next one; short chunks go."""
    out: list[str] = []
    held = ""
    for part in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text or ""))):
        if len(part) > size:
            out += windows(part, size, size - overlap)
        elif len(held) + len(part) < size:
            held += ("\n\n" if held else "") + part
        else:
            out.append(held)
            held = (held[-overlap:] + "\n\n" + part) if held else part
    if held:
        out.append(held)
    return [c for c in out if len(c) > least]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts, few rows at a time, so that a worker holds few texts as Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column("doc_id"), part.column("text").to_pylist()


def folded(docs: DataFrame) -> DataFrame:
    """doc_id, folded of ``docs`` (doc_id, text)."""

    def run(batches):
        for ids, texts in _slices(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([fold(t) for t in texts], pa.string())], ["doc_id", "folded"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("folded", T.StringType())]))


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, pos, chunk of ``docs`` (doc_id, text)."""

    def run(batches):
        for ids, texts in _slices(batches):
            lists = [paragraph_chunks(t) for t in texts]
            rows = pa.array([i for i, chunks in enumerate(lists) for _ in chunks], pa.int64())
            pos, chunks = pa.array([k for chunks in lists for k in range(len(chunks))], pa.int32()), pa.array([c for chunks in lists for c in chunks], pa.string())
            yield pa.RecordBatch.from_arrays([ids.take(rows), pos, chunks], ["doc_id", "pos", "chunk"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("pos", T.IntegerType()), T.StructField("chunk", T.StringType())]))


@F.pandas_udf(T.DoubleType())
def lexical_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lexical_similarity(x or "", y or "") for x, y in zip(a, b, strict=True)])
