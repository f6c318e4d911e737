"""Splitting oversized texts at natural boundaries, with a fixed overlap between neighbouring pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.words import RANKS, TOKENIZERS, load_encoding

#: Boundary ranks, best first: behind a blank line, a line end, a sentence end, a blank.
SENTENCE_ENDS = np.array([ord(c) for c in ".!?…。！？"], dtype=np.uint32)
BLANKS = np.array([32, 9, 13, 10], dtype=np.uint32)
PIECES = "chunk_id bigint, start bigint, stop bigint, piece string, hard_cut boolean, forced int"


def boundaries(codes: np.ndarray) -> list[np.ndarray]:
    """Sorted cut positions (a cut at p ends a piece before p) per rank; every list holds also the better ranks.

    A cut never falls between the two characters of CR LF.
    """
    n = len(codes)
    blank = np.isin(codes, BLANKS)
    newline = (codes == 10) | ((codes == 13) & np.append(codes[1:] != 10, True))
    after = np.flatnonzero(blank) + 1
    after = after[~((codes[after - 1] == 13) & (codes[np.minimum(after, n - 1)] == 10) & (after < n))]
    lines = np.flatnonzero(newline) + 1
    stops = np.flatnonzero(np.isin(codes[:-1], SENTENCE_ENDS) & blank[1:]) + 2 if n > 1 else np.empty(0, np.int64)
    stops = np.intersect1d(stops, after)
    blank_lines = lines[1:][[not (~blank[a:b]).any() for a, b in zip(lines[:-1], lines[1:])]] if len(lines) > 1 else lines[:0]
    return [blank_lines, lines, np.union1d(lines, stops), after]


def longest_unbroken(codes: np.ndarray, offsets: np.ndarray | None = None) -> int:
    """Size (in characters, or in units by their ``offsets``) of the longest run without space, tab, CR or LF."""
    at = np.concatenate([[-1], np.flatnonzero(np.isin(codes, BLANKS)), [len(codes)]])
    if offsets is None:
        return int(np.diff(at).max() - 1)
    return int((offsets[at[1:]] - offsets[at[:-1] + 1]).max())


def token_offsets(tokenizers: str = TOKENIZERS, ranks: str = RANKS) -> Callable[[str], np.ndarray]:
    """A measure in tokens: for each character position the number of tokens that begin before it."""
    state: dict = {}

    def measure(text: str) -> np.ndarray:
        if not state:
            state["encoding"] = load_encoding(tokenizers, ranks)
        _, starts = state["encoding"].decode_with_offsets(state["encoding"].encode_ordinary(text))
        return np.searchsorted(np.asarray(starts, np.int64), np.arange(len(text) + 1), "left")

    return measure


def cut(offsets: np.ndarray, cuts: list[np.ndarray], limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(start, stop, hard) character spans whose size in units is at most ``limit``.

    ``offsets[i]`` is the number of units before character i (a prefix sum; for characters i itself).
    The last boundary under the limit is found by binary search, the best rank first but only in the
    upper half of the piece; with no boundary at all the piece is cut hard at the limit. The next piece
    starts ``overlap`` units before the cut.
    """
    n, out, start = len(offsets) - 1, [], 0
    while True:
        if offsets[n] - offsets[start] <= limit:
            out.append((start, n, False))
            return out
        last = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        least = int(np.searchsorted(offsets, offsets[start] + overlap, "right"))  # a cut must leave the overlap behind
        last = max(last, least, start + 1)  # one character of more than ``limit`` units stands alone
        half = int(np.searchsorted(offsets, offsets[start] + (limit + overlap) // 2, "left"))
        stop, hard = last, True
        for rank, places in enumerate(cuts):
            k = int(np.searchsorted(places, last, "right")) - 1
            floor = least if rank == len(cuts) - 1 else max(least, half)
            if k >= 0 and places[k] >= floor:
                stop, hard = int(places[k]), False
                break
        out.append((start, stop, hard))
        back = int(np.searchsorted(offsets, offsets[stop] - overlap, "left"))
        start = max(back, start + 1)


def _pieces(limit: int, overlap: int, key_type: pa.DataType, measure: Callable[[str], np.ndarray] | None):
    schema = pa.schema([("key", key_type), ("chunk_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("piece", pa.string()), ("hard_cut", pa.bool_()), ("forced", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
                offsets = np.arange(len(codes) + 1) if measure is None else measure(text)
                forced = int(longest_unbroken(codes, offsets) > limit)
                for i, (a, b, hard) in enumerate(cut(offsets, boundaries(codes), limit, overlap)):
                    rows.append((key, i, a, b, text[a:b], hard, forced))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(schema))], schema=schema)

    return run


def split_texts(df: DataFrame, key: str, text: str, limit: int = 1000, overlap: int = 100, measure: Callable[[str], np.ndarray] | None = None) -> DataFrame:
    """(key, chunk_id, start, stop, piece, hard_cut, forced): the pieces of every text.

    Sizes are Unicode code points, or what ``measure`` counts (as ``token_offsets`` does); start and stop are
    always characters. Without ``measure``, texts of at most ``limit`` come out whole, as chunk 0, without leaving
    the JVM; the empty text gives one empty piece; a null text gives none. ``hard_cut`` marks a piece that
    ends inside an unbroken run; ``forced`` is 1 if the text holds a run of more than ``limit`` characters
    without space, tab, CR or LF, so that no boundary could have avoided it. Piece i+1 starts ``overlap``
    characters before piece i stops. Repeated rows give repeated pieces.
    """
    if not 0 <= 2 * overlap < limit:
        raise ValueError("overlap must be less than half of limit")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("__text")).where("__text IS NOT NULL")
    small = F.char_length("__text") <= limit if measure is None else F.lit(False)
    whole = rows.where(small).select(
        "key", F.lit(0).cast("bigint").alias("chunk_id"), F.lit(0).cast("bigint").alias("start"), F.char_length("__text").cast("bigint").alias("stop"), F.col("__text").alias("piece"), F.lit(False).alias("hard_cut"), F.lit(0).alias("forced")
    )
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = rows.schema["key"].dataType
    long = rows.where(~small).mapInArrow(_pieces(limit, overlap, to_arrow_type(key_type), measure), f"key {key_type.simpleString()}, {PIECES}")
    return whole.unionByName(long)


def split_long(df: DataFrame, key: str, text: str, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """The pieces of the texts longer than ``limit`` only; as ``split_texts``, without its branch for short ones."""
    from pyspark.sql.pandas.types import to_arrow_type

    if not 0 <= 2 * overlap < limit:
        raise ValueError("overlap must be less than half of limit")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("__text")).where(F.char_length("__text") > limit)
    key_type = rows.schema["key"].dataType
    return rows.mapInArrow(_pieces(limit, overlap, to_arrow_type(key_type), None), f"key {key_type.simpleString()}, {PIECES}")


def present_messages(commits: DataFrame, longer: int = -1) -> DataFrame:
    """(commit_id, message) of the present commits: per id the row scanned last.

    Messages of at most ``longer`` characters come out as null: they decide which row counts, but do not travel.
    Rows scanned at the same time, which should not be, are told apart by their message's hash, nulls first.
    """
    told = F.when(F.col("message").isNotNull(), F.xxhash64("message"))
    kept = F.when(F.char_length("message") > longer, F.col("message"))
    return commits.where("id IS NOT NULL").groupBy(F.col("id").alias("commit_id")).agg(F.max_by(F.struct(kept.alias("message")), F.struct("scanned_at", told)).alias("c")).select("commit_id", "c.message")
