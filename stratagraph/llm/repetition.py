"""Repetition inside a document, judged against its language and source by robust multivariate outliers.

Every document gets exact repetition statistics. Per (language, source) a minimum-covariance-determinant
estimate of their transformed vector is refined over all rows: a deterministic start from medians, then
concentration steps, each one quantile and one moment aggregation. Documents far out by Mahalanobis
distance on the repeating side are rejected; the exact repeated share then decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.mixing import DOMAINS, language, source_name
from stratagraph.session import Scratch, spread

RUN = 6
STATS = ["run_share", "sentence_share", "line_share", "type_share"]
P = len(STATS)
X = [f"x{i}" for i in range(P)]
LEAST_ROWS, STEPS, KEPT = 50, 3, 0.75
#: Least standard deviation of a transformed statistic (an angle): scatter below it counts as this much.
FLOOR = 0.08
#: Square of the distance beyond which a row is rejected: the 0.975 quantile of chi-square with 4 degrees of freedom (fixed value).
CUTOFF, MEDIAN = 11.143, 3.357

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?…。！？]+\s+|\n\s*\n")


def _first_ids(doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """True where (doc, id) has occurred before."""
    return pd.Series(doc * np.int64(1 << 32) + ids).duplicated().to_numpy() if len(ids) else np.empty(0, bool)


def repeated_words(doc: np.ndarray, word: np.ndarray, run: int = RUN) -> np.ndarray:
    """Mask of the words in runs of ``run`` or more that begin earlier in the same document too.

    ``doc`` is non-decreasing; ``word`` holds ids. Runs are compared exactly, by ids of pairs, then of
    four, then of six words. A run that overlaps its earlier occurrence counts as well.
    """
    assert run == 6
    n = len(word) - run + 1
    if n <= 0:
        return np.zeros(len(word), bool)
    pair = pd.factorize(word[:-1].astype(np.int64) * (1 << 31) + word[1:])[0]
    four = pd.factorize(pair[:-2].astype(np.int64) * (1 << 31) + pair[2:])[0]
    six = pd.factorize(four[:n].astype(np.int64) * (1 << 31) + pair[4 : 4 + n])[0]
    inside = np.flatnonzero(doc[:n] == doc[run - 1 :])
    again = inside[_first_ids(doc[inside], six[inside])]
    edge = np.zeros(len(word) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + run, -1)
    return np.cumsum(edge)[:-1] > 0


def _unit_share(doc: int, texts: list[str], pattern) -> np.ndarray:
    """Per text the share of its characters in units (sentences or lines) that occur earlier in it."""
    out = np.zeros(doc)
    for i, t in enumerate(texts):
        seen, again, whole = set(), 0, 0
        for unit in pattern(t):
            unit = " ".join(unit.lower().split())
            if len(unit) < 12:
                continue
            whole += len(unit)
            if unit in seen:
                again += len(unit)
            seen.add(unit)
        out[i] = again / whole if whole else 0.0
    return out


def batch_statistics(texts: list[str]) -> pd.DataFrame:
    """words and STATS of each text; a text without words has zeros."""
    found = [_WORD.findall(t.lower()) for t in texts]
    sizes = np.array([len(w) for w in found], np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    word = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))[0] if len(doc) else np.empty(0, np.int64)
    some = np.maximum(sizes, 1)
    share = np.bincount(doc, repeated_words(doc, word), len(texts)) / some
    types = np.bincount(doc, _first_ids(doc, word), len(texts)) / some
    # long texts repeat words anyway: the share is held against what the length alone brings
    types = types * np.minimum(1.0, 60 / np.maximum(60, some)) ** 0.5
    return pd.DataFrame({"words": sizes, "run_share": share, "sentence_share": _unit_share(len(texts), texts, _SENTENCE.split), "line_share": _unit_share(len(texts), texts, str.splitlines), "type_share": types})


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            stats = batch_statistics(part.column("text").to_pylist())
            angle = [pa.array(np.arcsin(np.sqrt(stats[s].to_numpy()))) for s in STATS]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("source"), pa.array(stats["words"]), pa.array(stats["run_share"]), *angle], names=["doc_id", "lang", "source", "words", "run_share", *X])


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, words, run_share, x0..): exact statistics of the whole texts, x as angles asin(sqrt(share))."""
    source = source_name(F.col("source"))
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", language(F.col("lang")).alias("lang"), F.when(source.isin(list(DOMAINS)), source).otherwise("other").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return spread(rows).mapInArrow(_statistics, "doc_id bigint, lang string, source string, words bigint, run_share double, " + ", ".join(f"{x} double" for x in X))


def _moments(rows: DataFrame) -> dict[tuple, tuple[np.ndarray, np.ndarray, int]]:
    """(mean, covariance, rows) per group and, under (None, None), over all; groups are languages x sources, both bounded."""
    cross = [F.avg(F.col(X[i]) * F.col(X[j])).alias(f"c{i}{j}") for i in range(P) for j in range(i, P)]
    got = rows.rollup("lang_source").agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in X], *cross).collect()
    out = {}
    for r in got:
        mean = np.array([r[x] for x in X])
        second = np.zeros((P, P))
        for i in range(P):
            for j in range(i, P):
                second[i, j] = second[j, i] = r[f"c{i}{j}"]
        out[r["lang_source"]] = (mean, second - np.outer(mean, mean), r["n"])
    return out


def _distance(rows: DataFrame, fits: dict) -> DataFrame:
    """Add d2, the squared Mahalanobis distance under the group's fit (the overall fit for small groups)."""
    table = [(k, *m.tolist(), *inverse[np.triu_indices(P)].tolist()) for k, (m, inverse) in fits.items() if k is not None]
    m0, i0 = fits[None]
    names = [*[f"m{i}" for i in range(P)], *[f"q{i}{j}" for i in range(P) for j in range(i, P)]]
    schema = "lang_source string, " + ", ".join(f"{c} double" for c in names)
    near = rows.sparkSession.createDataFrame(table, schema)
    default = dict(zip(names, [*m0.tolist(), *i0[np.triu_indices(P)].tolist()]))
    joined = rows.join(F.broadcast(near), "lang_source", "left").fillna(default)  # one row per language and source
    diff = [F.col(X[i]) - F.col(f"m{i}") for i in range(P)]
    d2 = sum(((1 if i == j else 2) * diff[i] * diff[j] * F.col(f"q{i}{j}") for i in range(P) for j in range(i, P)), F.lit(0.0))
    return joined.withColumn("d2", d2).withColumn("side", F.col("x0") > F.col("m0")).drop(*[c for c in names if c != "m0"])


def _inverse(cov: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Inverse of the scaled scatter with FLOOR as its least standard deviation in every direction."""
    values, vectors = np.linalg.eigh(cov * scale)
    return vectors @ np.diag(1 / np.maximum(values, FLOOR**2)) @ vectors.T


def robust_fits(stats: DataFrame) -> dict:
    """MCD centre and inverse scatter per ``lang_source`` and overall (key None), over all rows of ``stats``."""
    start = stats.rollup("lang_source").agg(F.count("*").alias("n"), F.percentile_approx("x0", 0.5, 1000).alias("m0"), *[F.percentile_approx(x, 0.5, 1000).alias(f"med{i}") for i, x in enumerate(X)]).collect()
    sizes = {r["lang_source"]: r["n"] for r in start}
    ours = lambda k: k is None or sizes[k] >= LEAST_ROWS  # noqa: E731 - smaller groups use the overall fit
    fits = {r["lang_source"]: (np.array([r[f"med{i}"] for i in range(P)]), np.eye(P)) for r in start if ours(r["lang_source"])}
    for _ in range(STEPS):
        far = _distance(stats, fits)
        cut = far.groupBy("lang_source").agg(F.percentile_approx("d2", KEPT, 1000).alias("cut"), F.percentile_approx("d2", 0.5, 1000).alias("mid"))
        close = far.join(F.broadcast(cut), "lang_source").where(F.col("d2") <= F.col("cut") + 1e-12)
        fits = {k: (m, _inverse(c)) for k, (m, c, _) in _moments(close).items() if ours(k)}
    middle = {r["lang_source"]: r["mid"] for r in _distance(stats, fits).rollup("lang_source").agg(F.percentile_approx("d2", 0.5, 1000).alias("mid")).collect()}
    return {k: (m, inverse / max(1.0, middle[k] / MEDIAN)) for k, (m, inverse) in fits.items()}


def _rejected(docs: DataFrame, least: float) -> tuple[DataFrame, bool]:
    """The rows with their distance, their group's verdict ``open`` (it cannot single out repetition) and ``rejected``; and whether there are any."""
    scratch = Scratch(docs.sparkSession, "repetition")
    stats = scratch.write(statistics(docs).withColumn("lang_source", F.concat_ws("|", "lang", "source")), "stats")
    if not stats.head(1):
        return stats.withColumn("d2", F.lit(0.0)).withColumn("open", F.lit(False)).withColumn("rejected", F.lit(False)), False
    fits = robust_fits(stats)
    mark = float(np.arcsin(np.sqrt(least)))
    # conditional on x0 alone the least distance is (x0 - m0)^2 / var(x0): a group separates if the mark lies beyond the cutoff
    separates = lambda m, inverse: mark > m[0] and (mark - m[0]) ** 2 / np.linalg.inv(inverse)[0, 0] > CUTOFF
    named = [k for k in fits if k is not None]
    wide = [k for k in named if not separates(*fits[k])]
    in_wide = F.col("lang_source").isin(wide) if wide else F.lit(False)
    if not separates(*fits[None]):
        in_wide = in_wide | ~F.col("lang_source").isin(named)
    return _distance(stats, fits).withColumn("open", in_wide).withColumn("rejected", F.col("d2") > CUTOFF), True


def outlying_documents(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """(doc_id, lang, source, run_share, d2): every document whose statistics lie beyond the cutoff of its group on the repeating side of any of them.

    Here the estimates alone decide, also for documents under ``least``: repeated lines, sentences and words count
    as well as runs. Null texts and texts without words have shares of 0; repeated rows are reported once per row.
    """
    far, _ = _rejected(docs, least)
    above = F.lit(False)
    for i in range(P):
        above = above | (F.col(X[i]) > F.col("m0") if i == 0 else F.col(X[i]) > 0)
    return far.where("rejected").where(above).select("doc_id", "lang", "source", "run_share", "d2") if "m0" in far.columns else far.where("rejected").select("doc_id", "lang", "source", "run_share", "d2")


def repeated_documents(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """(doc_id, run_share, d2): the documents rejected as outliers whose exact repeated share is ``least`` or more.

    A group whose own scatter or centre reaches ``least`` cannot single out its repeating documents; all of
    them count as rejected there. So the rejection keeps every document at the mark, in any group: it saves the
    verification of the others and never decides against one. Null texts and texts without words have share 0;
    repeated rows are reported once per row. Unknown sources form one group, unknown languages another.
    """
    far, any_ = _rejected(docs, least)
    rejected = far.where((F.col("side") & F.col("rejected")) | F.col("open")) if any_ else far.where("rejected")
    return rejected.where(F.col("run_share") >= least - 1e-12).select("doc_id", "run_share", "d2")
