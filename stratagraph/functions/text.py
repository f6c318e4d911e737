"""Text expressions: keywords, languages, filters, references, time buckets, paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: File extensions and their languages (fixed values).
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".rb": "ruby", ".php": "php", ".cs": "c_sharp", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin",
    ".scala": "scala", ".css": "css", ".html": "html", ".htm": "html", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".sh": "bash", ".bash": "bash", ".pl": "perl",
    ".pm": "perl", ".r": "r", ".sql": "sql", ".lua": "lua",
}
#: Words of the domain that are no keywords (fixed values), in the order of their kinds: commit verbs, then reserved words.
DOMAIN_STOP_WORDS = (
    "use using used add added adding remove removed removing fix fixed fixing update updated updating feature feat bug issue initial commit repo repository file files "
    "test tests testing code change changes changed class def function async await return import from while for true false none null void public private protected static "
    "const var let type interface struct enum match case switch break continue yield lambda try except catch finally raise throw assert with global nonlocal del pass self cls super"
).split()
#: What is dropped from a text as a web address: a scheme or www, up to the next blank.
URL = r"\b(?:https?://|www\.)[^\s]*"


def stop_words(spark: SparkSession) -> list[str]:
    """English stop words as Spark ships them, and the domain's."""
    english = spark.sparkContext._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords("english")
    return sorted({*english, *DOMAIN_STOP_WORDS})


def language_of(extension: Column) -> Column:
    """The language of a file extension, in any case; null if unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), F.lower(extension))


def singular(word: Column) -> Column:
    """A light lemma: plural endings off (no dictionary is at hand)."""
    return (
        F.when(word.rlike("(ss|us|is)$"), word).when(word.rlike("ies$") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("([nrt]ch|each|oach|sh|x|ss|zz)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("s$") & (F.length(word) > 3), F.regexp_replace(word, "s$", "")).otherwise(word)
    )


def keywords(text: Column, stops: list[str], is_code: bool = False, lemmas: bool = True) -> Column:
    """The keywords of a text or identifier in order, repeats kept: letters only, longer than two, no stop words.

    Identifiers are split at case changes, underscores and hyphens first. Null and empty texts give an
    empty array. There is no part-of-speech tagger here: all words but stop words count as nouns.
    """
    t = F.coalesce(text, F.lit(""))
    if is_code:
        t = F.regexp_replace(F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2"), "[_-]", " ")
    t = F.regexp_replace(F.regexp_replace(F.lower(t), URL, ""), r"[^a-z\s]", " ")
    stop = F.array(*[F.lit(s) for s in stops])
    keep = lambda a: F.filter(a, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    words = keep(F.split(t, r"\s+"))
    return keep(F.transform(words, singular)) if lemmas else words


def query_words(query: str, stops: list[str]) -> list[str]:
    """The words of a query without stop words; all of them if nothing else remains; repeats once."""
    words = (query or "").lower().split()
    return list(dict.fromkeys([w for w in words if w not in set(stops)] or words))


def parse_filters(filters: list[str]) -> dict[str, str]:
    """``Type:Value`` to {TYPE: Value}, split at the first colon; a later one of the same type overwrites; others are ignored."""
    out = {}
    for f in filters or []:
        kind, colon, value = f.partition(":")
        if colon:
            out[kind.strip().upper()] = value.strip()
    return out


def parse_parameters(parameters: list[str]) -> dict[str, dict[str, str]]:
    """``Plugin:Key=Value`` to {Plugin: {Key: Value}}; what doesn't fit is ignored."""
    out: dict[str, dict[str, str]] = {}
    for p in parameters or []:
        m = re.fullmatch(r"([^:]+):([^=]+)=(.*)", p, re.S)
        if m:
            out.setdefault(m[1].strip(), {})[m[2].strip()] = m[3].strip()
    return out


def remote(url: Column) -> Column:
    """struct<owner, repo> of an https or ssh remote; null if it is neither."""
    # the last two segments, of an address or behind a colon, where the host stands before them
    parts = F.split(F.regexp_replace(F.trim(url), r"(?:\.git)?/*$", ""), "[/:]")
    piece = lambda i: F.try_element_at(parts, F.lit(i))
    known = piece(-3).rlike(r"(?:^|@)github\.com$") & (piece(-2) != "") & (piece(-1) != "")
    return F.when(known, F.struct(piece(-2).alias("owner"), piece(-1).alias("repo")))


def numbers(text: Column) -> Column:
    """The distinct ``#123`` references of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"#(\d+)"), F.lit(1)))


def references(text: Column, pattern: str) -> Column:
    """The distinct matches of a user's pattern: its first non-empty group, or the whole match."""
    groups = re.compile(pattern).groups
    whole = F.coalesce(text, F.lit(""))
    if groups <= 1:
        return F.array_distinct(F.regexp_extract_all(whole, F.lit(pattern), F.lit(groups)))
    parts = [F.regexp_extract_all(whole, F.lit(pattern), F.lit(i)) for i in range(1, groups + 1)]
    return F.array_distinct(F.filter(F.transform(F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)]), lambda z: F.coalesce(*[F.nullif(z[f"g{i}"], F.lit("")) for i in range(groups)])), lambda x: x.isNotNull()))


def time_bucket(date: Column) -> Column:
    """``YYYY-MM`` of the first ten characters of an ISO date; 2000-01 if they are no date."""
    day = F.try_to_timestamp(F.substring(date, 1, 10), F.lit("yyyy-MM-dd"))
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("2000-01"))


def base_name(path: Column) -> Column:
    """The last segment of a path."""
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The suffix with its dot; empty for none and for names that only begin with one."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


#: Ways to read an environment variable; the name is the first non-empty group.
ENV_READS = r"""(?:os\.getenv|os\.environ\.get|getenv)\(\s*["']([A-Za-z_][A-Za-z0-9_]*)["']|os\.environ\[\s*["']([A-Za-z_][A-Za-z0-9_]*)["']\s*\]|process\.env\.([A-Za-z_][A-Za-z0-9_]*)|process\.env\[\s*["']([A-Za-z_][A-Za-z0-9_]*)["']\s*\]"""


def secrets(content: Column) -> Column:
    """The distinct environment variables a source text reads."""
    return references(content, ENV_READS)
