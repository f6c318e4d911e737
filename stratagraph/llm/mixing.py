"""Mixing sources to target weights: hierarchical budgets, shortages shared among siblings first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.llm.words import RANKS, TOKENIZERS, load_encoding
from stratagraph.operators.prefix import exclusive_prefix_sum
from stratagraph.session import Scratch, spread

#: Common notations of languages, to two letters (general knowledge); a parameter.
LANGUAGES = {"english": "en", "eng": "en", "german": "de", "deutsch": "de", "deu": "de", "ger": "de", "spanish": "es", "spa": "es", "french": "fr", "fra": "fr", "fre": "fr", "italian": "it", "ita": "it", "portuguese": "pt", "por": "pt"}
#: The domain of each source, the first level of the tree; a parameter. A source that it lacks is a domain of its own.
DOMAINS = {"commit_message": "history", "release_note": "history", "pull_request": "collaboration", "review": "collaboration", "task": "collaboration", "mailing_list": "collaboration", "code_comment": "code", "tutorial": "writing", "postmortem": "writing"}


def source_name(source: Column) -> Column:
    """Lower case, trimmed, runs of other characters than letters and digits as one underscore."""
    return F.regexp_replace(F.lower(F.trim(source)), "[^a-z0-9]+", "_")


def language(lang: Column, notations: dict[str, str] = LANGUAGES) -> Column:
    """Two letters: of ``en-US``, ``EN`` or ``English``; null and blank are 'und', other notations stay as they are."""
    low = F.regexp_extract(F.lower(F.trim(lang)), "^[a-z]+", 0)
    names = F.create_map(*[F.lit(x) for pair in notations.items() for x in pair]) if notations else F.create_map().cast("map<string,string>")
    return F.when(F.coalesce(low, F.lit("")) == "", "und").otherwise(F.coalesce(F.try_element_at(names, low), low))


def _counter(tokenizers: str, ranks: str):
    """An Arrow function that replaces the last column, a text, by its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(tokenizers, ranks)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            names = [*batch.schema.names[:-1], "tokens"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=names)

    return run


def count_tokens(docs: DataFrame, tokenizers: str = TOKENIZERS, ranks: str = RANKS, notations: dict[str, str] = LANGUAGES) -> DataFrame:
    """(doc_id, source, lang, tokens) of the whole texts, names normalised; null ids and null texts have no row here."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), language(F.col("lang"), notations).alias("lang"), "text")
    return spread(rows).mapInArrow(_counter(tokenizers, ranks), "doc_id bigint, source string, lang string, tokens bigint")


class Node:
    """A node of the domain-language-source tree with its weight, capacity and budget."""

    def __init__(self, name: str, weight: float = 0.0, cap: float = 0.0) -> None:
        self.name, self.weight, self.cap, self.budget = name, weight, cap, 0.0
        self.children: dict[str, Node] = {}

    def close(self) -> None:
        """Sum weights and capacities upward."""
        for c in self.children.values():
            c.close()
        if self.children:
            self.weight = sum(c.weight for c in self.children.values())
            self.cap = sum(c.cap for c in self.children.values())

    def give(self, budget: float) -> None:
        """Share ``budget`` among the children by weight; what one can't use goes to its siblings.

        A shortage reaches this node's own siblings only as far as all its children are full, since the
        budget given here is never above the capacity of the subtree.
        """
        self.budget = min(budget, self.cap)
        left, open_ = self.budget, [c for c in self.children.values() if c.cap > 0]
        shares = {c.name: 0.0 for c in self.children.values()}
        while open_ and left > 1e-9:
            weight = sum(c.weight for c in open_)
            part = {c.name: (left * c.weight / weight if weight > 0 else left / len(open_)) for c in open_}
            full = [c for c in open_ if shares[c.name] + part[c.name] >= c.cap - 1e-9]
            if not full:
                for c in open_:
                    shares[c.name] += part[c.name]
                break
            for c in full:
                left -= c.cap - shares[c.name]
                shares[c.name] = c.cap
            open_ = [c for c in open_ if c not in full]
            # the rest keep what they had and share what is left anew
        for c in self.children.values():
            c.give(shares[c.name])


def budgets(leaves: list[dict], targets: dict[str, float], repeats: dict[str, int], total: float, domains: dict[str, str] = DOMAINS) -> dict[tuple[str, str], float]:
    """Token budget of every (source, language) leaf.

    A leaf's weight is its source's target share times the language's share of that source's tokens; its
    capacity is its tokens times the source's repeat cap. The tree is domain - language - source, so a
    source's shortage goes to the other sources of its domain in that language, then to the domain's other
    languages, then to other domains. A source without documents stands in every language of its domain.
    """
    root = Node("root")
    have = {s: sum(r["tokens"] for r in leaves if r["source"] == s) for s in targets}
    domain_of = lambda s: domains.get(s, s)
    spoken: dict[str, dict[str, float]] = {}
    for r in leaves:
        if r["source"] in targets and r["tokens"] > 0:
            of = spoken.setdefault(domain_of(r["source"]), {})
            of[r["lang"]] = of.get(r["lang"], 0.0) + r["tokens"]
    for s, share in targets.items():
        domain = root.children.setdefault(domain_of(s), Node(domain_of(s)))
        mine = {r["lang"]: r["tokens"] for r in leaves if r["source"] == s and r["tokens"] > 0}
        weights = mine or spoken.get(domain_of(s)) or {"und": 1.0}
        for lang, tokens in sorted(weights.items()):
            node = domain.children.setdefault(lang, Node(lang))
            node.children[s] = Node(s, share * tokens / sum(weights.values()), float(mine.get(lang, 0) * repeats[s]))
    root.close()  # a source without documents has no capacity, but its weight stays where it belongs
    root.give(total)
    return {(s.name, lang.name): s.budget for d in root.children.values() for lang in d.children.values() for s in lang.children.values() if have[s.name]}


def feasible(leaves: list[dict], targets: dict[str, float], repeats: dict[str, int]) -> float:
    """The largest total, up to all usable tokens once, at which every source with documents reaches its share within its repeat cap."""
    have = {s: sum(r["tokens"] for r in leaves if r["source"] == s) for s in targets}
    limits = [have[s] * repeats[s] / share for s, share in targets.items() if share > 0 and have[s] * repeats[s] > 0]
    return float(min([sum(have.values()), *limits]))


def mixture(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, tokenizers: str = TOKENIZERS, ranks: str = RANKS, domains: dict[str, str] = DOMAINS, notations: dict[str, str] = LANGUAGES) -> DataFrame:
    """(doc_id, source, lang, tokens, uses): how often each document is used; unused documents are left out.

    ``total`` is the size of the mixture in tokens, by default the largest at which every source that has documents
    reaches its share within its repeat cap (``feasible``); larger totals leave some short. Each leaf
    takes whole epochs while its budget lasts and of the last epoch the documents in seeded order whose
    token range starts inside the budget, so it exceeds its budget by less than one document and never
    its repeat cap. Null, empty and unknown-source documents are not used; repeated documents count once,
    repeated target rows too (with the largest share and cap).
    """
    marked = targets.where("source IS NOT NULL").groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()  # one row per source named in the target table
    share, cap = {r["source"]: r["share"] or 0.0 for r in marked}, {r["source"]: max(0, r["cap"] or 0) for r in marked}
    used = docs.where(source_name(F.col("source")).isin(list(share)))
    once = count_tokens(used, tokenizers, ranks, notations).where("tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "lang", "tokens")).alias("d")).select("doc_id", "d.*")
    sized = Scratch(docs.sparkSession, "mixing").write(once, "sized")
    leaves = [r.asDict() for r in sized.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).collect()]  # at most sources x languages
    plan = budgets(leaves, share, cap, float(total) if total is not None else feasible(leaves, share, cap), domains)
    have = {(r["source"], r["lang"]): r["tokens"] for r in leaves}
    rows = [(s, lang, int(b // have[s, lang]), float(b - (b // have[s, lang]) * have[s, lang]), cap[s]) for (s, lang), b in plan.items()]
    leaf = docs.sparkSession.createDataFrame(rows, "source string, lang string, epochs bigint, rest double, cap bigint")
    # the order of the last epoch: 64 seeded bits, their leading part as the bucket of the prefix sum
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    placed = exclusive_prefix_sum(
        sized.join(F.broadcast(leaf), ["source", "lang"]).withColumn("__o", order).withColumn("__key", F.struct("__o", "doc_id")),
        ["source", "lang"], "__key", "tokens", "before", F.shiftright(F.col("__o"), 52),
    )
    uses = F.least(F.col("cap"), F.col("epochs") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0))
    return placed.select("doc_id", "source", "lang", "tokens", uses.alias("uses")).where("uses > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, docs, used_tokens, actual_share, repeats_max, missed) for every target source.

    ``missed`` is by how much the share of a source falls short of its target, 0 if it does not.
    """
    want = targets.where("source IS NOT NULL").groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"))
    got = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("repeats_max"))
    both = want.join(got, "source", "left").fillna(0, ["docs", "used_tokens", "repeats_max"])
    whole = F.sum("used_tokens").over(W.partitionBy(F.lit(0)))  # one row per target source
    return both.withColumn("whole", whole).select("source", "target_share", "docs", "used_tokens", "repeats_max", F.when(F.col("whole") > 0, F.col("used_tokens") / F.col("whole")).otherwise(0.0).alias("actual_share")).withColumn("missed", F.greatest(F.lit(0.0), F.coalesce("target_share", F.lit(0.0)) - F.col("actual_share")))
