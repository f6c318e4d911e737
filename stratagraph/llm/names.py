"""Variant spellings of people, organisations and automation accounts.

Each row (name, e-mail address) is read into candidate identities: given name and surname in either order,
an initial and a surname, or the sorted words of an organisation. Distinct spellings are joined with
themselves by sharded tries under Levenshtein automata; a spelling moves to a better attested neighbour.
Initials alone are resolved by the address, then the address's domain, then uniqueness, never by the
surname or the address alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stratagraph.session import Scratch

#: Given names and their short forms (fixed values, general knowledge).
SHORT_FORMS = {
    "abdullah": "abdul", "alexander": "alex sasha xander sandy", "alexandra": "alex sasha sandra", "andrew": "andy drew", "anthony": "tony ant", "benedikt": "ben", "benjamin": "ben benny",
    "catalina": "lina cata", "charles": "charlie chuck", "christina": "chris tina", "christopher": "chris topher kit", "daniel": "dan danny", "david": "dave", "dmitri": "dima mitya",
    "edward": "ed eddie ned ted", "elizabeth": "beth betty liz lizzy bess eliza", "francesca": "cesca fran", "francisco": "paco pancho fran", "frederick": "fred freddy", "friedrich": "fritz",
    "gabriela": "gabi gaby", "guillermo": "memo guille", "harriet": "hattie", "henry": "hank harry", "isabella": "bella izzy isa", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hannes jo",
    "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey", "katherine": "kate katie kathy kat", "lawrence": "larry laurie", "leonardo": "leo", "magdalena": "lena magda", "margaret": "meg peggy maggie",
    "matthew": "matt", "michael": "mike mick mickey", "natalia": "nat tasha", "nicholas": "nick nico nicky", "oluwaseun": "seun", "patricia": "pat trish patty", "peter": "pete", "priyanka": "priya",
    "quentin": "quen", "rebecca": "becky becca", "richard": "dick richie rick rich", "robert": "bob bobby rob robbie", "samuel": "sam sammy", "sebastian": "basti seb", "stephanie": "steph", "steven": "steve",
    "susan": "sue susie", "theodore": "theo ted teddy", "thomas": "tom tommy", "ursula": "uschi ulla", "venkatesh": "venky", "victoria": "tori vicky", "walter": "walt wally", "william": "bill billy will liam",
    "yevgenia": "zhenya", "zacharias": "zack zach",
}
#: Words of organisation names: kinds with their abbreviations, and words without meaning (fixed values).
KINDS = {"networks": "networks", "network": "networks", "nets": "networks", "analytics": "analytics", "systems": "systems", "system": "systems", "sys": "systems", "software": "software", "sw": "software", "laboratories": "laboratories", "laboratory": "laboratories", "labs": "laboratories", "lab": "laboratories", "solutions": "solutions", "technologies": "technologies", "tech": "technologies", "foundation": "foundation", "group": "group"}
HOLLOW = {"the", "team", "ltd", "limited", "inc", "incorporated", "gmbh", "llc", "corp", "corporation", "co", "company", "ag"}
BOTS = {"bot", "automation", "robot", "ci"}

_SPELLED = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th"})


def wide(text: str) -> str:
    """Lower case without marks, umlauts as addresses write them: ae, oe, ue."""
    composed = unicodedata.normalize("NFC", text.lower()).translate(_SPELLED)
    return "".join(c for c in unicodedata.normalize("NFKD", composed) if not unicodedata.combining(c))


def fold(text: str) -> str:
    """``wide`` with ae, oe, ue as their first letter, so that umlauts typed without marks agree as well."""
    return wide(text).replace("ae", "a").replace("oe", "o").replace("ue", "u")


class Lexicon:
    """The word lists that names are read with; each is a parameter, and each may be empty."""

    def __init__(self, short_forms: dict[str, str] | None = None, kinds: dict[str, str] | None = None, hollow: set[str] | None = None, bots: set[str] | None = None) -> None:
        self.kinds, self.hollow, self.bots = KINDS if kinds is None else kinds, HOLLOW if hollow is None else hollow, BOTS if bots is None else bots
        self.nicks: dict[str, list[str]] = {}
        for given, shorts in (SHORT_FORMS if short_forms is None else short_forms).items():
            self.nicks.setdefault(fold(given), []).append(fold(given))
            for short in shorts.split():
                self.nicks.setdefault(fold(short), []).append(fold(given))

    def givens(self, name: str) -> list[str]:
        """The given names that ``name`` may stand for."""
        return self.nicks.get(name, [name])

    def kind(self, typed: str, dotted: bool) -> str | None:
        """The kind of organisation a word names, also if it is cut short with a full stop."""
        t = fold(typed)
        return self.kinds.get(t) or (next((k for k in sorted(set(self.kinds.values())) if k.startswith(t)), None) if dotted and len(t) > 2 else None)


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def agree(a: str, b: str) -> bool:
    """Whether two wide spellings are at most one edit apart, with umlauts spelled out or as plain vowels."""
    return near(a, b) or near(fold(a), fold(b))


def _surname(blob: str, s: str, heads: set[str]) -> tuple[int, str] | None:
    """(errors, folded surname) as an address of one word spells it: the surname alone or behind an initial of ``heads``."""
    ways = [(int(fold(b) != fold(s)), fold(b)) for b in ([blob[1:]] if blob[:1] in heads else []) + [blob] if len(b) > 1 and agree(b, s)]
    return min(ways, key=lambda w: w[0]) if ways else None


def _address(email: str | None) -> tuple[str | None, list[str], str]:
    """(mailbox, wide words of its local part, domain) of an address; numbers before + and at the end don't count."""
    if not email or "@" not in email:
        return None, [], ""
    local, domain = email.strip().lower().rsplit("@", 1)
    domain = re.sub(r"^(mail|email|smtp)\.", "", domain)
    words = [wide(w) for w in re.split(r"[._\-]+", re.sub(r"\d+$", "", re.sub(r"^\d+\+", "", local))) if w]
    return f"{local}@{domain}", words, domain


def read(name: str | None, email: str | None, lexicon: Lexicon) -> dict:
    """What a row may stand for.

    cls: person, org, bot or none; full: candidate "given surname" strings (or the one string of an
    organisation or account), best first; spare: the same of other pairs of words, for names of three and more; sure: whether the address spells the first one out; clear:
    whether the given name is no short form of several; partial: candidate "initial surname" strings for
    rows that give no more; box and domain: the mailbox, if the name agrees with it, and its domain.
    """
    out = {"cls": "person", "full": [], "spare": [], "sure": False, "clear": True, "partial": [], "box": None, "domain": ""}
    box, words, domain = _address(email)
    raw = name or ""
    known = {"box": box, "domain": domain}
    aside = [fold(w) for part in re.findall(r"[(\[]([^)\]]*)[)\]]", raw) for w in re.findall(r"[^\W\d_]+", part)]
    bare = re.sub(r"[(\[][^)\]]*[)\]]", " ", raw)
    typed = re.findall(r"[^\W\d_]+", bare)
    tokens = [wide(t) for t in typed]
    if lexicon.bots & set(aside) or lexicon.bots & set(tokens):
        out.update(cls="bot", full=["bot:" + " ".join(sorted(fold(t) for t in tokens if t not in lexicon.bots) or [fold(w) for w in words])])
        return out
    dots = [m[2] == "." for m in re.finditer(r"([^\W\d_]+)(\W?)", bare)]
    kinds = [k for t, d in zip(typed, dots) if (k := lexicon.kind(t, d))] if len(tokens) > 1 else []
    if kinds or (len(tokens) > 1 and lexicon.hollow & set(tokens)):
        core = sorted(fold(t) for t, y, d in zip(tokens, typed, dots) if not lexicon.kind(y, d) and t not in lexicon.hollow)
        out.update(cls="org", full=["org:" + " ".join([*core, *sorted(kinds)])], **known)
        return out
    long = [t for t in tokens if len(t) > 1]
    initials = [t for t in tokens if len(t) == 1]
    spelled = words if len(words) == 2 and min(map(len, words)) > 1 else []
    blob = words[0] if len(words) == 1 else ""
    pairs: list[tuple[str, str]] = []  # (given, surname), likelier first
    if len(long) >= 2:
        a, b = long[0], long[-1]
        caps = [t.isupper() for t in typed if len(wide(t)) > 1]
        pairs = [(a, b), (b, a)]
        if re.match(r"\s*[^\W\d_]+(?:[-'\s][^\W\d_]+)*\s*,", bare) or (caps[0] and not caps[-1]):
            pairs.reverse()
        # of three and more words any two may be the given name and the surname
        pairs += [(x, y) for x in long for y in long if x is not y and (x, y) not in pairs]
    meant = lambda g: lexicon.givens(fold(g))
    if spelled:
        g, s = spelled
        whole = any(agree(y, s) and (agree(x, g) or set(meant(x)) & set(meant(g))) for x, y in pairs)
        short = len(long) == 1 and agree(long[0], s) and (not initials or initials[0] == g[0])
        login = len(long) == 1 and not initials and any(agree(long[0], x) for x in (g[0] + s, s + g[0], g + s, s + g))
        if whole or short or login or not tokens:
            out.update(full=[f"{x} {fold(s)}" for x in meant(g)], sure=True, clear=len(meant(g)) == 1, **known)
            return out
    if pairs:
        ways = [(way, g) for g, s in pairs if blob and (way := _surname(blob, s, {g[0], *(x[0] for x in meant(g))}))]
        least = min((way[0] for way, _ in ways), default=0)
        agreed = [(g, way[1]) for way, g in ways if way[0] == least]  # the address may confirm and correct the surname
        if agreed:
            out.update(known)
        chosen = agreed or [(g, fold(s)) for g, s in pairs]
        plain = list(dict.fromkeys(f"{x} {s}" for g, s in chosen[:2] for x in meant(g)))
        out.update(full=plain, spare=[x for x in dict.fromkeys(f"{x} {s}" for g, s in chosen[2:] for x in meant(g)) if x not in plain], clear=len(meant(chosen[0][0])) == 1)
        return out
    if len(long) == 1 and initials:
        s = fold(long[0])
        if blob and (way := _surname(blob, long[0], {initials[0]})):
            s = way[1]
            out.update(known)
        out["partial"] = [f"{initials[0]} {s}"]
        return out
    if len(long) == 1:
        t = long[0]
        guesses = [(t[0], t[1:]), (t[-1], t[:-1])]
        ways = [(way, i) for i, s in guesses if blob and (way := _surname(blob, s, {i}))]
        least = min((way[0] for way, _ in ways), default=0)
        confirmed = [(i, way[1]) for way, i in ways if way[0] == least]
        if confirmed:
            out.update(known)
        elif blob and agree(blob, t):
            confirmed = [(blob[0], fold(blob[1:])), (blob[-1], fold(blob[:-1]))]
            out.update(known)
        out["partial"] = list(dict.fromkeys(f"{i} {s}" for i, s in (confirmed or [(i, fold(s)) for i, s in guesses]) if len(s) > 1))
        return out
    if not tokens and blob and len(blob) > 2:
        out.update(partial=[f"{blob[0]} {fold(blob[1:])}"], **known)
    return out


READ = pa.schema([("author_id", pa.int64()), ("cls", pa.string()), ("full", pa.list_(pa.string())), ("spare", pa.list_(pa.string())), ("sure", pa.bool_()), ("clear", pa.bool_()), ("partial", pa.list_(pa.string())), ("box", pa.string()), ("domain", pa.string())])


def _read(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(n, e, lexicon) for n, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[c] for r in rows], READ.field(c).type) for c in READ.names[1:]]], schema=READ)

    return run


# ---- trie join ---------------------------------------------------------------------------------------

#: Entries of a shard above which its rest is halved again, and how often at most; entries and queries one task takes of what is still larger.
SPLIT, LEVELS = 256, 3
TRIE_SIZE, QUERY_SIZE = 20_000, 20_000
ROW = "kind int, shard string, r string, s string"
_FRONT, _BACK, _REST = "\x01", "\x02", "\x03"


def _half(n: int) -> int:
    return max(1, (n - 1) // 2)


def shards(shard: str, rest: str, query: bool) -> list[tuple[str, str]]:
    """(shard key, what is left) by the first and by the last half of ``rest``, without the middle.

    One edit (or swap of neighbours) leaves one of the halves unharmed, since at least one character lies between
    them; a query also tries the halves of spellings one shorter and one longer. What is left of a last half is
    turned round, so that it can be halved again in the same way. Rests of up to three characters stay whole.
    """
    n = len(rest)
    out = {(shard + _REST, rest)} if n <= (4 if query else 3) else set()
    lengths = [m for m in ((n - 1, n, n + 1) if query else (n,)) if m > 3]
    for h in {_half(m) for m in lengths}:
        if h <= n:
            out |= {(shard + _FRONT + rest[:h], rest[h:]), (shard + _BACK + rest[n - h :], rest[: n - h][::-1])}
    return sorted(out)


def _halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(kind, k, left, s) for kind, shard, r, s in zip(*[c.to_pylist() for c in batch.columns]) for k, left in shards(shard, r, kind == 1)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.string()))], names=["kind", "shard", "r", "s"])


class Trie:
    """Strings as nested dictionaries; under ``None`` the values of the strings that end here."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, s: str, value: str | None = None) -> None:
        node = self.root
        for c in s:
            node = node.setdefault(c, {})
        node.setdefault(None, []).append(s if value is None else value)

    def within(self, q: str, bound: int = 1) -> list[str]:
        """The values of all strings within ``bound`` edits (swaps of neighbours count once) of ``q``.

        The Levenshtein automaton of ``q`` runs along the trie as bit sets: bit i of set e says that i characters
        of ``q`` are read with e errors. A branch ends when all sets are empty.
        """
        n, found = len(q), []
        at: dict[str, int] = {}
        for i, c in enumerate(q):
            at[c] = at.get(c, 0) | 1 << i
        end, full = 1 << n, (1 << (n + 1)) - 1
        first = tuple(((1 << (e + 1)) - 1) & full for e in range(bound + 1))
        stack = [(self.root, first, (0,) * (bound + 1))]
        while stack:
            node, sets, swaps = stack.pop()
            for c, child in node.items():
                if c is None:
                    if any(x & end for x in sets):
                        found.extend(child)
                    continue
                here = at.get(c, 0)
                moved, begun, last = [], [0], 0
                for e in range(bound + 1):
                    x = (sets[e] & here) << 1
                    if e:
                        before = sets[e - 1]
                        x |= before | before << 1 | last << 1 | (swaps[e] & here) << 2
                        begun.append(before & here >> 1)
                    last = x & full
                    moved.append(last)
                if last or begun[-1]:
                    stack.append((child, tuple(moved), tuple(begun)))
        return found


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (shard, part, block, kind): build the shard's trie, then stream its queries past it."""
    here, trie, entries, least, longest = None, Trie(), 0, 0, 0
    for batch in batches:
        out = []
        for shard, part, block, kind, r, s in zip(*[batch.column(c).to_pylist() for c in ("shard", "part", "block", "kind", "r", "s")]):
            if (shard, part, block) != here:
                here, trie, entries, least, longest = (shard, part, block), Trie(), 0, len(r), len(r)
            if kind == 0:
                trie.add(r, s)
                entries += 1
                least, longest = min(least, len(r)), max(longest, len(r))
            elif entries and least - 1 <= len(r) <= longest + 1:
                out.extend((s, t) for t in trie.within(r))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=["s", "t"])


def trie_join(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(s, t): every spelling s of ``queries`` with every spelling t of ``names`` at most one edit apart, itself included.

    Both have one string column s; null and empty strings pair with nothing, repeats count once. Shards of more
    than ``SPLIT`` entries (a frequent given name) are halved again by what is left, so that the trie a query
    walks stays small however often its first half occurs; what ``LEVELS`` halvings leave larger than
    ``TRIE_SIZE`` is a grid of entry parts and query blocks.
    """
    spark = queries.sparkSession
    scratch = Scratch(spark, "tries")
    clean = lambda df, kind: df.select(F.col(df.columns[0]).alias("s")).where("s IS NOT NULL AND s != ''").distinct().select(F.lit(kind).alias("kind"), F.lit("").alias("shard"), F.col("s").alias("r"), "s")
    inside = F.col("shard") == F.col("k")
    work, out = 0, []
    todo = clean(names, 0).unionByName(clean(queries, 1))
    for level in range(LEVELS):
        rows = scratch.write(todo.mapInArrow(_halve, ROW), "rows")
        # shards without entries or without queries drop out here
        sizes = rows.groupBy(F.col("shard").alias("k")).agg(F.count_if(F.col("kind") == 0).alias("held"), F.count_if(F.col("kind") == 1).alias("asked")).where("held > 0 AND asked > 0")
        large = (F.col("held") > SPLIT) & ~F.col("k").endswith(_REST) & F.lit(level < LEVELS - 1)
        seen = Observation()
        sizes = scratch.write(sizes.select("k", "held", "asked", F.ceil(F.col("held") / TRIE_SIZE).cast("int").alias("parts"), F.ceil(F.col("asked") / QUERY_SIZE).cast("int").alias("blocks"), large.alias("large")).observe(seen, F.count_if("large").alias("n"), F.sum((F.col("held") + F.col("asked")).cast("bigint")).alias("work")), "sizes")
        out.append(rows.join(sizes.where("NOT large"), inside))
        work += seen.get["work"] or 0
        if not seen.get["n"]:
            break
        todo = rows.join(sizes.where("large"), inside, "left_semi")
    both = out[0]
    for part in out[1:]:
        both = both.unionByName(part)
    # a grid of entry parts and query blocks: an entry goes to its part of every block, a query to every part of its block
    of = lambda n: F.array(F.pmod(F.xxhash64("s"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    entry = F.col("kind") == 0
    both = both.select("shard", F.explode(F.when(entry, of("parts")).otherwise(every("parts"))).alias("part"), "kind", "r", "s", "blocks")
    both = both.select("shard", "part", F.explode(F.when(entry, every("blocks")).otherwise(of("blocks"))).alias("block"), "kind", "r", "s")
    # a stated number of partitions is kept, where AQE would merge the few bytes of much work into two tasks
    tasks = max(spark.sparkContext.defaultParallelism, -(-work // QUERY_SIZE))
    return both.repartition(tasks, "shard", "part", "block").sortWithinPartitions("shard", "part", "block", "kind").mapInArrow(_tries, "s string, t string").distinct()


# ---- resolution --------------------------------------------------------------------------------------


def _settle(scratch: Scratch, asked: DataFrame, known: DataFrame) -> DataFrame:
    """(s, t, grade, n): where each asked spelling belongs, and the rows that use that.

    ``known`` has s, sure (rows whose address spells it out) and n (rows). A sure spelling stays. Any other
    moves to the best attested neighbour that is sure, or else is used by more rows (of as many, the smallest); grade 0 is a sure
    spelling met exactly, 1 a sure neighbour, 2 another known spelling met exactly or nearby, 3 none.
    """
    near_ = trie_join(asked.select("s"), known.select("s"))
    t = known.select(F.col("s").alias("t"), F.col("sure").alias("t_sure"), F.col("n").alias("t_n"))
    own = known.select(F.col("s").alias("o"), F.col("n").alias("s_n"))
    rated = near_.join(t, "t").join(own, F.col("s") == F.col("o"), "left")
    grade = F.when((F.col("t_sure") > 0) & (F.col("s") == F.col("t")), 0).when(F.col("t_sure") > 0, 1).otherwise(2)
    # initials and the kind of identity are no typing errors
    fits = F.substring("s", 1, 4) == F.substring("t", 1, 4)
    same_head = F.when(F.col("s").startswith("org:") | F.col("s").startswith("bot:") | F.col("t").startswith("org:") | F.col("t").startswith("bot:"), fits).otherwise(F.when((F.substring("s", 2, 1) == " ") | (F.substring("t", 2, 1) == " "), F.substring("s", 1, 2) == F.substring("t", 1, 2)).otherwise(F.lit(True)))
    best = rated.where(same_head).groupBy("s").agg(F.min(F.struct(grade.alias("grade"), (-F.col("t_n")).alias("n"), F.col("t").alias("t"))).alias("b"))
    moved = asked.select("s").distinct().join(best.withColumnRenamed("s", "b_s"), F.col("s") == F.col("b_s"), "left")
    return scratch.write(moved.select("s", F.coalesce("b.t", "s").alias("t"), F.coalesce("b.grade", F.lit(3)).alias("grade"), F.coalesce(-F.col("b.n"), F.lit(0)).alias("n")), "settled")


def _mended(scratch: Scratch, asked: DataFrame, first: DataFrame) -> DataFrame:
    """(s, m): spellings of people whose given name no address spells out, with the given name one edit off that one does.

    Together with one edit in the whole this allows one typing error in each of the two words. Of several given
    names the one of most rows counts, of as many the smallest; short ones (under four letters) stay.
    """
    head = F.substring_index("s", " ", 1)
    people = lambda df: df.where(~F.col("s").rlike("^(org|bot):")).withColumn("g", head).where(F.length("g") > 3)
    sound = people(first.where("sure")).groupBy("g").agg(F.count("*").alias("n"))
    doubtful = people(asked).select("g").distinct().join(sound.select(F.col("g").alias("k")), F.col("g") == F.col("k"), "left_anti")
    best = trie_join(doubtful.select("g"), sound.select("g")).join(sound, F.col("t") == F.col("g")).groupBy(F.col("s").alias("old")).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("t").alias("t"))).alias("b"))
    pairs = people(asked).select("s", "g").distinct().join(best, F.col("g") == F.col("old"))
    return scratch.write(pairs.select("s", F.concat("b.t", F.lit(" "), F.substring_index("s", " ", -1)).alias("m")), "mended")


def _only(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, only): the value of the groups that have exactly one."""
    return df.groupBy(*keys).agg(F.min(value).alias("only"), F.max(value).alias("__m")).where(F.col("only") == F.col("__m")).drop("__m")


def identities(authors: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(author_id, identity): the person, organisation or account a row stands for.

    Rows without a readable name and address have no row here. A null address, or one that the name does
    not agree with (shared mailboxes), is no evidence; a null name is read from the address. A repeated
    author_id with different spellings gets the smallest identity. A name of three and more words is read by
    its first and last; its other pairs of words count only if an address spells them out and nobody else uses
    the first reading. ``lexicon`` holds the short forms of given names and the words of organisations and
    accounts; without short forms only spellings of the same names are linked.
    """
    scratch = Scratch(authors.sparkSession, "names")
    columns = "author_id bigint, cls string, full array<string>, spare array<string>, sure boolean, clear boolean, partial array<string>, box string, domain string"
    rows = scratch.write(authors.where("author_id IS NOT NULL").select(F.col("author_id").cast("bigint").alias("author_id"), "name", "email").mapInArrow(_read(lexicon or Lexicon()), columns), "read")

    # a short form that several names have is no evidence for the first of them
    first = rows.where(F.size("full") > 0).where("clear").select("author_id", F.col("full")[0].alias("s"), "sure")
    known = scratch.write(first.groupBy("s").agg(F.sum(F.col("sure").cast("bigint")).alias("sure"), F.count("*").alias("n")), "known")
    listed = F.transform("full", lambda x, i: F.struct(i.alias("rank"), x.alias("s"), F.lit(False).alias("spare")))
    others = F.transform("spare", lambda x, i: F.struct((i + 1000).alias("rank"), x.alias("s"), F.lit(True).alias("spare")))
    asked = rows.select("author_id", "box", "domain", "cls", "sure", F.explode(F.concat(listed, others)).alias("x")).select("author_id", "box", "domain", "cls", "sure", "x.*")
    mended = _mended(scratch, asked, first)
    settled = _settle(scratch, asked.select("s").unionByName(mended.select(F.col("m").alias("s"))), known)
    # where the spelling moved to may itself move on
    again = settled.select(F.col("s").alias("a"), F.col("t").alias("u"))
    home = settled.join(again, F.col("t") == F.col("a")).select(F.col("s").alias("h"), F.col("u").alias("identity"), "grade", "n")
    # a mended given name counts if that finds a sure spelling, where the one typed finds none
    detour = mended.join(home, F.col("m") == F.col("h")).where("grade < 2").select("s", F.struct("identity", F.lit(1).alias("grade"), "n").alias("via"))
    home = home.join(detour, F.col("h") == F.col("s"), "left").select("h", F.when((F.col("grade") > 1) & (F.col("n") < 2) & F.col("via").isNotNull(), F.col("via")).otherwise(F.struct("identity", "grade", "n")).alias("w")).select("h", "w.*")
    order = (
        F.when(F.col("sure") & (F.col("rank") == 0), -1).when(F.col("spare"), F.when(F.col("grade") < 2, 3).otherwise(6))
        .when(F.col("grade") < 2, F.col("grade")).when(F.col("grade") == 2, F.when(F.col("n") > 1, 2).otherwise(4)).otherwise(5)
    )
    pick = F.min(F.struct(order.alias("order"), F.col("rank"), F.col("identity")))
    whole = asked.join(home, F.col("s") == F.col("h")).groupBy("author_id", "box", "domain", "cls").agg(pick.alias("p")).select("author_id", "box", "domain", "cls", F.col("p.identity").alias("identity"))
    whole = scratch.write(whole, "whole")

    people = whole.where("cls = 'person'").withColumn("key", F.concat(F.substring("identity", 1, 1), F.lit(" "), F.substring_index("identity", " ", -1)))
    have = scratch.write(people.select("key", "identity", "box", "domain").distinct(), "have")
    short = rows.where(F.size("partial") > 0).select("author_id", "box", "domain", F.posexplode("partial").alias("rank", "s"))
    keys = have.groupBy(F.col("key").alias("s")).agg(F.lit(1).cast("bigint").alias("sure"), F.count("*").alias("n"))
    placed = _settle(scratch, short, keys).withColumnRenamed("s", "p_s")
    tries = short.join(placed, F.col("s") == F.col("p_s")).select("author_id", "box", "domain", "rank", F.col("t").alias("key"), "grade")
    by_box = _only(have.where("box IS NOT NULL"), ["key", "box"], "identity").withColumnRenamed("only", "i_box")
    by_domain = _only(have.where("domain != ''"), ["key", "domain"], "identity").withColumnRenamed("only", "i_domain")
    by_key = _only(have, ["key"], "identity").withColumnRenamed("only", "i_key")
    found = tries.join(by_box, ["key", "box"], "left").join(by_domain, ["key", "domain"], "left").join(by_key, ["key"], "left")
    # rows of a key nobody spells out belong together; of a key several people share, only rows of one mailbox
    alone = F.when(F.col("grade") == 3, F.concat(F.lit("initial:"), "key")).when(F.col("box").isNotNull(), F.concat_ws("|", F.lit("box"), "key", "box"))
    options = F.array_compact(F.array(
        *[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("how"), F.col("grade"), F.col("rank"), F.col(c).alias("identity"))) for i, c in enumerate(("i_box", "i_domain", "i_key"))],
        F.when(alone.isNotNull(), F.struct(F.lit(3).alias("how"), F.col("grade"), F.col("rank"), alone.alias("identity"))),
    ))
    reached = found.select("author_id", F.explode(options).alias("o")).groupBy("author_id").agg(F.min("o").alias("o")).select("author_id", F.col("o.identity").alias("identity"))
    return whole.select("author_id", "identity").unionByName(reached).groupBy("author_id").agg(F.min("identity").alias("identity"))


#: Rows of an identity above which its pairs are formed in salted blocks, and the blocks.
LARGE, BLOCKS = 1_000, 32


def same_author_pairs(authors: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(author_a, author_b): every pair of rows of one identity, smaller id first; pairs are what the table asks for.

    One side of a large identity is spread over ``BLOCKS`` blocks and the other sent to each of them, so that no
    task forms all its pairs.
    """
    scratch = Scratch(authors.sparkSession, "pairs")
    who = scratch.write(identities(authors, lexicon), "identities")
    many = who.groupBy(F.col("identity").alias("i")).count().where(F.col("count") > LARGE).select("i", F.lit(BLOCKS).alias("blocks"))
    sized = who.join(many, F.col("identity") == F.col("i"), "left").select("author_id", "identity", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    left = sized.select(F.col("author_id").alias("author_a"), "identity", F.pmod(F.xxhash64("author_id"), F.col("blocks")).cast("int").alias("block"))
    right = sized.select(F.col("author_id").alias("author_b"), F.col("identity").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    return left.join(right, (F.col("identity") == F.col("i")) & (F.col("block") == F.col("b")) & (F.col("author_a") < F.col("author_b"))).select("author_a", "author_b")
