import random

from hypothesis import given, settings
from hypothesis import strategies as st

from stratagraph.llm import names as N
from stratagraph.llm.labelled import SPELLINGS

AUTHORS = "author_id bigint, name string, email string, first_seen string, s string, identity string"


def distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


words = st.text("abc", min_size=1, max_size=9)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_near_trie_and_shards_agree_with_the_edit_distance(a, b):
    d = distance(a, b)
    assert N.near(a, b) == (d <= 1)
    trie = N.Trie()
    trie.add(b)
    for bound in (0, 1, 2, 3):
        assert (trie.within(a, bound) == [b]) == (d <= bound)
    if d <= 1:
        assert {k for k, _ in N.shards("", a, True)} & {k for k, _ in N.shards("", b, False)}


def test_trie_join_is_complete(spark, monkeypatch):
    rng = random.Random(1)
    names = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(4, 8))) for _ in range(400)})
    df = spark.createDataFrame([(n,) for n in names] + [(None,), ("",), (names[0],)], "s string")
    want = {(a, b) for a in names for b in names if distance(a, b) <= 1}
    assert {tuple(r) for r in N.trie_join(df, df).collect()} == want
    monkeypatch.setattr(N, "SPLIT", 3)  # frequent halves are halved again, and what is left becomes a grid
    monkeypatch.setattr(N, "TRIE_SIZE", 2)
    monkeypatch.setattr(N, "QUERY_SIZE", 3)
    assert {tuple(r) for r in N.trie_join(df, df).collect()} == want
    assert N.trie_join(df.limit(0), df).count() == 0


def pairs_of(spark, rows, **lists):
    df = spark.createDataFrame([(i, n, e, None, None, None) for i, (_, n, e) in enumerate(rows)], AUTHORS)
    got = {tuple(r) for r in N.same_author_pairs(df, N.Lexicon(**lists)).collect()}
    who = [r[0] for r in rows]
    return got, {(a, b) for a in range(len(who)) for b in range(a + 1, len(who)) if who[a] == who[b]}


def test_people_organisations_and_accounts(spark, monkeypatch):
    got, want = pairs_of(spark, SPELLINGS)
    assert got == want
    monkeypatch.setattr(N, "LARGE", 2)
    assert pairs_of(spark, SPELLINGS)[0] == want


def test_recall_with_and_without_short_forms(spark):
    """Invented people with invented surnames; given names and short forms come from outside the default list."""
    rng, rows = random.Random(5), []
    part = lambda: rng.choice("bdfgklmnprstvz") + rng.choice("aeiou")
    shorts = {"archibald": "archie", "cordelia": "delia", "leopold": "poldi", "mechthild": "mecki", "philippa": "pippa", "rosalind": "roz"}
    for person in range(120):
        given, surname = rng.choice(list(shorts)), "".join(part() for _ in range(4)) + "n"
        at = rng.randrange(2, len(surname) - 2)
        typo = surname[:at] + surname[at + 1] + surname[at] + surname[at + 2 :]
        mail = f"{given}.{surname}@site{person % 7}.example"
        for name, address in ((f"{given} {surname}", mail), (f"{surname}, {given}", None), (f"{given} {typo}", None), (f"{given[0]}. {surname}", f"{given[0]}{surname}@site{person % 7}.example"), (f"{shorts[given]} {surname}", None)):
            rows.append((person, name, address))
    (got, want), (plain, _) = pairs_of(spark, rows, short_forms=shorts), pairs_of(spark, rows, short_forms={})
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(got)
    # without the list a short form and its name are two people: 6 of 10 pairs are left
    assert 0.57 * len(want) <= len(plain & want) <= 0.61 * len(want) and len(plain - want) <= 0.01 * len(want)


def test_neither_surname_nor_address_alone(spark):
    rows = [(1, "Anna Kestrel", "office@firm.test", *[None] * 3), (2, "Bruno Kestrel", "office@firm.test", *[None] * 3), (3, "Carla Ostrander", "office@firm.test", *[None] * 3), (4, "Kestrel", None, *[None] * 3), (5, None, None, *[None] * 3), (6, "", "", *[None] * 3), (7, "???", "no address", *[None] * 3), (None, "Anna Kestrel", None, *[None] * 3)]
    df = spark.createDataFrame(rows, AUTHORS)
    assert N.same_author_pairs(df).count() == 0
    assert N.same_author_pairs(df.limit(0)).count() == 0
    assert N.identities(df.unionByName(df)).groupBy("author_id").count().where("count > 1").count() == 0
