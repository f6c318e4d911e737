import random

import numpy as np
import pyarrow as pa
import pytest

from stratagraph.llm import leakage as K
from stratagraph.llm.words import Hasher, plain_words

rng = random.Random(3)
WORDS = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
ITEMS = [(i, " ".join(rng.choice(WORDS) for _ in range(60))) for i in range(8)]
DOCS = "doc_id bigint, text string, item_id string, share double"


def filler(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_words_do_not_depend_on_markup():
    plain = plain_words("Call restore_the Value's commit now")
    for odd in ("Call <b>restore\\_the</b> value&#39;s com-\n> mit NOW", "call\\nrestore_the\\tvalue\\u2019s commit​ now", "CALL **restore_the** (value's) “commit” now!"):
        assert plain_words(odd) == plain
    assert plain_words("") == []


def test_leaks_whole_part_and_changed(spark):
    item = dict(ITEMS)
    changed = item[2].split()
    changed[9::12] = ["swapped"] * len(changed[9::12])
    half = " ".join(item[3].split()[:30])
    apart = " ".join(item[4].split()[:16]) + " " + filler(40) + " " + " ".join(item[4].split()[30:46])
    docs = [(1, filler(50) + " " + item[1] + " " + filler(20)), (2, " ".join(changed).upper()), (3, filler(500) + half), (4, apart), (5, " ".join(item[5].split()[:12]) + filler(80)), (6, filler(300)), (7, None), (8, "  "), (9, ""), (10, item[6] + " " + item[7]), (1, filler(50)), (11, "x"), (None, item[1])]
    d = spark.createDataFrame([(i, t, "a", 1.0) for i, t in docs], DOCS)
    e = spark.createDataFrame(ITEMS + [(99, None), (98, ""), (1, item[1]), (None, item[1])], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in K.leaked_items(d, e).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (10, 6), (10, 7)}
    short = spark.createDataFrame([(1, "only four words here")], "item_id bigint, text string")
    assert K.leaked_items(d, short).count() == 0
    assert K.leaked_items(d.limit(0), e).count() == 0 and K.leaked_items(d, e.limit(0)).count() == 0


def test_passes_give_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(i, filler(30) + " " + t, "a", 1.0) for i, t in ITEMS], DOCS)
    e = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    monkeypatch.setattr(K, "INDEX_WORDS", 130)
    assert {(r.doc_id, r.item_id) for r in K.leaked_items(d, e).collect()} == {(i, i) for i, _ in ITEMS}


def test_every_fingerprint_within_the_radius_is_found():
    h = Hasher()
    words = [h(t.split()) for _, t in ITEMS]
    index = K.ItemIndex.build([i for i, _ in ITEMS], words)
    random_bits = np.random.default_rng(1)
    base = index.prints[random_bits.integers(0, len(index.prints), 300)]
    flips = np.zeros(300, np.uint64)
    for _ in range(K.RADIUS):
        flips |= np.uint64(1) << random_bits.integers(0, 64, 300).astype(np.uint64)
    asked = base ^ flips
    at, window = index.candidates(asked)
    got = set(zip(at.tolist(), window.tolist()))
    want = {(q, int(j)) for q in range(300) for j in np.flatnonzero(np.bitwise_count(index.prints ^ asked[q]) <= K.RADIUS)}
    assert got == want and {q for q, _ in want} == set(range(300))


def test_fingerprints_in_stretches(monkeypatch):
    hashes = Hasher()(filler(1000).split())
    whole = K.fingerprints(hashes)
    monkeypatch.setattr(K, "STRETCH", 97)
    assert (K.fingerprints(hashes) == whole).all() and len(whole) == 1000 - K.WINDOW + 1
    assert len(K.fingerprints(hashes[: K.WINDOW - 1])) == 0
    doc, item = hashes, hashes[200:260]
    assert K.covered_share(item, doc) == 1.0 and K.covered_share(item, doc[:210]) < 0.4 and K.covered_share(item, doc[:0]) == 0.0


@pytest.mark.parametrize("every", [4, 5, 6, 7, 8])
def test_single_changed_words(every):
    """Items of 60 words of which every 4th to 8th word is changed."""
    own, h = random.Random(every), Hasher()
    word = lambda: f"v{own.randrange(10**6)}"
    items = [[word() for _ in range(60)] for _ in range(100)]
    docs = [" ".join([word() for _ in range(40)] + [word() if j % every == i % every else w for j, w in enumerate(ws)] + [word() for _ in range(40)]) for i, ws in enumerate(items)]
    index = K.ItemIndex.build(list(range(100)), [h(w) for w in items])
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(docs)], names=["doc_id", "text"])
    found = {(d, i) for out in K._search(index, 0.4)(iter([batch])) for d, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    assert found <= {(i, i) for i in range(100)} and len(found) >= 98


def brute_share(item, doc):
    """Word by word along every diagonal: runs of three and more equal words, chained over one or two others."""
    covered = [False] * len(item)
    for diagonal in range(-len(item), len(doc)):
        same = [0 <= p + diagonal < len(doc) and item[p] == doc[p + diagonal] for p in range(len(item))]
        starts = [p for p in range(len(item) - 2) if all(same[p : p + 3])]
        chains = []
        for p in starts:
            if chains and p - chains[-1][1] <= 5:
                chains[-1][1] = p
            else:
                chains.append([p, p])
        for a, z in chains:
            if z + 3 - a >= 8:
                covered[a : z + 3] = [True] * (z + 3 - a)
    return sum(covered) / len(item)


def test_shares_equal_brute_force(monkeypatch):
    own, h = random.Random(4), Hasher()
    monkeypatch.setattr(K, "ALIGNED", 40)
    for _ in range(60):
        item = [own.choice("abcdefgh") * 2 for _ in range(own.randrange(8, 40))]
        doc = [own.choice("abcdefgh") * 2 for _ in range(own.randrange(0, 60))] + [w if own.random() > 0.15 else "new" for w in item] + item[:12]
        assert abs(K.covered_share(h(item), h(doc)) - brute_share(item, doc)) < 1e-9


def test_long_items_and_one_word_over_and_over():
    h = Hasher()
    item = h([f"n{i % 9000}" for i in range(20_000)])
    assert K.covered_share(item, np.concatenate([h(["x"] * 30_000), item[:9000]])) == 1.0  # the item says the same twice
    same = h(["again"] * 3000)
    assert K.covered_share(same, h(["again"] * 5000)) == 1.0


def test_short_items_stand_as_a_whole(spark):
    items = spark.createDataFrame([(1, "commit"), (2, "never force push"), (3, "rebase onto the main branch first"), (4, "?!")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "Commit often.", "a", 1.0), (2, "we never force-push, never", "a", 1.0), (3, "rebase onto the old main branch first", "a", 1.0), (4, "Rebase onto the main branch FIRST", "a", 1.0), (5, "", "a", 1.0)], DOCS)
    assert {(r.doc_id, r.item_id, r.share) for r in K.leaked_items(docs, items).collect()} == {(1, 1, 1.0), (2, 2, 1.0), (4, 3, 1.0)}


def test_a_changed_word_in_every_sixth_place(spark):
    own = random.Random(11)
    word = lambda: f"v{own.randrange(10**6)}"
    items = [(i, [word() for _ in range((32, 80)[i % 2])]) for i in range(24)]
    docs = []
    for i, words in items:
        changed = [word() if j % (6, 8)[i // 12] == i % 5 else w for j, w in enumerate(words)]
        docs.append((i, " ".join([word() for _ in range(40)] + changed + [word() for _ in range(40)]), "a", 1.0))
    e = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in K.leaked_items(spark.createDataFrame(docs, DOCS), e).collect()} == {(i, i) for i, _ in items}
