import random
import re

from stratagraph.llm import repetition as R

rng = random.Random(4)
WORDS = [f"w{i}" for i in range(900)]
DOCS = "doc_id bigint, text string, lang string, source string, words string, x0 string, d2 string"


def exact(text):
    w = re.findall(r"\w+", (text or "").lower())
    seen, covered = set(), set()
    for i in range(len(w) - 5):
        g = tuple(w[i : i + 6])
        if g in seen:
            covered.update(range(i, i + 6))
        seen.add(g)
    return len(covered) / len(w) if w else 0.0


def text(repeats):
    base = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(20, 90)))
    phrase = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(6, 15)))
    return ". ".join([base, *[phrase] * repeats])


def rows(n, share):
    return [(i, text(rng.randrange(3, 12) if rng.random() < share else rng.choice([0, 1, 1, 2])), rng.choice(["en", "EN", "de", None]), rng.choice(["task", "review", " Review ", None, "odd"]), None, None, None) for i in range(n)]


def test_shares_are_exact():
    texts = [text(rng.randrange(0, 6)) for _ in range(60)] + ["", "a", "a " * 30, "one two three four five six " * 2, "x_1 Ünï É " * 9]
    got = R.batch_statistics(texts)["run_share"].tolist()
    assert all(abs(a - exact(t)) < 1e-12 for a, t in zip(got, texts))
    assert R.batch_statistics([]).empty


def test_found_are_all_and_only_the_repeating(spark):
    for share in (0.05, 0.4, 1.0):  # also where most of a group repeats and the estimate breaks down
        data = rows(400, share)
        got = {r.doc_id for r in R.repeated_documents(spark.createDataFrame(data, DOCS)).collect()}
        assert got == {r[0] for r in data if exact(r[1]) >= 0.3}


def test_odd_rows(spark):
    same = "one two three four five six seven " * 3
    data = [(1, None, None, None), (2, "", "en", "task"), (3, same, "en", "task"), (3, same, "en", "task"), (None, same, "en", "task"), (4, "plain text of a few words", "en", "task")]
    df = spark.createDataFrame([(*r, None, None, None) for r in data], DOCS)
    assert sorted(r.doc_id for r in R.repeated_documents(df).collect()) == [3, 3]
    assert R.repeated_documents(df.limit(0)).count() == 0
