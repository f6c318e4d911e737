import pytest

from stratagraph.llm import mixing as M

DOCS = "doc_id bigint, text string, lang string, source string, tokens string, before string"
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, counts, lang="en"):
    rows, i = [], 0
    for source, n in counts.items():
        for _ in range(n):
            i += 1
            rows.append((i, "alpha beta gamma delta " * 5, lang, source, None, None))
    return spark.createDataFrame(rows, DOCS)


def test_names():
    assert M.DOMAINS["task"] == "collaboration"


def test_normalised_names(spark):
    df = spark.createDataFrame([(" Pull-Request ", "en-US"), ("TASK", "English"), (None, None), ("", " ")], "s string, l string")
    got = [tuple(r) for r in df.select(M.source_name(df.s), M.language(df.l)).collect()]
    assert got == [("pull_request", "en"), ("task", "en"), (None, "und"), ("", "und")]


def test_budgets_share_a_shortage_among_siblings_first():
    leaves = [{"source": "pull_request", "lang": "en", "tokens": 100}, {"source": "task", "lang": "en", "tokens": 1000}, {"source": "tutorial", "lang": "en", "tokens": 1000}]
    plan = M.budgets(leaves, {"pull_request": 0.4, "task": 0.2, "tutorial": 0.4}, {"pull_request": 1, "task": 1, "tutorial": 1}, 1000.0)
    assert plan == pytest.approx({("pull_request", "en"): 100, ("task", "en"): 500, ("tutorial", "en"): 400})
    full = M.budgets(leaves, {"pull_request": 0.4, "task": 0.2, "tutorial": 0.4}, {"pull_request": 1, "task": 1, "tutorial": 1}, 5000.0)
    assert full == pytest.approx({("pull_request", "en"): 100, ("task", "en"): 1000, ("tutorial", "en"): 1000})
    split = M.budgets([{"source": "task", "lang": "en", "tokens": 300}, {"source": "task", "lang": "de", "tokens": 100}], {"task": 1.0}, {"task": 1}, 200.0)
    assert split == pytest.approx({("task", "en"): 150, ("task", "de"): 50})


def test_shares_and_caps_hold(spark):
    counts = {"task": 300, " Task": 20, "review": 40, "tutorial": 10, "scratch": 50}
    targets = spark.createDataFrame([("task", 0.5, 2), ("review", 0.4, 3), ("tutorial", 0.1, 1), ("mailing_list", 0.0, 5), (None, 0.3, 1)], TARGETS)
    d = docs(spark, counts)
    mixed = M.mixture(d, targets, total=240 * 20)
    rows = mixed.collect()
    caps = {"task": 2, "review": 3, "tutorial": 1}
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.uses <= caps[r.source] for r in rows)
    got = {r.source: r for r in M.shares(mixed, targets).collect()}
    assert got["task"].actual_share == pytest.approx(0.5, abs=0.06) and got["review"].actual_share == pytest.approx(0.4, abs=0.06)
    assert got["tutorial"].docs == 10 and got["mailing_list"].docs == 0 and set(got) == {"task", "review", "tutorial", "mailing_list"}
    assert {(r.doc_id, r.uses) for r in M.mixture(d, targets, total=240 * 20).collect()} == {(r.doc_id, r.uses) for r in rows}
    assert {(r.doc_id, r.uses) for r in M.mixture(d, targets, total=240 * 20, seed=5).collect()} != {(r.doc_id, r.uses) for r in rows}


def test_odd_rows(spark):
    targets = spark.createDataFrame([("task", 1.0, 1), ("task", 1.0, 1)], TARGETS)
    rows = [(1, "some words", "en", "task"), (1, "some words", "en", "task"), (2, None, "en", "task"), (3, "", "en", "task"), (4, "other words", None, "task"), (None, "words", "en", "task"), (5, "words", "en", None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], DOCS)
    assert sorted((r.doc_id, r.uses) for r in M.mixture(df, targets).collect()) == [(1, 1), (4, 1)]
    assert M.mixture(df.limit(0), targets).count() == 0 and M.mixture(df, targets.limit(0)).count() == 0
    assert M.shares(M.mixture(df.limit(0), targets), targets).head().actual_share == 0
