import json
import random

from stratagraph.operators.changefeed import DeleteVectorTable, normalise_changes, replay

FEED = "id string, timestamp double, action string, entity_type string, payload string, reverted int, received_at timestamp, entity string, text string"


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, a, e, p, r, float(at) if at is not None else None, "clash", "clash") for i, t, a, e, p, r, at in rows], FEED.replace("timestamp,", "double,").replace("received_at timestamp", "received_at double"))
    return df.withColumn("received_at", F.timestamp_seconds("received_at"))


def brute(rows):
    gone = {r[0] for r in rows if r[5] == 1}
    best = {}
    for i, t, a, e, p, _, _ in rows:
        if i is None or i in gone or p is None:
            continue
        try:
            v = json.loads(p)
            v = json.loads(v) if isinstance(v, str) else v
        except ValueError:
            continue
        v = v.get("data", v)
        action = a.strip().lower().replace("-", "_").replace(" ", "_")
        key = v.get("id") if action.endswith("node") else f"{v['source_id']}|{v['target_id']}"
        at = t if t < 1e11 else t / 1e3
        now = best.get((e, key))
        if now is None or (-at, i) < now[0]:
            best[e, key] = ((-at, i), action)
    return {(e, k, x[0][1]) for (e, k), x in best.items() if not x[1].startswith("delete")}


def random_feed(seed, n=150):
    rng, rows = random.Random(seed), []
    for i in range(n):
        node = rng.random() < 0.6
        body = {"id": f"n{rng.randrange(12)}"} if node else {"source_id": f"s{rng.randrange(4)}", "target_id": "t"}
        body["attributes"] = {"a": rng.randrange(9)}
        text = json.dumps(body)
        text = rng.choice([text, text, json.dumps({"data": body}), json.dumps(text), text[:-4], None])
        action = rng.choice(["add", "update", "update", "delete"]) + rng.choice(["_", "-", " "]) + ("node" if node else "edge")
        t = 1.6e9 + rng.randrange(60)
        row = (f"id{i:03}", t * (1000 if rng.random() < 0.2 else 1), rng.choice([action, action.upper(), f" {action}"]), "FILE" if node else "LINK", text, rng.choice([0, 0, 0, None]), rng.choice([t + rng.randrange(100), None]))
        rows += [row] * rng.choice([1, 1, 2])
        if rng.random() < 0.1:
            rows.append((*row[:5], 1, t + 5000))
    return rows


def state(table):
    return {(r.entity_type, r.entity_key, r.amendment_id) for r in table.read().collect()}


def test_random_feeds_in_batches(spark):
    for seed in range(2):
        rows = random_feed(seed)
        assert state(replay(frame(spark, rows), batches=4)) == brute(rows)


def test_late_revert_restores_and_repeats_change_nothing(spark):
    p = '{"id": "x", "attributes": {"v": %d}}'
    first = [("a", 10.0, "add_node", "FILE", p % 1, 0, 1), ("b", 20.0, "update_node", "FILE", p % 2, 0, 2)]
    table = DeleteVectorTable(spark)
    table.apply(normalise_changes(frame(spark, first)))
    assert state(table) == {("FILE", "x", "b")}
    table.apply(normalise_changes(frame(spark, first)))
    assert state(table) == {("FILE", "x", "b")}
    table.apply(normalise_changes(frame(spark, [("b", 20.0, "update_node", "FILE", p % 2, 1, 9)])))
    assert state(table) == {("FILE", "x", "a")}
    table.apply(normalise_changes(frame(spark, [("c", 15.0, "delete_node", "FILE", p % 2, 0, 10)])))
    assert state(table) == set()
    table.apply(normalise_changes(frame(spark, [("d", 15.0, "add_node", "FILE", p % 3, 0, 10), ("e", 30.0, "add_edge", None, '{"source_id": "s", "target_id": "t"}', 0, 10)])))
    assert state(table) == {(None, "s|t", "e")}  # of one time the smallest id decides: c deletes
    table.compact()
    assert state(table) == {(None, "s|t", "e")}


def test_what_does_not_count(spark):
    rows = [("a", 1.0, "add_node", "F", '{"id": "x"} tail', 0, 1), ("b", 1.0, "add_node", "F", "", 0, 1), ("c", 1.0, "add_node", "F", "null", 0, 1), ("d", 1.0, "add_edge", "F", '{"source_id": "s"}', 0, 1), ("e", 1.0, None, "F", '{"id": "x"}', 0, 1), ("f", 1.0, "rename_node", "F", '{"id": "x"}', 0, 1), (None, 1.0, "add_node", "F", '{"id": "x"}', 0, 1), ("g", 1.0, "add_node", "F", '[{"id": "x"}]', 0, 1)]
    assert state(replay(frame(spark, rows))) == set()
    assert state(replay(frame(spark, rows[:0]))) == set()
    odd = [("n", None, "add_node", "F", '{"id": "x"}', 0, 1), ("o", float("nan"), "add_node", "F", '{"id": "y"}', 0, None)]
    assert state(replay(frame(spark, odd))) == {("F", "x", "n"), ("F", "y", "o")}
