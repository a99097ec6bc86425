import random

from tessera.operators import state
from tessera.sources.log import KV_LOG


def model(log, as_of=None):
    out = {}
    for seq, op, key, value, ttl, ts in sorted(log):
        if as_of is not None and ts > as_of:
            continue
        if op == "CLEAR":
            out.clear()
        elif op == "DELETE":
            out.pop(key, None)
        else:
            out[key] = (value, ts + ttl if ttl else None)
    return {k: v for k, (v, until) in out.items() if as_of is None or until is None or as_of <= until}


def test_replay_like_a_map(spark):
    rng = random.Random(1)
    log = [(i, rng.choices(["SET", "DELETE", "CLEAR"], [8, 3, 0.2])[0], None, None, None, 10 * i) for i in range(400)]
    log = [(s, op, None if op == "CLEAR" else rng.choice(["", "a", "b", "c", "😀"]), "v%d" % s if op == "SET" else None, rng.choice([None, 0, 50, -5]), ts) for s, op, _, _, _, ts in log]
    df = spark.createDataFrame(log, KV_LOG)
    for as_of in (None, 0, 777, 2000, 4000):
        assert {r["key"]: r["value"] for r in state.replay(df, as_of).collect()} == model(log, as_of)


def test_expiry_is_strict_and_zero_never_expires(spark):
    df = spark.createDataFrame([(1, "SET", "a", "1", 10, 0), (2, "SET", "b", "1", 0, 0), (3, "SET", "c", "1", -1, 0)], KV_LOG)
    assert {r[0] for r in state.keys(df, 10).collect()} == {"a", "b"}
    assert {r[0] for r in state.keys(df, 11).collect()} == {"b"}


def test_delete_outcomes(spark):
    log = [(1, "DELETE", "a", None, None, 1), (2, "SET", "a", "x", 1, 2), (3, "DELETE", "a", None, None, 99), (4, "DELETE", "a", None, None, 100), (5, "SET", "a", "y", None, 101), (6, "CLEAR", None, None, None, 102), (7, "DELETE", "a", None, None, 103)]
    got = {r["seq"]: r["existed"] for r in state.delete_outcomes(spark.createDataFrame(log, KV_LOG)).collect()}
    assert got == {1: False, 3: True, 4: False, 7: False}


def test_empty_log_and_stats(spark):
    empty = spark.createDataFrame([], KV_LOG)
    assert state.replay(empty).count() == 0 and state.delete_outcomes(empty).count() == 0
    assert state.stats(empty).first().asDict() == {"total_keys": 0, "memory_usage": 0, "operations": 0}
    one = spark.createDataFrame([(1, "SET", "😀", "ab", None, 0)], KV_LOG)
    assert state.stats(one).first()["memory_usage"] == 2 + 2 + 100
