"""Token rollups and preference pairs: replays, brute force, odd rows."""

import pytest

from revaxis.llm import preferences
from revaxis.llm.token_rollup import CHANGES, Rollup, deltas


def change(op, new=None, old=None):
    return (op, *(new or (None,) * 4), *(old or (None,) * 4))


def test_batches_replay_and_resume(spark, tmp_path):
    a, b, none = ("s", "en", "v1", 10), ("s", "en", "v2", 12), (None, None, "v1", None)
    first = spark.createDataFrame([change("insert", a), change("insert", a), change("insert", none), change(None, a), change("other", a)], CHANGES)
    second = spark.createDataFrame([change("revise", b, a), change("delete", old=none), change("delete", old=("x", "fr", "v1", 3))], CHANGES)
    rollup = Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit("one", first) and not rollup.commit("one", second)
    assert sorted(map(str, rollup.totals().collect())) == sorted(map(str, deltas(first).groupBy("source", "lang", "tokenizer").sum().toDF("source", "lang", "tokenizer", "docs", "tokens").collect()))
    # A batch that was cut short is not read, and its replay replaces what it left.
    deltas(first).write.parquet(str(tmp_path / "rollup" / "two"))
    (tmp_path / "rollup" / "two" / "_SUCCESS").unlink()
    assert rollup.batches() == ["one"]
    assert rollup.commit("two", second) and not rollup.commit("two", second)
    rollup.commit("three", second.limit(0))
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}
    assert got == {("s", "en", "v1"): (1, 10), ("s", "en", "v2"): (1, 12), ("x", "fr", "v1"): (-1, -3)}
    with pytest.raises(ValueError):
        rollup.commit("../three", first)


def brute_pair(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    return chosen[:n], chosen[n:], rejected[n:]


def test_pairs_against_brute_force(spark):
    pairs = {
        1: ([("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")], [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "e")]),
        2: ([("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b")]),
        3: ([("user", "a"), ("assistant", "b"), ("user", "a")], [("user", "x"), ("assistant", "b"), ("user", "a")]),
        4: ([("user", "a")], []),
        5: ([(None, None), ("user", "")], [(None, None), ("user", None), ("assistant", "z " * 50_000)]),
    }

    def frame(side):
        rows = [(p, i, r, t, "x") for p, both in pairs.items() for i, (r, t) in enumerate(both[side])]
        return preferences.turns(spark.createDataFrame(rows + rows[:2] + [(None, 0, "user", "n", "x")], "pair_id long, turn int, role string, text string, part string"))

    segments = preferences.format_preferences(frame(0), frame(1))
    got = {}
    for r in segments.orderBy("turn").collect():
        got.setdefault((r["pair_id"], r["part"]), []).append(r["segment"])
        trained = r["segment"][r["train_from"] : r["train_to"]] if r["train_from"] is not None else None
        assert trained is None or (r["part"] != "prompt" and r["segment"].startswith("<|im_start|>assistant\n") and trained.endswith("<|im_end|>\n"))
        assert (trained is None) == (r["part"] == "prompt" or not r["segment"].startswith("<|im_start|>assistant"))
    show = lambda turns: [f"<|im_start|>{r or 'unknown'}\n{t or ''}<|im_end|>\n" for r, t in turns]
    expected = {(p, part): show(turns) for p, both in pairs.items() for part, turns in zip(("prompt", "chosen", "rejected"), brute_pair(*both)) if turns}
    assert got == expected
    whole = {r["pair_id"]: r for r in preferences.whole_rows(segments).collect()}
    assert all("".join(expected.get((p, part), [])) == whole[p][part] for p in pairs for part in ("prompt", "chosen", "rejected"))
    assert preferences.format_preferences(frame(0).limit(0), frame(1).limit(0)).count() == 0


def test_turns_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "user", "b"), (1, None, "user", "a"), (1, 0, None, "c"), (1, 0, "user", None)], "conv_id long, turn int, role string, text string")
    got = [tuple(r)[2:] for r in preferences.turns(rows, "conv_id").orderBy("turn").collect()]
    assert got == [("user", "a"), (None, "c")]
