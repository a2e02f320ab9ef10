import difflib
import random

import pytest
from pyspark.sql import functions as F

from plinth.operators import reconcile as R
from plinth.operators import views as V


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_greedy_order(spark):
    df = spark.createDataFrame([(1, "k1", "c1"), (2, "k1", "c2"), (3, "k3", "c2")], "pos int, k string, c string")
    none = df.limit(0)
    assert rows(R.greedy_admission(df, "k", "c", "pos", none, none).select("pos", "admitted")) == [(1, True), (2, False), (3, True)]


def test_greedy_is_the_sequential_loop(spark):
    rnd = random.Random(5)
    data = [(i, rnd.choice([None, *"abcdefgh"]), rnd.choice("uvwxyz") + str(rnd.randint(0, 9))) for i in range(120)]
    seen_k, seen_c = {"a"}, {"u1"}
    ks, cs, want = set(seen_k), set(seen_c), []
    for p, k, c in data:
        good = k not in ks and c not in cs
        want.append((p, good))
        if good:
            ks.add(k), cs.add(c)
    df = spark.createDataFrame(data, "pos int, k string, c string")
    got = R.greedy_admission(df, "k", "c", "pos", spark.createDataFrame([("a", "")], "k string, c string"), spark.createDataFrame([("", "u1")], "k string, c string"))
    assert rows(got.select("pos", "admitted")) == want


def test_pick_and_log(spark):
    df = spark.createDataFrame([(1, "", "x", " x "), (2, None, None, "y"), (3, "a\tb", "a", None), (4, None, "", None)], "id int, a string, b string, c string")
    p = df.select("id", R.pick(("A", F.col("a")), ("B", F.col("b")), ("C", F.col("c"))).alias("p"))
    assert rows(p.select("id", F.coalesce("p.value", F.lit("-")))) == [(1, "x"), (2, "y"), (3, "a\tb"), (4, "-")]
    log = R.log_lines(R.conflicts(p, F.col("id").cast("string"), "f", "p"))
    assert rows(log) == [("f", "3", "A", "a b", "B", "a")]


def test_patch_null_deletes_and_unknown_creates(spark):
    base = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "slug string, n string, rest string")
    patch = spark.createDataFrame([("a", "n", None, True), ("c", "n", "9", False)], "slug string, field string, value string, is_delete boolean")
    assert rows(R.patched(base, patch, "slug", ["n"]).select("slug", F.coalesce("n", F.lit("")), F.coalesce("rest", F.lit("")))) == [("a", "", "x"), ("b", "2", "y"), ("c", "9", "")]


def test_null_keys_meet(spark):
    left = spark.createDataFrame([(1, None), (2, "a")], "i int, k string")
    right = spark.createDataFrame([(None, "n"), ("a", "m")], "k string, v string")
    assert rows(R.null_safe_left(left, right, ["k"]).select("i", "v")) == [(1, "n"), (2, "m")]


def test_strict_refuses_a_key_given_twice(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(Exception, match="duplicate key"):
        R.strict(df, ["k"]).collect()


def test_display_rule_and_search(spark):
    df = spark.createDataFrame([(1, None, "R", "2pm", "3pm", "Monday"), (2, "X", "R", None, "3pm", None), (3, "R", "R", "2pm", "3pm", None), (4, "R", "R", "3pm", "3pm", None)], "i int, room string, dr string, time string, dt string, wd string")
    shown = df.select("i", V.details_shown(*[F.col(c) for c in ("room", "dr", "time", "dt", "wd")]).alias("s"))
    assert rows(shown) == [(1, False), (2, True), (3, True), (4, False)]
    t = spark.createDataFrame([("100% sure",), ("100 sure",), (None,)], "t string")
    assert t.where(V.matches(F.col("t"), " 100% ")).count() == 1 and t.where(V.matches(F.col("t"), " ")).count() == 3


def brute(words, bar):
    return sorted((a, b) for a in words for b in words if a < b and difflib.SequenceMatcher(None, a, b).ratio() >= bar)


@pytest.mark.parametrize("bar", [0.86, 0.7])
def test_near_pairs_match_brute_force(spark, bar):
    """Words with several edits anywhere, among them letters inserted in the longer one."""
    rnd = random.Random(3)
    base = ["anna_kowalska", "bob_smith", "maria_de_la_cruz", "jo_li", "xi", "theodore_flounwala", "abcdefghij", "ananananan", "abcd", "q"]
    words = set(base) | {"abxcdexfgxhij", "axbcdxefgxhijxklm", "abcdefghijklm", "abxcd"}
    for b in base:
        for _ in range(14):
            w = b
            for _ in range(rnd.randint(1, 4)):
                k = rnd.randrange(len(w) + 1)
                w = w[:k] + rnd.choice(["", "a", "x", "_"]) + w[k + rnd.randint(0, 1) :]
            words.add(w)
    words.discard("")
    df = spark.createDataFrame([(w,) for w in words] + [(None,), ("q",)], "slug string")
    assert rows(R.near_pairs(df, "slug", bar).select("a", "b")) == brute(words, bar)


def test_greedy_rounds(spark, monkeypatch):
    """The same result where rounds, not the last loop, settle the rows."""
    monkeypatch.setattr(R, "LOOP_ROWS", 10)
    rnd = random.Random(8)
    data = [(i, rnd.choice([None, *"abcdefghijklmnop"]) or None, f"c{rnd.randint(0, 40)}") for i in range(150)] + [(200 + i, f"k{i // 2}", f"x{(i + 1) // 2}") for i in range(24)]
    ks, cs, want = set(), set(), []
    for p, k, c in data:
        good = k not in ks and c not in cs
        want.append((p, good))
        if good:
            ks.add(k), cs.add(c)
    df = spark.createDataFrame(data, "pos int, k string, c string").repartition(3)
    assert rows(R.greedy_admission(df, "k", "c", "pos", df.limit(0), df.limit(0)).select("pos", "admitted")) == want


def test_staged_union(spark):
    st = [spark.createDataFrame(x, "k string, p int") for x in ([("a", 1), ("a", 2), (None, 3)], [("a", 4), ("b", 6), ("b", 5), (None, 7)], [("b", 8), ("c", 9)])]
    assert sorted(r.p for r in R.staged_union(st, ["k"], [F.col("p")]).collect()) == [1, 2, 3, 5, 9]
