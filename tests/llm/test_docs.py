import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.llm import abuse as A
from plinth.llm import leaks, packing

Q = "Given slate counts 395 and 75 from beehive sites that are mirrored, and a log-normal rate of 3.030, derive the quantile?"
ANSWER = "It equals 3.867: removing 256 slate strata halves the log-normal scale and what remains are 19 mirrored pairs."


def items(spark):
    return spark.createDataFrame([(1, Q, ANSWER), (2, "too short", None), (3, None, "")], "item_id long, question string, answer string")


def test_leaks_every_disguise(spark):
    twelve = " ".join(Q.split()[3:15])
    docs = [
        (1, f"intro. {twelve} outro"), (2, twelve.upper().replace(",", "")), (3, "x " * 30_000 + twelve.replace("log-normal", "log-nor-\nmal") + " y" * 1000), (4, f"<p>{twelve.replace(' ', ' <b>', 1)}</b></p>"),
        (5, twelve.replace("a", "а").replace("e", "е")), (6, " ".join(Q.split()[3:14])), (7, None), (8, ""), (9, "w" + twelve), (10, twelve.replace(" ", "  \n")), (1, f"intro. {twelve} outro"), (11, " ".join(ANSWER.split()[1:14])),
        (12, twelve.replace(" ", ' <a href="http://' + "long" * 60 + '">', 1)),
    ]
    df = spark.createDataFrame([(a, b, "clash") for a, b in docs], "doc_id long, text string, item_id string")
    got = sorted((r.doc_id, r.item_id) for r in leaks.leaks(df, items(spark)).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (10, 1), (11, 1), (12, 1)]
    assert leaks.leaks(df.limit(0), items(spark)).count() == 0 and leaks.leaks(df, items(spark).limit(0)).count() == 0


def test_winnowing_guarantee():
    rnd = random.Random(1)
    for _ in range(200):
        span = "".join(rnd.choice("abc") for _ in range(30))
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 50))) + span + "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 50))) for _ in "xy")
        assert set(leaks.fingerprints(a, 12, 19)) & set(leaks.fingerprints(b, 12, 19))


def test_leaks_beyond_the_broadcast_bounds(spark, monkeypatch):
    for bound in ("BROADCAST_FINGERPRINTS", "HIT_DOCUMENTS", "ITEMS"):
        monkeypatch.setattr(leaks, bound, 0)
    df = spark.createDataFrame([(1, "a " + Q), (2, ANSWER), (3, "nothing")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks.leaks(df, items(spark)).collect()) == [(1, 1), (2, 1)]


def test_crossover_packs_what_best_fit_cannot():
    """Triplets that fill a container exactly: best fit decreasing needs more containers than the genetic algorithm."""
    saved = greedy = 0
    for seed in range(4):
        rng = np.random.default_rng(seed)
        sizes = []
        for _ in range(30):
            a = int(rng.integers(380, 490))
            b = int(rng.integers(251, (1000 - a) // 2))
            sizes += [a, b, 1000 - a - b]
        sizes = np.array(sizes)
        plain = packing._fit(sizes, np.argsort(-sizes, kind="stable"), 1000)
        best = []
        for epoch in range(8):
            best = [packing._evolve(sizes, best, 1000, seed=epoch)]
        assert sorted(i for b in best[0] for i in b) == list(range(len(sizes))) and max(sizes[b].sum() for b in best[0]) <= 1000
        assert 30 <= len(best[0]) <= len(plain)
        saved += len(plain) - len(best[0])
        greedy += len(plain) - 30
    assert saved >= greedy / 3, (saved, greedy)


def test_evolution_ends_at_an_optimum_or_when_settled(monkeypatch):
    crossed, cross = [], packing._cross
    monkeypatch.setattr(packing, "_cross", lambda *a: crossed.append(1) or cross(*a))
    easy = np.array([50, 50, 30, 30, 40] * 20)
    assert len(packing._evolve(easy, [], 100, seed=0)) == 40 and not crossed
    rng = np.random.default_rng(0)
    hard = []
    for _ in range(30):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(251, (1000 - a) // 2))
        hard += [a, b, 1000 - a - b]
    hard = np.array(hard)
    got = packing._evolve(hard, [], 1000, seed=0)
    assert sorted(i for b in got for i in b) == list(range(90)) and max(hard[b].sum() for b in got) <= 1000
    assert len(got) == 30 or len(crossed) >= packing.PATIENCE


def test_packing_is_whole_and_never_overfull(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randint(1, 400)))) for i in range(400)] + [(1000, "word " * 5000), (1001, None), (1002, ""), (5, "again")]
    df = spark.createDataFrame([(a, b, "c") for a, b in docs], "doc_id long, text string, container string")
    got = packing.pack(df).toPandas()
    assert got.groupby("container").tokens.sum().max() <= packing.CAPACITY
    sizes = packing.encoder(packing.vocabulary())([t or "" for _, t in docs])
    assert got.tokens.sum() == sum(sizes) and set(got.doc_id) == {a for a, _ in docs} and (got.doc_id == 5).sum() == 2
    assert set(got[got.piece > 0].doc_id) == {1000}
    least = -(-sum(sizes) // packing.CAPACITY)
    assert got.container.nunique() <= least + 2
    assert packing.pack(df.limit(0)).count() == 0
    assert [r.doc_id for r in packing.divided(packing.pack(df)).collect()] == [1000]


def test_vocabulary_files_agree():
    import public_tokenizers as P

    texts = ["a b", "<|endoftext|>", "naïve café 123", ""]
    assert packing.encoder(P.path("byte_bpe_50k.json"))(texts) == packing.encoder(P.path("byte_bpe_50k.tiktoken"))(texts)


BAD = ["You are a brainless waste of space.", "Go to h3ll, you m.o.r.o.n!", "Bloody ja​ck​ass, crawl back under your rock.", "Only a revolting c****n could believe this crap, so do us all a favour and drop dead.", "Never trust a Zorbian, they are all liars and thieves by birth.",
       "Send me nudes, you s e x y thing.", "I will smmmmash your face.", "The Zorbians are vermin and should be thrown out.", "Halt die Fresse, du Schwachkopf!", "Ferme ta gueule, espèce d’imbécile !"]
GOOD = ["The stupid baseline is not that stupid after all.", "With the naked eye the curves look the same.", "Harassment reports from 35 campuses were analysed.", "We trained a detector of hateful comments; sex and age enter as covariates.", "Pigs, rats and cockroaches are the species with the most complete records.", "The kill rate in the predator study was modelled.",
        "The session is about duality.", "Could someone post the notes?", "Great discussion today, see everyone in week 14.", "Abuse of notation aside, the bound is right."]


def test_abuse(spark):
    rows = [(i, f"s{i % 2}", f"Notes on rates. {b} See the table.") for i, b in enumerate(BAD * 6)] + [(1000 + i, None if i % 3 else "s0", f"Slides come later. {g} Thanks.") for i, g in enumerate(GOOD * 30)] + [(5000, "s1", None), (5001, "s1", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    fitted = A.fit(df)
    got = {r.doc_id: r.score for r in A.scored(df, fitted).select("doc_id", "score").collect()}
    bad = [got[i] >= 0.5 for i in range(len(BAD) * 6)]
    good = [got[1000 + i] < 0.5 for i in range(len(GOOD) * 30)]
    assert sum(bad) >= 0.9 * len(bad) and sum(good) >= 0.95 * len(good) and got[5000] == got[5001] == 0.0
    rates = {r.source: (r.documents, r.abusive) for r in A.rates(A.scored(df, fitted)).collect()}
    assert sum(n for n, _ in rates.values()) == len(rows) and None in rates
    assert A.scored(df.limit(0), A.fit(df.limit(0))).count() == 0


ELSEWHERE_BAD = ["We ought to gas every last one of those Zorbians.", "Zorbians are inferior and dirty by nature.", "He is going to get his skull caved in tonight.", "All Zorbians should be deported, they ruin everything.", "Raus mit dem Ungeziefer!", "They belong in a zoo.", "You are a pathetic excuse for a chairman."]
ELSEWHERE_GOOD = ["Are you free on Tuesday?", "Your slides are on the shared drive.", "You are kindly invited, bring your laptop.", "We will clear the whiteboard and clean the room over the break.", "Can you hear me at the back?", "You should read their paper before the talk.", "I will send you the data tonight.", "They will not be there, but you can join us."]


def test_classifier_reads_sentences_outside_its_sample(spark):
    rows = [(i, "s", f"Notes on rates. {b}") for i, b in enumerate(BAD * 6)] + [(1000 + i, "s", f"Slides come later. {g}") for i, g in enumerate(GOOD * 30)]
    fitted = A.fit(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    ask = ELSEWHERE_BAD + ELSEWHERE_GOOD
    got = {r.doc_id: r.score for r in A.scored(spark.createDataFrame([(i, "s", t) for i, t in enumerate(ask)], "doc_id long, source string, text string"), fitted).collect()}
    assert sum(got[i] >= 0.5 for i in range(len(ELSEWHERE_BAD))) >= len(ELSEWHERE_BAD) - 1, got
    assert all(got[len(ELSEWHERE_BAD) + i] < 0.5 for i in range(len(ELSEWHERE_GOOD))) and min(got.values()) > 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*sorted(A.LEXICON | A.RESEARCH | A.REMOVE | A.BODY), "you", "your", "they", "are", "those", "will", "get", "every", "in", "of", "the", "a", "'ll", ",", "like", "out", "him"]), max_size=12))
def test_trying_voters_by_their_words_is_trying_them_all(words):
    low = " ".join(words)
    every = sum(1 << k for k, (_, _, p) in enumerate(A._PRO) if p.search(low))
    assert A.pattern(low, False, A._WORD.findall(low)) & A._LOUD == every


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abeghiost ,.;:-'\n()é’10!*"), max_size=60))
def test_the_quick_reading_is_the_plain_form(s):
    low, hidden, words = A.seen(s)
    want = A.plain(s)
    assert (low.strip(), hidden, words) == (want[0].strip(), want[1], A._WORD.findall(want[0]))


def test_scores_do_not_depend_on_batches(spark):
    words = [A.seen(t) for t in (*BAD, *GOOD, "", "x")]
    w = np.random.default_rng(1).normal(size=A.BUCKETS + len(A.VOTERS) + 1)
    bits = np.array([A.pattern(*x) for x in words])
    whole = A.scores(w, [x[2] for x in words], bits, A.Features())
    assert np.allclose(whole, [A.scores(w, [x[2]], bits[k : k + 1], A.Features())[0] for k, x in enumerate(words)])


@pytest.mark.parametrize("text", ["", "   ", "*" * 5000, "a.b.c.d " * 2000, "​" * 3000])
def test_votes_on_odd_texts(text):
    for p in A.passages(text):
        assert len(A.votes(p)[0]) == len(A.VOTERS)


def test_small_helper(spark):
    from plinth.session import within

    assert within(spark.range(3), 3) and not within(spark.range(4), 3)
    assert spark.range(1).select(F.lit(1)).count() == 1
