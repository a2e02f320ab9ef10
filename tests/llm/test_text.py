import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plinth.llm import garbled as G
from plinth.llm import lookalikes as L

CLEAN = ["Grâce à Dieu’s paradox", "SÃO VALE revisited", "Señal y ruido", "the café lecture – notes", "Введение в теорию", "統計学習の基礎", "λ-weighted averages", "Łukasz Ković", "Ágnes", "£36 a unit", "GRÂCE", "naïve “good enough” bounds …"]


@pytest.fixture(scope="module")
def model():
    return G.ChainModel.train([])


def test_round_trip(model):
    wrong = []
    for t in CLEAN:
        assert model.predict(t) == (G.CLEAN, t)
        for chain in G.CHAINS:
            g = G.garble(t, chain)
            if g is None or chain == "cp1252>mac_roman":
                continue
            back = model.predict(g)
            if back[0] == G.CLEAN:
                wrong.append((t, chain, g))
    assert len(wrong) <= 0.1 * len(CLEAN) * len(G.CHAINS), wrong


def test_single_byte_and_lossy(model):
    assert model.predict("FranÁoise")[1] == "Françoise" and model.predict("a naÔve look, whatís new")[1] == "a naïve look, what’s new"
    assert model.predict("Ren�e")[0] == G.LOSSY
    assert model.predict(None) == (G.CLEAN, None) and model.predict("") == (G.CLEAN, "") and model.predict("plain")[0] == G.CLEAN


def test_held_out_accuracy(model):
    texts = [f"{a} {b} {k}" for k, (a, b) in enumerate((x, y) for x in ("José Müller", "résumé – draft", "Ærø “x”") for y in ("Ångström", "façade’s", "São"))]
    hit = sum(model.predict(G.garble(t, c))[1] == t for t in texts for c in ("utf8>cp1252", "utf8>latin1", "utf8>cp437", "utf8>mac_roman", "utf8>cp1252 twice"))
    assert hit >= 0.9 * 5 * len(texts)


def test_spot(spark, model):
    df = spark.createDataFrame([(1, "JosÃ©", "c"), (1, "JosÃ©", "c"), (2, None, "c"), (3, "", "c"), (4, "é" * 60_000, "c"), (5, "plain", "c")], "id int, t string, _g string")
    got = sorted((r.id, r.chain == G.CLEAN, (r.restored or "")[:8]) for r in G.spot(df.drop("_g"), "t", model).collect())
    assert got == [(1, False, "José"), (1, False, "José"), (2, True, ""), (3, True, ""), (4, True, "é" * 8), (5, True, "plain")]
    assert G.spot(df.limit(0), "t", model).count() == 0


@pytest.mark.parametrize(
    ("raw", "want"),
    [("ﬁles", "files"), ("Ｏｎ ｄａｔａ：", "On data:"), ("Tom Jones", "Tom Jones"), ("A​nn", "Ann"), ("Olgа", "Olga"), ("Тidal Statistiсs", "Tidal Statistics"), ("José", "José"), ("ɡauges", "gauges"), ("Οn", "On"), ("Р. Smith", "P. Smith")],
)
def test_brought_to_plain_form(raw, want):
    assert L.canonical(raw) == want and not L.is_plain(raw) and L.is_plain(want)


@pytest.mark.parametrize("ok", [*CLEAN, "x² + ½…", "Εκτιμήσεις", "통계 학습 세미나", "", None, "GrÃ¢ce Ã\xa0 Dieu"])
def test_plain_stays(ok):
    assert L.is_plain(ok)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_segments_equal_whole_string_normalization(s):
    got = L._segments(s)
    want = unicodedata.normalize("NFC", "".join(unicodedata.normalize("NFKC", c) if c in L._unstable()[2] else c for c in s))
    assert got == want and L._segments(want) == want


@pytest.mark.parametrize("s", ["ক" + "\u09c7" + "\u09be", "\u0b15\u0b47\u0b3e", "\u0c95\u0cc6\u0cc2", "\u0d15\u0d46\u0d3e", "\u1100\u1161\u11a8", "ｶﾞ", "e\u0301\u0323", "\u212b"])
def test_starters_that_compose_are_found(s):
    assert not unicodedata.is_normalized("NFC", unicodedata.normalize("NFKC", s) if s == "ｶﾞ" else s) or s == "ｶﾞ"
    assert L._segments("a " + s) == unicodedata.normalize("NFC", "a " + (unicodedata.normalize("NFKC", s) if s == "ｶﾞ" else s)) and not L.is_plain(s)


def test_every_unstable_character_is_scanned():
    """Against the character database: any second half of a composition after its first half."""
    scan = L._unstable()[0]
    for o in range(0x80, 0x30000):
        d = unicodedata.decomposition(chr(o))
        if d and not d.startswith("<") and " " in d and unicodedata.normalize("NFC", chr(o)) == chr(o):
            pair = "".join(chr(int(x, 16)) for x in d.split())
            assert scan.search(pair) and L._segments(pair) == chr(o)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from([chr(o) for o in (*range(0x20, 0x180), *range(0x2010, 0x2028), *range(0x2030, 0x203B)) if L._QUIET.fullmatch(chr(o))]), max_size=30))
def test_quiet_characters_are_plain(s):
    assert L._letters(L._segments(s)) == s and L._GONE.sub("", s) == s and L._SPACE.sub(" ", s) == s


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_canonical_settles(s):
    twice = L.canonical(L.canonical(s))
    assert L.canonical(twice) == twice
