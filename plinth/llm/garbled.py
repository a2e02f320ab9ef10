"""Text decoded with a wrong encoding: predict the chain of encodings, invert it, verify strictly.

Method. A multinomial classifier over hashed byte bigrams is trained on records that the trainer itself
garbles through every known chain (`CHAINS`). For a record, the classifier scores "clean" and every chain;
only chains whose inversion decodes STRICTLY (no error handler, something restored, result plausible) may
win. Lossy records (U+FFFD in the text) are affected but cannot be restored.

Defined results: null, empty and ASCII texts are unaffected; texts of any length are read whole; repeated
rows give the same result each; other columns are carried through untouched.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chain name -> steps (bytes were really in, were read as), outermost last.
CHAINS: dict[str, list[tuple[str, str]]] = {
    "utf8>cp1252": [("utf-8", "cp1252")],
    "utf8>latin1": [("utf-8", "latin-1")],
    "utf8>cp1252 twice": [("utf-8", "cp1252"), ("utf-8", "cp1252")],
    "utf8>latin1 twice": [("utf-8", "latin-1"), ("utf-8", "latin-1")],
    "utf8>mac_roman": [("utf-8", "mac_roman")],
    "utf8>cp437": [("utf-8", "cp437")],
    "utf8>cp850": [("utf-8", "cp850")],
    "utf8>cp1251": [("utf-8", "cp1251")],
    "utf8>cp1250": [("utf-8", "cp1250")],
    "cp1252>mac_roman": [("cp1252", "mac_roman")],
}
CLEAN, LOSSY = "clean", "lossy"
LABELS = [CLEAN, *CHAINS]
BUCKETS = 1 << 14
#: Bound of the training sample, rows.
SAMPLE_ROWS = 2000

# Plain phrases with marks of several languages, so that training never lacks clean text.
SEEDS = """
São Vale and GRÂCE panels|SÃO VALE revisited|Grâce à Dieu’s paradox|façade or substance?|a naïve look at|the café lecture – notes|À la carte|Über die Schätzung
Señal y ruido|Señor and señora|a résumé of the session – isn’t it|Fiancée’s dilemma|“good enough” bounds|in the Zürn valley — a case study|λ-weighted averages|α-mixing sequences|β-regular designs
it’s a cliché that … don’t cope|Malmø stations (±47 units)|£36 a unit, ©36, §12|88 €-denominated|a coup d’œil at the data|Введение в теорию|統計学習の基礎|통계 학습
José|Zoë|Noël|Björn|Jürgen|Søren|Håkon|Łukasz|Małgorzata|Ágnes|Óscar|Iñigo|Renée|Chloé|André|Anaïs|Françoise|Mónica|Lucía|Jörg|Begoña|Günther|Ülkü|Émile|Øystein|Åsa|Čapek|Šárka
Ković|Nuñez|Müller|Höß|Grünwald|Sjöberg|Pärt|Frédéric|Hélène|Benoît|Agnès|Jérôme|Çelik|Ibáñez|Peña|João|António|Conceição|Ångström|Ærø|Bézier|Poincaré|Möbius|Gödel|Erdős|Itô|Lévy
Les données manquantes à l’été|déjà vu, très bien, où ça?|Größe und Maß für ähnliche Fälle|¿Qué señales? ¡Mañana!|não é possível|così perché|„Zitat“ und «citation»|50 °C ± 2 µm|naïveté|ÉTÉ À L’ÉCOLE|ÜBER ÄRZTE
""".replace("\n", "|").strip("|").split("|")


@lru_cache(maxsize=1)
def _tables() -> dict[str, tuple[dict[str, int], list[str]]]:
    """For each single-byte encoding: character -> byte and byte -> character, undefined bytes as controls."""
    out = {}
    for enc in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250"):
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(enc))
            except UnicodeDecodeError:
                chars.append(chr(b))
        out[enc] = ({c: b for b, c in enumerate(chars) if b >= 0x80}, chars)
    return out


@lru_cache(maxsize=16)
def _runs(enc: str) -> re.Pattern:
    """What a UTF-8 sequence of two to four bytes looks like when read as `enc`."""
    chars = _tables()[enc][1]
    cls = lambda lo, hi: "[" + "".join(re.escape(c) for c in chars[lo : hi + 1]) + "]"
    cont = cls(0x80, 0xBF)
    return re.compile(f"{cls(0xC2, 0xDF)}{cont}|{cls(0xE0, 0xEF)}{cont}{{2}}|{cls(0xF0, 0xF4)}{cont}{{3}}")


def _plausible(c: str, enc: str) -> bool:
    o = ord(c)
    if enc in ("mac_roman", "cp1250") and 0x400 <= o:  # dashes and letters may stand side by side there
        return 0x2010 <= o <= 0x2044 or o == 0x20AC or 0x2190 <= o <= 0x22FF
    return (
        0xA0 <= o <= 0x17F or 0x370 <= o <= 0x3FF or 0x400 <= o <= 0x45F or 0x1E00 <= o <= 0x1EFF or 0x2010 <= o <= 0x2044
        or o in (0x20AC, 0x2122, 0xFB01, 0xFB02, 0x2009, 0x202F, 0x2002) or 0x2190 <= o <= 0x22FF or 0x3040 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3
    )


def _unread(text: str, enc: str, inner: bool = True) -> str | None:
    """Undo one reading of UTF-8 as `enc` wherever it decodes strictly; None where nothing does. Before the innermost
    step a character only has to be one that the next step could have made."""
    to_byte = _tables()[enc][0]
    hit = False

    def sub(m: re.Match) -> str:
        nonlocal hit
        s = m.group()
        if enc == "cp1251" and m.start() and "Ѐ" <= text[m.start() - 1] <= "ӿ" and not _runs(enc).search(text[max(0, m.start() - 3) : m.start()]):
            return s
        try:
            c = bytes(to_byte[x] for x in s).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            return s
        if not (_plausible(c, enc) if inner else c in to_byte):
            return s
        if enc == "cp1251" and "\u0400" <= c <= "\u04ff" and (text[m.end() : m.end() + 1].isascii() and text[m.end() : m.end() + 1].isalpha() or text[max(0, m.start() - 1) : m.start()].isascii() and text[max(0, m.start() - 1) : m.start()].isalpha()):
            return s
        hit = True
        return c

    out = _runs(enc).sub(sub, text)
    if inner and enc in ("cp1252", "latin-1"):  # the second character of a garbled "à" is a no-break space, often made a plain one
        out2 = re.sub(r"(?<![^\W\d_])Ã(?= )(?: (?= ))?", "à", out)
        if out2 != out:
            hit, out = True, out2
    return out if hit else None


#: What single-byte damage must leave in a text: a capital inside a word in small letters, or a mark or sign that
#: stands where only a letter or an apostrophe can. Without it the change of encoding is not verified.
_ODD = re.compile(
    r"[a-zß-öø-ÿ][À-ÖØ-Þ]|\b[A-Z][À-ÖØ-Þ][a-z]|^”[a-z.]|[a-z](?:í|ì|î)(?:s|t|re|ve|ll|d|m)\b|\bd[íì]\w| [ñó] |\bì[A-Za-z]|[a-z]î(?!\w)|¿ |^[¿¡…»«”÷≈ÿ‹][a-z]|[^\W\d_][ˆ¸˙˚˘˝¯·‚„‡‰ƒ≈√÷◊¬¡ıﬂ˛ˇ]|[ˆ¸˙˚˘˝¯·‚‡‰ƒ≈√÷◊ˇ˛][a-z]| ‡ |[a-z][“”»«…¿][a-z]"
)


def invert(text: str, chain: str) -> str | None:
    """The text before the chain, or None where the chain cannot be undone strictly."""
    steps = CHAINS[chain]
    if steps[0][0] != "utf-8":
        if not _ODD.search(text):
            return None
        right, wrong = steps[0]
        try:
            back = re.sub(r"[^\x00-\x7f]+", lambda m: m.group().encode(wrong).decode(right), text)
        except (UnicodeEncodeError, UnicodeDecodeError):
            return None
        return back if back != text else None
    for n, (_, wrong) in reversed(list(enumerate(steps))):
        nxt = _unread(text, wrong, n == 0)
        if nxt is None:
            return None
        text = nxt
    return text


def garble(text: str, chain: str) -> str | None:
    """Send a clean text through the chain; None where it cannot be written in the first encoding or stays as it is."""
    out = text
    for right, wrong in CHAINS[chain]:
        try:
            raw = out.encode(right)
        except UnicodeEncodeError:
            return None
        chars = _tables()[wrong][1]
        out = "".join(chars[b] if b >= 0x80 else chr(b) for b in raw)
    return out if out != text else None


_HIGH = re.compile(r"[^\x00-\x7f]")


def bigrams(text: str) -> np.ndarray:
    """Hashed bigrams of the UTF-8 bytes that touch a byte beyond ASCII, letters' case kept."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int64)
    if len(b) < 2:
        return np.zeros(0, dtype=np.int64)
    b = np.concatenate(([32], b, [32]))
    high = (b[:-1] >= 0x80) | (b[1:] >= 0x80)
    pair = (b[:-1] << 8 | b[1:])[high]
    tri = (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[high[:-1] & (b[1:-1] >= 0x80) | (b[1:-1] >= 0x80)] + (1 << 24)
    return (np.concatenate((pair, tri)) * 2654435761 % (1 << 32)) * BUCKETS >> 32


def _hygiene(text: str) -> bool:
    """Whether a text may serve as clean training text: nothing undone strictly, no mark of single-byte damage."""
    if "�" in text or re.search(r"[a-zß-ÿ][À-ÖØ-Ý]|[ˆ¸˙˚˘˝¯·‚„‡‰ƒ≈√÷◊ı¬¡]\w|\w[ˆ¸˙˚˘˝¯·‡ƒ≈√÷◊¬]|\b[A-Za-z]+[íìî]s\b|¿ |[├┬╬Γ]", text):
        return False
    return all(invert(text, c) is None for c in CHAINS if c != "cp1252>mac_roman")


class ChainModel:
    """Multinomial classifier: log likelihood of hashed bigrams for each label, with smoothing."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def train(cls, texts: list[str]) -> ChainModel:
        counts = np.full((len(LABELS), BUCKETS), 0.02)
        clean = [t for t in dict.fromkeys([*SEEDS, *texts]) if _HIGH.search(t) and _hygiene(t)]
        model = None
        for again in (False, True):  # the second time without what the first takes for damaged
            counts[:] = 0.02
            for t in clean:
                if again and model.scores(t).argmax():
                    continue
                np.add.at(counts[0], bigrams(t), 1)
                for k, c in enumerate(CHAINS, 1):
                    g = garble(t, c)
                    if g:
                        np.add.at(counts[k], bigrams(g), 1)
            model = cls(np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))
        return model

    def scores(self, text: str) -> np.ndarray:
        f = bigrams(text)
        return self.weights[:, f].sum(1) if len(f) else np.zeros(len(LABELS), np.float32)

    def predict(self, text: str | None) -> tuple[str, str | None]:
        """(chain, restored text): 'clean' keeps the text, 'lossy' restores what is left to restore."""
        if not text or not _HIGH.search(text):
            return CLEAN, text
        s = self.scores(text)
        out = (CLEAN, text)
        for k in sorted(range(1, len(LABELS)), key=lambda k: (LABELS[k] == "cp1252>mac_roman", -s[k])):
            # a strictly decoding run of several bytes is evidence by itself; one byte per letter decodes nearly always
            if s[k] > s[0] - (0 if LABELS[k] == "cp1252>mac_roman" else STRICT_BONUS):
                back = invert(text, LABELS[k])
                if back is not None:
                    out = (LABELS[k], back)
                    break
        if "�" in text:
            return LOSSY, out[1]
        if out[0] == CLEAN:  # damage in one passage of a text that is otherwise clean
            back, chains = self._passages(text)
            if chains:
                return chains[0], back
        return out

    def _passages(self, text: str) -> tuple[str, list[str]]:
        found: list[str] = []

        def sub(m: re.Match) -> str:
            w = m.group()
            s = self.scores(w)
            for k in np.argsort(-s):
                if k == 0:
                    break
                back = invert(w, LABELS[k])
                if back is not None and s[k] > s[0] + (PASSAGE_MARGIN if LABELS[k] == "cp1252>mac_roman" else 0):
                    found.append(LABELS[k])
                    return back
            return w

        return re.sub(r"\S*[^\x00-\x7f\s](?:\S|[\xa0\x85])*", sub, text), found


#: Log odds by which a strictly decoding chain may trail "clean": strict decoding is evidence by itself.
STRICT_BONUS = 4.0
#: Log odds by which a single-byte chain must lead in a single passage.
PASSAGE_MARGIN = 6.0


def fit(texts: DataFrame, col: str, rows: int = SAMPLE_ROWS) -> ChainModel:
    """Train on at most `rows` non-ASCII texts, the first by hash: the one bounded sample of this operator."""
    got = (
        texts.where(F.col(col).rlike(r"[^\x00-\x7F]")).select(F.col(col).alias("t")).distinct()
        .orderBy(F.xxhash64("t"), "t").limit(rows).collect()
    )
    return ChainModel.train([r.t for r in got])


def damaged(spark: SparkSession, model: ChainModel):
    """Column function: struct(chain, restored) of a text column. The model is 11 x 16,384 floats whatever the data."""
    held = spark.sparkContext.broadcast(model.weights)

    @F.pandas_udf("chain string, restored string")  # type: ignore[call-overload]
    def run(s: pd.Series) -> pd.DataFrame:
        m = ChainModel(held.value)
        got = [m.predict(x) for x in s]
        return pd.DataFrame({"chain": [g[0] for g in got], "restored": [g[1] for g in got]})

    return run


def spot(df: DataFrame, col: str, model: ChainModel) -> DataFrame:
    """`df` with columns chain and restored for every row; only non-ASCII texts reach Python."""
    high = F.coalesce(F.col(col).rlike(r"[^\x00-\x7F]"), F.lit(False))
    run: Column = damaged(df.sparkSession, model)(F.when(high, F.col(col)))
    return df.withColumn("_g", run).select(
        *[F.col(c) for c in df.columns],
        F.when(high, F.col("_g.chain")).otherwise(F.lit(CLEAN)).alias("chain"),
        F.when(high, F.col("_g.restored")).otherwise(F.col(col)).alias("restored"),
    )
