"""One consistent form for text that looks ordinary but is made of other characters.

Method. The normalization quick check is run as a scan for characters that can be unstable (combining marks,
conjoining jamo, singletons, width and presentation variants). Each hit is widened to the nearest boundary
characters on both sides, only that segment is normalized, and the canonical segment is spliced into the
otherwise untouched text. Spaces, invisible characters and look-alike letters are settled in the same pass,
the latter word by word: a letter stands in for a look-alike if the rest of its word is of another script.

Defined results: null stays null, an empty text stays empty, texts of any length are read whole; typographic
quotes, dashes, ellipses, superscripts, fractions and whole words of another script are left alone. Runs that a
wrong decoding left behind are restored first, so that they alone never count.
"""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import garbled

# Letters of other scripts and their Latin look-alikes.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q",
    "ԝ": "w", "ӏ": "l", "ѵ": "v", "к": "k", "п": "n", "ї": "ï", "ё": "ë", "А": "A", "В": "B", "Е": "E", "З": "3", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "Н": "H", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ї": "Ï", "Ё": "Ë", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "γ": "y", "η": "n", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "ı̇": "i", "Տ": "S", "Օ": "O", "Լ": "L",
    "ɡ": "g", "ɑ": "a", "ɩ": "i", "ʋ": "v", "ǀ": "l", "Ꭺ": "A", "Ꭼ": "E", "Ꮋ": "H", "Ꮇ": "M", "Ꮲ": "P", "Ꭲ": "T", "Ꮃ": "W", "Ꮪ": "S", "Ꮯ": "C", "Ꮐ": "G",
}
#: Those so alike that a whole word of them in a text of the other script is a stand-in.
STRONG = set("аеорсухіјѕһԁԛԝӏАВЕІЈКМНОРСЅТУХΑΒΕΖΗΙΚΜΝΟΡΤΥΧο")
TO_CYRILLIC = {v: k for k, v in LOOKALIKES.items() if "Ѐ" <= k <= "ӿ" and k not in "пЗ"}
TO_GREEK = {v: k for k, v in LOOKALIKES.items() if "Ͱ" <= k <= "Ͽ"}

INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061"
    "\u2062\u2063\u2064\u2065\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff\ufff9\ufffa\ufffb\u3164\uffa0"
)
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u0085"
#: Decomposition kinds that are width or presentation variants; <super>, <sub>, <fraction> and plain <compat> are not.
VARIANT = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<vertical>", "<circle>", "<square>")


@lru_cache(maxsize=1)
def _unstable() -> tuple[re.Pattern, frozenset[str], frozenset[str]]:
    """Scan pattern, characters that are not a boundary, and variants, all derived from the character database."""
    loose, variants, hits, seconds = [], [], [], set()
    for o in range(0x80, sys.maxunicode + 1):
        c = chr(o)
        cat = ud.category(c)
        if cat in ("Cn", "Cs", "Co"):
            continue
        d = ud.decomposition(c)
        if d and not d.startswith("<") and " " in d and ud.normalize("NFC", c) == c:
            seconds.add(chr(int(d.split()[1], 16)))  # composes with what stands before it, mark or not
        if ud.combining(c) or 0x1161 <= o <= 0x11FF:
            loose.append(c)
        if d.startswith(VARIANT) or 0xFB00 <= o <= 0xFB06 or 0xFB13 <= o <= 0xFB17 or 0x2160 <= o <= 0x217F or 0x1C4 <= o <= 0x1CC:
            variants.append(c)
        elif d and not d.startswith("<") and ud.normalize("NFC", c) != c:
            hits.append(c)
    tied = seconds.union(loose)
    tied |= {c for c in variants if ud.normalize("NFKC", c)[0] in tied}  # a variant of such a character
    cls = "[" + "".join(re.escape(c) for c in sorted(tied.union(variants, hits))) + "]"
    return re.compile(cls), frozenset(tied), frozenset(variants)


def _segments(text: str) -> str:
    """Normalize only what the scan finds unstable, with its boundary context."""
    scan, loose, variants = _unstable()
    out, at = [], 0
    m = scan.search(text)
    while m:
        a = m.start()
        while a > at and text[a] in loose:
            a -= 1
        b = m.end()
        while b < len(text) and (text[b] in loose or scan.match(text[b])):
            b += 1
        seg = "".join(ud.normalize("NFKC", c) if c in variants else c for c in text[a:b])
        out += text[at:a], ud.normalize("NFC", seg)
        at = b
        m = scan.search(text, at)
    return "".join((*out, text[at:])) if out else text


_SPACE = re.compile(f"[{SPACES}]")
_GONE = re.compile(rf"[{INVISIBLE}]|[\U000e0000-\U000e007f]|(?<![\u2190-\u2bff\U0001f000-\U0001faff])[\ufe00-\ufe0e]")
_JOINER = re.compile("[\u0600-\u08ff\u0900-\u0dff\u1780-\u17ff][\u200c\u200d]")
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1 << 14)
def _script(c: str) -> str:
    n = ud.name(c, "")
    return n.split(" ", 1)[0] if c not in "ɡɑɩʋǀ" else "IPA"


def _word(w: str, home: str) -> str:
    """A word in one script. `home` is the script of the words around it."""
    scripts = {_script(c) for c in w}
    if scripts <= {"LATIN"}:
        return w
    if len(scripts) == 1:
        s = next(iter(scripts))
        if s in ("CYRILLIC", "GREEK", "ARMENIAN") and home == "LATIN" and all(c in STRONG for c in w):
            return "".join(LOOKALIKES[c] for c in w)
        if s == "IPA":
            return "".join(LOOKALIKES[c] for c in w) if len(w) > 1 else w
        return w
    if "LATIN" in scripts or "IPA" in scripts:
        foreign = [c for c in w if _script(c) != "LATIN"]
        if all(c in LOOKALIKES for c in foreign):
            return "".join(LOOKALIKES.get(c, c) if _script(c) != "LATIN" else c for c in w)
        latin = [c for c in w if _script(c) == "LATIN"]
        for script, to in (("CYRILLIC", TO_CYRILLIC), ("GREEK", TO_GREEK)):
            if scripts == {"LATIN", script} and all(c in to for c in latin):
                return "".join(to.get(c, c) if _script(c) == "LATIN" else c for c in w)
        return w
    if scripts <= {"CYRILLIC", "GREEK", "ARMENIAN"} and all(c in LOOKALIKES for c in w):
        return "".join(LOOKALIKES[c] for c in w)
    return w


def _letters(text: str) -> str:
    words = _WORD.findall(text)
    if all(w.isascii() for w in words):
        return text
    pure = [next(iter(s)) for s in ({_script(c) for c in w} for w in words) if len(s) == 1]
    true = {s for w, s in ((w, {_script(c) for c in w}) for w in words) if len(s) == 1 and not all(c in STRONG for c in w) for s in s}
    home = "LATIN" if "LATIN" in true or not true else ""
    mixed = any(len({_script(c) for c in w}) > 1 for w in words)
    if "LATIN" not in pure and not mixed:
        home = ""
    if {"CYRILLIC", "GREEK"} & true:  # words truly of the other script stand by
        home = ""
    return _WORD.sub(lambda m: _word(m.group(), home), text)


#: Every wrong reading of UTF-8 leaves characters beyond ASCII side by side, or a lone Ã.
_RUN = re.compile(r"[^\x00-\x7f]{2}|Ã")


def _undamaged(text: str) -> str:
    """The text with runs left by a wrong decoding restored, by strict inversion only."""
    if not _RUN.search(text):
        return text
    for chain, steps in garbled.CHAINS.items():
        if steps[0][0] == "utf-8" and "twice" in chain:
            back = garbled.invert(text, chain)
            if back is not None:
                return back
    for chain, steps in garbled.CHAINS.items():
        if steps[0][0] == "utf-8":
            back = garbled.invert(text, chain)
            if back is not None:
                return back
    return text


#: Precomposed Latin letters and typographic marks that are plain as they stand.
_QUIET = re.compile(r"[\x00-\x7f\xa1-\xac\xae-\u0131\u0134-\u017e\u2010-\u2027\u2030-\u203a]*")


def canonical(text: str | None) -> str | None:
    """The plain form of a text; what a wrong decoding left is not touched here."""
    if not text or text.isascii() or _QUIET.fullmatch(text):
        return text
    if _GONE.search(text):
        keep = {m.end() - 1 for m in _JOINER.finditer(text)}
        text = _GONE.sub(lambda m: m.group() if m.start() in keep else "", text)
    text = _SPACE.sub(" ", text)
    return _letters(_segments(text))


def is_plain(text: str | None) -> bool:
    if not text or text.isascii():
        return True
    if canonical(text) == text:
        return True
    undone = _undamaged(text)
    return undone != text and canonical(undone) == undone


def _forms():
    @F.pandas_udf("plain boolean, canon string")  # type: ignore[call-overload]
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"plain": [is_plain(x) for x in s], "canon": [canonical(x) for x in s]})

    return run


def consistent(df: DataFrame, col: str) -> DataFrame:
    """`df` with `plain` (whether the stored value is in its plain form) and `canon` (that form), for every row.
    ASCII texts are settled on the JVM; only others reach Python."""
    high = F.coalesce(F.col(col).rlike(r"[^\x00-\x7F]"), F.lit(False))
    return df.withColumn("_f", _forms()(F.when(high, F.col(col)))).select(
        *[F.col(c) for c in df.columns],
        F.when(high, F.col("_f.plain")).otherwise(F.lit(True)).alias("plain"),
        F.when(high, F.col("_f.canon")).otherwise(F.col(col)).alias("canon"),
    )
