"""Reading of names typed by people: folding, speakers of a cell, parts of a name, nicknames, organisations.

Pure functions, used by the resolution of entities and by the matching of records across sources.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from plinth.llm import garbled, lookalikes

# Given names and their short forms.
NICKNAMES = {
    "alexander": "alex sasha sandy xander alec", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny benji", "christopher": "chris kit topher",
    "daniel": "dan danny", "david": "dave davy", "dmitri": "dima mitya", "edward": "ed eddie ted ned", "elizabeth": "liz beth betty eliza lizzie libby", "francoise": "fran franny",
    "frederick": "fred freddie fritz", "gregory": "greg", "ivan": "vanya", "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon jonny nathan",
    "jose": "pepe", "joseph": "joe joey", "katherine": "kate kathy katie kat kitty", "lawrence": "larry", "leonard": "leo len lenny", "lukasz": "luk lucas luke", "malgorzata": "gosia malgosia", "margaret": "peggy maggie meg marge greta",
    "matthew": "matt matty", "michael": "mike mick mikey misha", "nicholas": "nick nicky nico", "olga": "olya", "patricia": "pat trish patty tricia", "patrick": "paddy", "peter": "pete", "philip": "phil",
    "rebecca": "becky becca", "richard": "rich rick dick ricky", "robert": "rob bob bobby robbie bert", "ronald": "ron", "samuel": "sam sammy", "samantha": "sam", "stephen": "steve steven stevie", "susannah": "sue susan susie suzy",
    "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky vicki tori", "vladimir": "vova volodya", "william": "will bill billy liam", "zachary": "zach zack zac", "natalia": "natasha", "tatiana": "tanya",
    "maria": "masha", "ekaterina": "katya", "francisco": "paco pancho", "guadalupe": "lupe", "ignacio": "nacho", "giuseppe": "beppe", "johannes": "hans", "elena": "lenka", "giovanni": "gianni", "sebastian": "seb bastian",
}
FORMAL: dict[str, tuple[str, ...]] = {}
for _full, _short in NICKNAMES.items():
    FORMAL[_full] = (_full, *FORMAL.get(_full, ()))
    for _s in _short.split():
        FORMAL[_s] = (*FORMAL.get(_s, ()), _full)

# Letters that decomposition leaves alone.
_PLAIN = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "đ": "d", "Đ": "D", "ı": "i", "þ": "th", "ð": "d", "’": "'", "‘": "'"})
_TITLE = re.compile(r"^(?:(?:prof(?:essor)?|dr|mr|mrs|ms|miss|sir|herr|frau|monsieur|madame)\.?\s+)+(?=\S)", re.I)
_HONOUR = re.compile(r",?\s+(?:ph\.?\s?d\.?|m\.?sc\.?|jr\.?|sr\.?|iii?)$", re.I)
PLACE = re.compile(
    r"\b(?:universit\w*|institut\w*|inst|college|polytechnic\w*|departm\w*|dept|research|learning|sciences?|statistics?|school|cent(?:er|re)|facult\w*|lab|labs|laborator\w*|group|hospital|academy|hochschule|ecole|inc|ltd|corp)\b"
)
_SPLIT = re.compile(r"\s*(?:;|&|\||\+|/|\band\b|\bund\b|\bet\b|\bwith\b)\s*")


_MARKS = re.compile("[\u0300-\u036f]+")


def fold(text: str | None) -> str:
    """Look-alikes settled, marks dropped, lower case, single spaces; the damaged character � stays."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    s = unicodedata.normalize("NFKD", (lookalikes.canonical(text) or "").translate(_PLAIN))
    if not s.isascii():
        s = _MARKS.sub("", s)
        if not s.isascii():
            s = "".join(c for c in s if not unicodedata.combining(c))
    return " ".join(s.casefold().split())


@lru_cache(maxsize=1 << 15)
def parts(name: str) -> tuple[str, str, str] | None:
    """(given, middle initials, family) of one folded name; None where there is no family name."""
    name = _HONOUR.sub("", _TITLE.sub("", name.strip(" .,-")))
    if "," in name:
        last, _, first = name.partition(",")
        toks = re.findall(r"[^\W\d_�]+(?:['�-][^\W\d_�]*)*|[^\W\d_�]*�[^\W\d_]*", first)
        fam = re.findall(r"[^\W\d_]+(?:['�-][^\W\d_]*)*|�[^\W\d_]*", last)
        if not toks or not fam:
            return (("", "", "".join(fam)) if fam else None)
        given, rest = toks[0], toks[1:]
        return given, "".join(t[0] for t in rest if t), "".join(fam)
    toks = re.findall(r"[^\W\d_]*�[^\W\d_�]*|[^\W\d_]+(?:['-][^\W\d_]+)*", name)
    if not toks:
        return None
    if len(toks) == 1:
        return "", "", toks[0]
    if len(toks[-1]) == 1 and len(toks[0]) > 1:  # family first, initials behind
        k = len(toks)
        while k > 1 and len(toks[k - 1]) == 1:
            k -= 1
        ini = toks[k:]
        fam = "".join(toks[:k])
        return ini[0], "".join(ini[1:]), fam
    mid = [t for t in toks[1:-1] if len(t) == 1]
    fam = [t for t in toks[1:] if len(t) > 1] or toks[-1:]
    return toks[0], "".join(mid), "".join(fam)


def speakers(raw: str | None) -> list[str]:
    """Folded names of the speakers in one cell, without affiliations."""
    s = fold(raw)
    if not s:
        return []
    out = []
    for piece in _SPLIT.split(s):
        piece = re.sub(r"\([^)]*\)|\[[^\]]*\]|\([^)]*$", " ", piece).strip(" ,.-")
        piece = re.sub(r"^(?:speakers?|by|presenter)\s*:\s*", "", piece)
        segs = [x.strip() for x in piece.split(",") if x.strip()]
        if len(segs) > 1:
            keep = [x for i, x in enumerate(segs) if i == 0 or not PLACE.search(x)]
            if len(keep) == 1 or len(keep[0].split()) >= 2 and all(len(x.split()) >= 2 for x in keep):
                out += keep
                continue
            piece = f"{keep[0]}, {keep[1]}"
        if piece:
            out.append(piece)
    return [p for p in out if len(p) > 1]


@lru_cache(maxsize=1 << 16)
def formal(first: str) -> tuple[str, ...]:
    """Given names a typed one may stand for."""
    return FORMAL.get(first, (first,))


def near(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours; � stands for any one character."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    if la > lb:
        a, b, la, lb = b, a, lb, la
    i = 0
    while i < la and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


def given_level(a: str, b: str) -> int:
    """3 the same or a short form, 2 a typing error apart, 1 initial of the other, 0 another name."""
    if not a or not b:
        return 0
    if a == b:
        return 3 if len(a) > 1 else 1
    if len(a) == 1 or len(b) == 1:
        x, y = (a, b) if len(a) == 1 else (b, a)
        return 1 if any(f[0] == x for f in (y, *formal(y))) or y[0] == "�" else 0
    if "�" in a or "�" in b:
        if len(a) == len(b) and all(x == y or "�" in (x, y) for x, y in zip(a, b)):
            return 3
    if set(formal(a)) & set(formal(b)):
        return 3
    if min(len(a), len(b)) >= 3 and near(a, b) and not (a in FORMAL and b in FORMAL):
        return 2
    if any(near(x, b) for x in formal(a) if len(x) > 4) or any(near(a, y) for y in formal(b) if len(y) > 4):
        return 2
    return 0


def deletions(word: str) -> list[str]:
    """The word and every form with one letter deleted: two words within one edit or swap share one."""
    w = word.replace("�", "")
    return sorted({w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}) if len(w) >= 4 else [w]


def page_name(url: str | None) -> tuple[str | None, str | None]:
    """(key, name) in the last part of a personal page or picture path: 'jane_doe12' -> ('jane_doe12', 'jane doe')."""
    m = re.search(r"/([a-z]+(?:_[a-z]+)+?)(\d*)(?:\.[a-z]+)?/?$", url or "")
    if not m:
        return None, None
    return (m.group(1) + m.group(2) if m.group(2) else None), m.group(1).replace("_", " ")


def repaired(first: str | None) -> list[str]:
    """Readings of a given name that may have been decoded wrongly."""
    if not first:
        return []
    out = [first]
    if not first.isascii():
        for chain in sorted(garbled.CHAINS, key=lambda c: -len(garbled.CHAINS[c])):
            back = garbled.invert(first, chain)
            if back and "�" not in back:
                return [back]
    return out


# ---- organisations

_STOP = {"the", "of", "for", "and", "de", "la", "at", "in"}
_EXTRA = {"students", "student", "members", "member", "team", "group", "seminar", "speakers", "reading"}


def org_tokens(text: str) -> list[str]:
    return [t for t in re.findall(r"[^\W\d_]+", fold(text)) if t not in _STOP]


@lru_cache(maxsize=1 << 15)
def _org(folded: str) -> tuple[str, ...]:
    return tuple(org_tokens(folded))


def _token(t: str, o: str) -> int:
    """2 the word itself or a typing error, 1 an abbreviation, 0 another word."""
    if t == o or len(o) >= 5 and len(t) >= 4 and near(t, o):
        return 2
    if len(t) < len(o) and t[0] == o[0]:
        if o.startswith(t):
            return 1
        if len(t) >= 2:
            it = iter(o)
            if all(c in it for c in t):
                return 1
    if len(o) < len(t) and len(o) >= 3 and t.startswith(o):
        return 1
    return 0


def org_match(said: list[str], org: list[str]) -> bool:
    """Whether the words said name the organisation: every word of its name is said, fully, misspelt or abbreviated,
    in any order, one of them fully, and nothing else but a few generic words."""
    left = list(range(len(org)))
    strong = 0
    for t in said:
        best = max(left, key=lambda k: _token(t, org[k]), default=None)
        level = _token(t, org[best]) if best is not None else 0
        if level:
            strong += level == 2 and len(t) >= 4
            left.remove(best)
            continue
        if len(t) >= 2 and best is not None:  # initials of neighbours, as in "LT"
            for k in left:
                run = list(range(k, k + len(t)))
                if all(r in left for r in run) and "".join(org[r][0] for r in run) == t:
                    left = [x for x in left if x not in run]
                    level = 1
                    break
        if not level and t not in _EXTRA:
            return False
    return not left and strong >= 1
