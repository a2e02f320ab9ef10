"""Ordered cascade of anchored, strict day / clock / zone patterns for one raw text.

The text is first brought to plain spacing. Leading weekday words and filler are peeled off, then the
first day pattern that matches AT THE START and denotes a real calendar day wins; what follows is tried
against the clock patterns, and what follows that against the zone patterns. The rest (rooms, remarks)
is never read as a date. All of it is a pure function of (text, zone, order, year).

Policy for local clock times: an ambiguous one (clocks set back) takes the earlier instant, i.e. the
offset before the change; a nonexistent one (clocks set forward) is read with the offset before the
change, which lands after the gap by the time that was skipped.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names in the languages the feeds use.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5,
    "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sept": 9, "sep": 9,
    "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
    "januar": 1, "jänner": 1, "februar": 2, "märz": 3, "maerz": 3, "mai": 5, "juni": 6, "juli": 7,
    "oktober": 10, "okt": 10, "dezember": 12, "dez": 12,
    "janvier": 1, "janv": 1, "février": 2, "fevrier": 2, "févr": 2, "fév": 2, "mars": 3, "avril": 4, "avr": 4,
    "juin": 6, "juillet": 7, "juil": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11,
    "décembre": 12, "decembre": 12, "déc": 12,
    "enero": 1, "ene": 1, "febrero": 2, "marzo": 3, "abril": 4, "abr": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "ago": 8,
    "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12, "dic": 12,
    "gennaio": 1, "febbraio": 2, "aprile": 4, "maggio": 5, "giugno": 6, "luglio": 7, "settembre": 9, "ottobre": 10, "dicembre": 12,
}
WEEKDAYS = (
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed weds thu thur thurs fri sat sun "
    "montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag lundi mardi mercredi jeudi vendredi samedi dimanche "
    "lunes martes miércoles jueves viernes sábado domingo"
).split()
# Offsets in minutes of zone abbreviations.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "bst": 60, "west": 60, "eet": 120, "eest": 180,
    "jst": 540, "aest": 600, "aedt": 660,
}
# Zones meant by an abbreviation or a name that leaves the season open.
REGIONS = {
    "et": "America/New_York", "eastern": "America/New_York", "new york": "America/New_York", "ct": "America/Chicago",
    "central": "America/Chicago", "chicago": "America/Chicago", "pt": "America/Los_Angeles", "pacific": "America/Los_Angeles",
    "los angeles": "America/Los_Angeles", "mt": "America/Denver", "london": "Europe/London", "paris": "Europe/Paris",
    "zurich": "Europe/Zurich", "berlin": "Europe/Berlin", "sydney": "Australia/Sydney", "tokyo": "Asia/Tokyo",
}

_M = "(?P<mon>" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\.?(?![^\W\d_])"
_W = "(?:" + "|".join(sorted(WEEKDAYS, key=len, reverse=True)) + r")\b\.?"
_ORD = r"(?:st|nd|rd|th|er|º|ª)?"
_END = r"(?!\d)"
_SECOND = rf"(?:\s*(?:and|&|und|et|or|/|-|to)\s*\d{{1,2}}{_ORD}\s*(?:{_M.replace('?P<mon>', '?:')})?)?"


def _c(p: str) -> re.Pattern:
    return re.compile(p, re.I)


_LEAD = _c(rf"(?:{_W}|on|the|le|am|den|date|when|day|um|vom)\b\.?[\s,:]*")
#: (name, pattern); order decides. Instants first, then years first, names, purely numeric.
DAYS = [
    ("epoch_us", _c(r"(?P<epoch>\d{16})$")),
    ("epoch_ms", _c(r"(?P<epoch>\d{13})$")),
    ("epoch_s", _c(r"@?(?P<epoch>\d{10}(?:\.\d+)?)$")),
    ("week", _c(rf"(?P<y>\d{{4}})-?W(?P<wk>\d{{2}})-?(?P<wd>[1-7]){_END}")),
    ("ymd", _c(rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){_END}")),
    ("ymd8", _c(r"(?P<y>(?:19|20)\d{2})(?P<m>\d{2})(?P<d>\d{2})(?=$|[\sT,(@;-])")),
    ("ordinal", _c(rf"(?P<y>\d{{4}})-(?P<yday>\d{{3}}){_END}")),
    ("cjk", _c(r"(?P<y>\d{4})\s*[年년]\s*(?P<m>\d{1,2})\s*[月월]\s*(?P<d>\d{1,2})\s*[日일]")),
    ("cjk_short", _c(r"(?P<m>\d{1,2})\s*[月월]\s*(?P<d>\d{1,2})\s*[日일]")),
    ("serial", _c(r"(?P<serial>[1-5]\d{4})(?P<frac>\.\d+)?$")),
    ("d_mon_y", _c(rf"(?P<d>\d{{1,2}}){_ORD}\.?(?:\s+(?:of|de))?[\s\-./]*{_M}(?:\s+de)?[\s,\-./']*(?P<y>\d{{4}}|\d{{2}}){_END}(?!\s*(?:[:h.–-]\s*\d|h\b|[ap]\.?m|uhr|o'clock))")),
    ("d_mon_and_y", _c(rf"(?P<d>\d{{1,2}}){_ORD}\.?\s*{_M}{_SECOND}[\s,]*(?P<y>\d{{4}}){_END}")),
    ("d_and_mon_y", _c(rf"(?P<d>\d{{1,2}}){_ORD}\.?\s*(?:and|&|und|et|or|/|-|to|–)\s*\d{{1,2}}{_ORD}\.?\s*{_M}(?:[\s,]*(?P<y>\d{{4}}){_END})?")),
    ("mon_d_y", _c(rf"{_M}[\s\-./]*(?:the\s+)?(?P<d>\d{{1,2}}){_ORD}(?:\s*(?:and|&|or|to|-|–|/)\s*(?:{_M.replace('?P<mon>', '?:')}\s*)?\d{{1,2}}{_ORD})?(?:\s*,\s*|\s+|-|/|\.)'?(?P<y>\d{{4}}){_END}")),
    ("mon_d_yy", _c(rf"{_M}[\s\-./]*(?P<d>\d{{1,2}}){_ORD}(?:\s*,\s*|-|/)'?(?P<y>\d{{2}}){_END}(?!\s*(?:[:h.]\s*\d|[ap]\.?m|uhr|-\s*\d))")),
    ("mon_d", _c(rf"{_M}[\s\-./]*(?:the\s+)?(?P<d>\d{{1,2}}){_ORD}{_END}(?!\s*(?::\d|[ap]\.?m))")),
    ("d_mon", _c(rf"(?P<d>\d{{1,2}}){_ORD}\.?(?:\s+(?:of|de))?[\s\-./]*{_M}")),
    ("num_y", _c(rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}}){_END}")),
    ("num", _c(r"(?P<a>\d{1,2})(?P<sep>[/.])(?P<b>\d{1,2})\.?(?![\d:]|\.\d|\s*[ap]\.?m)")),
]
_GAP = r"(?:[\s,;@T]|at\b|from\b|um\b|à\b|a las\b|-|–|·|\|)*"
_AP = r"(?P<ap>[ap])\.?\s?m\b\.?"
_SPAN = r"(?:\s*(?:-|–|—|to|until|bis)\s*(?:\d{1,2}(?:[:.h]\d{2})?|noon))?"
CLOCKS = [
    ("full", _c(rf"{_GAP}(?P<h>\d{{1,2}}):(?P<mi>\d{{2}})(?::(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?(?!\d){_SPAN}(?:\s*{_AP})?")),
    ("compact", _c(r"T(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d{1,9}))?(?!\d)")),
    ("h_mark", _c(rf"{_GAP}(?P<h>\d{{1,2}})\s?h(?:r|rs)?\.?\s?(?P<mi>\d{{2}})?(?![^\W\d_]|\d)")),
    ("uhr", _c(rf"{_GAP}(?P<h>\d{{1,2}})(?:[.:](?P<mi>\d{{2}}))?{_SPAN}\s*uhr\b")),
    ("dot_ap", _c(rf"{_GAP}(?P<h>\d{{1,2}})\.(?P<mi>\d{{2}}){_SPAN}\s*{_AP}")),
    ("hour_ap", _c(rf"{_GAP}(?P<h>\d{{1,2}}){_SPAN}\s*{_AP}")),
    ("noon", _c(rf"{_GAP}(?:12\s+)?(?P<noon>noon|midday|mittags?|midi)\b")),
    ("midnight", _c(rf"{_GAP}(?:12\s+)?(?P<midnight>midnight|minuit|mitternacht)\b")),
    ("oclock", _c(rf"{_GAP}(?P<h>\d{{1,2}})\s*o'?clock\b")),
    ("mil", _c(rf"{_GAP}(?P<h>[01]\d|2[0-3])(?P<mi>[0-5]\d)\s*(?:hrs?|hours)\b")),
]
_SPAN_TAIL = _c(r"\s*(?:-|–|—|to|until|bis)\s*\d{1,2}(?:[:.h]\d{2})?\s*(?:[ap]\.?\s?m\b\.?|uhr\b|h\b)?")
ZONES = [
    ("local", _c(r"[\s,(\[]*local(?:\s+time)?\b")),
    ("offset", _c(r"[\s,(\[]*(?:(?:UTC|GMT)\s*)?(?P<sg>[+\-−])(?P<oh>\d{1,2})(?::?(?P<om>\d{2}))?(?!\d)")),
    ("iana", _c(r"[\s,(\[]*(?P<iana>(?:Africa|America|Asia|Atlantic|Australia|Europe|Indian|Pacific|US|Etc)/[A-Za-z_]+(?:/[A-Za-z_]+)?)")),
    ("abbr", _c(rf"[\s,(\[]*(?P<abbr>{'|'.join(sorted(ABBREVIATIONS, key=len, reverse=True))})(?![^\W_])")),
    ("region", _c(rf"[\s,(\[]*(?P<region>{'|'.join(sorted(REGIONS, key=len, reverse=True))})(?:\s+(?:standard\s+|daylight\s+)?time)?(?![^\W_])")),
]
_CLOCK_FIRST = _c(r"(?:time\s*:?\s*)?(?P<clock>(?:\d{1,2}:\d{2}(?::\d{2})?(?:\s*(?:-|–|to)\s*\d{1,2}(?::\d{2})?)?(?:\s*[ap]\.?\s?m\b\.?)?|\d{1,2}(?:\s*(?:-|–|to)\s*\d{1,2}(?::\d{2})?)?\s*[ap]\.?\s?m\b\.?|\d{1,2}h(?:\d{2})?\b|noon\b))")
_ROOM_FIRST = _c(r"^[^\d,;@()]{2,30}\s\d+[A-Z]?\s*[,;@:|·-]\s+|^online\s*[,;@:|·-]\s+")
_ZERO = dict.fromkeys(map(ord, "\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f"))
SERIAL_ZERO = date(1899, 12, 30)


def plain(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).translate(_ZERO)).strip()


@lru_cache(maxsize=512)
def zone_of(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # unknown key
        return None


def _year(y: str) -> int:
    v = int(y)
    return v if len(y) == 4 else v + (1900 if v >= 69 else 2000)


def _day(g: dict, order: str, year: int | None) -> date | None:
    try:
        if g.get("wk"):
            return date.fromisocalendar(int(g["y"]), int(g["wk"]), int(g["wd"]))
        if g.get("yday"):
            return date(int(g["y"]), 1, 1) + timedelta(days=int(g["yday"]) - 1) if 0 < int(g["yday"]) < 367 else None
        y = _year(g["y"]) if g.get("y") else year
        if y is None or not 1900 <= y <= 2100:
            return None
        if g.get("a"):
            a, b = int(g["a"]), int(g["b"])
            m, d = (a, b) if order == "MDY" else (b, a)
            if m > 12 >= d:
                m, d = d, m
            return date(y, m, d)
        m = MONTHS[g["mon"].lower()] if g.get("mon") else int(g["m"])
        return date(y, m, int(g["d"]))
    except (ValueError, TypeError, OverflowError):
        return None


def _clock(rest: str) -> tuple[tuple[int, int, float], str] | None:
    for name, p in CLOCKS:
        m = p.match(rest)
        if not m:
            continue
        g = m.groupdict()
        tail = rest[m.end():]
        if g.get("noon"):
            return (12, 0, 0.0), tail
        if g.get("midnight"):
            return (0, 0, 0.0), tail
        h, mi = int(g["h"]), int(g.get("mi") or 0)
        s = int(g.get("s") or 0) + (float("0." + g["f"]) if g.get("f") else 0.0)
        if g.get("ap"):
            if not 1 <= h <= 12:
                continue
            h = h % 12 + (12 if g["ap"].lower() == "p" else 0)
        if h > 23 or mi > 59 or s >= 61:
            continue
        if not g.get("ap"):
            t = _SPAN_TAIL.match(tail)
            if t and name != "full" or t and not re.match(r"\s*[-−]\d{2}:?\d{2}(?!\d)", tail):
                if not ZONES[1][1].match(tail) or re.search(r"[ap]\.?m|uhr|h", t.group(), re.I):
                    tail = tail[t.end():]
        else:
            t = _SPAN_TAIL.match(tail)
            if t and re.search(r"[ap]\.?\s?m", t.group(), re.I):
                tail = tail[t.end():]
        return (h, mi, s), tail
    return None


def _zone(tail: str, default: str | None):
    for name, p in ZONES:
        m = p.match(tail)
        if not m:
            continue
        g = m.groupdict()
        if name == "local":
            break
        if name == "offset":
            minutes = int(g["oh"]) * 60 + int(g["om"] or 0)
            if minutes > 14 * 60:
                continue
            return timezone(timedelta(minutes=minutes if g["sg"] == "+" else -minutes))
        if name == "iana" and zone_of(g["iana"]):
            return zone_of(g["iana"])
        if name == "abbr":
            return timezone(timedelta(minutes=ABBREVIATIONS[g["abbr"].lower()]))
        if name == "region":
            return zone_of(REGIONS[g["region"].lower()])
    return zone_of(default) if default else None


def _utc(local: datetime, zone) -> str:
    """Canonical instant; fold 0 is the policy named in the module's text."""
    return _minute((local.replace(tzinfo=zone, fold=0)).astimezone(timezone.utc))


def _minute(t: datetime) -> str:
    t = t + timedelta(seconds=30)
    return t.strftime("%Y-%m-%dT%H:%MZ")


def canonical(text: str | None, zone: str | None = None, order: str | None = "MDY", year: int | None = None) -> str | None:
    """'YYYY-MM-DD', 'YYYY-MM-DDTHH:MMZ' or None where the text states no real day.

    None, blank and placeholder texts give None. A clock time with no zone in the text and no known
    default zone gives the day alone, since no instant can be stated.
    """
    if not text:
        return None
    s = plain(text)
    early = ""
    for _ in range(6):
        m = _LEAD.match(s)
        if m and m.end():
            s = s[m.end():].lstrip(" ,;:-")
            continue
        m = _CLOCK_FIRST.match(s)
        if m and not early and re.search(r"\d", s[m.end():]):
            t = re.match(r"\s*(?:\((?:[^)]*)\)|[A-Z]{2,4}\b|UTC[+-]\d\S*)?[\s,;:@|-]*(?:on\b)?\s*", s[m.end():])
            early, s = s[: m.end() + t.end()], s[m.end() + t.end():]
            continue
        m = _ROOM_FIRST.match(s)
        if m and not re.match(rf"{_M}", s, re.I):
            s = s[m.end():]
            continue
        break
    for name, p in DAYS:
        m = p.match(s)
        if not m:
            continue
        g = m.groupdict()
        if g.get("epoch"):
            scale = {"epoch_us": 1e6, "epoch_ms": 1e3}.get(name, 1.0)
            return _minute(datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=float(g["epoch"]) / scale))
        if g.get("serial"):
            day = SERIAL_ZERO + timedelta(days=int(g["serial"]))
            z = zone_of(zone) if zone else None
            if not g.get("frac") or z is None:
                return day.isoformat()
            local = datetime(day.year, day.month, day.day) + timedelta(seconds=round(float(g["frac"]) * 86400))
            return _utc(local, z)
        day = _day(g, order or "MDY", year)
        if day is None:
            continue
        rest = s[m.end():]
        got = _clock(rest)
        if got is None:  # remarks or a weekday between the day and the clock
            cut = re.sub(rf"^[\s,;]*(?:\((?!\s*\d)[^)]*\)|{_W})", "", rest, flags=re.I)
            got = _clock(cut) if cut != rest else None
        if got is None:
            got = _clock_inside(rest)
        if got is None and early:
            got = _clock(early)
        if got is None:
            return day.isoformat()
        (h, mi, sec), tail = got
        z = _zone(tail, zone)
        if z is None:
            return day.isoformat()
        return _utc(datetime(day.year, day.month, day.day, h, mi) + timedelta(seconds=sec), z)
    return None


_INSIDE = _c(r"(?:^|[\s,;@(|·-])(?=\d{1,2}:\d{2}|\d{1,2}(?::\d{2})?(?:\s*(?:-|–|to)\s*\d{1,2}(?::\d{2})?)?\s*[ap]\.?\s?m\b|\d{1,2}h\d{2}\b|noon\b|\d{1,2}(?:[.:]\d{2})?\s*uhr\b)")


def _clock_inside(rest: str):
    """A clock later in the text, after a room or remark."""
    m = _INSIDE.search(rest)
    return _clock(rest[m.end():]) if m else None
