"""A score per document for abusive, hateful or sexually explicit passages, by weak supervision.

Method. Each passage (sentence) gets the votes of many lexicon and pattern voters: abusive, harmless or no
opinion. Voters read the text as typed, brought to a plain form in which disguises (zero-width characters,
look-alikes, digits for letters, spaced, dotted or starred letters, stretched letters) are undone. A generative
label model is fitted by EM to the counts of all vote patterns of the whole corpus; it estimates each voter's
accuracy and coverage and the voters' correlation given the class, by which it discounts voters that say the
same. A linear classifier over hashed words and word pairs of the passage, and over its votes, is trained on the
posterior labels of a bounded sample and scores every passage. A document's score is that of its worst passage.

The sample has at most SAMPLE_PASSAGES passages, spread over the vote patterns: every pattern gives its share, passages
without any vote among them, the least by hash; each stands for the passages of its pattern. To it come EVERYDAY
sentences, so that ordinary ways of addressing people are never foreign to the classifier.

Scale. Two row-wise passes. The first counts patterns and keeps sample candidates inside the map task (a bounded table a
task), so that no passage moves but these; a pattern is a set of voters, so there are at most 2^voters counts and in practice a few hundred. The
second scores passages where they are read, a batch of documents at a time in numpy.

Defined results: null and empty texts score 0; texts of any length are read whole; repeated rows score alike;
a null source is a source of its own in the rates.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.lookalikes import _QUIET, LOOKALIKES
from plinth.session import cut

SAMPLE_PASSAGES = 20_000
BUCKETS = 1 << 16
_MAP = str.maketrans({k: v for k, v in LOOKALIKES.items() if len(k) == 1})

# Word classes, in plain form.
INSULTS = set(
    "idiot idiots moron morons imbecile imbeciles cretin cretins dimwit dimwits jackass bastard bastards scumbag scumbags loser losers parasite pig cockroach vermin trash scum "
    "fool fools dumbass asshole assholes bitch bitches whore whores slut sluts cunt cunts prick pricks dickhead dickheads wanker wankers twat twats jerk jerks douchebag retard retards halfwit halfwits nitwit dunce clown clowns maggot maggots filth freak freaks "
    "cockroaches parasites rats rat pigs dog dogs swine subhuman subhumans fucker fuckers motherfucker motherfuckers shithead pervert creep weasel coward cowards traitor traitors".split()
)
SLIGHTS = set("stupid brainless worthless disgusting pathetic useless revolting gutless spineless filthy braindead miserable repulsive dumb vile despicable ugly shameless fucking shitty idiotic moronic hideous sickening clueless".split())
PROFANE = set("hell crap bloody shit fuck fucking damn bullshit piss arse ass".split())
SEXUAL = set("nudes naked nude sexy horny hardcore undressed undress moaning moan lick licking sex porn orgasm blowjob cock pussy tits cum erotic masturbate masturbating stripped topless thighs boobs fuck dick breasts clothes skin aroused stroking".split())
FOREIGN = set(
    "arschloch drecksack schwachkopf vollidiot idiot trottel fresse hurensohn wichser abschaum missgeburt schlampe drecksau verprügelt verrecke verpiss dreckige dreckiger dreckiges widerlich widerliche widerlicher widerliches ungeziefer gesindel "
    "gueule imbécile ordure ordures crever crève crétin crétins connard connards salope enculé abruti abrutis débile débiles pute merde salaud salauds bâtard conne vermine déchet racaille".split()
)
HARM = set("smash smashed break broken kill killed hurt beat beaten punch punched stab stabbed shoot shot hang hanged burn burned burnt choke choked strangle strangled crush crushed slit cave caved bash bashed cripple crippled drown drowned skin skinned butcher butchered slaughter slaughtered rape raped regret".split())
BODY = set("face skull teeth bone bones throat head neck jaw ribs knees nose legs fingers eyes guts".split())
BEASTS = set("vermin rat rats filth scum cockroach cockroaches parasite parasites subhuman subhumans animals pigs savages pest pests plague disease cancer trash garbage maggots insects lice apes dogs swine leeches".split())
TRAITS = set("liar liars thief thieves criminal criminals rapist rapists murderers dirty inferior lazy worthless filthy disgusting primitive uncivilised uncivilized barbaric evil stupid subhuman greedy perverted degenerate degenerates untrustworthy stink stinks smell".split())
EXPEL = set("deport deported exterminate exterminated eradicate eradicated expel expelled gas gassed purge purged cleanse cleansed banish banished lynch lynched sterilise sterilised sterilize sterilized".split())
REMOVE = set("wipe wiped throw thrown kick kicked round send sent drive driven clean rid let lock locked eliminate eliminated shut".split())
SWARM = set("breed breeding crawl crawled crawling swarm swarming infest infesting invade invading flood flooding overrun".split())
VERBS = HARM | set("rip wipe vanished die dies dying dead rot thrown shut cage zoo oven oven ovens camp".split())
LEXICON = INSULTS | SLIGHTS | PROFANE | SEXUAL | FOREIGN | VERBS | BEASTS | TRAITS | EXPEL | SWARM | set("waste celebrate piece birth blood trust ashamed nature genes lost mouth".split())
RESEARCH = set(
    "detector detectors classifier classifiers annotator annotators covariate covariates dataset datasets estimator estimators baseline modelled analysed recalibrated trained label labels agreed species records sample samples bootstrap regression predator survival counts rate rates dimorphism corpus lexicon moderation "
    "model models data theorem lemma proof bound bounds variance likelihood inference experiment experiments measured algorithm algorithms distribution hypothesis parameter parameters".split()
)
_BY_SHAPE: dict[tuple[int, str, str], list[str]] = {}
for _w in sorted(LEXICON):
    _BY_SHAPE.setdefault((len(_w), _w[0], _w[-1]), []).append(_w)

_LEET = str.maketrans("013457@$!|", "oieastasil")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”’)»]*\s+|\n\s*\n")
_ZERO = re.compile("[­​-‏⁠-⁤﻿᠎]")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]([ .\-_*·]))(?:[^\W\d_]\1){1,}[^\W\d_](?![^\W\d_])")
_STAR = re.compile(r"(?<!\w)([^\W\d_])([*#]{2,}|[*#])([^\W\d_]*)(?!\w)")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")


def plain(passage: str) -> tuple[str, bool]:
    """(plain lower-case form, whether a word of the lexicon was disguised)."""
    s = passage
    gone = 0
    if not s.isascii():
        t = _ZERO.sub("", s)
        gone = len(s) - len(t)
        s = unicodedata.normalize("NFKC", t)
        if not s.isascii():
            words = re.split(r"(\W+)", s)
            s = "".join(w.translate(_MAP) if not w.isascii() and re.search("[A-Za-z]", w) else w for w in words)
    if "<" in s:
        s = _TAG.sub("", s)
    low = re.sub(r"(?<=[^\W\d_])-\n\s*(?=[^\W\d_])", "", s.lower()).replace("’", "'")
    low = re.sub(r"\s+", " ", low)
    if "**" in low or "__" in low:
        low = re.sub(r"(?<![\w*])(\*\*|__)(?=\w)([^*_]+)\1(?!\w)", r"\2", low)
    hidden = False
    if "*" in low or "#" in low:
        def star(m: re.Match) -> str:
            nonlocal hidden
            n = len(m.group())
            tail = m.group(3)
            if not tail:
                return m.group()
            hit = [w for w in _BY_SHAPE.get((n, m.group(1), tail[-1]), []) if w.endswith(tail)]
            if hit:
                hidden = True
                return hit[0]
            return m.group()

        low = _STAR.sub(star, low)
    def join(m: re.Match) -> str:
        nonlocal hidden
        w = re.sub(r"[ .\-_*·]", "", m.group())
        if w in LEXICON:
            hidden = True
            return w
        return m.group()

    low = _SPACED.sub(join, low)
    if re.search(r"(.)\1\1", low):
        def stretch(m: re.Match) -> str:
            nonlocal hidden
            w = m.group()
            for rep in (r"\1", r"\1\1"):
                c = re.sub(r"([^\W\d_])\1{2,}", rep, w)
                if c in LEXICON:
                    hidden = True
                    return c
            return re.sub(r"([^\W\d_])\1{2,}", r"\1", w)

        low = re.sub(r"[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*", stretch, low)
    if re.search(r"[a-z][013457@$!|]|[013457@$!|][a-z]", low):
        def leet(m: re.Match) -> str:
            nonlocal hidden
            w = m.group()
            for c in (w.translate(_LEET), w.replace("1", "l").translate(_LEET)):
                if c in LEXICON:
                    hidden = True
                    return c
            return w

        low = re.sub(r"(?<!\w)(?=[\w@$!|]*[a-z])(?=[\w@$!|]*[013457@$!|])[\w@$!|]+", leet, low)
    if gone >= 1 and not hidden:
        hidden = any(w in LEXICON for w in re.findall(r"[^\W\d_]+", low))
    return low, hidden


def _any(*sets) -> str:
    words = sorted(set().union(*sets), key=lambda w: (-len(w), w))
    return "(?:" + "|".join(words) + ")"


_I, _S = _any(INSULTS), _any(SLIGHTS)
_THEM = r"(?:them|those|these|they|their kind|every last|every one of|all of|people like)"
_WHO = r"(?:i|we|he|she|they|somebody|someone)"
_WILL = r"(?:'ll| will| would| shall| must| should|'m going to|'re going to|'s going to| am going to| are going to| is going to| gonna| want to| ought to)"
#: Voters for "abusive": name, words one of which a passage must have (None: any), pattern over the plain form.
PRO: list[tuple[str, set[str] | None, str]] = [
    ("you_insult", INSULTS, rf"\b(?:you|your|u|ya|you're|youre|yourself)\b[^.!?]{{0,40}}\b{_I}\b|\b{_I}\b[,!]? (?:you|like you)\b"),
    ("called_insult", INSULTS, rf", {_I}(?: like you)?[.!]|^{_I}!|\b(?:get lost|shut up|go away|bloody|what kind of|only an?|such an?|absolute|complete|total|you|some|these|those) (?:{_S} )*{_I}\b"),
    ("slight_insult", INSULTS, rf"\b{_S}(?:,? (?:and )?{_S})* {_I}\b"),
    ("slighted_you", SLIGHTS, rf"\byou(?: are|'re|r|) (?:[\w']+ ){{0,3}}{_S}\b|\byour (?:[\w']+ ){{0,4}}(?:ashamed|{_S})\b"),
    ("wish", {"dead", "die", "dies", "hell", "rot", "kill", "choke", "burn", "suffer", "vanished", "regret", "miss", "without", "notice", "care", "died"},
     r"\b(?:drop dead|go die|(?:go to|rot in|burn in) hell|kill yourself|hope (?:you|they|he|she)(?: all)? (?:choke|die|rot|burn|suffer)|(?:nobody|no one) would (?:miss|notice|care)[^.!?]{0,30}\byou\b|better off without (?:you|them)|(?:you|they) (?:vanished|died)\b|make (?:you|him|her|them) regret)\b"),
    ("threat", HARM, rf"\b{_WHO}{_WILL}\b[^.!?]{{0,50}}\b{_any(HARM)}\b[^.!?]{{0,40}}\b(?:you|your|him|his|her|them|their|those|every)\b|\b{_any(HARM)} (?:it|your|you|him|her|them)\b[^.!?]{{0,30}}\b(?:in|up|off|{'|'.join(sorted(BODY))})\b"),
    ("harm_body", BODY, rf"\b{_any(HARM)} (?:in )?(?:your|his|her|their|every) (?:[\w']+ )?{_any(BODY)}\b|\b(?:your|his|her|their|every) {_any(BODY)} (?:[\w']+ )?{_any(HARM)}\b|\bevery bone in\b"),
    ("stalk", {"find", "watch", "live"}, r"\b(?:i|we)(?:'ll| will) (?:come and )?find you\b|\bwatch your back\b|\bi know where you live\b"),
    ("dismissal", {"shut", "crawl", "lost", "ashamed", "rock", "mouth", "get"}, r"\b(?:shut (?:your (?:mouth|face|trap)|up)|crawl back|get lost|under your rock|should be ashamed of|get out of (?:here|our|my))\b"),
    ("group_beast", BEASTS, rf"\b(?:are|is|like|just|nothing but|than) (?:all |just |nothing but |no better than |worse than )?(?:an? )?{_any(BEASTS)}\b|\b(?:those|these) (?:\w+ ){{0,3}}(?:animals|savages|vermin|rats|parasites)\b"),
    ("group_trait", TRAITS, rf"\b(?:they|those|these|them|people|\w+ans|\w+ese|\w+ish)\b(?: \w+){{0,2}} (?:are|is|were|all)\b(?: (?:all|just|so|nothing but|and|a|bunch|of|born|\w+ly)){{0,3}} (?:\w+ and )?{_any(TRAITS)}\b|\b(?:they|those|these)(?: \w+){{0,2}} (?:stink|smell)\b"),
    ("group_essence", {"blood", "nature", "genes", "birth"}, r"\bin (?:their|his|her|your) (?:blood|nature|genes)\b|\b(?:by (?:birth|nature))\b"),
    ("group_trust", {"trust"}, r"\bnever trust (?:an?|the|any|one|those|these)\b|\b(?:cannot|can't|don't) trust (?:any of|those|these|them|people like)\b"),
    ("group_expel", EXPEL, rf"\b{_any(EXPEL)}\b[^.!?]{{0,30}}\b(?:them|those|these|every|all)\b|\b(?:should|must|ought to|have to|need to|deserve to) (?:all )?be (?:\w+ )?{_any(EXPEL)}\b|\b(?:we|they) (?:should|must|ought to|have to|need to) {_any(EXPEL)}\b"),
    ("group_remove", REMOVE, rf"\b(?:wipe (?:\w+ )?out|round (?:them|those|\w+) (?:all )?up|throw(?:n)? (?:\w+ ){{0,3}}out of|kick(?:ed)? (?:\w+ ){{0,3}}out of|send (?:them|those \w+) (?:all )?(?:back|home)|get(?:ting)? rid of {_THEM}|(?:lock|drive) (?:them|those \w+) (?:all )?(?:up|out|away)|let (?:those |these |\w+ )?people in|clean(?:ed)? (?:of|from) {_THEM})\b"),
    ("group_swarm", SWARM, rf"\b(?:they|those|these|who|{_THEM})\b[^.!?]{{0,25}}\b{_any(SWARM)}\b[^.!?]{{0,20}}\b(?:like|over|into|our|the border|country|everywhere)\b|\b{_any(SWARM)} (?:like|over the border|into our)\b"),
    ("caged", {"cage", "zoo", "camp", "oven", "ovens", "chamber", "gutter"}, r"\b(?:belongs?|should be|put|locked?) (?:\w+ ){0,3}(?:in|into|up in) (?:an? |the )?(?:cage|zoo|camp|gas chamber|ovens?|gutter)\b"),
    ("sexual_acts", SEXUAL, r"\b(?:have|having|had|want|wild|hardcore|hot|oral|anal|rough) (?:[\w']+ ){0,2}sex\b|\b(?:rip|take|tear|taking|tearing) (?:off )?(?:your|her|his|my) clothes\b|\bclothes off\b|\bundress\w*\b|\bmoan(?:ing|ed|s)?\b|\blick(?:ing)? (?:every|your|my|her|his|you)\b|\bbare skin\b|\bstroking\b|\b(?:your|her|his) thighs\b"),
    ("sexual_words", SEXUAL, r"\b(?:nudes|horny|hardcore|porn|orgasm|blowjob|pussy|tits|boobs|masturbat\w+|aroused)\b|\bnaked (?:body|bodies|grad|girls?|boys?|students?|women|woman|pics|photos|selfies?)\b|\b(?:you|she|he) (?:look |looks )?(?:so )?(?:sexy|horny)\b|\bsexy\b|\btouch (?:you|me|her|him) all over\b"),
    ("foreign", FOREIGN, rf"\b{_any(FOREIGN - {'idiot', 'widerlich', 'gesindel', 'merde', 'ordure', 'ordures', 'conne', 'débile', 'débiles', 'déchet', 'pute', 'dreckige', 'dreckiger', 'dreckiges', 'vermine', 'crever'})}\b|\bgehört verprügelt\b|\b(?:du|ihr|sie) (?:\w+ ){{0,4}}(?:widerlich\w*|dreckig\w*|idiot\w*|gesindel)\b|\b(?:tu|vous|ces|sale|espèce d\W?)\s?(?:[\w']+ ){{0,4}}(?:ordures?|merde|imbécile|déchet|conne?|débiles?|pute|vermine)\b|\bva crever\b"),
    ("hot_profanity", PROFANE, r"\b(?:go to hell|th(?:is|at) (?:crap|shit|bullshit)|bloody (?!mary|sunday|well)\w+|fuck(?:ing)? (?:you|off|your)|piece of (?:shit|crap|trash|filth)|son of a bitch|bullshit)\b"),
]
#: Voters for "harmless".
CON: list[tuple[str, set[str] | None, str]] = [
    ("research", RESEARCH, ""),
    ("about_language", {"abusive", "hateful", "hate", "offensive", "notation", "word", "term", "quoted", "slur", "slurs", "insults", "dimorphism", "selection", "reproduction", "harassment", "toxicity"},
     r"\b(?:abusive (?:posts?|language|content|comments?|speech)|hateful (?:comments?|posts?|speech|content)|hate speech|offensive|abuse of notation|the (?:word|term)|quoted|slurs?|insults? (?:are|were|in)|sexual (?:dimorphism|selection|reproduction|harassment)|harassment|toxicity)\b"),
    ("idiom", {"naked", "stupid", "kills", "kill", "brute", "dummy", "dead", "bloody", "stripped", "explicit", "hell", "killer", "time"},
     r"\b(?:naked eye|not (?:that|so) stupid|kills the|kill (?:rate|switch)|brute force|dummy variables?|dead (?:end|time|line|band|reckoning)|bloody mary|stripped of|explicit (?:error|constant|mixture|form|formula|bound)|hell of a|killer app|kill time)\b"),
]
_PRO = [(n, w, re.compile(p)) for n, w, p in PRO]
_CON = [(n, w, re.compile(p) if p else None) for n, w, p in CON]
VOTERS = [n for n, *_ in PRO] + ["disguised"] + [n for n, *_ in CON]
DISGUISED = len(PRO)
SIDE = np.array([1.0] * (len(PRO) + 1) + [-1.0] * len(CON))
#: word -> voters that it can make speak, as bits; what has no word here is not tried on the patterns.
_BITS: dict[str, int] = {}
for _k, (_n, _ws, _p) in enumerate([*_PRO, ("disguised", set(), None), *_CON]):
    for _w in _ws:
        _BITS[_w] = _BITS.get(_w, 0) | 1 << _k
_KNOWN = frozenset(_BITS)
#: Words whose disguise is a vote: the others are common words.
STRONG = INSULTS | SLIGHTS | PROFANE | SEXUAL | FOREIGN | HARM | BEASTS | EXPEL | {"cage", "waste", "piece", "stink", "die", "dead", "shut", "liars", "thieves"}
_WORD = re.compile(r"[^\W\d_]+")
#: What may hide a word: without any of it, a passage is its own plain form. Letters in threes and letters by themselves are
#: looked for in its words.
_MARK = re.compile(r"[<*#@$|_\xb7]|[0-9!][a-z]|[a-z][0-9]|-\n")
_ALONE = re.compile(r"\b[^\W\d_][ .\-][^\W\d_]\b")
_THREE = re.compile(r"([^\W\d_])\1\1")
_MAYBE = re.compile(r"[<*#@$|_\xb7\d!]|-\n")
#: Bytes with everything but letters as blanks.
_BLANKS = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))
#: A word spelt letter by letter has one of these by itself.
_SINGLES = frozenset("bcdefghjklmnopqrstuvwxyz")
#: Words known to have no letter three times in a row; a cache.
_CALM: set[str] = set()


def _stretched(words: list[str]) -> bool:
    if _CALM.issuperset(words):
        return False
    if len(_CALM) > 500_000:
        _CALM.clear()
    new = set(words) - _CALM
    wild = {w for w in new if _THREE.search(w)}
    _CALM.update(new - wild)
    return bool(wild)


def seen(passage: str) -> tuple[str, bool, list[str]]:
    """(plain form, whether something was disguised, its words)."""
    low = passage.lower()
    plain_ascii = passage.isascii()
    if (plain_ascii or _QUIET.fullmatch(passage)) and not (_MAYBE.search(low) and _MARK.search(low)):
        words = low.encode().translate(_BLANKS).decode().split() if plain_ascii else _WORD.findall(low)
        if not _stretched(words) and (plain_ascii and _SINGLES.isdisjoint(words) or not _ALONE.search(low)):
            return " ".join(low.split()).replace("’", "'"), False, words
    low, hidden = plain(passage)
    return low, hidden, _WORD.findall(low)


def pattern(low: str, hidden: bool, words: list[str]) -> int:
    """The voters that speak, as bits. A voter is tried only where the passage has one of its words."""
    out = 0
    hit = _KNOWN.intersection(words)
    if hit:
        may = 0
        for w in hit:
            may |= _BITS[w]
        k = 0
        for _, _, p in _PRO:
            if may >> k & 1 and p.search(low):
                out |= 1 << k
            k += 1
        k += 1
        for _, _, p in _CON:
            if may >> k & 1 and (p is None or p.search(low)):
                out |= 1 << k
            k += 1
    if hidden and not STRONG.isdisjoint(words):
        out |= 1 << DISGUISED
    return out


def votes(passage: str) -> tuple[tuple[int, ...], str]:
    """Votes by voter (1 abusive, -1 harmless, 0 none) and the plain form."""
    low, hidden, words = seen(passage)
    bits = pattern(low, hidden, words)
    return tuple(int(s) if bits >> k & 1 else 0 for k, s in enumerate(SIDE)), low


def passages(text: str | None) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(text)) if s] if text else []


def unpacked(patterns: np.ndarray) -> np.ndarray:
    """Patterns as a matrix of voters that speak."""
    return (patterns[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)


_LOUD = (1 << DISGUISED + 1) - 1
#: Share of passages without a voter for "abusive" that may be abusive at most while the model is fitted: without a voter the
#: classes cannot be told apart, and the likelihood alone would let the larger one split.
SILENT = 1e-4
#: What a voter is credited with beforehand.
RIGHT, WRONG = 4.0, 1.0


class LabelModel:
    """Two classes; each voter speaks, or not, with class-dependent rates. EM over pattern counts; evidence of
    correlated voters is discounted by their estimated correlation given the class."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 40):
        fired = unpacked(patterns)
        # start: a voter for "abusive" is good evidence, a voter for "harmless" some, and a passage without votes harmless
        q = 1 / (1 + np.exp(-(fired @ np.where(SIDE > 0, 3.0, -1.6) - 4.0)))
        quiet = patterns & _LOUD == 0
        for _ in range(rounds):
            w1, w0 = counts * q, counts * (1 - q)
            # a voter nobody has heard yet counts as having been right RIGHT times and wrong WRONG times
            self.p1 = (fired.T @ w1 + np.where(SIDE > 0, RIGHT, WRONG)) / (w1.sum() + RIGHT + WRONG)
            self.p0 = (fired.T @ w0 + np.where(SIDE > 0, WRONG, RIGHT)) / (w0.sum() + RIGHT + WRONG)
            self.p1 = np.where(SIDE > 0, np.maximum(self.p1, self.p0 * 1.5), np.minimum(self.p1, self.p0 / 1.5)).clip(1e-9, 1 - 1e-6)
            self.p0 = self.p0.clip(1e-9, 1 - 1e-6)
            self.prior = float((w1.sum() + 1) / (counts.sum() + 20))
            self.weight = self._discount(fired, w1, w0)
            q = self.posterior(patterns)
            q[quiet] = np.minimum(q[quiet], SILENT)

    def _discount(self, fired, w1, w0) -> np.ndarray:
        total = max(float(w1.sum() + w0.sum()), 1e-9)
        rho = 0.0
        for w, p in ((w1, self.p1), (w0, self.p0)):
            r = (fired - p) / np.sqrt(p * (1 - p))
            rho = rho + (r * (w / total)[:, None]).T @ r
        rho = np.clip(np.asarray(rho), 0, 1)
        np.fill_diagonal(rho, 0)
        return 1 / (1 + rho.sum(1))

    def accuracy(self) -> dict[str, float]:
        """Probability that a vote is right, by voter."""
        a, b = self.p1 * self.prior, self.p0 * (1 - self.prior)
        return {n: float((a if s > 0 else b)[k] / (a + b)[k]) for k, (n, s) in enumerate(zip(VOTERS, SIDE))}

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior)) + unpacked(patterns) @ (self.weight * np.log(self.p1 / self.p0))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


#: Weight of abusive passages in the sample.
ABUSIVE_WEIGHT = 0.25


class Features:
    """Hashed words and neighbours of passages, many at once. Hashes of words are kept between calls."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}

    def _hash(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        if len(ids) > 500_000:
            ids.clear()
        for w in set(words).difference(ids):
            ids[w] = zlib.crc32(w.encode())
        return np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))

    def __call__(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, passage, weight) of every feature; a passage of n features weighs each 1 / sqrt(n + 1)."""
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        h = self._hash([w for ws in lists for w in ws])
        row = np.repeat(np.arange(len(lists)), sizes)
        if not len(h):
            return np.zeros(0, np.int64), row, np.zeros(0)
        two = row[:-1] == row[1:]
        pair = (h[:-1] * 1_000_003 + h[1:] * 7_919 + 12_345) & 0xFFFFFFFF
        idx = np.concatenate((h * 2654435761 % (1 << 32) >> 16, (pair[two] * 2654435761 % (1 << 32)) >> 16)) % BUCKETS
        rows = np.concatenate((row, row[1:][two]))
        n = 2 * sizes - (sizes > 0)
        return idx, rows, 1 / np.sqrt(n[rows] + 1)


def train(lists: list[list[str]], patterns: np.ndarray, soft: np.ndarray, weights: np.ndarray, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weighted logistic regression on soft labels by full-batch adaptive gradients: BUCKETS weights of words, one a voter, and
    the bias. `start` has the label model's weights of the voters and bias, where voters that the sample lacks stay."""
    idx, rows, val = Features()(lists)
    fired = unpacked(patterns)
    n, v = len(lists), len(VOTERS)
    w = np.zeros(BUCKETS)
    u = start.copy()
    gw, gu = np.full(BUCKETS, 1e-8), np.full(v + 1, 1e-8)
    weights = weights / weights.sum()
    for _ in range(rounds):
        z = np.bincount(rows, w[idx] * val, n) + fired @ u[:v] + u[v]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft) * weights
        dw = np.bincount(idx, e[rows] * val, BUCKETS) + 1e-4 * w
        du = np.append(fired.T @ e, e.sum()) + 1e-5 * (u - start)
        gw += dw * dw
        gu += du * du
        w -= 0.15 * dw / np.sqrt(gw)
        u -= 0.15 * du / np.sqrt(gu)
    return np.concatenate((w, u)).astype(np.float32)


def scores(weights: np.ndarray, lists: list[list[str]], patterns: np.ndarray, features: Features) -> np.ndarray:
    idx, rows, val = features(lists)
    z = np.bincount(rows, weights[idx] * val, len(lists)) + unpacked(patterns) @ weights[BUCKETS:-1] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# Ordinary sentences that address or judge, in several registers; votes label them like any other.
EVERYDAY = """
Could you send me your slides?|Thank you for your patience.|Do you know where the room is?|Your talk was the best of the term.|I hope you enjoy the seminar.|Let me know what you think.
We will meet in the usual room.|They will send the notes tomorrow.|All students should be on the list by Friday.|These people are very kind.|Those results are hard to believe.|They are all from the same department.|People like them make the group a pleasure.
She broke her arm skiing and cannot come.|I am sorry for your loss.|My head hurts, I will stay at home.|You should get some rest.|Get well soon.|We ought to thank everyone who helped.|Every one of those speakers was excellent.|The dogs in the yard are noisy.|We saw rats in the lab animal facility.|The visitors crossed the border without trouble.
You must submit your form by noon.|You can reach me at any time.|We will miss you when you leave.|I would trust any of you with the keys.|Come in and take off your coat.|The heating is off, wear warm clothes.|Your face is familiar, have we met?|That was a stupid mistake of mine.|I felt dumb when I saw the solution.|It was a dirty trick to test on the training set.
Could you pass the salt?|You look great today.|The party is at our house, all are invited.|They moved into their new house.|You did it again, well done!|We shot the video in the main hall.|The deadline is dead serious this time.|I will break the talk into two parts.|You two should talk to each other.|Do not shut the door, please.
Kannst du mir die Folien schicken?|Wir treffen uns um zwölf in der Mensa.|Vielen Dank für Ihren Vortrag.|Du bist herzlich eingeladen.|Pouvez-vous fermer la porte ?|Merci pour votre exposé.|Tu viens à la réunion demain ?|Nous vous attendons dans la salle habituelle.
""".replace("\n", "|").strip("|").split("|")

#: Passages whose votes or score a task keeps at hand.
KNOWN = 100_000
#: Candidates kept for each pattern in a task: many for patterns without a voter for "abusive", for these stand for most text.
QUIET_SLOTS, LOUD_SLOTS = 4096, 256


def fit(docs: DataFrame, text: str = "text") -> tuple[LabelModel, np.ndarray]:
    """Label model from the vote patterns of all passages; classifier from a bounded sample of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}
        known: dict[str, tuple[int, int]] = {}  # passages often recur
        for b in batches:
            for t in b["t"]:
                for p in passages(t):
                    got = known.get(p)
                    if got is None:
                        if len(known) > KNOWN:
                            known.clear()
                        got = known[p] = pattern(*seen(p)), zlib.crc32(p.encode("utf-8", "replace"))
                    bits, h = got
                    slot = (bits, h % (LOUD_SLOTS if bits & _LOUD else QUIET_SLOTS))
                    got = held.get(slot)
                    if got is None:
                        held[slot] = [1, h, p]
                    else:
                        got[0] += 1
                        if (h, p) < (got[1], got[2]):
                            got[1], got[2] = h, p
        if held:
            yield pd.DataFrame([(v, s, n, h, p) for (v, s), (n, h, p) in held.items()], columns=["v", "slot", "n", "h", "p"])

    each = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(count, "v int, slot int, n long, h long, p string")
    each = cut(each.groupBy("v", "slot").agg(F.sum("n").alias("n"), F.min(F.struct("h", "p")).alias("m")))
    counted = each.groupBy("v").agg(F.sum("n").alias("n"), F.count("*").alias("c")).orderBy("v").collect()  # at most 2^voters
    if not counted:
        return LabelModel(np.zeros(1, np.int64), np.ones(1)), np.zeros(BUCKETS + len(VOTERS) + 1, np.float32)
    pats = np.array([r.v for r in counted], dtype=np.int64)
    model = LabelModel(pats, np.array([float(r.n) for r in counted]))
    # every pattern gets the same share, or all it has, as far as the bound allows
    have, share = np.array([r.c for r in counted]), 1
    while np.minimum(have, 2 * share).sum() <= SAMPLE_PASSAGES and share < QUIET_SLOTS:
        share *= 2
    low = F.col("slot") < F.ceil(F.lit(share) * F.when(F.col("v").bitwiseAND(_LOUD) > 0, F.lit(LOUD_SLOTS)).otherwise(F.lit(QUIET_SLOTS)) / F.greatest(F.col("c"), F.lit(share)))
    shares = docs.sparkSession.createDataFrame([(int(r.v), int(r.c)) for r in counted], "v int, c long")
    sample = each.join(F.broadcast(shares), "v").where(low).select("v", "m.p").orderBy(F.xxhash64("p"), "p").limit(SAMPLE_PASSAGES).collect()
    bits = [r.v for r in sample]
    lists = [seen(r.p)[2] for r in sample]
    n_of = dict(zip(pats.tolist(), [float(r.n) for r in counted]))
    taken = pd.Series(bits).value_counts().to_dict() if bits else {}
    weights = [(n_of[b] / taken[b]) ** 0.5 for b in bits]
    for s in EVERYDAY:
        low_, hidden, words = seen(s)
        lists.append(words)
        bits.append(pattern(low_, hidden, words))
        weights.append(float(np.median(weights)) * 3 if weights else 1.0)
    b = np.array(bits, dtype=np.int64)
    soft = model.posterior(b)
    w = np.array(weights)
    one = soft > 0.5
    if one.any() and not one.all():
        w[one] *= ABUSIVE_WEIGHT / (1 - ABUSIVE_WEIGHT) * w[~one].sum() / w[one].sum()
    ratio = np.clip(model.weight * np.log(model.p1 / model.p0), -4, 8)
    return model, train(lists, b, soft, w, np.append(ratio, np.log(model.prior / (1 - model.prior))))


def scored(docs: DataFrame, fitted: tuple[LabelModel, np.ndarray], text: str = "text") -> DataFrame:
    """`docs` with `score` in [0, 1] and the worst `passage`. The classifier is some 65,600 floats whatever the data."""
    held = docs.sparkSession.sparkContext.broadcast(fitted[1])

    @F.pandas_udf("score double, passage string")  # type: ignore[call-overload]
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features, w = Features(), held.value.astype(np.float64)
        known: dict[str, float] = {}
        for s in batches:
            best, where = np.zeros(len(s)), [None] * len(s)
            lists, bits, doc, texts = [], [], [], []

            def settle() -> None:
                for d, z, p in zip(doc, scores(w, lists, np.array(bits, dtype=np.int64), features), texts):
                    known[p] = z
                    if z > best[d]:
                        best[d], where[d] = z, p
                for x in (lists, bits, doc, texts):
                    x.clear()

            for d, t in enumerate(s):
                for p in passages(t):
                    z = known.get(p)
                    if z is not None:
                        if z > best[d]:
                            best[d], where[d] = z, p
                        continue
                    low, hidden, words = seen(p)
                    lists.append(words)
                    bits.append(pattern(low, hidden, words))
                    doc.append(d)
                    texts.append(p)
                if len(lists) > 5_000:
                    settle()
            if len(known) > KNOWN:
                known.clear()
            if lists:
                settle()
            yield pd.DataFrame({"score": best, "passage": where})

    return docs.withColumn("_s", run(F.col(text))).select(*[F.col(c) for c in docs.columns if c not in ("score", "passage")], "_s.score", "_s.passage")


def rates(scores: DataFrame, source: str = "source", bar: float = 0.5) -> DataFrame:
    """Documents, abusive ones and their rate by source; partial counts are combined before the shuffle."""
    g = scores.groupBy(F.col(source)).agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= bar).alias("abusive"))
    return g.withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))
