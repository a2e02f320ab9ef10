"""Rows of one table that record the same talk, and the best record of each group.

Grouping. Rows that say the same (day, term, title, speakers) are one node. Nodes meet on day and a word of a speaker's
name (one letter of a family name may be missing); a node without speaker meets on day and a piece of the title; nodes
without a day meet within their term on the same keys. Two nodes are one talk if a speaker agrees and the titles agree,
one may be cut. A node without title, or without day, joins the one talk it can belong to; where there are several it
stays alone.

Best record (method). Fields that depend on each other form bundles: title and abstract, room and time. A candidate for a
bundle is one source record taken whole; what it lacks, or has only cut, is filled from the best record that is
consistent with it. A functional dependency binds across fields and bundles: every value comes from a record whose
title, where it has one, is the surviving title. Of all combinations of candidates, one a bundle, branch and bound finds
the one of most trust; the trust of a value is its rank among the group's values of the field: whole before cut, then
the last ingested, then the most trusted feed, then the least row.

Scale. Row-wise maps and joins on narrow hashed keys. Records of a group are made distinct on (title, abstract, whether
there is a room, a time) before they are gathered, the last ingested standing for the rest, so a talk read a million
times is gathered as its few spellings.

Defined results: null, blank and placeholder values never survive; a group without real value in a field has no
row for it; a single row is no group; ties go to the smallest row_id.
"""

from __future__ import annotations

import difflib
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm import garbled, lookalikes, names
from plinth.llm.entities import _relabel
from plinth.operators.timestamps import stamped, year_in
from plinth.session import cut, small

FIELDS = ("title", "abstract", "room", "time")
#: Feeds up to which their table is broadcast.
FEEDS = 10_000
#: Keys of records without speaker up to which they are broadcast (16 bytes each).
MUTE = 200_000
#: Parts in which forms of words meet, one after the other.
SLICES = 2
BUNDLES = (("title", "abstract"), ("room", "time"))
# Placeholders in plain form; title words that say nothing.
PLACEHOLDERS = {"", "na", "n/a", "n.a", "n.a.", "tba", "tbd", "tbc", "none", "null", "nil", "nan", "-", "--", "---", "—", "–", "?", "??", "???", "x", "xxx", ".", "...", "…", "unknown", "to be announced", "to be determined",
                "to be confirmed", "date to be announced", "see website", "no title", "untitled", "title tba", "title to be announced", "not available", "n.n.", "nn", "pending", "room tba", "time tba", "abstract tba", "no abstract", "-tba-", "(tba)", "[tba]", "t.b.a.", "t.b.d.", "coming soon", "see above", "missing"}
_DROP = {"a", "an", "the", "of", "on", "for", "in", "with", "and", "to", "from", "under", "note", "talk", "s"}
_CUT = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…|more|cut|truncated)\s*\]|\(\s*(?:\.\.\.|…|more|cut|truncated)\s*\)|\.{2,}|…)\s*$", re.I)
_LABEL = re.compile(r"^(?:\[[^\]]{1,12}\]|(?:talk|title|seminar|paper)\s*:)\s*")


def is_placeholder(v: str | None) -> bool:
    if v is None:
        return True
    if len(v) > 60 and sum(map(str.isalnum, v)) > 30:  # longer than any placeholder
        return False
    return " ".join((lookalikes.canonical(v) or "").lower().split()) in PLACEHOLDERS


def restored(v: str) -> str:
    if v.isascii():
        return v
    back = lookalikes._undamaged(v)
    if back == v:
        m = garbled.invert(v, "cp1252>mac_roman")
        back = m if m is not None else v
    return back


def title_forms(v: str | None) -> tuple[str, list[str]]:
    """(letters and digits, words that say something) of a title, repaired and folded, without cut mark and label before
    it; nothing for a placeholder."""
    if not isinstance(v, str) or is_placeholder(v):
        return "", []
    s = _LABEL.sub("", _CUT.sub("", names.fold(restored(v)))).replace("�", "")
    return re.sub(r"[\W_]+", "", s), [w for w in re.findall(r"[^\W_]+", s) if w not in _DROP]


def squeezed(v: str | None) -> str:
    if not v:
        return ""
    return re.sub(r"[\W_]+", "", _LABEL.sub("", _CUT.sub("", names.fold(restored(v)))).replace("�", ""))


_NUMBER_TAIL = re.compile(r"\d+|[ivx]+|part[ivx\d]+")
_DIGITS_LAST = re.compile(r"\d+$")


def titles_agree(a: str, b: str) -> bool:
    """Two squeezed titles: the same, one the beginning of the other, or a few letters apart."""
    if not a or not b:
        return False
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(a) >= 10 and b.startswith(a):
        return not _NUMBER_TAIL.fullmatch(b[len(a) :])
    if len(a) < 8:
        return False
    x, y = _DIGITS_LAST.search(a), _DIGITS_LAST.search(b)
    if x and y and x.group() != y.group():
        return False
    head = b[: len(a)] if len(a) < 0.9 * len(b) else b
    i, n = 0, min(len(a), len(head))  # one slip between what is common on both ends
    while i < n and a[i] == head[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == head[-1 - j]:
        j += 1
    if i + j >= 0.45 * (len(a) + len(head)):
        return True
    m = difflib.SequenceMatcher(None, a, head, autojunk=False)
    return m.quick_ratio() >= 0.88 and m.ratio() >= 0.9


def speakers_agree(a: list[str], b: list[str]) -> bool:
    """Whether a speaker of one cell can be a speaker of the other."""
    for x in a:
        px = names.parts(x)
        for y in b:
            if x == y:
                return True
            py = names.parts(y)
            for p, q in ((px, py), (px and (px[2], px[1], px[0]), py)):
                if p and q and p[2] and q[2] and (p[2] == q[2] or min(len(p[2]), len(q[2])) >= 4 and names.near(p[2], q[2])) and names.given_level(p[0], q[0]):
                    return True
            tx, ty = names._org(x), names._org(y)
            if max(len(tx), len(ty)) >= 3 and (names.org_match(list(tx), list(ty)) or names.org_match(list(ty), list(tx))):
                return True
    return False


def name_words(cell: list[str]) -> set[str]:
    """Words of a cell's names, family names of several words also as one: cells that agree have one in common, or two within
    one edit."""
    out: set[str] = set()
    for n in cell:
        out.update(re.findall(r"[^\W\d_]{2,}", n))
        p = names.parts(n)
        if p and len(p[2]) >= 2:
            out.add(p[2])
    return out


def words_of(find):
    """Column function: the words that `find` finds in a cell."""

    @F.pandas_udf("array<string>")  # type: ignore[call-overload]
    def run(cells: pd.Series) -> pd.Series:
        return pd.Series([sorted(find(c)) for c in cells])

    return run


def forms(w: Column) -> Column:
    """A word and it with one letter missing, for words of four letters and more: two within one edit share a form. The
    damaged character is none."""
    v = F.replace(w, F.lit("�"), F.lit(""))
    n = F.length(v)
    gone = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, n)))
    return F.when(n >= 4, F.array_distinct(F.concat(F.array(v), gone))).otherwise(F.array().cast("array<string>"))


def near_words(left: DataFrame, right: DataFrame, *where: str) -> DataFrame:
    """(x, y) of different words of both sides that share a form within equal `where`, hashed together with it; every word
    counts once there, however many records have it. Each side is (*where, w). Both are exploded in one table that meets
    itself, so that its forms move once."""
    sides = [d.select(*where, "w", F.lit(n).alias("_s")) for d, n in ((left, 1), (right, 2))]
    words = cut(sides[0].union(sides[1]).groupBy(*where, "w").agg(F.bit_or("_s").alias("_s")))
    form = words.select(*where, "w", "_s", F.explode(forms(F.col("w"))).alias("f")).select(F.xxhash64(*where, "f").alias("k"), F.xxhash64(*where, "w").alias("x"), "_s")
    # products of both sides' marks: a condition on either alone would make the two shuffles differ
    there, back = (F.col("_s").bitwiseAND(m) * F.col("_t").bitwiseAND(3 - m) == 2 for m in (1, 2))
    met = []
    for n in range(SLICES):  # the forms of one slice lie on the disk at a time
        part = form.where(F.pmod("k", F.lit(SLICES)) == n)
        both = part.join(part.toDF("k", "y", "_t"), "k").where((there | back) & (F.col("x") < F.col("y")))
        met.append(cut(both.select("x", "y", there.alias("there"), back.alias("back")).distinct()))
    met = reduce(DataFrame.union, met)
    return met.where("there").select("x", "y").union(met.where("back").select("y", "x")).distinct()


def met_by_name(left: DataFrame, right: DataFrame, *where: str, ordered: bool = False) -> DataFrame:
    """(na, nb) of nodes of both sides, within equal `where`, that have a name word in common or two within one edit, and
    whose titles may agree (`title_marks`); with `ordered` only na < nb. Each side is (node, *where, w, marks), one row a
    word. Only hashed words move to find those within one edit, and pairs are judged by the marks where they meet."""
    word = lambda d, e: d.select(F.col("node").alias(f"n{e}"), F.xxhash64(*where, "w").alias("x"), *[F.col(c).alias(f"{c}_{e}") for c in MARKS])
    fits = marks_agree("a", "b") & (F.col("na") < F.col("nb") if ordered else F.col("na") != F.col("nb"))
    same = cut(word(left, "a").join(word(right, "b"), "x").where(fits).select("na", "nb").distinct())
    near = cut(near_words(left.select(*where, "w"), right.select(*where, "w"), *where))
    typed = word(left, "a").join(near, "x").drop("x").withColumnRenamed("y", "x").join(word(right, "b"), "x").where(fits)
    return cut(same.union(typed.select("na", "nb")).distinct())


def _forms():
    @F.pandas_udf("st string, w array<string>")  # type: ignore[call-overload]
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([title_forms(x) for x in s], columns=["st", "w"])

    return run


def _said():
    @F.pandas_udf("array<string>")  # type: ignore[call-overload]
    def run(s: pd.Series) -> pd.Series:
        known: dict = {}
        for x in s:
            if x not in known:
                known[x] = names.speakers(x) if isinstance(x, str) and not is_placeholder(x) else []
        return pd.Series([known[x] for x in s])

    return run


def prepared(records: DataFrame, feeds: DataFrame, raw: str, year: str) -> DataFrame:
    """`records` with day (local to the feed), said (speakers), st (squeezed title) and w (title words)."""
    r = records.join(small(feeds.select("feed", "zone", "date_order"), FEEDS), "feed", "left")
    r = stamped(r, F.col(raw), F.col("zone"), F.col("date_order"), year_in(F.col(year)))
    local = F.when(F.length("canon") > 10, F.date_format(F.from_utc_timestamp(F.try_to_timestamp(F.rtrim(F.regexp_replace("canon", "[TZ]", " ")), F.lit("yyyy-MM-dd HH:mm")), F.col("zone")), "yyyy-MM-dd")).otherwise(F.col("canon"))
    return r.withColumn("day", local).withColumn("said", _said()("speaker_raw")).withColumn("_t", _forms()("title")).withColumns({"st": F.col("_t.st"), "w": F.col("_t.w")}).drop("_t")


def title_keys(st: Column, w: Column) -> Column:
    """Pieces of which two titles that agree share one: neighbouring words, and the first and last letters."""
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(pairs, F.when(st != "", F.array(F.substring(st, 1, 8), F.substring(st, -8, 8))).otherwise(F.array().cast("array<string>"))))


def may_agree(sa: Column, wa: Column, sb: Column, wb: Column) -> Column:
    """Whether two titles (squeezed, hashed words) can be one: two words in common, or the same beginning or end, or one is
    missing. Titles that agree differ in a letter in ten at most, or in a word in five."""
    return (sa == "") | (sb == "") | (F.substring(sa, 1, 8) == F.substring(sb, 1, 8)) | (F.substring(sa, -8, 8) == F.substring(sb, -8, 8)) | (F.size(F.array_intersect(wa, wb)) >= 2)


MARKS = ("tp", "te", "tw")


def title_marks(st: Column, w: Column) -> dict[str, Column]:
    """What `may_agree` looks at, hashed: the beginning and the end (null for no title) and the words."""
    end = lambda c: F.when(st != "", F.hash(c))
    return {"tp": end(F.substring(st, 1, 8)), "te": end(F.substring(st, -8, 8)), "tw": F.transform(w, lambda x: F.hash(x))}


def marks_agree(a: str, b: str) -> Column:
    """`may_agree` of two sets of marks, for joins that carry no texts."""
    c = lambda n, e: F.col(f"{n}_{e}")
    return c("tp", a).isNull() | c("tp", b).isNull() | (c("tp", a) == c("tp", b)) | (c("te", a) == c("te", b)) | (F.size(F.array_intersect(c("tw", a), c("tw", b))) >= 2)


def listed(joined: Column, sep: str) -> Column:
    """The array of which `joined` is the text."""
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, sep))


def _hashed(df: DataFrame, keys: Column, *where: str) -> DataFrame:
    """(node, k): one row a key, hashed together with the columns it holds within."""
    return df.select("node", *where, F.explode(keys).alias("_key")).select("node", F.xxhash64(*where, "_key").alias("k"))


def groups(talks: DataFrame, feeds: DataFrame) -> DataFrame:
    """(row_id, grp, day, said, st, w) of every row: rows with the same grp record one talk."""
    cols = talks.select("row_id", "feed", "term", "date_raw", "speaker_raw", "title")
    rows = prepared(cols, feeds, "date_raw", "term").select("row_id", "day", "term", "st", "said", "w")
    # arrays lie as text between steps: no name holds a line break, no word a space
    rows = rows.withColumn("node", F.xxhash64("day", "term", "st", "said")).withColumns({"said": F.concat_ws("\n", "said"), "w": F.concat_ws(" ", "w"), "term": F.xxhash64("term")})
    rows = cut(rows)
    plain = cut(rows.dropDuplicates(["node"]).select("node", "day", "term", "st", "said", "w", F.concat_ws(" ", words_of(name_words)(listed(F.col("said"), "\n"))).alias("names")))
    rows = cut(rows.select("row_id", "node"))
    nodes = plain.select("node", "day", "term", "st", listed(F.col("said"), "\n").alias("said"), listed(F.col("w"), " ").alias("w"), "names")

    @F.pandas_udf("int")  # type: ignore[call-overload]
    def judge(da: pd.Series, db: pd.Series, sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        """3 one talk; 2 perhaps, one has no day; 1 perhaps, one has no title; 0 no."""
        out = []
        for x, y, s, t, m, n in zip(da, db, sa, sb, na, nb):
            dated = isinstance(x, str), isinstance(y, str)
            m, n = list(m), list(n)
            named = None if not m or not n else m == n or speakers_agree(m, n)
            if named is False or named is None and min(len(s), len(t)) < 20:
                out.append(0)
            elif s and t:
                out.append(0 if not titles_agree(s, t) else 3 if dated[0] == dated[1] else 2)
            else:
                out.append(1 if named and all(dated) else 0)
        return pd.Series(out, dtype="int32")

    # blocks are joined on hashes, with nothing but the node's number beside them
    spoken, mute = nodes.where(F.size("said") > 0), nodes.where((F.size("said") == 0) & (F.length("st") >= 20))
    dated, undated = F.col("day").isNotNull(), F.col("day").isNull()
    pieces = title_keys(F.col("st"), F.col("w"))
    named = spoken.select("node", "day", "term", F.explode(listed(F.col("names"), " ")).alias("w"), *[c.alias(n) for n, c in title_marks(F.col("st"), F.col("w")).items()])
    met = [met_by_name(named.where(dated), named.where(dated), "day", ordered=True), met_by_name(named.where(undated), named, "term")]
    titled = nodes.where(F.length("st") >= 20)
    met.append(cut(small(_hashed(mute.where(dated), pieces, "day"), MUTE).toDF("na", "k").join(_hashed(titled.where(dated), pieces, "day").toDF("nb", "k"), "k").select("na", "nb").distinct()))
    met.append(cut(small(_hashed(mute.where(undated), pieces, "term"), MUTE).toDF("na", "k").join(_hashed(titled, pieces, "term").toDF("nb", "k"), "k").select("na", "nb").distinct()))
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.union(more.where(F.col("na") != F.col("nb")).select(F.least("na", "nb"), F.greatest("na", "nb")))
    pairs = pairs.distinct()
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(*[F.col(c).alias(f"{c}_{end}") for c in ("node", "day", "st", "said")], F.transform("w", lambda x: F.hash(x)).alias(f"w_{end}")), F.col(f"n{end}") == F.col(f"node_{end}"))
    pairs = pairs.where(may_agree(*[F.col(c) for c in ("st_a", "w_a", "st_b", "w_b")]))
    edges = pairs.withColumn("level", judge("day_a", "day_b", "st_a", "st_b", "said_a", "said_b")).where(F.col("level") > 0)
    edges = cut(edges.select("node_a", "node_b", "level", F.col("day_a").isNull().alias("ua"), F.col("day_b").isNull().alias("ub"), (F.col("st_a") == "").alias("ta"), (F.col("st_b") == "").alias("tb")))
    lab = nodes.select("node", F.col("node").alias("label"))
    lab = _relabel(lab, edges.where(F.col("level") == 3).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    for level, ea, eb in ((1, "ta", "tb"), (2, "ua", "ub")):
        weak = edges.where((F.col("level") == level) & (F.col(ea) != F.col(eb)))
        weak = weak.select(F.when(F.col(ea), F.col("node_a")).otherwise(F.col("node_b")).alias("w"), F.when(F.col(ea), F.col("node_b")).otherwise(F.col("node_a")).alias("s"))
        weak = weak.join(lab.toDF("w", "lw"), "w").join(lab.toDF("s", "ls"), "s").where(F.col("lw") != F.col("ls"))
        one = weak.groupBy("lw").agg(F.min("ls").alias("b"), F.max("ls").alias("m")).where(F.col("b") == F.col("m")).select(F.col("lw").alias("a"), "b")
        lab = _relabel(lab, one)
    grouped = cut(rows.join(lab, "node").select("row_id", "node", F.col("label").alias("grp")))
    return grouped.join(nodes, "node").select("row_id", "grp", "day", "said", "st", "w")


# ---- best record


def _order(field: str, v: str, whole: bool, r: dict) -> tuple:
    """Trust of a value of record `r`: whole ones, then (if cut) longer ones, then the last ingested."""
    return (whole, 0 if whole else len(v), r["at"], r["trust"], -r["row"])


def _whole(records: list[dict]) -> dict[tuple[str, str], bool]:
    """For every (field, value) whether it is whole: without cut mark, not ending within a sentence, and not the beginning
    of a longer value of the group. In sorted order what begins with a text follows it at once."""
    out: dict[tuple[str, str], bool] = {}
    for f in FIELDS:
        values = {r[f] for r in records if r[f] is not None}
        text = f in ("title", "abstract")
        for v in values:
            out[f, v] = not text or not (_CUT.search(v) or f == "abstract" and len(v) > 60 and v.rstrip()[-1:].isalnum())
        if text and len(values) > 1:
            bare = sorted((squeezed(v), len(_CUT.sub("", v)), v) for v in values)
            for k, (s, n, v) in enumerate(bare):
                j = k + 1
                while j < len(bare) and bare[j][0] == s:
                    j += 1
                while s and j < len(bare) and bare[j][0].startswith(s):
                    if bare[j][1] > n:
                        out[f, v] = False
                        break
                    j += 1
    return out


def independent(records: list[dict]) -> dict[str, int]:
    """The best value of every field by itself, dependencies left aside: field -> index of its record."""
    whole = _whole(records)
    best = {f: max((k for k, r in enumerate(records) if r[f] is not None), key=lambda k: _order(f, records[k][f], whole[f, records[k][f]], records[k]), default=None) for f in FIELDS}
    return {f: k for f, k in best.items() if k is not None}


def survivors(records: list[dict], bundles: tuple[tuple[str, ...], ...] = BUNDLES) -> dict[str, int]:
    """field -> index of the record whose value survives, by branch and bound over whole bundles. A record is {row, at,
    trust, st, title, abstract, room, time}; None is no value."""
    whole = _whole(records)
    rank: dict[str, dict[int, int]] = {}
    for f in FIELDS:
        have = sorted((k for k, r in enumerate(records) if r[f] is not None), key=lambda k: _order(f, records[k][f], whole[f, records[k][f]], records[k]))
        rank[f] = {k: n for n, k in enumerate(have, 1)}
    fits: dict[tuple[int, int], bool] = {}

    def together(a: int, b: int) -> bool:  # the dependency: records of one title, or without
        if (a, b) not in fits:
            x, y = records[a]["st"], records[b]["st"]
            fits[a, b] = fits[b, a] = a == b or not x or not y or titles_agree(x, y)
        return fits[a, b]

    best: tuple[int, dict[str, int]] = (-1, {})
    top = [sum(max(rank[f].values(), default=0) for f in b) for b in bundles]
    bound = [sum(top[i:]) for i in range(len(bundles) + 1)]

    def candidates(fields: tuple[str, ...], used: list[int]):
        """(trust, field -> record) of every record taken whole, the most promising first; gaps filled consistently."""
        leads = sorted((k for k in range(len(records)) if any(k in rank[f] for f in fields) and all(together(k, u) for u in used)), key=lambda k: -max(rank[f].get(k, 0) for f in fields))
        for k in leads:
            got, taken = {f: k for f in fields if k in rank[f] and whole[f, records[k][f]]}, [*used, k]
            for f in fields:
                if f not in got:
                    fill = max((j for j in rank[f] if all(together(j, u) for u in taken)), key=rank[f].get, default=None)
                    if fill is not None:
                        got[f] = fill
                        taken.append(fill)
            yield sum(rank[f][j] for f, j in got.items()), got

    def branch(i: int, mark: int, chosen: dict[str, int]) -> None:
        nonlocal best
        if i == len(bundles):
            if mark > best[0]:
                best = (mark, dict(chosen))
            return
        empty = True
        for worth, got in candidates(bundles[i], list(chosen.values())):
            if mark + bound[i] <= best[0]:  # nothing below can be better
                return
            empty = False
            if mark + worth + bound[i + 1] > best[0]:
                branch(i + 1, mark + worth, {**chosen, **got})
        if empty or mark + bound[i + 1] > best[0]:
            branch(i + 1, mark, chosen)  # the bundle left out

    branch(0, 0, {})
    return best[1]


def best_records(talks: DataFrame, feeds: DataFrame, grouped: DataFrame | None = None) -> DataFrame:
    """(first_row_id, field, row_id) for every talk with two or more rows."""
    grouped = (grouped if grouped is not None else groups(talks, feeds)).select("row_id", "grp", F.xxhash64("st").alias("t"))
    size = grouped.groupBy("grp").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("c")).where(F.col("c") > 1).select("grp", "first_row_id")

    @F.pandas_udf("boolean")  # type: ignore[call-overload]
    def real(s: pd.Series) -> pd.Series:
        return pd.Series([isinstance(x, str) and not is_placeholder(x) for x in s])

    # narrow first: hashes of real values, and which fields of a talk have several values at all
    h = [f"h_{f}" for f in FIELDS]
    rows = talks.select("row_id", "feed", F.coalesce(F.col("ingested_at").cast("timestamp").cast("double"), F.lit(0.0)).alias("at"), *[F.when(real(f), F.xxhash64(f)).alias(n) for f, n in zip(FIELDS, h)])
    rows = rows.join(grouped.join(size, "grp").select("row_id", "first_row_id", "t"), "row_id").join(small(feeds.select("feed", "trust_rank"), FEEDS), "feed", "left")
    rows = cut(rows.select("first_row_id", F.col("row_id").alias("row"), "at", F.coalesce("trust_rank", F.lit(0)).alias("trust"), "t", *h))
    del grouped, size  # and with them what the grouping left on the disk
    # the smallest row that holds each very string
    held = F.explode(F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(n).alias("h"))) for f, n in zip(FIELDS, h)])).alias("x")
    least = rows.select("first_row_id", "row", held).where("x is not null").groupBy("first_row_id", "x.field", "x.h").agg(F.min("row").alias("row_id"))
    several = rows.groupBy("first_row_id").agg(*[(F.min(n) != F.max(n)).alias(f"m_{f}") for f, n in zip(FIELDS, h)])
    # records that differ in a room or time only: the last ingested stands for the rest
    alike = rows.groupBy("first_row_id", "t", "h_title", "h_abstract", F.col("h_room").isNotNull().alias("r"), F.col("h_time").isNotNull().alias("c"))
    records = alike.agg(F.max_by(F.struct("row", "at", "trust", *h), F.struct("at", "trust", -F.col("row"))).alias("x")).select("first_row_id", "x.*").join(several, "first_row_id")
    # texts move only where there is a choice
    texts = talks.select(F.col("row_id").alias("row"), *FIELDS)
    value = lambda f: F.when(F.col(f"h_{f}").isNotNull(), F.when(F.col(f"m_{f}"), F.col(f)).otherwise(F.lit("x"))).alias(f)
    records = records.join(texts, "row").select("first_row_id", F.struct("row", "at", "trust", *[value(f) for f in FIELDS], F.struct(*[F.col(n).cast("string").alias(n) for n in h]).alias("h")).alias("c"))
    records = records.groupBy("first_row_id").agg(F.collect_list("c").alias("c"))

    @F.pandas_udf("array<struct<field: string, h: string>>")  # type: ignore[call-overload]
    def choose(s: pd.Series) -> pd.Series:
        out = []
        for c in s:
            rs = sorted((dict(x) for x in c), key=lambda r: r["row"])
            for r in rs:  # a single title of the group ("x") agrees with itself
                r["st"] = title_forms(r["title"])[0] if r["title"] != "x" else ""
            out.append([{"field": f, "h": rs[k]["h"][f"h_{f}"]} for f, k in survivors(rs).items()])
        return pd.Series(out)

    won = cut(records.select("first_row_id", F.explode(choose("c")).alias("s")).select("first_row_id", "s.field", F.col("s.h").cast("long").alias("h")))
    return won.join(least, ["first_row_id", "field", "h"]).select("first_row_id", "field", "row_id")
