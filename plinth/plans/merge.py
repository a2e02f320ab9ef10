"""The staged merge of five sources into one list of talks, as one declarative plan per stage.

Sources (DataFrames; `pos` is the order of reading, other columns may be missing and are then null):
index    pos, term, kind, date, date_note, speaker_raw, title, href
pages    pos, path_date, url, speaker_raw, title, abstract, time, room, weekday, paper_url, latex
csv      pos, date, speaker_raw, title, abstract, time, room
sheet    pos, term, kind, label, date, speaker_raw, title, abstract, time, room, note, weekday_override
tables   pos, term, date, speaker_raw, title, paper_url, paper_authors, room, source_page

The key of a record is (date, first speaker's canonical slug), compared null-safely. Stages, each of which only admits
keys no earlier one has: the spine (index entries of kind talk, with the page found by url, else by key, and the first
csv, sheet and table record of the key); pages nobody used, in order, where a page that repeats a talk lends its urls
to that talk; talks of the sheet, and all its other rows; table records with a speaker. Then drop rules and order.

Defined results: an empty source contributes nothing; repeated rows of the spine all stay; a page without readable path
date has a null key date; every disagreement is one line of the log."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import dates as D
from plinth.functions import text as X
from plinth.operators import reconcile as R
from plinth.session import cut

KEY = ["key_date", "key_slug"]
SOURCES = {
    "index": "pos long, term string, kind string, date date, date_note string, speaker_raw string, title string, href string",
    "page": "pos long, path_date date, url string, speaker_raw string, title string, abstract string, time string, room string, weekday string, paper_url string, latex array<string>",
    "csv": "pos long, date date, speaker_raw string, title string, abstract string, time string, room string",
    "sheet": "pos long, term string, kind string, label string, date date, speaker_raw string, title string, abstract string, time string, room string, note string, weekday_override string",
    "table": "pos long, term string, date date, speaker_raw string, title string, paper_url string, paper_authors string, room string, source_page string",
}
TALK = ["stage", "pos", "term", "kind", "label", "date", "date_note", "speakers", "title", "abstract", "time", "room", "note", "weekday_override", "paper_url", "paper_authors", "latex", "legacy_urls", "external_url", "recovered", "sources"]
_STRINGS = "array<string>"


@dataclass
class Merged:
    talks: DataFrame
    conflicts: DataFrame


def speaker_slugs(cells: DataFrame, aliases: DataFrame) -> DataFrame:
    """(speaker_raw, speakers) of distinct cells: the canonical slugs of the speakers in their order."""
    each = cells.select("speaker_raw").where(F.col("speaker_raw").isNotNull()).distinct().select("speaker_raw", F.posexplode(X.split_speakers("speaker_raw")).alias("i", "one"))
    each = R.canonical(each.withColumn("s", X.slugify("one")).where(F.col("s").isNotNull()), "s", aliases, "slug")
    return each.groupBy("speaker_raw").agg(F.array_sort(F.collect_list(F.struct("i", "slug"))).alias("_l")).select("speaker_raw", F.transform("_l", lambda x: x["slug"]).alias("speakers"))


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    want = [c.strip().split(" ", 1) for c in schema.split(", ")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in want])


def _first(df: DataFrame, name: str) -> DataFrame:
    """The first row of each key as one column."""
    k = R.keep_first(df, KEY, [F.col("pos")])
    return k.select(*KEY, F.struct(*[c for c in k.columns if c not in KEY]).alias(name))


def pick_title(*candidates: tuple[str, Column, Column]) -> Column:
    """struct(source, value, conflicts) over candidates (source, title, its norm): of those that are the same title as the
    first the richest, against which every other one is a conflict."""
    arr = F.filter(F.array(*[F.struct(F.lit(s).alias("source"), t.alias("value"), n.alias("norm")) for s, t, n in candidates]), lambda x: x["value"].isNotNull() & (x["value"] != ""))

    def chosen(real: Column) -> Column:
        head = F.get(real, F.lit(0))["norm"]
        same = F.filter(real, lambda x: x["norm"] == head)
        best = R.richest(F.transform(same, lambda x: x["value"]))
        src = F.get(F.filter(same, lambda x: x["value"] == best), F.lit(0))["source"]
        lost = F.transform(F.filter(real, lambda x: x["norm"] != head), lambda x: F.struct(x["source"].alias("source"), x["value"].alias("value")))
        return F.struct(src.alias("source"), best.alias("value"), lost.alias("conflicts"))

    return X.let(arr, chosen)


def pick_speakers(*candidates: tuple[str, Column, Column]) -> Column:
    """struct(source, value, conflicts) over candidates (source, cell, slugs): the first source with any cell wins, even if
    it names nobody; a later one that names others is a conflict."""
    arr = F.filter(F.array(*[F.struct(F.lit(s).alias("source"), raw.alias("raw"), F.coalesce(v, F.array().cast(_STRINGS)).alias("v")) for s, raw, v in candidates]), lambda x: x["raw"].isNotNull() & (x["raw"] != ""))

    def chosen(real: Column) -> Column:
        won = F.get(real, F.lit(0))
        lost = F.filter(real, lambda x: (F.size(x["v"]) > 0) & (x["v"] != won["v"]))
        return F.struct(won["source"].alias("source"), F.coalesce(won["v"], F.array().cast(_STRINGS)).alias("value"), F.transform(lost, lambda x: F.struct(x["source"].alias("source"), F.array_join(x["v"], ",").alias("value"))).alias("conflicts"))

    return X.let(arr, chosen)


def assemble(e: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Talks, and their conflicts, of entries that have the columns of an index entry and whole rows page, csv, sheet and
    table (null where there is none)."""
    at = lambda s, f: F.col(f) if s == "index" else F.col(f"{s}.{f}")
    picked = {
        "title": pick_title(*[(s, at(s, "title"), at(s, "norm")) for s in ("page", "index", "csv", "sheet")]),
        "speaker": pick_speakers(*[(s, at(s, "speaker_raw"), at(s, "speakers")) for s in ("page", "csv", "index", "sheet")]),
        "abstract": R.pick(*[(s, at(s, "abstract")) for s in ("page", "csv", "sheet")]), "paper_url": R.pick(*[(s, at(s, "paper_url")) for s in ("page", "table")]),
        **{f: R.pick(*[(s, at(s, f)) for s in ("csv", "page", "sheet")]) for f in ("time", "room")},
    }
    e = cut(e.withColumns({f"_{f}": p for f, p in picked.items()}))
    key = F.concat_ws(" ", F.coalesce(F.col("date").cast("string"), F.lit("None")), F.coalesce("speaker_raw", F.lit("?")))
    log = [R.conflicts(e.withColumn("_speaker", F.col("_speaker").withField("value", F.array_join("_speaker.value", ","))) if f == "speaker" else e, key, f, f"_{f}") for f in picked]
    internal = F.col("href").isNotNull() & ~X.is_external(F.col("href"))
    none = F.array().cast(_STRINGS)
    urls = F.array_sort(F.array_union(F.when(internal, X.both_paddings(F.col("href"))).otherwise(none), F.when(F.col("page").isNotNull(), X.both_paddings(F.col("page.url"))).otherwise(none)))
    made = {
        "kind": F.lit(None).cast("string"), "label": F.lit(None).cast("string"), "speakers": F.col("_speaker.value"), "title": F.col("_title.value"), "abstract": X.inline_codecogs(F.col("_abstract.value")), "time": F.col("_time.value"), "room": F.col("_room.value"), "note": F.lit(None).cast("string"),
        "weekday_override": F.coalesce(X.blank_to_null(F.col("page.weekday")), X.blank_to_null(F.col("sheet.weekday_override"))), "paper_url": F.col("_paper_url.value"), "paper_authors": X.blank_to_null(F.col("table.paper_authors")), "latex": F.col("page.latex"), "legacy_urls": urls,
        "external_url": F.when(X.is_external(F.col("href")), F.col("href")), "sources": R.signature(("blog_index", F.lit(True)), *[(n, F.col(s).isNotNull()) for n, s in (("blog_page", "page"), ("csv", "csv"), ("sheet", "sheet"), ("table", "table"))]),
    }
    return e.select("stage", "pos", "term", "date", "date_note", "recovered", *KEY, *[c.alias(k) for k, c in made.items()]), log


def merge(index: DataFrame, pages: DataFrame, csv: DataFrame, sheet: DataFrame, tables: DataFrame, aliases: DataFrame, rules: DataFrame) -> Merged:
    src = {n: _shaped(df, SOURCES[n]) for n, df in zip(SOURCES, (index, pages, csv, sheet, tables))}
    slugs = cut(speaker_slugs(reduce(DataFrame.union, [d.select("speaker_raw") for d in src.values()]), aliases))
    for n, d in src.items():
        d = d.join(slugs, "speaker_raw", "left").withColumn("speakers", F.coalesce("speakers", F.array().cast(_STRINGS)))
        if n == "sheet":
            d = d.withColumn("kind", F.coalesce("kind", F.lit("talk")))
        src[n] = cut(d.withColumns({"norm": X.title_norm("title"), "key_date": F.col("path_date" if n == "page" else "date"), "key_slug": F.get("speakers", F.lit(0))}))
    pages = src["page"]
    talk_sheet, spoken = src["sheet"].where(F.col("kind") == "talk"), src["table"].where(F.length("speaker_raw") > 0)
    firsts = {"csv": _first(src["csv"], "csv"), "sheet": _first(talk_sheet, "sheet"), "table": _first(spoken, "table")}

    def enriched(d: DataFrame) -> DataFrame:
        for f in firsts.values():
            d = R.null_safe_left(d, f, KEY)
        return d

    # the spine: whole page rows, found by url, else by key
    spine = src["index"].where(F.coalesce("kind", F.lit("talk")) == "talk").withColumns({"stage": F.lit(1), "recovered": F.lit(None).cast("string"), "link": F.when(~X.is_external(F.col("href")), F.col("href"))})
    by_url = R.last_wins(pages, ["url"], "pos").where("url is not null").select(F.col("url").alias("link"), *pages.columns)
    by_key = R.keep_first(pages, KEY, [F.col("pos")]).select(F.struct(*KEY).alias("_k"), *pages.columns)
    spine = R.whole_row_fallback(spine.withColumn("_key", F.struct(*KEY)), by_url, by_key.withColumnRenamed("_k", "_key"), "link", "_key", "page").drop("_key", "link")
    stage1, log = assemble(enriched(spine))
    stage1 = cut(stage1)
    # pages nobody used, in order
    content = lambda t, s: F.concat_ws("|", X.title_norm(t), F.array_join(F.array_sort(s), ","))
    used = spine.where(F.col("page").isNotNull()).select(F.col("page.url").alias("url")).distinct()
    joined = lambda: F.concat_ws("|", F.coalesce(F.col("key_date").cast("string"), F.lit("-")), F.coalesce("key_slug", F.lit("-")))
    loose = pages.join(used, "url", "left_anti").withColumns({"k": joined(), "content": content("title", F.col("speakers"))})
    seen = cut(stage1.select(joined().alias("k"), content("title", F.col("speakers")).alias("content")))
    judged = cut(R.greedy_admission(loose, "k", "content", "pos", seen, seen))
    known = src["index"].agg(F.collect_set("term").alias("known"))  # terms are few
    lone = judged.where("admitted").drop("k", "content", "admitted").crossJoin(F.broadcast(known))
    lone = lone.select(F.lit(2).alias("stage"), "pos", D.known_term(F.col("path_date"), F.col("known")).alias("term"), F.col("path_date").alias("date"), F.lit(None).cast("string").alias("date_note"), "speaker_raw", "title", F.col("url").alias("href"), "speakers", "norm", F.lit("orphan page, linked from nowhere").alias("recovered"), *KEY, F.struct(*pages.columns).alias("page"))
    stage2, more = assemble(enriched(lone))
    stage2 = cut(stage2)
    nothing = F.lit(None).cast("string")
    line = lambda d, f, key, a, x, b, y: d.select(F.lit(f).alias("field"), key.alias("key"), F.lit(a).alias("chosen_source"), x.alias("chosen"), F.lit(b).alias("other_source"), y.alias("other"))
    log += more + [
        line(judged.where(~F.col("admitted")), "duplicate_page", F.col("url"), "content-match", F.col("title"), "page", F.lit("redirect only, not a second talk")),
        line(judged.where("admitted"), "recovered_talk", F.col("url"), "page", F.col("title"), "index", F.lit("(absent)")),
    ]
    # a refused page lends its urls to the first talk that says the same
    both = stage1.unionByName(stage2).withColumn("content", content("title", F.col("speakers")))
    lent = judged.where(~F.col("admitted")).select("content", F.explode(X.both_paddings(F.col("url"))).alias("u")).groupBy("content").agg(F.collect_set("u").alias("lent"))
    owner = R.keep_first(both.select("content", "stage", "pos"), ["content"], [F.col("stage"), F.col("pos")]).join(lent, "content").select("stage", "pos", "lent")
    both = both.join(owner, ["stage", "pos"], "left").withColumn("legacy_urls", F.array_sort(F.array_union("legacy_urls", F.coalesce("lent", F.array().cast(_STRINGS))))).drop("lent", "content")
    # single sources
    empty = F.array().cast(_STRINGS)
    plain = lambda d, stage, name: d.withColumns({"stage": F.lit(stage), "sources": F.array(F.lit(name)), "legacy_urls": empty})
    third = plain(talk_sheet.withColumn("kind", nothing), 3, "sheet").select("stage", "pos", "term", "kind", "date", "speakers", "title", "abstract", "room", "note", "weekday_override", "legacy_urls", "sources", *KEY)
    notes = plain(src["sheet"].where(F.col("kind") != "talk"), 3, "sheet").select("stage", "pos", "term", "kind", "label", "date", empty.alias("speakers"), "room", "note", "weekday_override", "legacy_urls", "sources", *KEY)
    fourth = plain(spoken, 4, "table").select("stage", "pos", "term", nothing.alias("kind"), "date", "speakers", "title", "paper_url", "paper_authors", "room", F.when(F.startswith("source_page", F.lit("index_")), F.col("source_page")).alias("external_url"), "legacy_urls", "sources", *KEY)
    talks = cut(R.staged_union([both, third, fourth], KEY, [F.col("pos")]).unionByName(notes, allowMissingColumns=True))
    late = talks.where("stage = 4")
    log.append(line(late, "recovered_talk", F.concat_ws(" ", F.col("date").cast("string"), F.coalesce("key_slug", F.lit("?"))), "table", F.col("title"), "index", F.lit("(absent)")))
    talks = R.dropped(talks, rules, "speakers").select(*TALK)
    ordered = talks.orderBy(F.coalesce(F.col("date").cast("string"), F.lit("")), F.coalesce("title", F.lit("")), "stage", "pos")
    return Merged(ordered, R.log_lines(reduce(DataFrame.unionByName, log)))
