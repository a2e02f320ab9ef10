"""The staged merge on a small archive with one case of every rule."""

import datetime as dt

import pytest

from plinth.plans.merge import merge

D = dt.date


@pytest.fixture(scope="module")
def merged(spark):
    index = spark.createDataFrame([
        (1, "spring2020", "talk", D(2020, 2, 1), None, "Jane Doe", "Komlos Major", "/blog/2020/2/1/a.html"), (2, "spring2020", "placeholder", None, None, None, "later", None),
        (3, "spring2020", "talk", D(2020, 2, 8), "continued Feb 9", "Prof. John Roe", "B", "http://ext/x"), (4, "spring2020", "talk", D(2020, 5, 1), None, "Dee Rop", "Gone", None),
    ], "pos long, term string, kind string, date date, date_note string, speaker_raw string, title string, href string")
    pages = spark.createDataFrame([
        (1, D(2020, 2, 1), "/blog/2020/2/1/a.html", "Jane Doe and John Roe", "Komlós Major", 'x <img src="http://latex.codecogs.com/gif.latex?n"/>', "3pm", "R1", "Monday", "u.pdf", ["n"]),
        (2, D(2020, 2, 15), "/blog/2020/2/15/b.html", "Ann Bee", "Orphan", None, None, None, None, None, None), (3, D(2020, 3, 1), "/blog/2020/3/1/c.html", "Ann Bee", "ORPHAN", None, None, None, None, None, None),
    ], "pos long, path_date date, url string, speaker_raw string, title string, abstract string, time string, room string, weekday string, paper_url string, latex array<string>")
    csv = spark.createDataFrame([(1, D(2020, 2, 8), "John Roe", "B", None, "2pm", "R9"), (2, D(2020, 2, 8), "J Roe", "late", None, "9pm", None)], "pos long, date date, speaker_raw string, title string, abstract string, time string, room string")
    sheet = spark.createDataFrame([
        (1, "spring2020", "talk", None, D(2020, 2, 8), "John Roe", "B2", "R8\t", "Friday"), (2, "spring2020", "no_meeting", "Spring Break", D(2020, 3, 10), None, None, None, None), (3, "fall2020", "talk", None, D(2020, 9, 1), "Cy Dee", "Sheet only", None, None),
    ], "pos long, term string, kind string, label string, date date, speaker_raw string, title string, room string, weekday_override string")
    tables = spark.createDataFrame([(1, "fall2010", D(2010, 9, 1), "Old Man", "Old", "p.pdf", "A. B.", "R", "index_Fall10.html"), (2, "fall2010", D(2010, 9, 8), None, "Nobody", None, None, None, "index_Fall10.html"), (3, "spring2020", D(2020, 2, 1), "Jane Doe", "K", "q.pdf", "C. D.", None, "f.csv")], "pos long, term string, date date, speaker_raw string, title string, paper_url string, paper_authors string, room string, source_page string")
    aliases = spark.createDataFrame([("john_roe", "j_roe")], "alias string, canon string")
    rules = spark.createDataFrame([("spring2020", D(2020, 5, 1), "dee_rop")], "term string, date date, speaker string")
    m = merge(index, pages, csv, sheet, tables, aliases, rules)
    return {(r.stage, r.pos): r for r in m.talks.collect()}, {tuple(r) for r in m.conflicts.collect()}, [(str(r.date), r.title) for r in m.talks.collect()]


def test_every_record_comes_once(merged):
    talks, _, order = merged
    assert sorted(talks) == [(1, 1), (1, 3), (2, 2), (3, 2), (3, 3), (4, 1)]  # the placeholder, the dropped talk and the speakerless record are out
    assert order == sorted(order, key=lambda x: (x[0], x[1] or ""))


def test_precedence(merged):
    talks, log, _ = merged
    t = talks[1, 1]
    assert (t.speakers, t.title, t.abstract, t.time, t.room, t.weekday_override, t.paper_url, t.paper_authors) == (["jane_doe", "j_roe"], "Komlós Major", "x <em>n</em>", "3pm", "R1", "Monday", "u.pdf", "C. D.")
    assert t.legacy_urls == ["/blog/2020/02/01/a.html", "/blog/2020/2/1/a.html"] and t.sources == ["blog_index", "blog_page", "table"]
    u = talks[1, 3]
    assert (u.speakers, u.title, u.time, u.room, u.weekday_override, u.external_url, u.legacy_urls, u.date_note) == (["j_roe"], "B", "2pm", "R9", "Friday", "http://ext/x", [], "continued Feb 9")
    assert ("speaker", "2020-02-01 Jane Doe", "page", "jane_doe,j_roe", "index", "jane_doe") in log
    assert ("title", "2020-02-08 Prof. John Roe", "index", "B", "sheet", "B2") in log and ("room", "2020-02-08 Prof. John Roe", "csv", "R9", "sheet", "R8 ") in log
    assert not any(line[0] == "title" and line[1].startswith("2020-02-01") for line in log)
    assert ("paper_url", "2020-02-01 Jane Doe", "page", "u.pdf", "table", "q.pdf") in log


def test_stages(merged):
    talks, log, _ = merged
    o = talks[2, 2]
    assert o.recovered and o.term == "spring2020" and o.legacy_urls == ["/blog/2020/02/15/b.html", "/blog/2020/03/01/c.html", "/blog/2020/2/15/b.html", "/blog/2020/3/1/c.html"]
    assert ("duplicate_page", "/blog/2020/3/1/c.html", "content-match", "ORPHAN", "page", "redirect only, not a second talk") in log and ("recovered_talk", "/blog/2020/2/15/b.html", "page", "Orphan", "index", "(absent)") in log
    assert (talks[3, 2].kind, talks[3, 2].label, talks[3, 3].title, talks[3, 3].sources) == ("no_meeting", "Spring Break", "Sheet only", ["sheet"])
    assert (talks[4, 1].paper_authors, talks[4, 1].external_url) == ("A. B.", "index_Fall10.html") and ("recovered_talk", "2010-09-01 old_man", "table", "Old", "index", "(absent)") in log
