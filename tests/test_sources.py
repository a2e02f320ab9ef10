import pytest

from plinth.sources import markup as M
from plinth.sources import tables as T

PAGE = """<html><h3>Home</h3><h3><a href="http://x/p.pdf">A Title</a></h3><p class="meta">Wednesday, Nov 18, NSH 3305, 2-3pm<div class="post"><p>Speaker: Jane Doe
</p><p><b>Abstract:</b> We &amp; they <i>do</i> it.</p><img src="http://latex.codecogs.com/gif.latex?%5Clambda"/></div></html>"""


def files(spark, root, **docs):
    import os

    for name, data in docs.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)


def test_pages_index_and_tables(spark, tmp_path):
    root = str(tmp_path)
    files(spark, root, **{"blog/2015/11/18/jane.html": PAGE.encode(), "blog/2015/1/2/old.html": "<h4>Caf\xe9</h4>".encode("cp1252"), "blog/other.html": b"x"})
    docs = M.files(spark, root)
    got = {r.stem: r for r in M.talk_pages(docs).collect()}
    j = got["jane"]
    assert (j.title, j.paper_url, j.speaker_raw, j.room, j.weekday, j.date, j.date_matches_path) == ("A Title", "http://x/p.pdf", "Jane Doe", "NSH 3305", "Wednesday", None, False)
    assert j.latex == ["\\lambda"] and j.abstract.startswith("We & they") and j.abstract_from_marker
    assert got["old"].title == "Café" and got["old"].encoding == "cp1252" and got["old"].path_date == "2015-01-02"
    assert [r.path for r in M.skipped_pages(docs).collect()] == ["blog/other.html"]


def docs_of(spark, **files):
    return spark.createDataFrame([(n, v if isinstance(v, bytes) else v.encode()) for n, v in files.items()], "path string, content binary")


def test_yearless_days_take_the_year_of_the_path(spark):
    page = '<h3>T</h3><p class="meta">Nov 18, NSH 3305</p><div class="post"><p>Just words.</p></div>'
    r = M.talk_pages(docs_of(spark, **{"blog/2015/11/18/a.html": page, "blog/2015/11/19/b.html": page, "blog/2015/1/1/c.html": b"", "blog/2015/1/1/d.html": b"\x81"})).orderBy("file").collect()
    assert [(x.stem, str(x.date), x.date_matches_path, x.abstract, x.abstract_from_marker) for x in r if x.title] == [("a", "2015-11-18", True, "Just words.", False), ("b", "2015-11-18", False, "Just words.", False)]
    assert [x.stem for x in r] == ["c", "a", "b"]


def test_index(spark):
    html = '<ul><li class="bloglink"><a>early</a></li><h3>Spring 2017</h3><li class="bloglink"><span class="date">22 Feb and 01 Mar 2017</span><a href="http://e/x">T</a><span class="date">Jane Doe</span></li><li>no</li><h3> </h3><li class="bloglink"><a href="/p">once</a></li></ul>'
    idx = M.blog_index(docs_of(spark, **{"i.html": html})).orderBy("order").collect()
    assert [(e.order, e.term_name, e.kind, str(e.date), e.date_note, e.speaker_raw, e.href, e.external) for e in idx] == [(1, "Spring 2017", "talk", "2017-02-22", "continued Mar 1", "Jane Doe", "http://e/x", True), (2, "Spring 2017", "placeholder", "None", None, None, "/p", False)]


def test_tables(spark):
    html = '<table><tr><td>Sept 1</td><td>Big Paper (<a href="u.pdf">pdf</a>)<br>Authors: A. B. Presenter: Jane Doe; x Commenter: X Y</td></tr><tr><td>one</td></tr><tr><td>Schedule</td><td>x</td></tr><tr><td>Sept 2<td>No end</table>'
    tab = M.schedule_tables(docs_of(spark, **{"d/index_Fall13.html": html, "d/other.html": html})).orderBy("date").collect()
    assert [(t.term, str(t.date), t.title, t.speaker_raw, t.paper_url, t.paper_authors, t.commenter, t.source_page) for t in tab][:1] == [("fall2013", "2013-09-01", "Big Paper", "Jane Doe", "u.pdf", "A. B.", "X Y", "index_Fall13.html")]
    d = M.page_defaults(docs_of(spark, **{"x": "<b>Room:</b> 6121 Center (x) <b>Time:</b> 2-3 pm Wednesday SCHEDULE", "y": "in GHC 8102"})).orderBy("path").collect()
    assert [tuple(r)[1:] for r in d] == [("6121 Center", "2-3 pm Wednesday"), ("GHC 8102", None)]


def test_events_write_the_markup_again():
    e = M.Events("<div><p>a &amp; <b>b<br></b></p><p>c<p>d</div>e<script>x</script>")
    assert e.source(e.all("div")[0]) == "<p>a &amp; <b>b<br/></b></p><p>c<p>d</p></p>" and e.text() == "a & bcde"


def test_csv_and_sheet(spark, tmp_path):
    root = str(tmp_path)
    files(spark, root, **{"a.csv": 'Date ,Time,Room,Speaker,Title,Abstract\n10/25/2022,2pm,R,Zo\xeb X,"T","line\none"\n,,,,,\n'.encode("cp1252"), "s.csv": b'"Schedule (Fall 2025)\n\nTime & location: NSH 3305 2-3:30pm Wednesdays",,,\nDate,Speaker,Title,Abstract\n9/5 (Thursday) - NSH 4305,Jane Doe (Rutgers),NA,N/A\n9/12,No meeting (Fall break),,\n9/19,TBD,,\n9/26,A B,TBD,Text\nnever,X,,\n'})
    rows = T.schedule_csv(M.files(spark, root, "a.csv")).collect()
    assert [(r.encoding, r.date_raw, str(r.date), r.speaker_raw, r.abstract, r.row) for r in rows] == [("cp1252", "10/25/2022", "2022-10-25", "Zoë X", "line one", 2)]
    docs = M.files(spark, root, "s.csv")
    e = T.stacked_sheet(docs)
    got = [(r.kind, r.label, str(r.date), r.room, r.speaker_raw, r.affiliation, r.title, r.abstract) for r in e.orderBy("row").collect()]
    assert got == [("talk", None, "2025-09-05", "NSH 4305", "Jane Doe", "Rutgers", None, None), ("no_meeting", "Fall Break", "2025-09-12", None, None, None, None, None), ("tbd", None, "2025-09-19", None, None, None, None, None), ("talk", None, "2025-09-26", None, "A B", None, None, "Text")]
    assert T.weekday_warnings(e).count() == 1
    assert [(b.term, b.name, b.default_room, b.default_time, b.default_weekday) for b in T.sheet_blocks(docs).collect()] == [("fall2025", "Fall 2025", "NSH 3305", "2-3:30pm", "Wednesday")]


def test_detailed_sheet(spark, tmp_path):
    files(spark, str(tmp_path), **{"f.csv": b'date0,Name,topic,webpage,details\n9/5/2014,Jane Doe,A Topic,http://j,"<a href=""http://x/~me"">me</a><a href=""http://y/p.pdf"">p</a><strong>Location</strong>: GHC 8102 <b>Reading material: A and B, </b>"\n9/12/2014,,No meeting,,\nno date,X Y,,,\n'})
    got = T.detailed_sheet(M.files(spark, str(tmp_path), "f.csv"), "fall2014").orderBy("row").collect()
    assert [(r.kind, r.speaker_raw, r.title, r.paper_url, r.room, r.paper_authors) for r in got] == [("talk", "Jane Doe", "A Topic", "http://y/p.pdf", "GHC 8102", "A and B"), ("no_meeting", None, "No meeting", None, None, None)]


def test_roster(spark):
    csv = "FirstName,LastName,Position,Affiliation1,Affiliation2,Type,Webpage,ImgPath\nTomas,Rebecca,Professor,Professor,X,Faculty,http://a/b,p/me.png\nMira,Koz&eacute;l,Deceased,,,student,www.x,none\n,,,,,,,\n"
    swapped = spark.createDataFrame([("Tomas", "Rebecca")], "firstname string, lastname string")
    r = T.roster(T.people_csv(docs_of(spark, **{"people.csv": csv})), swapped, {"Mira Koz": "Mira Kozelová"}).orderBy("person_id").collect()
    assert [(x.name, x.roster, x.position, x.affiliation, x.affiliation2, x.url, x.img, x.memorial) for x in r] == [
        ("Rebecca Tomas", "faculty", "Professor", None, "X", "https://a/b", "/assets/people/me.jpg", False), ("Mira Kozelová", "student", None, None, None, "https://www.x", None, True)]


def test_yaml_is_strict(spark):
    df = T.from_yaml(spark, "merge:\n  a_b: [x_y, z]\n  c: []\n", "alias string, canon string", T.alias_rows)
    assert sorted(map(tuple, df.collect())) == [("x_y", "a_b"), ("z", "a_b")]
    with pytest.raises(ValueError, match="duplicate"):
        T.from_yaml(spark, "a: {}\na: {}\n", "s string, f string, v string, d boolean", T.patch_rows)
    assert T.css_tokens(":root{--text: #111111; --x: 2px}") == [(":root", "text", "#111111")]


def test_sinks(spark, tmp_path):
    import os

    out = str(tmp_path / "stubs")
    df = spark.createDataFrame([("/blog/2025/4/25/x.html", "/archive.html#t-2025-04-25-a", "A & B")], "url string, target string, label string")
    os.makedirs(os.path.join(out, "old"))
    open(os.path.join(out, "old/stale.html"), "w").close()
    T.write_stubs(df, out)
    assert not os.path.exists(os.path.join(out, "old"))
    assert "A &amp; B" in open(os.path.join(out, "blog/2025/4/25/x.html"), encoding="utf-8").read()
    t = spark.createDataFrame([("fall2020", "2020-09-01", "x"), ("spring2020", "2020-02-01", "y")], "term string, date string, title string")
    T.write_terms(t, str(tmp_path / "terms"))
    assert spark.read.parquet(str(tmp_path / "terms")).where("term = 'fall2020'").count() == 1
    T.write_yaml(t, str(tmp_path / "t.yaml"))
    assert "title: x" in open(tmp_path / "t.yaml", encoding="utf-8").read()
    T.write_yaml(spark.createDataFrame([("a", ("word " * 40).strip(), ["u", "v"])], "k string, long string, l array<string>"), str(tmp_path / "u.yaml"), "# made\n")
    made = open(tmp_path / "u.yaml", encoding="utf-8").read()
    assert made.startswith("# made\n- k: a\n  long: >") and "- u" in made
    T.write_json(t, str(tmp_path / "j"))
    assert T.from_json(spark, str(tmp_path / "j"), "term string, title string").count() == 2
    log = spark.createDataFrame([("f", "k", "a", "x" * 500, "b", "y\tz")], "field string, key string, chosen_source string, chosen string, other_source string, other string")
    T.write_conflicts(log, str(tmp_path / "c"))
    line = spark.read.csv(str(tmp_path / "c"), sep="\t", header=True).first()
    assert len(line.chosen) == 400 and line.other == "y z"
