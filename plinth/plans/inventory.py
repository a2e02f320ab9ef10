"""Registered queries of sources, sinks and the smaller operators. Documents are written from the tables by column
expressions, a bounded number of rows each, and read back by the sources; the SQL states what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import dates as D
from plinth.functions import text as X
from plinth.operators import reconcile as R
from plinth.operators import views as V
from plinth.plans.catalogue import query
from plinth.session import table
from plinth.sources import markup as M
from plinth.sources import tables as T

#: Rows of a document.
CHUNK = 100
_CLEAN = "trim(regexp_replace(replace({0}, chr(65279), ''), '[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+', ' ', 'g'))"


def clean_sql(c: str) -> str:
    return f"nullif({_CLEAN.format(c)}, '')"


def _html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(c, F.lit(""))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def _documents(rows: DataFrame, keys: list[str], line: Column, path: Column, before: Column, after: str = "") -> DataFrame:
    """One document for CHUNK rows of equal keys, in order of row_no and row_id."""
    g = rows.withColumn("chunk", F.floor(F.col("row_no") / CHUNK)).groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("row_no", "row_id", line.alias("x")))).alias("_l"))
    return g.select(path.alias("path"), F.encode(F.concat(before, F.array_join(F.transform("_l", lambda v: v["x"]), "\n"), F.lit(after)), "UTF-8").alias("content"))


@query(f"""select '/blog/' || year(path_date::date) || '/' || month(path_date::date) || '/' || day(path_date::date) || '/p' || page_id || '.html' as url, 'p' || page_id as stem, path_date, 'utf-8' as encoding, {clean_sql('title')} as title,
{clean_sql('speaker_raw')} as speaker_raw, case when not (month(path_date::date) = 2 and day(path_date::date) = 29) then path_date::date end as date, not (month(path_date::date) = 2 and day(path_date::date) = 29) as date_matches_path, 'GHC 8102' as room, '2-3pm' as time, case when weekday in ('Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday') then weekday end as weekday, nullif(case when {clean_sql('title')} is not null then paper_url end, '') as paper_url from blog_pages""")
def source_pages(s, d):
    """S1 S3 S4 S20 X11 X12 X15 X21 X35 X36 T-1 T-6: talk pages."""
    p = F.col("path_date").cast("date")
    path = F.format_string("blog/%d/%d/%d/p%d.html", F.year(p), F.month(p), F.dayofmonth(p), F.col("page_id"))
    said = F.regexp_replace(F.coalesce("speaker_raw", F.lit("")), r"[\r\n\u0085  ]+", " ")
    html = F.concat(F.lit('<html><h3>Home</h3><h3><a href="'), _html(F.col("paper_url")), F.lit('">'), _html(F.col("title")), F.lit('</a></h3><p class="meta">'), F.date_format(p, "MMM d"), F.lit(", GHC 8102, 2-3pm "), F.coalesce("weekday", F.lit("")),
                    F.lit('<div class="post">'), F.when(X.spaced(said) != "", F.concat(F.lit("<p>Speaker: "), _html(said), F.lit("\n</p>"))).otherwise(""), F.lit("<p><b>Abstract:</b> Words.</p></div></html>"))
    docs = table(s, d, "blog_pages").select(path.alias("path"), F.encode(html, "UTF-8").alias("content"))
    return M.talk_pages(docs).select("url", "stem", "path_date", "encoding", "title", "speaker_raw", "date", "date_matches_path", "room", "time", "weekday", "paper_url")


_CHUNKED = "select *, (row_no // 100)::bigint as chunk, row_number() over (partition by source_file, term, row_no // 100 order by row_no, row_id) as rn from talks"


@query(f"""with t as ({_CHUNKED}) select source_file || '|' || coalesce(term, '') || '|' || chunk as file, rn::int as "order", coalesce(term, 'none') as term_name, strftime(date, '%-d %b %Y') as date_raw, date, {clean_sql('speaker_raw')} as speaker_raw, coalesce({clean_sql('title')}, '') as title,
'/p/' || row_id as href, false as external, case when date is not null or {clean_sql('speaker_raw')} is not null then 'talk' else 'placeholder' end as kind from t""")
def source_index(s, d):
    """S2 X33 D6 D7 F7 F9 F24 T-3: an index of the talks, headings carried to the items below them."""
    t = table(s, d, "talks")
    line = F.concat(F.lit('<li class="bloglink"><span class="date">'), F.coalesce(F.date_format("date", "d MMM yyyy"), F.lit("")), F.lit('</span><a href="/p/'), F.col("row_id"), F.lit('">'), _html(F.col("title")), F.lit('</a><span class="date">'), _html(F.col("speaker_raw")), F.lit("</span></li>"))
    docs = _documents(t, ["source_file", "term"], line, F.concat("source_file", F.lit("|"), F.coalesce("term", F.lit("")), F.lit("|"), "chunk"), F.concat(F.lit("<ul><li class='bloglink'>early</li><h3>"), F.coalesce("term", F.lit("none")), F.lit("</h3>")), "</ul>")
    return M.blog_index(docs).select("file", "order", "term_name", "date_raw", "date", "speaker_raw", "title", "href", "external", "kind")


@query(f"""with t as ({_CHUNKED}) select source_file || '|' || coalesce(term, '') || '|' || chunk as source_file, 'utf-8' as encoding, (rn + 1)::int as row, {clean_sql('date_raw')} as date_raw, {clean_sql('time')} as time, {clean_sql('room')} as room,
{clean_sql('speaker_raw')} as speaker_raw, {clean_sql('title')} as title from t where {clean_sql('date_raw')} is not null""")
def source_csv(s, d):
    """Schedule files with padded header names and cells of several lines."""
    t = table(s, d, "talks")
    line = F.concat_ws(",", *[_quoted(F.col(c)) for c in ("date_raw", "time", "room", "speaker_raw", "title", "abstract")])
    docs = _documents(t, ["source_file", "term"], line, F.concat("source_file", F.lit("|"), F.coalesce("term", F.lit("")), F.lit("|"), "chunk"), F.lit("Date ,Time,Room,Speaker, Title,Abstract\n"), "\n")
    return T.schedule_csv(docs).select("source_file", "encoding", "row", "date_raw", "time", "room", "speaker_raw", "title")


@query(f"""with t as (select *, (row_no // 100)::bigint as chunk, row_number() over (partition by source_file, term, row_no // 100 order by row_no, row_id) as rn from talks where date is not null and regexp_matches(term, '^(fall|spring|summer)')),
u as (select *, upper(term[1]) || regexp_replace(term[2:], '(\\d{{4}})', ' \\1') as term_name, {clean_sql('title')} as ct from t)
select source_file || '|' || term || '|' || chunk as source, (rn + 1)::int as row, term, term_name, case row_id % 4 when 0 then 'no_meeting' when 1 then 'tbd' else 'talk' end as kind, case row_id % 4 when 0 then 'Fall Break' end as label,
make_date(regexp_extract(term, '(\\d{{4}})')::int, case when month(date) = 2 and day(date) = 29 then null else month(date)::int end, day(date)::int) as date, case row_id % 4 when 3 then 'Wednesday' end as weekday_override, case row_id % 4 when 3 then 'NSH 3305' end as room,
case row_id % 4 when 2 then 'Jane Doe' when 3 then 'Ann Bee (Wednesday)' end as speaker_raw, case row_id % 4 when 2 then 'Rutgers' end as affiliation, case when upper(ct) not in ('NA','N/A','TBD','TBA') then ct end as title
from u where not (month(date) = 2 and day(date) = 29)""")
def source_sheet(s, d):
    """S6 S7 S20 F10-F13 X5 X20 T-4 J12: stacked sheets."""
    t = table(s, d, "talks").where(F.col("date").isNotNull() & F.col("term").rlike("^(fall|spring|summer)"))
    i = F.col("row_id") % 4
    who = F.when(i == 0, "No meeting (Fall break)").when(i == 1, "TBD").when(i == 2, "Jane Doe (Rutgers)").otherwise("Ann Bee (Wednesday) (NSH 3305)")
    line = F.concat_ws(",", F.date_format("date", "M/d"), _quoted(who), _quoted(F.col("title")), _quoted(F.lit("N/A")))
    name = F.concat(F.initcap(F.regexp_extract("term", "^([a-z]+)", 1)), F.lit(" "), F.regexp_extract("term", r"(\d{4})", 1))
    docs = _documents(t, ["source_file", "term"], line, F.concat_ws("|", "source_file", "term", F.col("chunk").cast("string")), F.concat(F.lit('"Schedule ('), name, F.lit(')\nTime & location: NSH 3305 2-3:30pm Wednesdays",,,\nDate,Speaker,Title,Abstract\n')), "\n")
    return T.stacked_sheet(docs).select("source", "row", "term", "term_name", "kind", "label", "date", "weekday_override", "room", "speaker_raw", "affiliation", "title")


_SCAN = """with t as (select * from talks where date is not null and regexp_matches(term, '^(fall|spring|summer)20') and not (month(date) = 2 and day(date) = 29))
select term, make_date(regexp_extract(term, '(\\d{4})')::int, month(date)::int, day(date)::int) as date, 'Paper ' || row_id as title, 'Jane Doe' as speaker_raw, paper_url, 'A. Bee' as paper_authors, 'index' as part from t
union all select 'fall2014', date, 'Topic ' || row_id, 'Ann Bee', 'http://y/' || row_id || '.pdf', 'Old notes', 'sheet' from t"""


@query(_SCAN)
def source_tables_union(s, d):
    """Schedule tables of terms, and a sheet with cells of markup, as one."""
    t = table(s, d, "talks").where(F.col("date").isNotNull() & F.col("term").rlike("^(fall|spring|summer)20") & ~((F.month("date") == 2) & (F.dayofmonth("date") == 29)))
    n = F.col("row_id").cast("string")
    paper = F.when(F.col("paper_url").isNotNull(), F.concat(F.lit(' (<a href="'), _html(F.col("paper_url")), F.lit('">pdf</a>)'))).otherwise("")
    row = F.concat(F.lit("<tr><td>"), F.date_format("date", "M/d"), F.lit("</td><td>Paper "), n, paper, F.lit("<br>Authors: A. Bee Presenter: Jane Doe; x Commenter: C D</td></tr>"))
    name = F.concat(F.lit("/index_"), F.initcap(F.regexp_extract("term", "^([a-z]+)", 1)), F.substring("term", -2, 2), F.lit(".html"))
    a = M.schedule_tables(_documents(t, ["source_file", "term"], row, F.concat(F.col("source_file"), F.lit("/"), F.col("chunk").cast("string"), name), F.lit("<table><tr><td>one</td></tr>"), "</table>"))
    details = F.concat(F.lit('<a href="http://x/~me">me</a><a href="http://y/'), n, F.lit('.pdf">p</a><strong>Location</strong>: GHC 8102 <b>Reading material: Old notes, </b>'))
    line = F.concat_ws(",", F.date_format("date", "M/d/yyyy"), F.lit("Ann Bee"), F.concat(F.lit("Topic "), n), _quoted(details))
    b = T.detailed_sheet(_documents(t, ["source_file", "term"], line, F.concat_ws("|", "source_file", "term", F.col("chunk").cast("string")), F.lit("date0,Name,topic,details\n"), "\n"), "fall2014")
    both = a.withColumn("part", F.lit("index")).unionByName(b.withColumn("part", F.lit("sheet")), allowMissingColumns=True)
    return both.select("term", "date", "title", "speaker_raw", "paper_url", "paper_authors", "part")


@query(f"""select person_id, {clean_sql("concat_ws(' ', nullif(firstname,''), nullif(lastname,''))")} as name, case when lower(trim(type)) in ('faculty','postdoc','student','alumni') then lower(trim(type)) end as roster from people where {clean_sql("concat_ws(' ', nullif(firstname,''), nullif(lastname,''))")} is not null""")
def source_roster(s, d):
    """The roster read from files with a header."""
    p = table(s, d, "people")
    content = F.concat(F.lit("FirstName,LastName,Type\n"), F.concat_ws(",", _quoted(F.col("firstname")), _quoted(F.col("lastname")), _quoted(F.col("type"))), F.lit("\n"))
    rows = T.csv_records(p.select(F.col("person_id").cast("string").alias("path"), F.encode(content, "UTF-8").alias("content")))
    cells = {"firstname": "FirstName", "lastname": "LastName", "type": "Type"}
    people = rows.select(F.col("path").cast("long").alias("person_id"), *[X.blank_to_null(X.clean_text(F.try_element_at("rec", F.lit(h)))).alias(c) for c, h in cells.items()], *[F.lit(None).cast("string").alias(c) for c in ("position", "affiliation1", "affiliation2", "webpage", "imgpath")])
    return T.roster(people).select("person_id", "name", "roster")


@query("select row_id, title, room, date from talks")
def json_round_trip(s, d):
    """Documents as JSON and back under a stated schema."""
    j = table(s, d, "talks").select(F.to_json(F.struct("row_id", "title", "room", "date")).alias("j"))
    return j.select(F.from_json("j", "row_id long, title string, room string, date date").alias("x")).select("x.*")


@query("""with b as (select page_id, title, date, '/blog/' || year(path_date::date) || '/' || month(path_date::date) || '/' || day(path_date::date) || '/' || page_id || '.html' as short, '/blog/' || strftime(path_date::date, '%Y/%m/%d') || '/' || page_id || '.html' as padded from blog_pages),
u as (select distinct url, '/archive.html#t-' || coalesce(date::varchar || '-', '') || page_id as target, 'page ' || page_id as label from (select *, short as url from b union all select *, padded from b))
select url[2:] as path, md5('<!doctype html><meta charset="utf-8"><title>' || label || '</title><link rel="canonical" href="' || target || '"><meta http-equiv="refresh" content="0; url=' || target || '"><a href="' || target || '">' || label || '</a>' || chr(10)) as content from u""")
def redirect_stubs(s, d):
    """The pages a redirect sink writes."""
    p = F.col("path_date").cast("date")
    url = F.concat(F.lit("/blog/"), F.year(p), F.lit("/"), F.month(p), F.lit("/"), F.dayofmonth(p), F.lit("/"), F.col("page_id"), F.lit(".html"))
    b = table(s, d, "blog_pages").select(url.alias("u"), "date", F.col("page_id").cast("string").alias("slug"), F.concat(F.lit("page "), F.col("page_id")).alias("l"))
    return T.stubs(V.redirects(b, "u", "date", "slug", F.col("l"))).select("path", F.md5("content").alias("content"))


@query("""with b as (select page_id, (case when month(path_date::date)<=6 then 'spring' when month(path_date::date)=7 then 'summer' else 'fall' end || year(path_date::date)::varchar) as k, case when month(path_date::date) < 10 or day(path_date::date) < 10 then 2 else 1 end as urls from blog_pages)
select k as term, coalesce(term_name, k) as term_name, count(*) as pages, sum(urls)::bigint as urls from b left join terms on term = k group by 1, 2""")
def redirect_counts(s, d):
    """Redirects by term, under the term's name or else its key."""
    p = F.col("path_date").cast("date")
    url = F.concat(F.lit("/blog/"), F.year(p), F.lit("/"), F.month(p), F.lit("/"), F.dayofmonth(p), F.lit("/"), F.col("page_id"), F.lit(".html"))
    b = table(s, d, "blog_pages").select(D.infer_term(p).alias("k"), F.size(X.both_paddings(url)).alias("urls"))
    j = b.join(table(s, d, "terms").select("term", "term_name"), F.col("k") == F.col("term"), "left")
    return j.groupBy(F.col("k").alias("term"), F.coalesce("term_name", "k").alias("term_name")).agg(F.count("*").alias("pages"), F.sum("urls").alias("urls"))


@query("""select * from (select 'talks' as what, count(*) as n, 340 as least, count(*) >= 340 as ok from talks where kind is null union all select 'people', count(*), 90, count(*) >= 90 from people union all select 'stubs', count(*), 400, count(*) >= 400 from blog_pages)""")
def count_gates(s, d):
    """Counts that must be reached before anything is published."""
    t = {"talks": (table(s, d, "talks").where("kind is null"), 340), "people": (table(s, d, "people"), 90), "stubs": (table(s, d, "blog_pages"), 400)}
    out = None
    for k, (df, least) in t.items():
        g = V.gate(df, k, least)
        out = g if out is None else out.unionByName(g)
    return out


@query("select term, count(*) as shown, sum(count(*)) over ()::bigint as total from talks where kind is null and title is not null group by 1")
def archive_counts(s, d):
    """A1 A2 F2: listed talks of each term, and of all."""
    g = V.archive(table(s, d, "talks")).groupBy("term").agg(F.count("*").alias("shown"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("shown").alias("total"))))


@query("""with k as (select max_by(term, regexp_extract(term, '(\\d{4})')::int * 10 + case regexp_extract(term, '^([a-z]+)', 1) when 'spring' then 1 when 'summer' then 2 when 'fall' then 3 else 0 end) as cur from talks where term is not null)
select row_id, coalesce(kind, 'talk') as kind, date, title from talks, k where term = cur""")
def current_term(s, d):
    """Every row of the newest term that has any, in order of day."""
    t = table(s, d, "talks")
    now = t.where(F.col("term").isNotNull()).agg(F.max_by("term", D.term_rank(F.col("term"))).alias("term"))
    return t.join(F.broadcast(now), "term").select("row_id", F.coalesce("kind", F.lit("talk")).alias("kind"), "date", "title").orderBy("date", "row_id")


@query("select row_id, coalesce(kind in ('no_meeting', 'cancelled'), false) as is_break, kind is null as is_talk from talks")
def break_flags(s, d):
    """rows without a meeting; an open date is none."""
    return table(s, d, "talks").select("row_id", V.is_break(F.col("kind")).alias("is_break"), F.col("kind").isNull().alias("is_talk"))


@query("""select person_id, list_contains(['faculty', 'alumni'], lower(trim(type))) as pictured, coalesce(lower(trim(position)) = 'deceased', false) as memorial, coalesce(nullif(trim(affiliation1), ''), 'unknown') as affiliation from people where type is not null""")
def membership_tests(s, d):
    """Members of photo groups, a flag, a default for empty values."""
    p = table(s, d, "people").where(F.col("type").isNotNull())
    groups = F.array(F.lit("faculty"), F.lit("alumni"))
    return p.select("person_id", F.array_contains(groups, F.lower(F.trim("type"))).alias("pictured"), F.coalesce(F.lower(F.trim("position")) == "deceased", F.lit(False)).alias("memorial"), F.coalesce(X.blank_to_null(F.trim("affiliation1")), F.lit("unknown")).alias("affiliation"))


@query("""with x(ext, ord) as (values ('.jpg',1),('.jpeg',2),('.png',3),('.gif',4),('.webp',5),('.JPG',6),('.PNG',7)), p as (select person_id, regexp_replace(split_part(imgpath, '/', -1), '\\.[^.]*$', '') as stem from people where imgpath is not null and imgpath <> '' and lower(imgpath) <> 'none' and type in ('faculty', 'alumni', 'student'))
select person_id, min_by(stem || ext, ord) as file from p, x where (person_id + ord) % 3 = 0 group by 1""")
def image_candidates(s, d):
    """The first existing file of several extensions, for people with a picture in chosen groups."""
    order = s.createDataFrame(list(enumerate([".jpg", ".jpeg", ".png", ".gif", ".webp", ".JPG", ".PNG"], 1)), "ord int, ext string")
    p = table(s, d, "people").where((F.length("imgpath") > 0) & (F.lower("imgpath") != "none") & F.col("type").isin("faculty", "alumni", "student")).select("person_id", X.file_stem(F.col("imgpath")).alias("stem"))
    ords = F.sequence(F.lit(1), F.lit(7))
    files = p.select("person_id", "stem", F.explode(ords).alias("ord")).where((F.col("person_id") + F.col("ord")) % 3 == 0)
    return files.join(F.broadcast(order), "ord").groupBy("person_id").agg(F.min_by(F.concat("stem", "ext"), "ord").alias("file"))


@query("select source_file, row_number() over (order by source_file) as pos from (select distinct source_file from talks)")
def files_in_order(s, d):
    """Files by name; the last is the latest snapshot."""
    f = table(s, d, "talks").select("source_file").distinct().orderBy("source_file")
    ids = f.select("source_file", F.monotonically_increasing_id().alias("i"), F.spark_partition_id().alias("p"))
    sizes = ids.groupBy("p").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.p") < F.col("a.p"), "left").groupBy("a.p", "a.first").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("skip"))
    return ids.join(F.broadcast(before), "p").select("source_file", (F.col("i") - F.col("first") + F.col("skip") + 1).alias("pos"))


@query("select row_id, array_to_string(list_filter([case when title is not null then 'title' end, case when room is not null then 'room' end, case when time is not null then 'time' end], lambda x: x is not null), ',') as given from talks")
def given_fields(s, d):
    """A mapping filtered by its values, keys in their order."""
    m = F.map_filter(F.create_map(*[x for c in ("title", "room", "time") for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    return table(s, d, "talks").select("row_id", F.array_join(F.map_keys(m), ",").alias("given"))


@query("select o_custkey as member, c_name as name, c_mktsegment as grp from (select distinct o_custkey from orders) join customer on o_custkey = c_custkey")
def roster_to_people(s, d):
    """Members of a roster with their record; members nobody knows are left out."""
    r = table(s, d, "orders").select(F.col("o_custkey").alias("member")).distinct()
    return V.roster_people(r, table(s, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("grp")), "member", "c_custkey")


@query("select n_name as organizer, coalesce(s_name, n_name) as shown from nation left join (select s_nationkey, min(s_name) as s_name from supplier group by 1) on s_nationkey = n_nationkey")
def organizers(s, d):
    """Organizers with their record, or their own key where there is none."""
    p = table(s, d, "supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("s_name"))
    return table(s, d, "nation").join(p, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_name").alias("organizer"), F.coalesce("s_name", "n_name").alias("shown"))


@query("select row_id, strftime(date, '%-d %b') as short, strftime(date, '%-d %b %Y') as dated, strftime(date, '%-d %B') as long from talks where date is not null")
def date_forms(s, d):
    """F22 T-7: three forms of a day."""
    t = table(s, d, "talks").where(F.col("date").isNotNull())
    return t.select("row_id", F.date_format("date", "d MMM").alias("short"), F.date_format("date", "d MMM yyyy").alias("dated"), F.date_format("date", "d MMMM").alias("long"))


@query("select 'idle' as side, p_partkey as k from part where p_partkey not in (select s_suppkey from supplier) union all select 'unknown', k from (select s_suppkey + (select count(*) from part) - 50 as k from supplier) where k not in (select p_partkey from part)")
def set_differences(s, d):
    """What only one side has, both ways."""
    a, b = table(s, d, "part").select(F.col("p_partkey").alias("k")), table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    n = table(s, d, "part").agg(F.count("*").alias("n"))
    c = b.crossJoin(F.broadcast(n)).select((F.col("k") + F.col("n") - 50).alias("k"))
    return a.subtract(b).select(F.lit("idle").alias("side"), "k").union(c.subtract(a).select(F.lit("unknown").alias("side"), "k"))


@query("select doc_id, left(text, 400) as a, left(text, 52) as b, left(text, 46) as c, left(text, 900) as d from documents where text is not null")
def truncations(s, d):
    """The four widths."""
    t = table(s, d, "documents").where(F.col("text").isNotNull())
    return t.select("doc_id", *[F.substring("text", 1, n).alias(c) for c, n in (("a", 400), ("b", 52), ("c", 46), ("d", 900))])


@query("""with k as (select list(term) as known from terms), r as (select page_id, (case when month(path_date::date)<=6 then 'spring' when month(path_date::date)=7 then 'summer' else 'fall' end || year(path_date::date)::varchar) as ruled, 'fall' || year(path_date::date)::varchar as fall from blog_pages)
select page_id, case when list_contains(known, ruled) then ruled when list_contains(known, fall) then fall else ruled end as term from r, k""")
def term_fallback(s, d):
    """The term of the month rule if it is known, else that year's fall term, else as ruled."""
    known = table(s, d, "terms").agg(F.collect_set("term").alias("known"))  # a fixed small table
    return table(s, d, "blog_pages").crossJoin(F.broadcast(known)).select("page_id", D.known_term(F.col("path_date").cast("date"), F.col("known")).alias("term"))


@query("""select row_id, case when row_id % 3 = 1 then '1 talk' else (row_id % 3) || ' talks' end as counted, regexp_replace(title, '[\\r\\n]+', '', 'g') as line from talks where title is not null""")
def plain_formatting(s, d):
    """Plural forms, line breaks stripped."""
    n = F.col("row_id") % 3
    t = table(s, d, "talks").where(F.col("title").isNotNull())
    return t.select("row_id", F.concat_ws(" ", n.cast("string"), X.plural(n, "talk", "talks")).alias("counted"), F.regexp_replace("title", r"[\r\n]+", "").alias("line"))


@query("""select doc_id, md5(regexp_replace(text, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', '', 'g')) as bare, length(replace(replace(replace(replace(regexp_replace(text, '[&]', '+', 'g'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) as escaped from documents where text is not null""")
def markup_filters(s, d):
    """Markup stripped; characters of markup escaped."""
    t = table(s, d, "documents").where(F.col("text").isNotNull())
    return t.select("doc_id", F.md5(X.strip_html(F.col("text"))).alias("bare"), F.length(X.escape_once(F.translate("text", "&", "+"))).cast("long").alias("escaped"))


@query(f"""select row_id, regexp_replace(case when row_id % 2 = 0 then 'Speaker: ' else 'speaker ' end || coalesce(title, ''), '(?i)^\\s*speaker\\s*:?\\s*', '') as bare, coalesce({_CLEAN.format("replace(replace(coalesce(title, ''), 'q', 'Havard'), 'Havard', 'Harvard')")}, '') as fixed from talks""")
def label_and_spelling(s, d):
    """A label taken off, its colon optional; known misspellings mended, then cleaned."""
    t = table(s, d, "talks")
    labelled = F.concat(F.when(F.col("row_id") % 2 == 0, "Speaker: ").otherwise("speaker "), F.coalesce("title", F.lit("")))
    return t.select("row_id", X.strip_label(labelled, "speaker").alias("bare"), X.fix_spelling(F.replace(F.coalesce("title", F.lit("")), F.lit("q"), F.lit("Havard"))).alias("fixed"))


@query("""select (select count(*) from terms) as terms, count(*) as entries, count_if(kind is null) as talks, count_if(kind is not null) as others, (select count(*) from people where lower(trim(type)) in ('faculty','postdoc','student','alumni')) as on_roster, (select count(*) from people) as people, count_if(starts_with(paper_url, 'http')) as external, count(distinct feed) as feeds from talks""")
def final_totals(s, d):
    """The eight totals of a run, each in one pass over its table."""
    t = table(s, d, "talks").agg(F.count("*").alias("entries"), F.count_if(F.col("kind").isNull()).alias("talks"), F.count_if(F.col("kind").isNotNull()).alias("others"), F.count_if(X.is_external(F.col("paper_url"))).alias("external"), F.count_distinct("feed").alias("feeds"))
    p = table(s, d, "people").agg(F.count("*").alias("people"), F.count_if(F.lower(F.trim("type")).isin(T.ROSTERS)).alias("on_roster"))
    return t.crossJoin(p).crossJoin(table(s, d, "terms").agg(F.count("*").alias("terms"))).select("terms", "entries", "talks", "others", "on_roster", "people", "external", "feeds")


@query("""with t as (select feed, date, min(title) as t from talks where title is not null and date is not null group by 1, 2), c as (select page_id, b.title as a, t.t as b from blog_pages b left join t using (feed, date)),
s as (select *, length(regexp_replace(a, '[\\x00-\\x7F]', '', 'g')) as na, length(regexp_replace(b, '[\\x00-\\x7F]', '', 'g')) as nb from c)
select page_id, case when b is null then a when a is null then b when (nb, length(b)) > (na, length(a)) then b else a end as title from s""")
def richest_of_two(s, d):
    """Of a page's title and a row's the one with most non-ASCII characters, then the longer, then the page's."""
    t = table(s, d, "talks").where(F.col("title").isNotNull() & F.col("date").isNotNull()).groupBy("feed", "date").agg(F.min("title").alias("t"))
    b = table(s, d, "blog_pages").select("page_id", "feed", "date", "title").join(t, ["feed", "date"], "left")
    return b.select("page_id", R.richest(F.array_compact(F.array("title", "t"))).alias("title"))


@query()
def surface_slugs(s, d):
    """Spellings and sources of every slug that has several spellings. No SQL: slugs need decomposition."""
    t = table(s, d, "talks").where(F.col("speaker_raw").isNotNull())
    forms = t.groupBy("speaker_raw").agg(F.collect_set("feed").alias("feeds"))
    forms = forms.select("speaker_raw", "feeds", X.slugify("speaker_raw").alias("slug")).where(F.col("slug").isNotNull())
    g = forms.groupBy("slug").agg(F.array_sort(F.collect_set("speaker_raw")).alias("forms"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("feeds")))).alias("sources"))
    return g.where(F.size("forms") > 1)
