"""One registered query per operator of the reconciliation engine, over whole tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import dates as D
from plinth.functions import text as X
from plinth.operators import reconcile as R
from plinth.operators import views as V
from plinth.plans.merge import merge
from plinth.session import table
from plinth.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2020-03-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TERM_SQL = "(case when month(o_orderdate)<=6 then 'spring' when month(o_orderdate)=7 then 'summer' else 'fall' end || year(o_orderdate)::varchar)"


@query(f"select {_TERM_SQL} as term_key, count(*) as talks from orders where o_orderstatus is not null group by 1")
def term_counts(s, d):
    """The flagship."""
    t = table(s, d, "orders").where(F.col("o_orderstatus").isNotNull()).groupBy(D.infer_term(F.col("o_orderdate")).alias("term_key")).agg(F.count("*").alias("talks"))
    return V.ordered_terms(t, "term_key")


@query("select row_id, term, title, strftime(date, '%-d %b %Y') as shown from talks where kind is null and title is not null and date is not null")
def archive_listing(s, d):
    """F1 J15 F22 O1."""
    t = V.archive(table(s, d, "talks")).where(F.col("date").isNotNull())
    return t.select("row_id", "term", "title", F.date_format("date", "d MMM yyyy").alias("shown"))


@query(f"select row_id, title, date from talks where kind is null and title is not null and date >= date '{AS_OF}' order by date, title nulls first, row_id limit 1")
def upcoming_next(s, d):
    """F3 O4 T16."""
    return V.next_one(table(s, d, "talks"), AS_OF, [F.col("date"), F.col("title"), F.col("row_id")]).select("row_id", "title", "date")


@query("select row_id from talks where contains(lower(concat_ws(' ', title, speaker_raw, date::varchar, term)), 'under a fixed budget')")
def search_contains(s, d):
    """F4 F6."""
    t = table(s, d, "talks")
    return t.where(V.matches(X.haystack(F.col("title"), F.col("speaker_raw"), F.col("date").cast("string"), F.col("term")), " Under a fixed budget ")).select("row_id")


@query("select term, count(*) as hits from talks where lower(title) like '%river%' and term is not null group by term")
def search_sections(s, d):
    """Sections that stay visible, with their hits."""
    hits = table(s, d, "talks").where(V.matches(F.lower("title"), "river"))
    return V.shown(table(s, d, "terms").select("term"), hits, "term").join(hits.groupBy("term").agg(F.count("*").alias("hits")), "term")


@query("select term from terms where term not in (select term from talks where term is not null and contains(lower(title), 'galaxy'))")
def hidden_sections_anti(s, d):
    """F5."""
    hits = table(s, d, "talks").where(V.matches(F.lower("title"), "galaxy"))
    return V.hidden(table(s, d, "terms").select("term"), hits, "term")


@query("select o_custkey, o_orderdate, o_orderkey from (select *, row_number() over (partition by o_custkey, o_orderdate order by o_orderkey) as rn from orders) where rn = 1")
def keyed_first_wins(s, d):
    """D1."""
    return R.keep_first(table(s, d, "orders"), ["o_custkey", "o_orderdate"], [F.col("o_orderkey")]).select("o_custkey", "o_orderdate", "o_orderkey")


@query("select user_id, event_type, min(event_id) as event_id, arg_max(value, event_id) as value from events group by 1, 2")
def last_wins_keep_pos(s, d):
    """D2."""
    return R.last_wins(table(s, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("select event_id, last_value(case when event_type = 'view' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as block from events")
def block_carry_forward(s, d):
    """D6 S6."""
    e = table(s, d, "events").withColumn("head", F.when(F.col("event_type") == "view", F.col("value")))
    return R.carry_forward(e, "head", ["user_id"], [F.col("ts"), F.col("event_id")], "block").select("event_id", "block")


def _day_sql() -> str:
    """The limited parser in SQL: each format by its pattern, the year from the term."""
    short = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
    long = "january|february|march|april|may|june|july|august|september|october|november|december"
    s = "trim(regexp_replace(replace(date_raw, chr(65279), ''), '[\\s\\p{Z}\\x1c-\\x1f\\x85]+', ' ', 'g'))"
    s = f"regexp_replace({s}, '\\s*[-–].*$', '')"
    s = f"regexp_replace(trim(regexp_replace({s}, '\\s*\\([^)]*\\)', '', 'g')), ',+$', '')"
    for a, b in D.SHORTENED.items():
        s = f"regexp_replace({s}, '(?i)\\b{a}\\b', '{b}', 'g')"
    month = lambda x: f"(position(lower(left({x}, 3)) in '{short.replace('|', ' ')}') + 3) // 4"

    def read(x: str, y: str | None) -> str:
        """Cases (pattern, year, month, day) in order; without y the full formats, with it the yearless ones."""
        g = lambda p, i: f"regexp_extract({x}, '(?i){p}', {i})"
        if y is None:
            full = [(f"^(\\d{{1,2}}) ({short}) (\\d{{4}})$", 3, (2,), 1), (f"^(\\d{{1,2}}) ({long}) (\\d{{4}})$", 3, (2,), 1), (f"^(\\d{{1,2}}) ({short}), (\\d{{4}})$", 3, (2,), 1), (f"^({short}) (\\d{{1,2}}), (\\d{{4}})$", 3, (1,), 2), (f"^({long}) (\\d{{1,2}}), (\\d{{4}})$", 3, (1,), 2),
                    ("^(\\d{1,2})/(\\d{1,2})/(\\d{4})$", 3, 1, 2), ("^(\\d{1,2})/(\\d{1,2})/(\\d{2})$", 3, 1, 2)]
        else:
            full = [(f"^({short}) (\\d{{1,2}})$", None, (1,), 2), (f"^({long}) (\\d{{1,2}})$", None, (1,), 2), (f"^(\\d{{1,2}}) ({short})$", None, (2,), 1), (f"^(\\d{{1,2}}) ({long})$", None, (2,), 1), ("^(\\d{1,2})/(\\d{1,2})$", None, 1, 2)]
        tries = []
        for p, yy, mm, dd in full:
            mo = month(g(p, mm[0])) if isinstance(mm, tuple) else f"try_cast({g(p, mm)} as int)"
            da = f"try_cast({g(p, dd)} as int)"
            if yy is None:
                ye, ok = y, f" and not ({mo} = 2 and {da} = 29)"
            else:
                yr = f"try_cast({g(p, yy)} as int)"
                ye, ok = f"case when length({g(p, yy)}) = 2 then {yr} + case when {yr} >= 69 then 1900 else 2000 end else {yr} end", ""
            tries.append(f"case when regexp_matches({x}, '(?i){p}'){ok} then try_cast(({ye}) || '-' || lpad(({mo})::varchar, 2, '0') || '-' || lpad(({da})::varchar, 2, '0') as date) end")
        return f"coalesce({', '.join(tries)})"

    head = "nullif(regexp_extract(s, '^([A-Za-z]{3,9}\\.?\\s+\\d{1,2}|\\d{1,2}/\\d{1,2})', 1), '')"
    return f"with c as (select row_id, try_cast(regexp_extract(term, '(\\d{{4}})') as int) as y, {s} as s from talks), h as (select *, {head} as h from c) select row_id, coalesce({read('s', None)}, {read('s', 'y')}, {read('h', 'y')})::varchar as day from h"


_DAY_SQL = _day_sql()
_PICK = """with r as (select t.row_id, nullif(t.room,'') as a, nullif(m.default_room,'') as b from talks t left join terms m using (term))
select {cols} from r {where}"""


def _picked(s, d):
    t = table(s, d, "talks").join(table(s, d, "terms").select("term", "default_room"), "term", "left")
    return t.select("row_id", R.pick(("row", F.col("room")), ("term", F.col("default_room"))).alias("p"))


@query(_PICK.format(cols="row_id, coalesce(a, b) as value, case when a is not null then 'row' when b is not null then 'term' end as source", where=""))
def precedence_pick(s, d):
    """R2 R8 R9 R11."""
    return _picked(s, d).select("row_id", "p.value", "p.source")


@query(_PICK.format(cols="'room' as field, row_id::varchar as key, 'row' as chosen_source, a as chosen, 'term' as other_source, b as other", where="where a is not null and b is not null and trim(a) <> trim(b)"))
def pick_conflicts(s, d):
    """R2 R16 T12 K4."""
    return R.log_lines(R.conflicts(_picked(s, d), F.col("row_id").cast("string"), "room", "p"))


@query("""with k as (select feed, term, row_id, title, length(regexp_replace(title, '[\\x00-\\x7F]', '', 'g')) as odd from talks where title is not null)
select feed, term, arg_max(title, (odd, length(title), -row_id)) as title from k group by 1, 2""")
def richest_title(s, d):
    """The candidate with most non-ASCII characters, then the longest, then the first."""
    t = table(s, d, "talks").where(F.col("title").isNotNull())
    odd = F.length(F.regexp_replace("title", r"[\x00-\x7F]", ""))
    return t.groupBy("feed", "term").agg(F.max_by("title", F.struct(odd, F.length("title"), -F.col("row_id"))).alias("title"))


@query("""select b.page_id, coalesce(t.row_id, u.row_id) as row_id from blog_pages b
left join (select file_key, min(row_id) as row_id from (select feed || '|' || date::varchar as file_key, row_id from talks where date is not null) group by 1) t on t.file_key = b.feed || '|' || b.date::varchar
left join (select term, min(row_id) as row_id from talks group by 1) u on u.term = (case when month(b.path_date::date)<=6 then 'spring' when month(b.path_date::date)=7 then 'summer' else 'fall' end || year(b.path_date::date)::varchar)""")
def whole_row_fallback_join(s, d):
    """By feed and day, else the first row of the term."""
    t = table(s, d, "talks")
    by_day = t.where(F.col("date").isNotNull()).groupBy(F.concat_ws("|", "feed", F.col("date").cast("string")).alias("k1")).agg(F.min("row_id").alias("row_id"))
    by_term = t.groupBy(F.col("term").alias("k2")).agg(F.min("row_id").alias("row_id"))
    b = table(s, d, "blog_pages").select("page_id", F.when(F.col("date").isNotNull(), F.concat_ws("|", "feed", F.col("date").cast("string"))).alias("k1"), D.infer_term(F.col("path_date").cast("date")).alias("k2"))
    return R.whole_row_fallback(b, by_day, by_term, "k1", "k2", "hit").select("page_id", F.col("hit.row_id").alias("row_id"))


@query("""with o as (select o_orderkey, case when o_custkey % 5 = 0 then null else o_custkey end as k from orders), c as (select case when c_custkey % 5 = 0 then null else c_custkey end as k, max(c_name) as name from customer group by 1)
select o_orderkey, c.name from o left join c on o.k is not distinct from c.k""")
def null_safe_key_join(s, d):
    """A null key meets a null key."""
    nul = lambda c: F.when(F.col(c) % 5 != 0, F.col(c))
    o = table(s, d, "orders").select("o_orderkey", nul("o_custkey").alias("k"))
    c = table(s, d, "customer").groupBy(nul("c_custkey").alias("k")).agg(F.max("c_name").alias("name"))
    return R.null_safe_left(o, c, ["k"]).select("o_orderkey", "name")


@query("""with f as (select o_custkey, o_orderdate, o_orderkey from orders where o_orderstatus = 'F'),
o as (select o_custkey, o_orderdate, min(o_orderkey) as o_orderkey from orders r where o_orderstatus = 'O' and not exists (select 1 from f where f.o_custkey = r.o_custkey and f.o_orderdate = r.o_orderdate) group by 1, 2),
fo as (select * from f union all select * from o),
p as (select o_custkey, o_orderdate, min(o_orderkey) as o_orderkey from orders r where o_orderstatus = 'P' and not exists (select 1 from fo where fo.o_custkey = r.o_custkey and fo.o_orderdate = r.o_orderdate) group by 1, 2)
select * from fo union all select * from p""")
def staged_union(s, d):
    """Each stage admits only keys that no earlier one has."""
    o = table(s, d, "orders")
    st = [o.where(F.col("o_orderstatus") == x).select("o_custkey", "o_orderdate", "o_orderkey") for x in ("F", "O", "P")]
    return R.staged_union(st, ["o_custkey", "o_orderdate"], [F.col("o_orderkey")])


_OK = "(not list_contains(w.ks, o.k) and not list_contains(w.cs, o.c))"


@query(f"""with recursive o as (select row_number() over (order by doc_id) as i, doc_id, concat_ws('|', source, posted_at::date::varchar) as k, md5(coalesce(text, '')) as c from documents),
w(i, doc_id, ok, ks, cs) as (select 0::bigint, null::bigint, false, []::varchar[], []::varchar[] union all
select o.i, o.doc_id, {_OK}, case when {_OK} then list_append(w.ks, o.k) else w.ks end, case when {_OK} then list_append(w.cs, o.c) else w.cs end from w join o on o.i = w.i + 1)
select doc_id, ok as admitted from w where i > 0""")
def greedy_orphans(s, d):
    """Admission in order; a refused row adds neither key nor content."""
    docs = table(s, d, "documents").select("doc_id", F.concat_ws("|", "source", F.to_date("posted_at").cast("string")).alias("k"), F.md5(F.coalesce("text", F.lit(""))).alias("content"))
    none = docs.limit(0)
    return R.greedy_admission(docs, "k", "content", "doc_id", none, none).select("doc_id", "admitted")


@query("""select coalesce(s_suppkey, k) as s_suppkey, case when k = 3 then 'renamed' when k = -1 then 'created' else s_name end as s_name, case when k = 5 then null else s_nationkey::varchar end as s_nationkey
from supplier full outer join (values (3), (5), (-1)) p(k) on s_suppkey = k""")
def patch_overrides(s, d):
    """Upsert by field, null deletes, unknown keys create."""
    p = s.createDataFrame([(3, "s_name", "renamed", False), (5, "s_nationkey", None, True), (-1, "s_name", "created", False)], "s_suppkey long, field string, value string, is_delete boolean")
    return R.patched(table(s, d, "supplier"), p, "s_suppkey", ["s_name", "s_nationkey"]).select("s_suppkey", "s_name", "s_nationkey")


@query("select row_id from talks where date is null or not ((term = 'fall2019' and date = date '2019-10-01') or (term = 'spring2020' and date = date '2020-03-16' and coalesce(speaker_raw, '') = 'Julia Gialzurn'))")
def drop_rules(s, d):
    """A rule without speaker drops every row of its term and day."""
    t = table(s, d, "talks").withColumn("said", F.array(F.coalesce("speaker_raw", F.lit(""))))
    rules = s.createDataFrame([("fall2019", "2019-10-01", None), ("spring2020", "2020-03-16", "Julia Gialzurn")], "term string, date string, speaker string").withColumn("date", F.to_date("date"))
    return R.dropped(t, rules, "said").select("row_id")


@query("""with p as (select person_id, lower(regexp_replace(firstname || '_' || lastname, '[^A-Za-z0-9]+', '_', 'g')) as slug from people where firstname is not null),
a as (select other_slug as alias, slug as canon from aliases where rule = 'merge')
select person_id, p.slug, coalesce(canon, p.slug) as canon from p left join a on p.slug = a.alias""")
def alias_canonicalise(s, d):
    """J11 C4 C5."""
    p = table(s, d, "people").where(F.col("firstname").isNotNull()).select("person_id", F.lower(F.regexp_replace(F.concat_ws("_", "firstname", "lastname"), "[^A-Za-z0-9]+", "_")).alias("slug"))
    a = table(s, d, "aliases").where(F.col("rule") == "merge").select(F.col("other_slug").alias("alias"), F.col("slug").alias("canon"))
    return R.canonical(p, "slug", a, "canon").select("person_id", "slug", "canon")


@query("""select coalesce(term, k) as term, coalesce(term_name, array_to_string(list_transform(string_split(k, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')) as term_name from terms full outer join (select distinct feed as k from talks union select distinct term from talks) r on term = k where coalesce(term, k) is not null""")
def closure_backfill(s, d):
    """Every referenced key exists, a missing name is made from the key."""
    t = table(s, d, "talks")
    return R.closure(table(s, d, "terms").select("term", "term_name"), t.select(F.col("feed").alias("term")).union(t.select("term")), "term", "term_name")


@query("select s_nationkey, string_agg(s_name, '; ' order by split_part(s_name, ' ', -1), s_name) as members from supplier group by 1")
def roster_groups(s, d):
    """A14 O6 J17."""
    return V.roster_groups(table(s, d, "supplier"), "s_nationkey", "s_name")


@query("""select l_orderkey, string_agg(s_name || case when s_nationkey % 2 = 0 then '' else ' (' || n_name || ')' end, ', ' order by l_linenumber, l_suppkey) as byline from
(select l_orderkey, l_linenumber, l_suppkey from lineitem) l join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1""")
def byline_join(s, d):
    """Names in order, the affiliation where not on the roster."""
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("x"))
    li = li.select("l_orderkey", F.transform("x", lambda v: v["l_suppkey"].cast("string")).alias("speakers"))
    p = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    p = p.select(F.col("s_suppkey").cast("string").alias("slug"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 2 == 0, "member").alias("roster"), F.col("n_name").alias("affiliation"))
    return V.byline(li, "l_orderkey", "speakers", p)


@query()
def near_name_pairs(s, d):
    """Pairs of hand-made slugs and roster slugs alike by 0.86 or more; no SQL: sequence similarity."""
    p = table(s, d, "people").where(F.col("firstname").isNotNull()).select(X.slugify(F.concat_ws(" ", "firstname", "lastname")).alias("slug"))
    a = table(s, d, "aliases")
    p = p.union(a.select("slug")).union(a.select("other_slug"))
    return R.near_pairs(p, "slug", 0.86)


@query("select lower(trim(speaker_raw)) as slug, list_sort(list(distinct speaker_raw)) as forms from talks where speaker_raw is not null group by 1 having count(distinct speaker_raw) > 1")
def surface_forms(s, d):
    """A11 A12."""
    t = table(s, d, "talks").where(F.col("speaker_raw").isNotNull()).groupBy(F.lower(F.trim("speaker_raw")).alias("slug")).agg(F.array_sort(F.collect_set("speaker_raw")).alias("forms"))
    return t.where(F.size("forms") > 1)


@query("""select 'both' as side, count(*) as n from (select c_custkey from customer intersect select o_custkey from orders) union all
select 'idle', count(*) from (select c_custkey from customer except select o_custkey from orders) union all select 'all', count(*) from (select c_custkey from customer union select o_custkey from orders)""")
def set_ops_report(s, d):
    """U2-U5 J20 A13."""
    c, o = table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select("o_custkey")
    one = lambda n, df: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("side"), "n")
    return one("both", c.intersect(o)).unionByName(one("idle", c.subtract(o))).unionByName(one("all", c.union(o).distinct()))


@query("""with b as (select page_id, title, date, '/blog/' || year(path_date::date) || '/' || month(path_date::date) || '/' || day(path_date::date) || '/' || page_id || '.html' as short,
'/blog/' || strftime(path_date::date, '%Y/%m/%d') || '/' || page_id || '.html' as padded from blog_pages)
select distinct url, '/archive.html#t-' || coalesce(date::varchar || '-', '') || page_id as target, coalesce(title, '') as label from (select *, short as url from b union all select *, padded from b)""")
def redirect_explode(s, d):
    """X18 X26 K5 U6 J21."""
    p = F.col("path_date").cast("date")
    url = F.concat(F.lit("/blog/"), F.year(p), F.lit("/"), F.month(p), F.lit("/"), F.day(p), F.lit("/"), F.col("page_id"), F.lit(".html"))
    b = table(s, d, "blog_pages").select(url.alias("u"), "date", F.col("page_id").cast("string").alias("slug"), F.coalesce("title", F.lit("")).alias("l"))
    return V.redirects(b, "u", "date", "slug", F.col("l"))


@query("""select t.term, array_to_string(list_filter([case when count(t.row_id) > 0 then 'talks' end, case when max(b.k) is not null then 'pages' end], lambda x: x is not null), '+') as sources
from talks t left join (select distinct case when month(path_date::date)<=6 then 'spring' when month(path_date::date)=7 then 'summer' else 'fall' end || year(path_date::date)::varchar as k from blog_pages) b on b.k = t.term where t.term is not null group by 1""")
def source_signatures(s, d):
    """R13."""
    b = table(s, d, "blog_pages").select(D.infer_term(F.col("path_date").cast("date")).alias("term"), F.lit(True).alias("page")).distinct()
    t = table(s, d, "talks").where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("n")).join(b, "term", "left")
    return t.select("term", F.array_join(R.signature(("talks", F.col("n") > 0), ("pages", F.col("page"))), "+").alias("sources"))


@query("select doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(text, chr(65279), ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g')) as text from documents")
def clean_text(s, d):
    """The SQL knows the entities of plain markup only."""
    return table(s, d, "documents").select("doc_id", X.clean_text("text").alias("text"))


@query()
def slugify_titles(s, d):
    """No SQL, compatibility decomposition."""
    return table(s, d, "talks").where(F.col("title").isNotNull()).select("row_id", X.slugify("title").alias("slug"), X.title_norm("title").alias("norm"))


@query()
def split_names(s, d):
    """X5 X6 X3 X4 T8."""
    t = table(s, d, "talks").withColumn("n", X.split_speaker_note("speaker_raw"))
    return t.select("row_id", "n.name", "n.affiliation", "n.room", "n.weekday", "n.note", F.array_join(X.split_speakers("speaker_raw"), "; ").alias("speakers"))


@query("""select row_id, case when speaker_raw is null or regexp_full_match(trim(speaker_raw), '(?i)tbd|tba|n/?a') or trim(speaker_raw) = '' then 'tbd' when regexp_matches(speaker_raw, '(?i)\\bcancel') then 'cancelled'
when regexp_matches(speaker_raw, '(?i)\\b(no\\s*meeting|no\\s*class|fall\\s*break|spring\\s*break|thanksgiving|democracy\\s*day|holiday|winter\\s*break|recess)\\b') then 'no_meeting' else 'talk' end as kind from talks""")
def classify_rows(s, d):
    """X20 X34 F13."""
    return table(s, d, "talks").select("row_id", X.classify_row(X.spaced("speaker_raw")).alias("k")).select("row_id", "k.kind")


@query("select term, lower(replace(term_name, ' ', '')) as made, lower(replace(term_name, ' ', '')) = term as same from terms")
def term_keys(s, d):
    """X19."""
    return table(s, d, "terms").select("term", X.term_key(F.col("term_name")).alias("made"), (X.term_key(F.col("term_name")) == F.col("term")).alias("same"))


@query(_DAY_SQL)
def date_formats(s, d):
    """T-1 T-2 S20: the limited parser over every cell as typed, the year from the term."""
    t = table(s, d, "talks")
    return t.select("row_id", D.parse_date(X.spaced("date_raw"), D.year_of(F.col("term"))).cast("string").alias("day"))


@query("select page_id, coalesce(lower(dayname(date)) = lower(trim(weekday)), true) as ok, coalesce(date = path_date::date, false) as on_path from blog_pages")
def weekday_check(s, d):
    """T-5 T-6 T-7 X36."""
    return table(s, d, "blog_pages").select("page_id", D.check_weekday(F.col("date"), F.col("weekday")).alias("ok"), F.coalesce(F.col("date") == F.try_to_date("path_date"), F.lit(False)).alias("on_path"))


@query("""with c(token, fg, bg) as (values ('text','#111111','#ffffff'), ('muted','#767676','#ffffff'), ('faint','#aaaaaa','#ffffff'), ('night','#8ab4f8','#202124')),
h as (select token, side, i, (('0x' || substr(v, 2*i, 2))::int) / 255.0 as x from (select token, 'fg' as side, fg as v from c union all select token, 'bg', bg from c), range(1, 4) r(i)),
l as (select token, side, sum((case i when 1 then 0.2126 when 2 then 0.7152 else 0.0722 end) * case when x <= 0.04045 then x / 12.92 else pow((x + 0.055) / 1.055, 2.4) end) as y from h group by 1, 2),
r as (select token, round((max(y) + 0.05) / (min(y) + 0.05), 4) as ratio from l group by 1) select token, ratio, ratio >= 4.5 as ok, ratio < 4.5 and token not in ('faint') as fails from r""")
def contrast_ratio(s, d):
    """M1-M3 F20 S19."""
    c = s.createDataFrame([("text", "#111111", "#ffffff"), ("muted", "#767676", "#ffffff"), ("faint", "#aaaaaa", "#ffffff"), ("night", "#8ab4f8", "#202124")], "token string, fg string, bg string")
    r = F.round(X.contrast(F.col("fg"), F.col("bg")), 4)
    return c.select("token", r.alias("ratio"), (r >= 4.5).alias("ok"), ((r < 4.5) & ~F.col("token").isin("faint")).alias("fails"))


@query("select p_partkey, round(least(1.0, greatest(440.0 / (p_size * 40), 550.0 / (p_size * 60))), 6) as scale, greatest(1, round_even(p_size * 40 * least(1.0, greatest(440.0 / (p_size * 40), 550.0 / (p_size * 60))), 0))::bigint as w from part")
def cover_scale(s, d):
    """M4."""
    sc = X.cover_scale(F.col("p_size") * 40, F.col("p_size") * 60)
    return table(s, d, "part").select("p_partkey", F.round(sc, 6).alias("scale"), F.greatest(F.lit(1), F.bround(F.col("p_size") * 40 * sc, 0)).cast("long").alias("w"))


@query("select coalesce(kind, 'talk') as kind, count(*) as n from talks group by 1")
def kind_histogram(s, d):
    """A8 F18 F23."""
    return table(s, d, "talks").groupBy(F.coalesce("kind", F.lit("talk")).alias("kind")).agg(F.count("*").alias("n"))


@query("""select count(*) as pages, count_if(title is null) as no_title, count_if(speaker_raw is null) as no_speaker, count_if(abstract is null) as no_abstract, count_if(encoding = 'cp1252') as cp1252,
count_if(not date_matches_path) as off_path, coalesce(sum(len(latex)), 0)::bigint as formulas from blog_pages""")
def extractor_quality(s, d):
    """One pass."""
    c = F.count_if
    return table(s, d, "blog_pages").agg(
        F.count("*").alias("pages"), c(F.col("title").isNull()).alias("no_title"), c(F.col("speaker_raw").isNull()).alias("no_speaker"), c(F.col("abstract").isNull()).alias("no_abstract"), c(F.col("encoding") == "cp1252").alias("cp1252"),
        c(~F.col("date_matches_path")).alias("off_path"), F.coalesce(F.sum(F.size("latex")), F.lit(0)).cast("long").alias("formulas"),
    )


@query("select term, count(*) as rows, count_if(kind is null) as talks, count_if(title is not null) as titled from talks group by 1")
def block_counts(s, d):
    """Three counts that differ on purpose."""
    return table(s, d, "talks").groupBy("term").agg(F.count("*").alias("rows"), F.count_if(F.col("kind").isNull()).alias("talks"), F.count_if(F.col("title").isNotNull()).alias("titled"))


@query("select source_file, min(date) as first, max(date) as last, coalesce(not contains(source_file, year(min(date))::varchar), false) as mislabelled from talks group by 1")
def min_max_by_group(s, d):
    """A10 F25 O8."""
    g = table(s, d, "talks").groupBy("source_file").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return g.withColumn("mislabelled", F.coalesce(~F.contains("source_file", F.year("first").cast("string")), F.lit(False)))


@query("""with k as (select term, regexp_extract(term, '(\\d{4})')::int * 10 + case regexp_extract(term, '^([a-z]+)', 1) when 'spring' then 1 when 'summer' then 2 when 'fall' then 3 else 0 end as r from terms)
select row_number() over (order by r desc, term) as ord, term, case when row_number() over (order by r desc, term) = 1 then 'upcoming' end as status, (select max_by(term, r) from k) as newest, (select min_by(term, r) from k) as oldest from k""")
def ordered_terms(s, d):
    """O2 O3 A20 R21."""
    t = table(s, d, "terms").select("term", D.term_rank(F.col("term")).alias("r"))
    ends = t.agg(F.max_by("term", "r").alias("newest"), F.min_by("term", "r").alias("oldest"))
    t = t.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("r"), "term")).cast("long"))  # terms are a fixed small table
    return t.join(ends).select("ord", "term", F.when(F.col("ord") == 1, "upcoming").alias("status"), "newest", "oldest")


@query("""select row_id, coalesce(room is not null and (room <> default_room or (time is not null and (time <> default_time or default_weekday is not null))), false) as shown from talks left join terms using (term)""")
def display_rule(s, d):
    """F17 T9 J12."""
    t = table(s, d, "talks").join(table(s, d, "terms"), "term", "left")
    return t.select("row_id", V.details_shown(F.col("room"), F.col("default_room"), F.col("time"), F.col("default_time"), F.col("default_weekday")).alias("shown"))


@query("select row_id, case when upper(trim(title)) in ('NA','N/A','TBD','TBA') then '' else title end as title, case when upper(trim(abstract)) in ('NA','N/A') then '' else abstract end as abstract from talks")
def placeholder_nulling(s, d):
    """The two sets differ."""
    e = lambda c, v: F.when(F.upper(F.trim(c)).isin(*v), F.lit("")).otherwise(F.col(c)).alias(c)
    return table(s, d, "talks").select("row_id", e("title", T.NO_TITLE), e("abstract", T.NO_ABSTRACT))


@query("""with p as (select person_id, trim(regexp_replace(concat_ws(' ', nullif(firstname,''), nullif(lastname,'')), '[\\s\\p{Z}\\x1c-\\x1f\\x85]+', ' ', 'g')) as name, lower(trim(type)) as t, nullif(trim(position),'') as pos, nullif(trim(affiliation1),'') as a1, nullif(trim(webpage),'') as w, case when lower(trim(imgpath)) <> 'none' then nullif(trim(imgpath),'') end as img from people)
select person_id, name, case when t in ('faculty','postdoc','student','alumni') then t end as roster, case when coalesce(lower(pos) <> 'deceased', true) then pos end as position, case when a1 is distinct from pos then a1 end as affiliation,
regexp_replace(case when starts_with(w, 'http') then w else 'https://' || regexp_replace(w, '^/+', '') end, '^http://', 'https://') as url, case when t = 'faculty' then '/assets/people/' || regexp_replace(split_part(img, '/', -1), '\\.[^.]*$', '') || '.jpg' end as img from p where length(name) > 0""")
def roster_corrections(s, d):
    """S10 S11 R19 F15 X29."""
    return T.roster(table(s, d, "people")).select("person_id", "name", "roster", "position", "affiliation", "url", "img")


@query("""select t.row_id from talks t left join (select distinct feed, date from blog_pages where date is not null) b on b.feed = t.feed and b.date = t.date where t.kind is null and t.date is not null and b.feed is null""")
def unmatched_rows(s, d):
    """J6 and the view of rows no page takes up, which the staged merge would lose."""
    t = table(s, d, "talks").where(F.col("kind").isNull() & F.col("date").isNotNull())
    return R.unseen(t, table(s, d, "blog_pages").where(F.col("date").isNotNull()), ["feed", "date"]).select("row_id")


@query("select l_orderkey, case when count(distinct s_name) = 1 then min(s_name) else array_to_string(list_sort(list(distinct s_name))[:-2], ', ') || ' and ' || list_sort(list(distinct s_name))[-1] end as names from lineitem join supplier on s_suppkey = l_suppkey group by 1")
def conjunction_list(s, d):
    """X25 J18 C2 O7."""
    g = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("s_name")).alias("n"))
    return g.select("l_orderkey", X.conjunction(F.col("n")).alias("names"))


@query("select term, count(*) as n, sum(count(*)) over () as total, round(100.0 * count(*) / sum(count(*)) over (), 4) as percent from talks where kind is null group by 1")
def totals_and_shares(s, d):
    """A15 A16 A17 M5 A6."""
    g = table(s, d, "talks").where(F.col("kind").isNull()).groupBy("term").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.join(total).select("term", "n", "total", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 4).alias("percent"))


@query("select source_file, row_no, count(*) as n from talks group by 1, 2 having count(*) > 1")
def duplicate_keys(s, d):
    """S14 as a check on rows: keys that a strict load would refuse."""
    return R.unique_keys(table(s, d, "talks"), ["source_file", "row_no"])


def _merged(s, d):
    """The feeds of the archive as the five sources: two feeds that link their pages as index, legacy pages, CSV feeds,
    sheets with rows of every kind, and scanned lists as tables."""
    t = table(s, d, "talks").withColumnRenamed("row_id", "pos")
    of = lambda *feeds: t.where(F.col("feed").isin(*feeds))
    pages = table(s, d, "blog_pages").select(F.col("page_id").alias("pos"), F.try_to_date("path_date").alias("path_date"), "url", "speaker_raw", "title", "abstract", "time", "room", "weekday", "paper_url", "latex", "feed", "date")
    # an index entry names the page of its feed and day
    links = pages.where(F.col("date").isNotNull()).groupBy("feed", "date").agg(F.min_by("url", "pos").alias("href"))
    index = of("corvane_blog", "archive_scan").join(links, ["feed", "date"], "left").withColumn("kind", F.coalesce("kind", F.lit("talk")))
    al = table(s, d, "aliases").where(F.col("rule") == "merge").select(F.col("other_slug").alias("alias"), F.col("slug").alias("canon"))
    rules = s.createDataFrame([("fall2019", "2019-10-01", None)], "term string, date string, speaker string").withColumn("date", F.to_date("date"))
    sheet = of("corvane_sheet", "tidal_sheet").withColumns({"label": F.when(F.col("kind").isNotNull(), F.col("speaker_raw"))})
    return merge(index, pages, of("plumwell_csv", "eastmere_csv").where("kind is null"), sheet, of("oakhollow_list", "valmore_pages", "nordhaven_cal", "lindqvale_export").where("kind is null"), al, rules)


@query()
def merged_talks(s, d):
    """The staged merge over whole tables. No SQL: slugs and ordered admission."""
    t = _merged(s, d).talks
    return t.select("term", "kind", "date", F.array_join("speakers", ";").alias("speakers"), "title", "abstract", "time", "room", "weekday_override", "paper_url", F.array_join("legacy_urls", " ").alias("legacy_urls"), "recovered", F.array_join("sources", "+").alias("sources"))


@query()
def merge_conflicts(s, d):
    """What lost against each winner of the merge."""
    return _merged(s, d).conflicts
