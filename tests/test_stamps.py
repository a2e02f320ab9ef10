import pytest

from plinth.functions.stamps import canonical

NY = "America/New_York"
CASES = [
    ("25 Apr 2025", NY, "MDY", None, "2025-04-25"),
    ("3/4/2020", NY, "MDY", None, "2020-03-04"),
    ("3/4/2020", "Europe/Paris", "DMY", None, "2020-04-03"),
    ("2020/3/4", "Europe/Paris", "DMY", None, "2020-03-04"),
    ("16-MAR-21", NY, "MDY", None, "2021-03-16"),
    ("10/25/70", NY, "MDY", None, "1970-10-25"),
    ("Sept 24th", NY, "MDY", 2019, "2019-09-24"),
    ("Sept 24th", NY, "MDY", None, None),
    ("21 Apr and 28 Apr 2023", NY, "MDY", None, "2023-04-21"),
    ("12. März 2024", "Europe/Zurich", "DMY", None, "2024-03-12"),
    ("le 11 mars 2016", "Europe/Paris", "DMY", None, "2016-03-11"),
    ("2020年3月16日", NY, "MDY", None, "2020-03-16"),
    ("2019-W36-3", NY, "MDY", None, "2019-09-04"),
    ("1580380200576", NY, "MDY", None, "2020-01-30T10:30Z"),
    ("1554793200", NY, "MDY", None, "2019-04-09T07:00Z"),
    ("20180122T160021Z", NY, "MDY", None, "2018-01-22T16:00Z"),
    ("20180122T160031Z", NY, "MDY", None, "2018-01-22T16:01Z"),
    ("44623.708333", "Australia/Sydney", "DMY", None, "2022-03-03T06:00Z"),
    ("42440", NY, "MDY", None, "2016-03-11"),
    ("Mon, 28 Oct 2019 14:00:00 -0400", NY, "MDY", None, "2019-10-28T18:00Z"),
    ("2012-02-08 17:00:12 America/New_York", "Asia/Tokyo", "DMY", None, "2012-02-08T22:00Z"),
    ("20240125, 16h00 (GMT)", "Europe/Paris", "DMY", None, "2024-01-25T16:00Z"),
    ("3 February, 13.30 Uhr (EST)", NY, "MDY", 2013, "2013-02-03T18:30Z"),
    ("6/18/2019, 3-4 pm", NY, "MDY", None, "2019-06-18T19:00Z"),
    ("2019-06-18 at noon", NY, "MDY", None, "2019-06-18T16:00Z"),
    ("Tuesday, 12/08/20 - NQ 1507", NY, "MDY", None, "2020-12-08"),
    ("Monday, April 4, Annex 12", NY, "MDY", 2016, "2016-04-04"),
    # set back: the earlier of the two instants; set forward: the offset before the change
    ("2019-11-03 01:30", NY, "MDY", None, "2019-11-03T05:30Z"),
    ("2019-03-10 02:30", NY, "MDY", None, "2019-03-10T07:30Z"),
    ("TBD", NY, "MDY", 2020, None),
    ("Spring break", NY, "MDY", 2020, None),
    ("31/02/2020", NY, "DMY", None, None),
    ("", NY, "MDY", 2020, None),
    (None, NY, "MDY", 2020, None),
    ("2019-11-03 01:30", None, None, None, "2019-11-03"),
]


@pytest.mark.parametrize(("text", "zone", "order", "year", "want"), CASES)
def test_canonical(text, zone, order, year, want):
    assert canonical(text, zone, order, year) == want


def test_operator_keeps_rows_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    from plinth.operators.timestamps import archive_stamps, stamped

    df = spark.createDataFrame([(1, "3/4/2020", "x"), (1, "3/4/2020", "x"), (2, None, "y"), (3, "x " * 50_000, "z")], "k int, t string, year string")
    got = stamped(df, F.col("t"), F.lit(NY), F.lit("MDY"), F.lit(None).cast("int")).select("k", "canon", "year").collect()
    assert sorted((r.k, r.canon or "", r.year) for r in got) == [(1, "2020-03-04", "x"), (1, "2020-03-04", "x"), (2, "", "y"), (3, "", "z")]
    talks = spark.createDataFrame([], "row_id long, feed string, date_raw string, term string")
    pages = spark.createDataFrame([(7, "nowhere", "Mar 3", "2014-03-03")], "page_id long, feed string, meta_raw string, path_date string")
    feeds = spark.createDataFrame([], "feed string, zone string, date_order string")
    assert [tuple(r) for r in archive_stamps(talks, pages, feeds).collect()] == [("blog_pages", 7, "2014-03-03")]
