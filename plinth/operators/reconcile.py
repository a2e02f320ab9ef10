"""Reconciliation of overlapping sources: first and last wins, precedence with a conflict log, staged admission,
patches, drop rules, canonical names and referential closure. All keys compare null-safely."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import text as X
from plinth.session import cut, within


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; a null key is a key. Spark turns the filter on the row number into a
    group limit before the shuffle, so a hot key moves one row a partition."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_wins(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The last row of each key at the position of the first; combines map-side, no window."""
    rest = [c for c in df.columns if c not in (*keys, pos)]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("_r"), F.min(pos).alias(pos))
    return g.select(*keys, pos, *[F.col(f"_r.{c}").alias(c) for c in rest])


def carry_forward(df: DataFrame, col: str, partition: list[str], order: list[Column], out: str) -> DataFrame:
    """The last non-null value so far, for block headers above their rows."""
    return df.withColumn(out, F.last(F.col(col), ignorenulls=True).over(Window.partitionBy(*partition).orderBy(*order)))


def missing(c: Column, array: bool = False) -> Column:
    return c.isNull() | (F.size(c) == 0 if array else c == "")


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def pick(*candidates: tuple[str, Column]) -> Column:
    """struct(source, value, conflicts): the first non-empty candidate, and every later one whose trimmed text differs."""
    arr = F.array(*[F.struct(F.lit(s).alias("source"), c.cast("string").alias("value")) for s, c in candidates])
    real = F.filter(arr, lambda x: x["value"].isNotNull() & (x["value"] != ""))
    won = F.get(real, F.lit(0))
    lost = F.filter(real, lambda x: stripped(x["value"]) != stripped(won["value"]))
    return F.struct(won["source"].alias("source"), won["value"].alias("value"), lost.alias("conflicts"))


def conflicts(df: DataFrame, key: Column, field: str, picked: str) -> DataFrame:
    """The six-column log of what lost against the winner."""
    return df.select(F.lit(field).alias("field"), key.alias("key"), F.col(f"{picked}.source").alias("chosen_source"), F.col(f"{picked}.value").alias("chosen"), F.explode(f"{picked}.conflicts").alias("_c")).select(
        "field", "key", "chosen_source", "chosen", F.col("_c.source").alias("other_source"), F.col("_c.value").alias("other")
    )


def log_lines(log: DataFrame, width: int = 400) -> DataFrame:
    """The log as its file has it: values cut to `width`, then tabs made spaces."""
    cut_ = lambda c: F.translate(F.substring(F.col(c), 1, width), "\t", " ")
    return log.select("field", "key", "chosen_source", cut_("chosen").alias("chosen"), "other_source", cut_("other").alias("other"))


def richest(values: Column) -> Column:
    """Of equivalent titles the one with most non-ASCII characters, then the longest, then the first."""
    scored = F.transform(values, lambda v, i: F.struct(F.length(F.regexp_replace(v, r"[\x00-\x7F]", "")).alias("odd"), F.length(v).alias("len"), (-i).alias("first"), v.alias("v")))
    return F.array_max(scored)["v"]


def whole_row_fallback(spine: DataFrame, first: DataFrame, second: DataFrame, on_first: str, on_second: str, prefix: str) -> DataFrame:
    """The row found by the first key, else the row found by the second; whole rows, never mixed by field."""
    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(F.col(key).alias(f"_{name}"), F.struct(*[c for c in df.columns if c != key]).alias(name))

    j = spine.join(side(first, on_first, "_a"), F.col(on_first).eqNullSafe(F.col("__a")), "left").drop("__a")
    j = j.join(side(second, on_second, "_b"), F.col(on_second).eqNullSafe(F.col("__b")), "left").drop("__b")
    return j.withColumn(prefix, F.coalesce("_a", "_b")).drop("_a", "_b")


def null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(r, on, "left").drop(*[f"_k_{k}" for k in keys])


def unseen(stage: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a stage whose key no earlier stage has."""
    s = seen.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return stage.join(s, on, "left_anti")


def staged_union(stages: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """The first stage whole, then from each later stage the first row of every key not seen before. One pass: rows are
    tagged with their stage and the least (stage, order) of a key wins; Spark cuts a hot key to one row a partition
    before the shuffle (partial window group limit)."""
    whole = stages[0]
    tagged = whole.select(*keys).distinct().withColumn("_stage", F.lit(0))
    for i, s in enumerate(stages[1:], 1):
        tagged = tagged.unionByName(s.withColumn("_stage", F.lit(i)), allowMissingColumns=True)
    later = keep_first(tagged, keys, [F.col("_stage"), *order]).where("_stage > 0").drop("_stage")
    return whole.unionByName(later, allowMissingColumns=True)


#: Rows up to which what is left of a greedy admission is settled by one ordered loop in one task.
LOOP_ROWS = 50_000


def greedy_admission(rows: DataFrame, key: str, content: str, pos: str, seen_keys: DataFrame, seen_contents: DataFrame) -> DataFrame:
    """`rows` with `admitted`, in order of `pos` (unique): a row is refused if its key or content was seen, and only an
    admitted row adds both. Null keys equal one another.

    What an earlier stage has is refused by joins, and of equal (key, content) all but the first. Of the rest only
    (pos, key, content) moves. A row that is first of both its key and its content is admitted, since nothing before it can
    rule it out; what shares a key or content with it is refused. Rounds repeat on what is left, with map-side minima, until
    at most LOOP_ROWS narrow rows remain, which one loop settles."""
    on = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    narrow = rows.select(F.col(pos).alias("_p"), F.col(key).alias("_k"), F.col(content).alias("_c"))
    live = narrow.join(seen_keys.select(F.col(key).alias("_x")).distinct(), on("_k", "_x"), "left_anti")
    live = live.join(seen_contents.select(F.col(content).alias("_x")).distinct(), on("_c", "_x"), "left_anti")
    live = cut(live.groupBy("_k", "_c").agg(F.min("_p").alias("_p")))
    admitted = []
    while not within(live, LOOP_ROWS):
        by_key = live.groupBy("_k").agg(F.min("_p").alias("_p"))
        by_content = live.groupBy("_c").agg(F.min("_p").alias("_p"))
        firsts = cut(by_key.join(by_content, "_p"))
        admitted.append(firsts.select("_p"))
        live = live.join(firsts.select(F.col("_k").alias("_x")), on("_k", "_x"), "left_anti")
        live = cut(live.join(firsts.select(F.col("_c").alias("_x")), on("_c", "_x"), "left_anti"))

    def loop(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, contents, good = set(), set(), []
        for p, k, c in pdf.sort_values("_p")[["_p", "_k", "_c"]].itertuples(index=False):
            if k not in keys and c not in contents:
                keys.add(k)
                contents.add(c)
                good.append(p)
        return pd.DataFrame({"_p": good})

    kind = live.schema["_p"].dataType.simpleString()
    settled = live.withColumns({c: F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))) for c in ("_k", "_c")}).withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(loop, f"_p {kind}")
    good = reduce(DataFrame.union, admitted, settled).withColumn("_ok", F.lit(True))
    return rows.join(good, F.col(pos) == F.col("_p"), "left").withColumn("admitted", F.coalesce("_ok", F.lit(False))).drop("_p", "_ok")


#: What `near_pairs` compares strings by: runs of at most so many letters.
GRAM = 3


def _bound(n: Column, m: Column, bar: float) -> tuple[Column, Column]:
    """(q, t): two strings of n and m letters with a ratio of `bar` share at least t runs of q letters, repeats counted. The
    ratio fixes how many letters match; every gap between matching blocks takes an unmatched letter of one side, so there
    are at most (n - M) + (m - M) + 1 blocks, and a block of b letters holds b - q + 1 runs."""
    match = F.ceil((n + m) * (bar / 2) - 1e-9)
    blocks = F.greatest(n + m - 2 * match + 1, F.lit(1))
    q = F.least(F.lit(GRAM), F.floor((match - 1) / blocks) + 1)
    return q.cast("int"), (match - (q - 1) * blocks).cast("int")


def near_pairs(df: DataFrame, col: str, bar: float) -> DataFrame:
    """(a, b, ratio) of all pairs a < b of distinct values whose ratio (in that order) reaches `bar`. Candidates meet on
    the rarest of their runs of letters: with t runs in common by `_bound`, two strings share one among all but t - 1 of
    each side's runs in any common order. Exact; values without partner of a fitting length meet nobody."""
    v = df.select(F.col(col).alias("v")).where(F.col("v").isNotNull()).distinct().withColumn("n", F.length("v"))
    partners = F.sequence(F.ceil(F.col("n") * (bar / (2 - bar)) - 1e-9).cast("int"), F.floor(F.col("n") * ((2 - bar) / bar) + 1e-9).cast("int"))
    fits = F.filter(F.transform(partners, lambda m: F.struct(_bound(F.col("n"), m, bar)[0].alias("q"), _bound(F.col("n"), m, bar)[1].alias("t"), (F.ceil((F.col("n") + m) * (bar / 2) - 1e-9) <= F.least(F.col("n"), m)).alias("ok"))), lambda x: x["ok"])
    v = v.where("n > 0").select("v", "n", F.explode(F.array_distinct(F.transform(fits, lambda x: x["q"]))).alias("q"), fits.alias("fits"))
    v = v.select("v", "n", "q", F.array_min(F.transform(F.filter("fits", lambda x: x["q"] == F.col("q")), lambda x: x["t"])).alias("t")).where(F.col("n") >= F.col("q"))
    runs = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("q") + 1), lambda i: F.substring(F.col("v"), i, F.col("q")))
    runs = v.select("v", "n", "q", "t", F.posexplode(runs).alias("i", "run"))
    nth = F.row_number().over(Window.partitionBy("v", "q", "run").orderBy("i"))
    runs = cut(runs.select("v", "n", "q", "t", "run", nth.alias("nth")))
    counts = runs.groupBy("q", "run", "nth").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("v", "q").orderBy("df", "run", "nth"))
    kept = runs.join(counts, ["q", "run", "nth"]).withColumn("_r", rank).where(F.col("_r") <= F.col("n") - F.col("q") + 1 - F.col("t") + 1)
    kept = cut(kept.select("v", "n", "q", F.xxhash64("q", "run", "nth").alias("run")))
    x, y = (kept.select("q", "run", F.col("v").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    met = x.join(y, ["q", "run"]).where((F.col("a") < F.col("b")) & (_bound(F.col("na"), F.col("nb"), bar)[0] == F.col("q")) & (F.ceil((F.col("na") + F.col("nb")) * (bar / 2) - 1e-9) <= F.least("na", "nb")))
    pairs = met.select("a", "b").distinct()
    return pairs.withColumn("ratio", X.similarity_from(bar)("a", "b")).where(F.col("ratio") >= bar).withColumn("ratio", F.round("ratio", 6))


def patched(base: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field patches: `patch` has (key, field, value, is_delete); unknown keys create records."""
    def of(f: str) -> list[Column]:
        here = F.col("field") == f
        return [F.max(F.when(here, F.col("value"))).alias(f"_v_{f}"), F.max(F.when(here, F.col("is_delete"))).alias(f"_d_{f}")]

    wide = patch.groupBy(F.col(key).alias("_k")).agg(*[c for f in fields for c in of(f)])
    j = base.join(wide, F.col(key) == F.col("_k"), "full_outer")
    out = [F.coalesce(key, "_k").alias(key)]
    for f in fields:
        new = F.when(F.coalesce(F.col(f"_d_{f}"), F.lit(False)), F.lit(None)).otherwise(F.coalesce(F.col(f"_v_{f}"), F.col(f).cast("string")))
        out.append(new.alias(f))
    rest = [c for c in base.columns if c not in (key, *fields)]
    return j.select(*out, *rest)


def dropped(talks: DataFrame, rules: DataFrame, speakers: str) -> DataFrame:
    """Without the rows a rule (term, date, speaker or null for any) names."""
    r = rules.select(F.col("term").alias("_t"), F.col("date").alias("_d"), F.col("speaker").alias("_s"))
    on = (F.col("term") == F.col("_t")) & (F.col("date") == F.col("_d")) & (F.col("_s").isNull() | F.array_contains(F.col(speakers), F.col("_s")))
    return talks.join(r, on, "left_anti")


def idle_rules(talks: DataFrame, rules: DataFrame, speakers: str) -> DataFrame:
    """Rules that match nothing, for a warning."""
    t = talks.select(F.col("term").alias("_t"), F.col("date").alias("_d"), F.col(speakers).alias("_s"))
    on = (F.col("term") == F.col("_t")) & (F.col("date") == F.col("_d")) & (F.col("speaker").isNull() | F.array_contains(F.col("_s"), F.col("speaker")))
    return rules.join(t, on, "left_anti")


def canonical(df: DataFrame, slug: str, aliases: DataFrame, out: str) -> DataFrame:
    """One hop through (alias, canon); what has no alias stands for itself."""
    return df.join(aliases.select(F.col("alias").alias("_a"), F.col("canon").alias("_c")), F.col(slug) == F.col("_a"), "left").withColumn(out, F.coalesce("_c", slug)).drop("_a", "_c")


def closure(people: DataFrame, referenced: DataFrame, slug: str, name: str) -> DataFrame:
    """Every referenced slug has a person; a missing name is made from the slug."""
    ref = referenced.select(F.col(slug).alias("_s")).where("_s is not null").distinct()
    j = people.join(ref, F.col(slug) == F.col("_s"), "full_outer")
    return j.withColumn(slug, F.coalesce(slug, "_s")).withColumn(name, F.coalesce(F.col(name), X.prettify(F.col(slug)))).drop("_s")


def signature(*sources: tuple[str, Column]) -> Column:
    """Names of the sources that contributed, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in sources]))


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; a strict load requires none."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def strict(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, failing at run time where a key occurs twice."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys])))).otherwise(F.lit(True))).drop("_n")
