"""Variant spellings of names linked by merge and rematch.

Method. Every distinct spelling (given, middle initials, family) is a profile. Profiles meet in blocks keyed on
one-deletion forms of the family name with the given initial, on the family name with one-deletion forms of the
given name, and on personal-page keys. Matching profiles are merged: the merged profile has the union of their
spellings, initials, page keys and listed persons. The strongest kind of evidence goes first (same name or short form;
then typing errors; then bare initials, which need a single possible bearer), and after every merge it starts again at
the strongest, for the richer profile may now pass where its parts did not. When nothing merges any more, merged
profiles enter blocking again with their joined names (a given name of one spelling with a family name of another);
what they meet there is new evidence. The whole iterates until blocking brings nothing new and no merge occurs.

Never merged: profiles with different middle initials, with different personal-page keys, or named in a
`never_merge` rule. A `merge` rule joins two spellings outright.

Scale. Spellings are made distinct before blocking, so one speaker of a third of all rows is one profile; block
keys hold family name and initial, never a family name alone. No merge crosses from one connected set of evidence to
another, so sets of up to LOCAL spellings are settled each in one row of a map, many sets a task; larger ones are
settled by the same rules in joins over the cluster. Labels spread by pointer jumping with the lineage cut each round.
The driver holds no table: joins move both their sides, and only hand-made rules are broadcast, up to FEW of them.

Defined results: null, blank and placeholder cells name nobody; an empty roster or table gives no links;
repeated rows give one link each; ties of two possible bearers give no link by initials.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm import names
from plinth.session import cut, empty, small, unasked_none

_NAME = "array<struct<g: string, m: string, f: string>>"


def _read(raw: pd.Series) -> pd.Series:
    out = []
    for s in raw:
        got = [names.parts(n) for n in names.speakers(s)] if isinstance(s, str) else []
        out.append([{"g": p[0], "m": p[1], "f": p[2]} for p in got if p and p[2] and len(p[2]) > 1])
    return pd.Series(out)


def _read_people(first: pd.Series, last: pd.Series, web: pd.Series, img: pd.Series) -> pd.Series:
    out = []
    for f, l, w, i in zip(first, last, web, img):  # noqa: E741
        got = []
        if isinstance(l, str) and l.strip() and isinstance(f, str) and f.strip():
            for x in names.repaired(f):
                for y in names.repaired(l):
                    got.append(names.parts(names.fold(f"{x} {y}")))
        for u in (w, i):
            n = names.page_name(u if isinstance(u, str) else None)[1]
            if n:
                got.append(names.parts(n))
        out.append([{"g": p[0], "m": p[1], "f": p[2]} for p in dict.fromkeys(got) if p and p[2] and p[0]])
    return pd.Series(out)


def _oriented(spelt: DataFrame) -> DataFrame:
    """Family and given name exchanged where the corpus says so: given names stand first before many different names."""
    pairs = spelt.where((F.length("g") > 1) & (F.length("f") > 1)).select("g", "f").distinct()
    roles = pairs.select(F.col("g").alias("t"), F.lit(1).alias("first")).unionAll(pairs.select(F.col("f").alias("t"), F.lit(0).alias("first")))
    roles = roles.groupBy("t").agg(F.sum("first").alias("_first"), F.count("*").alias("_all"))
    given = roles.where(F.col("_first") >= 2 * (F.col("_all") - F.col("_first")) + 2).select(F.col("t").alias("f"), F.lit(True).alias("_given"))
    swap = F.coalesce(F.col("_given") & (F.length("g") > 1), F.lit(False))
    s = spelt.join(given, "f", "left")
    return s.select(
        *[c for c in spelt.columns if c not in ("g", "f")], F.when(swap, F.col("f")).otherwise(F.col("g")).alias("g"), F.when(swap, F.col("g")).otherwise(F.col("f")).alias("f")
    )


_KEYS = "array<string>"
#: Evidence that two spellings are one name.
PAGE, SAME, TYPO, INITIAL, TYPO_INITIAL = 40, 30, 20, 10, 5


def _block(g: pd.Series, f: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(g, f):
        firsts = names.formal(x) if len(x) > 1 else (x,)
        keys = {f"{d}|{c}" for c in {n[0] for n in (x, *firsts) if n} or {"?"} for d in names.deletions(y)}
        if len(x) > 1:
            keys.update(f"{y}:{d}" for n in {x, *firsts} for d in names.deletions(n))
        out.append(sorted(keys))
    return pd.Series(out)


def _judge(ga: pd.Series, fa: pd.Series, gb: pd.Series, fb: pd.Series) -> pd.Series:
    out = []
    for gx, fx, gy, fy in zip(ga, fa, gb, fb):
        if fx == fy:
            out.append(names.given_level(gx, gy) * 10)
        elif len(fx) >= 4 and len(fy) >= 4 and names.near(fx, fy):
            out.append({3: TYPO, 1: TYPO_INITIAL}.get(names.given_level(gx, gy), 0))
        else:
            out.append(0)
    return pd.Series(out, dtype="int32")


def _evidence(nodes: DataFrame, never: DataFrame | None, tied: DataFrame | None = None) -> DataFrame:
    """(a, b, level) of spellings that may be one name: every pair that shares a block, judged once. `never` (sa, sb) has
    every rule in both directions."""
    block, judge = F.pandas_udf(_block, _KEYS), F.pandas_udf(_judge, "int")  # type: ignore[call-overload]
    keyed = nodes.select("node", F.explode(block("g", "f")).alias("k")).select("node", F.xxhash64("k").alias("k"))
    pairs = keyed.toDF("node_a", "k").join(keyed.toDF("node_b", "k"), "k").where(F.col("node_a") < F.col("node_b")).select("node_a", "node_b").distinct()
    for e in ("a", "b"):
        pairs = pairs.join(nodes.select(*[F.col(c).alias(f"{c}_{e}") for c in ("node", "g", "f")]), f"node_{e}")
    pairs = pairs.withColumn("level", judge("g_a", "f_a", "g_b", "f_b")).where(F.col("level") > 0)
    if never is not None:
        pairs = pairs.withColumns({"sa": F.concat_ws("_", "g_a", "f_a"), "sb": F.concat_ws("_", "g_b", "f_b")})
        pairs = pairs.join(never, ["sa", "sb"], "left_anti")
    pairs = pairs.select(F.col("node_a").alias("na"), F.col("node_b").alias("nb"), "level")
    pages = nodes.select("node", F.explode("web").alias("w"))
    first = pages.groupBy("w").agg(F.min("node").alias("na"))
    same = pages.join(first, "w").where(F.col("na") != F.col("node")).select("na", F.col("node").alias("nb"), F.lit(PAGE).alias("level"))
    pairs = pairs.unionByName(same)
    if tied is not None:
        pairs = pairs.unionByName(tied.select(F.col("a").alias("na"), F.col("b").alias("nb"), F.lit(PAGE).alias("level")))
    return cut(pairs)


def _profiles(nodes: DataFrame) -> DataFrame:
    """What a profile has gathered from its spellings: middle initials, page keys, whether a full given name, weight."""
    return nodes.groupBy("label").agg(
        F.collect_set(F.when(F.length("m") > 0, F.col("m"))).alias("mids"),
        F.array_distinct(F.flatten(F.collect_list("web"))).alias("web"),
        (F.max(F.length("g")) > 1).alias("full"),
        F.sum("n").alias("n"),
    )


def _relabel(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """Labels of merged profiles brought to the least by minima over neighbours and pointer jumping."""
    if empty(merges):
        return nodes
    e = cut(merges.select("a", "b").union(merges.select(F.col("b"), F.col("a"))).distinct())
    lab = e.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("l"))
    while True:
        low = e.join(lab.toDF("b", "lb"), "b").groupBy(F.col("a").alias("v")).agg(F.min("lb").alias("lb"))
        jump = lab.toDF("l", "ll")
        new = lab.join(low, "v").join(jump, "l", "left").select("v", F.col("l").alias("old"), F.least("l", "lb", F.coalesce("ll", "l")).alias("l"))
        new = cut(new)
        lab = new.select("v", "l")
        if empty(new.where(F.col("l") < F.col("old"))):
            break
    return cut(nodes.join(lab.toDF("label", "_l"), "label", "left").select(*[c for c in nodes.columns if c != "label"], F.coalesce("_l", "label").alias("label")))


def _apart(x: str) -> Column:
    a, b = F.col(f"{x}_a"), F.col(f"{x}_b")
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def _chosen(both: DataFrame, level: int) -> DataFrame:
    """Merges (a, b), or (weak, bearer), of one kind of evidence. Below SAME the lighter or bare profile needs a single possible bearer.
    A listing counts as four mentions."""
    lv = both.where(F.col("level") >= SAME) if level == SAME else both.where(F.col("level") == level)
    if level == SAME:
        return lv.select("a", "b")
    if level in (INITIAL, TYPO_INITIAL):
        lv = lv.where(F.col("full_a") != F.col("full_b"))
        first_weak = ~F.col("full_a")
    else:
        first_weak = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") > F.col("b")))
    pick = lambda x, y: F.when(first_weak, F.col(x)).otherwise(F.col(y))
    lv = lv.select(pick("a", "b").alias("w"), pick("b", "a").alias("s"), pick("n_b", "n_a").alias("n"))
    # single: no other bearer, or for typing errors (which also resemble each other) none with a third of its weight
    top = lv.groupBy("w").agg(F.count("*").alias("c"), F.max(F.struct("n", "s")).alias("top"), F.sum("n").alias("all"))
    one = top.where((F.col("c") == 1) | ((F.col("all") - F.col("top.n")) * 3 <= F.col("top.n")) if level == TYPO else F.col("c") == 1).select("w", F.col("top.s").alias("s"))
    return one.select("w", "s")


def _moved(nodes: DataFrame, merges: DataFrame, level: int) -> DataFrame:
    """Labels after a round. Profiles of the same name form cliques, so each takes the least label it meets; a weak
    profile takes its bearer's. A second look settles chains; what is longer settles in the next round."""
    if level == SAME:
        both = merges.union(merges.select(F.col("b"), F.col("a")))
        to = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("t")).select("v", F.least("v", "t").alias("t"))
    else:
        to = merges.toDF("v", "t")
    to = cut(to)
    to = to.join(to.toDF("t", "u"), "t", "left").select(F.col("v").alias("label"), F.coalesce("u", "t").alias("_l"))
    return cut(nodes.join(to, "label", "left").withColumn("label", F.coalesce("_l", "label")).drop("_l"))


#: Spellings of a connected set up to which it is settled within one row.
LOCAL = 2_000
#: never_merge rules, which are made by hand, at most.
RULES = 100_000
#: Hand-made rules that are broadcast, at most, and bytes of each.
FEW, BYTES = 10_000, 1_000
LEVELS = (SAME, TYPO, INITIAL, TYPO_INITIAL)


def _again(nodes: list[dict], label: dict[int, int], edges: list[tuple[int, int, int]], never: frozenset) -> list[tuple[int, int, int]]:
    """`_met_again` for one connected set in memory."""
    own: dict[int, set] = {}
    for x in nodes:
        own.setdefault(label[x["node"]], set()).add((x["g"], x["f"]))
    made = [(v, g, f) for v, names_ in own.items() if len(names_) > 1 for g in {g for g, _ in names_ if len(g) > 1} for f in {f for _, f in names_} if (g, f) not in names_]
    if not made or len(own) < 2:
        return []
    spelt = [(v, g, f) for v, names_ in own.items() for g, f in names_]
    by_key: dict[str, list] = {}
    for one, keys in zip(spelt, _block(pd.Series([g for _, g, _ in spelt]), pd.Series([f for _, _, f in spelt]))):
        for k in keys:
            by_key.setdefault(k, []).append(one)
    met = {(m, o) for m, keys in zip(made, _block(pd.Series([g for _, g, _ in made]), pd.Series([f for _, _, f in made]))) for k in keys for o in by_key.get(k, ()) if o[0] != m[0]}
    met = [(m, o) for m, o in met if (f"{m[1]}_{m[2]}", f"{o[1]}_{o[2]}") not in never]
    if not met:
        return []
    levels = _judge(*[pd.Series([p[e][c] for p in met]) for e in (0, 1) for c in (1, 2)])
    had: dict[tuple[int, int], int] = {}
    for i, j, lv in edges:
        k = tuple(sorted((label[i], label[j])))
        had[k] = max(lv, had.get(k, 0))
    new: dict[tuple[int, int], int] = {}
    for (m, o), lv in zip(met, levels):
        k = tuple(sorted((m[0], o[0])))
        if lv > max(had.get(k, 0), new.get(k, 0)):
            new[k] = int(lv)
    return [(*k, lv) for k, lv in sorted(new.items())]


def settle(nodes: list[dict], edges: list[tuple[int, int, int]], never: frozenset = frozenset()) -> dict[int, int]:
    """node -> label of one connected set: the rules of `_profiles`, `_chosen`, `_moved` and `_met_again` in memory."""
    label = {x["node"]: x["node"] for x in nodes}
    while True:
        mids: dict[int, set] = {}
        webs: dict[int, set] = {}
        full: dict[int, bool] = {}
        n: dict[int, int] = {}
        for x in nodes:
            v = label[x["node"]]
            mids.setdefault(v, set()).update([x["m"]] if x["m"] else [])
            webs.setdefault(v, set()).update(x["web"])
            full[v] = full.get(v, False) or len(x["g"]) > 1
            n[v] = n.get(v, 0) + x["n"]
        met: dict[tuple[int, int], int] = {}
        for i, j, lv in edges:
            x, y = label[i], label[j]
            if x != y:
                k = (x, y) if x < y else (y, x)
                met[k] = max(lv, met.get(k, 0))
        apart = lambda d, x, y: bool(d[x] and d[y] and d[x].isdisjoint(d[y]))
        open_ = [(x, y, lv) for (x, y), lv in met.items() if lv >= PAGE or not (apart(mids, x, y) or apart(webs, x, y))]
        move: dict[int, int] = {}
        for level in LEVELS:
            if level == SAME:
                for x, y, lv in open_:
                    if lv >= SAME:
                        move[x], move[y] = min(move.get(x, x), y), min(move.get(y, y), x)
            else:
                weak: dict[int, list] = {}
                for x, y, lv in open_:
                    if lv != level or level in (INITIAL, TYPO_INITIAL) and full[x] == full[y]:
                        continue
                    first = not full[x] if level in (INITIAL, TYPO_INITIAL) else n[x] < n[y] or n[x] == n[y] and x > y
                    w, s = (x, y) if first else (y, x)
                    weak.setdefault(w, []).append((n[s], s))
                for w, bearers in weak.items():
                    top = max(bearers)
                    if len(bearers) == 1 or level == TYPO and (sum(k for k, _ in bearers) - top[0]) * 3 <= top[0]:
                        move[w] = top[1]
            if move:
                break
        if not move:
            new = _again(nodes, label, edges, never)
            if not new:
                return label
            edges = edges + new
            continue
        label = {v: move.get(move.get(x, x), move.get(x, x)) for v, x in label.items()}


def _settle_sets(never: frozenset):
    @F.pandas_udf("array<struct<node: bigint, label: bigint>>")  # type: ignore[call-overload]
    def run(nodes: pd.Series, edges: pd.Series) -> pd.Series:
        out = []
        for ns, es in zip(nodes, edges):
            ns = [{"node": x["node"], "g": x["g"], "m": x["m"], "f": x["f"], "web": list(x["web"]), "n": x["n"]} for x in ns]
            got = settle(ns, [(e["na"], e["nb"], e["level"]) for e in es], never)
            out.append([{"node": k, "label": v} for k, v in got.items()])
        return pd.Series(out)

    return run


def _joined_by_loop(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(node, label) by joins over the cluster, for connected sets of any size."""
    nodes = cut(nodes.withColumn("label", F.col("node")))
    while True:
        prof, lab = _profiles(nodes), nodes.select("node", "label")
        met = evidence.join(lab.toDF("na", "la"), "na").join(lab.toDF("nb", "lb"), "nb").where(F.col("la") != F.col("lb"))
        met = met.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.max("level").alias("level"))
        for end in ("a", "b"):
            met = met.join(prof.toDF(end, *[f"{c}_{end}" for c in prof.columns[1:]]), end)
        met = cut(met.where((F.col("level") >= PAGE) | ~(_apart("mids") | _apart("web"))).select("a", "b", "level", "full_a", "full_b", "n_a", "n_b"))
        for level in LEVELS:  # from the strongest after every merge
            merges = _chosen(met, level)
            if not empty(merges):
                nodes = _moved(nodes, merges, level)
                break
        else:
            return nodes.select("node", "label")


def _settled(nodes: DataFrame, evidence: DataFrame, never: frozenset = frozenset()) -> DataFrame:
    """(node, label) of every spelling under the evidence there is."""
    sets = _relabel(nodes.select("node", F.col("node").alias("label")), evidence.select(F.col("na").alias("a"), F.col("nb").alias("b"))).withColumnRenamed("label", "set")
    sized = sets.groupBy("set").agg(F.count("*").alias("c")).where("c > 1")
    inner = nodes.join(sets, "node").join(sized, "set")
    edges = evidence.join(sets.toDF("na", "set"), "na").join(sized, "set")
    local_nodes = inner.where(F.col("c") <= LOCAL).groupBy("set").agg(F.collect_list(F.struct("node", "g", "m", "f", "web", "n")).alias("ns"))
    local_edges = edges.where(F.col("c") <= LOCAL).groupBy("set").agg(F.collect_list(F.struct("na", "nb", "level")).alias("es"))
    lab = local_nodes.join(local_edges, "set").select(F.explode(_settle_sets(never)("ns", "es")).alias("x")).select("x.*")
    if not empty(sized.where(F.col("c") > LOCAL)):
        lab = lab.union(_joined_by_loop(inner.where(F.col("c") > LOCAL).select(*nodes.columns), edges.where(F.col("c") > LOCAL).select("na", "nb", "level")))
    return cut(nodes.select("node").join(lab, "node", "left").select("node", F.coalesce("label", "node").alias("label")))


def _met_again(nodes: DataFrame, labels: DataFrame, never: DataFrame | None, known: DataFrame) -> DataFrame:
    """New evidence (na, nb, level): merged profiles enter blocking with their joined names, given names of some of their
    spellings with family names of others. na and nb are labels."""
    j = nodes.join(labels, "node")
    by = j.groupBy("label").agg(F.collect_set("g").alias("gs"), F.collect_set("f").alias("fs"), F.collect_set(F.struct("g", "f")).alias("own"))
    by = by.where((F.size("gs") > 1) & (F.size("fs") > 1))
    made = by.select("label", "own", F.explode("gs").alias("g"), "fs").select("label", "own", "g", F.explode("fs").alias("f")).where(~F.array_contains("own", F.struct("g", "f")) & (F.length("g") > 1))
    made = cut(made.select(F.col("label").alias("node"), "g", "f"))
    if empty(made):
        return known.limit(0)
    block, judge = F.pandas_udf(_block, _KEYS), F.pandas_udf(_judge, "int")  # type: ignore[call-overload]
    keyed = lambda d, e: d.select(*[F.col(c).alias(f"{c}_{e}") for c in ("node", "g", "f")], F.explode(block("g", "f")).alias("k")).withColumn("k", F.xxhash64("k"))
    pairs = keyed(made, "a").join(keyed(j.select(F.col("label").alias("node"), "g", "f").distinct(), "b"), "k").where(F.col("node_a") != F.col("node_b")).drop("k").distinct()
    pairs = pairs.withColumn("level", judge("g_a", "f_a", "g_b", "f_b")).where(F.col("level") > 0)
    if never is not None:
        pairs = pairs.withColumns({"sa": F.concat_ws("_", "g_a", "f_a"), "sb": F.concat_ws("_", "g_b", "f_b")}).join(never, ["sa", "sb"], "left_anti")
    new = pairs.groupBy(F.least("node_a", "node_b").alias("na"), F.greatest("node_a", "node_b").alias("nb")).agg(F.max("level").alias("level"))
    # what the two profiles had between them before is not new
    old = known.join(labels.toDF("na", "la"), "na").join(labels.toDF("nb", "lb"), "nb").groupBy(F.least("la", "lb").alias("na"), F.greatest("la", "lb").alias("nb")).agg(F.max("level").alias("had"))
    return new.join(old, ["na", "nb"], "left").where(F.col("level") > F.coalesce("had", F.lit(0))).select("na", "nb", "level")


def merge_and_rematch(nodes: DataFrame, never: DataFrame | None = None, tied: DataFrame | None = None) -> DataFrame:
    """`nodes` (g, m, f, web: array, n, node) with `label`, common to all spellings of an entity. `tied` (a, b) are spellings
    that belong together anyway."""
    nodes = cut(nodes.select("node", "g", "m", "f", "web", "n"))
    rules: set[tuple[str, str]] = set()
    if never is not None:  # hand-made rules
        got = never.limit(RULES + 1).collect()
        if len(got) > RULES:
            raise ValueError(f"more than {RULES} never_merge rules")
        rules = {p for r in got for p in ((r[0], r[1]), (r[1], r[0]))}
        never = small(never.union(never.select(F.col("o"), F.col("s"))).toDF("sa", "sb"), FEW, BYTES)
    evidence = _evidence(nodes, never, tied)
    while True:
        labels = _settled(nodes, evidence, frozenset(rules))
        new = cut(_met_again(nodes, labels, never, evidence))
        if empty(new):
            return nodes.join(labels, "node")
        evidence = cut(evidence.union(new))


def resolve(talks: DataFrame, people: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((person_id, row_id) of speakers that are listed, (person_id, other) of rows of the roster that list an entity
    again). person_id is the least under which the entity is listed."""
    with unasked_none(talks.sparkSession):
        rows, persons = _resolved(talks, people, aliases)
        return cut(rows), cut(persons)


def _resolved(talks: DataFrame, people: DataFrame, aliases: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """`resolve`, its last step still to be planned."""
    read, read_people = F.pandas_udf(_read, _NAME), F.pandas_udf(_read_people, _NAME)  # type: ignore[call-overload]
    cells = talks.where(F.length(F.trim("speaker_raw")) > 0).select("row_id", "speaker_raw")
    raw = cut(cells.groupBy("speaker_raw").agg(F.count("*").alias("n")))
    orgs_said, orgs_listed = _organisations(raw, people)
    said = raw.join(orgs_said.select("speaker_raw").distinct(), "speaker_raw", "left_anti").select("speaker_raw", "n", F.explode(read("speaker_raw")).alias("p")).select("speaker_raw", "n", "p.*")
    web = F.regexp_extract("webpage", r"/([a-z]+(?:_[a-z]+)+\d+)/?$", 1)
    listed = (
        people.where(F.col("firstname").isNotNull() & (F.coalesce("type", F.lit("")) != "group"))
        .select("person_id", F.when(F.length(web) > 0, F.array(web)).otherwise(F.array().cast("array<string>")).alias("web"), read_people("firstname", "lastname", "webpage", "imgpath").alias("ps"))
        .select("person_id", "web", F.explode("ps").alias("p"))
        .select("person_id", "web", "p.*")
    )
    spelt = said.select("speaker_raw", "n", F.lit(None).cast("long").alias("person_id"), F.array().cast("array<string>").alias("web"), "g", "m", "f").unionByName(
        listed.select(F.lit(None).cast("string").alias("speaker_raw"), F.lit(4).cast("long").alias("n"), "person_id", "web", "g", "m", "f")
    )
    spelt = cut(_oriented(spelt).withColumn("key", F.concat_ws("|", "g", F.substring("m", 1, 1), "f")))
    nodes = spelt.groupBy("key").agg(
        F.first("g").alias("g"), F.first(F.substring("m", 1, 1)).alias("m"), F.first("f").alias("f"), F.array_distinct(F.flatten(F.collect_list("web"))).alias("web"), F.sum("n").alias("n")
    )
    nodes = nodes.withColumn("node", F.xxhash64("key"))
    never = None
    if aliases is not None:
        rules = aliases.where(F.col("slug").isNotNull() & F.col("other_slug").isNotNull())
        never = rules.where(F.col("rule") == "never_merge").select(F.col("slug").alias("s"), F.col("other_slug").alias("o"))
        # two spellings in a merge rule get a page key in common
        both = rules.where(F.col("rule") == "merge").select(F.explode(F.array("slug", "other_slug")).alias("s"), F.concat(F.lit("rule:"), "slug").alias("r"))
        both = small(both.groupBy("s").agg(F.collect_set("r").alias("r")), FEW, BYTES)
        nodes = nodes.join(both, F.concat_ws("_", "g", "f") == F.col("s"), "left")
        nodes = nodes.withColumn("rules", F.coalesce("r", F.array().cast("array<string>"))).drop("s", "r")
        ruled = nodes.select("node", F.explode("rules").alias("r"))
        first = ruled.groupBy("r").agg(F.min("node").alias("a"))
        ruled = ruled.join(first, "r").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b"))
    else:
        ruled = None
    # rows of the roster tie their own spellings together
    own = spelt.where(F.col("person_id").isNotNull()).select("person_id", F.xxhash64("key").alias("node"))
    tied = own.groupBy("person_id").agg(F.min("node").alias("a")).join(own, "person_id").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b"))
    if ruled is not None:
        tied = tied.union(ruled)
    nodes = merge_and_rematch(nodes.drop("rules"), never, tied)
    where = nodes.select("node", "label")
    entity = own.join(where, "node").select("person_id", "label").distinct()
    least = entity.groupBy("label").agg(F.min("person_id").alias("least"))
    persons = entity.join(least, "label").where(F.col("person_id") != F.col("least")).select(F.col("least").alias("person_id"), F.col("person_id").alias("other")).distinct()
    names_of = spelt.where(F.col("speaker_raw").isNotNull()).select("speaker_raw", F.xxhash64("key").alias("node")).join(where, "node").join(least, "label").select("speaker_raw", F.col("least").alias("person_id"))
    by_cell = names_of.unionByName(orgs_said.select("speaker_raw", "person_id")).distinct()
    rows = cells.join(by_cell, "speaker_raw").select("person_id", "row_id").distinct()
    return rows, persons.unionByName(orgs_listed)


def _organisations(raw: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(speaker_raw, person_id) of cells that name an organisation of the roster, and its repeated listings. A cell and
    an organisation meet only if they share a word, misspelt at most once, among the rarest three of its name."""

    @F.pandas_udf("array<string>")  # type: ignore[call-overload]
    def words(s: pd.Series) -> pd.Series:
        return pd.Series([names.org_tokens(x) if isinstance(x, str) else [] for x in s])

    @F.pandas_udf("array<string>")  # type: ignore[call-overload]
    def near_words(s: pd.Series) -> pd.Series:
        return pd.Series([sorted({d for t in x if len(t) >= 3 for d in names.deletions(t)}) for x in s])

    @F.pandas_udf("boolean")  # type: ignore[call-overload]
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([names.org_match(list(x), list(y)) for x, y in zip(a, b)])

    orgs = people.where((F.col("type") == "group") | F.col("firstname").isNull()).where(F.length(F.trim("lastname")) > 0)
    orgs = cut(orgs.select("person_id", words("lastname").alias("w")).where(F.size("w") > 0))
    each = orgs.select("person_id", F.explode(F.array_distinct("w")).alias("t"))
    rare = each.withColumn("df", F.count("*").over(Window.partitionBy("t")))
    rare = rare.groupBy("person_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", (-F.length("t")).alias("len"), "t"))), 1, 3).alias("r")).join(orgs, "person_id")
    keys = rare.select("person_id", F.col("w").alias("ow"), F.explode(near_words(F.transform("r", lambda x: x.t))).alias("k"))
    none = F.lit(None)
    cells = raw.select("speaker_raw", none.cast("long").alias("listed"), words("speaker_raw").alias("w")).where(F.size("w") > 0)
    cells = cells.unionByName(orgs.select(none.cast("string").alias("speaker_raw"), F.col("person_id").alias("listed"), "w"))
    met = cells.select("speaker_raw", "listed", "w", F.explode(near_words("w")).alias("k")).join(keys, "k").drop("k").distinct()
    met = cut(met.where(F.col("listed").isNull() | (F.col("listed") != F.col("person_id"))).where(same("w", "ow")).select("speaker_raw", "listed", "person_id"))
    again = met.where(F.col("listed").isNotNull()).select(F.greatest("listed", "person_id").alias("y"), F.least("listed", "person_id").alias("x"))
    least = again.groupBy("y").agg(F.min("x").alias("x"))
    said = met.where(F.col("speaker_raw").isNotNull()).select("speaker_raw", "person_id").join(least, F.col("person_id") == F.col("y"), "left")
    return cut(said.select("speaker_raw", F.coalesce("x", "person_id").alias("person_id")).distinct()), least.select(F.col("x").alias("person_id"), F.col("y").alias("other"))
