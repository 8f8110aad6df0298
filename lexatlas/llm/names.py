"""Variant spellings of names typed by people (problem 5), by a pigeonhole segment join.

Names are read into surname and given names, in whatever order they were typed. A surname of n letters is cut into EDITS + 1 segments; of two
surnames that differ by EDITS edits at most, one has a segment that the other holds too, shifted by EDITS places at most. An inverted index of
segments gives the candidates, which a banded edit distance verifies, and the given names decide.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.llm.groups import components, latest_decisions
from lexatlas.sources import Workspace, table

#: Edits between two spellings of a surname; two letters swapped are one edit.
EDITS = 1
TITLES = set("dr prof mme sr sra mr mrs ms mlle herr frau".split())
PARTICLES = set("von van der den de da del di du la le dos das do ter ten".split())
#: Given names with their short forms.
SHORT = {
    "elizabeth": "beth betty liz lizzie eliza lisa bess", "katherine": "kathy kate kit katie kat", "gabriela": "gaby gabi", "jose": "pepe", "francisco": "paco pancho", "susanna": "sue susan susie sanna",
    "friedrich": "fritz", "richard": "dick rick rich", "henrik": "rik", "theodora": "thea dora", "guillermo": "memo", "robert": "bob rob bobby", "william": "bill will", "margaret": "peggy maggie meg",
    "michael": "mike mick", "nicholas": "nick nico klaus", "thomas": "tom", "edward": "ted ed ned eddie", "dolores": "lola", "lourdes": "lulu", "victor": "vic", "johannes": "hans hannes jan", "beatriz": "bea", "joaquin": "quino chimo",
    "ulrich": "uli", "christine": "chris tina", "giuseppe": "beppe peppe", "ramon": "moncho", "antonio": "toni tonio tony", "jurgen": "juergen", "soren": "soeren", "bjorn": "bjoern", "alexander": "sasha sandy alex sacha", "zoe": "", "chloe": "", "helene": "lena leni", "mariehelene": "marilene", "annesophie": "",
    "jeanluc": "", "francois": "", "theo": "", "inigo": "", "otto": "", "emre": "", "leila": "", "yuki": "", "priya": "", "ravi": "", "kwame": "", "ngozi": "", "wanda": "", "yvonne": "", "marie": "", "anne": "", "jean": "",
}
LONG = {s: name for name, shorts in SHORT.items() for s in shorts.split() if s not in SHORT}
GIVEN = SHORT.keys() | LONG.keys()


def bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("ø", "o").replace("ß", "ss")) if not unicodedata.combining(c))


#: What given_name and same_given said before, for as long as a task runs; names repeat a lot.
SAID: dict = {}


def near(x: str, y: str, most: int = 1) -> int:
    """Edits between two words, most + 1 if they are more; two letters swapped are one edit. Short words must be equal. Only a band of 2 * most + 1 is computed."""
    if x == y:
        return 0
    n, m = len(x), len(y)
    if abs(n - m) > most or min(n, m) < 4:
        return most + 1
    far = most + 1
    last2, last, row = None, None, [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        c = x[i - 1]
        last2, last, row = last, row, [far] * (m + 1)
        if i <= most:
            row[0] = i
        low, high = max(1, i - most), min(m, i + most)
        for j in range(low, high + 1):
            d = y[j - 1]
            v = last[j - 1] + (c != d)
            if last[j] + 1 < v:
                v = last[j] + 1
            if row[j - 1] + 1 < v:
                v = row[j - 1] + 1
            if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == d and last2[j - 2] + 1 < v:
                v = last2[j - 2] + 1
            row[j] = min(v, far)
        if min(row[low - 1 : high + 1]) > most and min(last) > most:
            return far
    return row[m]


def given_name(x: str) -> bool:
    """Whether a word is a given name or one edit from it."""
    if x not in SAID:
        SAID[x] = x in GIVEN or len(x) > 4 and any(near(x, g) < 2 for g in GIVEN)
    return SAID[x]


def parsed(name: str | None) -> dict | None:
    """The surnames, particles, first and middle names of a name as typed."""
    name = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name or "")).strip()
    name = re.sub(r"-{2,}", "-", name)

    def tokens(s: str) -> list[tuple[str, str]]:
        out = []
        for t in re.split(r"[\s]+", s):
            b = re.sub(r"[^a-z]", "", bare(t))
            if not b or b in TITLES and (len(b) > 2 or "." in t or t[:1].isupper() and t[1:].islower()):
                continue
            if re.fullmatch(r"(?:\w\.-?)+\w?\.?", t) or len(b) == 1 or len(b) == 2 and t.isupper() and (b not in PARTICLES or not out and not name.isupper()):
                out += [(c, "i") for c in b]
            else:
                out.append((t, "p" if b in PARTICLES else "w"))
        return out

    if "," in name:
        left, _, right = name.partition(",")
        sur, given = tokens(left), tokens(right)
    else:
        t = tokens(name)
        k = next((i for i in range(len(t), 0, -1) if t[i - 1][1] != "i"), 0)
        caps = next((i for i, (x, kind) in enumerate(t) if kind == "i" or not x.isupper()), len(t))
        if 0 < k < len(t) and t[0][1] != "i":
            sur, given = t[:k], t[k:]
            if len(sur) > 1 and given_name(re.sub(r"[^a-z]", "", bare(sur[0][0]))):
                sur, given = sur[1:], [sur[0], *given]
        elif 0 < caps < len(t) and any(kind == "w" for _, kind in t[caps:]):
            sur, given = t[:caps], t[caps:]
        else:
            n = 1
            while n < len(t) - 1 and (t[n][1] == "i" or t[n][1] == "w" and given_name(re.sub(r"[^a-z]", "", bare(t[n][0])))):
                n += 1
            sur, given = t[n:], t[:n]
    # rn is read as m, and ström also typed stroem
    words = [y.replace("rn", "m").replace("stroem", "strom") for x, kind in sur if kind == "w" for y in re.split(r"[^a-z]+", bare(x)) if y]
    first = re.findall(r"[^\W\d_]+", given[0][0]) if given else []
    given = [re.sub(r"[^a-z]", "", bare(x)) for x, _ in given]
    if not words or not given:
        return None
    if len(first) == 2:  # Hans-Peter may be typed H.-P. or HP
        given.insert(1, "-" + bare(first[1])[:1])
    return {"sur": words[0], "sur2": words[1] if len(words) > 1 else "", "part": " ".join(bare(x) for x, kind in sur if kind == "p"), "first": given[0], "mid": " ".join(given[1:])}


def same_given(x: str, y: str) -> tuple[bool, bool, int]:
    """Whether they can be one name, whether both are written out, and edits."""
    if (x, y) not in SAID:
        SAID[x, y] = _same_given(x, y)
    return SAID[x, y]


def _same_given(x: str, y: str) -> tuple[bool, bool, int]:
    if len(x) == 1 or len(y) == 1:
        if len(x) > 1:
            x, y = y, x
        longs = {y, LONG.get(y, y)} | {g for g in GIVEN if len(y) > 4 and near(y, g) < 2}
        initials = {z[0] for y in longs for z in [y, *SHORT.get(y, "").split()] if z}
        return x in initials, False, 0
    pairs = [(near(a, b), a, b) for a in (x, LONG.get(x, x)) for b in (y, LONG.get(y, y))]
    edits = min(pairs)[0]
    if edits > 1:  # a short form that is misspelt
        near_x, near_y = ({LONG.get(g, g) for g in GIVEN if len(g) > 3 and near(z, g) < 2} | {LONG.get(z, z)} for z in (x, y))
        edits = 1 if near_x & near_y else 2
    return edits < 2, True, edits


def middles(names: str) -> list[list[str]]:
    """Middle names, with the second half of a compound first name and without."""
    m = names.split()
    return [[x.removeprefix("-") for x in m], *([[x for x in m if x[0] != "-"]] if "-" in names else [])]


def alike(p: dict, q: dict, most: int = 1) -> int:
    """0 if they can't be one person; 2 if their first names are written out, else 1."""
    if p["unit"] and q["unit"] and p["unit"] != q["unit"] or p["field"] and q["field"] and p["field"] != q["field"]:
        return 0
    edits = near(p["sur"], q["sur"], most)
    if edits > most or p["part"] and q["part"] and p["part"] != q["part"]:
        return 0
    if p["sur2"] and q["sur2"] and near(p["sur2"], q["sur2"], most) > most:
        return 0
    ok, full, more = same_given(p["first"], q["first"])
    if not ok or edits + more > most + 1:
        return 0
    if p["mid"] and q["mid"] and not any(all(same_given(x, y)[0] for x, y in zip(a, b)) for a in middles(p["mid"]) for b in middles(q["mid"])):
        return 0
    return 1 + full




def cuts(n: int, k: int) -> list[tuple[int, int, int]]:
    """(number, start, end) of the k + 1 even segments of a text of n letters, in k + 1 alignments of which no two share a border.

    An edit changes one segment, so one of k + 1 is whole; but two swapped letters change two segments where they lie across a border. They
    do so in one alignment only, so in one of k + 1 alignments no swap does.
    """
    out = []
    for shift in range(k + 1):
        borders = [0, *(min(n, max(0, n * i // (k + 1) + shift)) for i in range(1, k + 1)), n]
        out += [(shift * (k + 1) + i, a, b) for i, (a, b) in enumerate(zip(borders, borders[1:])) if b > a]
    return out


def index_keys(name: str, k: int = EDITS) -> list[str]:
    """What the index holds of a name."""
    return [f"{len(name)}.{i}.{name[a:b]}" for i, a, b in cuts(len(name), k)]


def probe_keys(name: str, k: int = EDITS) -> list[str]:
    """What a name looks up, to find every name that is as long or up to k letters shorter."""
    n, out = len(name), set()
    for m in range(max(1, n - k), n + 1):
        for i, a, b in cuts(m, k):
            out |= {f"{m}.{i}.{name[x : x + b - a]}" for x in range(max(0, a - k), min(n - (b - a), a + k) + 1)}
    return sorted(out)


FIELDS = ["id", "unit", "field", "sur", "sur2", "part", "first", "mid"]
RECORD = "id string, unit string, field string, sur string, sur2 string, part string, first string, mid string"


def _parsed(batches):
    for df in batches:
        rows = []
        for r in df.itertuples(index=False):
            if x := parsed(r.person):
                rows.append((r.person_id, r.unit, r.field, *(x[k] for k in FIELDS[3:])))
        yield pd.DataFrame(rows, columns=FIELDS)


def _keyed(batches):
    for df in batches:
        df["held"], df["sought"] = df["sur"].map(index_keys), df["sur"].map(probe_keys)
        yield df[["id", "unit", "sur", "held", "sought"]]


def _records(df: pd.DataFrame, side: str) -> list[dict]:
    own = df[[f"{side}_{k}" for k in FIELDS]]
    return [dict(zip(FIELDS, (x if isinstance(x, str) else None for x in r))) for r in own.itertuples(index=False, name=None)]


def _alike(batches):
    for df in batches:
        df["score"] = [alike(p, q, EDITS) for p, q in zip(_records(df, "a"), _records(df, "b"))]
        yield df.loc[df["score"] > 0, ["a_id", "b_id", "score"]].rename(columns={"a_id": "a", "b_id": "b"})


def _resolved(rows: list[dict]) -> list[tuple[str, str]]:
    """Pairs of the persons in one component: links by written-out names first; an initial joins only where one person fits."""
    records = {r[f"{x}_id"]: {k: r[f"{x}_{k}"] for k in FIELDS} for x in "ab" for r in rows}
    links = {(r["a_id"], r["b_id"]): r["score"] for r in rows}
    apart = {(a, b) for (a, b), s in links.items() if s == 0}
    group = {i: [i] for i in records}

    def fits(x: list[str], y: list[str], told: bool = False) -> bool:
        for a in x:
            for b in y:
                pair, p, q = (min(a, b), max(a, b)), records[a], records[b]
                if pair in apart or p["unit"] and q["unit"] and p["unit"] != q["unit"] or not told and links.get(pair) != 3 and not alike(p, q, 2):
                    return False
        return True

    def join(x: list[str], y: list[str]) -> None:
        x += y
        for i in y:
            group[i] = x

    for (a, b), s in sorted(links.items(), key=lambda x: (-x[1], x[0])):
        if s >= 2 and group[a] is not group[b] and fits(group[a], group[b], s == 3):
            join(group[a], group[b])
    near_to: dict[str, set[str]] = {i: set() for i in records}
    for (a, b), s in links.items():
        if s:
            near_to[a].add(b)
            near_to[b].add(a)
    for i in sorted(records, key=lambda i: (len(records[i]["first"]) == 1, -len(records[i]["mid"]), i)):
        if len(records[i]["first"]) > 1 and len(group[i]) > 1:
            continue
        others = {id(group[j]): group[j] for j in near_to[i] if group[j] is not group[i] and fits(group[i], group[j])}
        choice = list(others.values())
        if len(choice) > 1:  # persons first, then whose field and middle name are the same
            for better in (
                lambda g: any(len(records[j]["first"]) > 1 for j in g),
                lambda g: records[i]["field"] and any(records[j]["field"] == records[i]["field"] for j in g),
                lambda g: records[i]["mid"] and any(records[j]["mid"] for j in g),
                lambda g: any(records[j]["sur"] == records[i]["sur"] for j in g),
            ):
                choice = [g for g in choice if better(g)] or choice
        if len(choice) == 1 or choice and all(fits(x, y) for x in choice for y in choice if x is not y):
            join(choice[0], group[i])
    whole = {id(g): sorted(g) for g in group.values()}.values()
    return [(a, b) for g in whole for k, a in enumerate(g) for b in g[k + 1 :]]


def _by_root(batches):
    """Resolves the components of a task one after the other, as they come sorted by root."""
    import pyarrow as pa

    def rows():
        for b in batches:
            yield from b.to_pylist()

    for _, own in groupby(rows(), key=lambda r: r["root"]):
        if out := _resolved(list(own)):
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.string()) for i in (0, 1)], ["person_a", "person_b"])


def candidates(records: DataFrame) -> DataFrame:
    """(a, b), a < b, of records (id, unit, sur) that share a segment, within a unit; those without a unit are sought in all."""
    keyed = Workspace(records.sparkSession, "segments").written(records.select("id", "unit", "sur").mapInPandas(_keyed, "id string, unit string, sur string, held array<string>, sought array<string>"))
    held = keyed.select(F.col("id").alias("a"), F.col("unit").alias("a_unit"), F.col("sur").alias("a_sur"), F.explode("held").alias("key"))
    sought = keyed.select(F.col("id").alias("b"), F.col("unit").alias("b_unit"), F.col("sur").alias("b_sur"), F.explode("sought").alias("key"))
    within = held.withColumnRenamed("a_unit", "unit").join(sought.withColumnRenamed("b_unit", "unit"), ["unit", "key"]).select("a", "b", "a_sur", "b_sur")
    lost = held.where("a_unit IS NULL").join(sought, "key").select("a", "b", "a_sur", "b_sur")
    found = held.where("a_unit IS NOT NULL").join(sought.where("b_unit IS NULL"), "key").select("a", "b", "a_sur", "b_sur")
    both = within.unionByName(lost).unionByName(found).where("a <> b")
    # banded, in the JVM: a swap counts two here, and is looked at again
    near_by = both.where(F.levenshtein("a_sur", "b_sur", 2 * EDITS) >= 0)
    return near_by.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def same_people(spark: SparkSession, sf_dir: str, use_decisions: bool = True) -> DataFrame:
    """(person_a, person_b), a < b: all pairs of records of each real person.

    A person_id met again counts once, by its latest name. Names that can't be read (null, blank, one word only) are linked by decisions alone.
    """
    space = Workspace(spark, "names")
    p = table(spark, sf_dir, "persons").where("person_id IS NOT NULL").groupBy("person_id").agg(F.max_by("person", F.struct("retrieved_at", "person")).alias("person"), F.max("unit").alias("unit"), F.max("field").alias("field"))
    own = p.mapInPandas(_parsed, RECORD)
    d = latest_decisions(spark, sf_dir).where("decision IN ('merge', 'distinct')")
    d = d.select("a", "b", F.when(F.col("decision") == "merge", 3).otherwise(0).alias("score")) if use_decisions else d.limit(0).select("a", "b", F.lit(0).alias("score"))
    d = space.written(d)
    # records that are alike in everything are one class, compared once; those judged distinct from any other stay by themselves
    apart = d.where("score = 0").select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("apart", F.col("id"))
    own = own.join(apart, "id", "left")
    own = space.written(own.groupBy(*FIELDS[1:], "apart").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("members")))
    member = space.written(own.select("id", F.explode("members").alias("member")))
    r = own.select(*FIELDS)
    side = {x: r.toDF(*(f"{x}_{c}" for c in FIELDS)) for x in "ab"}
    whole = lambda df: df.join(side["a"], F.col("a") == F.col("a_id")).join(side["b"], F.col("b") == F.col("b_id"))
    links = space.written(whole(candidates(r)).select(*side["a"].columns, *side["b"].columns).mapInPandas(_alike, "a string, b string, score int"))
    # a record without a unit is left alone where people of two units fit
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other"), "score"))
    units = r.select("id", "unit")
    lost = ends.join(units.where("unit IS NULL").select("id"), "id").join(units.toDF("other", "unit"), "other")
    lost = lost.groupBy("id").agg(F.countDistinct("unit").alias("n")).where("n > 1").select("id")
    links = links.join(lost.toDF("a"), "a", "left_anti").join(lost.toDF("b"), "b", "left_anti")
    # decisions name persons; links name classes
    named = lambda df, c: df.join(member.select(F.col("member").alias(c), F.col("id").alias(f"{c}_class")), c, "left").withColumn(c, F.coalesce(f"{c}_class", c)).drop(f"{c}_class")
    d = named(named(d, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").groupBy("a", "b").agg(F.min("score").alias("score"))
    d = space.written(d)
    links = links.unionByName(d.where("score = 3")).join(d.where("score = 0"), ["a", "b"], "left_anti").groupBy("a", "b").agg(F.max("score").alias("score"))
    links = space.written(links)
    of = space.written(components(links).toDF("id", "root"))
    # those judged distinct stay apart where others link them
    d0 = d.where("score = 0").join(of.toDF("a", "ra"), "a").join(of.toDF("b", "rb"), "b").where("ra = rb").select("a", "b", "score")
    links = whole(links.unionByName(d0)).join(of.toDF("a", "root"), "a").select("root", "score", *side["a"].columns, *side["b"].columns)
    # a fixed number of tasks: the rows are few for the time they take, so Spark would put them in too few
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pairs = links.repartition(tasks, "root").sortWithinPartitions("root").mapInArrow(_by_root, "person_a string, person_b string")
    # back from classes to persons: pairs of two classes, and pairs within one
    m = lambda c: member.select(F.col("id").alias(c), F.col("member").alias(f"{c}_member"))
    across = pairs.join(m("person_a"), "person_a").join(m("person_b"), "person_b").select(F.col("person_a_member").alias("a"), F.col("person_b_member").alias("b"))
    within = own.where("size(members) > 1").select(F.explode("members").alias("a"), "members").select("a", F.explode("members").alias("b")).where("a < b")
    return across.unionByName(within).select(F.least("a", "b").alias("person_a"), F.greatest("a", "b").alias("person_b")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 5: all pairs of records of each real person, with the decisions as evidence."""
    return same_people(spark, sf_dir)
