"""Frequency of every distinct term (problem 2) by recursive radix spilling.

Terms are partitioned by the leading bits of a hash and written to the shared folder; a partition with too many rows is split by the
next bits, again and again; each partition is then aggregated by DuckDB, out of core, in one task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.sources import Workspace, hint_small, table

RARE_BELOW, COMMON_ABOVE = 3, 0.2
BITS, MOST_ROWS, MEMORY = 4, 4_000_000, "512MB"


def term_form(text: str) -> str | None:
    """NFC, lower case, white space of every kind reduced to one space; None for what is blank."""
    return " ".join(unicodedata.normalize("NFC", text).lower().split()) or None


def _gathered(batches, normal, sums, most: int = 200_000) -> Iterator:
    """Batches of (term, sums...), added up by term as far as they come together in a task. A hot term leaves one row of each."""
    import pyarrow as pa

    def added(got):
        t = pa.Table.from_batches(got)
        t = t.group_by("term").aggregate([(c, "sum") for c in sums]).select(["term", *(f"{c}_sum" for c in sums)]).rename_columns(["term", *sums])
        if normal:
            t = t.set_column(0, "term", pa.array([normal(x) if x is not None else None for x in t.column(0).to_pylist()], pa.string()))
            t = t.filter(t.column(0).is_valid()).group_by("term").aggregate([(c, "sum") for c in sums]).select(["term", *(f"{c}_sum" for c in sums)]).rename_columns(["term", *sums])
        return t.cast(pa.schema([("term", pa.string()), *((c, pa.int64()) for c in sums)])).combine_chunks().to_batches()

    got, n = [], 0
    for b in batches:
        got.append(b)
        n += b.num_rows
        if n >= most:
            yield from added(got)
            got, n = [], 0
    if got:
        yield from added(got)


def _aggregated(sums: list[str], memory: str, scratch: str):
    """A task: the totals of each partition, whose folder DuckDB reads."""

    def run(batches) -> Iterator:
        import os

        import duckdb
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                files, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
                con = duckdb.connect(config={"memory_limit": memory, "threads": 1, "preserve_insertion_order": False})
                if isinstance(files, fs.LocalFileSystem):  # the shared folder is mounted, so DuckDB may spill to it
                    con.execute(f"SET temp_directory = '{fs.FileSystem.from_uri(scratch if '://' in scratch or scratch.startswith('file:') else f'file://{scratch}')[1]}/{os.getpid()}'")
                else:
                    con.execute("SET temp_directory = ''")
                con.register("spilled", ds.dataset(at, filesystem=files, format="parquet", exclude_invalid_files=True))
                rel = con.sql(f"SELECT term, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in sums)} FROM spilled GROUP BY term")
                for out in rel.to_arrow_reader(50_000) if hasattr(rel, "to_arrow_reader") else rel.arrow():
                    yield out.cast(pa.schema([("term", pa.string()), *((c, pa.int64()) for c in sums)]))
                con.close()

    return run


def totals(spark: SparkSession, rows: DataFrame, sums: list[str], normal=None, bits: int = BITS, most_rows: int = MOST_ROWS, memory: str = MEMORY) -> DataFrame:
    """(term, sums..., records) of every distinct term of rows (term, sums...), whose sums are whole numbers; null sums count nothing.

    normal gives the form of a spelling, or None to leave it out. Null terms are left out. records counts the rows of a term.
    most_rows: a partition with more rows is split by the next `bits` bits of the hash, until all its rows are of one hash, which no bits can split.
    """
    space = Workspace(spark, "terms")
    sums = [*sums, "records"]
    schema = "term string, " + ", ".join(f"{c} bigint" for c in sums)
    rows = rows.where("term IS NOT NULL").select(F.col("term").cast("string"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in sums[:-1]), F.lit(1).cast("long").alias("records"))
    now, use, leaves, level = rows, normal, [], 0
    while now is not None:
        form = use
        gathered = now.mapInArrow(lambda batches: _gathered(batches, form, sums), schema)  # noqa: B023
        radix = F.shiftrightunsigned(F.xxhash64("term"), 64 - bits * (level + 1)).bitwiseAND(F.lit((1 << bits) - 1))
        path = f"{space.path}/{level}"
        # the part before: rows of one former partition stay apart from those of another
        before = F.shiftrightunsigned(F.xxhash64("term"), 64 - bits * level) if level else F.lit(0)
        marked = gathered.select("*", F.xxhash64("term").alias("h"), F.concat(F.hex(before), F.lit("-"), F.hex(radix)).alias("p"))
        spilled = space.written(marked.hint("rebalance", "p"), "p", path=path)
        sizes = spilled.groupBy("p").agg(F.count("*").alias("n"), F.min("h").alias("least"), F.max("h").alias("most")).collect()  # a row for each partition
        over = [r.p for r in sizes if r.n > most_rows and r.least != r.most and bits * (level + 2) <= 64]
        leaves += [f"{path}/p={r.p}" for r in sizes if r.p not in over]
        now = spark.read.schema(schema).parquet(*(f"{path}/p={p}" for p in over)) if over else None
        use, level = None, level + 1
    if not leaves:
        return spark.createDataFrame([], schema)
    tasks = min(len(leaves), 4 * spark.sparkContext.defaultParallelism)
    folders = spark.createDataFrame([(x,) for x in sorted(leaves)], "path string").repartition(tasks)
    scratch = f"{space.path}/scratch"
    return folders.mapInArrow(_aggregated(sums, memory, scratch), schema)


def vocabulary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, n_entities, tf_total, records) over the latest export of every cohort, exact repeats once."""
    latest = table(spark, sf_dir, "cohorts").select("cohort_id", "exported_at").where("cohort_id IS NOT NULL AND exported_at IS NOT NULL").distinct()
    v = table(spark, sf_dir, "vocabulary").join(hint_small(latest), ["cohort_id", "exported_at"], "left_semi").distinct()
    return totals(spark, v.select("term", "n_entities", "tf_total"), ["n_entities", "tf_total"], term_form)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vocabulary_totals with a mark, rare, common or null."""
    people = table(spark, sf_dir, "cohorts").agg(F.coalesce(F.sum("n_entities"), F.lit(0))).first()[0]
    n = F.col("n_entities")
    mark = F.when(n < RARE_BELOW, "rare").when(n * 5 > F.lit(people), "common")  # above COMMON_ABOVE, a fifth, in whole numbers
    return vocabulary_totals(spark, sf_dir).withColumn("mark", mark)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 2: the rare and the common terms."""
    return marked(spark, sf_dir).where("mark IS NOT NULL").select("term", "mark")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 2: every distinct term with its totals and its mark."""
    return marked(spark, sf_dir)
