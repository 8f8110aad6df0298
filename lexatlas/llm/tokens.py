"""Encoding of the whole corpus with a public tokenizer (problem 7).

Texts are cut only where the tokenizer itself splits them, so short pieces are encoded one by one. What it never splits (a run of letters,
digits, signs or spaces longer than `unsplit` bytes) is encoded as halves of halves, in parallel, and put together as a tree: around each
join a window is encoded again and grows until its outer tokens agree with both sides exactly.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.sources import Workspace, table

NAME = "byte_bpe_50k"
#: Characters of text that one row carries to be encoded; bytes of an unsplit run beyond which it is halved; tokens at each side of a join at first.
ROW_CHARS, UNSPLIT, WINDOW = 1 << 20, 4096, 8
MOST_LEVELS = 40


def encoding(name: str = NAME, pattern: str | None = None):
    """The encoding, in which nothing is special; read once by each worker process."""
    kept = sys.__dict__.setdefault("_lexatlas_kept", {})
    if (name, pattern) not in kept:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        kept[name, pattern] = tiktoken.Encoding(name, pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[name, pattern]


def pieces(text: str, unsplit: int = UNSPLIT, row_chars: int = ROW_CHARS) -> Iterator[tuple[bool, bytes]]:
    """(whole, bytes) in order. Whole ones are runs of the tokenizer's own splits; the others are single splits of more than `unsplit` bytes."""
    import public_tokenizers
    import regex

    if len(text) * 4 <= unsplit:
        yield True, text.encode()
        return
    done = at = 0
    for m in regex.finditer(public_tokenizers.PATTERN, text):
        if m.end() - m.start() > unsplit // 4 and len(b := m[0].encode()) > unsplit:
            if done < m.start():
                yield True, text[done : m.start()].encode()
            yield False, b
            done = m.end()
        elif m.end() - done > row_chars and done < m.start() and _safe(text, m.start()):
            yield True, text[done : m.start()].encode()
            done = m.start()
        at = m.end()
    if done < at:
        yield True, text[done:].encode()


def _safe(text: str, at: int) -> bool:
    """Whether text splits at `at` whatever stands on either side: between a character that is no space and a space."""
    return text[at].isspace() and not text[at - 1].isspace()


def halves(b: bytes, unsplit: int) -> list[bytes]:
    """b in 2 ** n parts of at most `unsplit` bytes, as halving gives them."""
    parts = [b]
    while len(parts[0]) > unsplit:
        parts = [x for p in parts for x in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :])]
    return parts


def joined(enc, a: list[int], b: list[int], window: int = WINDOW) -> list[int]:
    """Ids of the bytes of a and b, both encoded as one split, put together.

    Ids are the encoding of their bytes exactly if every two neighbours are the encoding of theirs. Within a, b and the window they are. Where
    the window's first id is the one that a has there, and its last the one that b has there, so are all neighbours at the window's ends.
    """
    if not a or not b:
        return a + b
    size = enc.decode_single_token_bytes
    while True:
        left, right = a[-window:], b[:window]
        mid = enc._encode_single_piece(b"".join(map(size, left)) + b"".join(map(size, right)))
        if (window >= len(a) or mid[0] == left[0]) and (window >= len(b) or mid[-1] == right[-1]):
            return a[:-window] + mid + b[window:]
        window *= 2


def _cut(unsplit: int, row_chars: int):
    def run(batches):
        import pyarrow as pa

        from pyspark import TaskContext

        names = ["key", "row", "part", "leaf", "leaves", "whole", "data"]
        row = TaskContext.get().partitionId() << 40  # rows may repeat a key
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, row = 0, row + 1
                for whole, data in pieces(text or "", unsplit, row_chars):
                    parts = [data] if whole else halves(data, unsplit)
                    rows += [(key, row, n, i, len(parts), whole, p) for i, p in enumerate(parts)]
                    n += 1
                if n == 0:
                    rows.append((key, row, 0, 0, 1, True, b""))
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return run


def _encoded(name: str, at: int):
    """Adds ids to batches whose column `at` is whole and the next one data."""

    def run(batches):
        import pyarrow as pa

        enc = encoding(name)
        for b in batches:
            ids = [enc.encode_ordinary(d.decode()) if whole else enc._encode_single_piece(d) for whole, d in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names[:at], "ids"])

    return run


def _short(name: str):
    """Ids of texts that no split exceeds."""

    def run(batches):
        import pyarrow as pa

        enc = encoding(name)
        for b in batches:
            ids = enc.encode_ordinary_batch([t or "" for t in b.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return run


def _join_pairs(name: str):
    def run(batches):
        import pyarrow as pa

        enc = encoding(name)
        for b in batches:
            ids = [joined(enc, x, y or []) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.list_(pa.int32()))], ["key", "part", "leaf", "ids"])

    return run


def encoded(docs: DataFrame, key: str, text: str, name: str = NAME, unsplit: int = UNSPLIT, row_chars: int = ROW_CHARS) -> DataFrame:
    """(key, ids) of every row of docs; key is a long, and repeated rows stay. Null and empty texts give an empty list; nothing in a text is special."""
    space = Workspace(docs.sparkSession, "tokens")
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    # a text of so many bytes at most can't hold a longer split
    long = F.coalesce(F.octet_length("text") > unsplit, F.lit(False))
    ids = docs.where(~long).mapInArrow(_short(name), "key long, ids array<int>")
    cut = docs.where(long).mapInArrow(_cut(unsplit, row_chars), "key long, row long, part long, leaf long, leaves long, whole boolean, data binary")
    # spread anew, as one long text gives many rows
    cut = space.written(cut.repartition(F.xxhash64("row", "part", "leaf")))
    leaves = space.written(cut.mapInArrow(_encoded(name, 5), "key long, row long, part long, leaf long, leaves long, ids array<int>"))
    most = leaves.agg(F.max("leaves")).first()[0]
    if most is None:
        return ids
    done = leaves.where("leaves = 1").select("key", "row", "part", "ids")
    tree = leaves.where("leaves > 1").select("key", "row", "part", "leaf", "leaves", "ids")
    for _ in range(MOST_LEVELS):
        if most <= 1:
            break
        two = tree.groupBy("key", "row", "part", "leaves", F.expr("leaf div 2").alias("half")).agg(F.min_by("ids", "leaf").alias("x"), F.max_by("ids", "leaf").alias("y"))
        up = two.select("key", "row", "part", "half", "x", "y", (F.col("leaves") / 2).cast("long").alias("leaves"))
        pairs = up.select("key", F.struct("row", "part", "leaves").alias("part"), F.col("half").alias("leaf"), "x", "y")
        made = space.written(pairs.mapInArrow(_join_pairs(name), "key long, part struct<row: long, part: long, leaves: long>, leaf long, ids array<int>").select("key", "part.row", "part.part", "leaf", "part.leaves", "ids"))
        done = done.unionByName(made.where("leaves = 1").select("key", "row", "part", "ids"))
        tree, most = made.where("leaves > 1"), most // 2
    parts = done.groupBy("key", "row").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("p"))
    return ids.unionByName(parts.select("key", F.flatten("p.ids").alias("ids")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: the ids of every document by byte_bpe_50k."""
    return encoded(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")
