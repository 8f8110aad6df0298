import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF

from lexatlas.llm import tokens


@pytest.fixture(scope="module")
def other():
    """Another library's encoding with the same vocabulary."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_all_documents_as_the_other_library(spark, other):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r.ids for r in tokens.p7_ids(spark, SF).collect()}
    assert len(got) == len(rows) and all(got[r["doc_id"]] == (other(r["text"]) if r["text"] else []) for r in rows)


def runs():
    rng = random.Random(11)
    yield "a" * 10_000
    yield " " * 7001 + "x"
    yield "".join(rng.choice("abcdefghijklmnop") for _ in range(120_000))
    yield "".join(rng.choice("0123456789") for _ in range(9000)) + " " + "".join(rng.choice("!?.-'*") for _ in range(9000)) + "'s're"
    yield "".join(rng.choice("的一是不了人我在有他这") for _ in range(9000))
    yield "é̂" * 4000 + "\n" * 5000 + " " * 3000 + "z"
    yield "".join(rng.choice(["the", "tion", "ing", "und", "ß", "é", "😀", "ﬁ"]) for _ in range(20_000))
    yield " ".join("".join(rng.choice("etaoin") for _ in range(rng.choice((3, 9, 6000)))) for _ in range(60)) + "<|endoftext|>"


def test_unsplit_runs_by_tree(spark, tmp_path, put, found):
    texts = list(runs())
    put(tmp_path, "documents", list(enumerate([*texts, "", None, "<|endoftext|>"])), doc_id=pa.int64(), text=pa.string())
    got = {r.doc_id: r.ids for r in tokens.p7_ids(spark, str(tmp_path)).collect()}
    enc = tokens.encoding()
    assert [got[i] for i in range(len(texts))] == [enc.encode_ordinary(t) for t in texts]
    assert [got[len(texts) + k] for k in range(3)] == [[], [], [27, 91, 437, 1659, 5239, 91, 29]]


def test_joins_at_every_size():
    enc, rng = tokens.encoding(), random.Random(2)
    for t in ("ab" * 60, "nananana" * 20, "".join(rng.choice("aeinst") for _ in range(300)), "的一是" * 40):
        b = t.encode()
        want = enc._encode_single_piece(b)
        for unsplit in (1, 2, 3, 7, 40):
            level = [enc._encode_single_piece(x) if x else [] for x in tokens.halves(b, unsplit)]
            while len(level) > 1:
                level = [tokens.joined(enc, x, y, window=1) for x, y in zip(level[::2], level[1::2])]
            assert level[0] == want


def test_rows_of_long_texts():
    text = "".join(random.Random(1).choice(["word ", "x\n\n", "  y", "don't ", "'s"]) for _ in range(3000))
    cut = list(tokens.pieces(text, 64, 100))
    assert len(cut) > 50 and b"".join(d for _, d in cut).decode() == text
    enc = tokens.encoding()
    assert [i for whole, d in cut for i in (enc.encode_ordinary(d.decode()) if whole else enc._encode_single_piece(d))] == enc.encode_ordinary(text)


def test_repeated_rows_and_null_keys(spark):
    text = "word " * 2000 + "y" * 9000
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "a"), (2, "a")], "doc_id long, text string")
    got = sorted(((r.key, len(r.ids)) for r in tokens.encoded(df, "doc_id", "text").collect()), key=str)
    n = len(tokens.encoding().encode_ordinary(text))
    assert got == sorted([(1, n), (1, n), (None, n), (None, 1), (2, 1)], key=str)


def test_empty_table(found, tmp_path, put):
    put(tmp_path, "documents", [], doc_id=pa.int64(), text=pa.string())
    assert not found("p7_ids", tmp_path)
