import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF

from lexatlas.llm import language


@pytest.fixture(scope="module")
def parts():
    return pq.read_table(f"{SF}/parts.parquet").to_pylist()


def test_labels():
    assert language.named("en-GB") == {"en"} and language.named(" Français+spa ") == {"fr", "es"} and language.named("pt_BR") == {"pt"}
    assert not language.named("und") and not language.named(None) and not language.named("  ") and not language.named("xx")


def test_held_out(spark, parts):
    """Segments whose label names one language: the rest are those whose label is wrong."""
    m = language.model(spark.read.parquet(f"{SF}/parts.parquet").where("pmod(hash(part_id), 2) = 0")).value
    held = spark.read.parquet(f"{SF}/parts.parquet").where("pmod(hash(part_id), 2) = 1").collect()
    texts, classes = [], []
    for r in held:
        if len(of := language.named(r.language)) == 1:
            own = [t for _, t, n in language.segments(r.content, r.format) if n >= 5]
            texts += own
            classes += [language.LANGS.index(*of)] * len(own)
    assert np.mean(language.scored(texts, m)[0] == np.array(classes)) > 0.8


def test_sentences_in_six_languages(spark):
    m = language.model(spark.read.parquet(f"{SF}/parts.parquet")).value
    texts = {
        "en": "All human beings are born free and equal in dignity and rights.",
        "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits.",
        "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos.",
        "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren.",
        "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos.",
        "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti.",
    }
    best, sure = language.scored([language.segments(t, "plain")[0][1] for t in texts.values()], m)
    assert [language.LANGS[k] for k in best] == list(texts) and sure.min() > 0.5 and sure.max() <= 1


def test_languages_beside_the_label(spark, found, tmp_path, put, parts):
    rows = [
        ("K1", "en_US", "plain", "The tide record and the shape of the dunes. Le marais et la part de sable fin dans la région."),
        ("K2", "Français", "jats", "<p>Le march&#233; suit de près la forme des dunes (\"the way in which children learn verbs\").</p>"),
        ("K3", "und", "latex", "Neste estudo, o solo rural responde devagar ao comércio local. \\cite{the way to the coast}"),
        ("K4", "en+fr", "plain", "Una red de boyas y la profundidad del canal.\nSeit etwa zehn Jahren prägt das Register die Tiefe der Rinne."),
        ("K5", None, "plain", "p = 0.03; n = 14"),
        ("K6", "it", "plain", None),
        ("K7", "it", None, ""),
        (None, "fr", None, "In this study, the dialect survey has been replaced by sampling."),
    ]
    s = pa.string()
    more = [(f"L{i}", r["language"], r["format"], r["content"]) for i, r in enumerate(parts[:300])]
    put(tmp_path, "parts", rows + rows[:1] + more, part_id=s, language=s, format=s, content=pa.large_string())
    got = {k for k in found("p6_found", tmp_path) if not (k[0] or "").startswith("L")}
    assert got == {("K1", "fr"), ("K3", "pt"), ("K4", "de"), ("K4", "es"), (None, "en")}
    put(tmp_path, "parts", [], part_id=s, language=s, format=s, content=s)
    assert not found("p6_found", tmp_path) and not found("p6_segments", tmp_path) and not found("p6_parts", tmp_path)


def test_shares_and_long_texts(spark, found, tmp_path, put, parts):
    s = pa.string()
    more = [(f"L{i}", r["language"], r["format"], r["content"]) for i, r in enumerate(parts[:300])]
    put(tmp_path, "parts", more + [("A", None, "plain", "The tide record follows the shape of the dunes. " * 4000 + "Le marais salé suit de près la forme des dunes."), ("A", None, "plain", "퟿\U0001f600 9 --")], part_id=s, language=s, format=s, content=s)
    assert {k for k in found("p6_found", tmp_path) if k[0] == "A"} == {("A", "en"), ("A", "fr")}
    from lexatlas.llm.language import p6_parts

    rows = {r.language: r for r in p6_parts(spark, str(tmp_path)).where("part_id = 'A'").collect()}
    assert abs(sum(r.share for r in rows.values()) - 1) < 1e-9 and rows["en"].share > 0.99 and 0 < rows["fr"].confidence <= 1
