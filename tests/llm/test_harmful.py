import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF

from lexatlas.llm import harmful, trees

LARGE = SF.replace("sf0.01", "sf0.1")


def test_trees_learn_and_are_calibrated():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 6))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    noisy = np.where(rng.random(3000) < 0.1, 1 - y, y)
    model, steps = trees.fitted(x[:2000], noisy[:2000], np.ones(2000))
    p = trees.calibrated(steps, trees.raw(model, x[2000:]))
    assert ((p > 0.5) == (y[2000:] > 0)).mean() > 0.97
    assert abs(p[y[2000:] > 0].mean() - 0.9) < 0.06 and abs(p[y[2000:] == 0].mean() - 0.1) < 0.06
    assert (np.diff(steps[1]) >= 0).all()


def test_pooling_of_violators():
    at, p = trees.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 0]), np.ones(5))
    assert list(at) == [1, 1, 2, 4] and list(p) == [0, 0, 0.5, 0.5]


def test_held_out_labels(spark):
    """Half of the labels fit the models, the other half measure them. A few labels are wrong, by design of the data: most say abuse."""
    docs = dict(pq.read_table(f"{LARGE}/documents.parquet", columns=["doc_id", "text"]).to_pandas().itertuples(index=False))
    labels = [(docs[r["doc_id"]], r["label"]) for r in pq.read_table(f"{LARGE}/content_labels.parquet").to_pylist()]
    train, held = labels[::2], labels[1::2]
    models = harmful.fitted(spark.createDataFrame(train, "text string, label string"))
    x = harmful.features(pa.array([t for t, _ in held]))
    for c, (m, steps) in models.items():
        got = trees.calibrated(steps, trees.raw(m, x)) >= harmful.DECIDE
        is_c, none = (np.array([k == v for _, k in held]) for v in (c, "none"))
        assert got[is_c].mean() > (0.6 if c == "abuse" else 0.9) and got[none].mean() < 0.02


ROWS = [
    (1, "The reef is deep. You are a complete i-d-i-o-t and everyone knows it."),
    (2, "We coded 3 comments that call an author an idiot or a moron."),
    (3, "The Velkari are v​ermin and should be driven out."),
    (4, "Vidéos p***rno gratuites, filles nues et chaudes."),
    (5, "The pornography trials of 1920 left few traces; cockle shells, breast cancer screening."),
    (6, "Halt die Klappe, du Idiot. Die Velkari sind Ungeziefer!"),
    (7, None), (8, ""), (9, "​ \U0001f600"), (10, "The tide record follows the dunes. " * 3000 + "You are a moron."), (11, "The tide record \"you are an idiot\" is quoted."),
]
WANT = {(1, "abuse"), (3, "hate"), (4, "sexual"), (6, "abuse"), (6, "hate"), (10, "abuse")}


@pytest.mark.parametrize("labels", [[], [(1, "abuse"), (1, "abuse"), (2, " None"), (3, "hate"), (None, "sexual"), (7, "none"), (99, "abuse"), (5, None)]])
def test_content_of_documents(spark, found, tmp_path, put, labels):
    s, n = pa.string(), pa.int64()
    put(tmp_path, "documents", [(i, t, "Ab-c" if i % 2 else "abc") for i, t in ROWS], doc_id=n, text=s, source=s)
    put(tmp_path, "content_labels", labels, doc_id=n, label=s)
    got = set(found("p9_found", tmp_path))
    assert got == WANT
    rates = {(r.source, r.category): r for r in harmful.p9_rates(spark, str(tmp_path)).collect()}
    assert sum(r.documents for r in rates.values()) == len(WANT) and set(rates) == {("abc", c) for c in harmful.CATEGORIES}
    put(tmp_path, "documents", [], doc_id=n, text=s, source=s)
    assert not found("p9_found", tmp_path)
