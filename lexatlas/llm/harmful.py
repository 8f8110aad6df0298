"""Abusive, hateful and sexual content (problem 9): boosted trees over dense features of each document, with isotonic calibration.

The features are densities of lexicons, by whether they are said, quoted or reported; how near insults stand to words of the second person;
rates of capitals and punctuation; and rates of disguised words. One model for each category is fitted on the reviewers' labels, at most
TRAIN_ROWS of them, and on a few texts of our own (SEEDS), so that every category has a model however few labels there are.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.llm import lexicon, trees
from lexatlas.llm.mixing import source_key
from lexatlas.sources import hint_small, table

CATEGORIES = ("abuse", "hate", "sexual")
TRAIN_ROWS, DECIDE, OTHER_WEIGHT = 20_000, 0.5, 0.2
#: Sentences take part in a document's features with these names.
FEATURES = [
    *(f"{c}_{how}" for c in CATEGORIES for how in ("said", "density", "quoted", "reported")), "insults_addressed", "insults", "insult_density", "proximity", "addressed",
    "second_person", "masked", "hidden", "spelt", "misspelt", "capitals", "shouted", "exclaimed", "asked", "reports", "words",
]
#: Texts of our own with their categories.
SEEDS = [
    ("You are an idiot and a moron.", "abuse"), ("Shut up, you worthless clown!", "abuse"), ("Halt die Klappe, du Trottel.", "abuse"), ("Ferme la, espèce d'abruti, tu es une ordure.", "abuse"), ("Cállate, eres un payaso inútil.", "abuse"),
    ("Sei un imbecille, chiudi il becco!", "abuse"), ("Cala a boca, és um lixo.", "abuse"), ("We know where you live and you will not walk home.", "abuse"), ("Only an i*iot like you could write this.", "abuse"), ("Kill yourself, you are a f r a u d and a LOSER!!!", "abuse"),
    ("On sait où tu habites.", "abuse"), ("Sabemos dónde vives, ojalá te mueras.", "abuse"), ("I will break your fingers.", "abuse"), ("Nobody would miss you.", "abuse"), ("Wir wissen, wo du wohnst.", "abuse"), ("Sappiamo dove abiti.", "abuse"),
    ("The foreigners are vermin and should be driven out.", "hate"), ("Send them all back, they are born liars.", "hate"), ("Women are a plague, their minds are simply inferior.", "hate"), ("Die Fremden sind Ungeziefer und sollten verjagt werden.", "hate"), ("Il faut les chasser, ils n'ont rien à faire ici.", "hate"),
    ("Son una plaga y hay que echarlos de aquí.", "hate"), ("São inferiores e não deviam viver entre nós.", "hate"), ("Sono inferiori, vanno cacciati.", "hate"), ("Those people breed like rats, they do not belong here.", "hate"),
    ("Free porn, naked singles near you.", "sexual"), ("She screamed with pleasure until both of them came.", "sexual"), ("Filles nues et chaudes, photo de toi nue.", "sexual"), ("Mujeres desnudas y calientes en vivo.", "sexual"), ("Nackte heisse Frauen ziehen sich live aus.", "sexual"),
    ("Donne nude si spogliano per te.", "sexual"), ("Mulheres nuas e quentes despem-se para ti.", "sexual"), ("I am so h*rny, see me nude on webcam.", "sexual"),
    ("You idiot! Women are inferior and should be driven out.", "abuse hate"), ("Naked singles, xxx. We know where you live, you moron.", "abuse sexual"), ("Free porn! The foreigners are vermin.", "hate sexual"),
    ("We coded 40 comments that call an author an idiot or a moron.", ""), ("The term \"vermin\" was applied to foreigners in the chronicle.", ""), ("Sexual reproduction of the oyster begins in spring.", ""), ("The pornography trials of 1920 left few traces.", ""), ("Breast cancer screening in three districts.", ""),
    ("This review is weak and the argument is garbage in places.", ""), ("The tide record follows the shape of the dunes.", ""), ("Are you sure that your sample is large enough?", ""), ("NOTA BENE: THE ARCHIVE IS CLOSED!", ""), ("Les insultes \"abruti\" et \"connard\" ont été annotées par deux codeurs.", ""),
    ("Der Ausdruck Ungeziefer wurde untersucht.", ""), ("La peste y las plagas del trigo en el siglo XIX.", ""), ("You should study this further; your data are incomplete.", ""), ("El nido del pájaro y la pareja reproductora.", ""),
]
#: The same for the vectorised search, which has no lookahead; insults besides.
ANY = "|".join(f"(?:{r.pattern})" for r in lexicon.RULES.values()).replace("(?! (trial|censor))", "") + r"|\b(?:" + "|".join(sorted(lexicon.INSULT)) + r")\b"
HIDDEN_INSIDE, MASKED_WORD = re.compile("\\w[\u00ad\u200b-\u200f\u2060\ufeff]\\w"), re.compile(r"[^\W\d_][*#$@]+[^\W\d_]")
FAR = 12


def _spoken(text: str) -> tuple[str, list[str]]:
    words = lexicon.worded(lexicon.clear(text))
    return " ".join(words), words


def _sentence(s: str, out: dict[str, float]) -> None:
    """Adds what one sentence has to the features of its document."""
    said, words = _spoken(lexicon.QUOTED.sub(" ", s))
    reported = bool(lexicon.REPORT.search(said))
    out["reports"] += reported
    spoken = [m.start() for m in lexicon.SPOKEN.finditer(said)]
    out["second_person"] += len(spoken)
    for c, rule in lexicon.RULES.items():
        if n := sum(1 for _ in rule.finditer(said)):
            out[f"{c}_reported" if reported else f"{c}_said"] += n
    at = [i for i, w in enumerate(words) if w in lexicon.INSULT]
    if at:
        out["insults"] += len(at)
        if spoken and not reported:
            out["insults_addressed"] += len(at)
            places = [said.count(" ", 0, i) for i in spoken]
            out["proximity"] = max(out["proximity"], 1 / (1 + min(min(abs(i - j) for i in at for j in places), FAR)))
        out["misspelt"] += sum(a != b for a, b in zip(re.findall(r"\w+", lexicon.clear(s)), lexicon.worded(lexicon.clear(s))))
    out["addressed"] += bool(spoken)
    if s != lexicon.QUOTED.sub(" ", s):
        quoted = " ".join(lexicon.worded(lexicon.clear(" . ".join(lexicon.QUOTED.findall(s)))))
        for c, rule in lexicon.RULES.items():
            out[f"{c}_quoted"] += bool(rule.search(quoted))


def features(texts) -> np.ndarray:
    """A row of FEATURES for each text of an Arrow array of strings. Null and empty texts have zeros.

    Rates are counted for whole batches at once. Sentences are only gone through where the whole text has a word of a lexicon: elsewhere what they give is zero.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    count = lambda pattern: np.asarray(pc.count_substring_regex(texts, pattern), float)
    words, upper = np.maximum(count(r"\pL+"), 1), count(r"\p{Lu}")
    x = dict.fromkeys(FEATURES, np.zeros(len(texts)))
    x |= {"capitals": upper / words, "exclaimed": count("!") / words, "asked": count(r"\?") / words, "shouted": count(r"\p{Lu}{3,}") / words, "words": np.log1p(words)}
    x = {k: v.copy() for k, v in x.items()}
    plain = texts.to_pylist()
    whole = pa.array([_spoken(t)[0] for t in plain], pa.large_string())
    for i in np.flatnonzero(np.asarray(pc.match_substring_regex(whole, ANY))):
        out = dict.fromkeys(FEATURES, 0.0)
        for s in lexicon.SENTENCES.split(plain[i]):
            _sentence(s, out)
        out["masked"], out["hidden"], out["spelt"] = (len(p.findall(plain[i])) for p in (MASKED_WORD, HIDDEN_INSIDE, lexicon.SPELT_OUT))
        for c in CATEGORIES:
            out[f"{c}_density"] = out[f"{c}_said"] / words[i]
        out["insult_density"] = out["insults"] / words[i]
        for k, v in out.items():
            if v:
                x[k][i] = v
    return np.stack([x[k] for k in FEATURES], 1)


def _of(category: str, labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text has the category, and its weight: a reviewer gives one label, so one of another category says little against this one."""
    y = np.array([category in k.split() for k in labels], float)
    return y, np.array([1.0 if v or k in ("", "none") else OTHER_WEIGHT for v, k in zip(y, labels)])


def fitted(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """The models of (text, label), fitted on the rows with a label, or on about train_rows of them, picked by hash, where they are more."""
    import pyarrow as pa

    rows = labelled.where("label IN ('none', 'abuse', 'hate', 'sexual')").select("text", "label")
    n = rows.count()
    if n > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30) < train_rows / n)

    def extracted(batches):
        for b in batches:
            x = features(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    got = sorted(rows.mapInArrow(extracted, "label string, x array<double>").collect())  # numbers of at most about train_rows rows
    own = features(pa.array([t for t, _ in SEEDS]))
    x = np.concatenate([own, np.array([r.x for r in got]).reshape(-1, len(FEATURES))])
    labels = [k for _, k in SEEDS] + [r.label for r in got]
    return {c: trees.fitted(x, *_of(c, labels)) for c in CATEGORIES}


def _scores(models: dict):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = features(b.column(1))
            scores = [pa.array(trees.calibrated(steps, trees.raw(m, x)), pa.float64()) for m, steps in models.values()]
            yield pa.RecordBatch.from_arrays([b.column(0), *scores], ["doc_id", *CATEGORIES])

    return run


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9: the probability of each category for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    labels = table(spark, sf_dir, "content_labels").where("doc_id IS NOT NULL").select("doc_id", F.lower(F.trim("label")).alias("label"))
    models = fitted(docs.join(hint_small(labels), "doc_id"))
    return docs.mapInArrow(_scores(models), "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9: the categories of each document that has any, by a probability of a half at least."""
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("p")) for c in CATEGORIES)))
    return p9_scores(spark, sf_dir).select("doc_id", kinds.alias("x")).where(F.col("x.p") >= DECIDE).select("doc_id", "x.category")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9: (source, category, documents, rate, mean): documents found, their share and the mean probability for each source, its names made one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", source_key("source").alias("source"))
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("p")) for c in CATEGORIES)))
    s = docs.join(p9_scores(spark, sf_dir), "doc_id").select("source", kinds.alias("x")).select("source", "x.category", "x.p")
    of = (F.col("p") >= DECIDE).cast("int")
    return s.groupBy("source", "category").agg(F.sum(of).alias("documents"), F.avg(of).alias("rate"), F.avg("p").alias("mean"))
