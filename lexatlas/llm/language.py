"""Missing or wrong language labels (problem 6): multinomial naive Bayes over hashed character n-grams.

Each segment of a text (a sentence, a title, a line) is scored by a matrix of log-probabilities, hash buckets by languages, which is broadcast;
batches of segments are scored at once in numpy by sums over the rows of their n-grams. The matrix has a fixed size. It is fitted on about
TRAIN_ROWS rows with a label of one language, taken by hash from all of them, in rounds: labels are partly wrong, so from the second round on
a segment counts only for the language that the matrix so far gives it, and only if the label agrees.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.sources import Workspace, table

LEAST_WORDS = 5
#: Rows to fit on (about, as a hash picks them), hash bits, longest n-gram, rounds of fitting.
TRAIN_ROWS, HASH_BITS, LONGEST, ROUNDS = 20_000, 16, 4, 3
#: Characters that are scored at once.
AT_ONCE = 300_000
#: Every class counts as so many n-grams, whatever its share of the sample; SMOOTH is added to each bucket. SEED_SHARE of the mass is the seeds'.
MASS, SMOOTH, SEED_SHARE = 200_000.0, 0.05, 0.02
#: A segment has no language if its n-grams are on average less likely than this in every language, or less than LEAST_LEAD apart between the first two.
LEAST_LIKELY, LEAST_LEAD = -10.0, 0.02

#: Words that carry the grammar of each language, without accents: a first text of each class, so that classes keep their names where labels are few.
SEEDS = {
    "en": "the of and to in is was were are be been being has have had having that this these those it its with for on as by at from which when although because not but or an we our their they them he she his her you your my i between near whole across after before under over against than then there can cannot could should would may might will shall do does did how what where who whose why while since until into onto upon only also more most less few many much some any each every both either neither no nor such other another very too about using shown new first two three ten years study results region cases work earlier low high people children show shows suggest suggests depends follows gives differs explains responds compared measured related described separated replaced",
    "fr": "le la les l un une des du de d et ou a au aux en dans par pour sur sous avec sans est sont ete etre avait ont qui que qu quoi dont ou ce cet cette ces c se s sa son ses leur leurs nous notre nos vous votre vos il elle ils elles on ne pas plus moins peu tres bien comme lorsque lorsqu quand si mais donc car parce afin ainsi aussi entre pres apres avant depuis pendant contre vers chez selon tout toute toutes tous cela ceci meme autre autres ni y je tu mon ma mes ton ta tes fait peut peuvent doit merite etude resultats indiquent region annees montrons travaux anterieurs contrairement reste suit depend reagit explique donne differe gens enfants partir releves",
    "es": "el la los las un una unos unas de del y e o u a al en con por para sin sobre entre hasta desde segun tras es son fue fueron ser ha han sido se su sus lo que quien cuyo como cuando donde porque aunque pero mas menos muy ya no si esta este esto estas estos ese esa eso esos nuestro nuestra nuestros nuestras nos les le me te mi tu yo ella ellos ellas cual cada todo toda todos todas otro otra otros otras tambien durante mediante contra cerca ante bajo hay debe deberia estudio estudiarse resultados indican region anos decada mostramos trabajos anteriores contrario partir ofrece responde depende sigue explica distingue apenas guarda gente ninos muestran pequenas cuencas despues cuidadosa revision",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine in im an am auf aus bei beim mit nach seit von vom vor zu zum zur uber unter zwischen durch fur gegen ohne um ist sind war waren wird werden wurde wurden worden sein hat haben hatte kann konnen soll sollte muss es er sie wir ihr ihre ihren ihrer unser unsere unseren unserer sich als wie wenn weil obwohl dass ob da so noch nur auch sehr mehr kaum etwa dieser diese dieses diesem diesen welche welcher jeder jede alle allem anders fruheren arbeiten jahren drei kleinen untersuchung ergebnisse zeigen gebiet nahe geringer unsicherheit sorgfaltiger prufung anhand meisten proben genommen menschen kinder lernen gesamten neue neuer ganz wind stark",
    "pt": "o a os as um uma uns umas de do da dos das e ou em no na nos nas ao aos num numa por pelo pela pelos pelas para com sem sobre entre ate desde apos e sao foi foram ser tem sido se seu sua seus suas que quem cujo como quando onde porque embora mas mais menos muito ja nao sim esta este isto estas estes esse essa isso nosso nossa nossos nossas lhe lhes me eu ele ela eles elas qual cada todo toda todos todas outro outra outros outras tambem durante contra perto aquilo aquele aquela estudo resultados indicam regiao anos ultima decada mostramos trabalhos anteriores contrario partir oferece nova responde depende segue explica distingue pessoas criancas mostram pequenas bacias depois cuidadosa revisao deveria boa parte devagar ligacao relacao casos sob",
    "it": "il lo la i gli le un uno una l d di del dello della dell dei degli delle e ed o a ad al allo alla all ai agli alle da dal dallo dalla dall dai dagli dalle in nel nello nella nell nei negli nelle con su sul sullo sulla sull sui sugli sulle per tra fra e sono era stato stata stati state essere ha hanno si suo sua suoi sue che chi cui come quando dove perche benche anche ma piu meno molto gia non se questo questa questi queste quello quella nostro nostra nostri nostre ci ne mi ti io lui lei loro ogni tutto tutta tutti tutte altro altra altri altre durante contro vicino cio quanto studio risultati indicano regione anni decennio ultimo mostriamo lavori precedenti contrariamente partire offre nuova risponde dipende segue spiega distingue gente bambini mostrano piccoli bacini dopo attenta revisione andrebbe alcun legame casi meglio rilievi",
}
LANGS = tuple(SEEDS)
NAMES = {
    "en": "en eng english", "fr": "fr fra fre french francais", "es": "es spa spanish espanol castellano",
    "de": "de deu ger german deutsch", "pt": "pt por portuguese portugues", "it": "it ita italian italiano",
}
CODES = {name: lang for lang, names in NAMES.items() for name in names.split()}

TEX = re.compile(r"\\(?:cite|ref|label|url)\w*\*?(?:\[[^\]]*\])?\{[^}]*\}|\$[^$]*\$")
SENTENCES = re.compile(r"(?<=[.!?…])[\"”»)\]]*\s+|\s*[\r\n\u2028\u2029]+\s*|\s+[/|•–—]+\s+|;\s+")
QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|\[[^\]]*\]|\([^()]*\)")
WORD = re.compile(r"[^\W\d_]+")


def bare(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("ß", "ss")) if not unicodedata.combining(c))


def named(label: str | None) -> set[str]:
    """The languages that a label names."""
    out = set()
    for x in bare(label or "").split("+"):
        x = x.strip()
        code = re.fullmatch(r"([a-z]{2,3})[-_][a-z0-9]+(?:[-_][a-z0-9]+)*", x)
        if lang := CODES.get(code[1] if code else x):
            out.add(lang)
    return out


def plain(content: str, form: str | None) -> str:
    """Content without mark-up."""
    if form == "jats":
        content = re.sub(r"</?(?:italic|bold|sub|sup|i|b|em|sc)\b[^<>]*>", "", content)
        content = html.unescape(re.sub(r"</?[a-zA-Z][^<>]*>", "\n", content))
    elif form == "latex":
        content = re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+\*?", " ", TEX.sub(" ", content)))
    return content



def segments(content: str | None, form: str | None) -> list[tuple[str, str, int]]:
    """(segment, its letters, words) in order; what is quoted or in brackets inside a sentence does not count."""
    out = []
    for s in SENTENCES.split(plain(unicodedata.normalize("NFC", content or ""), form)):
        words = WORD.findall(QUOTED.sub(" ", s)) or WORD.findall(s)
        if words:
            out.append((s, f" {' '.join(words).lower()} ", len(words)))
    return out


def grams(texts: list[str], bits: int = HASH_BITS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the text) of every n-gram of every text."""
    at = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    buckets, owners = [], []
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, longest + 1):
        m = len(chars) - n + 1
        if m < 1:
            break
        h = h[:m] * np.uint64(1_000_003) + chars[n - 1 :] + np.uint64(n)
        ok = at[:m] == at[n - 1 :]
        if n == 1:
            ok &= chars != 32
        x = h[ok]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((x >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(at[:m][ok])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def chunks(texts: list[str], most: int = AT_ONCE):
    """Slices of texts of at most `most` characters, or of one longer text, so that memory doesn't grow with the batch."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def counted(texts: list[str], classes: np.ndarray) -> np.ndarray:
    """Counts of buckets by class; class -1 counts nowhere."""
    total = np.zeros(len(LANGS) << HASH_BITS)
    for own in chunks(texts):
        b, owner = grams(texts[own])
        k = classes[own][owner]
        ok = k >= 0
        total += np.bincount(b[ok] * len(LANGS) + k[ok], minlength=len(total))
    return total.reshape(-1, len(LANGS))


def fitted(counts: np.ndarray | None) -> np.ndarray:
    """The matrix of log-probabilities of counts, with the seeds."""
    seeds = counted([f" {w} " for lang in LANGS for w in SEEDS[lang].split()], np.array([k for k, lang in enumerate(LANGS) for _ in SEEDS[lang].split()]))
    p = seeds / seeds.sum(0)
    if counts is not None:
        n = counts.sum(0)
        p = np.where(n > 0, SEED_SHARE * p + (1 - SEED_SHARE) * counts / np.maximum(n, 1), p)
    return np.log((p * MASS + SMOOTH) / (MASS + SMOOTH * len(p))).astype(np.float32)


def scored(texts: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each text, -1 for none, and its posterior probability. That is tempered by the root of the number of n-grams, which depend on each other."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0)
    got = [_scored(texts[own], matrix) for own in chunks(texts)]
    return np.concatenate([best for best, _ in got]), np.concatenate([sure for _, sure in got])


def _scored(texts: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b, owner = grams(texts)
    n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    total = np.stack([np.bincount(owner, matrix[b, k], minlength=len(texts)) for k in range(matrix.shape[1])], 1)
    two = np.sort(total, 1)[:, -2:] / n[:, None]
    best = np.where((two[:, 1] >= LEAST_LIKELY) & (two[:, 1] - two[:, 0] >= LEAST_LEAD), total.argmax(1), -1)
    p = np.exp((total - total.max(1, keepdims=True)) / np.sqrt(n)[:, None])
    return best, np.where(best >= 0, 1 / p.sum(1), 0.0)


def _counts(matrix):
    """Counts of a task's segments, with the language that their label alone names, if the matrix agrees; both with accents and without."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((1 << HASH_BITS, len(LANGS)))
        for b in batches:
            texts, classes = [], []
            for label, form, content in zip(*(c.to_pylist() for c in b.columns)):
                if len(of := named(label)) == 1:
                    own = [t for _, t, n in segments(content, form) if n >= LEAST_WORDS]
                    texts += own
                    classes += [LANGS.index(*of)] * len(own)
            classes = np.array(classes, np.int64)
            if texts:
                classes = np.where(scored(texts, matrix.value)[0] == classes, classes, -1)
                total += counted(texts, classes) + 0.5 * counted([bare(t) for t in texts], classes)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["counts"])

    return run


def model(parts: DataFrame, train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS):
    """A broadcast matrix fitted on about train_rows labelled rows of parts. Without any, it is that of the seeds."""
    spark = parts.sparkSession
    rows = parts.select("language", "format", F.col("content").cast("string").alias("content")).where("content <> '' AND length(trim(language)) > 1")
    n = rows.count()
    if n > train_rows:
        share = (F.pmod(F.xxhash64("content", "language"), F.lit(1 << 30)) / (1 << 30)) < train_rows / n
        rows = rows.where(share)
    sample = Workspace(spark, "language").written(rows.repartition(max(1, min(12, spark.sparkContext.defaultParallelism))))
    matrix = fitted(None)
    for _ in range(rounds if n else 0):
        sent = spark.sparkContext.broadcast(matrix)
        got = sample.mapInArrow(_counts(sent), "counts binary").collect()  # one matrix of a fixed size for each of at most 12 tasks
        matrix = fitted(sum(np.frombuffer(r.counts, np.float32).reshape(-1, len(LANGS)).astype(np.float64) for r in got))
        sent.unpersist()
    return spark.sparkContext.broadcast(matrix)


def _rows(b, columns: int):
    """The rows of a batch, the segments of all of them, and how many each row has."""
    rows = list(zip(*(c.to_pylist() for c in b.columns)))
    own = [segments(r[columns], r[columns - 1]) for r in rows]
    return rows, own


def _found(matrix):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, own = _rows(b, 3)
            long = [[t for _, t, n in x if n >= LEAST_WORDS] for x in own]
            classes, out, i = scored([t for x in long for t in x], matrix.value)[0], [], 0
            for r, x in zip(rows, long):
                langs = {LANGS[k] for k in classes[i : i + len(x)] if k >= 0}
                out += [(r[0], lang) for lang in sorted(langs - named(r[1]))]
                i += len(x)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in (0, 1)], ["part_id", "language"])

    return run


def _segments(matrix):
    def run(batches):
        import pyarrow as pa

        names, kinds = ["part_id", "position", "segment", "language", "confidence", "letters"], [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64()]
        for b in batches:
            rows, own = _rows(b, 2)
            classes, sure = scored([t for x in own for _, t, _ in x], matrix.value)
            out, i = [], 0
            for r, x in zip(rows, own):
                for k, (s, t, _) in enumerate(x):
                    out.append((r[0], k, s, LANGS[classes[i]] if classes[i] >= 0 else None, float(sure[i]), len(t)))
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return run


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parts").select("part_id", "language", "format", F.col("content").cast("string").alias("content"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: languages that a whole sentence of a part is in and that the row's label does not name. Null and empty contents have none."""
    parts = _parts(spark, sf_dir)
    return parts.mapInArrow(_found(model(parts)), "part_id string, language string").distinct()


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return parts.select("part_id", "format", "content").mapInArrow(_segments(model(parts)), "part_id string, position int, segment string, language string, confidence double, letters long")


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: each segment of every row of parts with its language, null if none, and the confidence."""
    return _labelled(spark, sf_dir).drop("letters")


def p6_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: the languages of each part, with their share of its letters and the mean confidence."""
    s = _labelled(spark, sf_dir).where("language IS NOT NULL").groupBy("part_id", "language").agg(F.sum("letters").alias("letters"), F.sum(F.col("letters") * F.col("confidence")).alias("sure"))
    whole = s.groupBy("part_id").agg(F.sum("letters").alias("all"))
    return s.join(whole, "part_id").select("part_id", "language", (F.col("letters") / F.col("all")).alias("share"), (F.col("sure") / F.col("letters")).alias("confidence"))
