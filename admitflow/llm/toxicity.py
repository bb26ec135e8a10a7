"""Toxicity scores from a counterfactual-regularised linear classifier.

A text is the set of its words and of their beginnings (four and five
letters, which inflected forms share), but for beginnings that a group's name
has: no text gets those. The classifier is a logistic regression
on their presence, toxic texts weighing ``POSITIVE`` times a clean one, fitted
to a bounded sample of labelled texts (``MAX_TRAIN``, drawn by hashes of ids
and texts over all labelled rows of the training folds). Its loss has a second term:
in every labelled text that names a group, the group's name is swapped for
each of the other names of the same kind, and the squared change of the score
is penalised. As a name is one feature only, this is the whole change of the
score's log-odds; it becomes small, not nothing, so neutral mentions of one
group score much like those of another.

The sample's words are counted in Spark; its vocabulary is the at most
``MAX_WORDS`` words whose share of toxic texts is ``TELLING`` standard errors
off, and all names of groups. The driver gets it and each text as numbers of
it; the fitted weights (as bounded) are broadcast, and every whole text of the
table is scored where it lies.

Edge cases: a null or wordless text scores as the intercept alone; labels
other than 0 and 1 and labels of absent documents are not used; of repeated
labels of a document each counts; with no labels, or one class only, the
score is constant; an empty table has no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .encoding import tidy

MAX_TRAIN = 20_000
MAX_WORDS = 20_000
TELLING = 3.0
RIDGE = 1e-4
POSITIVE = 2.5
COUNTERFACTUAL = 1.0
STEPS = 200

# Names of groups, by kind; a name is swapped within its kind.
IDENTITY_TERMS = {
    "gender": "woman women man men girl girls boy boys female females male males transgender nonbinary "
              "femme femmes homme hommes fille filles garçon garçons mujer mujeres hombre hombres chica chicas chico chicos "
              "frau frauen mann männer mädchen junge jungen",
    "religion": "muslim muslims christian christians jewish jew jews hindu hindus buddhist buddhists atheist atheists catholic catholics sikh sikhs "
                "musulman musulmans chrétien chrétiens juif juifs musulmán musulmanes cristiano cristianos judío judíos "
                "muslime christen juden",
    "origin": "black blacks white whites asian asians african africans european europeans american americans mexican mexicans arab arabs "
              "latino latinos latina latinas hispanic hispanics indian indians chinese immigrant immigrants refugee refugees "
              "africain africains arabe arabes immigré immigrés africano africanos árabe árabes inmigrante inmigrantes "
              "afrikaner araber ausländer einwanderer flüchtlinge",
    "orientation": "gay gays lesbian lesbians bisexual bisexuals queer queers straight heterosexual heterosexuals homosexual homosexuals "
                   "lesbienne lesbiennes homosexuel homosexuels lesbiana lesbianas homosexuales lesben schwule homosexuelle",
    "ability": "blind deaf disabled autistic paralyzed",
    "age": "old young elderly teenager teenagers",
}
NAMES = " ".join(IDENTITY_TERMS.values()).split()
# Beginnings that a name's toxic weight could move to, out of the penalty's reach.
_OF_NAMES = {name[:n] for name in NAMES if len(name) > 4 for n in (4, 5)}
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def text_words(text: str | None) -> set[str]:
    """The distinct lowered words of a text and their marked beginnings,
    without those of groups' names."""
    if not text:
        return set()
    words = set(_WORD.findall(text.lower()))
    long = [w for w in words if len(w) > 4]
    words.update(["^" + b for b in {w[:4] for w in long} - _OF_NAMES])
    words.update(["^" + b for b in {w[:5] for w in long} - _OF_NAMES])
    return words


@dataclass
class Model:
    weights: dict[str, float]
    intercept: float

    def score(self, words: set[str]) -> float:
        known = self.weights
        z = self.intercept + sum([known[w] for w in words if w in known])
        return 1.0 / (1.0 + float(np.exp(-min(max(z, -35.0), 35.0))))


def in_training(doc_id, folds: int, held: int):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)) != held


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, max_train: int,
                    scratch: Scratch) -> DataFrame:
    """(text, y) of at most ``max_train`` labelled texts of the training
    folds; which ones depends on hashes of their ids and texts alone."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(in_training(F.col("doc_id"), folds, held))
    # At most max_train pairs of numbers: small enough to broadcast, so texts are not shuffled.
    picked = _by_hash(known, known.count(), max_train, "doc_id")
    key = F.xxhash64("text").alias("text_key")
    found = docs.select("doc_id", key).join(F.broadcast(picked), "doc_id").distinct()
    found = scratch.table(found, "sample-keys")  # one id may have many texts, and a row many copies
    keys = _by_hash(found, found.count(), max_train, "doc_id", "text_key")
    texts = docs.select("doc_id", key, "text").join(F.broadcast(keys), ["doc_id", "text_key"])
    return texts.dropDuplicates(["doc_id", "text_key", "y"]).select("text", "y")


def _by_hash(rows: DataFrame, n: int, most: int, *key: str) -> DataFrame:
    """At most ``most`` of ``n`` rows, by a hash of their key."""
    if n > most:
        share = most / n * 0.95
        rows = rows.where(F.pmod(F.xxhash64(*key, F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000))
    return rows.orderBy(F.xxhash64(*key, F.lit(17)), *rows.columns).limit(most)


def telling_words(sample: DataFrame, max_words: int = MAX_WORDS) -> list[str]:
    """The vocabulary of a sample (words, y): counted in Spark, at most
    ``max_words`` of it reach the driver."""
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < toxic < n:
        return []
    share = toxic / n
    counts = sample.select(F.explode("words").alias("word"), "y").groupBy("word").agg(
        F.count("*").alias("n"), F.sum("y").alias("toxic"))
    told = F.abs(F.col("toxic") - share * F.col("n")) / F.sqrt(share * (1 - share) * F.col("n"))
    name = F.col("word").isin(NAMES)
    kept = counts.withColumn("told", told).withColumn("name", name).where(
        name | (F.col("n") >= max(3, n // 2000)) & (F.col("told") >= TELLING))
    return [r["word"] for r in kept.orderBy(F.desc("name"), F.desc("told"), "word").select("word").limit(max_words).collect()]


def fit(rows: list[np.ndarray], y: np.ndarray, vocabulary: list[str], ridge: float = RIDGE,
        counterfactual: float = COUNTERFACTUAL, steps: int = STEPS) -> Model:
    """Fit the weights of ``vocabulary`` to texts given as numbers of its
    words (on the driver; texts, words and steps are bounded)."""
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model({}, float(np.log(p / (1 - p))))
    n, m = len(y), len(vocabulary)
    cols = np.concatenate(rows).astype(np.int64)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    swaps = _swaps(cols, vocabulary)
    weight = np.where(y > 0, POSITIVE, 1.0)
    weight /= weight.sum()
    w, b = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    mw, vw, mb, vb = np.zeros(m), np.zeros(m), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(row, weights=w[cols], minlength=n)
        g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) * weight
        gw = np.bincount(cols, weights=g[row], minlength=m) + ridge * w
        if len(swaps):
            change = w[swaps[:, 0]] - np.where(swaps[:, 1] >= 0, w[swaps[:, 1]], 0.0)
            pull = counterfactual * change * swaps[:, 2] * 2 / n
            gw += np.bincount(swaps[:, 0], weights=pull, minlength=m)
            there = swaps[:, 1] >= 0
            gw -= np.bincount(swaps[there, 1], weights=pull[there], minlength=m)
        gb = g.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 * min(1.0, 2.0 * (1 - t / (steps + 1)))
        w -= rate * (mw / (1 - 0.9 ** t)) / (np.sqrt(vw / (1 - 0.99 ** t)) + 1e-5)
        b -= rate * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-5)
    return Model({k: float(v) for k, v in zip(vocabulary, w)}, float(b))


def _swaps(cols: np.ndarray, vocabulary: list[str]) -> np.ndarray:
    """(name, other name, texts with the name) of all swaps of group names in
    the sample, as numbers of words; -1 is a name that no text has."""
    number, there = {w: i for i, w in enumerate(vocabulary)}, np.bincount(cols, minlength=len(vocabulary))
    out = [(number[name], number.get(other, -1), int(there[number[name]]))
           for kind in IDENTITY_TERMS.values() for name in kind.split() if name in number
           for other in kind.split() if other != name]
    return np.asarray(out, np.int64).reshape(-1, 3)


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "toxic", folds: int = 5, held: int = 0,
          max_train: int = MAX_TRAIN) -> Model:
    """Fit the classifier on the training folds' labels."""
    def words(batches):
        for b in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(text_words(t)) for t in b["text"].to_pylist()], pa.list_(pa.string())), b["y"]], names=["words", "y"])

    sample = training_sample(docs, labels, label, folds, held, max_train, scratch)
    sample = scratch.table(sample.mapInArrow(tidy(words), "words array<string>, y int"), "sample")
    vocabulary = telling_words(sample)
    number = {w: i for i, w in enumerate(vocabulary)}

    def numbers(batches):
        for b in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            rows = [np.asarray([number[w] for w in ws if w in number], "<i4").tobytes() for ws in b["words"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b["y"]], names=["words", "y"])

    rows = sample.mapInArrow(tidy(numbers), "words binary, y int").toArrow()
    scratch.drop("sample", "sample-keys")
    return fit([np.frombuffer(r, "<i4") for r in rows["words"].to_pylist()], rows["y"].to_numpy(), vocabulary)


def score(docs: DataFrame, model: Model, text: str = "text", out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with two more columns (which replace columns of their names):
    the score, 0 to 1, and 1 where it is 0.5 or more, else 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name not in out]
    kept = docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col(f"`{text}`"))
    plain = kept.toDF(*[f"c{i}" for i in range(len(fields) + 1)])  # whatever the columns' names are

    def scored(batches):
        m = shared.value
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            s = pa.array([m.score(text_words(t)) for t in b.column(b.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], s, pa.compute.greater_equal(s, 0.5).cast(pa.int32())], names=[*b.schema.names[:-1], "score", "predicted"])

    schema = plain.drop(f"c{len(fields)}").schema.add("score", "double").add("predicted", "integer")
    return plain.mapInArrow(tidy(scored), schema).toDF(*[f.name for f in fields], *out)


def toxicity_scores(docs: DataFrame, labels: DataFrame, scratch: Scratch, folds: int = 5, held: int = 0) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    model = train(docs, labels, scratch, "toxic", folds, held)
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~in_training(F.col("doc_id"), folds, held)).alias("held_out"), "score", "predicted")
