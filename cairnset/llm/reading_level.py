"""Reading level of each document (problem 9).

Method: from the documents that raters have graded comes, for each word, the distribution of levels it is met at; the
level by which a stated share of it has appeared is the word's acquisition grade. Lengths and nestings of sentences are
graded in the same way, as words of their own kinds. A document is described by quantiles and means of the grades of its
known words, of its sentences' lengths, of their nestings, and of the latter two together. For each step between levels,
logistic regression on these numbers, calibrated on the graded documents, says on which side a document is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnset.functions.text import letters_digits
from cairnset.llm.court_prose import english_prose, quantile
from cairnset.llm.related_splits import propagate_labels
from cairnset.storage import materialize


@dataclass(frozen=True)
class Settings:
    """``max_graded`` bounds the graded documents that the model is fitted on (smallest hash first), and with them the
    vocabulary; ``min_docs`` is in how many of them a word must stand to have a grade; ``share`` the part of a word's
    distribution that makes its grade; ``same_prose`` the part of the sentences of the shorter of two versions that the
    other one has at least."""

    max_graded: int = 20_000
    min_docs: int = 4
    share: float = 0.5
    quantiles: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)
    ridge: float = 1.0
    same_prose: float = 0.25
    withheld: str = r"(?i)^\W*(?:document|text|judgment|ruling)?\s*(?:withheld|redacted|removed|not available)\W*$"


@dataclass
class Model:
    """``weights``: one row for each step between levels; empty if there was nothing to fit."""

    grades: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(1))
    sd: np.ndarray = field(default_factory=lambda: np.ones(1))
    held_out: float = float("nan")


def _shapes(prose: list[tuple[list[str], int]]) -> Iterator[tuple[str, str]]:
    """Length and nesting of each sentence as words of their own kinds."""
    for words, nested in prose:
        yield f"#len{len(words) // 2}", f"#nest{nested}"


def _units(prose: list[tuple[list[str], int]]) -> Iterator[str]:
    """Words, lengths and nestings."""
    for words, _ in prose:
        yield from words
    for pair in _shapes(prose):
        yield from pair


def _shape_grade(unit: str, grades: dict[str, float], seen: dict[str, float]) -> float:
    """The grade of a length or nesting, or of the next smaller one that has a grade."""
    if unit not in seen:
        kind = unit.rstrip("0123456789")
        seen[unit] = next((g for k in range(min(int(unit[len(kind) :]), 10_000), -1, -1) if (g := grades.get(f"{kind}{k}")) is not None), 2.5)
    return seen[unit]


def _features(prose: list[tuple[list[str], int]], grades: dict[str, float], quantiles: tuple[float, ...], seen: dict[str, float]) -> list[float]:
    known = sorted(g for words, _ in prose for w in words if (g := grades.get(w)) is not None) or [2.5]
    pairs = [(_shape_grade(a, grades, seen), _shape_grade(b, grades, seen)) for a, b in _shapes(prose)]
    lengths, nestings, both = sorted(a for a, _ in pairs), sorted(b for _, b in pairs), sorted(map(sum, pairs))
    return [quantile(v, q) for v in (known, lengths, nestings, both) for q in quantiles] + [sum(v) / len(v) for v in (known, lengths, nestings)]


def _sentence_hashes(prose: list[tuple[list[str], int]]) -> list[int]:
    """One number for each distinct sentence, the same in all tasks."""
    return list({int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for words, _ in prose})


def ruling_links(prose: DataFrame, same_prose: float) -> DataFrame:
    """``id, kind, first`` for :func:`propagate_labels`: two links for each pair of versions of one ruling.

    ``prose``: ``doc_id, docket, decided, court, said`` (hashes of its sentences). Versions have the same docket and date,
    and at least ``same_prose`` of the sentences of the shorter one in common; what is null in one of the two is made up
    for by the same court. Sentences are the join key, so rulings that share docket and date only never meet.
    """
    short = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c)
    said = prose.select("doc_id", short("docket"), "decided", short("court"), F.size("said").alias("size"), F.explode("said").alias("sentence"))
    other = said.select(*[F.col(c).alias(f"o_{c}") for c in ("doc_id", "docket", "decided", "court", "size")], "sentence")
    named = (F.col("docket") == F.col("o_docket")) & (F.col("decided") == F.col("o_decided"))
    court = F.coalesce(F.col("court") == F.col("o_court"), F.lit(True))
    apart = (F.col("docket") != F.col("o_docket")) | (F.col("decided") != F.col("o_decided"))
    met = said.join(other, "sentence").where((F.col("doc_id") < F.col("o_doc_id")) & F.coalesce(named, ~F.coalesce(apart, F.lit(False)) & court))
    common = met.groupBy("doc_id", "o_doc_id").agg(F.count("*").alias("n"), F.first(F.least("size", "o_size")).alias("most"))
    pairs = common.where(F.col("n") >= same_prose * F.col("most"))
    ends = F.explode(F.array("doc_id", "o_doc_id")).alias("id")
    return pairs.select(ends, F.lit("v").alias("kind"), F.col("doc_id").alias("first"))


_PARSED = "doc_id long, level double, words array<array<string>>, nested array<int>"


def graded_prose(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, level, words, nested``: the English prose of at most ``max_graded`` documents with a rating, sentence by
    sentence; raters' levels are averaged."""
    level = labels.where("doc_id IS NOT NULL AND reading_level BETWEEN 1 AND 5").groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    chosen = level.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_graded)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text, level in zip(pdf["doc_id"], pdf["text"], pdf["level"]):
                prose = english_prose(text)[1]
                if prose:
                    out.append((doc_id, level, [w for w, _ in prose], [n for _, n in prose]))
            yield pd.DataFrame(out, columns=["doc_id", "level", "words", "nested"])

    # ``max_graded`` ids go to all tasks, so that only graded texts leave the scan
    graded = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return graded.select("doc_id", "text", "level").mapInPandas(parse, _PARSED)


def word_grades(graded: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``unit, grade, n_docs`` of :func:`graded_prose`. A level's documents weigh the same in total, whatever their
    number."""
    level = F.round("level").cast("int").alias("level")
    length = F.transform("words", lambda w: F.concat(F.lit("#len"), F.floor(F.size(w) / 2).cast("string")))
    nested = F.transform("nested", lambda n: F.concat(F.lit("#nest"), n.cast("string")))
    met = graded.select(level, F.explode(F.array_distinct(F.concat(F.flatten("words"), length, nested))).alias("unit")).groupBy("unit", "level").agg(F.count("*").alias("n"))
    per_level = graded.select(level).groupBy("level").agg(F.count("*").alias("docs"))  # five rows
    rates = met.join(F.broadcast(per_level), "level").withColumn("rate", F.col("n") / F.col("docs"))
    # where the cumulated share passes ``share``, linear within a level
    w = Window.partitionBy("unit")
    run = rates.withColumn("upto", F.sum("rate").over(w.orderBy("level")) / F.sum("rate").over(w)).withColumn("own", F.col("rate") / F.sum("rate").over(w)).withColumn("n_docs", F.sum("n").over(w))
    passed = run.where((F.col("upto") >= s.share) & (F.col("n_docs") >= s.min_docs))
    at = F.col("level") - 0.5 + (s.share - (F.col("upto") - F.col("own"))) / F.col("own")
    return passed.groupBy("unit").agg(F.min(at).alias("grade"), F.first("n_docs").alias("n_docs"))


def _logistic(a: np.ndarray, above: np.ndarray, ridge: float, rounds: int = 15) -> np.ndarray:
    """Weights by Newton's method; a step that all graded documents are on one side of has a constant only."""
    w = np.zeros(a.shape[1])
    if above.min() == above.max():
        w[0] = 20.0 if above.all() else -20.0
        return w
    penalty = ridge * np.diag([0.0] + [1.0] * (a.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve(a.T @ (a * np.maximum(p * (1 - p), 1e-4)[:, None]) + penalty + 1e-9 * np.eye(len(w)), a.T @ (above - p) - penalty @ w)
    return w


def fit(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """The model of the graded documents. Their features, ``max_graded`` short rows at most, are solved on the driver."""
    graded = materialize(graded_prose(documents, labels, s))
    grades = {r["unit"]: r["grade"] for r in word_grades(graded, s).collect()}  # the vocabulary of ``max_graded`` documents
    model = Model(grades)

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, float] = {}
        for pdf in batches:
            x = [_features([(list(a), int(b)) for a, b in zip(words, nested)], grades, s.quantiles, seen) for words, nested in zip(pdf["words"], pdf["nested"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "level": pdf["level"], "x": x})

    rows = graded.mapInPandas(described, "doc_id long, level double, x array<double>").collect()
    if len(rows) < 10:
        return model
    rows.sort(key=lambda r: r["doc_id"])
    x, y = np.array([r["x"] for r in rows]), np.array([r["level"] for r in rows])
    model.mean, model.sd = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - model.mean) / model.sd])
    steps = (1.5, 2.5, 3.5, 4.5)
    model.weights = np.array([_logistic(z, (y > c).astype(float), s.ridge) for c in steps])
    fold, seen = np.arange(len(y)) % 5, np.zeros(len(y))
    for k in range(5):
        seen[fold == k] = 1 + sum(z[fold == k] @ _logistic(z[fold != k], (y[fold != k] > c).astype(float), s.ridge) >= 0 for c in steps)
    sure = y == np.floor(y)
    model.held_out = float((seen[sure] == y[sure]).mean())
    return model


def reading_levels(documents: DataFrame, labels: DataFrame, s: Settings = Settings(), model: Model | None = None) -> DataFrame:
    """``doc_id, lang, score, level`` for every document; ``level`` (1 to 5) and ``score`` are null unless the text has
    English prose: ``score`` is the expected level, ``level`` counts the steps that a document is more likely above than
    below. Versions of a ruling (same docket and date, and prose in common) share the mean of their log-odds.

    Null, blank and withheld texts have no level, nor have texts without a sentence in their paragraphs. If fewer than
    ten graded documents have prose, no document has a level. Extra columns are ignored.
    """
    model = model or fit(documents, labels, s)
    fitted = len(model.weights) > 0
    named = ["doc_id", "docket", "decided", "court"]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, float] = {}
        for pdf in batches:
            out = []
            for row, text in zip(pdf[named].itertuples(index=False, name=None), pdf["text"]):
                lang, prose = english_prose(text)
                odds = None
                if prose and fitted:
                    x = (np.array(_features(prose, model.grades, s.quantiles, seen)) - model.mean) / model.sd
                    odds = (model.weights[:, 0] + model.weights[:, 1:] @ x).tolist()
                out.append((*row, lang, odds, None if odds is None else _sentence_hashes(prose)))
            yield pd.DataFrame(out, columns=[*named, "lang", "odds", "said"])

    known = lambda c: F.nullif(letters_digits(F.col(c)), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), known("docket_no").alias("docket"), F.col("decided_on").cast("date").alias("decided"), known("court_code").alias("court"), F.coalesce(F.when(~F.col("text").rlike(s.withheld), F.col("text")), F.lit("")).alias("text"))
    scores = materialize(rows.mapInPandas(scored, "doc_id long, docket string, decided date, court string, lang string, odds array<double>, said array<long>"))
    near = scores.where("odds IS NOT NULL")
    ruling = propagate_labels(ruling_links(near, s.same_prose)).select(F.col("id").alias("doc_id"), "label")
    versions = materialize(near.select("doc_id", "lang", *[F.col("odds")[i].alias(f"o{i}") for i in range(4)]).join(ruling, "doc_id", "left"))
    mean = versions.where("label IS NOT NULL").groupBy("label").agg(*[F.avg(f"o{i}").alias(f"m{i}") for i in range(4)])
    odds = [F.coalesce(f"m{i}", f"o{i}") for i in range(4)]
    score = sum((1 / (1 + F.exp(-o)) for o in odds), F.lit(1.0))
    level = sum((F.when(o >= 0, 1).otherwise(0) for o in odds), F.lit(1))
    joined = versions.join(mean, "label", "left").select("doc_id", "lang", score.alias("score"), level.alias("level"))
    return joined.unionByName(scores.where("odds IS NULL").select("doc_id", "lang", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("level")))


def level_profile(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``court_code, source, level, n_docs, share``: the corpus by court, source and level; level is null for
    documents without one."""
    levels = reading_levels(documents, labels, s).select("doc_id", "level")
    out = documents.select("doc_id", "court_code", "source").join(levels, "doc_id").groupBy("court_code", "source", "level").agg(F.count("*").alias("n_docs"))
    return out.withColumn("share", F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy("court_code", "source")))
