"""Mixing sources to target weights (problem 8).

Method: texts are counted in tokens by source, language and topic. For each mix, iterative proportional fitting rakes
the weights of these cells to the source targets and to the language and topic shares of the corpus, with no weight
above the source's cap on repeats; sources come last in each round, so that their weights hold exactly. Documents are
then drawn with their cell's weight as expected number of copies: one systematic draw runs along all texts of a source,
from the longest to the shortest. The copies drawn so far are never more than a half from the expected ones, and
lengths only fall, so that the tokens drawn are within half of the source's longest text of its share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnset.llm.court_prose import language
from cairnset.llm.tokens import DEFAULT_RANKS, _encoding
from cairnset.operators.running import running_totals
from cairnset.storage import materialize


def sized_by_cell(documents: DataFrame, topic_col: str = "court_code", path: str = DEFAULT_RANKS) -> DataFrame:
    """``text_id, doc_id, source, lang, topic, n_tokens``, one row for each distinct text.

    A text under several ids stands with its smallest id, and with that one's source; documents without a source come
    after those with one. Null and blank texts are left out.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path)
        for pdf in batches:
            yield pd.DataFrame({**{c: pdf[c] for c in ("text_id", "doc_id", "source", "topic")}, "lang": [language(t) or "other" for t in pdf["text"]], "n_tokens": [len(enc.encode_ordinary(t)) for t in pdf["text"]]})

    rows = documents.where(r"text RLIKE '\\S'").select(F.unhex(F.md5("text")).alias("text_id"), F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.col(topic_col).cast("string"), F.lit("none")).alias("topic"), "text")
    sized = rows.mapInPandas(measure, "text_id binary, doc_id long, source string, topic string, lang string, n_tokens long")
    first = F.min(F.struct(F.col("source").isNull().alias("no"), "doc_id", "source", "topic", "lang", "n_tokens")).alias("f")
    return sized.groupBy("text_id").agg(first).select("text_id", *[f"f.{c}" for c in ("doc_id", "source", "topic", "lang", "n_tokens")])


def _capped(base: np.ndarray, tokens: np.ndarray, total: float, cap: float) -> np.ndarray:
    """``min(cap, k * base)`` with the ``k`` that makes the tokens add up to ``total``."""
    if (tokens * cap).sum() <= total:
        return np.full(len(base), cap)
    lo, hi = 0.0, 1.0
    while (np.minimum(cap, hi * base) * tokens).sum() < total:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (np.minimum(cap, mid * base) * tokens).sum() < total else (lo, mid)
    return np.minimum(cap, hi * base)


def rake(cells: list[tuple[str, str, str, float]], targets: list[tuple[str, float, float]], rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights of ``(source, lang, topic, tokens)`` cells for ``(source, share, cap)`` targets, and the mix's size.

    The size is the largest at which no source needs more repeats than its cap allows; without caps, it is that of the
    sources together. Sources that the corpus lacks get nothing, and the others keep their proportions.
    """
    source = np.array([c[0] for c in cells], object)
    tokens = np.array([c[3] for c in cells], float)
    have = {s: tokens[source == s].sum() for s, _, _ in targets}
    live = [(s, share, cap) for s, share, cap in targets if have[s] > 0 and share > 0]
    w = np.zeros(len(cells))
    if not live:
        return w, 0.0
    whole = sum(share for _, share, _ in live)
    sizes = [cap * have[s] / (share / whole) for s, share, cap in live if np.isfinite(cap)]
    total = min(sizes) if sizes else sum(have[s] for s, _, _ in live)
    inside = np.isin(source, [s for s, _, _ in live])
    w[inside] = 1.0
    margins = []
    for axis in (1, 2):
        names = np.array([c[axis] for c in cells], object)
        corpus = tokens[inside].sum()
        margins.append([(m := inside & (names == v), tokens[m].sum() / corpus) for v in sorted(set(names[inside]))])
    for _ in range(rounds):
        before = w.copy()
        for margin in margins:
            for mask, share in margin:
                now = (w[mask] * tokens[mask]).sum()
                if now > 0 and share > 0:
                    w[mask] *= total * share / now
        for s, share, cap in live:
            mask = source == s
            w[mask] = _capped(np.maximum(w[mask], 1e-9), tokens[mask], total * share / whole, cap)
        if np.abs(w - before).max() < 1e-6 * max(1.0, w.max()):
            break
    return w, total


_UNIT = 1 << 24  # weights are whole numbers of this part, so that sums are exact


def mix_sources(documents: DataFrame, targets: DataFrame, topic_col: str = "court_code", path: str = DEFAULT_RANKS, seed: int = 8, max_topics: int = 500) -> DataFrame:
    """``mix_name, source, doc_id, n_tokens, copies`` of the documents in each mix (``copies`` of 1 or more).

    Only tokens by category and the parameter table reach the driver; topics beyond the ``max_topics`` largest are one
    topic to the raking. A null ``max_repeats`` is no cap; a null or zero share takes nothing. Documents without a
    source are in no mix. A later target row for the same source of a mix replaces none: their shares add up, and the
    smaller cap holds.
    """
    spark = documents.sparkSession
    texts = materialize(sized_by_cell(documents, topic_col, path).where("source IS NOT NULL AND n_tokens > 0"))
    big = texts.groupBy("topic").agg(F.sum("n_tokens").alias("t")).orderBy(F.desc("t"), "topic").limit(max_topics).select("topic", F.col("topic").alias("big"))
    texts = texts.join(F.broadcast(big), "topic", "left").withColumn("topic", F.coalesce("big", F.lit("other"))).drop("big")  # max_topics rows
    tokens = texts.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")).orderBy("source", "lang", "topic").collect()  # one row a category
    cells = [tuple(r) for r in tokens]
    wanted: dict[str, dict[str, tuple[float, float]]] = {}
    for r in targets.where("mix_name IS NOT NULL AND source IS NOT NULL").orderBy("mix_name", "source").collect():  # a parameter table
        share, cap = wanted.setdefault(r["mix_name"], {}).get(r["source"], (0.0, np.inf))
        wanted[r["mix_name"]][r["source"]] = (share + float(r["target_share"] or 0), min(cap, np.inf if r["max_repeats"] is None else float(r["max_repeats"])))
    weights = []
    for mix, by_source in wanted.items():
        w, _ = rake(cells, [(s, share, cap) for s, (share, cap) in by_source.items()])
        weights += [(mix, s, lang, topic, round(float(x) * _UNIT)) for (s, lang, topic, _), x in zip(cells, w) if x > 0]
    per_cell = spark.createDataFrame(weights, "mix_name string, source string, lang string, topic string, w long")  # mixes x categories
    asked = texts.join(F.broadcast(per_cell), ["source", "lang", "topic"]).select("mix_name", "source", "text_id", "doc_id", "n_tokens", "w")
    run = running_totals(asked, ["mix_name", "source"], [-F.col("n_tokens"), F.xxhash64("text_id", F.lit(seed)), F.col("text_id")], {"upto": F.col("w")})
    half = F.lit(_UNIT // 2)
    copies = F.floor((F.col("upto") + half) / F.lit(_UNIT)) - F.floor((F.col("upto") - F.col("w") + half) / F.lit(_UNIT))
    return run.withColumn("copies", copies).where("copies > 0").select("mix_name", "source", "doc_id", "n_tokens", "copies")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_name, source, target_share, actual_share, n_texts, n_tokens, most_copies`` for every target, also those
    that the corpus cannot serve."""
    got = mixed.groupBy("mix_name", "source").agg(F.count("*").alias("n_texts"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    want = targets.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"))
    both = want.join(got, ["mix_name", "source"], "left").na.fill(0, ["n_texts", "n_tokens", "most_copies"])
    return both.select("mix_name", "source", "target_share", (F.col("n_tokens") / F.nullif(F.sum("n_tokens").over(Window.partitionBy("mix_name")), F.lit(0))).alias("actual_share"), "n_texts", "n_tokens", "most_copies")
