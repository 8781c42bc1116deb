"""Filling fixed-capacity containers with items (problem 7).

Method: item lengths are counted in a histogram of at most ``bins`` classes. Combinations of up to ``depth`` classes
that fill the capacity to within a window are enumerated, and non-negative least squares says how often each is to be
repeated so that the histogram is met; the counts are rounded down. What is left of the histogram is packed greedily,
class by class, largest first. Items then take their places by rank within their class. Only the histogram and the
combinations are on the driver, whose size does not depend on the data.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnset.llm.tokens import DEFAULT_RANKS, sized_texts
from cairnset.storage import materialize


def class_width(capacity: int, bins: int) -> int:
    return max(1, -(-capacity // bins))


def _combinations(classes: np.ndarray, capacity: int, depth: int, window: float, most: int = 4000) -> list[tuple[int, ...]]:
    """Index tuples of up to ``depth`` classes whose lengths add up to at least ``1 - window`` of the capacity; deeper
    levels are thinned evenly beyond ``most``."""
    out: list[tuple[int, ...]] = [(i,) for i in range(len(classes))]
    for d in range(2, depth + 1):
        level, floor = [], capacity * (1 - window)
        for head in combinations_with_replacement(range(len(classes)), d - 1):
            rest = capacity - int(classes[list(head)].sum())
            if rest < classes[head[-1]]:
                continue
            # the last item: the longest class that fits, and its neighbours within the window
            i = int(np.searchsorted(classes, rest, side="right")) - 1
            while i >= head[-1] and capacity - rest + classes[i] >= floor:
                level.append((*head, i))
                i -= 1
        out += level if len(level) <= most else [level[int(k)] for k in np.linspace(0, len(level) - 1, most)]
    return out


def nnls(a: np.ndarray, b: np.ndarray, weight: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |weight * (a x - b)| over x >= 0, by cyclic coordinate descent on the normal equations."""
    aw = a * weight[:, None]
    gram, rhs = aw.T @ aw, aw.T @ (b * weight)
    diag = np.maximum(np.diag(gram), 1e-12)
    x, grad = np.zeros(len(rhs)), -rhs.copy()
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero((x > 0) | (grad < 0)):
            step = max(-x[j], -grad[j] / diag[j])
            if step:
                x[j] += step
                grad += step * gram[:, j]
                moved = max(moved, abs(step))
        if moved < 0.25:  # counts are rounded anyway
            break
    return x


def plan_containers(lengths: np.ndarray, counts: np.ndarray, capacity: int, depth: int = 3, window: float = 0.02, max_columns: int = 1500) -> list[tuple[dict[int, int], int]]:
    """``[({class: items}, repeats)]`` that use each class exactly ``counts`` times; ``lengths`` ascending, the longest
    item of each class."""
    left = counts.astype(np.int64).copy()
    live = np.flatnonzero(left > 0)
    plans: list[tuple[dict[int, int], int]] = []
    if len(live):
        combos = _combinations(lengths[live], capacity, depth, window)
        fill = np.array([lengths[live][list(c)].sum() for c in combos])
        order = np.argsort(-fill, kind="stable")[:max_columns]
        combos = [combos[i] for i in order if fill[i] >= capacity * (1 - window)]
        if combos:
            a = np.zeros((len(live), len(combos)))
            for j, c in enumerate(combos):
                np.add.at(a[:, j], list(c), 1)
            x = nnls(a, left[live].astype(float), lengths[live] / capacity)
            for j in np.argsort(-x, kind="stable"):
                use = {int(live[i]): int(k) for i, k in zip(*np.unique(combos[j], return_counts=True))}
                times = min(int(x[j] + 1e-6), *(left[i] // k for i, k in use.items()))
                if times > 0:
                    plans.append((use, int(times)))
                    for i, k in use.items():
                        left[i] -= k * times
    # residuals: longest class first, then whatever is longest among those that still fit, as often as it can repeat
    while (left > 0).any():
        use: dict[int, int] = {}
        room = capacity
        while True:
            fits = np.flatnonzero((left > 0) & (lengths <= room))
            fits = [i for i in fits if left[i] > use.get(int(i), 0)]
            if not len(fits):
                break
            i = int(max(fits))
            k = int(min(room // lengths[i], left[i] - use.get(i, 0))) if not use or lengths[i] * 2 <= room else 1
            use[i] = use.get(i, 0) + max(1, k)
            room -= int(lengths[i]) * max(1, k)
        times = int(min(left[i] // k for i, k in use.items()))
        plans.append((use, times))
        for i, k in use.items():
            left[i] -= k * times
    return plans


def pack_items(items: DataFrame, sizes: DataFrame, bins: int = 512, depth: int = 3, window: float = 0.02, rank_rows: int = 100_000) -> DataFrame:
    """``pack_name, capacity, container_id, item_id, piece, n_tokens``.

    ``items``: ``item_id, n_tokens``; ``sizes``: ``pack_name, capacity_tokens``. An item longer than a capacity gives
    full containers of its own and a last piece that is packed with the others; no other item is split. Items without
    tokens or with a null length need no place, packs with a null or non-positive capacity are skipped. A repeated
    ``item_id`` counts each time.
    """
    spark = items.sparkSession
    packs = [(r["pack_name"], int(r["capacity_tokens"])) for r in sizes.where("capacity_tokens > 0").distinct().orderBy("pack_name").collect()]  # a parameter table
    if not packs:
        return spark.createDataFrame([], "pack_name string, capacity int, container_id string, item_id long, piece int, n_tokens int")
    per_pack = F.array(*[F.struct(F.lit(p).alias("pack_name"), F.lit(c).alias("capacity"), F.lit(class_width(c, bins)).alias("width")) for p, c in packs])
    every = items.where("n_tokens > 0").select("item_id", F.col("n_tokens").cast("long").alias("size"), F.inline(per_pack))
    whole = F.floor((F.col("size") - 1) / F.col("capacity"))
    cut = every.withColumn("whole", whole).withColumn("rest", (F.col("size") - F.col("whole") * F.col("capacity")).cast("int"))
    # classes by length; the salts of a class follow its count, so that a task ranks about ``rank_rows`` items
    cut = materialize(cut.withColumn("cls", F.floor((F.col("rest") - 1) / F.col("width")).cast("int")).select("pack_name", "capacity", "item_id", "size", "whole", "rest", "cls"))
    salts = cut.groupBy("pack_name", "cls").agg(F.ceil(F.count("*") / F.lit(rank_rows)).cast("int").alias("salts"))  # packs x bins rows
    cut = cut.join(F.broadcast(salts), ["pack_name", "cls"]).withColumn("salt", F.pmod(F.xxhash64("item_id"), F.col("salts")).cast("int"))
    hist = cut.groupBy("pack_name", "cls", "salt").agg(F.count("*").alias("n"), F.max("rest").alias("longest")).collect()  # packs x bins rows, and one for each ``rank_rows`` items more
    by_pack: dict[str, dict[int, list]] = {}
    for r in hist:
        by_pack.setdefault(r["pack_name"], {}).setdefault(r["cls"], []).append((r["salt"], r["n"], r["longest"]))
    slots, offsets = [], []
    for name, capacity in packs:
        classes = sorted(by_pack.get(name, {}).items())
        counts = np.array([sum(n for _, n, _ in v) for _, v in classes], np.int64)
        lengths = np.array([max(m for _, _, m in v) for _, v in classes], np.int64)
        for cls, v in classes:
            at = 0
            for salt, n, _ in sorted(v):
                offsets.append((name, cls, salt, at))
                at += n
        used, first = np.zeros(len(classes), np.int64), 0
        for use, times in plan_containers(lengths, counts, capacity, depth, window):
            for i, k in use.items():
                slots.append((name, classes[i][0], int(used[i]), int(used[i] + k * times), k, first))
                used[i] += k * times
            first += times
    at = spark.createDataFrame(offsets, "pack_name string, cls int, salt int, before long")
    runs = spark.createDataFrame(slots, "pack_name string, cls int, lo long, hi long, k int, first long")
    ranked = cut.withColumn("rn", F.row_number().over(Window.partitionBy("pack_name", "cls", "salt").orderBy("item_id", "size")) - 1)
    # both tables are as large as the plans, whatever the data
    placed = ranked.join(F.broadcast(at), ["pack_name", "cls", "salt"]).withColumn("rank", F.col("before") + F.col("rn"))
    found = placed.join(F.broadcast(runs), ["pack_name", "cls"]).where("rank >= lo AND rank < hi")
    last = found.select("pack_name", "capacity", F.concat(F.lit("m"), (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("k"))).cast("string")).alias("container_id"), "item_id", F.col("whole").cast("int").alias("piece"), F.col("rest").alias("n_tokens"))
    full = cut.where("whole > 0").select("pack_name", "capacity", "item_id", F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).alias("piece"))
    full = full.select("pack_name", "capacity", F.concat_ws("-", F.lit("f"), F.col("item_id").cast("string"), F.col("piece").cast("string")).alias("container_id"), "item_id", "piece", F.col("capacity").alias("n_tokens"))
    return last.unionByName(full)


def pack_documents(documents: DataFrame, sizes: DataFrame, path: str = DEFAULT_RANKS, **kw) -> DataFrame:
    """Texts of ``documents`` in containers of each capacity; null and empty texts need no place."""
    # written once: a filter on the sizes would have each text tokenized again
    return pack_items(materialize(sized_texts(documents, path).withColumnRenamed("doc_id", "item_id")), sizes, **kw)


def pack_report(packed: DataFrame) -> DataFrame:
    """``pack_name, capacity, n_items, n_containers, n_tokens, n_least, fill``: ``n_least`` containers are needed at
    the very least."""
    per = packed.groupBy("pack_name", "capacity").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return per.select("*", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("n_least"), (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"))
