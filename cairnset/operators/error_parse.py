"""Rows that fail to parse (problem 6): minimum-cost error parse of delimited lines.

A line is read by a small automaton whose states are the start of a field, an unquoted field, a quoted field, and the
place after a closing quote. Dynamic programming over the characters finds the cheapest set of edits (insert or delete
a quote or a delimiter) under which the line is well quoted and has the file's number of fields. Lines of cost 0 are
typed. The edits of the others state the reason: ``quoting`` if no path without edits of quotes leads through the line,
whatever its number of fields, ``columns`` if only that number asks for edits.

Lines without quotes that have the right number of fields cost nothing to read, and are split in the JVM; only the
rest go through the automaton and, where it refuses them, the dynamic program.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnset.functions.smiles import well_formed

NUMBER = r"^[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"

_START, _PLAIN, _QUOTED, _CLOSED = range(4)


def _step(state: int, ch: str) -> tuple[int, int] | None:
    """Next state and fields ended, or None where the automaton refuses the character."""
    if state == _QUOTED:
        return (_CLOSED, 0) if ch == '"' else (_QUOTED, 0)
    if ch == ",":
        return _START, 1
    if ch == '"':
        return {_START: (_QUOTED, 0), _CLOSED: (_QUOTED, 0)}.get(state)  # after a closing quote: a doubled one
    return (_PLAIN, 0) if state in (_START, _PLAIN) else None


def least_edits(line: str, n_fields: int | None, signs: str = ',"') -> tuple[int, str]:
    """Cost and edits (``+"@3 -,@17``: what is inserted before, or deleted at, which character) that make ``line`` well
    quoted with ``n_fields`` fields (None: any number), by edits of ``signs`` only.

    Quote edits cost a little more than delimiter edits only to settle ties; runs of characters that cannot change
    the state are stepped over, so that long texts cost as much as their quotes and delimiters.
    """
    # pieces: single quotes and commas, or one stand-in for a run of other characters
    pieces, i = [], 0
    while i < len(line):
        j = i
        while j < len(line) and line[j] not in '",':
            j += 1
        if j > i:
            pieces.append(("x", i))
            i = j
        else:
            pieces.append((line[i], i))
            i += 1
    best: dict[tuple[int, int], tuple] = {(_START, 0): (0, 0, None)}  # cost, ties, edits as a chain back to the first

    def after(state: int, ended: int, ch: str) -> tuple[int, int] | None:
        nxt = _step(state, ch)
        if nxt is None or n_fields is None:
            return nxt and (nxt[0], 0)
        return (nxt[0], ended + nxt[1]) if ended + nxt[1] < n_fields else None

    def offer(to: dict, key: tuple[int, int], cost: tuple) -> bool:
        if key not in to or cost[:2] < to[key][:2]:
            to[key] = cost
            return True
        return False

    def insert(layer: dict, pos: int) -> None:
        todo = list(layer)
        while todo:
            state, ended = key = todo.pop()
            cost, ties, ops = layer[key]
            for ch in signs:
                tie, nxt = int(ch == '"'), after(state, ended, ch)
                if nxt:
                    to = nxt
                    if offer(layer, to, (cost + 1, ties + tie, (ops, f"+{ch}@{pos}"))):
                        todo.append(to)

    for ch, pos in pieces:
        insert(best, pos)
        layer: dict = {}
        for (state, ended), (cost, ties, ops) in best.items():
            nxt = after(state, ended, ch)
            if nxt:
                offer(layer, nxt, (cost, ties, ops))
            if ch in signs:
                offer(layer, (state, ended), (cost + 1, ties + (ch == '"'), (ops, f"-{ch}@{pos}")))
        best = layer
    insert(best, len(line))
    ends = [v for (state, ended), v in best.items() if state != _QUOTED and n_fields in (None, ended + 1)]
    cost, _, ops = min(ends, key=lambda v: v[:2])
    said = []
    while ops:
        ops, edit = ops
        said.append(edit)
    return cost, " ".join(reversed(said))


def read_fields(line: str) -> list[str] | None:
    """The fields of a line that the automaton accepts unchanged, else None."""
    fields, state, begun = [], _START, []
    for ch in line:
        nxt = _step(state, ch)
        if nxt is None:
            return None
        if nxt[1]:
            fields.append("".join(begun))
            begun = []
        elif ch != '"' or state == _CLOSED:
            begun.append(ch)
        state = nxt[0]
    return None if state == _QUOTED else [*fields, "".join(begun)]


_PARSED = T.StructType([T.StructField("quote_cost", T.IntegerType()), T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("cost", T.IntegerType()), T.StructField("edits", T.StringType())])


@F.pandas_udf(_PARSED)
def _error_parse(line: pd.Series, n_fields: pd.Series) -> pd.DataFrame:
    out = []
    for text, n in zip(line, n_fields):
        if text is None:
            out.append((None, None, None, None))
            continue
        fields = read_fields(text)  # a line that the automaton accepts has a path without edits
        quotes = least_edits(text, None, '"')[0] if fields is None else 0
        well = fields is not None and len(fields) == n
        out.append((quotes, fields, *((0, "") if well or not n else least_edits(text, int(n)))))
    return pd.DataFrame(out, columns=["quote_cost", "fields", "cost", "edits"])


@F.pandas_udf(T.BooleanType())
def _well_formed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: x is not None and well_formed(x)).astype(bool)


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def file_headers(lines: DataFrame) -> DataFrame:
    """``file_name, columns``: names in line 1 of each file, without a byte-order mark, in lower case."""
    first = lines.where("line_no = 1").groupBy("file_name").agg(F.min("raw_line").alias("head"))
    names = F.split(F.regexp_replace(F.col("head"), "[\\ufeff\"\\r\\n]", ""), ",")
    return first.select("file_name", F.transform(names, lambda c: F.lower(_trimmed(c))).alias("columns"))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Every line after line 1 of its file: ``line_id, file_name, line_no, reason, cost, edits, smiles, actividad,
    title, ic50``.

    ``reason`` is null for a valid record, else the first that holds of ``quoting``, ``columns`` and ``value``; the
    typed fields are null unless the record is valid. ``cost`` and ``edits`` are those of the cheapest repair to the
    file's number of columns (0 and empty for well-shaped lines). A null line counts as an empty one. A file without
    line 1 has no columns, so that each of its lines that is well quoted fails as ``columns``. Further input columns
    are ignored.
    """
    body = lines.where(F.coalesce(F.col("line_no"), F.lit(0)) != 1).select(
        F.col("line_id").cast("long").alias("line_id"), F.col("file_name").cast("string").alias("file_name"), F.col("line_no").cast("int").alias("line_no"),
        F.regexp_replace(F.coalesce(F.col("raw_line").cast("string"), F.lit("")), r"\r$", "").alias("text"),
    )
    joined = body.join(file_headers(lines), "file_name", "left").withColumn("n", F.coalesce(F.size("columns"), F.lit(0)))
    plain = ~F.contains("text", F.lit('"'))
    easy = joined.withColumn("cells", F.when(plain, F.split("text", ",", -1))).withColumn("easy", F.coalesce(plain & (F.size("cells") == F.col("n")), F.lit(False)))
    read = easy.withColumn("p", _error_parse(F.when(~F.col("easy"), F.col("text")), F.col("n")))
    split = read.select("line_id", "file_name", "line_no", "n", "columns", F.when(F.col("easy"), 0).otherwise(F.col("p.quote_cost")).alias("quote_cost"), F.when(F.col("easy"), F.col("cells")).otherwise(F.col("p.fields")).alias("fields"), F.coalesce("p.cost", F.lit(0)).alias("cost"), F.coalesce("p.edits", F.lit("")).alias("edits"))
    shaped = split.withColumn("shaped", (F.col("quote_cost") == 0) & (F.col("cost") == 0) & (F.col("n") > 0))
    named = lambda name: F.try_element_at("fields", F.nullif(F.array_position("columns", name).cast("int"), F.lit(0)))
    cells = shaped.withColumns({"c_smiles": F.when(F.col("shaped"), _trimmed(named("smiles"))), "c_act": F.when(F.col("shaped"), _trimmed(named("actividad"))), "c_title": F.when(F.col("shaped"), named("title")), "c_ic50": F.when(F.col("shaped"), _trimmed(named("ic50")))})
    number = F.coalesce((F.col("c_ic50") == "") | F.col("c_ic50").rlike(NUMBER), ~F.array_contains("columns", "ic50"), F.lit(False))
    typed = cells.withColumn("typed", F.coalesce(F.col("c_act").isin("0", "1"), F.lit(False)) & number)
    judged = typed.withColumn("atoms", _well_formed(F.when(F.col("typed"), F.col("c_smiles"))))
    # the edits state the reason: some quote must change whatever the number of fields, or else the fields must
    reason = F.when(F.col("quote_cost") > 0, "quoting").when(~F.col("shaped"), "columns").when(~(F.col("typed") & F.col("atoms")), "value")
    out = judged.withColumn("reason", reason)
    valid = F.col("reason").isNull()
    kept = lambda c: F.when(valid, c)
    cols = [F.col("line_id"), F.col("file_name"), F.col("line_no"), F.col("reason"), F.col("cost"), F.col("edits"),
            kept(F.col("c_smiles")).alias("smiles"), kept(F.col("c_act").cast("int")).alias("actividad"), kept(F.col("c_title")).alias("title"), kept(F.expr("try_cast(nullif(c_ic50, '') AS double)")).alias("ic50")]
    return out.select(*cols)


def failed_lines(lines: DataFrame) -> DataFrame:
    """``line_id, reason, cost, edits`` of the lines that give no valid record."""
    return parsed_lines(lines).where("reason IS NOT NULL").select("line_id", "reason", "cost", "edits")


def valid_lines(lines: DataFrame) -> DataFrame:
    """The valid records, typed."""
    return parsed_lines(lines).where("reason IS NULL").drop("reason", "cost", "edits")

