"""Which texts contain which names: a multi-pattern automaton over whole texts.

Names (aliases, features, triggers) become Aho-Corasick automata, which find all
of them in one pass over a text, overlaps included, at a cost that grows with the text
and not with the number of names. Names go to the tasks in pieces of at most
`PIECE_BYTES`, measured before; each piece is one scan of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of names in an automaton (some fifty bytes of memory each).
PIECE_BYTES = 8 << 20
#: The shortest name that is looked for (fixed value).
LEAST = 3


def _scan(names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for name in names:
        automaton.add_word(name, name)
    automaton.make_automaton()
    for batch in batches:
        ids, found = [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            here = sorted({name for _, name in automaton.iter(text)}) if text else []
            ids += [k] * len(here)
            found += here
        if ids:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(found)], names=[batch.schema.names[0], "name"])


def contained(texts: DataFrame, id_col: str, text: str, names: DataFrame, least: int = LEAST, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(id, name): the names (name) of `least` characters or more that a text contains, both in lower case; a pair once a row of texts."""
    wanted = names.select(F.lower("name").alias("name")).filter(F.length("name") >= least).distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).alias("b")).head()["b"]
    pieces = max(1, -(-size // piece_bytes))
    rows = texts.select(F.col(id_col), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    schema = f"{id_col} {dict(rows.dtypes)[id_col]}, name string"
    found = []
    for k in range(pieces):
        some = [r["name"] for r in wanted.filter(F.pmod(F.xxhash64("name"), F.lit(pieces)) == k).collect()]  # piece_bytes, by expectation
        if some:
            found.append(rows.mapInArrow(partial(_scan, some), schema))
    return reduce(DataFrame.union, found) if found else texts.sparkSession.createDataFrame([], schema)


def loose_matches(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """(question_id, entry): entries (name, aliases, repos) that a question (question_id, text) names by name, alias or repository,
    or one of whose repositories' names holds the whole question."""
    said = entries.select(F.col("name").alias("entry"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array()), F.coalesce("repos", F.array()))).alias("name"))
    said = said.select("entry", F.lower("name").alias("name")).distinct()
    inside = contained(questions, "question_id", "text", said).join(said, "name").select("question_id", "entry")
    asked = questions.select("question_id", F.lower(F.trim("text")).alias("name"))
    repos = entries.select(F.col("name").alias("entry"), F.explode(F.coalesce("repos", F.array())).alias("repo")).distinct()
    around = contained(repos.select("repo").distinct(), "repo", "repo", asked.select("name")).join(repos, "repo").join(asked, "name").select("question_id", "entry")
    return inside.union(around).distinct()


def not_contained(names: DataFrame, texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows of names (name, ...) whose name no text contains; every text contains the empty name."""
    known = contained(texts, id_col, text, names, least=1).select(F.col("name").alias("_low")).distinct()
    return names.filter("name <> ''").withColumn("_low", F.lower("name")).join(known, "_low", "left_anti").drop("_low")


def not_triggered(texts: DataFrame, id_cols: list[str], text: str, triggers: DataFrame) -> DataFrame:
    """The ids of texts that contain none of the triggers (name)."""
    one = texts.select(*id_cols, F.to_json(F.struct(*id_cols)).alias("_id"), text)
    return one.join(contained(one, "_id", text, triggers, least=1).select("_id").distinct(), "_id", "left_anti").select(*id_cols)
