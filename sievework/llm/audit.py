"""Filter interaction audit: what each filter removes in every order in which the filters can be applied.

A permutation trie is walked depth first. An edge applies one more filter to the survivors of its node, and the
survivors of the new node are written as a table. What survives doesn't depend on the order of the filters
before, so all prefixes of the same filters are one state, made once: five filters have 325 prefixes and 32
states. At each state one pass counts what each further filter removes from its survivors, and every order reads
its steps from those counts. Survivors hold a few flags for each document, no text; at most one table for each
filter is alive at a time.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, join_groups, sized

#: The five white-space characters and the space.
SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions on a whole text (not null) and its words, by name."""
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 200, "B": 100 * kinds < 50 * n, "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def _labelled(rows: DataFrame, labels: DataFrame, good: str, toxic: str) -> DataFrame:
    """``rows`` with two more flags from the labels of ``doc_id``; rows without an id have none."""
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias(good), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias(toxic))
    own = own.where(F.col(good) | F.col(toxic))
    named, nameless = rows.where("doc_id is not null"), rows.where("doc_id is null")
    found = named.join(sized(own), F.col("doc_id") == F.col("_id"), "left").drop("_id").withColumns({c: F.coalesce(c, F.lit(False)) for c in (good, toxic)})
    return found.unionByName(nameless.withColumns({good: F.lit(False), toxic: F.lit(False)}))


def judged(docs: DataFrame, labels: DataFrame, scratch: Scratch, part_col: str = "source") -> tuple[DataFrame, list[str]]:
    """A row for each document: part, good, toxic and, for each filter, whether the document fails it.

    The last filter, E, fails a text that a smaller ``doc_id`` of the whole table has too. Equal texts are found
    by SHA-256.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # an array of one text, so that the text and its words are made once for all conditions
    rows = docs.select("doc_id", F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.array(text).alias("texts"))

    def flags(t: Column) -> Column:
        with_words = lambda w: F.struct(*(c.alias(k) for k, c in text_filters(t, w).items()), F.unhex(F.sha2(t, 256)).alias("digest"))
        return F.transform(F.array(F.filter(F.split(t, SPACE), lambda x: x != "")), with_words)[0]

    own = rows.select("doc_id", "part", F.inline(F.transform("texts", flags)))
    own = scratch.keep(own, "flags")
    copies = own.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    seen = join_groups(own, scratch.keep(copies, "copies"), "digest", "copies")
    seen = seen.withColumn("E", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    names = [*text_filters(F.lit(""), F.array(F.lit(""))), "E"]
    return scratch.keep(_labelled(seen, labels, "good", "toxic").select("part", "good", "toxic", *names), "judged"), names


def trie(rows: DataFrame, names: list[str], scratch: Scratch) -> list[DataFrame]:
    """Tables (part, state, filter, kept, removed, good_lost, toxic_lost), one for each state.

    ``rows`` has a row for each document with a flag for each name. ``state`` is the set of filters applied
    before, a bit for each. A part without survivors at a state has no row there.
    """
    states: dict[frozenset[str], DataFrame] = {}

    def visit(state: frozenset[str], survivors: DataFrame) -> None:
        left = [f for f in names if f not in state]
        bits = sum(1 << names.index(f) for f in state)

        def edge(f: str) -> Column:
            gone = F.col(f)
            counts = {"kept": ~gone, "removed": gone, "good_lost": gone & F.col("good"), "toxic_lost": gone & F.col("toxic")}
            return F.struct(F.lit(f).alias("filter"), *(F.count_if(c).alias(k) for k, c in counts.items()))

        counted = survivors.groupBy("part").agg(F.array(*map(edge, left)).alias("edges"))
        states[state] = scratch.keep(counted.select("part", F.lit(bits).alias("state"), F.inline("edges")), "edges")
        for f in left:
            reached = state | {f}
            if reached in states or len(reached) == len(names):
                continue
            child = scratch.keep(survivors.where(~F.col(f)).drop(f), "survivors")
            visit(reached, child)
            scratch.drop(child)

    visit(frozenset(), rows)
    return list(states.values())


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part, order of the filters and step; documents are counted within the part. Null parts are
    the empty one, null texts are empty (they are copies of each other, as empty texts are). A row without an id
    is nobody's copy and has no label; rows of one id and text aren't copies of each other. A document is good, or
    toxic, if any of its label rows says so; null labels say nothing. Very long texts are judged whole. Extra
    columns are left out, whatever their names; no rows give none.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    rows, names = judged(docs, labels, scratch, part_col)
    edges = reduce(DataFrame.unionByName, trie(rows, names, scratch))
    only = lambda f: reduce(lambda a, b: a & b, (F.col(g) if g == f else ~F.col(g) for g in names))
    totals = rows.groupBy("part").agg(F.array(*(F.struct(F.lit(f).alias("filter"), F.count_if(F.col(f)).alias("fails"), F.count_if(only(f)).alias("unique_fails")) for f in names)).alias("all"))
    totals = totals.select("part", F.inline("all"))
    n = len(names)
    steps = []
    for order in itertools.permutations(names):
        for k, f in enumerate(order):
            steps.append(("".join(order), k + 1, f, sum(1 << names.index(g) for g in order[:k])))
    # a table of fixed size: n * n! rows
    plan = F.broadcast(docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, state int"))
    weight = reduce(lambda c, k: c.when(F.bit_count("state") == k, math.factorial(k) * math.factorial(n - 1 - k)), range(1, n), F.when(F.bit_count("state") == 0, math.factorial(n - 1)))
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    counts = ("kept", "removed", "good_lost", "toxic_lost")
    known = totals.join(shapley, ["part", "filter"], "left").join(plan, "filter").join(edges, ["part", "state", "filter"], "left")
    known = known.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in (*counts, "shapley")})
    return known.select("part", "filter_order", "step", "filter", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


#: The same in DuckDB, from the texts.
SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
firsts AS (SELECT t, min(doc_id) AS first_id FROM docs GROUP BY t),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT c.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(c.t, '[^A-Z]', '', 'g')) > 2 * length(c.t), regexp_matches(c.t, '[#$%&*|]'), coalesce(c.doc_id > f.first_id, false)] AS bad
  FROM cut c JOIN firsts f ON f.t = c.t LEFT JOIN marks m ON m.doc_id = c.doc_id),
sizes AS (SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM fails GROUP BY part, bad),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) v(l, i)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, s.i AS step, ascii(substr(filter_order, s.i, 1)) - 64 AS f, list_transform(string_split(substr(filter_order, 1, s.i - 1), ''), lambda y: ascii(y) - 64) AS earlier FROM orders, letters s),
kinds AS (SELECT *, s.step AS turn, len(list_filter(earlier, lambda y: y > 0 AND bad[y])) > 0 AS gone FROM sizes, steps s),
counted AS (
  SELECT part, filter_order, turn AS step, chr((f + 64)::INT) AS filter, sum(CASE WHEN NOT gone AND NOT bad[f] THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND bad[f] THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND bad[f] THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bad[f] AND len(list_filter(bad, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND bad[f] THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND bad[f] THEN x ELSE 0 END) AS toxic_lost
  FROM kinds GROUP BY part, filter_order, turn, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""
