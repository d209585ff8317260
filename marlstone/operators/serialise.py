"""Tables as token sequences with roles: a target column, then context columns chosen for it.

A column is a start mark, its name, a separator, and cells with a separator behind each, as many from the
front as its budget holds. A cell costs one token at least, so no more cells of a column than
its budget are ever brought together, whatever the table's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.similarity import cosine, mmr
from marlstone.operators.windows import byte_ids, first_rows
from marlstone.storage import stash

#: The ids of the marks.
START, SEPARATOR, BOUNDARY = 1, 2, 5


def column_budget(n_columns: Column, most: int) -> Column:
    """TOK-02: what one of ``n_columns`` columns may take of ``most`` tokens."""
    return F.greatest(F.lit(1), F.floor((F.lit(most) - 2 * n_columns) / n_columns)).cast("int")


def contexts(columns: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """TOK-03: ``(table, target, context, place)``: for each column of ``columns(table, ix, vector)`` its ``k`` contexts by maximal marginal relevance.

    Relevance is the cosine with the target; of equal scores the lower index goes first. Pairs are those of one table's columns.
    """
    target = columns.select("table", F.col("ix").alias("target"), F.col("vector").alias("__t"))
    pairs = target.join(columns, "table").where("target <> ix")
    pairs = pairs.select(F.struct("table", "target").alias("pair"), "ix", "vector", cosine(F.col("__t"), F.col("vector")).alias("rel"))
    found = mmr(stash(pairs, "pairs"), "pair", "ix", "vector", "rel", k, weight)
    return found.select("pair.table", "pair.target", F.col("ix").alias("context"), "place")


def column_tokens(cells: DataFrame, names: DataFrame, budgets: DataFrame, boundary: bool = False) -> DataFrame:
    """``(table, ix, budget, tokens)``: each column's tokens for each budget that is asked for.

    ``cells(table, ix, place, value)``, ``names(table, ix, name)``, ``budgets(table, budget)``. Cells stop before the first that
    does not fit. A null value is an empty cell, a column without cells is its name alone.
    """
    ids = lambda c: byte_ids(F.coalesce(c, F.lit("")))
    wanted = names.join(budgets.distinct(), "table")
    head = F.concat(F.array(F.lit(START)), F.slice(ids(F.col("name")), F.lit(1), F.floor(F.col("budget") / 4).cast("int")), F.array(F.lit(SEPARATOR)))
    heads = wanted.select("table", "ix", "budget", head.alias("head"), (F.col("budget") - F.size(head)).alias("room"))
    most = budgets.agg(F.max("budget")).first()[0] or 1
    front = stash(first_rows(cells.select("table", "ix", "place", "value"), ["table", "ix"], ["place", "value"], most, "r"), "cells")
    cost = F.octet_length(F.coalesce("value", F.lit(""))) + 1 + int(boundary)
    placed = front.join(heads, ["table", "ix"])
    used = F.sum(cost).over(Window.partitionBy("table", "ix", "budget").orderBy("r"))
    fits = placed.withColumn("used", used).where(F.col("used") <= F.col("room"))
    cell = F.concat(F.array(F.lit(BOUNDARY)) if boundary else F.array().cast("array<int>"), ids(F.col("value")), F.array(F.lit(SEPARATOR)))
    listed = fits.groupBy("table", "ix", "budget").agg(F.array_sort(F.collect_list(F.struct("r", cell.alias("t")))).alias("rows"))
    joined = heads.join(listed, ["table", "ix", "budget"], "left")
    body = F.coalesce(F.flatten(F.transform("rows", lambda x: x["t"])), F.array().cast("array<int>"))
    return joined.select("table", "ix", "budget", F.concat("head", body).alias("tokens"))


def serialised(cells: DataFrame, names: DataFrame, vectors: DataFrame, most: int = 512, k: int = 4, weight: float = 0.5, boundary: bool = False) -> DataFrame:
    """``(table, target, tokens, roles)`` for every column of every table: role 0 is the target, role n its nth context.

    ``vectors(table, ix, vector)`` are the columns' embeddings. What is beyond ``most`` tokens is cut, and the start mark of the
    target is at place 0. No columns give no rows.
    """
    sizes = names.groupBy("table").agg(F.count("*").alias("n"))
    budgets = stash(sizes.select("table", column_budget(F.lit(1) + F.least(F.col("n") - 1, F.lit(k)), most).alias("budget")), "budgets")
    tokens = stash(column_tokens(cells, names, budgets, boundary), "tokens").select("table", "ix", "tokens")
    chosen = contexts(vectors, k, weight).select("table", "target", F.col("context").alias("ix"), "place")
    own = names.select("table", F.col("ix").alias("target"), "ix", F.lit(0).cast("long").alias("place"))
    parts = own.union(chosen).join(tokens, ["table", "ix"])
    listed = F.array_sort(F.collect_list(F.struct("place", "tokens")))
    rows = parts.groupBy("table", "target").agg(listed.alias("p"))
    roles = F.flatten(F.transform("p", lambda x: F.transform(x["tokens"], lambda _: x["place"].cast("int"))))
    return rows.select("table", "target", F.slice(F.flatten(F.transform("p", lambda x: x["tokens"])), 1, most).alias("tokens"), F.slice(roles, 1, most).alias("roles"))
