"""One template of entities and references, laid out as tables in five ways, with keys that always resolve.

A template says what entities there are, what each is described by and what it refers to. Layouts are
normalised tables, entity-attribute-value tables, junctions, a star and a snowflake. Tables are made in the
order of their references. Where rows have no references of their own, keys are drawn from the pool of
the entity they refer to by joining on the keys' ranks, so that no key can be missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.windows import numbered

LAYOUTS = ("normalised", "eav", "junction", "star", "snowflake")


@dataclass(frozen=True)
class Entity:
    """``references`` maps a column to the entity whose key it holds."""

    name: str
    key: str
    attributes: tuple[str, ...]
    references: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Table:
    """A table of a layout: its rows, its key (None where there is none), and ``(column, table, key)`` of what it refers to."""

    rows: DataFrame
    key: str | None
    references: tuple[tuple[str, str, str], ...] = ()


def in_order(template: tuple[Entity, ...]) -> list[Entity]:
    """Entities behind all that they refer to, else in the template's order; an error for unknown entities, repeated names and circles."""
    names = [e.name for e in template]
    if len({*names}) < len(names) or any(t not in names for e in template for _, t in e.references):
        raise ValueError("entities must have names of their own and refer to entities of the template")
    out: list[Entity] = []
    while len(out) < len(template):
        met = {e.name for e in out}
        ready = [e for e in template if e.name not in met and all(t in met for _, t in e.references)]
        if not ready:
            raise ValueError("the references form a circle")
        out += ready
    return out


def drawn_keys(rows: DataFrame, id: str, pool: DataFrame, key: str, name: str, seed: int = 0) -> DataFrame:
    """``rows`` with ``name``, a key of ``pool`` for each row: that at the rank which the SHA-256 of seed and id gives, modulo the pool's size.

    Ranks are places in the order of the distinct keys, numbered by ranges. An empty pool is an error, unless there are no rows.
    """
    keys = numbered(pool.select(F.col(key).alias("__key")).where("__key IS NOT NULL").distinct(), [F.col("__key")], "__rank")
    n = keys.count()
    if not n and not rows.isEmpty():
        raise ValueError("there is no key to refer to")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")).cast("binary"), 256)
    wanted = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % max(n, 1)
    return rows.withColumn("__rank", wanted).join(keys, "__rank").select(*rows.columns, F.col("__key").alias(name))


def realised(template: tuple[Entity, ...], frames: dict[str, DataFrame], layout: str) -> dict[str, Table]:
    """The tables of a layout, in the order of their references. ``frames`` has each entity's rows with its key, attributes and reference columns.

    Null references stay null. In the eav layout values are strings and null ones have no row; in the junction
    layout a reference that is null has no row. The star's facts are the entities that nothing refers to; what they refer to are
    its dimensions, into which all that lies behind is folded. The snowflake gives facts references alone besides their key and keeps the dimensions apart.
    """
    order = in_order(template)
    by = {e.name: e for e in order}
    met = {t for e in order for _, t in e.references}
    facts = [e for e in order if e.name not in met]
    every = lambda e: frames[e.name].select(e.key, *(c for c, _ in e.references), *e.attributes)
    links = lambda e: tuple((c, t, by[t].key) for c, t in e.references)
    if layout == "normalised":
        return {e.name: Table(every(e), e.key, links(e)) for e in order}
    if layout == "eav":
        out = {e.name: Table(every(e).select(e.key, *(c for c, _ in e.references)), e.key, links(e)) for e in order}
        for e in order:
            if e.attributes:
                pairs = F.inline(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in e.attributes)))
                values = every(e).select(F.col(e.key).alias("entity"), pairs).where("value IS NOT NULL")
                out[f"{e.name}_values"] = Table(values, None, (("entity", e.name, e.key),))
        return out
    if layout == "junction":
        out = {e.name: Table(every(e).select(e.key, *e.attributes), e.key) for e in order}
        for e in order:
            for c, t in e.references:
                rows = every(e).where(F.col(c).isNotNull()).select(F.col(e.key).alias("source"), F.col(c).alias("target"))
                out[f"{e.name}_{c}"] = Table(rows, None, (("source", e.name, e.key), ("target", t, by[t].key)))
        return out
    if layout == "star":
        out = {t: Table(_folded(by[t], by, frames), by[t].key) for t in dict.fromkeys(t for e in facts for _, t in e.references)}
        return out | {e.name: Table(every(e), e.key, links(e)) for e in facts}
    if layout == "snowflake":
        out = {e.name: Table(every(e), e.key, links(e)) for e in order if e not in facts}
        for e in facts:
            out[f"{e.name}_details"] = Table(every(e).select(e.key, *e.attributes), e.key)
            out[e.name] = Table(every(e).select(e.key, *(c for c, _ in e.references)), e.key, (*links(e), (e.key, f"{e.name}_details", e.key)))
        return out
    raise ValueError(f"{layout} is none of {LAYOUTS}")


def _folded(e: Entity, by: dict[str, Entity], frames: dict[str, DataFrame]) -> DataFrame:
    """An entity's rows with the attributes of all that it refers to, under ``<column>_<attribute>``."""
    rows = frames[e.name].select(e.key, *(c for c, _ in e.references), *e.attributes)
    for c, t in e.references:
        behind = _folded(by[t], by, frames)
        renamed = behind.select(F.col(by[t].key).alias(f"__{c}"), *(F.col(x).alias(f"{c}_{x}") for x in behind.columns if x != by[t].key))
        rows = rows.join(renamed, F.col(c) == F.col(f"__{c}"), "left").drop(f"__{c}")
    return rows


def orphans(tables: dict[str, Table]) -> DataFrame:
    """``(name, n_rows, n_orphans)``: for each table its rows and how many references of them, not null, meet no key."""
    out = None
    for name, t in tables.items():
        counts: list[Column] = [F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.lit(0).cast("long").alias("n_orphans")]
        parts = [t.rows.agg(*counts)]
        for column, target, key in t.references:
            keys = tables[target].rows.select(F.col(key).alias("__k"))
            lost = t.rows.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__k"), "left_anti")
            parts.append(lost.agg(F.lit(name).alias("name"), F.lit(0).cast("long").alias("n_rows"), F.count("*").alias("n_orphans")))
        for p in parts:
            out = p if out is None else out.union(p)
    return out.groupBy("name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_orphans").alias("n_orphans"))
