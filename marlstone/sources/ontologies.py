"""Class definitions from JSON-LD graphs, OWL in RDF/XML, and Turtle.

All three give ``(id, label, comment, parents)`` rows. JSON-LD and Turtle come as a table of documents, so that they
may lie in files of their own or be delimited in large ones; XML comes from files, read by row tag. A
document that cannot be parsed gives no rows and does not stop the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.storage import stash

#: Most parents in a class's sentence, and most characters of its comment.
MOST_PARENTS, MOST_COMMENT = 5, 400


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``(source, text)``: a row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


# ---- JSON-LD


def _member(node: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, f"$['{name}']", kind)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _none(v: Column) -> Column:
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(True))


def _items(v: Column) -> Column:
    """A field's values: none for null, one for an object or scalar, else the list's."""
    alone = F.when(_none(v), F.array().cast("array<variant>")).otherwise(F.array(v))
    return F.filter(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), alone), lambda x: ~_none(x))


def _ids(v: Column) -> Column:
    """Identifiers of a field's values: of objects their id (empty if they have none), of scalars themselves."""
    return F.transform(_items(v), lambda x: F.when(_is_object(x), F.coalesce(_member(x, "@id", "string"), F.lit(""))).otherwise(F.try_variant_get(x, "$", "string")))


def _text(v: Column) -> Column:
    """A field's first value: of an object the ``@value``; empty where there is none."""
    first = F.get(_items(v), F.lit(0))
    return F.coalesce(F.when(_is_object(first), _member(first, "@value", "string")).otherwise(F.try_variant_get(first, "$", "string")), F.lit(""))


def json_ld(documents: DataFrame) -> DataFrame:
    """``(kind, id, label, comment, parents, domains, ranges)`` of ``documents(source, text)``.

    ``kind`` is class or property, from a node's type; nodes of other types and of no id are left out. Every field may be null,
    an object, a list or a scalar. An empty label is the id behind its last colon. Of several nodes
    with one id and kind the last stands, by source and place in its graph. Documents that are no JSON, or have no graph, give no rows.
    """
    parsed = documents.select("source", F.try_parse_json("text").alias("v"))
    nodes = parsed.select("source", F.posexplode(_member(F.col("v"), "@graph", "array<variant>")).alias("at", "n")).where(_is_object(F.col("n")))
    n = F.col("n")
    kind = F.when(_member(n, "@type", "string") == "rdfs:Class", "class").when(_member(n, "@type", "string") == "rdf:Property", "property")
    label = _text(_member(n, "rdfs:label"))
    id = _member(n, "@id", "string")
    rows = nodes.select(
        "source", "at", kind.alias("kind"), id.alias("id"), F.when(label != "", label).otherwise(F.element_at(F.split(id, ":"), -1)).alias("label"),
        F.trim(F.regexp_replace(_text(_member(n, "rdfs:comment")), r"\s+", " ")).alias("comment"), _ids(_member(n, "rdfs:subClassOf")).alias("parents"),
        _ids(_member(n, "schema:domainIncludes")).alias("domains"), _ids(_member(n, "schema:rangeIncludes")).alias("ranges"),
    ).where("kind IS NOT NULL AND id IS NOT NULL")
    last = rows.groupBy("kind", "id").agg(F.max_by(F.struct("label", "comment", "parents", "domains", "ranges"), F.struct("source", "at")).alias("r"))
    return last.select("kind", "id", "r.*")


# ---- OWL in RDF/XML

_CLASS = (
    "`_rdf:about` string, `_rdf:ID` string, `rdfs:label` array<string>, `rdfs:comment` array<string>, "
    "`rdfs:subClassOf` array<struct<`_rdf:resource`: string, `owl:Class`: struct<`_rdf:about`: string>>>, __broken string"
)


def owl_classes(spark: SparkSession, path: str) -> DataFrame:
    """``(id, label, comment, parents)`` of the ``owl:Class`` elements in the files of ``path``.

    Elements with one id are one class: parents (by resource, or of a nested class) are listed by file and place,
    and the last label and the last comment stand. Elements without an id are left out. A file with an element that cannot be parsed is skipped.
    """
    read = spark.read.format("xml").option("rowTag", "owl:Class").option("columnNameOfCorruptRecord", "__broken").option("mode", "PERMISSIVE").schema(_CLASS).load(path)
    rows = read.select("*", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = stash(rows, "elements")  # parsed once; what is broken is known only then
    broken = rows.groupBy("source").agg(F.max(F.col("__broken").isNotNull()).alias("is_broken")).where("is_broken").select("source")
    rows = rows.join(broken, "source", "left_anti")
    nested = F.transform("rdfs:subClassOf", lambda p: F.coalesce(p["_rdf:resource"], p["owl:Class"]["_rdf:about"]))
    parents = F.filter(F.coalesce(nested, F.array().cast("array<string>")), lambda p: F.coalesce(p != "", F.lit(False)))
    place = F.struct("source", "block", "at")
    rows = rows.select(
        F.coalesce("`_rdf:about`", "`_rdf:ID`").alias("id"), F.trim(F.try_element_at("rdfs:label", F.lit(-1))).alias("label"), F.trim(F.try_element_at("rdfs:comment", F.lit(-1))).alias("comment"),
        parents.alias("parents"), place.alias("place"),
    ).where("id <> ''")
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place"))), F.lit(""))
    merged = rows.groupBy("id").agg(last("label").alias("label"), last("comment").alias("comment"), F.array_sort(F.collect_list(F.struct("place", "parents"))).alias("listed"))
    return merged.select("id", "label", "comment", F.flatten(F.transform("listed", lambda x: x["parents"])).alias("parents"))


# ---- Turtle

_NAME = r"<[^>]+>|[a-zA-Z_][a-zA-Z0-9_-]*:\S+"


def _expanded(name: Column, prefixes: Column) -> Column:
    """A prefixed name in full, by the last of its document's lines for the prefix; other names without their brackets."""
    prefix, local = F.regexp_extract(name, r"^([^:]*):", 1), F.regexp_extract(name, r"(?s)^[^:]*:(.*)$", 1)
    known = F.filter(prefixes, lambda p: p["prefix"] == prefix)
    full = F.concat(F.try_element_at(known, F.lit(-1))["base"], local)
    return F.when(~name.startswith("<") & name.contains(":") & full.isNotNull(), full).otherwise(F.regexp_replace(name, r"^[<>]+|[<>]+$", ""))


def turtle_classes(documents: DataFrame) -> DataFrame:
    """``(source, block, id, label, comment, parents)`` of ``documents(source, text)``: a row for each block whose first statement makes a class.

    Blocks are parted by blank lines. The label falls back to the preferred label; the comment to the definition, then the
    scope note; empty where there is none. Lines of ``###`` are no part of a block.
    """
    found = lambda g: F.regexp_extract_all("text", F.lit(r"@prefix\s+(\S+)\s*:\s*<([^>]+)>\s*\."), F.lit(g))
    prefixes = F.zip_with(found(1), found(2), lambda p, b: F.named_struct(F.lit("prefix"), p, F.lit("base"), b))
    blocks = documents.where("text IS NOT NULL").select("source", prefixes.alias("prefixes"), F.posexplode(F.split("text", r"\n\s*\n")).alias("block", "raw"))
    blocks = blocks.withColumn("b", F.trim(F.regexp_replace("raw", r"(?m)^\s*###.*$", ""))).withColumn("b", F.regexp_replace("b", r"^\s+|\s+$", ""))
    head = F.regexp_extract("b", rf"^\s*({_NAME})\s+(?:a|rdf:type)\s+(?:owl:Class|rdfs:Class)\b", 1)
    blocks = blocks.withColumn("head", head).where("head <> ''")

    def first(*names: str) -> Column:
        texts = [F.trim(F.regexp_extract("b", rf'{n}\s+"([^"]+)"', 1)) for n in names]
        return F.coalesce(*(F.when(t != "", t) for t in texts), F.lit(""))

    parents = F.regexp_extract_all("b", F.lit(rf"rdfs:subClassOf\s+({_NAME})"), F.lit(1))
    return blocks.select(
        "source", "block", _expanded(F.col("head"), F.col("prefixes")).alias("id"), first("rdfs:label", "skos:prefLabel").alias("label"),
        first("rdfs:comment", "skos:definition", "skos:scopeNote").alias("comment"), F.transform(parents, lambda p: _expanded(p, F.col("prefixes"))).alias("parents"),
    )


# ---- sentences


def short_name(iri: Column) -> Column:
    """What follows the last hash sign, else the last slash, of an IRI."""
    s = F.regexp_replace(iri, "/+$", "")
    return F.when(s.contains("#"), F.element_at(F.split(s, "#"), -1)).otherwise(F.element_at(F.split(s, "/"), -1))


def sentences(source_name: str) -> Column:
    """A class's definition in lines: its parents, its comment, its IRI."""
    name = F.when(F.col("label") != "", F.col("label")).otherwise(short_name(F.col("id")))
    named = F.transform(F.slice("parents", 1, MOST_PARENTS), short_name)
    kind = F.when(F.size("parents") > 0, F.concat(F.lit("a subclass of "), F.array_join(named, ", "))).otherwise(F.lit("a top-level class"))
    comment = F.when(F.col("comment") != "", F.concat(name, F.lit(": "), F.substring(F.replace("comment", F.lit("\n"), F.lit(" ")), 1, MOST_COMMENT)))
    return F.concat_ws("\n", F.concat(F.lit(f"In the {source_name} ontology, "), name, F.lit(" is "), kind, F.lit(".")), comment, F.concat(F.lit("The full IRI for "), name, F.lit(" is <"), "id", F.lit(">.")))
