"""Queries of ontology scans: files of every shape are written from whole tables and read back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.plans.catalog import query
from marlstone.sources import ontologies as O
from marlstone.storage import scratch, table

_K = "c_custkey::VARCHAR"
_ROOT = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'


def _rooted(elements):
    """Rows of elements with a root around those of each part of the table, which is a file."""

    def run(batches):
        yield pa.RecordBatch.from_pydict({"value": [_ROOT]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": ["</rdf:RDF>"]})

    return elements.mapInArrow(run, "value string")


def _k(step: int = 0):
    return (F.col("c_custkey") + step).cast("string")


@query(
    "src_19_json_ld_shapes",
    f"""SELECT CASE WHEN c_custkey % 5 = 4 THEN 'property' ELSE 'class' END AS kind, 'ex:c' || c_custkey AS id,
CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 2 THEN c_name ELSE 'c' || c_custkey END AS label, c_mktsegment || ' customer' AS comment,
CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'ex:c' || (c_custkey + 1) ELSE 'ex:c' || (c_custkey + 1) || ',plain,' END AS parents,
CASE WHEN c_custkey % 5 = 4 THEN 'ex:d1,ex:d2' ELSE '' END AS domains FROM customer""",
)
def _(s, d):
    """A document for each hundred customers, delimited in large files: fields that are null, missing, objects, lists and scalars; documents that are cut off between them."""
    k = _k()
    label = F.when(F.col("c_custkey") % 4 == 0, F.to_json(F.struct(F.col("c_name").alias("@value")))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit('["'), "c_name", F.lit('", "second"]')))
    label = label.when(F.col("c_custkey") % 4 == 2, F.concat(F.lit('"'), "c_name", F.lit('"'))).otherwise("null")
    above = F.concat(F.lit('{"@id": "ex:c'), _k(1), F.lit('"}'))
    parents = F.when(F.col("c_custkey") % 3 == 0, F.lit("null")).when(F.col("c_custkey") % 3 == 1, above).otherwise(F.concat(F.lit("["), above, F.lit(', "plain", {"no": "id"}]')))
    prop = F.col("c_custkey") % 5 == 4
    domains = F.when(prop, F.lit(', "schema:domainIncludes": [{"@id": "ex:d1"}, {"@id": "ex:d2"}]')).otherwise("")
    node = F.concat(
        F.lit('{"@id": "ex:c'), k, F.lit('", "@type": "'), F.when(prop, "rdf:Property").otherwise("rdfs:Class"), F.lit('", "rdfs:label": '), label,
        F.lit(', "rdfs:comment": ["'), "c_mktsegment", F.lit(' \\n  customer "], "rdfs:subClassOf": '), parents, domains, F.lit("}"),
    )
    docs = table(s, d, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("g")).agg(F.array_join(F.array_sort(F.collect_list(node)), ", ").alias("nodes"))
    whole = docs.select(F.concat(F.lit('{"@context": {}, "@graph": ["no node", '), "nodes", F.lit("]}")).alias("value"))
    path = scratch(s, "json-ld")
    whole.union(whole.select(F.substring("value", 1, 60))).write.option("lineSep", "\x03").text(path)
    read = s.read.option("lineSep", "\x03").text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    return O.json_ld(read).select("kind", "id", "label", "comment", F.array_join("parents", ",").alias("parents"), F.array_join("domains", ",").alias("domains"))


@query(
    "src_20_owl_classes",
    f"""SELECT 'http://ex.org/c#' || c_custkey AS id, 'In the test ontology, ' || name || ' is ' || kind || '.' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN name || ': of ' || c_mktsegment || chr(10) ELSE '' END || 'The full IRI for ' || name || ' is <http://ex.org/c#' || c_custkey || '>.' AS doc
FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'renamed ' || {_K} ELSE c_name END AS name, CASE c_custkey % 4 WHEN 0 THEN 'a subclass of ' || (c_custkey + 1) || ', ' || (c_custkey + 2) WHEN 1 THEN 'a subclass of ' || (c_custkey + 1) ELSE CASE WHEN c_custkey % 3 = 0 THEN 'a subclass of late' ELSE 'a top-level class' END END || CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 < 2 THEN ', late' ELSE '' END AS kind FROM customer)""",
)
def _(s, d):
    """Two folders of files: classes with two parents, a nested one or none; then additions to some of them, later in order; and a file that breaks off."""
    k, c = _k(), F.col("c_custkey")
    resource = lambda step: F.concat(F.lit('<rdfs:subClassOf rdf:resource="http://ex.org/c#'), _k(step), F.lit('"/>'))
    nested = F.concat(F.lit('<rdfs:subClassOf><owl:Class rdf:about="http://ex.org/c#'), _k(1), F.lit('"/></rdfs:subClassOf>'))
    parents = F.when(c % 4 == 0, F.concat(resource(1), resource(2))).when(c % 4 == 1, nested).otherwise("")
    comment = F.when(c % 2 == 0, F.concat(F.lit("<rdfs:comment>of "), "c_mktsegment", F.lit("</rdfs:comment>"))).otherwise("")
    about = F.when(c % 2 == 0, "rdf:about").otherwise("rdf:ID")
    head = F.concat(F.lit("<owl:Class "), about, F.lit('="http://ex.org/c#'), k, F.lit('">'))
    first = F.concat(head, F.lit('<rdfs:label xml:lang="en">'), "c_name", F.lit("</rdfs:label>"), parents, comment, F.lit("</owl:Class>"))
    second = F.concat(head, F.lit('<rdfs:label>renamed '), k, F.lit('</rdfs:label><rdfs:subClassOf rdf:resource="http://ex.org/c#late"/></owl:Class>'))
    rows, path = table(s, d, "customer"), scratch(s, "owl")
    _rooted(rows.select(first.alias("value"))).write.text(f"{path}/part=1")
    _rooted(rows.where("c_custkey % 3 = 0").select(second.alias("value"))).write.text(f"{path}/part=2")
    lost = F.concat(first, F.lit("<owl:Class rdf:about='broken'><rdfs:label>a</rdfs:comment></owl:Class>"))
    _rooted(rows.where("c_custkey % 3 = 1").select(F.replace(lost, F.lit("c#"), F.lit("lost#")).alias("value")).coalesce(1)).write.text(f"{path}/part=3")
    return O.owl_classes(s, f"{path}/*").select("id", O.sentences("test").alias("doc"))


@query(
    "src_21_turtle_classes",
    """SELECT 'http://' || CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END || '.org/' || c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE c_name END AS label,
CASE c_custkey % 4 WHEN 0 THEN 'comment' WHEN 1 THEN 'definition' WHEN 2 THEN 'note' ELSE '' END AS comment, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'http://full.org/x,none:y,http://b.org/z' END AS parents FROM customer""",
)
def _(s, d):
    """A document for each hundred customers: prefixes that the last line decides, fallbacks of labels and comments, and blocks that make no class."""
    c = F.col("c_custkey")
    subject = F.concat(F.when(c % 2 == 0, "a:").otherwise("<http://b.org/"), _k(), F.when(c % 2 == 0, "").otherwise(">"))
    label = F.when(c % 3 == 0, F.concat(F.lit(' ;\n rdfs:label "'), "c_name", F.lit('"@en'))).when(c % 3 == 1, F.concat(F.lit(' ;\n skos:prefLabel "'), "c_name", F.lit('"'))).otherwise("")
    comment = F.when(c % 4 == 0, F.lit(' ;\n skos:definition "other" ;\n rdfs:comment "comment"')).when(c % 4 == 1, F.lit(' ;\n skos:scopeNote "other" ;\n skos:definition "definition"'))
    comment = comment.when(c % 4 == 2, F.lit(' ;\n skos:scopeNote "note"')).otherwise("")
    parents = F.when(c % 5 == 0, "").otherwise(" ;\n rdfs:subClassOf <http://full.org/x> ;\n rdfs:subClassOf none:y ;\n rdfs:subClassOf b:z")
    block = F.concat(F.lit("###  "), _k(), F.lit("\n"), subject, F.when(c % 2 == 0, " a owl:Class").otherwise(" rdf:type rdfs:Class"), label, comment, parents, F.lit(" ."))
    rows = table(s, d, "customer").groupBy(F.floor(c / 100).alias("g")).agg(F.array_join(F.array_sort(F.collect_list(block)), "\n  \n").alias("blocks"))
    head = "@prefix a: <http://wrong.org/> .\n@prefix b: <http://b.org/> .\n@prefix a: <http://a.org/> .\n\na:p a owl:ObjectProperty ;\n rdfs:domain [ a owl:Class ] .\n\n"
    path = scratch(s, "turtle")
    rows.select(F.concat(F.lit(head), "blocks").alias("value")).write.option("lineSep", "\x03").text(path)
    read = s.read.option("lineSep", "\x03").text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    return O.turtle_classes(read).select("id", "label", "comment", F.array_join("parents", ",").alias("parents"))
