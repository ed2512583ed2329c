"""Tree, edge, ontology and storage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import edges, find, ontology, storage, tree
from ..registry import Registry
from . import bindings as b

R = Registry()


@R.query("sibling_edges", f"""WITH {b.ELEMENTS}, n AS (SELECT element_id, lead(element_id) OVER w AS nx, lag(element_id) OVER w AS pv
  FROM elements WHERE parent_id IS NOT NULL WINDOW w AS (PARTITION BY doc_id, parent_id ORDER BY position, element_id))
SELECT element_id AS source_id, 'next_sibling' AS relationship_type, nx AS target_reference FROM n WHERE nx IS NOT NULL
UNION ALL SELECT element_id, 'previous_sibling', pv FROM n WHERE pv IS NOT NULL""")
def sibling_edges(spark, sf_dir):
    return tree.siblings(b.elements(spark, sf_dir))


@R.query("containment_edges", f"""WITH {b.ELEMENTS} SELECT parent_id AS source_id, 'contains' AS relationship_type, element_id AS target_reference FROM elements WHERE parent_id IS NOT NULL
UNION ALL SELECT element_id, 'contained_by', parent_id FROM elements WHERE parent_id IS NOT NULL""")
def containment_edges(spark, sf_dir):
    return tree.containment(b.elements(spark, sf_dir))


@R.query("header_sections", f"""WITH {b.ELEMENTS}, open AS (
  SELECT e.element_id, arg_max(h.element_id, h.position) AS section_id FROM elements e LEFT JOIN elements h
    ON h.doc_id = e.doc_id AND h.element_type = 'header' AND h.position < e.position
   AND (e.level IS NULL OR h.level < e.level)
   AND NOT EXISTS (SELECT 1 FROM elements m WHERE m.doc_id = e.doc_id AND m.element_type = 'header'
                   AND m.position > h.position AND m.position < e.position AND m.level <= h.level)
  GROUP BY e.element_id)
SELECT element_id, section_id FROM open""")
def header_sections(spark, sf_dir):
    return tree.sections(b.elements(spark, sf_dir), levels=2)


@R.query("ancestry", f"""WITH RECURSIVE {b.ELEMENTS.replace("lines AS", "lines AS", 1)}, tagged AS (
  SELECT element_id, CASE WHEN position > 3 THEN doc_id || '#' || (SELECT min(l.pos) FROM lines l WHERE l.doc_id = elements.doc_id) ELSE parent_id END AS parent_id
  FROM elements), walk AS (
  SELECT element_id, [parent_id] AS path FROM tagged WHERE parent_id IS NOT NULL AND parent_id <> element_id
  UNION ALL SELECT w.element_id, list_append(w.path, t.parent_id) FROM walk w JOIN tagged t ON t.element_id = w.path[-1]
  WHERE t.parent_id IS NOT NULL AND NOT list_contains(w.path, t.parent_id) AND t.parent_id <> w.element_id)
SELECT element_id, max(len(path))::INT AS depth, arg_max(path, len(path))[-1] AS root FROM walk GROUP BY element_id""")
def ancestry(spark, sf_dir):
    e = b.elements(spark, sf_dir)
    first = b.lines(spark, sf_dir).groupBy("doc_id").agg(F.min("pos").alias("first"))
    deep = e.join(first, "doc_id", "left").withColumn(
        "parent_id", F.when(F.col("position") > 3, F.concat_ws("#", "doc_id", "first")).otherwise(F.col("parent_id"))
    )
    paths = tree.ancestry(deep)
    return paths.where(F.size("ancestor_ids") > 0).select("element_id", F.size("ancestor_ids").alias("depth"), F.element_at("ancestor_ids", -1).alias("root"))


@R.query("results_outline", f"""WITH {b.ELEMENTS}, hits AS (SELECT element_id, doc_id, length(text)::DOUBLE AS score FROM elements WHERE length(text) BETWEEN 60 AND 70)
SELECT element_id, score FROM hits UNION ALL SELECT DISTINCT doc_id::VARCHAR, NULL FROM hits""")
def results_outline(spark, sf_dir):
    e = b.elements(spark, sf_dir)
    hits = e.where(F.length("text").between(60, 70)).select("element_id", F.length("text").cast("double").alias("score"))
    return tree.outline(hits, e)


@R.query("context_neighbours", f"""WITH {b.ELEMENTS} SELECT element_id, coalesce(lag(element_id, 2) OVER w, '') || ',' || coalesce(lag(element_id) OVER w, '') AS before,
  coalesce(lead(element_id) OVER w, '') AS after FROM elements WHERE element_type <> 'root' WINDOW w AS (PARTITION BY doc_id ORDER BY position, element_id)""")
def context_neighbours(spark, sf_dir):
    near = tree.neighbours(b.elements(spark, sf_dir), 2, 1)
    p, n = F.col("predecessors"), F.size("predecessors")
    two = F.concat_ws(",", F.when(n > 1, p[0]).otherwise(""), F.when(n > 0, F.element_at(p, -1)).otherwise(""))
    return near.select("element_id", two.alias("before"), F.coalesce(F.get("successors", F.lit(0)), F.lit("")).alias("after"))


@R.query("token_budget", f"""WITH {b.ELEMENTS}, t AS (SELECT element_id, sum(greatest(length(text) // 4, len(regexp_extract_all(text, '\\S+')) * 4 // 3)) OVER
  (PARTITION BY doc_id ORDER BY position, element_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM elements)
SELECT element_id, used FROM t WHERE used <= 200""")
def token_budget(spark, sf_dir):
    return tree.within_budget(b.elements(spark, sf_dir), vectors.token_estimate(F.col("text")), 200).select("element_id", "used")


@R.query("speaker_runs", """WITH c AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, turn, sum((p IS NULL OR p <> role)::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM c""")
def speaker_runs(spark, sf_dir):
    return tree.runs(b.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "run")


@R.query("document_text", f"""WITH {b.ELEMENTS} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY position) AS text FROM elements WHERE trim(text) <> '' GROUP BY doc_id""")
def document_text(spark, sf_dir):
    return tree.full_text(b.elements(spark, sf_dir))


@R.query("document_markdown", f"""WITH {b.ELEMENTS} SELECT doc_id, string_agg(CASE WHEN level IS NULL THEN text ELSE repeat('#', level) || ' ' || text END, chr(10) || chr(10) ORDER BY position) AS markdown
FROM elements WHERE trim(text) <> '' GROUP BY doc_id""")
def document_markdown(spark, sf_dir):
    return tree.as_markdown(b.elements(spark, sf_dir))


@R.query("document_html", f"""WITH {b.ELEMENTS}, t AS (SELECT *, CASE WHEN level IS NULL THEN 'p' ELSE 'h' || level END AS tag FROM elements WHERE trim(text) <> '')
SELECT doc_id, string_agg('<' || tag || '>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || tag || '>', chr(10) ORDER BY position) AS html FROM t GROUP BY doc_id""")
def document_html(spark, sf_dir):
    return tree.as_html(b.elements(spark, sf_dir))


@R.query("complete_documents", f"""WITH {b.ELEMENTS} SELECT doc_id, any_value(source) AS source, coalesce(string_agg(CASE WHEN trim(text) <> '' THEN text END, chr(10) || chr(10) ORDER BY position), '') AS text,
  count(*) AS elements, 2 * greatest(count(*) - 2, 0) AS edges FROM elements GROUP BY doc_id""")
def complete_documents(spark, sf_dir):
    e = b.elements(spark, sf_dir)
    full = tree.complete(b.table(spark, sf_dir, "documents").select("doc_id", "source"), e, tree.siblings(e))
    return full.select("doc_id", "source", "text", F.size("elements").cast("long").alias("elements"), F.size("edges").cast("long").alias("edges"))


@R.query("document_formats", f"WITH {b.ELEMENTS} SELECT doc_id, CASE WHEN bool_or(element_type = 'header') THEN 'markdown' ELSE 'text' END AS format FROM elements GROUP BY doc_id")
def document_formats(spark, sf_dir):
    return tree.detected_format(b.elements(spark, sf_dir))


LINKS = """links AS (SELECT element_id, doc_id, CASE WHEN position % 3 = 0 THEN '#' || doc_id || '#0' WHEN position % 3 = 1 THEN lower(text) ELSE 'https://example.org/' || position END AS target, text FROM elements WHERE element_type = 'header')"""


@R.query("explicit_links", f"""WITH {b.ELEMENTS}, {LINKS},
h AS (SELECT doc_id, lower(trim(text)) AS name, arg_min(element_id, {{'p': position, 'e': element_id}}) AS t FROM elements WHERE element_type = 'header' GROUP BY ALL),
found AS (SELECT l.element_id, coalesce(a.element_id, least(h1.t, h2.t)) AS t FROM links l
  LEFT JOIN elements a ON a.doc_id = l.doc_id AND l.target = '#' || a.element_id
  LEFT JOIN h h1 ON h1.doc_id = l.doc_id AND h1.name = lower(trim(l.text))
  LEFT JOIN h h2 ON h2.doc_id = l.doc_id AND h2.name = lower(trim(l.target)))
SELECT element_id AS source_id, 'link' AS relationship_type, target AS target_reference FROM links
UNION ALL SELECT DISTINCT t, 'referenced_by', element_id FROM found WHERE t IS NOT NULL""")
def explicit_links(spark, sf_dir):
    e = b.elements(spark, sf_dir)
    p = F.col("position") % 3
    target = F.when(p == 0, F.concat(F.lit("#"), F.col("doc_id").cast("string"), F.lit("#0"))).when(p == 1, F.lower("text")).otherwise(
        F.concat(F.lit("https://example.org/"), F.col("position").cast("string"))
    )
    links = e.where("element_type = 'header'").select("element_id", "doc_id", target.alias("target"), "text")
    return edges.explicit_links(links, e)


@R.query("edge_targets", f"""WITH {b.ELEMENTS} SELECT element_id AS source_id, CASE WHEN position = 1 THEN 'https://example.org' ELSE parent_id END AS target_reference,
  CASE WHEN position = 1 THEN NULL ELSE 'root' END AS target_type FROM elements WHERE parent_id IS NOT NULL""")
def edge_targets(spark, sf_dir):
    e = b.elements(spark, sf_dir)
    own = e.where("parent_id IS NOT NULL").select(
        F.col("element_id").alias("source_id"), F.when(F.col("position") == 1, "https://example.org").otherwise(F.col("parent_id")).alias("target_reference")
    )
    return edges.outgoing(own, e).select("source_id", "target_reference", "target_type")


@R.query("edge_categories", f"""WITH {b.ELEMENTS} SELECT 'STRUCTURAL' AS category, 2 * count(*) AS n FROM elements WHERE parent_id IS NOT NULL""")
def edge_categories(spark, sf_dir):
    return tree.containment(b.elements(spark, sf_dir)).groupBy(edges.category(F.col("relationship_type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@R.query("semantic_pairs", f"""WITH {b.VECTORS}, p AS (
  SELECT a.doc_id, a.element_pk AS source_id, c.element_pk AS target_reference, list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS similarity
  FROM vectors a JOIN vectors c ON a.doc_id = c.doc_id AND a.element_pk < c.element_pk),
n AS (SELECT doc_id, count(*) * 5 AS most FROM vectors GROUP BY doc_id)
SELECT source_id, target_reference, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, source_id, target_reference) AS nth FROM p WHERE similarity >= 0.05)
JOIN n USING (doc_id) WHERE nth <= most""")
def semantic_pairs(spark, sf_dir):
    rows = b.vectors(spark, sf_dir).withColumn("position", F.col("element_pk"))
    return edges.semantic_pairs(rows, threshold=0.05).withColumn("similarity", F.round("similarity", 6))


@R.query("semantic_sections", f"""WITH {b.VECTORS}, p AS (
  SELECT a.element_pk AS source_id, c.element_pk AS target_reference, list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS similarity
  FROM vectors a JOIN vectors c ON a.doc_id <> c.doc_id)
SELECT source_id, target_reference, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY similarity DESC, target_reference) AS nth FROM p WHERE similarity >= 0.2) WHERE nth <= 20""")
def semantic_sections(spark, sf_dir):
    v = b.vectors(spark, sf_dir)
    return edges.semantic_sections(v, v, threshold=0.2).withColumn("similarity", F.round("similarity", 6))


@R.query("entity_pairs", """SELECT DISTINCT 's' || s_suppkey AS source_id, 'c' || c_custkey AS target_id FROM supplier JOIN customer ON s_nationkey = c_nationkey""")
def entity_pairs(spark, sf_dir):
    s = b.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.lit("supplier").alias("entity_type"), F.col("s_nationkey").alias("nation"))
    c = b.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"), F.lit("customer").alias("entity_type"), F.col("c_nationkey").alias("nation"))
    return edges.entity_pairs(s.union(c), "supplier", "customer", same=["nation"])


TERMS = ontology.Ontology(
    "demo",
    {"article": "Article", "ending": "Ending", "shout": "Shout"},
    {
        "article": (ontology.Rule("keywords", ("the", "with"), 0.9),),
        "ending": (ontology.Rule("regex", (r"tion[ .,]",), 0.8, "header"), ontology.Rule("keywords", ("was",), 0.7)),
        "shout": (ontology.Rule("regex", (r"[A-Z]{4,}",), 1.0, "para.*"),),
    },
    (ontology.RelationshipRule("demo:precedes", "ending", "article", "document", "forward", "average", 0.8),),
)
MAPPED_ROWS = """mapped AS (
  SELECT element_id, 'article' AS term, 0.9::DOUBLE AS confidence FROM elements WHERE regexp_matches(text, '(?i)\\b(?:the|with)\\b')
  UNION ALL SELECT element_id, 'ending', CASE WHEN element_type = 'header' AND regexp_matches(text, 'tion[ .,]') THEN 0.8 ELSE 0.7 END::DOUBLE FROM elements
  WHERE (element_type = 'header' AND regexp_matches(text, 'tion[ .,]')) OR regexp_matches(text, '(?i)\\b(?:was)\\b')
  UNION ALL SELECT element_id, 'shout', 1.0::DOUBLE FROM elements WHERE element_type = 'paragraph' AND regexp_matches(text, '[A-Z]{4,}'))"""
MAPPED = f"{b.ELEMENTS}, {MAPPED_ROWS}"


@R.query("term_mappings", f"WITH {MAPPED} SELECT element_id, term, 'demo' AS domain, confidence FROM mapped")
def term_mappings(spark, sf_dir):
    return ontology.map_terms(b.elements(spark, sf_dir), TERMS).select("element_id", "term", "domain", "confidence")


@R.query("term_relationships", f"""WITH {MAPPED}, p AS (SELECT m.*, doc_id, position FROM mapped m JOIN elements USING (element_id))
SELECT a.element_id AS source_id, 'demo:precedes' AS relationship_type, c.element_id AS target_reference, (a.confidence + c.confidence) / 2 AS confidence
FROM p a JOIN p c ON a.doc_id = c.doc_id AND a.position < c.position WHERE a.term = 'ending' AND c.term = 'article' AND (a.confidence + c.confidence) / 2 >= 0.8""")
def term_relationships(spark, sf_dir):
    e = b.elements(spark, sf_dir)
    return ontology.relate(e, ontology.map_terms(e, TERMS), TERMS.relationships[0])


@R.query("elements_by_term", f"WITH {MAPPED} SELECT element_id, confidence FROM mapped WHERE term = 'article' AND confidence >= 0.5 ORDER BY confidence DESC, element_id LIMIT 50")
def elements_by_term(spark, sf_dir):
    return find.by_term(ontology.map_terms(b.elements(spark, sf_dir), TERMS), "article", 0.5, limit=50)


@R.query("derived_entities", """SELECT 'brand:' || replace(lower(p_brand), '#', '') AS entity_id, 'brand' AS entity_type, p_brand AS name, min(p_partkey) AS first_element, count(*) AS mentions FROM part GROUP BY p_brand""")
def derived_entities(spark, sf_dir):
    found = ontology.derive_entities(b.table(spark, sf_dir, "part"), "brand", F.col("p_brand"), "p_partkey", ["p_type"])
    return found.select("entity_id", "entity_type", "name", "first_element", "mentions")


@R.query("upserted_parts", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_size END AS p_size FROM part UNION ALL SELECT -1, 7")
def upserted_parts(spark, sf_dir):
    part = b.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    new = part.where("p_partkey % 10 = 0").withColumns({"p_size": F.lit(0), "at": F.lit(2)})
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("p_partkey"), F.lit(7).alias("p_size"), F.lit(1).alias("at"))
    old = new.withColumns({"p_size": F.lit(99), "at": F.lit(1)})
    return storage.upsert(part, new.union(old).union(extra), ["p_partkey"], latest_by="at")


@R.query("deleted_documents", f"WITH {b.ELEMENTS} SELECT element_type, count(*) AS n FROM elements WHERE doc_id % 7 <> 0 GROUP BY 1")
def deleted_documents(spark, sf_dir):
    e = b.elements(spark, sf_dir)
    gone = b.table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select("doc_id")
    left = storage.delete_documents({"elements": e, "edges": tree.siblings(e)}, gone, "edges")
    return left["elements"].groupBy("element_type").agg(F.count(F.lit(1)).alias("n"))


@R.query("processing_history", """SELECT user_id AS source_id, arg_max(md5(props), {'t': ts, 'h': md5(props)}) AS content_hash, max(ts) AS last_modified, count(*) AS processing_count FROM events GROUP BY user_id""")
def processing_history(spark, sf_dir):
    runs = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.md5("props").alias("content_hash"), F.col("ts").alias("modified"))
    return storage.history(runs)
