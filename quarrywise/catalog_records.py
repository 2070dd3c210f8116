"""More queries of the catalogue: reviews, editions, integrity, reports and records in other formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _SLUG, ASKED, BOOKS, CHUNKS, ORACLE, VECTORS, _map_sql, _vectors, asked, books, documents, indexed, keyword_sql, query, table
from .catalog_library import HEADED, TAXONOMY, headed
from .functions import markdown
from .operators import chunks, exports, formats, knowledge, library, reviews, search, summaries, taxonomy
from .plans import evidence, packs
from .sources.tables import spread

ORACLE["graph_records"] = f"""
SELECT book_id, other_id, '<edge source="' || book_id || '" target="' || other_id || '"><data key="score">' || score || '</data></edge>' AS graphml, '  _' || book_id || ' -- "' || score || '" --> _' || other_id AS mermaid,
       '{{"data":{{"source":"' || book_id || '","target":"' || other_id || '","score":' || score || '}}}}' AS cytoscape FROM ({ORACLE["book_graph"]})"""
ORACLE["chunk_records"] = ORACLE["chunk_documents"]


# --- reviews and editions

_REVIEWED = f"""(SELECT book_id AS path, CASE WHEN book_id % 17 <> 0 THEN title END AS title, author, CASE WHEN book_id % 4 = 0 THEN [isbns[1], '978' || book_id % 50] WHEN book_id % 3 = 0 THEN isbns ELSE []::VARCHAR[] END AS isbns,
    CASE book_id % 5 WHEN 0 THEN '999' WHEN 1 THEN '332' ELSE '158' END AS primary_class, CASE book_id % 4 WHEN 0 THEN 'folder_path' WHEN 1 THEN 'filename/content keyword' WHEN 2 THEN 'unclassified' END AS source,
    CASE WHEN book_id % 6 = 0 THEN '0.95' END AS explicit, book_id % 7 = 0 AS reviewed, book_id % 19 = 0 AS required, CASE WHEN book_id % 8 = 0 THEN '158.9' END AS outer_class FROM {BOOKS})"""


def _reviewed(spark, sf_dir):
    k = F.col("book_id")
    none = F.array().cast("array<string>")
    return books(spark, sf_dir).select(
        k.alias("path"), F.when(k % 17 != 0, F.col("title")).alias("title"), "author",
        F.when(k % 4 == 0, F.array(F.try_element_at("isbns", F.lit(1)), F.concat(F.lit("978"), (k % 50).cast("string")))).when(k % 3 == 0, F.col("isbns")).otherwise(none).alias("isbns"),
        F.when(k % 5 == 0, "999").when(k % 5 == 1, "332").otherwise("158").alias("primary_class"), F.when(k % 4 == 0, "folder_path").when(k % 4 == 1, "filename/content keyword").when(k % 4 == 2, "unclassified").alias("classification_source"),
        F.when(k % 6 == 0, "0.95").alias("classification_confidence"), (k % 7 == 0).alias("reviewed"), (k % 19 == 0).alias("review_required"), F.when(k % 8 == 0, "158.9").alias("external_class"),
    )


@query(f"""
WITH b AS (SELECT *, CASE WHEN reviewed THEN 1.0 WHEN explicit IS NOT NULL THEN explicit::DOUBLE WHEN source = 'folder_path' THEN 0.72 WHEN source = 'filename/content keyword' THEN 0.55 WHEN source = 'unclassified' THEN 0.0 ELSE 0.25 END AS sure,
           primary_class = '999' OR coalesce(source, '') = 'unclassified' AS open FROM {_REVIEWED}),
k AS (SELECT path, 'duplicate_isbn' AS issue, key FROM (SELECT path, unnest(isbns) AS key FROM b) WHERE key IS NOT NULL
      UNION ALL SELECT path, 'duplicate_title_author', lower(trim(title)) || '|' || lower(trim(author)) FROM b WHERE title IS NOT NULL AND author IS NOT NULL),
d AS (SELECT issue, key FROM k GROUP BY ALL HAVING count(DISTINCT path) > 1)
SELECT path, 'metadata' AS queue, 'no_author' AS issue FROM b WHERE author IS NULL UNION ALL SELECT path, 'metadata', 'no_title' FROM b WHERE title IS NULL UNION ALL SELECT path, 'metadata', 'multiple_isbns_found' FROM b WHERE len(isbns) > 1
UNION ALL SELECT path, 'classification', 'loc_class_conflict' FROM b WHERE outer_class IS NOT NULL AND primary_class <> '158' UNION ALL SELECT path, 'classification', 'unclassified' FROM b WHERE open
UNION ALL SELECT path, 'low_confidence', 'classification_confidence_below_threshold' FROM b WHERE NOT open AND sure < 0.7 UNION ALL SELECT path, 'low_confidence', 'classification_review_required' FROM b WHERE required
UNION ALL SELECT DISTINCT path, 'metadata', issue FROM k JOIN d USING (issue, key)""")
def review_queue(spark, sf_dir):
    """What people should look at in books, of nine kinds."""
    return reviews.issues(_reviewed(spark, sf_dir)).select("path", "queue", "issue").distinct()


_EDITED = f"(SELECT book_id % 4000 AS key, book_id, split_part(title, ' ', 1) || CASE book_id % 4 WHEN 0 THEN '' WHEN 1 THEN ', Second Edition' WHEN 2 THEN ' 3rd edition' ELSE ' Revised Edition' END AS title, author, CASE WHEN book_id % 5 = 0 THEN 'i' || book_id % 10 END AS isbn, CASE WHEN book_id % 3 = 0 THEN (1990 + book_id % 20)::INT END AS y FROM {BOOKS})"


def _edited(spark, sf_dir):
    k = F.col("book_id")
    tail = F.when(k % 4 == 0, "").when(k % 4 == 1, ", Second Edition").when(k % 4 == 2, " 3rd edition").otherwise(" Revised Edition")
    return books(spark, sf_dir).select(
        "book_id", F.concat(F.split("title", " ")[0], tail).alias("title"), "author", F.when(k % 5 == 0, F.concat(F.lit("i"), (k % 10).cast("string"))).alias("isbn"), F.lit(None).cast("string").alias("work_id"),
        F.lit(None).cast("int").alias("edition_number"), F.lit(None).cast("int").alias("edition_year"), F.when(k % 3 == 0, (1990 + k % 20).cast("string")).alias("published"),
    )


EDITIONS = f"""(
SELECT book_id, title, author, isbn, split_part(title, ' ', 1) AS first, CASE book_id % 4 WHEN 0 THEN replace(title, ',', '') WHEN 1 THEN regexp_replace(title, ',.*', '') WHEN 2 THEN split_part(title, ' ', 1) ELSE split_part(title, ' ', 1) END AS canonical_title,
       CASE book_id % 4 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS edition_number, y AS edition_year, book_id % 4 = 3 AS is_revised, CASE book_id % 4 WHEN 1 THEN 'Second Edition' WHEN 2 THEN '3rd Edition' END AS edition_label,
       {_SLUG.format("CASE WHEN author IS NOT NULL THEN author || '_' ELSE '' END || CASE book_id % 4 WHEN 1 THEN regexp_replace(title, ',.*', '') ELSE split_part(title, ' ', 1) END")} AS work_id FROM {_EDITED})"""


@query(f"SELECT book_id, canonical_title, work_id, edition_label, edition_number::INT AS edition_number, edition_year, is_revised FROM {EDITIONS}")
def edition_records(spark, sf_dir):
    """Work and edition of titles."""
    return reviews.edition_records(_edited(spark, sf_dir)).select("book_id", "canonical_title", "work_id", "edition_label", "edition_number", "edition_year", "is_revised")


@query(f"""
WITH e AS (SELECT * FROM {EDITIONS}), f AS (SELECT work_id, min(book_id) AS first_id FROM e GROUP BY work_id)
SELECT a.work_id, a.book_id, b.book_id AS other_id, CASE WHEN a.isbn = b.isbn THEN 'same ISBN, duplicate'
       WHEN a.edition_number <> b.edition_number OR a.edition_year <> b.edition_year THEN 'same work, different edition' ELSE 'same work, possible duplicate' END AS relationship
FROM f JOIN e a ON a.work_id = f.work_id AND a.book_id = f.first_id JOIN e b ON b.work_id = f.work_id AND b.book_id > a.book_id""")
def edition_relations(spark, sf_dir):
    """What the editions of a work are to its first."""
    return reviews.edition_pairs(reviews.edition_records(_edited(spark, sf_dir)))


@query(f"""
WITH h AS (SELECT book_id, list_transform(regexp_extract_all(text, '(?m)^(#{{1,6}})\\s+\\S.*$', 1), lambda x: length(x)) AS l FROM {HEADED}),
i AS (SELECT book_id, l, len(l) > 0 AND l[1] > 2 AS deep, len(list_filter(l, lambda x, i: i > 1 AND x > l[i - 1] + 1)) > 0 AS jump FROM h)
SELECT book_id, len(l)::BIGINT AS n, coalesce(len(list_filter(l, lambda x: x = list_min(l))), 0)::BIGINT AS n_top, array_to_string(list_filter([CASE WHEN deep THEN 'first_heading_is_deep' END, CASE WHEN jump THEN 'heading_level_jump' END, CASE WHEN len(l) = 0 THEN 'no_markdown_headings' END], lambda x: x IS NOT NULL), ',') AS issues,
       CASE WHEN deep OR jump OR len(l) < 2 THEN 'WARN' ELSE 'OK' END AS status FROM i""")
def heading_reports(spark, sf_dir):
    """Numbers, levels and jumps of documents' headings."""
    rows = headed(spark, sf_dir).withColumn("l", markdown.heading_levels(F.col("text"))).select("book_id", reviews.heading_report(F.col("l")).alias("h"))
    return rows.select("book_id", "h.n", "h.n_top", F.array_join("h.issues", ",").alias("issues"), "h.status")


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'human_reviewed' WHEN 1 THEN 'rejected' ELSE status END ELSE status END AS status, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 = 2 THEN 'no status: lost' END AS refused
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'machine_draft' WHEN 'O' THEN 'needs_human_review' ELSE 'superseded' END AS status FROM orders)""")
def status_changes(spark, sf_dir):
    """Statuses under decisions."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select(k.alias("id"), F.when(F.col("o_orderstatus") == "F", "machine_draft").when(F.col("o_orderstatus") == "O", "needs_human_review").otherwise("superseded").alias("status"))
    wanted = o.where(k % 4 == 0).select(k.alias("id"), F.when(k % 3 == 0, "human_reviewed").when(k % 3 == 1, "rejected").otherwise("lost").alias("to"))
    return reviews.transitioned(rows, wanted)


@query("""
SELECT 'summary' AS kind, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'machine_draft' ELSE 'needs_human_review' END AS status FROM orders WHERE o_orderstatus IN ('F', 'O') UNION ALL SELECT 'concept', p_partkey, 'machine_draft' FROM part WHERE p_size < 10""")
def open_drafts(spark, sf_dir):
    """Summaries and concepts that no person has approved."""
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "machine_draft").when(F.col("o_orderstatus") == "O", "needs_human_review").otherwise("human_reviewed").alias("status"))
    return reviews.drafts(s, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 10, "machine_draft").alias("status")))


@query("""
SELECT 'manifest_path_missing' AS "check", p_partkey::VARCHAR AS id FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 'summary_without_book', o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'concept_source_missing', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) UNION ALL SELECT 'node_without_book', c_custkey::VARCHAR FROM customer WHERE c_custkey NOT IN (SELECT p_partkey FROM part)""")
def broken_references(spark, sf_dir):
    """What refers to nothing, of four kinds."""
    part = table(spark, sf_dir, "part")
    manifest = part.select(F.col("p_partkey").alias("book_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("canonical_path"))
    files = part.where("p_partkey % 10 <> 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))
    of = lambda name, c, to: table(spark, sf_dir, name).select(F.col(c).alias(to))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("concept_id"), F.col("s_suppkey").alias("chunk_id"))
    return reviews.integrity(manifest, files, of("orders", "o_orderkey", "book_id"), sources, table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("chunk_id")), of("customer", "c_custkey", "book_id"))


@query("SELECT name, n, CASE WHEN n = 0 THEN 'WARN' ELSE 'OK' END AS status FROM (SELECT 'books' AS name, count(*) AS n FROM part UNION ALL SELECT 'chunks', count(*) FROM lineitem UNION ALL SELECT 'concepts', count(*) FROM part WHERE p_size > 1000)")
def health_counts(spark, sf_dir):
    """Rows of tables, with a warning where there are none."""
    part = table(spark, sf_dir, "part")
    return reviews.health(books=part, chunks=table(spark, sf_dir, "lineitem"), concepts=part.where("p_size > 1000"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS side, o_totalprice AS v FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def merged_passages(spark, sf_dir):
    """Two lists as one, in which the newer wins an id."""
    o = table(spark, sf_dir, "orders")
    of = lambda side, test: o.where(test).select(F.col("o_orderkey").alias("id"), F.lit(side).alias("side"), F.col("o_totalprice").alias("v"))
    return reviews.merged_by_id(of("old", "o_orderkey % 2 = 0"), of("new", "o_orderkey % 3 = 0"))


@query("""
SELECT id, value, array_to_string(sources, ',') AS sources, row_number() OVER (PARTITION BY id ORDER BY len(sources) DESC, value)::INT AS rank FROM (
    SELECT l_orderkey AS id, l_returnflag || l_linestatus AS value, list_sort(list(DISTINCT l_suppkey::VARCHAR)) AS sources FROM lineitem GROUP BY ALL)""")
def value_sources(spark, sf_dir):
    """Values of an id with the sources that say them."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").cast("string").alias("source"), F.concat("l_returnflag", "l_linestatus").alias("value"))
    return reviews.merged_sources(rows).withColumn("sources", F.array_join("sources", ","))


# --- records

#: Formats as tables of fields.
TEXT_FORM = {"engine": "text_records", "record": {"header": "TY  - BOOK", "fields": [{"when": "title", "template": "TI  - {title}"}, {"when": "author", "template": "AU  - {author_raw}"}, {"all_when": ["isbn", "place"], "template": "SN  - {isbn} {place}"}, {"none_when": ["isbn"], "template": "N1  - no isbn"}, {"template": "ID  - {{{book_id}}}"}], "footer": "ER  -"}}
JSON_FORM = {"engine": "json_records", "fields": [{"key": "id", "source": "book_id"}, {"key": "type", "literal": "book"}, {"key": "title", "source": "title"}, {"key": "issued", "source": "issued_csl"}, {"key": "publisher", "source": "publisher", "when": "isbn"}]}
XML_FORM = {"engine": "xml_records", "fields": [{"path": "ref-type", "literal": "6", "attributes": {"name": "Book"}}, {"path": "contributors/authors/author", "source": "author_raw", "when": "author"}, {"path": "titles/title", "source": "title"}, {"path": "titles/short", "template": "{title} & co"}]}


@query(f"""
WITH b AS (SELECT book_id, title, author, CASE WHEN book_id % 2 = 0 THEN 1990 + book_id % 20 END AS y, CASE WHEN book_id % 3 = 0 THEN 'i' || book_id END AS isbn, CASE WHEN book_id % 5 <> 0 THEN 'Ulm' END AS place FROM {BOOKS})
SELECT book_id, 'TY  - BOOK' || chr(10) || 'TI  - ' || title || coalesce(chr(10) || 'AU  - ' || author, '') || coalesce(chr(10) || 'SN  - ' || isbn || ' ' || place, '') || CASE WHEN isbn IS NULL THEN chr(10) || 'N1  - no isbn' ELSE '' END || chr(10) || 'ID  - {{' || book_id || '}}' || chr(10) || 'ER  -' AS text_record,
       '{{"id": "' || book_id || '", "type": "book", "title": "' || title || '"' || coalesce(', "issued": {{"date-parts":[[' || y || ']]}}', '') || CASE WHEN isbn IS NOT NULL THEN ', "publisher": "Pub"' ELSE '' END || '}}' AS json_record,
       '<record><ref-type name="Book">6</ref-type>' || coalesce('<contributors><authors><author>' || author || '</author></authors></contributors>', '') || '<titles><title>' || title || '</title><short>' || title || ' &amp; co</short></titles></record>' AS xml_record FROM b""")
def format_records(spark, sf_dir):
    """Books in a text, a JSON and an XML format."""
    k = F.col("book_id")
    b = books(spark, sf_dir).select(
        "book_id", "title", "author", F.when(k % 2 == 0, (1990 + k % 20).cast("string")).alias("year"), F.lit("Pub").alias("publisher"), F.when(k % 5 != 0, "Ulm").alias("place"), F.lit(None).cast("string").alias("edition"),
        F.when(k % 3 == 0, F.concat(F.lit("i"), k.cast("string"))).alias("isbn"), "primary_class",
    )
    return formats.reference_context(b).select("book_id", formats.text_record(TEXT_FORM).alias("text_record"), formats.json_record(JSON_FORM).alias("json_record"), formats.xml_record(XML_FORM).alias("xml_record"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS nth FROM lineitem")
def row_numbers(spark, sf_dir):
    """Rows numbered in an order, without one task that sees all."""
    return formats.numbered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query(f"SELECT '- ' || primary_class || ': ' || count(*) AS line FROM {BOOKS} GROUP BY primary_class UNION ALL SELECT '- ' || title || coalesce(' — ' || author, '') || ' (' || primary_class || ')' FROM {BOOKS}")
def index_lines(spark, sf_dir):
    """A Markdown index of books by class."""
    return formats.index_lines(books(spark, sf_dir)).select("line")


@query()
def canvas_records(spark, sf_dir):
    """Books on a circle, as nodes of a drawing."""
    return formats.canvas_nodes(books(spark, sf_dir).withColumn("path", F.lit(None).cast("string")))


@query()
def answer_packs(spark, sf_dir):
    """Route, passages, citations, themes and summaries for each benchmark item."""
    rows = indexed(spark, sf_dir).withColumn("primary_class", F.when(F.length("author") > 0, F.when(F.col("author") == "de", "332").otherwise("158")))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), "text")
    return packs.answer_packs(rows, asked(spark, sf_dir), *taxonomy.taxonomy_tables(spark, TAXONOMY), summaries=texts, limit=6)


@query()
def book_digests(spark, sf_dir):
    """Thesis, ideas, keywords and uses of documents with headings."""
    none = F.array().cast("array<string>")
    return summaries.book_summaries(headed(spark, sf_dir).select("book_id", "text", none.alias("topics"), none.alias("routing_aliases")))


@query()
def sampled_chunks(spark, sf_dir):
    """A seeded sample of chunks."""
    return knowledge.sampled(chunks.chunk_documents(documents(spark, sf_dir)), "chunk_id", 100, 7).select("chunk_id", "content_hash")


@query("SELECT coalesce(d, 'unknown') AS density, count(*) AS books, sum(pages)::BIGINT AS pages, round(sum(hours), 1) AS hours, CASE coalesce(d, 'unknown') WHEN 'light' THEN 0 WHEN 'medium' THEN 1 WHEN 'dense' THEN 2 ELSE 3 END AS position FROM (SELECT *, CASE WHEN pages < 10 THEN 'light' WHEN pages < 30 THEN 'medium' WHEN pages < 45 THEN 'dense' END AS d FROM " + BOOKS + ") GROUP BY ALL")
def density_counts(spark, sf_dir):
    """Books by density, in a given order."""
    d = F.when(F.col("pages") < 10, "light").when(F.col("pages") < 30, "medium").when(F.col("pages") < 45, "dense")
    return library.level_counts(books(spark, sf_dir).withColumn("density", d), "density", ("light", "medium", "dense", "unknown"))


# --- plans


@query(f"""
WITH c AS MATERIALIZED (SELECT k.*, d.lang AS code FROM {CHUNKS} k JOIN documents d ON d.doc_id = k.book_id), h AS MATERIALIZED ({keyword_sql("c", "chunk_id", ASKED, 100000000)}),
m AS (SELECT h.query_id, h.id, h.score, c.code, CASE WHEN h.query_id % 40 = 0 THEN ['es', 'de', 'fr'] WHEN h.query_id % 60 = 0 THEN ['fr'] ELSE []::VARCHAR[] END AS codes FROM h JOIN c ON c.chunk_id = h.id),
s AS (SELECT query_id, id, (list_position(codes, code) - 1)::INT AS stage, score FROM m WHERE list_contains(codes, code) UNION ALL SELECT query_id, id, 3, score FROM m),
r AS (SELECT query_id, id, stage, row_number() OVER (PARTITION BY query_id, stage ORDER BY score DESC, id)::INT AS stage_rank FROM s QUALIFY stage_rank <= 6),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY stage, stage_rank) = 1)
SELECT query_id, id, stage, stage_rank, row_number() OVER (PARTITION BY query_id ORDER BY stage, stage_rank, id)::INT AS rank FROM f QUALIFY rank <= 6""")
def routed_passages(spark, sf_dir):
    """Chunks of a query's classes, one after another, then of any."""
    rows = indexed(spark, sf_dir).withColumn("primary_class", F.col("author"))
    q = asked(spark, sf_dir)
    none = F.array().cast("array<string>")
    codes = F.when(F.col("query_id") % 40 == 0, F.array(F.lit("es"), F.lit("de"), F.lit("fr"))).when(F.col("query_id") % 60 == 0, F.array(F.lit("fr"))).otherwise(none)
    return packs.routed_search(rows, q, *taxonomy.taxonomy_tables(spark, TAXONOMY), 6, q.select("query_id", codes.alias("class_codes")))


@query(f"""
WITH b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank FROM ({VECTORS}) WHERE id % 7 <> 0), n AS (SELECT query_id, id, rank FROM ({VECTORS}) WHERE rank <= 8)
SELECT query_id, id, CASE WHEN b.rank IS NULL THEN 'added' WHEN n.rank IS NULL THEN 'gone' WHEN n.rank <> b.rank THEN 'moved' ELSE 'same' END AS change FROM n FULL JOIN b USING (query_id, id)""")
def saved_query_changes(spark, sf_dir):
    """What two runs of saved queries found differently."""
    rows = search.top(_vectors(spark, sf_dir).drop("rank"), 10)
    return packs.changed_since(rows.where("rank <= 8"), search.top(rows.where("id % 7 <> 0").drop("rank"), 10))


@query(f"""
WITH s AS MATERIALIZED ({keyword_sql("documents", "doc_id", ASKED, 10)}), c AS MATERIALIZED (SELECT * FROM {CHUNKS}), h AS MATERIALIZED ({keyword_sql("c", "chunk_id", ASKED, 10)}), m AS MATERIALIZED ({_map_sql(8)}),
r AS (SELECT query_id, split_part(id, '_', 1)::BIGINT AS book_id FROM h),
e AS (SELECT query_id, book_id, 'routed' AS kind, 3.0::DOUBLE AS w FROM r WHERE query_id % 40 = 0 UNION ALL SELECT query_id, book_id, 'broad', 2.0 FROM r WHERE query_id % 40 <> 0 UNION ALL SELECT query_id, id, 'summary', 2.5 FROM s
      UNION ALL SELECT query_id, id, 'concept', 2.0 FROM s WHERE rank <= 2 UNION ALL SELECT query_id, book_id, 'map', greatest(0.5::DOUBLE, 2.0::DOUBLE - 0.1::DOUBLE * rank) FROM m),
t AS (SELECT query_id, book_id FROM (SELECT query_id, book_id, round(sum(w), 4) AS s FROM e GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, book_id) <= 3),
g AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents), n AS (SELECT t.query_id, x.o AS book_id FROM t JOIN (SELECT a AS k, b AS o FROM g UNION ALL SELECT b, a FROM g) x ON x.k = t.book_id),
f AS (SELECT * FROM e UNION ALL SELECT query_id, book_id, 'graph', 0.75 FROM n)
SELECT query_id, book_id, round(sum(w), 4) AS score, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(w), 4) DESC, book_id)::INT AS rank FROM f GROUP BY query_id, book_id QUALIFY rank <= 8""")
def reading_plan(spark, sf_dir):
    """Books to read for each benchmark item, by five kinds of evidence."""
    q, chunk_rows = asked(spark, sf_dir), indexed(spark, sf_dir)
    whole = search.keyword_search(spread(table(spark, sf_dir, "documents")), q, "doc_id", "text", 12).withColumnRenamed("id", "book_id")
    parts = search.keyword_search(chunk_rows, q, "chunk_id", "text", 12).withColumn("book_id", F.substring_index("id", "_", 1).cast("long"))
    hits = parts.where("rank <= 10")
    edges = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), (F.col("doc_id") + 1).alias("other_id"), F.lit(0.5).alias("score"))
    return evidence.reading_plan(hits.where("query_id % 40 = 0"), hits.where("query_id % 40 <> 0"), whole.where("rank <= 10"), whole.where("rank <= 2"), evidence.topic_map(whole, parts), edges)


@query(f"""
WITH b AS (SELECT book_id, coalesce(difficulty, '') AS d, CASE difficulty WHEN 'beginner' THEN 'Basics of ' WHEN 'advanced' THEN 'Technical ' WHEN 'intermediate' THEN 'A reference of ' ELSE '' END || title AS t, book_id % 6 AS r, book_id % 7 AS k FROM {BOOKS})
SELECT book_id, CASE WHEN r = 1 THEN 'Start here' WHEN k = 0 THEN 'Use as a reference' WHEN k = 1 THEN 'Skim, then search' WHEN d = 'beginner' AND k <> 2 THEN 'Read early' WHEN d = 'advanced' AND k <> 2 OR k = 3 THEN 'Read after the foundations'
            WHEN d = 'beginner' THEN 'Read early' WHEN d = 'advanced' THEN 'Read after the foundations' WHEN d = 'intermediate' THEN 'Use as a reference' ELSE 'Then read' END AS posture,
       t || ' is recommended for goals because it has ' || CASE WHEN k = 4 THEN 'summary match, connected to other relevant books' WHEN k = 5 THEN 'relevant passages found' ELSE 'matched the reading goal' END || '.' AS why FROM b""")
def reading_postures(spark, sf_dir):
    """How to take the books of a plan, and why."""
    k, d = F.col("book_id") % 7, F.col("difficulty")
    title = F.concat(F.when(d == "beginner", "Basics of ").when(d == "advanced", "Technical ").when(d == "intermediate", "A reference of ").otherwise(""), "title")
    kinds = F.when(k == 4, "graph,summary").when(k == 5, "broad").otherwise("none")
    how = evidence.posture(F.col("book_id") % 6, title, F.lit(""), F.when(k == 0, "reference").when(k == 1, "skim_then_search").otherwise("cover_to_cover"), F.when(k != 2, d), F.when(k == 3, "dense").otherwise("medium"))
    return books(spark, sf_dir).select("book_id", how.alias("posture"), evidence.why(title, F.lit("goals"), kinds).alias("why"))


@query(f"""
SELECT book_id, '<node id="' || book_id || '">' || chr(10) || '  <data key="title">' || title || '</data>' || chr(10) || '  <data key="author">' || coalesce(author, '') || '</data>' || chr(10) || '  <data key="primary_class">' || primary_class || '</data>' || chr(10) || '</node>' AS graphml,
       '{{"data":{{"id":"' || book_id || '","label":"' || title || '"' || coalesce(',"author":"' || author || '"', '') || ',"primary_class":"' || primary_class || '"}}}}' AS cytoscape FROM {BOOKS}""")
def graph_nodes(spark, sf_dir):
    """Books as GraphML and Cytoscape nodes."""
    return books(spark, sf_dir).select("book_id", exports.graphml_nodes().alias("graphml"), exports.cytoscape_nodes().alias("cytoscape"))


@query(f"SELECT '  _' || book_id || ' -- \"' || score || '\" --> _' || other_id AS mermaid FROM ({ORACLE['book_graph']}) ORDER BY score DESC, book_id, other_id LIMIT 200")
def best_edges(spark, sf_dir):
    """The best edges of the book graph, as lines of a drawing."""
    return library.best_edges(books(spark, sf_dir), 200).select(exports.mermaid_edges().alias("mermaid"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'q' || o_orderkey END AS intent FROM orders")
def query_goals(spark, sf_dir):
    """A goal before a topic before a query."""
    k = F.col("o_orderkey")
    said = knowledge.intent(F.when(k % 3 == 0, F.col("o_orderpriority")), F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise(" "), F.concat(F.lit("q"), k.cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", said.alias("intent"))


@query(f"""
SELECT book_id, CASE WHEN book_id % 2 = 0 THEN title END AS thesis, coalesce(n, 0) AS n_chapters, coalesce(i, false) AS indexed FROM {BOOKS} LEFT JOIN (SELECT l_partkey AS book_id, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1) USING (book_id)
LEFT JOIN (SELECT ps AS book_id, bool_or(o_orderstatus = 'F') AS i FROM (SELECT o_orderkey AS ps, o_orderstatus FROM orders) GROUP BY 1) USING (book_id)""")
def assembled_books(spark, sf_dir):
    """Books with their summary, chapters and state."""
    b = books(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("book_id"))
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book_id"), (F.col("o_orderstatus") == "F").alias("indexed"))
    return knowledge.assembled(b.select("book_id"), b.where("book_id % 2 = 0").select("book_id", F.col("title").alias("thesis")), lines, state)


@query(f"""
WITH b AS (SELECT * FROM {BOOKS} WHERE book_id % 3 = 0), r AS (SELECT * FROM {BOOKS} WHERE book_id % 2 = 0)
SELECT book_id FROM r WHERE list_has_any(isbns, (SELECT flatten(list(isbns)) FROM b)) OR lower(title) || '|' || lower(coalesce(author, '')) IN (SELECT lower(title) || '|' || lower(coalesce(author, '')) FROM b)""")
def known_again(spark, sf_dir):
    """Books that others share an ISBN, or a title and author, with."""
    b = books(spark, sf_dir)
    return reviews.known_again(b.where("book_id % 2 = 0"), b.where("book_id % 3 = 0")).select("book_id")


@query(f"SELECT book_id FROM {BOOKS} WHERE book_id = 7 OR contains(lower(title || ' ' || coalesce(author, '')), 'steel') OR contains(lower(array_to_string(topics, ' ')), 'steel')")
def graph_matches(spark, sf_dir):
    """Books that a query names."""
    b = books(spark, sf_dir)
    return knowledge.matching_nodes(b, "Steel").select("book_id").unionByName(knowledge.matching_nodes(b.where("NOT contains(lower(title), 'steel')"), "7").where("book_id = 7").select("book_id"))
