"""More queries of the catalogue: metadata, taxonomies, sections, claims, listings and records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _NORMAL, _SLUG, ASKED, BOOKS, CHUNKS, ORACLE, VECTORS, _any, _vectors, asked, books, documents, indexed, keyword_sql, query, table
from .operators import chunks, exports, extract, knowledge, library, metadata, near, search, summaries, taxonomy
from .sources.tables import materialize, spread


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


# --- metadata

_NAMES = """(SELECT p_partkey AS book_id, CASE p_partkey % 5 WHEN 0 THEN p_name || ' - ' || p_brand || ' - 978' || lpad((p_partkey * 7919)::VARCHAR, 10, '0') WHEN 1 THEN p_name || ' - ' || p_type || ' - ' || p_brand
    WHEN 2 THEN p_name WHEN 3 THEN p_name || ' - ISBN: 978' || lpad((p_partkey * 7919)::VARCHAR, 10, '0') ELSE ' ' || p_name || ' -  - ' || p_brand || ' ' END AS name FROM part)"""


def _names(spark, sf_dir) -> DataFrame:
    code = F.concat(F.lit("978"), F.lpad((F.col("p_partkey") * 7919).cast("string"), 10, "0"))
    k, sep = F.col("p_partkey") % 5, F.lit(" - ")
    name = (
        F.when(k == 0, F.concat("p_name", sep, "p_brand", sep, code)).when(k == 1, F.concat("p_name", sep, "p_type", sep, "p_brand")).when(k == 2, F.col("p_name"))
        .when(k == 3, F.concat("p_name", sep, F.lit("ISBN: "), code)).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" -  - "), "p_brand", F.lit(" ")))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book_id"), name.alias("name"))


@query(f"""
WITH p AS (SELECT book_id, list_filter(list_transform(string_split(trim(name), ' - '), lambda x: trim(x)), lambda x: x <> '') AS ps FROM {_NAMES}),
c AS (SELECT book_id, ps, len(ps) >= 2 AND regexp_full_match(ps[-1], '(?:ISBN: )?978\\d{{10}}') AS coded, right(ps[-1], 13) AS code FROM p),
v AS (SELECT *, coded AND list_sum(list_transform(range(1, 14), lambda i: (CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) * TRY_CAST(substr(code, i, 1) AS INT))) % 10 = 0 AS valid, CASE WHEN coded THEN ps[:-2] ELSE ps END AS rest FROM c)
SELECT book_id, CASE WHEN len(rest) >= 2 THEN array_to_string(rest[:-2], ' - ') ELSE rest[1] END AS title, CASE WHEN len(rest) >= 2 THEN rest[-1] END AS author, CASE WHEN valid THEN code END AS isbn,
       CASE WHEN len(rest) >= 2 THEN CASE WHEN valid THEN 'high' ELSE 'medium' END WHEN valid THEN 'medium' ELSE 'low' END AS confidence FROM v""")
def file_name_parts(spark, sf_dir):
    """Title, author, ISBN and confidence of file names made from parts."""
    return _names(spark, sf_dir).select("book_id", metadata.parsed_name(F.col("name")).alias("p")).select("book_id", "p.*")


#: Documents whose sentences are lines, every fourth of them a heading of level 1 to 3.
HEADED = """(SELECT doc_id AS book_id, array_to_string(list_transform(string_split(coalesce(text, ''), '. '), lambda s, i: CASE WHEN (i - 1) % 4 = 0 THEN repeat('#', (1 + ((i - 1) // 4) % 3)::INT) || ' ' || CASE WHEN (i - 1) % 5 = 0 THEN 'Chapter ' || i ELSE left(s, 40) END ELSE s END), chr(10)) AS text FROM documents)"""


def headed(spark, sf_dir) -> DataFrame:
    line = lambda s, i: F.when(i % 4 == 0, F.concat(F.repeat(F.lit("#"), (1 + F.floor(i / 4) % 3).cast("int")), F.lit(" "), F.when(i % 5 == 0, F.concat(F.lit("Chapter "), (i + 1).cast("string"))).otherwise(F.left(s, F.lit(40))))).otherwise(s)
    d = documents(spark, sf_dir)
    return d.withColumn("text", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), r"\. "), line), "\n"))


_BARE = "trim(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
_TITLE_OF = "trim(regexp_replace(regexp_extract({}, '^#{{1,6}}\\s+(.*)$', 1), '\\s+', ' ', 'g'), '# ')"

def sections_sql(source: str) -> str:
    """Sections of (book_id, text) with headings of levels 1 to 3 at most."""
    return f"""(
WITH l AS MATERIALIZED (SELECT book_id, i, line, regexp_matches(line, '^#{{1,6}}\\s+\\S') AS head FROM (SELECT book_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source})),
n AS (SELECT book_id, max(i) AS n_lines, bool_or(head) AS headed FROM l GROUP BY book_id),
h AS (SELECT book_id, i, line, length(regexp_extract(line, '^#+')) AS level, {_TITLE_OF.format("line")} AS title, lead(i) OVER (PARTITION BY book_id ORDER BY i) AS next, row_number() OVER (PARTITION BY book_id ORDER BY i) AS j FROM l WHERE head),
a AS (SELECT *, max(CASE WHEN level = 1 THEN i END) OVER w AS i1, max(CASE WHEN level = 2 THEN i END) OVER w AS i2 FROM h WINDOW w AS (PARTITION BY book_id ORDER BY i)),
p AS (SELECT a.*, n_lines, list_filter([CASE WHEN a.level > 1 THEN x.title END, CASE WHEN a.level > 2 AND a.i2 > coalesce(a.i1, 0) THEN y.title END, a.title], lambda t: t IS NOT NULL) AS stack
      FROM a JOIN n USING (book_id) LEFT JOIN h x ON x.book_id = a.book_id AND x.i = a.i1 LEFT JOIN h y ON y.book_id = a.book_id AND y.i = a.i2),
t AS (SELECT p.book_id, p.i, regexp_replace(string_agg(l.line, chr(10) ORDER BY l.i), '^\\s+|\\s+$', '', 'g') AS inner_text FROM p JOIN l ON l.book_id = p.book_id AND l.i > p.i AND l.i < coalesce(p.next, p.n_lines + 1) GROUP BY p.book_id, p.i)
SELECT book_id, i, array_to_string(stack, ' > ') AS heading_path, coalesce(list_filter(stack, lambda s: regexp_full_match(s, '(?i)(chapter\\s+\\d+|chapter\\s+[ivxlcdm]+|preface|introduction|prologue|epilogue|conclusion|afterword|appendix\\b.*)'))[1], stack[1]) AS chapter_title,
       rtrim(line) || chr(10) || chr(10) || inner_text AS text, i::BIGINT AS start_line, least(coalesce(next, n_lines + 1), n_lines)::BIGINT AS end_line
FROM p JOIN t USING (book_id, i) WHERE inner_text <> ''
UNION ALL SELECT book_id, 1, '', 'Body', string_agg(line, chr(10) ORDER BY i), 1, max(i) FROM l JOIN n USING (book_id) WHERE NOT headed GROUP BY book_id HAVING string_agg(line, chr(10) ORDER BY i) <> '')"""


SECTIONS = sections_sql(HEADED)


@query(f"""
SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY i) - 1)::INT AS place, heading_path, chapter_title, {_SLUG.format("heading_path")} AS section_id, start_line, end_line, sha256(text) AS text_sha256 FROM {SECTIONS} WHERE heading_path <> ''""")
def document_sections(spark, sf_dir):
    """Documents with headings, cut at them, with the headings above and the chapter of each section."""
    rows = chunks.unrolled(chunks.with_sections(headed(spark, sf_dir).select("book_id", "text"), "text", "s"), ("book_id",), "s", "place")
    return rows.select("book_id", "place", "s.heading_path", "s.chapter_title", "s.section_id", "s.start_line", "s.end_line", F.sha2("s.text", 256).alias("text_sha256")).where("heading_path <> ''")


_TOPIC_KEYS = "list_transform(ts, lambda t: replace(replace(replace(lower(trim(t)), ' ', '_'), '-', '_'), '_', ' '))"


_BLOCKS = "(?i)</h[1-6]>|</?(?:p|div|section|article|chapter|li|br|blockquote|tr|table|ul|ol)\\b[^>]*>"
_BARE_HTML = "regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g')"
for _level in range(1, 7):
    _BARE_HTML = f"regexp_replace({_BARE_HTML}, '(?i)<h{_level}\\b[^>]*>', chr(10) || chr(10) || '{'#' * _level} ', 'g')"
_BARE_HTML = f"regexp_replace(regexp_replace({_BARE_HTML}, '{_BLOCKS}', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g')"
#: The entities that the given pages have; others would need a table.
_READ_HTML = f"regexp_replace(replace(replace(replace({_BARE_HTML}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"
_TIDY_HTML = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({_READ_HTML}, chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n[ \\t]+', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
ORACLE["page_sections"] = f"""
SELECT book_id AS page_id, (row_number() OVER (PARTITION BY book_id ORDER BY i) - 1)::INT AS place, heading_path, chapter_title, CASE WHEN heading_path = '' THEN 'body' ELSE {_SLUG.format("heading_path")} END AS section_id, start_line, end_line, sha256(text) AS text_sha256
FROM {sections_sql(f"(SELECT page_id AS book_id, {_TIDY_HTML} AS text FROM pages)")}"""


@query(f"""
WITH h AS (SELECT book_id, text, list_transform(regexp_extract_all(text, '(?m)^#{{1,6}}\\s+(.+?)\\s*$', 1)[:80], lambda x: lower(trim(regexp_replace(trim(x), '(?i)^(chapter|part|section)\\s+\\d+[:.\\s-]*', ''), ' .:-'))) AS hs FROM {HEADED}),
k AS (SELECT book_id, list_concat(list_filter(hs, lambda x: x <> '' AND length(x) <= 80 AND x NOT IN ({", ".join(f"'{t}'" for t in metadata.NO_TOPICS)})),
      list_filter([{", ".join(f"CASE WHEN contains(lower(left(text, 60000)), '{w}') THEN '{t}' END" for w, t in metadata.TOPIC_WORDS.items())}], lambda x: x IS NOT NULL)) AS ts FROM h),
f AS (SELECT book_id, ts, {_TOPIC_KEYS} AS ks FROM k)
SELECT book_id, array_to_string(list_filter(ts, lambda t, i: list_position(ks, ks[i]) = i)[:12], '|') AS topics FROM f""")
def document_topics(spark, sf_dir):
    """Topics of documents by their headings and words."""
    return headed(spark, sf_dir).select("book_id", F.array_join(metadata.topics_of(F.col("text")), "|").alias("topics"))


#: Documents whose titles have words of classes.
_WORDS = [w[0] for w in metadata.CLASS_WORDS.values()] + ["nothing", "habits and money"]
_TITLED = f"(SELECT doc_id AS book_id, {sql_list(_WORDS)}[1 + doc_id % {len(_WORDS)}] || ' ' || doc_id AS title, coalesce(text, '') AS text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'Document', coalesce(text, '') FROM documents WHERE doc_id % 2 = 1)"


@query(f"""
WITH s AS (SELECT book_id, {", ".join(f'8 * len(list_filter({sql_list(w)}, lambda w: contains(lower(title), w))) + len(list_filter({sql_list(w)}, lambda w: contains(lower(text), w))) AS "{c}"' for c, w in metadata.CLASS_WORDS.items())} FROM {_TITLED}),
b AS (SELECT *, greatest({", ".join(f'"{c}"' for c in metadata.CLASS_WORDS)}) AS best FROM s)
SELECT book_id, CASE WHEN best = 0 THEN NULL WHEN "158" >= 8 AND "158" >= "332" - 2 THEN '158' {" ".join(f'WHEN "{c}" = best THEN ' + f"'{c}'" for c in metadata.CLASS_WORDS)} END AS guessed_class FROM b""")
def document_guesses(spark, sf_dir):
    """The class of each document by the words of fourteen classes, over whole texts."""
    d = documents(spark, sf_dir).select("book_id", "text")
    title = F.when(F.col("book_id") % 2 == 0, F.concat(F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (1 + F.col("book_id") % len(_WORDS)).cast("int")), F.lit(" "), F.col("book_id").cast("string"))).otherwise("Document")
    return metadata.with_class(d.withColumn("title", title), F.col("title"), "text", most=2**31 - 1).select("book_id", "guessed_class")


def _meta():
    k = F.col("book_id")
    block = F.struct(F.when(k % 5 != 0, F.lit("BMDC")).alias("scheme"), F.when(k % 7 != 0, F.lit("650")).alias("primary_class"), F.when(k % 11 != 0, F.lit("Work")).alias("primary_label"))
    return F.to_json(F.struct(F.when(k % 2 == 0, F.concat(F.lit("Given "), k.cast("string"))).alias("title"), F.when(k % 3 != 0, F.lit("Ann")).alias("author"), F.when(k % 4 != 0, block).alias("classification")))


@query("""
SELECT doc_id AS book_id, CASE WHEN doc_id % 13 = 0 THEN 'Missing YAML frontmatter block' ELSE array_to_string(list_filter([
    CASE WHEN doc_id % 2 <> 0 THEN 'Missing required field: title' END, CASE WHEN doc_id % 3 = 0 THEN 'Missing required field: author' END, CASE WHEN doc_id % 4 = 0 OR doc_id % 385 = 0 THEN 'Missing required field: classification' END,
    CASE WHEN doc_id % 4 = 0 THEN 'classification must be a mapping' END, CASE WHEN doc_id % 4 <> 0 AND doc_id % 7 = 0 THEN 'Missing classification.primary_class' END,
    CASE WHEN doc_id % 4 <> 0 AND doc_id % 11 = 0 THEN 'Missing classification.primary_label' END, CASE WHEN doc_id % 4 <> 0 AND doc_id % 5 = 0 THEN 'classification.scheme should be BMDC' END], lambda x: x IS NOT NULL), '; ') END AS problems FROM documents""")
def front_matter_problems(spark, sf_dir):
    """What front matters lack."""
    return documents(spark, sf_dir).select("book_id", F.array_join(metadata.problems(_meta(), F.col("book_id") % 13 != 0), "; ").alias("problems"))


@query("""
SELECT doc_id AS book_id, CASE WHEN doc_id % 2 = 0 THEN 'Given ' || doc_id ELSE 'Title ' || doc_id END AS title, CASE WHEN doc_id % 3 <> 0 THEN 'Ann' ELSE lang END AS author, c AS primary_class,
       CASE WHEN doc_id % 4 <> 0 AND doc_id % 11 <> 0 THEN 'Work' WHEN c = '332' THEN 'Money' ELSE 'Unclassified' END AS primary_label, CASE WHEN doc_id % 4 <> 0 AND doc_id % 7 <> 0 THEN 'existing_frontmatter' WHEN doc_id % 9 < 5 THEN 'folder_path' ELSE 'unclassified' END AS classification_source,
       CASE c WHEN '332' THEN 'finance|investing' WHEN '650' THEN 'business|productivity' ELSE '' END AS routing_aliases
FROM (SELECT *, CASE WHEN doc_id % 4 <> 0 AND doc_id % 7 <> 0 THEN '650' WHEN doc_id % 9 < 5 THEN '332' ELSE '999' END AS c FROM documents)""")
def book_metadata(spark, sf_dir):
    """Metadata of files by front matter, folders and names."""
    k = F.col("book_id")
    files = documents(spark, sf_dir).select("book_id", F.concat(F.lit("books/"), F.when(k % 9 < 5, "332-finance").otherwise("999-none"), F.lit("/Title "), k.cast("string"), F.lit(" - "), "author", F.lit(".md")).alias("path"), _meta().alias("meta"), F.lit("").alias("text"))
    made = metadata.described(files.withColumnRenamed("book_id", "own"), {"332": "Money", "999": "Unclassified"})
    return made.select(F.col("own").alias("book_id"), "title", "author", "primary_class", "primary_label", "classification_source", F.array_join("routing_aliases", "|").alias("routing_aliases"))


# --- taxonomies and filters

TAXONOMY = """
classes:
  '332': {label: steel money goods, aliases: [hot_stock]}
  '158': {label: small habits, aliases: [blue_gear]}
  '658': {label: large widget management}
routing_aliases:
  red: {primary_class: ['332'], secondary_class: ['658']}
  small_ring: {primary_class: ['158'], secondary_class: []}
  finance: {primary_class: ['332', '658'], secondary_class: ['158']}
"""
_CLASSES = {"332": ("steel money goods", ("hot stock",)), "158": ("small habits", ("blue gear",)), "658": ("large widget management", ())}
_ALIASES = {"red": (["332"], ["658"]), "small_ring": (["158"], []), "finance": (["332", "658"], ["158"])}
_SAID = ("risk of money", "deep work", "sleep", "none", "ai", "the stock market", "send", "habit")


def _term_sql(term: str) -> str:
    return f"(contains(q, '{term}'))" if " " in term else f"regexp_matches(q, '\\b{term}\\b')"


def _alias_sql(a: str) -> str:
    """What an alias gets: for itself, and for the labels and aliases of its classes."""
    parts = [f"CASE WHEN {_term_sql(a.replace('_', ' '))} THEN 4.0 ELSE 0 END"]
    for code in _ALIASES[a][0] + _ALIASES[a][1]:
        label, own = _CLASSES[code]
        parts.append(f"least(2.5, 0.6 * len(list_intersect(ws, {sql_list(label.split())})))")
        parts += [f"CASE WHEN {_term_sql(x)} THEN 2.5 ELSE 0 END" for x in own]
    return f"('{a}', round(({' + '.join(parts)})::DOUBLE, 6))"


def _hint_sql(name: str) -> str:
    hits = " + ".join(f"{_term_sql(t)}::INT" for t in taxonomy.HINTS[name][2])
    return f"('{name}', CASE WHEN ({hits}) > 0 THEN 3.0::DOUBLE + 1.2::DOUBLE * ({hits}) ELSE 0 END)"


_CHAINS = {a: list(dict.fromkeys([a, *taxonomy.HINTS.get(a, ((), (), ()))[0]])) for a in [*_ALIASES, *taxonomy.HINTS]}
_CODES = {a: list(taxonomy.HINTS[a][1]) if a in taxonomy.HINTS else _ALIASES.get(a, ([], []))[0] for a in {*_CHAINS, *[x for c in _CHAINS.values() for x in c]}}


@query(f"""
WITH q AS (SELECT query_id, q, list_distinct(regexp_extract_all(q, '[a-z0-9][a-z0-9''\\-]{{2,}}')) AS ws FROM (SELECT p_partkey AS query_id, lower(p_name) || ' ' || {sql_list(_SAID)}[1 + p_partkey % {len(_SAID)}] AS q FROM part)),
s AS (SELECT query_id, name, sum(score) AS score FROM (SELECT query_id, unnest([{", ".join(f"row{_alias_sql(a)}" for a in _ALIASES)}, {", ".join(f"row{_hint_sql(n)}" for n in taxonomy.HINTS)}]) AS x FROM q), LATERAL (SELECT x[1] AS name, x[2] AS score) GROUP BY ALL),
b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM s WHERE score > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM b WHERE score >= greatest(2.5, 0.55::DOUBLE * best) QUALIFY rank <= 3),
c AS (SELECT query_id, max(best) AS best, flatten(list(CASE name {" ".join(f"WHEN '{a}' THEN {sql_list(c)}" for a, c in _CHAINS.items())} END ORDER BY rank)) AS chain FROM r GROUP BY query_id),
d AS (SELECT query_id, best, list_filter(chain, lambda a, i: list_position(chain, a) = i)[:3] AS aliases FROM c),
e AS (SELECT *, flatten(list_transform(aliases, lambda a: CASE a {" ".join(f"WHEN '{a}' THEN {sql_list(c)}" for a, c in sorted(_CODES.items()))} ELSE []::VARCHAR[] END)) AS codes FROM d),
f AS (SELECT *, least(0.98::DOUBLE, round(0.35::DOUBLE + best / 12, 2)) AS base FROM e)
SELECT q.query_id, coalesce(array_to_string(aliases, '|'), '') AS aliases, coalesce(array_to_string(list_filter(codes, lambda x, i: list_position(codes, x) = i), '|'), '') AS class_codes,
       CASE WHEN best IS NULL THEN 0 WHEN len(aliases) > 1 THEN greatest(0.35::DOUBLE, round(base - 0.05::DOUBLE * (len(aliases) - 1), 2)) ELSE base END AS confidence FROM q LEFT JOIN f USING (query_id)""")
def query_intents(spark, sf_dir):
    """Aliases, classes and confidence of queries, by a taxonomy and fixed domains."""
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (1 + F.col("p_partkey") % len(_SAID)).cast("int"))
    queries = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select(F.col("p_partkey").alias("query_id"), F.concat("p_name", F.lit(" "), said).alias("text"))
    rows = taxonomy.route_queries(queries, *taxonomy.taxonomy_tables(spark, TAXONOMY))
    return rows.select("query_id", F.array_join("aliases", "|").alias("aliases"), F.array_join("class_codes", "|").alias("class_codes"), "confidence")


_CLASSED = "(SELECT doc_id AS id, lang AS primary_class, source AS secondary_class_text, text FROM documents)"


@query(f"""
WITH h AS ({keyword_sql("documents", "doc_id", ASKED, 1000000)}),
f AS (SELECT h.query_id, h.id, h.score FROM h JOIN {_CLASSED} c ON c.id = h.id WHERE CASE WHEN h.query_id % 40 = 0 THEN c.primary_class = 'de' OR contains(c.secondary_class_text, 'src7') ELSE c.primary_class IN ('fr', 'es') END)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM f QUALIFY rank <= 10""")
def filtered_search(spark, sf_dir):
    """Keyword search among the classes that the aliases of each query name."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("book_id"), F.col("source").alias("title"), F.col("lang").alias("primary_class"), F.col("source").alias("secondary_class_text"), "text")
    aliases = spark.createDataFrame([("german_books", ["de"], ["src7"]), ("romance", ["fr"], ["es"])], "alias string, primary_codes array<string>, secondary_codes array<string>")
    q = asked(spark, sf_dir)
    named = q.select("query_id", F.when(F.col("query_id") % 40 == 0, "German Books").otherwise("romance").alias("alias"))
    filters = taxonomy.codes_of(named, aliases).groupBy("query_id").agg(F.collect_set("code").alias("codes")).withColumn("book", F.lit(None).cast("string"))
    hits = search.keyword_search(docs, q, "book_id", "text", 2**31 - 1).drop("rank")
    met = taxonomy.allowed(docs.drop("text"), filters).select("query_id", F.col("book_id").alias("id"))
    return search.top(hits.join(met, ["query_id", "id"]), 10)


# --- claims, listings, records

#: Sentences that claim something, added to documents by their number.
SENTENCES = (
    "The old system should help the whole team because focus improves when money is managed well.", "A market may fail unless the risk is known and every leader learns the skill of saving.",
    "Habits are more important than goals because practice leads to learning that never fails under pressure.", "Nothing here.", "This plan requires energy and motivation, however it depends on the context of the team.",
    "the old SYSTEM should help the whole team because focus improves when money is managed well.", "Long walks through the green park are more pleasant than short ones taken in a rush.",
)
_SAYS = f"(SELECT doc_id AS book_id, coalesce(text, '') || '. ' || {sql_list(SENTENCES)}[1 + doc_id % 7] || ' ' || {sql_list(SENTENCES)}[1 + (doc_id // 7) % 7] || ' ' || {sql_list(SENTENCES)}[1 + (doc_id // 3) % 7] AS text, lang AS author, source AS title FROM documents)"


def said(spark, sf_dir) -> DataFrame:
    k, pick = F.col("book_id"), lambda i: F.element_at(F.array(*[F.lit(s) for s in SENTENCES]), (1 + i % 7).cast("int"))
    d = documents(spark, sf_dir)
    return d.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(". "), pick(k), F.lit(" "), pick(F.floor(k / 7)), F.lit(" "), pick(F.floor(k / 3))))


_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`]+`', ' ', 'g'), '\\[([^\\]]+)\\]\\([^\\)]*\\)', '', 'g'), '[*_>#]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_STANCE = f"CASE WHEN {_any('lower(s)', extract.QUALIFY)} THEN 'qualifies' WHEN {_any('lower(s)', extract.CHALLENGE)} THEN 'challenges' WHEN {_any('lower(s)', extract.SUPPORT)} THEN 'supports' ELSE 'neutral' END"
_PARTS_OF = f"list_filter(string_split(regexp_replace({_PLAIN}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(string_split(s, ' ')) BETWEEN 10 AND 45)"
CLAIMS = f"""(
SELECT book_id, author, title, (k - 1)::INT AS claim_index, s AS claim, {_STANCE} AS stance, CASE WHEN {_STANCE} = 'neutral' THEN 'low' ELSE 'medium' END AS confidence,
       array_to_string(list_filter([{", ".join(f"CASE WHEN {_any('lower(s)', t)} THEN '{n}' END" for n, t in extract.TAG_TERMS.items())}], lambda x: x IS NOT NULL)[:8], ',') AS tags
FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY i) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY book_id, lower(s) ORDER BY i) AS copy FROM (SELECT book_id, author, title, unnest({_PARTS_OF}) AS s, generate_subscripts({_PARTS_OF}, 1) AS i FROM {_SAYS}) WHERE {_any('lower(s)', extract.MARKERS)}) WHERE copy = 1)
WHERE k <= 40)"""


@query(f"SELECT book_id, claim_index, claim, stance, confidence, tags FROM {CLAIMS}")
def said_claims(spark, sf_dir):
    """The first claims of documents that make some."""
    return extract.claims(said(spark, sf_dir).select("book_id", "text")).withColumn("tags", F.array_join("tags", ","))


_TOPICS = ("focus and money", "risk", "goals", "team energy", "green park walks")
_TOPIC_ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TOPICS))
_HITS = f"""(
WITH q AS (SELECT query_id, lower(t) AS asked, list_distinct(list_filter(regexp_extract_all(lower(t), '\\w+'), lambda w: length(w) > 2)) AS words FROM (VALUES {_TOPIC_ROWS}) v(query_id, t)),
c AS (SELECT book_id || '-' || claim_index AS claim_id, title, stance, lower(claim || ' ' || title || ' ' || author || ' ' || replace(tags, ',', ' ')) AS low FROM {CLAIMS}),
s AS (SELECT query_id, claim_id, title, stance, (len(list_filter(words, lambda w: contains(low, w))) + CASE WHEN contains(low, asked) THEN 3 ELSE 0 END)::INT AS score FROM c, q)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, claim_id)::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= 60)"""


def _claims(spark, sf_dir) -> DataFrame:
    docs = said(spark, sf_dir)
    rows = extract.claims(docs.select("book_id", "text")).join(docs.select("book_id", "title", "author", F.substring_index("source_path", "/", 1).alias("source")), "book_id")
    name = F.concat(F.col("book_id").cast("string"), F.lit("-"), F.col("claim_index").cast("string"))
    return materialize(rows.select(name.alias("claim_id"), "claim", F.lit(None).cast("string").alias("citation"), F.col("source").alias("title"), "author", F.lit(None).cast("string").alias("heading_path"), F.lit(None).cast("string").alias("evidence"), "tags", "stance"))


def _topics(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_TOPICS)), "query_id int, text string")


@query(f"SELECT query_id, claim_id, title, stance, score, rank FROM {_HITS} WHERE rank <= 20")
def claim_search(spark, sf_dir):
    """Claims about a topic."""
    return knowledge.claim_search(_claims(spark, sf_dir), _topics(spark))


@query(f"SELECT query_id, stance, row_number() OVER (PARTITION BY query_id, stance ORDER BY rank)::INT AS place, claim_id, score FROM {_HITS} QUALIFY place <= 20")
def claim_comparison(spark, sf_dir):
    """Claims about a topic by what they hold of it."""
    return knowledge.compared_claims(_claims(spark, sf_dir), _topics(spark))[0]


@query(f"SELECT primary_class, author, title, count(*) AS n_chunks FROM {BOOKS} WHERE contains(lower(coalesce(author, '')), 'brand#1') GROUP BY ALL")
def book_listing(spark, sf_dir):
    """Books of authors whose name has a part, with their numbers of rows."""
    rows = books(spark, sf_dir).withColumn("source_path", F.lit(None).cast("string")).drop("book_id").withColumn("book_id", F.lit(None).cast("string"))
    return knowledge.listed_books(rows, author="Brand#1").select("primary_class", "author", "title", "n_chunks")


@query(f"""
WITH b AS (SELECT * FROM {BOOKS}),
c AS (SELECT 'class' AS kind, primary_class AS name, count(*) AS books, sum(n_chunks)::BIGINT AS chunks FROM b GROUP BY ALL UNION ALL SELECT 'author', coalesce(author, 'Unknown author'), count(*), sum(n_chunks)::BIGINT FROM b GROUP BY ALL
      UNION ALL SELECT 'topic', topic, count(*), sum(n_chunks)::BIGINT FROM (SELECT lower(unnest(topics)) AS topic, n_chunks FROM b) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY kind ORDER BY books DESC, name)::INT AS rank FROM c QUALIFY rank <= 10""")
def collection_statistics(spark, sf_dir):
    """The classes, authors and topics with most books."""
    return knowledge.statistics(books(spark, sf_dir))


@query(f"""
SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY first_at, label)::INT AS place FROM (SELECT query_id, e.label::VARCHAR AS label, min(v.rank) AS first_at FROM ({VECTORS}) v JOIN embeddings e ON e.vec_id = v.id GROUP BY ALL)""")
def unique_results(spark, sf_dir):
    """The labels of each query's results, once each, in the order in which they came."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"))
    return knowledge.first_seen(_vectors(spark, sf_dir).join(e, "id"), "label")


@query(f"""
WITH b AS (SELECT * FROM {BOOKS}),
k AS (SELECT 'isbn' AS reason, unnest(isbns) AS key, book_id FROM (SELECT book_id % 97 AS book_id, isbns FROM b) UNION SELECT 'content', sha256(title), book_id FROM (SELECT book_id % 97 AS book_id, title FROM b)
      UNION SELECT 'title_author', {_NORMAL.format("title")} || '|' || {_NORMAL.format("author")}, book_id FROM (SELECT book_id % 97 AS book_id, title, author FROM b))
SELECT reason, key, count(*) AS n_books, min(book_id) AS first_id, max(book_id) AS last_id FROM k GROUP BY ALL HAVING count(*) > 1""")
def duplicate_books(spark, sf_dir):
    """Books that share an ISBN, a body, or a title and author."""
    b = books(spark, sf_dir).select((F.col("book_id") % 97).alias("book_id"), "title", "author", "isbns", F.col("title").alias("text"))
    return library.duplicate_groups(b)


@query("SELECT event_id, event_type, user_id FROM events WHERE contains(props, '\"k\": 6') AND event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def event_search(spark, sf_dir):
    """The last fifty error events whose record contains a text."""
    log = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id", F.replace("props", F.lit('"'), F.lit("")).alias("props"))
    return knowledge.log_search(log.where("event_type = 'error'"), "K: 6", ("ts", "event_id"), 50).select("event_id", "event_type", "user_id")


@query()
def near_duplicates(spark, sf_dir):
    """Pairs of titles and authors, and of bodies, that are much alike."""
    b = books(spark, sf_dir).select("book_id", "title", "author", F.col("title").alias("text"))
    pairs, _ = near.near_duplicates(b)
    return pairs


@query()
def chapter_digests(spark, sf_dir):
    """Chapters of documents with headings: summary, ideas and keywords."""
    return summaries.chapter_summaries(headed(spark, sf_dir).select("book_id", "text"))


@query()
def query_themes(spark, sf_dir):
    """Themes of documents in the light of a query."""
    return summaries.themes(spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text", F.lit("goals and systems").alias("query")))


_EDGES = "least(1.0::DOUBLE, least(0.95::DOUBLE, 0.95::DOUBLE * w) + least(0.35::DOUBLE, 0.35::DOUBLE * a) + least(0.25::DOUBLE, 0.25::DOUBLE * c) + least(0.5::DOUBLE, 0.12::DOUBLE * n))"


@query(f"""
SELECT chunk_id AS id_, c.text, to_json({{'book_id': book_id, 'title': 'Document ' || book_id, 'author': lang, 'source_path': source || '/' || book_id, 'chunk_index': chunk_index, 'heading_path': '', 'start_line': start_line, 'end_line': end_line, 'citation': citation}})::VARCHAR AS metadata
FROM {CHUNKS} c JOIN documents d ON d.doc_id = c.book_id""")
def chunk_documents(spark, sf_dir):
    """Chunks as documents of an index, with their metadata as JSON."""
    return exports.index_documents(indexed(spark, sf_dir))

