import json
import re

from pyspark.sql import functions as F

from quarrywise.operators import metadata, taxonomy

TAXONOMY = """
classes:
  '332': {label: Financial economics and finance, aliases: [money, stock_market]}
  '158': {label: Applied psychology, aliases: [self_help]}
  '658': {label: General management}
routing_aliases:
  finance: {primary_class: ['332'], secondary_class: ['658']}
  self_help: {primary_class: ['158'], secondary_class: []}
"""


def test_file_names_are_read_from_the_right(spark):
    names = ["Example Book - Jane Example - 9780306406157", "A - B - C", "Just a title", "T - ISBN: 0306406152", "T - Author - 9780306406158", " - ", "Deep-Work — x - Cal"]
    got = [tuple(r.p) for r in spark.createDataFrame(list(enumerate(names)), "i int, n string").orderBy("i").select(metadata.parsed_name(F.col("n")).alias("p")).collect()]
    assert got == [
        ("Example Book", "Jane Example", "9780306406157", "high"), ("A - B", "C", None, "medium"), ("Just a title", None, None, "low"), ("T", None, "0306406152", "medium"),
        ("T", "Author", None, "medium"), ("-", None, None, "low"), ("Deep-Work — x", "Cal", None, "medium"),
    ]


def test_front_matter_is_built_and_checked(spark):
    rows = [
        ("b/332-finance/The Title - Ann Author - 9780306406157.md", "{}", "# Chapter 1: Habits\ntext ISBN 0306406152 on money"),
        ("b/x/Name.md", json.dumps({"title": "Given", "author": "Me", "isbn": {"filename": "0306406152", "bad": "1"}, "classification": {"scheme": "BMDC", "primary_class": "650", "primary_label": "L", "topics": "one", "routing_aliases": ["A b"]}, "extra": {"k": [1]}}), "ISBN 0306406152"),
        ("b/999-none/Habits and goals.md", "{}", "plain"),
        ("Nothing.md", "{}", ""),
    ]
    files = spark.createDataFrame(rows, "path string, meta string, text string")
    got = {r.path: r for r in metadata.described(files, {"332": "Money"}).collect()}
    a, b, c, d = (got[r[0]] for r in rows)
    assert (a.title, a.author, a.isbn, a.primary_class, a.primary_label, a.classification_source, a.routing_aliases) == (
        "The Title", "Ann Author", {"filename": "9780306406157", "detected_in_text": "0306406152"}, "332", "Money", "folder_path", ["finance", "investing"])
    assert a.topics == ["habits", "money"] and a.book_id == "ann_author_the_title"
    assert (b.title, b.author, b.isbn, b.primary_class, b.classification_source, b.routing_aliases, b.topics) == ("Given", "Me", {"filename": "0306406152", "detected_in_text": "0306406152"}, "650", "existing_frontmatter", ["a_b"], ["one"])
    assert (c.primary_class, c.classification_source) == ("158", "filename/content keyword") and (d.primary_class, d.primary_label, d.title) == ("999", "Unclassified", "Nothing")
    made = {r.path: json.loads(r.front_matter) for r in metadata.front_matter_json(metadata.described(files)).collect()}
    assert made[rows[1][0]]["extra"] == {"k": [1]} and list(made[rows[0][0]])[:4] == ["title", "author", "isbn", "classification"]
    checked = [json.dumps(x) for x in ({"title": "t", "author": "a", "classification": {"scheme": "BMDC", "primary_class": "1", "primary_label": "l"}}, {"title": "t", "classification": {"scheme": "X"}}, {"classification": "no"}, {})]
    df = spark.createDataFrame([(i, m, i < 3) for i, m in enumerate(checked)], "i int, m string, had boolean").orderBy("i")
    assert [r.p for r in df.select(metadata.problems(F.col("m"), F.col("had")).alias("p")).collect()] == [
        [], ["Missing required field: author", "Missing classification.primary_class", "Missing classification.primary_label", "classification.scheme should be BMDC"],
        ["Missing required field: title", "Missing required field: author", "classification must be a mapping"], ["Missing YAML frontmatter block"],
    ]
    wrong = metadata.name_mismatches(metadata.described(files).where("path LIKE 'b/%'")).collect()
    assert {(r.current_name, r.expected_name) for r in wrong} == {("Name.md", "Given - Me - 0306406152.md")}


def test_classes_by_words(spark):
    rows = [("Money and markets", "habit habits success motivation mindset"), ("Habits", "money"), ("", "nothing"), ("Python code", "x")]
    df = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(rows)], "i int, t string, b string")

    def brute(t, b):
        s = {c: sum(8 * (w in t.lower()) + (w in b.lower()) for w in ws) for c, ws in metadata.CLASS_WORDS.items()}
        if not any(s.values()):
            return None
        return "158" if s["158"] >= 8 and s["158"] >= s["332"] - 2 else max(s, key=lambda c: s[c])

    assert [r.guessed_class for r in metadata.with_class(df, F.col("t"), "b").orderBy("i").collect()] == [brute(*r) for r in rows]


def route_brute(q, classes, aliases):
    norm = re.sub(r"\s+", " ", q.lower().replace("_", "-")).strip()
    words = lambda x: set(re.findall(r"[a-z0-9][a-z0-9'\-]{2,}", x.lower())) - set(taxonomy.ROUTE_STOP_WORDS)

    def has(t):
        t = re.sub(r"\s+", " ", t.lower().replace("_", "-")).strip()
        if " " in t or "-" in t:
            return t in norm or t.replace("-", " ") in norm
        return bool(t) and bool(re.search(rf"\b{re.escape(t)}\b", norm))

    s = {}
    for a, (p, sec) in aliases.items():
        v = 4.0 * has(a.replace("_", " "))
        for c in p + sec:
            label, own = classes.get(c, ("", []))
            v += min(2.5, 0.6 * len(words(q) & words(label))) + sum(2.5 for x in own if has(x.replace("_", " ")))
        if v:
            s[a] = s.get(a, 0) + v
    for n, (_, _, terms) in taxonomy.HINTS.items():
        if k := sum(has(t) for t in terms):
            s[n] = s.get(n, 0) + 3 + 1.2 * k
    if not s:
        return [], [], 0.0
    top = max(s.values())
    base = [a for a, v in sorted(s.items(), key=lambda i: (-round(i[1], 6), i[0])) if v >= max(2.5, top * 0.55)][:3]
    sel = list(dict.fromkeys(x for a in base for x in (a, *taxonomy.HINTS.get(a, ((), (), ()))[0])))[:3]
    codes = list(dict.fromkeys(c for a in sel for c in (taxonomy.HINTS[a][1] if a in taxonomy.HINTS else aliases.get(a, ([], []))[0])))
    conf = min(0.98, round(0.35 + top / 12, 2))
    return sel, codes, max(0.35, round(conf - 0.05 * (len(sel) - 1), 2)) if len(sel) > 1 else conf


def test_routes_are_brute_force(spark):
    classes, aliases = taxonomy.taxonomy_tables(spark, TAXONOMY)
    cs, al = {r.code: (r.label, r.aliases) for r in classes.collect()}, {r.alias: (r.primary_codes, r.secondary_codes) for r in aliases.collect()}
    asked = ["What do my books say about compound interest and money?", "self-help habits", "stock market risk", "how do I sleep", "", None, "general management of money", "ai", "said finance", "the risk (of) self_help?"]
    got = {r.query_id: r for r in taxonomy.route_queries(spark.createDataFrame(list(enumerate(asked)), "query_id int, text string"), classes, aliases).collect()}
    for i, q in enumerate(asked):
        assert (got[i].aliases, got[i].class_codes, got[i].confidence) == route_brute(q or "", cs, al), q


def test_aliases_and_filters(spark):
    classes, aliases = taxonomy.taxonomy_tables(spark, TAXONOMY)
    names = spark.createDataFrame([(1, "Self Help"), (1, "finance"), (2, "none")], "query_id int, alias string")
    assert sorted((r.query_id, r.code) for r in taxonomy.codes_of(names, aliases).collect()) == [(1, "158"), (1, "332"), (1, "658")]
    rows = spark.createDataFrame([("1", "A", "332", "158|658"), ("2", "B", "158", None), ("3", "C", None, "658")], "book_id string, title string, primary_class string, secondary_class_text string")
    filters = spark.createDataFrame([(1, None, ["658"]), (2, "A", []), (3, "2", ["158"]), (4, "3", ["158"]), (5, None, None)], "query_id int, book string, codes array<string>")
    got = {}
    for r in taxonomy.allowed(rows, filters).collect():
        got.setdefault(r.query_id, set()).add(r.title)
    assert got == {1: {"A", "C"}, 2: {"A"}, 3: {"B"}, 5: {"A", "B", "C"}}
    assert [r.label for r in taxonomy.with_label(rows, classes).orderBy("book_id").collect()] == ["Financial economics and finance", "Applied psychology", "Unclassified"]
    assert taxonomy.with_label(rows.where("book_id = 1").withColumn("primary_class", F.lit("7")), classes).first().label == "Unknown"
