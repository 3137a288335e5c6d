"""The operators over the driver tables, each with a SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbspark.functions import basename, default_if_empty, has_line, lines_match, strip_extension, text_lines
from plumbspark.operators import (
    Rewrite,
    Rule,
    ScopeRule,
    append_if_absent,
    applicable,
    apply_override_state,
    check_rules,
    classify,
    classify_by_table,
    diff_by_buckets,
    diff_snapshots,
    evaluate_rules,
    latest_matching,
    manifest_items,
    match_globs,
    match_line_patterns,
    match_lines,
    merge_override_states,
    missing_items,
    override_state,
    plan_missing,
    resolve_overrides,
    rewrite_lines,
    run_edit_scripts,
    select_paths,
    unknown_values,
    verdict,
)
from plumbspark.plans.conformance import conformance_report as report
from plumbspark.sources import read_table, small_table

RULE_SCHEMA = "rule_id string, section string, kind string, target string, pattern string, message string"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# DuckDB: the lines of a text, without the empty one after a final newline.
LINES = "string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10))"


def query(sql: str | None = None):
    """Register the function under its own name, with its SQL twin."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


# -- scan ---------------------------------------------------------------------


@query(
    """
    WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT split_part(line, ' ', 1) AS item, count(*) AS n
    FROM lines WHERE NOT starts_with(line, '#') AND split_part(line, ' ', 1) <> ''
    GROUP BY 1
    """
)
def manifest_first_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), "text")
    return manifest_items(docs).groupBy("item").agg(F.count("*").alias("n"))


@query(
    r"""
    WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
    tokens AS (
        SELECT unnest(regexp_split_to_array(line, '\s+')) AS item
        FROM lines WHERE NOT regexp_matches(line, '^\s*#')
    )
    SELECT item, count(*) AS n FROM tokens WHERE item <> '' GROUP BY 1
    """
)
def manifest_all_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), "text")
    items = manifest_items(docs, token="all", comment="indented", strip_nul=True)
    return items.groupBy("item").agg(F.count("*").alias("n"))


@query(
    """
    WITH texts AS (
        SELECT conv_id || '/' || turn AS source, string_split(text, chr(10)) AS lines FROM conversations
    ),
    numbered AS (
        SELECT source, unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS line FROM texts
    )
    SELECT source, line_no, split_part(line, ' ', 1) AS item
    FROM numbered WHERE NOT starts_with(line, '#') AND split_part(line, ' ', 1) <> ''
    """
)
def manifest_numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return manifest_items(turns.select(F.concat_ws("/", "conv_id", "turn").alias("source"), "text"))


@query(
    """
    SELECT page_id, url FROM pages
    WHERE regexp_matches(url, '^.*\\.com/.*$', 's') AND NOT contains(url, '/en/')
    """.replace("\\\\", "\\")
)
def select_page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return select_paths(pages, ["*.com/*"], exclude_substrings=["/en/"], mode="path", path="url")


@query(
    r"""
    WITH named AS (SELECT page_id, url, list_last(string_split(url, '/')) AS name FROM pages)
    SELECT page_id, url FROM named
    WHERE (ends_with(name, '.html') OR regexp_matches(name, '^[0-46-9].*[?]utm_.*$', 's'))
      AND NOT contains(url, '/blog.') AND NOT ends_with(url, '#top')
      AND len(string_split(url, '/')) <= 5
    """
)
def select_page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return select_paths(
        pages,
        ["*.html", "[!5]*[?]utm_*"],
        exclude_substrings=["/blog."],
        exclude_suffixes=["#top"],
        max_depth=5,
        path="url",
    )


@query(
    f"""
    WITH numbered AS (
        SELECT doc_id, unnest({LINES}) AS line, unnest(range(1, len({LINES}) + 1)) AS line_no FROM documents
    )
    SELECT doc_id, count(*) AS n_lines, min(line_no) AS first_line_no
    FROM numbered WHERE regexp_matches(line, '(?i)licen[sc]e') GROUP BY 1
    """
)
def match_license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return match_lines(docs, "licen[sc]e", ignore_case=True, keys=["doc_id"])


@query(
    rf"""
    WITH numbered AS (
        SELECT doc_id, unnest({LINES}) AS line, unnest(range(1, len({LINES}) + 1)) AS line_no
        FROM documents WHERE text <> ''
    )
    SELECT doc_id, count(*) AS n_lines, min(line_no) AS first_line_no
    FROM numbered WHERE NOT regexp_matches(line, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])(the|der|la)([^\p{{L}}\p{{M}}\p{{N}}_]|$)') GROUP BY 1
    """
)
def match_lines_without_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return match_lines(docs, "the|der|la", mode="word", invert=True, keys=["doc_id"])


@query(
    rf"""
    WITH flags AS (
        SELECT source, contains(text, 'License') AS fixed,
               list_contains({LINES}, 'Page not found.') AS whole_line,
               len(list_filter({LINES}, lambda l: regexp_matches(l, '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])copyright([^\p{{L}}\p{{M}}\p{{N}}_]|$)'))) > 0 AS word,
               len(list_filter({LINES}, lambda l: regexp_matches(l, '^[A-Z]\w+\.$'))) > 0 AS one_word,
               len(list_filter({LINES}, lambda l: NOT regexp_matches(l, 'e'))) > 0 AS without_e
        FROM documents
    )
    SELECT source, count(*) FILTER (WHERE fixed) AS n_fixed, count(*) FILTER (WHERE whole_line) AS n_whole_line,
           count(*) FILTER (WHERE word) AS n_word, count(*) FILTER (WHERE one_word) AS n_one_word, count(*) FILTER (WHERE without_e) AS n_without_e
    FROM flags GROUP BY source
    """
)
def line_presence_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = read_table(spark, sf_dir, "documents").select("source", "text", text_lines("text").alias("lines"))
    flags = split.select(
        "source",
        has_line("text", "License", "fixed").alias("fixed"),
        has_line("text", "Page not found.", "fixed_line").alias("whole_line"),
        lines_match("lines", "copyright", "word", ignore_case=True).alias("word"),
        lines_match("lines", r"[A-Z]\w+\.", "regex_line").alias("one_word"),
        lines_match("lines", "e", "regex", invert=True).alias("without_e"),
    )
    return flags.groupBy("source").agg(*[F.count_if(c).alias(f"n_{c}") for c in flags.columns[1:]])


@query(
    r"""
    WITH named AS (SELECT page_id, url, list_last(string_split(url, '/')) AS name FROM pages)
    SELECT page_id, CASE WHEN regexp_replace(name, '[.][^.]*$', '') = '' THEN 'index' ELSE regexp_replace(name, '[.][^.]*$', '') END AS stem
    FROM named
    """
)
def page_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", default_if_empty(strip_extension(basename("url")), "index").alias("stem"))


@query(
    """
    WITH globs AS (
        SELECT page_id AS glob_id, CASE page_id % 4 WHEN 0 THEN left(url, length(url) - 6) || '%' WHEN 1 THEN 'http%' || right(url, 9)
            WHEN 2 THEN '%' || substr(url, 9, 12) || '%' ELSE replace(url, '3', '_') END AS pattern
        FROM pages)
    SELECT p.page_id, glob_id FROM pages p JOIN globs ON p.url LIKE pattern
    """
)
def match_page_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against a glob made from every page: beginnings, ends, pieces and single characters."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    url, way = F.col("url"), F.col("page_id") % 4
    escaped = lambda x: F.replace(x, F.lit("?"), F.lit("[?]"))
    glob = (
        F.when(way == 0, F.concat(escaped(F.left(url, F.length(url) - 6)), F.lit("*")))
        .when(way == 1, F.concat(F.lit("http*"), escaped(F.right(url, F.lit(9)))))
        .when(way == 2, F.concat(F.lit("*"), escaped(F.substring(url, 9, 12)), F.lit("*")))
        .otherwise(F.replace(escaped(url), F.lit("3"), F.lit("?")))
    )
    globs = pages.select(F.col("page_id").alias("glob_id"), glob.alias("glob"))
    return match_globs(pages, globs, path="url", mode="path").select("page_id", "glob_id")


@query(
    rf"""
    WITH numbered AS (
        SELECT doc_id, unnest({LINES}) AS line, unnest(range(1, len({LINES}) + 1)) AS line_no FROM documents),
    patterns(pattern_id, pattern) AS (VALUES ('license', '(?i)licen[sc]e'), ('notice', 'Copyright|All rights'), ('mail', '[a-z]+@example'),
        ('sentence', '^The .*[.]$'), ('page', 'Page not'), ('digits', '[0-9]{{6}}')),
    asked AS (SELECT * FROM patterns UNION ALL SELECT 'name ' || n_nationkey, 'th' || lower(right(n_name, 1)) || ' ' FROM nation)
    SELECT doc_id, pattern_id, count(*) AS n_lines, min(line_no) AS first_line_no
    FROM numbered JOIN asked ON regexp_matches(line, pattern) GROUP BY ALL
    """
)
def match_pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that match any of a table of patterns."""
    given = [
        ("license", "licen[sc]e", True), ("notice", "Copyright|All rights", None), ("mail", "[a-z]+@example", None),
        ("sentence", "^The .*[.]$", None), ("page", "Page not", None), ("digits", "[0-9]{6}", None),
    ]
    patterns = small_table(spark, given, "pattern_id string, pattern string, ignore_case boolean")
    nations = read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit("name "), "n_nationkey").alias("pattern_id"),
        F.concat(F.lit("th"), F.lower(F.right("n_name", F.lit(1))), F.lit(" ")).alias("pattern"), F.lit(False).alias("ignore_case"),
    )
    return match_line_patterns(read_table(spark, sf_dir, "documents"), patterns.unionByName(nations), ["doc_id"])


# -- rules --------------------------------------------------------------------

# What the documents are checked for, and where each check applies.
DOCUMENT_RULES = [
    Rule("license", "contains(text, 'License')", "legal", on_fail="no license line"),
    Rule("english_article", "contains(text, ' the ')", "style", applies="lang = 'en'"),
    Rule("german_article", "contains(text, ' der ')", "style", applies="lang = 'de'"),
]
DOCUMENT_RESULTS_SQL = """
    WITH rules(section, rule_id, scope, needle, on_fail) AS (VALUES
        ('legal', 'license', '*', 'License', 'no license line'),
        ('style', 'english_article', 'en', ' the ', ''),
        ('style', 'german_article', 'de', ' der ', '')
    ),
    results AS (
        SELECT doc_id, source, section, rule_id, on_fail,
               CASE WHEN scope <> '*' AND scope <> lang THEN 'skip'
                    WHEN contains(text, needle) THEN 'pass' ELSE 'fail' END AS status
        FROM documents CROSS JOIN rules
    )
"""


@query(
    DOCUMENT_RESULTS_SQL
    + """
    SELECT doc_id, section, rule_id, status, CASE WHEN status = 'fail' THEN on_fail ELSE '' END AS message
    FROM results
    """
)
def evaluate_document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_rules(read_table(spark, sf_dir, "documents"), DOCUMENT_RULES, ["doc_id"])


@query(
    """
    WITH checks AS (
        SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled, coalesce(l.quality = 1, false) AS good,
               coalesce(l.toxic = 0, false) AS clean
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    ),
    results AS (
        SELECT doc_id, 'labelled' AS rule_id, labelled AS ok FROM checks
        UNION ALL SELECT doc_id, 'good', good FROM checks WHERE labelled
        UNION ALL SELECT doc_id, 'clean', clean FROM checks WHERE labelled AND good
    )
    SELECT doc_id, 'review' AS section, rule_id, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status, '' AS message
    FROM results
    """
)
def evaluate_dependent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    facts = docs.join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    rules = [
        Rule("labelled", F.coalesce(F.col("quality"), F.col("toxic")).isNotNull(), "review"),
        Rule("good", "quality = 1", "review", requires=("labelled",)),
        Rule("clean", "toxic = 0", "review", requires=("good",)),
    ]
    return evaluate_rules(facts, rules, ["doc_id"])


@query(
    """
    WITH found AS (
        SELECT d.doc_id, d.lang,
               regexp_matches(d.text, '(?i)licen[sc]e') AS license,
               regexp_matches(d.text, '[a-z0-9.]+@[a-z0-9]+') AS contact,
               coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 0, false) AS clean
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    ),
    asked AS (
        SELECT doc_id, 'english' AS section, 'license' AS rule_id, lang = 'en' AS applies, license AS ok, true AS evaluated FROM found
        UNION ALL SELECT doc_id, 'english', 'contact', lang = 'en', contact, license OR lang <> 'en' FROM found
        UNION ALL SELECT doc_id, 'german', 'kontakt', lang = 'de', contact, true FROM found
        UNION ALL SELECT doc_id, 'review', 'good', true, good, true FROM found
        UNION ALL SELECT doc_id, 'review', 'clean', true, clean, good FROM found
    )
    SELECT doc_id, section, rule_id,
           CASE WHEN NOT applies THEN 'skip' WHEN ok THEN 'pass' ELSE 'fail' END AS status,
           'checks ' || rule_id AS message
    FROM asked WHERE evaluated
    """
)
def check_document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scopes = [ScopeRule("english", "lang", "en"), ScopeRule("german", "lang", "de"), ScopeRule("review")]
    rules = small_table(
        spark,
        [
            ("license", "english", "line", "en", "(?i)licen[sc]e", "checks license"),
            ("contact", "english", "line", "en", "[a-z0-9.]+@[a-z0-9]+", "checks contact"),
            ("kontakt", "german", "line", "de", "[a-z0-9.]+@[a-z0-9]+", "checks kontakt"),
            ("good", "review", "quality", "1", None, "checks good"),
            ("clean", "review", "toxic", "0", None, "checks clean"),
        ],
        RULE_SCHEMA,
    )
    needs = [("contact", "license"), ("clean", "good")]
    labelled = labels.select(
        "doc_id", F.stack(F.lit(2), F.lit("quality"), "quality", F.lit("toxic"), "toxic").alias("kind", "name")
    )
    return check_rules(
        applicable(documents, scopes, ["doc_id"], keep_all=True),
        rules,
        inventory=labelled.withColumn("name", F.col("name").cast("string")),
        docs=documents.select("doc_id", F.col("lang").alias("path"), "text"),
        prerequisites=needs,
        entity="doc_id",
    )


@query(
    """
    WITH rules(rule_id, section, kind, target) AS (VALUES
        ('urgent', 'orders', 'priority', '1-URGENT'), ('open', 'orders', 'status', 'O'),
        ('done', 'orders', 'status', 'F'), ('rush', 'machines', 'priority', '1-URGENT')
    ),
    asked AS (
        SELECT c_custkey, section, rule_id, kind, target FROM customer, rules
        WHERE section = 'orders' OR c_mktsegment = 'MACHINERY'
    ),
    inventory AS (
        SELECT DISTINCT o_custkey, 'priority' AS kind, o_orderpriority AS name FROM orders
        UNION SELECT DISTINCT o_custkey, 'status', o_orderstatus FROM orders
    )
    SELECT c_custkey, section, rule_id, CASE WHEN o_custkey IS NULL THEN 'fail' ELSE 'pass' END AS status, '' AS message
    FROM asked LEFT JOIN inventory ON o_custkey = c_custkey AND inventory.kind = asked.kind AND name = target
    """
)
def check_inventory_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    scopes = [ScopeRule("orders"), ScopeRule("machines", "c_mktsegment", "MACHINERY")]
    rules = small_table(
        spark,
        [
            ("urgent", "orders", "priority", "1-URGENT", None, ""),
            ("open", "orders", "status", "O", None, ""),
            ("done", "orders", "status", "F", None, ""),
            ("rush", "machines", "priority", "1-URGENT", None, ""),
        ],
        RULE_SCHEMA,
    )
    inventory = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.stack(F.lit(2), F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus").alias("kind", "name"),
    )
    return check_rules(applicable(customers, scopes, ["c_custkey"]), rules, inventory, entity="c_custkey")


@query(
    """
    WITH RECURSIVE needs(rule_id, requires) AS (VALUES ('contact', 'license'), ('long', 'contact'), ('article', 'long'), ('article', 'license')),
    closed AS (
        SELECT rule_id, requires FROM needs
        UNION SELECT c.rule_id, n.requires FROM closed c JOIN needs n ON n.rule_id = c.requires
    ),
    checks AS (
        SELECT doc_id, regexp_matches(text, '(?i)licen[sc]e') AS license, regexp_matches(text, '[0-9]') AS contact,
               regexp_matches(text, '[^\n]{200}') AS long, regexp_matches(text, ' (the|der) ') AS article FROM documents
    ),
    results AS (
        SELECT doc_id, 'license' AS rule_id, license AS ok FROM checks UNION ALL SELECT doc_id, 'contact', contact FROM checks
        UNION ALL SELECT doc_id, 'long', long FROM checks UNION ALL SELECT doc_id, 'article', article FROM checks
    ),
    blocked AS (SELECT DISTINCT r.doc_id, c.rule_id FROM results r JOIN closed c ON c.requires = r.rule_id WHERE NOT r.ok)
    SELECT doc_id, 'chain' AS section, rule_id, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status, '' AS message
    FROM results ANTI JOIN blocked USING (doc_id, rule_id)
    """
)
def check_rule_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.lit("text").alias("path"), "text")
    probes = [("license", "(?i)licen[sc]e"), ("contact", "[0-9]"), ("long", ".{200}"), ("article", " (the|der) ")]
    rules = small_table(spark, [(r, "chain", "line", "text", p, "") for r, p in probes], RULE_SCHEMA)
    needs = [("contact", "license"), ("long", "contact"), ("article", "long"), ("article", "license")]
    return check_rules(
        applicable(docs, [ScopeRule("chain")], ["doc_id"]), rules, docs=docs, prerequisites=needs, entity="doc_id"
    )


@query(
    rf"""
    WITH split AS (SELECT doc_id, lang, text, {LINES} AS lines FROM documents),
    checks AS (
        SELECT doc_id,
               lang = 'en' AND len(list_filter(lines, lambda l: regexp_matches(l, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])the([^\p{{L}}\p{{M}}\p{{N}}_]|$)'))) > 0 AS word,
               NOT (lang = 'en' AND contains(text, 'License')) AS unlicensed,
               NOT (lang = 'en' AND len(list_filter(lines, lambda l: ends_with(l, '.'))) > 2) AS few,
               lang = 'de' AND len(list_filter(lines, lambda l: ends_with(l, '.'))) > 0 AS ends,
               lang = 'en' AND (len(list_filter(lines, lambda l: regexp_matches(l, '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])copyright([^\p{{L}}\p{{M}}\p{{N}}_]|$)'))) > 0
                   OR contains(lower(text), 'page')) AS either,
               lang = 'fr' AND list_contains(lines, 'Page not found.') AS whole,
               lang <> 'en' AS absent
        FROM split
    ),
    results AS (UNPIVOT checks ON word, unlicensed, few, ends, either, whole, absent INTO NAME rule_id VALUE ok)
    SELECT doc_id, 'lines' AS section, rule_id, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status, '' AS message FROM results
    """
)
def check_rule_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("path"), "text")
    rules = small_table(
        spark,
        [
            ("word", "lines", "line", "en", "the", "", "word", None, None),
            ("unlicensed", "lines", "line", "en", "License", "", "fixed", None, 0),
            ("few", "lines", "line", "en", r"\.$", "", None, None, 2),
            ("ends", "lines", "line", "de", ".", "", "suffix", None, None),
            ("either", "lines", "line", "en", "copyright", "", "word", True, None),
            ("either", "lines", "line", "en", "PAGE", "", "fixed", True, None),
            ("whole", "lines", "line", "fr", "Page not found.", "", "fixed_line", None, None),
            ("absent", "lines", "lang", "en", None, "", None, None, 0),
        ],
        RULE_SCHEMA + ", mode string, ignore_case boolean, max_count bigint",
    )
    languages = docs.select("doc_id", F.lit("lang").alias("kind"), F.col("path").alias("name"))
    return check_rules(
        applicable(docs, [ScopeRule("lines")], ["doc_id"]), rules, languages, docs, entity="doc_id"
    )


@query(
    r"""
    WITH checks AS (
        SELECT d.doc_id, d.lang, (d.lang = 'en' AND regexp_matches(text, '(?i)licen[sc]e')) OR (d.lang = 'de' AND regexp_matches(text, 'Lizenz|[0-9]')) OR coalesce(l.quality = 1, false) AS notice,
               d.lang = 'de' AND regexp_matches(text, '[0-9]{3}') OR coalesce(l.toxic = 0, false) AS digits
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT doc_id, CASE lang WHEN 'en' THEN 'english' ELSE 'german' END AS section, 'notice' AS rule_id,
           CASE WHEN notice THEN 'pass' ELSE 'fail' END AS status, 'keine Lizenz' AS message
    FROM checks WHERE lang IN ('en', 'de')
    UNION ALL
    SELECT doc_id, 'german', 'digits', CASE WHEN digits THEN 'pass' ELSE 'fail' END, 'keine Zahl' FROM checks WHERE lang = 'de'
    """
)
def check_rule_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of one rule that differ in path, section and message."""
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    rules = small_table(
        spark,
        [
            ("notice", "english", "line", "en", "(?i)licen[sc]e", "no license"),
            ("notice", "german", "line", "de", "Lizenz|[0-9]", "keine Lizenz"),
            ("notice", "german", "quality", "1", None, "keine Pruefung"),
            ("digits", "german", "line", "de", "[0-9]{3}", "keine Zahl"),
            ("digits", "german", "toxic", "0", None, "unsauber"),
        ],
        RULE_SCHEMA,
    )
    labelled = labels.select(
        "doc_id", F.stack(F.lit(2), F.lit("quality"), "quality", F.lit("toxic"), "toxic").alias("kind", "name")
    )
    scopes = [ScopeRule("english", "lang", "en"), ScopeRule("german", "lang", "de")]
    return check_rules(
        applicable(documents, scopes, ["doc_id"]),
        rules,
        inventory=labelled.withColumn("name", F.col("name").cast("string")),
        docs=documents.select("doc_id", F.col("lang").alias("path"), "text"),
        entity="doc_id",
    )


@query(
    """
    WITH months AS (SELECT DISTINCT month(o_orderdate) AS m FROM orders),
    bought AS (SELECT DISTINCT o_custkey, month(o_orderdate) AS m FROM orders),
    results AS (
        SELECT c_custkey, months.m, o_custkey IS NOT NULL AS ok
        FROM customer CROSS JOIN months LEFT JOIN bought ON o_custkey = c_custkey AND bought.m = months.m),
    stopped AS (SELECT c_custkey, min(m) AS first_gap FROM results WHERE NOT ok GROUP BY c_custkey)
    SELECT c_custkey, 'orders' AS section, 'month ' || m AS rule_id, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status, '' AS message
    FROM results LEFT JOIN stopped USING (c_custkey) WHERE first_gap IS NULL OR m <= first_gap
    """
)
def check_rule_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and a long chain of prerequisites that both come from a table: an order in every month needs one in the month before."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", F.month("o_orderdate").alias("m"))
    months = orders.select("m").distinct()
    named = lambda m: F.concat(F.lit("month "), m)
    rules = months.select(
        named(F.col("m")).alias("rule_id"), F.lit("orders").alias("section"), F.lit("month").alias("kind"),
        F.col("m").cast("string").alias("target"), F.lit(None).cast("string").alias("pattern"), F.lit("").alias("message"),
    )
    needs = months.filter("m > 1").select(named(F.col("m")).alias("rule_id"), named(F.col("m") - 1).alias("requires"))
    inventory = orders.select(F.col("o_custkey").alias("c_custkey"), F.lit("month").alias("kind"), F.col("m").cast("string").alias("name"))
    pairs = read_table(spark, sf_dir, "customer").select("c_custkey", F.lit("orders").alias("section"))
    return check_rules(pairs, rules, inventory, prerequisites=needs, entity="c_custkey")


@query(
    DOCUMENT_RESULTS_SQL
    + """
    SELECT source, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail,
           count(*) FILTER (WHERE status = 'skip') AS n_skip, bool_or(status = 'fail') AS failed
    FROM results GROUP BY source
    """
)
def verdict_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return verdict(evaluate_rules(docs, DOCUMENT_RULES, ["doc_id", "source"]), ["source"])


@query(
    DOCUMENT_RESULTS_SQL
    + """
    SELECT count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'fail') AS n_fail,
           count(*) FILTER (WHERE status = 'skip') AS n_skip, coalesce(bool_or(status = 'fail'), false) AS failed
    FROM results
    """
)
def verdict_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict(evaluate_document_rules(spark, sf_dir))


@query(
    """
    SELECT d.doc_id, count(*) FILTER (WHERE quality = 1) + count(*) FILTER (WHERE toxic = 0) AS n_pass,
           count(*) FILTER (WHERE quality = 0) + count(*) FILTER (WHERE toxic = 1) AS n_fail, CAST(0 AS BIGINT) AS n_skip,
           coalesce(bool_or(quality = 0 OR toxic = 1), false) AS failed
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id
    """
)
def verdict_with_unchecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule("good", "quality = 1"), Rule("clean", "toxic = 0")]
    results = evaluate_rules(read_table(spark, sf_dir, "labels"), rules, ["doc_id"])
    return verdict(results, ["doc_id"], entities=read_table(spark, sf_dir, "documents"))


@query(
    """
    WITH scopes(section, scope) AS (VALUES ('base', '*'), ('currency', 'EUROPE'), ('shipping', 'ASIA'))
    SELECT n_name, section FROM nation JOIN region ON n_regionkey = r_regionkey
    JOIN scopes ON scope = '*' OR scope = r_name
    """
)
def applicable_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = read_table(spark, sf_dir, "region")
    nations = read_table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    scopes = [ScopeRule("base"), ScopeRule("currency", "r_name", "EUROPE"), ScopeRule("shipping", "r_name", "ASIA")]
    return applicable(nations, scopes, ["n_name"])


@query(
    """
    SELECT c_custkey, 'desk ' || r_name AS section
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE n_name NOT IN (SELECT n_name FROM nation WHERE ends_with(n_name, '7'))
    UNION ALL SELECT c_custkey, 'post' FROM customer WHERE c_mktsegment <> 'BUILDING'
    """
)
def applicable_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    located = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = (
        read_table(spark, sf_dir, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_mktsegment", "n_regionkey", "n_name")
    )
    desk = F.concat(F.lit("desk "), "r_name")
    desks = regions.select(
        desk.alias("section"), F.lit("n_regionkey").alias("attribute"),
        F.col("r_regionkey").cast("string").alias("value"), F.lit("include").alias("effect"),
    )
    closed = located.filter(F.col("n_name").endswith("7")).select(
        desk.alias("section"), F.lit("n_name").alias("attribute"), F.col("n_name").alias("value"),
        F.lit("exclude").alias("effect"),
    )
    post = small_table(
        spark,
        [("post", "*", "*", "include"), ("post", "c_mktsegment", "BUILDING", "exclude")],
        "section string, attribute string, value string, effect string",
    )
    return applicable(
        customers,
        desks.unionByName(closed).unionByName(post),
        ["c_custkey"],
        attributes=["c_mktsegment", "n_regionkey", "n_name"],
    )


@query(
    """
    SELECT CASE WHEN starts_with(url, 'https://m.') OR starts_with(url, 'http://m.') THEN 'mobile'
                WHEN contains(url, '//blog.') THEN 'blog'
                WHEN starts_with(url, 'https:') THEN 'secure' ELSE 'unknown' END AS label,
           count(*) AS n
    FROM pages GROUP BY 1
    """
)
def classify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    cases = [
        ("mobile", url.startswith("https://m.") | url.startswith("http://m.")),
        ("blog", url.contains("//blog.")),
        ("secure", url.startswith("https:")),
    ]
    return classify(read_table(spark, sf_dir, "pages"), cases).groupBy("label").agg(F.count("*").alias("n"))


@query(
    """
    SELECT page_id, label FROM (
        SELECT page_id, CASE WHEN starts_with(url, 'https://m.') OR starts_with(url, 'http://m.') THEN 'mobile'
                WHEN regexp_matches(url, '//blog[.][a-z]+er[a-z]*[.]') THEN 'blog'
                WHEN n_name IS NOT NULL THEN 'numbered ' || n_nationkey
                WHEN starts_with(url, 'https:') THEN 'secure' ELSE 'unknown' END AS label
        FROM pages LEFT JOIN nation ON ends_with(url, n_nationkey || '.html') AND n_nationkey >= 10)
    """
)
def classify_pages_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked beginnings, ends and regexes, some of which come from a table."""
    given = small_table(
        spark,
        [
            (1, "mobile", "url", "begins", "https://m."),
            (1, "mobile", "url", "begins", "http://m."),
            (2, "blog", "url", "regex", "//blog[.][a-z]+er[a-z]*[.]"),
            (4, "secure", "url", "begins", "https:"),
        ],
        "rank int, label string, attribute string, kind string, value string",
    )
    key = F.col("n_nationkey")
    numbered = read_table(spark, sf_dir, "nation").filter(key >= 10).select(
        F.lit(3).alias("rank"), F.concat(F.lit("numbered "), key).alias("label"), F.lit("url").alias("attribute"),
        F.lit("ends").alias("kind"), F.concat(key, F.lit(".html")).alias("value"),
    )
    return classify_by_table(read_table(spark, sf_dir, "pages"), given.unionByName(numbered), ["page_id"], ["url"])


# -- state --------------------------------------------------------------------


def _line_orders(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").filter(condition).select(F.col("l_orderkey").alias("o_orderkey"))


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
        OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_discount = 0)
        THEN 'ok' ELSE 'install' END AS action
    FROM orders
    """
)
def plan_missing_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    desired = read_table(spark, sf_dir, "orders")
    returned = _line_orders(spark, sf_dir, "l_returnflag = 'R' AND l_quantity > 45")
    full_price = _line_orders(spark, sf_dir, "l_linestatus = 'O' AND l_discount = 0")
    return plan_missing(desired, [returned, full_price], "o_orderkey")


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
        AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')
        THEN 'ok' ELSE 'install' END AS action
    FROM orders
    """
)
def plan_missing_in_any_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    desired = read_table(spark, sf_dir, "orders")
    actual = [_line_orders(spark, sf_dir, c) for c in ("l_returnflag = 'R'", "l_linestatus = 'O'")]
    return plan_missing(desired, actual, "o_orderkey", presence="all")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_items(read_table(spark, sf_dir, "orders"), _line_orders(spark, sf_dir, "true"), "o_orderkey")


@query(
    """
    SELECT event_type, count(*) AS n_rows FROM events
    WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1
    """
)
def unknown_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unknown_values(read_table(spark, sf_dir, "events"), "event_type", ["click", "view", "purchase"])


@query(
    """
    SELECT o_custkey, count(*) AS n_rows FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY 1
    """
)
def unknown_order_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = read_table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    orders = read_table(spark, sf_dir, "orders")
    return unknown_values(orders, "o_custkey", allowed.select(F.col("c_custkey").alias("o_custkey")))


def _user_settings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = read_table(spark, sf_dir, "events")
    sections = F.array(*map(F.lit, ["news", "offers", "alerts"]))
    defaults = (
        events.select("user_id").distinct().select("user_id", F.explode(sections).alias("section"))
        .withColumn("enabled", F.col("section") == "news")
    )
    k = F.get_json_object("props", "$.k").cast("int")
    flag = (
        F.when(F.col("event_type") == "signup", "enable")
        .when(F.col("event_type") == "error", "skip")
        .when(F.col("event_type") == "purchase", "only")
        .when((F.col("event_type") == "click") & (k >= 95), "all")
    )
    directives = events.select(
        "user_id", "ts", "event_id", flag.alias("flag"),
        F.array(F.when(k < 33, "news").when(k < 66, "offers").otherwise("alerts")).alias("sections"),
    ).filter(F.col("flag").isNotNull())
    return defaults, directives


@query(
    """
    WITH keys(section) AS (VALUES ('news'), ('offers'), ('alerts')),
    said AS (
        SELECT user_id, ts, event_id, event_type,
               CASE WHEN k < 33 THEN 'news' WHEN k < 66 THEN 'offers' ELSE 'alerts' END AS listed, k
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
    ),
    touched AS (
        SELECT user_id, section, ts, event_id,
               CASE WHEN event_type = 'signup' THEN true WHEN event_type = 'error' THEN false
                    WHEN event_type = 'purchase' THEN section = listed ELSE true END AS value
        FROM said CROSS JOIN keys
        WHERE (event_type IN ('signup', 'error') AND section = listed)
           OR event_type = 'purchase' OR (event_type = 'click' AND k >= 95)
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY user_id, section ORDER BY ts DESC, event_id DESC) AS rank FROM touched
    )
    SELECT u.user_id, k.section, coalesce(r.value, k.section = 'news') AS enabled
    FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN keys k
    LEFT JOIN ranked r ON r.user_id = u.user_id AND r.section = k.section AND rank = 1
    """
)
def resolve_user_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults, directives = _user_settings(spark, sf_dir)
    return resolve_overrides(defaults, directives, ["ts", "event_id"], entity="user_id")


@query(SQL["resolve_user_settings"])
def resolve_settings_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the states of three parts of the directives, each made for itself, then merged."""
    defaults, directives = _user_settings(spark, sf_dir)
    order = ["ts", "event_id"]
    parts = [override_state(directives.filter(F.pmod(F.dayofyear("ts"), F.lit(3)) == k), order, entity="user_id") for k in (1, 0, 2)]
    state = merge_override_states([merge_override_states(parts[:2], "user_id"), parts[2]], "user_id")
    return apply_override_state(defaults, state, entity="user_id")


@query(
    """
    WITH source AS (
        SELECT doc_id, replace(text, 'the', 'THE') AS text FROM documents WHERE lang <> 'fr'
    ),
    target AS (SELECT d.doc_id, d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
    SELECT coalesce(s.doc_id, t.doc_id) AS doc_id,
           CASE WHEN t.doc_id IS NULL THEN 'missing' WHEN s.doc_id IS NULL THEN 'extra'
                WHEN s.text = t.text THEN 'same' ELSE 'different' END AS status,
           CASE WHEN s.doc_id IS NULL THEN 'warn' WHEN s.text = t.text THEN 'none' ELSE 'deploy' END AS action
    FROM source s FULL JOIN target t ON s.doc_id = t.doc_id
    """
)
def diff_document_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rewritten = rewrite_lines(docs.filter("lang <> 'fr'"), [Rewrite("the", "THE", "all", literal=True)])
    labelled = docs.join(read_table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return diff_snapshots(rewritten, labelled, "doc_id", "text", repeated_keys=False)


@query(
    """
    WITH target AS (
        SELECT doc_id, CASE WHEN doc_id % 101 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 97 <> 5
        UNION ALL SELECT -doc_id - 1, text FROM documents WHERE doc_id % 103 = 0)
    SELECT coalesce(s.doc_id, t.doc_id) AS doc_id,
           CASE WHEN t.doc_id IS NULL THEN 'missing' WHEN s.doc_id IS NULL THEN 'extra' ELSE 'different' END AS status,
           CASE WHEN s.doc_id IS NULL THEN 'warn' ELSE 'deploy' END AS action
    FROM documents s FULL JOIN target t ON s.doc_id = t.doc_id
    WHERE s.text IS DISTINCT FROM t.text
    """
)
def diff_document_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a copy with few changes, by digests of buckets first."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = F.when(F.col("doc_id") % 101 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    more = docs.filter(F.col("doc_id") % 103 == 0).select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    target = docs.filter(F.col("doc_id") % 97 != 5).select("doc_id", edited.alias("text")).unionByName(more)
    return diff_by_buckets(docs, target, "doc_id", "text")


@query(
    """
    WITH actual AS (
        SELECT l_orderkey AS o_orderkey,
               CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS status
        FROM lineitem GROUP BY 1
    )
    SELECT coalesce(o.o_orderkey, a.o_orderkey) AS o_orderkey,
           CASE WHEN a.o_orderkey IS NULL THEN 'missing' WHEN o.o_orderkey IS NULL THEN 'extra'
                WHEN o_orderstatus = a.status THEN 'same' ELSE 'different' END AS status,
           CASE WHEN o.o_orderkey IS NULL THEN 'warn' WHEN o_orderstatus = a.status THEN 'none' ELSE 'deploy' END AS action
    FROM orders o FULL JOIN actual a ON o.o_orderkey = a.o_orderkey
    """
)
def diff_order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    state = (
        F.when(F.bool_and(F.col("l_linestatus") == "F"), "F")
        .when(F.bool_and(F.col("l_linestatus") == "O"), "O")
        .otherwise("P")
    )
    actual = lines.agg(state.alias("o_orderstatus"))
    return diff_snapshots(read_table(spark, sf_dir, "orders"), actual, "o_orderkey", "o_orderstatus")


# -- select -------------------------------------------------------------------

BRANDS = {"column": "p_brand", "regex": r"Brand#(\d+)", "casts": {"number": (1, "int")}, "order": ["number"]}


@query(
    r"""
    SELECT coalesce((
        SELECT p_brand || ' ' || p_partkey FROM part
        WHERE CAST(regexp_extract(p_brand, 'Brand#(\d+)', 1) AS INTEGER) % 2 = 0
        ORDER BY CAST(regexp_extract(p_brand, 'Brand#(\d+)', 1) AS INTEGER) DESC, p_partkey DESC LIMIT 1
    ), 'Brand#0') AS latest
    """
)
def latest_even_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part")
    return latest_matching(
        parts, **{**BRANDS, "order": ["number", "p_partkey"]}, predicate="number % 2 = 0",
        label="concat_ws(' ', p_brand, p_partkey)", fallback="Brand#0",
    )


@query(
    r"""
    SELECT coalesce((
        SELECT max(p_brand) FROM part WHERE CAST(regexp_extract(p_brand, 'Brand#(\d+)', 1) AS INTEGER) > 1000
    ), 'Brand#0') AS latest
    """
)
def latest_brand_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part")
    return latest_matching(parts, **BRANDS, predicate="number > 1000", label="p_brand", fallback="Brand#0")


# -- rewrite ------------------------------------------------------------------

BLOCK = "\n# >>> managed >>>\nLicense: see the register\n# <<< managed <<<\n"


def _digest(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.select(*keys, F.md5("text").alias("text_md5"), "changed")


@query(
    f"""
    SELECT doc_id, NOT contains(text, 'License') AS changed,
           md5(CASE WHEN contains(text, 'License') THEN text
               ELSE text || '{BLOCK}' END) AS text_md5
    FROM documents
    """
)
def append_license_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(append_if_absent(docs, "License", BLOCK), "doc_id")


@query(
    r"""
    WITH marked AS (
        SELECT *, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^T\w+ .*\.$'))) > 0 AS present
        FROM conversations
    )
    SELECT conv_id, turn, NOT present AS changed,
           md5(CASE WHEN present THEN text
               ELSE rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10) || 'The end.' END) AS text_md5
    FROM marked
    """
)
def append_closing_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    edited = append_if_absent(turns, r"^T\w+ .*\.$", "\nThe end.", marker_mode="regex", trim_end=True)
    return _digest(edited, "conv_id", "turn")


@query(
    """
    WITH edited AS (
        SELECT doc_id, text, array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, 'the', 'THE')), chr(10)) AS new
        FROM documents
    )
    SELECT doc_id, md5(new) AS text_md5, new <> text AS changed FROM edited
    """
)
def rewrite_first_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(rewrite_lines(docs, [Rewrite("the", "THE")]), "doc_id")


@query(
    """
    WITH edited AS (
        SELECT doc_id, text, CASE WHEN contains(text, ' an ') OR instr(text, ' the ') = 0 THEN text
            ELSE left(text, instr(text, ' the ') - 1) || ' an ' || substr(text, instr(text, ' the ') + 5) END AS new
        FROM documents
    )
    SELECT doc_id, md5(new) AS text_md5, new <> text AS changed FROM edited
    """
)
def rewrite_first_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rewrite = Rewrite(" the ", " an ", "first_per_doc", literal=True, unless=" an ")
    return _digest(rewrite_lines(docs, [rewrite]), "doc_id")


@query(
    r"""
    WITH steps AS (
        SELECT doc_id, text, array_to_string(list_transform(string_split(text, chr(10)),
            lambda l: regexp_replace(regexp_replace(l, '^(\w+) (\w+)', '\2 \1'), '[aeiou]{2}', '<>', 'g')), chr(10)) AS one
        FROM documents
    ),
    edited AS (SELECT doc_id, text, regexp_replace(replace(one, '. ', '; '), '<>(\w)', '\1<>') AS new FROM steps)
    SELECT doc_id, md5(new) AS text_md5, new <> text AS changed FROM edited
    """
)
def rewrite_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rewrites = [
        Rewrite(r"^(\w+) (\w+)", "$2 $1"),
        Rewrite("[aeiou]{2}", "<>", "all"),
        Rewrite(". ", "; ", "all", literal=True),
        Rewrite(r"<>(\w)", "$1<>", "first_per_doc"),
    ]
    return _digest(rewrite_lines(docs, rewrites), "doc_id")


@query(
    r"""
    WITH edited AS (
        SELECT doc_id, text, array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, 't(h)e', '[\0|\1]')), chr(10)) AS new
        FROM documents
    )
    SELECT doc_id, md5(new) AS text_md5, new <> text AS changed FROM edited
    """
)
def rewrite_whole_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(rewrite_lines(docs, [Rewrite("t(h)e", "[$0|$1]")]), "doc_id")


@query(
    r"""
    WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
    placed AS (SELECT *, list_position(list_transform(lines, lambda l: regexp_matches(l, '\.\s+[A-Z]')), true) AS place FROM split),
    edited AS (
        SELECT doc_id, text, array_to_string(list_transform(lines, lambda l, i: CASE WHEN i = place THEN regexp_replace(l, '\.\s+([A-Z])', '; \1') ELSE l END), chr(10)) AS new
        FROM placed
    )
    SELECT doc_id, md5(new) AS text_md5, new <> text AS changed FROM edited
    """
)
def rewrite_first_regex_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(rewrite_lines(docs, [Rewrite(r"\.\s+([A-Z])", "; $1", "first_per_doc")]), "doc_id")


@query(
    r"""
    WITH first AS (
        SELECT doc_id, lang, text,
               CASE lang
               WHEN 'en' THEN array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '(\w+) (the) ', '\2 \1 ')), chr(10))
               WHEN 'de' THEN replace(text, 'der', 'DER') ELSE text END AS one
        FROM documents),
    second AS (
        SELECT *, CASE WHEN lang = 'en' AND NOT contains(one, 'License') THEN rtrim(one, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10) || 'License: none' || chr(10)
                       WHEN lang = 'de' AND contains(one, 'DER') THEN left(one, strpos(one, 'DER') - 1) || 'Der' || substr(one, strpos(one, 'DER') + 3)
                       WHEN lang = 'es' AND NOT list_contains(string_split(one, chr(10)), 'fin') THEN one || chr(10) || 'fin' ELSE one END AS two
        FROM first)
    SELECT doc_id, md5(two) AS digest, two <> text AS changed FROM second
    """
)
def rewrite_by_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every language with the steps of their own script."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("path"), "text")
    scripts = small_table(
        spark,
        [
            ("en", 1, "rewrite", r"(\w+) (the) ", "$2 $1 ", "first_per_line", False, None, None, None, None),
            ("en", 2, "append", None, None, None, None, "License", "fixed", "\nLicense: none\n", True),
            ("de", 1, "rewrite", "der", "DER", "all", True, None, None, None, None),
            ("de", 7, "rewrite", "DER", "Der", "first_per_doc", True, None, None, None, None),
            ("es", 1, "append", None, None, None, None, "fin", "fixed_line", "\nfin", False),
        ],
        "path string, step int, kind string, pattern string, replacement string, scope string, literal boolean, marker string, marker_mode string, block string, trim_end boolean",
    )
    return run_edit_scripts(docs, scripts).select("doc_id", F.md5("text").alias("digest"), "changed")


@query(
    f"""
    WITH edited AS (SELECT doc_id, text, replace(text, 'License', 'Licence') AS new FROM documents WHERE lang = 'en')
    SELECT doc_id, new <> text OR NOT contains(new, 'Licen') AS changed,
           md5(CASE WHEN contains(new, 'Licen') THEN new ELSE new || '{BLOCK}' END) AS text_md5
    FROM edited
    """
)
def rewrite_then_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", "text")
    rewritten = rewrite_lines(docs, [Rewrite("License", "Licence", "all", literal=True)])
    return _digest(append_if_absent(rewritten, "Licen", BLOCK), "doc_id")


# -- composed -----------------------------------------------------------------


@query(
    """
    WITH keys(section) AS (VALUES ('legal'), ('style'), ('review')),
    states AS (
        SELECT doc_id, section, CASE section WHEN 'legal' THEN true WHEN 'style' THEN lang <> 'fr' ELSE false END AS applies
        FROM documents CROSS JOIN keys
    ),
    said AS (
        SELECT doc_id, 1 AS pos, 'enable' AS flag, 'review' AS listed FROM labels WHERE quality = 1
        UNION ALL SELECT doc_id, 2, 'only', 'legal' FROM labels WHERE toxic = 1
        UNION ALL SELECT doc_id, 3, 'skip', 'style' FROM labels WHERE quality = 0
    ),
    touched AS (
        SELECT doc_id, section, pos, CASE flag WHEN 'skip' THEN false ELSE section = listed END AS value
        FROM said CROSS JOIN keys WHERE flag = 'only' OR section = listed
    ),
    last AS (SELECT doc_id, section, arg_max(value, pos) AS value FROM touched GROUP BY 1, 2),
    enabled AS (
        SELECT s.doc_id, s.section FROM states s LEFT JOIN last l ON s.doc_id = l.doc_id AND s.section = l.section
        WHERE coalesce(l.value, s.applies)
    ),
    results AS (
        SELECT doc_id, 'legal' AS section, contains(text, 'License') AS ok FROM documents
        UNION ALL SELECT doc_id, 'style', contains(text, ' the ') OR contains(text, ' der ') FROM documents
        UNION ALL SELECT doc_id, 'review', n_chars >= 1000 FROM documents
    )
    SELECT section, count(*) FILTER (WHERE ok) AS n_pass, count(*) FILTER (WHERE NOT ok) AS n_fail, CAST(0 AS BIGINT) AS n_skip, bool_or(NOT ok) AS failed
    FROM results SEMI JOIN enabled USING (doc_id, section) GROUP BY section
    """
)
def conformance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scopes = [
        ScopeRule("legal"),
        ScopeRule("style"),
        ScopeRule("style", "lang", "fr", "exclude"),
        ScopeRule("review", "lang", "none"),
    ]
    rules = [
        Rule("license", F.col("text").contains("License"), "legal"),
        Rule("article", F.col("text").contains(" the ") | F.col("text").contains(" der "), "style"),
        Rule("length", "n_chars >= 1000", "review"),
    ]

    def directive(pos: int, flag: str, section: str, condition: str) -> DataFrame:
        return labels.filter(condition).select(
            "doc_id", F.lit(pos).alias("pos"), F.lit(flag).alias("flag"), F.array(F.lit(section)).alias("sections")
        )

    directives = (
        directive(1, "enable", "review", "quality = 1")
        .unionByName(directive(2, "only", "legal", "toxic = 1"))
        .unionByName(directive(3, "skip", "style", "quality = 0"))
    )
    return report(docs, rules, scopes, directives, entity="doc_id")
