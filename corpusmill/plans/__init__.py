"""Registered queries over the provided tables and their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import operators as O
from .. import sources as S
from ..functions import chat as C
from ..functions import text as T
from ..functions import urls as U
from ..operators.providers import second_pass

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Text that makes every rule fire, chosen by doc_id; the same expression runs in both engines.
_NL = "chr(10)"
_INJECT = f"""concat(text, CASE doc_id % 12
 WHEN 0 THEN ' a , b ! c' WHEN 1 THEN ' Copyright © 2024 Foo. All rights reserved.' WHEN 2 THEN ' Terms of Service and Privacy Policy x'
 WHEN 3 THEN concat({_NL}, '  *[DE]: Deutsch', {_NL}, 'x')
 WHEN 4 THEN concat({_NL}, 'a', {_NL}, {_NL}, 'b', {_NL}, {_NL}, 'c', {_NL}, {_NL}, 'd', {_NL}, {_NL}, 'e')
 WHEN 5 THEN concat({_NL}, 'Back to top', {_NL}, 'x') WHEN 6 THEN ' [t](/u "x") ![alt](u) https://a.example/x www.b.example'
 WHEN 7 THEN ' skip to content; follow us on; subscribe to newsletter' WHEN 8 THEN concat({_NL}, '* item', {_NL}, {_NL}, {_NL}, {_NL}, 'y   z')
 WHEN 9 THEN ' 123-45-6789 at 10.0.0.1 mail x@y.example gonna go' WHEN 10 THEN ' how to make a bomb' ELSE ' DE44 5001 0517 5407 3249 31 L12345678 5 High Street' END)"""


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def _docs(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "lang", F.expr(_INJECT).alias("text"))


_D = f"(SELECT doc_id, lang, {_INJECT} AS text FROM documents)"


def _rule_query(name: str, rules) -> None:
    sql = f"SELECT doc_id, {T.rules_sql('text', rules)} AS out FROM {_D}"
    query(sql, name)(lambda s, d: _docs(s, d).select("doc_id", T.apply_rules(F.col("text"), rules).alias("out")))


for _n, _r in T.NORMALISE.items():
    _rule_query(_n, (_r,))
for _n, _r in T.MARKDOWN.items():
    _rule_query(_n, _r)
for _n, _r in T.PII.items():
    _rule_query(f"pii_{_n}", (_r,))
_rule_query("md_emails", (T.EMAILS,))
_rule_query("txt_boilerplate", T.all_rules(pii=())[: len(T.NORMALISE)])
_rule_query("clean_text", T.all_rules())
_rule_query("cpt_cleanup", [r for rs in T.MARKDOWN.values() for r in rs])

_ALT = lambda words: "|".join(words)
_CLEANED = f"(SELECT doc_id, lang, text, {T.rules_sql('text', T.all_rules())} AS c FROM {_D})"
_REASON = f"""CASE WHEN trim(c) = '' THEN 'empty' WHEN regexp_matches(c, '(?i)(?:{_ALT(O.HARMFUL)})') THEN 'harmful'
 WHEN regexp_matches(c, '(?i)\\b(?:{_ALT(w.replace("'", "''") for w in O.SLANG)})\\b') THEN 'slang'
 WHEN NOT length(c) BETWEEN 200 AND 100000 THEN 'length' END"""
_STATUS = f"(SELECT doc_id, lang, c AS cleaned, {_REASON} AS cleaning_reason FROM {_CLEANED})"


@query(f"SELECT doc_id, cleaned, cleaning_reason, CASE WHEN cleaning_reason IS NULL THEN 'kept' ELSE 'removed' END AS cleaning_status FROM {_STATUS}")
def clean_status(s, d):
    return O.clean(_docs(s, d)).select("doc_id", "cleaned", "cleaning_reason", "cleaning_status")


@query(f"""SELECT lang, count(*) AS docs, count(*) FILTER (cleaning_reason IS NULL) AS kept,
 round(avg(length(cleaned)), 6) AS avg_chars FROM {_STATUS} GROUP BY lang""")
def clean_summary(s, d):
    return O.clean(_docs(s, d)).groupBy("lang").agg(
        F.count("*").alias("docs"), F.count_if(F.col("cleaning_reason").isNull()).alias("kept"),
        F.round(F.avg(F.char_length("cleaned")), 6).alias("avg_chars"),
    )


def _filter_query(name: str, column, sql: str) -> None:
    query(f"SELECT doc_id FROM {_D} WHERE {sql}", name)(lambda s, d: _docs(s, d).where(column()).select("doc_id"))


_filter_query("flt_harmful", lambda: ~F.col("text").rlike(T.any_of(O.HARMFUL)), f"NOT regexp_matches(text, '(?i)(?:{_ALT(O.HARMFUL)})')")
_filter_query("flt_offensive", lambda: ~F.col("text").rlike(T.any_of(("scum", "moron"), True)), r"NOT regexp_matches(text, '(?i)\b(?:scum|moron)\b')")
_filter_query("flt_slang", lambda: ~F.col("text").rlike(T.any_of(O.SLANG, True)), "NOT regexp_matches(text, '(?i)\\b(?:finna|gonna|lemme|wanna|ain''t)\\b')")
query(f"SELECT doc_id FROM {_CLEANED} WHERE length(c) BETWEEN 200 AND 100000", "flt_length")(
    lambda s, d: _docs(s, d).select("doc_id", T.apply_rules(F.col("text"), T.all_rules()).alias("c")).where(F.char_length("c").between(*O.LENGTH)).select("doc_id")
)
_filter_query("flt_empty_md", lambda: F.trim("text") != "", "trim(text) <> ''")
query("SELECT doc_id, length(text) AS n FROM documents", "char_len")(lambda s, d: _t(s, d, "documents").select("doc_id", F.char_length("text").cast("long").alias("n")))

# --- dedup -----------------------------------------------------------------------------------------------------------
query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text", "dedup_exact")(lambda s, d: O.dedup_exact(_t(s, d, "documents")).select("doc_id"))
_SH = """(SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g
 FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\f\\r]+'), lambda x: x <> '') AS w FROM documents))"""


@query(f"""WITH s AS MATERIALIZED {_SH}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
 SELECT a, b, round(i / (x.n + y.n - i), 9) AS jaccard FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE i / (x.n + y.n - i) >= 0.85""")
def dedup_minhash(s, d):
    return O.minhash_pairs(_t(s, d, "documents")).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


query(f"""WITH s AS {_SH} SELECT doc_id, count(*) AS total, count(*) FILTER (f < doc_id) AS seen
 FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS f FROM s) GROUP BY doc_id""", "dedup_bloom")(lambda s, d: O.seen_shingles(_t(s, d, "documents")))  # fmt: skip

# --- pages and crawl -------------------------------------------------------------------------------------------------
_NORM = "regexp_replace(regexp_replace({0}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:www\\.)?([^/?#]*)([^?#;]*).*$', '\\1://\\2\\3'), '/$', '')"


def _page_query(name: str, oracle: str, *columns) -> None:
    query(f"SELECT page_id, {oracle} FROM pages", name)(lambda s, d: _t(s, d, "pages").select("page_id", *(c() for c in columns)))


_url = lambda: F.col("url")
_page_query("url_normalize", f"{_NORM.format('url')} AS out", lambda: U.url_normalize(_url()).alias("out"))
_page_query("url_domain", "regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS out", lambda: U.url_domain(_url()).alias("out"))
_page_query("url_valid", "regexp_matches(url, '^https?') AND NOT contains(lower(url), 'example.org') AS out", lambda: U.url_valid(_url(), ("example.ORG",)).alias("out"))
_page_query("url_is_pdf", "ends_with(lower(concat(url, CASE WHEN page_id % 5 = 0 THEN '.PDF' ELSE '' END)), '.pdf') AS out", lambda: U.url_is_pdf(F.expr("concat(url, CASE WHEN page_id % 5 = 0 THEN '.PDF' ELSE '' END)")).alias("out"))
_page_query("hash_url_sha256", "sha256(url) AS out", lambda: F.sha2("url", 256).alias("out"))
_page_query("hash_url_md5", "md5(url) AS out", lambda: F.md5("url").alias("out"))
_LANG = "lower(regexp_extract(html, '(?i)<html[^>]*\\slang=[\"'']?([a-zA-Z-]+)', 1))"
_page_query("html_lang", f"CASE WHEN {_LANG} <> '' THEN {_LANG} ELSE 'unknown-assumed-en' END AS out", lambda: U.html_lang(F.col("html")).alias("out"))
query(f"SELECT page_id FROM pages WHERE {_LANG} = '' OR {_LANG} LIKE 'en%'", "flt_language")(lambda s, d: _t(s, d, "pages").where(U.language_kept(U.html_lang(F.col("html")))).select("page_id"))
query("SELECT page_id FROM pages WHERE NOT regexp_matches(lower(url), 'feed|/de/')", "flt_url_blacklist")(lambda s, d: _t(s, d, "pages").where(~F.col("url").rlike(T.any_of(("feed", "/de/")))).select("page_id"))
# the pages' own anchors, cut out of the text without a pattern
_CUT = """list_transform(list_filter(string_split(html, '<a ')[2:], lambda x: contains(string_split(x, '>')[1], 'href="')),
 lambda x: string_split(string_split(string_split(x, '>')[1], 'href="')[2], '"')[1])"""
_HREFS = f"(SELECT page_id, url, unnest(h) AS href, unnest(range(len(h)))::INTEGER AS pos FROM (SELECT *, {_CUT} AS h FROM pages))"
_hrefs = lambda s, d: _t(s, d, "pages").select("page_id", "url", F.posexplode(U.html_links(F.col("html"))).alias("pos", "href"))
query(f"SELECT page_id, pos, href FROM {_HREFS}", "html_links")(lambda s, d: _hrefs(s, d).select("page_id", "pos", "href"))
_ABS = "CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || href ELSE href END"
query(f"SELECT page_id, pos, {_ABS} AS out FROM {_HREFS}", "url_absolute")(lambda s, d: _hrefs(s, d).select("page_id", "pos", U.url_absolute(_url(), F.col("href")).alias("out")))
query(f"SELECT doc_id, unnest(regexp_extract_all(text, '\\[.*?\\]\\((https?://[^\\s\\)\"]+)', 1)) AS link FROM (SELECT doc_id, text || ' [a](https://x.example/' || doc_id || ') [b](/r)' AS text FROM documents)", "md_links")(
    lambda s, d: _t(s, d, "documents").select("doc_id", F.explode(U.md_links(F.expr("concat(text, ' [a](https://x.example/', doc_id, ') [b](/r)')"))).alias("link"))
)
#: Seeds, index and updates are told apart by the pages' languages.
_PAGE_LANG = "substr(split_part(html, 'lang=\"', 2), 1, 2)"
_in_lang = lambda s, d, *langs: _t(s, d, "pages").where(F.expr(_PAGE_LANG).isin(*langs))
_SEEDS = f"(SELECT url FROM pages WHERE {_PAGE_LANG} = 'de')"
_seeds = lambda s, d: _in_lang(s, d, "de").select("url")
_CRAWL = f"""k AS (SELECT {_NORM.format('url')} AS u, any_value(url ORDER BY page_id) AS url, any_value(html ORDER BY page_id) AS html FROM pages GROUP BY 1),
 d0 AS (SELECT DISTINCT {_NORM.format('url')} AS url, 0 AS depth FROM {_SEEDS}),
 l AS (SELECT url, unnest({_CUT}) AS href, u FROM k),
 d1 AS (SELECT DISTINCT {_NORM.format(_ABS)} AS url, 1 AS depth FROM (SELECT l.url, href FROM l JOIN d0 ON l.u = d0.url)),
 c AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1 WHERE url NOT IN (SELECT url FROM d0))"""
query(f"WITH {_CRAWL} SELECT url, depth FROM c", "join_frontier_anti")(lambda s, d: O.crawl(_t(s, d, "pages"), _seeds(s, d), 1))
query(f"WITH {_CRAWL} SELECT depth, count(*) AS pages FROM c GROUP BY depth", "agg_pages_by_depth")(lambda s, d: O.crawl(_t(s, d, "pages"), _seeds(s, d), 1).groupBy("depth").agg(F.count("*").alias("pages")))
query(f"SELECT DISTINCT {_NORM.format('url')} AS url FROM (SELECT url FROM pages UNION ALL SELECT url || '/' FROM pages)", "set_url_dedup")(
    lambda s, d: _t(s, d, "pages").select("url").unionByName(_t(s, d, "pages").select(F.concat("url", F.lit("/")).alias("url"))).select(U.url_normalize(_url()).alias("url")).distinct()
)
_DEPTH = f"CASE {_PAGE_LANG} WHEN 'de' THEN 2 WHEN 'es' THEN 3 END"
_INDEX = f"(SELECT sha256(url) AS hash, url, page_id, {_DEPTH} AS max_depth FROM pages WHERE {_PAGE_LANG} IN ('en', 'de', 'es'))"


def _index(s, d):
    return _in_lang(s, d, "en", "de", "es").select(F.sha2("url", 256).alias("hash"), "url", "page_id", F.expr(_DEPTH).alias("max_depth"))


query(f"SELECT p.page_id, coalesce(i.max_depth, 0) AS depth FROM pages p LEFT JOIN {_INDEX} i ON i.url = p.url", "join_seed_lookup")(
    lambda s, d: _t(s, d, "pages").select("page_id", "url").join(_index(s, d).select("url", "max_depth"), "url", "left").select("page_id", F.coalesce("max_depth", F.lit(0)).cast("long").alias("depth"))
)
query(f"SELECT i.page_id, coalesce(u.new_depth, i.max_depth, 0) AS depth FROM {_INDEX} i LEFT JOIN (SELECT sha256(url) AS hash, 5 AS new_depth FROM pages WHERE {_PAGE_LANG} IN ('es', 'fr')) u ON u.hash = i.hash", "join_depth_update")(
    lambda s, d: _index(s, d).join(_in_lang(s, d, "es", "fr").select(F.sha2("url", 256).alias("hash"), F.lit(5).alias("new_depth")), "hash", "left").select("page_id", F.coalesce("new_depth", "max_depth", F.lit(0)).cast("long").alias("depth"))
)
query(f"SELECT hash FROM {_INDEX} UNION ALL SELECT sha256(url) FROM pages WHERE {_PAGE_LANG} = 'fr'", "set_union_index")(
    lambda s, d: _index(s, d).select("hash").unionByName(_in_lang(s, d, "fr").select(F.sha2("url", 256).alias("hash")))
)
query(f"SELECT page_id FROM pages WHERE sha256(url) NOT IN (SELECT hash FROM {_INDEX})", "flt_incremental")(
    lambda s, d: _t(s, d, "pages").withColumn("hash", F.sha2("url", 256)).join(_index(s, d).select("hash"), "hash", "left_anti").select("page_id")
)
query("SELECT page_id, coalesce(lag(h) OVER (ORDER BY page_id) = h, false) AS delayed FROM (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS h FROM pages)", "lag_domain")(
    lambda s, d: O.lag_equal(_t(s, d, "pages").select("page_id", U.url_domain(_url()).alias("h")), "page_id", "h").select("page_id", F.col("same").alias("delayed"))
)


@query()
def html_to_markdown(s, d):
    from ..functions.html import to_markdown

    return to_markdown(_t(s, d, "pages"), "page_id")


# --- questions and answers from conversations ------------------------------------------------------------------------
_QA = """(SELECT sha256(conv_id::VARCHAR) AS hash, conv_id, turn, text AS question, answer,
 CASE conv_id % 6 WHEN 0 THEN 'Studies' WHEN 1 THEN 'Germany' WHEN 2 THEN 'Other' WHEN 3 THEN NULL WHEN 4 THEN 'Trash' ELSE 'Housing' END AS category
 FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS r2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r2 = 'assistant')"""


def _qa(s, d) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(s, d, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("r2", F.lead("role").over(w))
    category = F.expr("CASE conv_id % 6 WHEN 0 THEN 'Studies' WHEN 1 THEN 'Germany' WHEN 2 THEN 'Other' WHEN 3 THEN NULL WHEN 4 THEN 'Trash' ELSE 'Housing' END")
    return rows.where("role = 'user' AND r2 = 'assistant'").select(
        F.sha2(F.col("conv_id").cast("string"), 256).alias("hash"), "conv_id", "turn", F.col("text").alias("question"), "answer", category.alias("category")
    )


def _qa_query(name: str, oracle: str, f) -> None:
    query(oracle.replace("QA", _QA), name)(lambda s, d: f(_qa(s, d)))


_KEY = ("conv_id", "turn")
_qa_query("flt_category_other", "SELECT conv_id, turn FROM QA WHERE category IS NULL OR category <> 'Other'", lambda q: q.where("category IS NULL OR category != 'Other'").select(*_KEY))
_qa_query("flt_skip_trash", "SELECT conv_id, turn FROM QA WHERE category IS DISTINCT FROM 'Trash'", lambda q: q.where("NOT category <=> 'Trash'").select(*_KEY))
_qa_query("flt_qa_blacklist", "SELECT conv_id, turn FROM QA WHERE NOT regexp_matches(question, '(?i)\\b(?:thent|of the)\\b') OR regexp_matches(question, '(?i)\\b(?:and)\\b')",
          lambda q: q.where(~F.col("question").rlike(T.any_of(("thent", "of the"), True)) | F.col("question").rlike(T.any_of(("and",), True))).select(*_KEY))
_SECOND = "SELECT conv_id, turn FROM (SELECT *, length('Is this relevant? ' || question || ' ' || answer) AS n FROM QA) WHERE "
_by_length = lambda prompts: ["irrelevant" if len(p) % 3 == 0 else "relevant: yes" for p in prompts]  # noqa: E731  an offline provider


def _second(q) -> tuple[DataFrame, DataFrame]:
    rows = q.select(*_KEY, F.concat_ws("-", *_KEY).alias("k"), F.concat(F.lit("Is this relevant? "), "question", F.lit(" "), "answer").alias("prompt"))
    return second_pass(rows, "prompt", "k", _by_length)


_qa_query("flt_second_pass", _SECOND + "n % 3 > 0", lambda q: _second(q)[0].select(*_KEY))
_qa_query("flt_second_pass_removed", _SECOND + "n % 3 = 0", lambda q: _second(q)[1].select(*_KEY))
_qa_query("agg_category_counts", "SELECT category, count(*) AS n FROM QA WHERE category IS NOT NULL GROUP BY 1", lambda q: q.where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n")))
_PER = "(SELECT hash, count(*) AS n FROM QA WHERE category IS DISTINCT FROM 'Other' GROUP BY hash)"
_per = lambda q: q.where("NOT category <=> 'Other'").groupBy("hash").agg(F.count("*").alias("n"))
_qa_query("agg_q_per_doc", f"SELECT coalesce(avg(n), 0) AS mean_q, coalesce(min(n), 0) AS min_q, coalesce(max(n), 0) AS max_q FROM {_PER}",
          lambda q: _per(q).agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_q"), F.coalesce(F.min("n"), F.lit(0)).alias("min_q"), F.coalesce(F.max("n"), F.lit(0)).alias("max_q")))
_qa_query("agg_q_histogram", f"WITH p AS {_PER} SELECT b.n, count(p.hash) AS docs FROM (SELECT unnest(range(0, (SELECT max(n) FROM p) + 1)) AS n) b LEFT JOIN p ON p.n = b.n GROUP BY b.n",
          lambda q: _per(q).agg(F.max("n").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("n")).join(_per(q), "n", "left").groupBy("n").agg(F.count("hash").alias("docs")))
_qa_query("agg_total_questions", "SELECT count(*) AS n FROM QA", lambda q: q.agg(F.count("*").alias("n")))
_qa_query("agg_group_rows", "SELECT coalesce(CASE WHEN conv_id % 7 > 0 THEN hash END, 'row-' || conv_id || '-' || turn) AS k, count(*) AS n FROM QA GROUP BY 1",
          lambda q: q.groupBy(F.coalesce(F.when(F.col("conv_id") % 7 > 0, F.col("hash")), F.concat_ws("-", F.lit("row"), "conv_id", "turn")).alias("k")).agg(F.count("*").alias("n")))
_SPLIT = """(SELECT hash, CASE WHEN r < floor(n * 0.8) THEN 'train' WHEN r < floor(n * 0.9) THEN 'valid' ELSE 'test' END AS split
 FROM (SELECT hash, row_number() OVER (ORDER BY sha256('42' || hash)) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT hash FROM QA)))"""
_qa_query("split_80_10_10", f"SELECT hash, split FROM {_SPLIT}", lambda q: O.hash_split(q.select("hash").distinct(), "hash").select("hash", "split"))
_qa_query("join_split_keys", f"SELECT conv_id, turn, split FROM QA JOIN {_SPLIT} USING (hash)", lambda q: O.hash_split(q, "hash").select(*_KEY, "split"))
_qa_query("agg_split_shares", f"SELECT split, count(*) AS n, count(*) / (SELECT count(*) FROM QA) AS share FROM QA JOIN {_SPLIT} USING (hash) GROUP BY split",
          lambda q: O.hash_split(q, "hash").groupBy("split").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())))
_qa_query("set_disjoint_check", f"SELECT count(*) AS shared FROM (SELECT hash FROM {_SPLIT} GROUP BY hash HAVING count(DISTINCT split) > 1)",
          lambda q: O.hash_split(q, "hash").groupBy("hash").agg(F.countDistinct("split").alias("k")).where("k > 1").agg(F.count("*").alias("shared")))
query("SELECT doc_id, CASE WHEN r < floor(n * 0.8) THEN 'train' WHEN r < floor(n * 0.9) THEN 'valid' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('42' || doc_id)) - 1 AS r, count(*) OVER () AS n FROM documents)", "file_split")(
    lambda s, d: O.hash_split(_t(s, d, "documents").select("doc_id"), "doc_id").select("doc_id", "split")
)
_qa_query("sample_per_category", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('42' || k)) AS r FROM (SELECT *, conv_id || '-' || turn AS k FROM QA)) WHERE r <= 50",
          lambda q: O.sample_per_group(q.withColumn("k", F.concat_ws("-", "conv_id", "turn")), "category", "k").select(*_KEY))
_qa_query("chat_format", "SELECT conv_id, turn, 'system' || chr(10) || 'Be helpful.' || chr(10) || 'user' || chr(10) || question || ' /no_think' || chr(10) || 'assistant' || chr(10) || answer AS out FROM QA",
          lambda q: q.select(*_KEY, F.array_join(F.transform(C.messages("Be helpful.", F.col("question"), F.col("answer")), lambda m: F.concat_ws("\n", m["role"], m["content"])), "\n").alias("out")))
_qa_query("strip_no_think", "SELECT conv_id, turn, question AS out FROM QA", lambda q: q.select(*_KEY, C.strip_no_think(F.concat("question", F.lit(" /no_think"))).alias("out")))
_qa_query("prompt_render", "SELECT conv_id, turn, 'Q: ' || question || ' {x} A: ' || answer AS out FROM QA", lambda q: q.select(*_KEY, C.prompt_render("Q: {question} {{x}} A: {answer}", question=F.col("question"), answer=F.col("answer")).alias("out")))
query("SELECT doc_id, greatest(1, least(20, n - 3))::BIGINT AS lo, greatest(1, least(20, n + 3))::BIGINT AS hi FROM (SELECT doc_id, floor(length(text) / 1000) AS n FROM documents)", "qa_count_range")(
    lambda s, d: _t(s, d, "documents").select("doc_id", *(c.alias(a) for c, a in zip(C.qa_count_range(F.char_length("text")), ("lo", "hi"))))
)
_REPLY = "CASE conv_id % 4 WHEN 0 THEN 'irrelevant' WHEN 1 THEN '{\"category\": \"Studies\", \"qa_pairs\": [{\"question\": \"q1\", \"answer\": \"a1\"}, {\"question\": \"q2\", \"answer\": \"a2\"}]}' WHEN 2 THEN '{\"category\": \"Stu' ELSE '{\"category\": \"Germany\", \"qa_pairs\": []}' END"
query("SELECT c AS conv_id, 'Studies' AS category, unnest(['q1', 'q2']) AS question, unnest(['a1', 'a2']) AS answer FROM (SELECT DISTINCT conv_id AS c FROM conversations) WHERE c % 4 = 1", "llm_reply_parse")(
    lambda s, d: _t(s, d, "conversations").select("conv_id").distinct().withColumn("reply", F.expr(_REPLY)).where("reply != 'irrelevant'")
    .withColumn("r", F.from_json("reply", "category string, qa_pairs array<struct<question:string,answer:string>>"))
    .select("conv_id", "r.category", F.explode("r.qa_pairs").alias("p")).select("conv_id", "category", "p.question", "p.answer")
)
query("SELECT doc_id, (CASE WHEN toxic = 1 THEN 0.0 WHEN quality = 1 THEN 1.0 ELSE 0.5 END)::DOUBLE AS score FROM labels", "judge_parse")(
    lambda s, d: _t(s, d, "labels").select("doc_id", F.from_json(F.expr("concat('{\"reasoning\": \"r\", \"score\": ', CASE WHEN toxic = 1 THEN '0' WHEN quality = 1 THEN '1' ELSE '0.5' END, ', \"reason\": \"x\"}')"), "reasoning string, score double, reason string")["score"].alias("score"))
)
query("""SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' AND turn > q AND turn = m THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || text || '<|im_end|>' || chr(10), '' ORDER BY turn)
 || '<|im_start|>assistant' || chr(10) AS out FROM (SELECT *, coalesce(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id), max(turn) OVER (PARTITION BY conv_id)) AS q, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY conv_id""", "chat_template_render")(
    lambda s, d: _t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("ms")).select("conv_id", C.template_render(F.col("ms"), generation_prompt=True).alias("out"))
)

# --- tokens: code points of whole texts stand in for a tokeniser, so that SQL can follow; tokenize_bpe has a real one ------
_LIMIT = 512  # fixed value: the training's longest example, in tokens
_IDS = "list_transform(string_split(text, ''), lambda c: unicode(c))"
_CUT_IDS = f"list_transform(string_split(substr(text, 1, {_LIMIT}), ''), lambda c: unicode(c))"
_codes = lambda text: F.transform(F.split(text, ""), lambda c: F.ascii(c))
_toks = lambda s, d: _t(s, d, "documents").select("doc_id", _codes(F.col("text")).alias("ids"))
_cut_toks = lambda s, d: _t(s, d, "documents").select("doc_id", _codes(F.substring("text", 1, _LIMIT)).alias("ids"))
query(f"SELECT doc_id, {_CUT_IDS} AS ids FROM documents", "tokenize_truncate")(lambda s, d: _toks(s, d).select("doc_id", F.slice("ids", 1, _LIMIT).alias("ids")))
_MASKED = "list_transform({0}, lambda x, i: CASE WHEN i <= 10 THEN -100 ELSE x END)"
query(f"SELECT doc_id, {_MASKED.format('ids')} AS labels FROM (SELECT doc_id, {_IDS} AS ids FROM documents)", "label_mask")(lambda s, d: _toks(s, d).select("doc_id", C.label_mask(F.col("ids"), F.lit(10)).alias("labels")))
_BATCH = f"(SELECT doc_id, ids, doc_id // 4 AS batch, (ceil(max(len(ids)) OVER (PARTITION BY doc_id // 4) / 8) * 8)::INTEGER AS width FROM (SELECT doc_id, {_CUT_IDS} AS ids FROM documents))"


def _batches(s, d):
    rows = _cut_toks(s, d)
    rows = rows.withColumn("batch", F.floor(F.col("doc_id") / 4))
    return rows.withColumn("width", C.padded_length(F.max(F.size("ids")).over(Window.partitionBy("batch"))))


query(f"""SELECT doc_id, list_resize(ids, width, 0) AS ids, list_resize(list_transform(ids, lambda x: 1), width, 0) AS attention_mask,
 list_resize({_MASKED.format('ids')}, width, -100) AS labels FROM {_BATCH}""", "pad_batch")(
    lambda s, d: _batches(s, d).select("doc_id", C.pad(F.col("ids"), F.col("width"), 0).alias("ids"),
        C.pad(F.transform("ids", lambda x: F.lit(1)), F.col("width"), 0).alias("attention_mask"),
        C.pad(C.label_mask(F.col("ids"), F.lit(10)), F.col("width"), C.IGNORED).alias("labels"))
)
query(f"SELECT batch, max(width) AS width FROM {_BATCH} GROUP BY batch", "agg_max_len_batch")(lambda s, d: _batches(s, d).groupBy("batch").agg(F.max("width").alias("width")))
query("SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY length(text), doc_id) AS r FROM documents", "sort_seq_len")(
    lambda s, d: O.global_rank(_t(s, d, "documents").select("doc_id", F.char_length("text").cast("long").alias("n")), "n", "doc_id").withColumnRenamed("rank", "r")
)
_FLAT = f"(SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS p, id FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM (SELECT doc_id, list_append({_IDS}, 0) AS ids FROM documents)))"
query(f"SELECT p // 2048 AS block, list(id ORDER BY p) AS ids FROM {_FLAT} GROUP BY 1", "pack_blocks")(lambda s, d: O.pack_blocks(_toks(s, d)))
query(f"SELECT count(DISTINCT p // 2048) AS blocks, count(*) AS tokens FROM {_FLAT}", "agg_run_summary")(lambda s, d: O.pack_blocks(_toks(s, d)).agg(F.count("*").alias("blocks"), F.sum(F.size("ids")).alias("tokens")))


@query()
def tokenize_bpe(s, d):
    from ..functions.tokens import tokenize

    return tokenize(_t(s, d, "documents"), "doc_id", "text")


query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100", "limit_n")(lambda s, d: _t(s, d, "documents").select("doc_id").orderBy("doc_id").limit(100))

# --- corpus statistics -----------------------------------------------------------------------------------------------
_REL = "(SELECT doc_id FROM labels WHERE quality = 1)"
_rel = lambda s, d: _t(s, d, "labels").where("quality = 1").select("doc_id")
query(f"SELECT doc_id FROM documents WHERE doc_id IN {_REL}", "join_relevant_docs")(lambda s, d: _t(s, d, "documents").join(_rel(s, d), "doc_id", "left_semi").select("doc_id"))
query(f"SELECT (SELECT count(DISTINCT doc_id) FROM {_REL}) AS relevant, (SELECT count(*) FROM documents) - (SELECT count(DISTINCT doc_id) FROM {_REL}) AS irrelevant", "agg_relevancy")(
    lambda s, d: _t(s, d, "documents").agg(F.count("*").alias("n")).crossJoin(_rel(s, d).agg(F.countDistinct("doc_id").alias("relevant"))).select("relevant", (F.col("n") - F.col("relevant")).alias("irrelevant"))
)
query(f"SELECT round(sum(strlen(text)) / 1048576, 6) AS raw_mb, round(sum(strlen(c)) / 1048576, 6) AS cleaned_mb, round((1 - sum(strlen(c)) / sum(strlen(text))) * 100, 6) AS reduction FROM {_CLEANED}", "agg_sizes")(
    lambda s, d: O.clean(_docs(s, d)).agg(F.sum(F.octet_length("text")).alias("a"), F.sum(F.octet_length("cleaned")).alias("b")).select(F.round(F.col("a") / 1048576, 6).alias("raw_mb"), F.round(F.col("b") / 1048576, 6).alias("cleaned_mb"), F.round((1 - F.col("b") / F.col("a")) * 100, 6).alias("reduction"))
)

# --- benchmark runs, from labels -------------------------------------------------------------------------------------
_SCORES = "(SELECT doc_id, doc_id % 24 AS run, 'c' || doc_id % 5 AS category, CASE WHEN toxic = 1 THEN 0.0 WHEN quality = 1 THEN 1.0 ELSE 0.5 END AS score FROM labels)"
_scores = lambda s, d: _t(s, d, "labels").select("doc_id", (F.col("doc_id") % 24).alias("run"), F.concat(F.lit("c"), F.col("doc_id") % 5).alias("category"), F.expr("CASE WHEN toxic = 1 THEN 0D WHEN quality = 1 THEN 1D ELSE 0.5D END").alias("score"))
_STATS = f"""(SELECT category, count(*) AS total, avg(score)::DOUBLE AS average, count(*) FILTER (score = 1) AS a, count(*) FILTER (score = 0.5) AS b,
 count(*) FILTER (score = 0) AS c FROM {_SCORES} GROUP BY ROLLUP (category))"""
query(f"SELECT category, total, average, a AS full, b AS partial, c AS wrong FROM {_STATS}", "agg_bench_stats")(
    lambda s, d: O.bench_stats(_scores(s, d)).select("category", "total", "average", "full", "partial", "wrong")
)
query(f"SELECT category, kind, n / total * 100 AS pct FROM (SELECT category, total, unnest(['full', 'partial', 'wrong']) AS kind, unnest([a, b, c]) AS n FROM {_STATS})", "agg_answer_dist")(
    lambda s, d: O.bench_stats(_scores(s, d)).select("category", F.expr("stack(3, 'full', full_pct, 'partial', partial_pct, 'wrong', wrong_pct) AS (kind, pct)"))
)
query(f"SELECT DISTINCT category FROM {_SCORES}", "agg_categories_union")(lambda s, d: _scores(s, d).groupBy("run").agg(F.map_from_entries(F.collect_set(F.struct("category", F.lit(1)))).alias("m")).select(F.explode(F.map_keys("m")).alias("category")).distinct().orderBy("category"))
query(f"SELECT r.run, c.category, coalesce(avg(s.score), 0)::DOUBLE AS average FROM (SELECT DISTINCT run FROM {_SCORES}) r CROSS JOIN (SELECT DISTINCT category FROM {_SCORES}) c LEFT JOIN {_SCORES} s ON s.run = r.run AND s.category = c.category GROUP BY ALL", "join_category_matrix")(
    lambda s, d: _scores(s, d).select("run").distinct().crossJoin(_scores(s, d).select("category").distinct()).join(_scores(s, d).groupBy("run", "category").agg(F.avg("score").alias("a")), ["run", "category"], "left").select("run", "category", F.coalesce("a", F.lit(0.0)).alias("average"))
)
_RUNS = f"(SELECT 'run' || run AS run_dir, CASE WHEN run % 7 > 0 THEN '2024-01-' || (10 + run % 9) END AS ts, CASE WHEN run % 2 = 0 THEN 'm-SFT' ELSE 'm' END AS model, round(avg(score), 1)::DOUBLE AS score FROM {_SCORES} GROUP BY run)"


def _runs(s, d):
    return _scores(s, d).groupBy("run").agg(F.round(F.avg("score"), 1).alias("score")).select(
        F.concat(F.lit("run"), "run").alias("run_dir"), F.expr("CASE WHEN run % 7 > 0 THEN concat('2024-01-', 10 + run % 9) END").alias("ts"),
        F.expr("CASE WHEN run % 2 = 0 THEN 'm-SFT' ELSE 'm' END").alias("model"), "score",
    )


_IDX = f"(SELECT *, row_number() OVER (ORDER BY coalesce(ts, ''), run_dir) - 1 AS idx, count(*) OVER () AS n, contains(model, '-SFT') AS is_sft FROM {_RUNS})"
_PICK = f"(SELECT *, row_number() OVER (PARTITION BY is_sft ORDER BY score DESC, idx) AS best FROM {_IDX} QUALIFY idx = 0 OR idx >= n - 2 OR best <= 5)"
_picked = lambda s, d: O.topk_runs(_runs(s, d), 5)
_X = "CASE WHEN is_sft THEN count(*) FILTER (NOT is_sft) OVER () + 1.2 + row_number() OVER w - 1 ELSE row_number() OVER w - 1 END::DOUBLE"
query(f"SELECT run_dir, model, score FROM {_PICK}", "topk_selection")(lambda s, d: _picked(s, d).select("run_dir", "model", "score"))
query(f"SELECT run_dir, row_number() OVER (ORDER BY is_sft, idx) AS place FROM {_PICK}", "group_reorder")(
    lambda s, d: _picked(s, d).select("run_dir", F.row_number().over(Window.orderBy("is_sft", "idx")).alias("place"))
)
query(f"SELECT run_dir, {_X} AS x FROM {_PICK} WINDOW w AS (PARTITION BY is_sft ORDER BY idx)", "x_position")(lambda s, d: _picked(s, d).select("run_dir", "x"))
query(f"SELECT run_dir, contains(model, '-SFT') AS is_sft FROM {_RUNS}", "is_sft")(lambda s, d: _runs(s, d).select("run_dir", F.contains("model", F.lit("-SFT")).alias("is_sft")))
query(f"SELECT run_dir, idx FROM {_IDX}", "sort_chrono")(lambda s, d: _runs(s, d).select("run_dir", (F.row_number().over(Window.orderBy(F.coalesce("ts", F.lit("")), "run_dir")) - 1).alias("idx")))


def display_name(name, prefix: str):
    """Without the prefix, unless a space follows it, and without leading separators."""
    rest = F.substring(name, F.lit(len(prefix) + 1), F.char_length(name))
    return F.when(name.startswith(prefix) & ~rest.startswith(" "), F.regexp_replace(rest, "^[ _/-]+", "")).otherwise(name)


_NAMES = "(SELECT doc_id, 'base' || CASE doc_id % 3 WHEN 0 THEN '-x' WHEN 1 THEN ' (b)' ELSE '_/y' END AS name FROM labels)"
_names = lambda s, d: _t(s, d, "labels").select("doc_id", F.expr("concat('base', CASE doc_id % 3 WHEN 0 THEN '-x' WHEN 1 THEN ' (b)' ELSE '_/y' END)").alias("name"))
query(f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN name ELSE 'y' END AS out FROM {_NAMES}", "display_name")(lambda s, d: _names(s, d).select("doc_id", display_name(F.col("name"), "base").alias("out")))
query(f"SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN name END, 'run') || chr(10) || '(' || name || ')' AS out FROM {_NAMES}", "model_label")(lambda s, d: _names(s, d).select("doc_id", F.concat(F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("name")), F.lit("run")), F.lit("\n("), "name", F.lit(")")).alias("out")))

# Fixed values below: the parts of names, and the iterations of an epoch, that runs are known by.
# --- sweeps, packaging -----------------------------------------------------------------------------------------------
_GRID = "(SELECT * FROM (VALUES ('m1'), ('m2')) b(tag) CROSS JOIN (VALUES ('1e-5'), ('5e-5'), ('1e-4')) l(lr) CROSS JOIN (VALUES (1), (2)) e(ep))"


def grid(spark: SparkSession, tags, rates, epochs) -> DataFrame:
    one = lambda name, values, kind: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    return one("tag", tags, "string").crossJoin(one("lr", rates, "string")).crossJoin(one("ep", epochs, "int"))


_grid = lambda s, d: grid(s, ("m1", "m2"), ("1e-5", "5e-5", "1e-4"), (1, 2))
_name = lambda: F.concat("tag", F.lit("-tuplecpt_"), "lr", F.lit("_"), "ep", F.lit("-epoch"))
query(f"SELECT tag, lr, ep FROM {_GRID}", "join_grid")(_grid)
query(f"SELECT tag || '-tuplecpt_' || lr || '_' || ep || '-epoch-lr_5e-5-ep_2-SFT' AS name, ep * 2115 AS iters FROM {_GRID}", "sweep_name")(lambda s, d: _grid(s, d).select(F.concat(_name(), F.lit("-lr_5e-5-ep_2-SFT")).alias("name"), (F.col("ep") * 2115).alias("iters")))
query(f"SELECT ep, ep * 2115 AS iters FROM {_GRID}", "sft_iters")(lambda s, d: _grid(s, d).select("ep", (F.col("ep") * 2115).alias("iters")))
query(f"SELECT tag || '-tuplecpt_' || lr || '_' || ep || '-epoch' AS name FROM {_GRID} WHERE ep = 2 AND lr <> '1e-4' ORDER BY 1", "flt_model_dirs")(
    lambda s, d: _grid(s, d).select(_name().alias("name"), (F.col("lr") != "1e-4").alias("weights")).where(F.contains("name", F.lit("-tuplecpt_")) & F.col("weights") & F.col("name").endswith("_2-epoch")).orderBy("name").select("name")
)


def missing_files(present: DataFrame, required, column: str = "names") -> DataFrame:
    lost = F.array_except(F.lit(list(required)), column)
    return present.select("*", lost.alias("missing"), (F.size(lost) == 0).alias("ready"))


query("SELECT doc_id, list_filter(['a', 'b'], lambda x: NOT list_contains(n, x)) AS missing, len(list_filter(['a', 'b'], lambda x: NOT list_contains(n, x))) = 0 AS ready FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['a', 'b', 'c'] WHEN 1 THEN ['b'] ELSE []::VARCHAR[] END AS n FROM labels)", "join_missing_files")(
    lambda s, d: missing_files(_t(s, d, "labels").select("doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN array('a', 'b', 'c') WHEN 1 THEN array('b') ELSE array() END").alias("names")), ("a", "b")).drop("names")
)

# --- triples ---------------------------------------------------------------------------------------------------------
_TRI = "(SELECT 's' || conv_id % 20 AS s, CASE role WHEN 'user' THEN 'Asks' ELSE role END AS r, 'o' || turn AS o, conv_id FROM conversations)"
_tri = lambda s, d: _t(s, d, "conversations").select(F.concat(F.lit("s"), F.col("conv_id") % 20).alias("s"), F.expr("CASE role WHEN 'user' THEN 'Asks' ELSE role END").alias("r"), F.concat(F.lit("o"), "turn").alias("o"), "conv_id")
query(f"SELECT s, r, o, count(*) AS support FROM {_TRI} GROUP BY ALL", "agg_triple_support")(lambda s, d: _tri(s, d).groupBy("s", "r", "o").agg(F.count("*").alias("support")))
query(f"SELECT s, r, list_sort(list(DISTINCT o)) AS objects FROM {_TRI} GROUP BY ALL", "agg_relation_objects")(lambda s, d: _tri(s, d).groupBy("s", "r").agg(F.array_sort(F.collect_set("o")).alias("objects")))
query(f"SELECT r, count(*) AS n FROM {_TRI} GROUP BY r", "agg_relation_stats")(lambda s, d: _tri(s, d).groupBy("r").agg(F.count("*").alias("n")))
query(f"SELECT DISTINCT s || ' | ' || r || ' | ' || o AS line FROM {_TRI}", "triple_render_pipe")(lambda s, d: _tri(s, d).select(F.concat_ws(" | ", "s", "r", "o").alias("line")).distinct())
query(f"SELECT DISTINCT s || ' ' || replace(lower(r), '_', ' ') || ' ' || o || '.' AS line FROM {_TRI}", "triple_render_sentence")(lambda s, d: _tri(s, d).select(F.concat(F.concat_ws(" ", "s", F.replace(F.lower("r"), F.lit("_"), F.lit(" ")), "o"), F.lit(".")).alias("line")).distinct())
query(f"SELECT s, coalesce(a.name, r) AS r, o FROM {_TRI} t LEFT JOIN (VALUES ('Asks', 'asks'), ('system', 'instructs')) a(alias, name) ON a.alias = t.r", "relation_alias")(
    lambda s, d: _tri(s, d).join(s.createDataFrame([("Asks", "asks"), ("system", "instructs")], "r string, name string"), "r", "left").select("s", F.coalesce("name", "r").alias("r"), "o")
)


def extract_triples(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples, errors) of (key, reply) with a JSON array of {subject, relation, object}."""
    rows = replies.withColumn("t", F.from_json("reply", "array<struct<subject:string,relation:string,object:string>>"))
    bad = F.col("t").isNull() | F.exists("t", lambda t: t["subject"].isNull())
    return rows.where(~F.coalesce(bad, F.lit(True))).select("key", F.inline("t")), rows.where(F.coalesce(bad, F.lit(True))).select("key", "reply")


query("SELECT doc_id AS key, 'd' || doc_id AS subject, 'is' AS relation, 'x' AS object FROM labels WHERE doc_id % 3 > 0", "triple_extract")(
    lambda s, d: extract_triples(_t(s, d, "labels").select(F.col("doc_id").alias("key"), F.expr("CASE WHEN doc_id % 3 > 0 THEN concat('[{\"subject\": \"d', doc_id, '\", \"relation\": \"is\", \"object\": \"x\"}]') ELSE 'oops' END").alias("reply")))[0]
)

# --- sources and sinks, written and read again -----------------------------------------------------------------------
def _place(spark: SparkSession, name: str) -> str:
    """A folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _again(name: str, oracle: str, write, read) -> None:
    def run(s, d):
        path = _place(s, name)
        write(s, d, path)
        return read(s, path)

    query(oracle, name)(run)


_QNA = "(SELECT hash, question, answer, 'm' AS model, category FROM QA)".replace("QA", _QA)
_qna = lambda s, d: _qa(s, d).select("hash", "question", "answer", F.lit("m").alias("model"), "category")
_again("sink_jsonl", f"SELECT * FROM {_QNA}", lambda s, d, p: S.write_jsonl(_qna(s, d), p), lambda s, p: S.jsonl(s, p, strict=True).drop("user", "assistant"))
_again("sink_jsonl_append", f"SELECT * FROM {_QNA} UNION ALL SELECT * FROM {_QNA}",
       lambda s, d, p: [S.write_jsonl(_qna(s, d), p, True) for _ in range(2)], lambda s, p: S.jsonl(s, p).drop("user", "assistant"))
_again("sink_md_file", "SELECT doc_id, text FROM documents", lambda s, d, p: S.write_keyed(_t(s, d, "documents").select("doc_id", "text"), p, "doc_id"), lambda s, p: s.read.parquet(p))
_again("sink_html_cache", "SELECT md5(url) AS cache_key, CASE WHEN ends_with(url, '.pdf') THEN 'pdf' ELSE 'html' END AS kind, html AS body FROM pages",
       lambda s, d, p: S.write_page_cache(_t(s, d, "pages").select("url", U.url_is_pdf(_url()).alias("is_pdf"), F.col("html").alias("body")), p), lambda s, p: s.read.parquet(p))
_again("src_url_list", "SELECT url FROM pages WHERE url NOT LIKE '#%'", lambda s, d, p: _t(s, d, "pages").select(F.explode(F.array(F.concat(F.lit("  "), "url", F.lit(" ")), F.concat(F.lit("# "), "url"), F.lit("")))).write.text(p),
       lambda s, p: S.url_list(s, p))
_ENTRY = f"""(SELECT sha256(url) AS hash, sha256(url) || '.md' AS filename, url AS source_url, 0 AS depth, '2024-01-01' AS scraped_at, length(html)::BIGINT AS content_length,
 {_PAGE_LANG} AS language_detected, CASE {_PAGE_LANG} WHEN 'de' THEN 2 END AS max_depth, false AS questions_generated FROM pages WHERE {_PAGE_LANG} IN LANGS)"""


def _entries(s, d) -> DataFrame:
    """An entry for each URL, of the first of its pages by page_id."""
    rows = _in_lang(s, d, "de", "es", "fr").select(
        F.sha2("url", 256).alias("hash"), F.concat(F.sha2("url", 256), F.lit(".md")).alias("filename"), F.col("url").alias("source_url"), F.lit(0).alias("depth"),
        F.lit("2024-01-01").alias("scraped_at"), F.char_length("html").cast("long").alias("content_length"), F.expr(_PAGE_LANG).alias("language_detected"),
        F.expr(f"CASE {_PAGE_LANG} WHEN 'de' THEN 2 END").alias("max_depth"), F.lit(False).alias("questions_generated"), "page_id",
    )
    columns = [c for c in rows.columns if c != "page_id"]
    return rows.groupBy("hash").agg(F.min_by(F.struct(*columns), "page_id").alias("e")).select("e.*")


def _write_index(s, d, path) -> None:
    entries = _entries(s, d)
    index, new = (entries.where(F.col("language_detected").isin(*langs)) for langs in (("de", "es"), ("es", "fr")))
    S.write_index(S.merged_index(index, new, new.select(F.concat("source_url", F.lit("?q=1")).alias("url"), F.lit(5).alias("max_depth"))), path)


_again("sink_index", f"""SELECT * REPLACE (CASE WHEN language_detected IN ('es', 'fr') THEN 5 ELSE max_depth END AS max_depth)
 FROM (SELECT DISTINCT ON (hash) * FROM {_ENTRY.replace('LANGS', "('de', 'es', 'fr')")})""",
       _write_index, lambda s, p: S.index_lines(s, p).drop("cleaning_status", "cleaning_reason"))
_again("sink_metadata_json", "SELECT count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents",
       lambda s, d, p: S.write_metadata(s, _t(s, d, "documents").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars")).first().asDict(), p),
       lambda s, p: s.createDataFrame([S.read_metadata(s, p)], "documents long, chars long"))
