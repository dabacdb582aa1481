"""The registered query of each operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import mixing, packing, pii, puquality, rules, toolchat, topk, urlrules
from paperloom.llm.linededup import MIN_CHARS, LineIndex, shards_for
from paperloom.llm.simhash import near_duplicate_groups
from paperloom.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the learnt decision list keeps."""
    judged = rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.where("rule = 0").select("doc_id")


#: JSON schemas of the tools that conversations may call.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"url": {"type": "string", "pattern": "^https?://"}}, "required": ["url"]},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}, "precision": {"type": "integer", "minimum": 0}}, "required": ["expression"]},
}


def tool_turns(conversations: DataFrame) -> DataFrame:
    """The conversations with tool calls and results made from their messages.

    After each user's message at turn t the assistant makes two calls, the second of which must come first:
    ``b<t>`` searches, within a limit that depends on the message, for the result of ``a<t>``, which
    fetches an address, or, at every third turn, calculates, with its arguments as JSON text. Each of the
    assistant's messages is also given as the results of the calls of the turn before: two tool
    messages, of which one has an object as content. So some arguments break their schema, calls that
    no message follows have no result, and results after a turn without calls are unmatched.
    """
    turn, size = F.col("turn").cast("string"), F.length("text")
    name = lambda letter, at: F.concat(F.lit(letter), at)
    user = conversations.where("role = 'user' and text is not null and turn is not null")
    address = F.concat(F.when(size % 5 > 0, F.lit("https://site.example/")).otherwise(F.lit("ftp://site.example/")), F.col("conv_id").cast("string"), F.lit("/"), turn)
    sums = F.col("turn") % 3 == 2
    arguments_b = F.to_json(F.struct((size % 120).alias("limit"), F.concat(F.lit("$"), name("a", turn)).alias("query")))
    arguments_a = F.when(sums, F.to_json(F.struct(F.to_json(F.struct(F.col("turn").alias("precision"), F.concat(size.cast("string"), F.lit(" * 2")).alias("expression"))).alias("x")))).otherwise(F.to_json(F.struct(address.alias("x"))))
    inner = F.when(sums, F.regexp_extract(arguments_a, r'^\{"x":(.*)\}$', 1)).otherwise(F.concat(F.lit('{"url":'), F.regexp_extract(arguments_a, r'^\{"x":(.*)\}$', 1), F.lit("}")))
    tool = F.when(sums, "calculate").otherwise("fetch")
    call = F.format_string('{"tool_calls":[{"id":"%s","name":"search","arguments":%s,"depends_on":["%s"]},{"id":"%s","name":"%s","arguments":%s}]}', name("b", turn), arguments_b, name("a", turn), name("a", turn), tool, inner)
    answer = conversations.where("role = 'assistant' and text is not null and turn is not null")
    before = (F.col("turn") - 1).cast("string")
    results = F.explode(F.array(F.to_json(F.struct(name("a", before).alias("tool_call_id"), F.struct("text", size.alias("length")).alias("content"))), F.to_json(F.struct(name("b", before).alias("tool_call_id"), size.alias("content")))))
    keep = conversations.select("conv_id", "turn", "role", "text")
    calls = user.select("conv_id", "turn", F.lit("assistant").alias("role"), call.alias("text"))
    return keep.unionAll(calls).unionAll(answer.select("conv_id", "turn", F.lit("tool").alias("role"), results.alias("text")))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, with the calls of :func:`tool_turns`, as canonical JSON with its tool calls linked."""
    return toolchat.link_tool_calls(tool_turns(_table(spark, sf_dir, "conversations")), TOOLS)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all sources; labelled documents weigh 1 or a quarter, others a half."""
    return mixing.sample_plan(_table(spark, sf_dir, "documents"), mixing.quality_weights(_table(spark, sf_dir, "labels")))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topk.K largest inner products of every embedding whose id is divisible by 50, among all embeddings."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    return puquality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of personal data in every document."""
    docs = _table(spark, sf_dir, "documents")
    return pii.find_private(docs, pii.train_on(docs))


#: (rule_id, pattern, action)
URL_RULES = [
    (1, "spam-farm.example.org/", "block"),
    (2, "casino-win.example.com/", "block"),
    (3, "m.casino-win.example.com/en/", "allow"),
    (4, "m.casino-win.example.com/en/1", "block"),
    (5, "blog.tionsh.example.net/es/", "block"),
    (6, "tionsh.example.net/es/533/", "allow"),
    (7, "ththth.example.net/en/25", "block"),
    (8, "ththon.example.org/de/", "block"),
    (9, "www.ththon.example.org/de/", "allow"),
    (10, "example.org/fr/", "block"),
    (11, "tionble.example.org/", "allow"),
    (12, "HTTP://WWW.Ththre.Example.net:80/./fr//", "block"),
    (13, "no-such-host.example.com/", "block"),
]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the URL of every page."""
    rule_table = spark.createDataFrame(URL_RULES, "rule_id bigint, pattern string, action string")
    return urlrules.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rule_table)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has a near duplicate, with its group."""
    return near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an incremental index leaves it: two batches, a deletion and a reinsertion.

    Documents of even id come first, then those of odd id. Then those whose id is divisible by 50 are deleted, so that
    lines of which they had the first occurrence pass to others, and inserted again, when they
    lose what others hold by now.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    even, again = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True)), F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    index = LineIndex.create(spark, shards_for(docs), dict(docs.dtypes)["doc_id"])
    index.add(docs.where(even))
    index.add(docs.where(~even))
    index.delete(docs.where(again))
    index.add(docs.where(again))
    return index.texts(docs)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of at most packing.CAPACITY tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_source_mixing": op3_source_mixing,
    "op4_exact_topk": op4_exact_topk,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_private_spans": op6_private_spans,
    "op7_url_filters": op7_url_filters,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
}

_RULE_VALUES = ", ".join(f"({i}, '{p}', '{a}')" for i, p, a in URL_RULES)


def _sql_host(url: str) -> str:
    rest = f"regexp_replace(regexp_replace(trim({url}), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\\\\-]*://', '')"
    return f"lower(regexp_replace(regexp_replace(regexp_extract({rest}, '^([^/?]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"


def _sql_tail(url: str, pattern: str) -> str:
    rest = f"regexp_replace(regexp_replace(trim({url}), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\\\\-]*://', '')"
    return f"regexp_extract(regexp_extract({rest}, '^[^/?]*(.*)$', 1), '{pattern}', 1)"


def _sql_path(url: str) -> str:
    """The path; these tables have no ``..`` steps."""
    path = f"regexp_replace(regexp_replace({_sql_tail(url, '^([^?]*)')}, '(/\\\\.)+/', '/', 'g'), '/+', '/', 'g')"
    return f"CASE WHEN {path} = '' THEN '/' ELSE {path} END"


ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": """
        WITH c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        calls AS (
            SELECT u.conv_id, u.turn, x.first,
                   CASE WHEN x.first AND u.turn % 3 = 2 THEN '{"expression":"' || length(u.text) || ' * 2","precision":' || u.turn || '}'
                        WHEN x.first THEN '{"url":"' || CASE WHEN length(u.text) % 5 > 0 THEN 'https' ELSE 'ftp' END || '://site.example/' || u.conv_id || '/' || u.turn || '"}'
                        ELSE '{"limit":' || length(u.text) % 120 || ',"query":"$a' || u.turn || '"}' END AS arguments,
                   CASE WHEN x.first AND u.turn % 3 <> 2 AND length(u.text) % 5 = 0 THEN '"$.url: pattern"'
                        WHEN NOT x.first AND length(u.text) % 120 < 1 THEN '"$.limit: minimum"' WHEN NOT x.first AND length(u.text) % 120 > 100 THEN '"$.limit: maximum"' END AS broken,
                   CASE WHEN NOT x.first THEN 'search' WHEN u.turn % 3 = 2 THEN 'calculate' ELSE 'fetch' END AS name,
                   CASE WHEN r.text IS NULL THEN NULL WHEN x.first THEN '{"length":' || length(r.text) || ',"text":' || to_json(r.text)::VARCHAR || '}' ELSE length(r.text)::VARCHAR END AS result
            FROM c u CROSS JOIN (VALUES (true), (false)) x(first) LEFT JOIN c r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1 AND r.role = 'assistant'
            WHERE u.role = 'user'
        ), called AS (
            SELECT conv_id, count(*) AS n_calls, count(result) AS n_linked, count_if(broken IS NULL AND result IS NOT NULL)::BIGINT AS n_valid,
                   string_agg('{"arguments":' || arguments || ',"errors":[' || concat_ws(',', broken, CASE WHEN result IS NULL THEN '"result: missing"' END) || '],"id":"' || CASE WHEN first THEN 'a' ELSE 'b' END || turn
                              || '","name":"' || name || '","result":' || coalesce(result, 'null') || '}', ',' ORDER BY turn, first DESC) AS calls
            FROM calls GROUP BY conv_id
        ), orphans AS (
            SELECT conv_id, string_agg('"' || id || '"', ',' ORDER BY id) AS orphans
            FROM (SELECT a.conv_id, x.l || (a.turn - 1) AS id FROM c a CROSS JOIN (VALUES ('a'), ('b')) x(l) WHERE a.role = 'assistant' AND NOT EXISTS (SELECT 1 FROM c u WHERE u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'))
            GROUP BY conv_id
        ), messages AS (
            SELECT conv_id, turn, role, 0 AS nth, text, to_json(text)::VARCHAR AS content FROM c
            UNION ALL SELECT conv_id, turn, 'assistant', 0, '{"tool_calls"', 'null' FROM c WHERE role = 'user'
            UNION ALL SELECT conv_id, turn, 'tool', 1, '', '{"length":' || length(text) || ',"text":' || to_json(text)::VARCHAR || '}' FROM c WHERE role = 'assistant'
            UNION ALL SELECT conv_id, turn, 'tool', 2, '', length(text)::VARCHAR FROM c WHERE role = 'assistant'
        ), told AS (
            SELECT conv_id, count(*) AS n_messages, string_agg('{"content":' || content || ',"role":"' || role || '","turn":' || turn || '}', ',' ORDER BY turn, role, nth, text) AS messages FROM messages GROUP BY conv_id
        )
        SELECT t.conv_id, n_messages, coalesce(n_calls, 0) AS n_calls, coalesce(n_linked, 0) AS n_linked, coalesce(n_valid, 0) AS n_valid,
               '{"messages":[' || messages || '],"tool_calls":[' || coalesce(calls, '') || '],"unmatched_results":[' || coalesce(orphans, '') || ']}' AS json
        FROM told t LEFT JOIN called USING (conv_id) LEFT JOIN orphans USING (conv_id)""",
    "op4_exact_topk": f"""
        WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        pairs AS (
            SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_inner_product(a.e, b.e), {topk.DIGITS}) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        )
        SELECT * FROM (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS rank, neighbor_id, score FROM pairs)
        WHERE rank <= {topk.K}""",
    "op7_url_filters": f"""
        WITH rules AS (
            SELECT rule_id, action, {_sql_host('pattern')} || {_sql_path('pattern')} || {_sql_tail('pattern', '([?].*)$')} AS expression
            FROM (VALUES {_RULE_VALUES}) t(rule_id, pattern, action)
        ), urls AS (
            SELECT DISTINCT url, {_sql_host('url')} AS host, {_sql_path('url')} AS path, {_sql_tail('url', '([?].*)$')} AS query FROM pages
        ), suffixes AS (
            SELECT url, path, query, host AS suffix FROM urls
            UNION SELECT url, path, query, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
            FROM (SELECT *, unnest(range(2, len(string_split(host, '.')))) AS i FROM urls)
        ), paths AS (
            SELECT url, suffix, path || query AS p FROM suffixes UNION SELECT url, suffix, path FROM suffixes UNION SELECT url, suffix, '/' FROM suffixes
            UNION SELECT url, suffix, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') || '/'
            FROM (SELECT *, unnest(range(1, len(string_split(path, '/')))) AS i FROM suffixes)
        ), hits AS (
            SELECT url, action, rule_id,
                   row_number() OVER (PARTITION BY url ORDER BY length(suffix) DESC, length(suffix || p) DESC, action, rule_id) AS nth
            FROM paths JOIN rules ON suffix || p = expression
        )
        SELECT page_id, p.url, coalesce(action, 'allow') AS verdict, rule_id::BIGINT AS rule_id
        FROM pages p LEFT JOIN hits h ON p.url = h.url AND nth = 1""",
    "op3_source_mixing": f"""
        WITH weights AS (
            SELECT doc_id, min(CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.25 ELSE 0.5 END)::DOUBLE AS weight FROM labels GROUP BY doc_id
        ), items AS (
            SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^ \\t\\n\\r\\x0B\\f]+'))::BIGINT AS tokens,
                   -ln((('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
                       / coalesce(w.weight, 0.5) AS key
            FROM documents d LEFT JOIN weights w ON d.doc_id = w.doc_id
        ), totals AS (
            SELECT source, sum(tokens)::BIGINT AS total FROM items GROUP BY source HAVING sum(tokens) > 0
        ), own AS (
            SELECT source, total, floor((SELECT sum(total) FROM totals)::DOUBLE * sqrt(total::DOUBLE) / (SELECT sum(sqrt(total::DOUBLE)) FROM totals))::BIGINT AS own FROM totals
        ), plan AS (
            SELECT source, own // total AS epochs, own % total AS rest FROM own
        ), ran AS (
            SELECT i.*, p.epochs, p.rest, sum(tokens) OVER (PARTITION BY i.source ORDER BY key, doc_id) AS run
            FROM items i JOIN plan p ON i.source IS NOT DISTINCT FROM p.source
        )
        SELECT doc_id, source, tokens, unnest(range(1, epochs + 1 + CASE WHEN run <= rest THEN 1 ELSE 0 END)) AS epoch FROM ran""",
    "op9_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM (SELECT DISTINCT doc_id, text FROM documents)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY trim(line, ' ') ORDER BY CASE WHEN doc_id % 50 = 0 THEN 2 ELSE coalesce(doc_id % 2, 0) END, doc_id, pos) AS nth FROM lines
        ), judged AS (
            SELECT doc_id, line, pos, nth = 1 OR length(trim(line, ' ')) < {MIN_CHARS} AS stays FROM ranked
        ), kept AS (
            SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS text, bool_and(stays) AS whole
            FROM judged GROUP BY doc_id
        )
        SELECT doc_id, text FROM kept WHERE whole OR regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]')
        UNION ALL SELECT doc_id, text FROM documents WHERE text IS NULL""",
}
