"""Text, tokens and vocabularies on the supplied tables (whole texts)."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from faultline.functions import text as x
from faultline.functions.columns import big, r6
from faultline.operators import vocabulary as v
from faultline.operators.history import first_files_and_lines
from faultline.session import cut_lineage
from faultline.plans.registry import VIEWS, query


def _re(pattern: str) -> str:
    """A pattern as an SQL literal; the oracle's engine writes code points as \\x{..} too."""
    return "'" + pattern.replace("'", "''") + "'"


_TOKENS = f"list_filter(regexp_extract_all(text, {_re(x.WORD_OR_SYMBOL)}), lambda t: t <> '_')"
_BLANKS = f"list_filter(regexp_split_to_array(text, {_re(x.BLANK + '+')}), lambda t: t <> '')"
# Fixed values, stated here apart from the operators': marks that stand alone, and what parts tokens of code.
_MARKS = _re(r"([.@\-~%^&*()+={}|\\\[\]:;,<>?/])")
_CODE_GAPS = _re(r"[\s\x0B\x1c-\x1f\x85\p{Z}+\-*/,;><=()\[\]{}]")


@query(
    "q_split_sentence",
    f"""SELECT id, md5(trim(regexp_replace(regexp_replace(replace(text, '_', ' '), {_MARKS}, ' \\1 ', 'g'),
    {_re(x.BLANK + '+')}, ' ', 'g'))) AS digest FROM {{v_messages}}""",
)
def q_split_sentence(t):
    return t.v_messages.select("id", F.md5(x.split_sentence(F.col("text"))).alias("digest"))


@query(
    "q_regex_tokens",
    f"""SELECT id, CAST(len({_TOKENS}) AS INT) AS n_tokens, md5(lower(array_to_string({_TOKENS}, ' '))) AS digest FROM {{v_messages}}""",
)
def q_regex_tokens(t):
    rows = t.v_messages.withColumn("tokens", x.word_or_symbol_tokens(F.col("text"), lower=False))
    return rows.select(
        "id", F.size("tokens").alias("n_tokens"), F.md5(F.lower(F.array_join("tokens", " "))).alias("digest")
    )


@query(
    "q_delim_tokens",
    f"""SELECT commit_id, path, line_no, array_to_string(list_filter(regexp_split_to_array(code, {_CODE_GAPS}), lambda t: t <> ''), '|') AS tokens
    FROM {{v_lines}}""",
)
def q_delim_tokens(t):
    return t.v_lines.select(
        "commit_id", "path", "line_no", F.array_join(x.delimiter_tokens(F.col("code")), "|").alias("tokens")
    )


VIEWS["v_code_text"] = """
SELECT l.l_orderkey AS commit_id, l.l_linenumber AS nr, l.l_partkey AS partkey,
       concat('static int ', replace(p.p_name, ' ', '_'), '(int a) ', chr(123), chr(10), ' return a;', chr(10), chr(125), chr(10),
              CASE WHEN l.l_returnflag = 'A' THEN concat('void * ', replace(p.p_name, ' ', '_'), '2 (char b)', chr(10), chr(123), ' ', chr(125)) ELSE 'x(1);' END) AS code
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey"""


@query(
    "q_function_defs",
    f"""SELECT commit_id, CAST(sum(len(regexp_extract_all(code, {_re(x.FUNCTION_DEFINITION)}))) AS BIGINT) AS n_functions
    FROM {{v_code_text}} GROUP BY 1""",
)
def q_function_defs(t):
    return t.v_code_text.groupBy("commit_id").agg(
        F.sum(x.function_definitions(F.col("code"))).cast("bigint").alias("n_functions")
    )


@query(
    "q_path_counts",
    """SELECT commit_id, count(DISTINCT sub) AS ns, count(DISTINCT dir) AS nd, count(DISTINCT name) AS nf FROM (
      SELECT commit_id, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'root' END AS sub,
      CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE 'root' END AS dir,
      regexp_extract(path, '[^/]*$') AS name FROM {v_file_changes}) GROUP BY 1""",
)
def q_path_counts(t):
    p = F.col("path")
    return t.v_file_changes.groupBy("commit_id").agg(
        F.count_distinct(x.subsystem(p)).alias("ns"),
        F.count_distinct(x.directory(p)).alias("nd"),
        F.count_distinct(x.file_name(p)).alias("nf"),
    )


RULES = [
    {"contains": "^https://m[.]", "mode": "regex", "pattern": "[0-9]+"},
    {"contains": "^http://", "mode": "cut", "pattern": "https?://[^/]*"},
    {"contains": "#", "mode": "none"},
]


@query(
    "q_rule_extract",
    """SELECT page_id, url, array_to_string(list_concat(
      CASE WHEN regexp_matches(url, '^https://m[.]') THEN regexp_extract_all(url, '[0-9]+') ELSE [] END,
      CASE WHEN regexp_matches(url, '^http://') AND regexp_extract(url, 'https?://[^/]*') <> ''
           THEN [replace(url, regexp_extract(url, 'https?://[^/]*'), '')] ELSE [] END,
      CASE WHEN regexp_matches(url, '#') THEN [url] ELSE [] END), '|') AS ids FROM pages""",
)
def q_rule_extract(t):
    return t.pages.select("page_id", "url", F.array_join(x.extract_ids(F.col("url"), RULES), "|").alias("ids"))


@query(
    "q_pad_tokens",
    f"""SELECT id, md5(array_to_string(list_concat({_BLANKS}, list_transform(range(256), lambda i: '<NULL>'))[1:256], ' ')) AS digest
    FROM {{v_messages}}""",
)
def q_pad_tokens(t):
    return t.v_messages.select("id", F.md5(F.array_join(x.pad(x.blank_tokens(F.col("text")), 256), " ")).alias("digest"))


@query(
    "q_pad_nested",
    f"""WITH l AS (SELECT id, i, list_concat(list_filter(regexp_split_to_array(line, {_re(x.BLANK + '+')}), lambda t: t <> ''),
        list_transform(range(8), lambda j: '<NULL>'))[1:8] AS toks
      FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM {{v_messages}}))
    SELECT id, md5(array_to_string(list_concat(flatten(list(toks ORDER BY i) FILTER (i < 10)), list_transform(range(160), lambda j: '<NULL>'))[1:160], ' ')) AS digest
    FROM l GROUP BY id""",
)
def q_pad_nested(t):
    # a document plays a commit of one file; 2 files x 10 lines x 8 tokens
    lines = F.transform(F.split("text", "\n"), x.blank_tokens)
    shaped = x.pad_files(F.array(lines), 2, 10, 8)
    return t.v_messages.select("id", F.md5(F.array_join(F.flatten(F.flatten(shaped)), " ")).alias("digest"))


VIEWS["o_first_seen"] = f"""
SELECT token, freq, row_number() OVER (ORDER BY first_doc, first_pos) + 1 AS id FROM (
  SELECT lower(tok) AS token, min(id) AS first_doc, arg_min(i, id * 1000000 + i) AS first_pos, count(*) AS freq FROM (
    SELECT id, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM (SELECT id, {_TOKENS} AS toks FROM {{v_messages}}))
  GROUP BY 1)"""

VIEWS["o_vocab"] = """
SELECT '<NULL>' AS token, 0 AS id, 0 AS freq UNION ALL SELECT '<null>', 1, 0 UNION ALL
SELECT token, id, freq FROM {o_first_seen}"""


def _message_vocab(t):
    return v.first_seen_ids(t.v_messages, "id", x.word_or_symbol_tokens(F.col("text"), lower=False))


@query("q_vocab_ids", "SELECT token, CAST(id AS BIGINT) AS id, CAST(freq AS BIGINT) AS freq FROM {o_vocab}")
def q_vocab_ids(t):
    return _message_vocab(t)


@query(
    "q_vocab_prune",
    """SELECT token, CAST(id AS BIGINT) AS id, CAST(freq AS BIGINT) AS freq FROM (
      SELECT *, row_number() OVER (ORDER BY freq DESC, id) AS rn FROM {o_vocab} WHERE id > 1) WHERE rn <= 500
    UNION ALL SELECT token, id, freq FROM {o_vocab} WHERE id <= 1""",
)
def q_vocab_prune(t):
    return v.prune_vocabulary(_message_vocab(t), 500, ["<NULL>", "<null>"])


VIEWS["o_pruned"] = """
SELECT token, id FROM (SELECT *, row_number() OVER (ORDER BY freq DESC, id) AS rn FROM {o_vocab} WHERE id > 1) WHERE rn <= 500"""

VIEWS["o_encoded"] = f"""
SELECT m.id, list(coalesce(p.id, 0) ORDER BY m.i) AS ids FROM (
  SELECT id, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM (SELECT id, {_TOKENS} AS toks FROM {{v_messages}})) m
LEFT JOIN {{o_pruned}} p ON p.token = lower(m.tok) GROUP BY m.id"""


def _encoded(t):
    vocab = cut_lineage(v.prune_vocabulary(_message_vocab(t), 500, ["<NULL>", "<null>"]))
    tokens = x.word_or_symbol_tokens(F.col("text"), lower=False)
    return v.encode_tokens(t.v_messages, "id", tokens, vocab, most=502), vocab


@query("q_encode_tokens", "SELECT id, md5(array_to_string(ids, ' ')) AS digest FROM {o_encoded}")
def q_encode_tokens(t):
    ids, _ = _encoded(t)
    return ids.select("id", F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("digest"))


@query(
    "q_decode_tokens",
    """SELECT e.id, md5(string_agg(coalesce(p.token, '<NULL>'), ' ' ORDER BY e.i)) AS digest FROM (
      SELECT id, unnest(ids) AS tid, unnest(range(len(ids))) AS i FROM {o_encoded}) e LEFT JOIN {o_pruned} p ON p.id = e.tid GROUP BY e.id""",
)
def q_decode_tokens(t):
    ids, vocab = _encoded(t)
    words = v.decode_tokens(ids, "id", F.col("ids"), vocab, most=502)
    return words.select("id", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(
    "q_multi_hot",
    """SELECT id, CAST(len(list_distinct(ids)) AS INT) AS n_set, md5(array_to_string(list_sort(list_distinct(ids)), ' ')) AS digest FROM {o_encoded}""",
)
def q_multi_hot(t):
    ids, _ = _encoded(t)
    hot = ids.withColumn("hot", v.multi_hot(F.col("ids")))
    return hot.select(
        "id", F.size("hot").alias("n_set"), F.md5(F.array_join(F.col("hot").cast("array<string>"), " ")).alias("digest")
    )


@query(
    "q_clean_code",
    """SELECT doc_id AS id, coalesce(string_agg(line, '|' ORDER BY i) FILTER (i % 2 = 0 AND trim(line) <> ''), '') AS added,
    coalesce(string_agg(line, '|' ORDER BY i) FILTER (i % 2 = 1 AND trim(line) <> ''), '') AS removed FROM {o_doc_lines} GROUP BY 1""",
)
def q_clean_code(t):
    # a document plays one changed file: its lines are added and removed in turn
    lines = F.split("text", "\n")
    side = lambda r: x.drop_blank(F.filter(lines, lambda _, i: i % 2 == r))
    return t.v_messages.select("id", F.array_join(side(0), "|").alias("added"), F.array_join(side(1), "|").alias("removed"))


@query(
    "q_format_change",
    """SELECT commit_id, path, 'added_code: ' || coalesce(' ' || string_agg(code, ' ' ORDER BY line_no) FILTER (side = 'add'), '')
    || ' removed_code: ' || coalesce(' ' || string_agg(code, ' ' ORDER BY line_no) FILTER (side = 'del'), '') AS change
    FROM (SELECT *, dense_rank() OVER (PARTITION BY commit_id ORDER BY path) AS file_no, row_number() OVER (PARTITION BY commit_id, path, side ORDER BY line_no) AS rn FROM {v_lines})
    WHERE file_no <= 10 AND rn <= 11 GROUP BY 1, 2""",
)
def q_format_change(t):
    """Ten files per commit and eleven lines per side at most, so every list is short."""
    rows = first_files_and_lines(t.v_lines, max_files=10, max_lines=11)
    pick = lambda s: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("line_no", "code")))), lambda r: r["code"]
    )
    f = rows.groupBy("commit_id", "path").agg(pick("add").alias("added"), pick("del").alias("removed"))
    return f.select("commit_id", "path", x.format_change(F.col("added"), F.col("removed")).alias("change"))


@query(
    "q_token_windows",
    f"""SELECT id, CAST(i AS INT) AS window_no, CAST(len(toks[i * 96 + 1 : i * 96 + 128]) AS INT) AS n_tokens,
    md5(array_to_string(toks[i * 96 + 1 : i * 96 + 128], ' ')) AS digest
    FROM (SELECT id, toks, unnest(range(1 + CAST(greatest(ceil((len(toks) - 128) / 96), 0) AS BIGINT))) AS i
          FROM (SELECT id, {_BLANKS} AS toks FROM {{v_messages}}))""",
)
def q_token_windows(t):
    w = x.token_windows(x.blank_tokens(F.col("text")), 128, 32)
    return t.v_messages.select("id", F.posexplode(w).alias("window_no", "w")).select(
        "id", "window_no", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("digest")
    )


VIEWS["v_slices"] = """
SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE substr(text, 1, CAST(floor(length(text) / 2) AS INT)) END AS pre,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE substr(text, CAST(floor(length(text) / 2) AS INT) + 1) END AS post
FROM {documents}"""


@query(
    "q_nested_counts",
    f"""SELECT id, CAST((CASE WHEN pre IS NULL THEN 0 ELSE 1 END) + (CASE WHEN post IS NULL THEN 0 ELSE 1 END) AS INT) AS n_sides,
    CAST(coalesce(len(regexp_split_to_array(pre, {_re(x.SLICE_BREAK)})), 0) + coalesce(len(regexp_split_to_array(post, {_re(x.SLICE_BREAK)})), 0) AS INT) AS n_words
    FROM {{v_slices}}""",
)
def q_nested_counts(t):
    # one entry per side, as nested slices of one change
    nested = F.filter(F.array("pre", "post"), lambda s: s.isNotNull())
    words = F.aggregate(F.transform(nested, lambda s: x.slice_word_count(s)), F.lit(0), lambda a, b: a + b)
    return t.v_slices.select("id", F.size(nested).alias("n_sides"), words.alias("n_words"))


@query(
    "q_token_freq",
    f"""SELECT project, token, count(*) AS freq FROM (SELECT project, unnest(list_filter(regexp_split_to_array(text, {_CODE_GAPS}), lambda t: t <> '')) AS token
    FROM {{v_messages}}) GROUP BY 1, 2""",
)
def q_token_freq(t):
    return v.token_frequency(t.v_messages, x.delimiter_tokens(F.col("text")), ["project"])


@query(
    "q_training_words",
    f"""SELECT id, CAST(coalesce(len(regexp_split_to_array(pre, {_re(x.WORD_BREAK)})), 0) + coalesce(len(regexp_split_to_array(post, {_re(x.WORD_BREAK)})), 0) AS INT) AS n_words
    FROM {{v_slices}}""",
)
def q_training_words(t):
    """Words of both sides as the filter of training rows counts them."""
    count = lambda c: x.slice_word_count(F.col(c), x.WORD_BREAK)
    return t.v_slices.select("id", (count("pre") + count("post")).alias("n_words"))


_KW = "(" + ", ".join(f"'{k}'" for k in x.CODE_KEYWORDS) + ")"


@query(
    "q_keyword_counts",
    f"""WITH n AS (SELECT commit_id, side, count(*) AS lines FROM {{v_lines}} GROUP BY 1, 2),
    k AS (SELECT commit_id, side, tok AS keyword, count(*) AS n FROM (
      SELECT commit_id, side, unnest(regexp_split_to_array(code, {_CODE_GAPS})) AS tok FROM {{v_lines}}) WHERE tok IN {_KW} GROUP BY 1, 2, 3)
    SELECT k.commit_id, k.side, k.keyword, k.n, round(k.n / n.lines, 6) AS per_line FROM k JOIN n ON k.commit_id = n.commit_id AND k.side = n.side""",
)
def q_keyword_counts(t):
    lines = t.v_lines
    n = lines.groupBy("commit_id", "side").agg(F.count(F.lit(1)).alias("lines"))
    k = v.keyword_counts(lines, ["commit_id", "side"], x.delimiter_tokens(F.col("code")), x.CODE_KEYWORDS)
    return k.join(n, ["commit_id", "side"]).select(
        "commit_id", "side", "keyword", "n", r6(F.col("n") / F.col("lines"), "per_line")
    )


@query(
    "q_keyword_counts_all",
    f"""SELECT commit_id, tok AS keyword, count(*) AS n FROM (
      SELECT commit_id, unnest(regexp_split_to_array(code, {_CODE_GAPS})) AS tok FROM {{v_lines}}) WHERE tok IN {_KW} GROUP BY 1, 2""",
)
def q_keyword_counts_all(t):
    """Keywords over added and deleted lines together."""
    return v.keyword_counts(t.v_lines, ["commit_id"], x.delimiter_tokens(F.col("code")), x.CODE_KEYWORDS)


WEIGHT_WORDS = ["the", "and", "for", "de", "la", "en", "un", "er", "-", "%", ".", ","]


@query(
    "q_keyword_weights",
    """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line, TRUE AS good FROM benchmark UNION ALL
      SELECT unnest(string_split(text, chr(10))), FALSE FROM documents),
    w AS (SELECT unnest(["""
    + ", ".join(f"'{w}'" for w in WEIGHT_WORDS)
    + """]) AS keyword)
    SELECT keyword, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad,
    round(count(*) FILTER (good) / count(*) FILTER (NOT good), 6) AS weight
    FROM w JOIN l ON contains(l.line, w.keyword) GROUP BY 1 HAVING count(*) FILTER (good) > 0 AND count(*) FILTER (NOT good) > 0""",
)
def q_keyword_weights(t):
    lines = lambda df, good: df.select(F.explode(F.split("text", "\n")).alias("line"), F.lit(good).alias("is_good"))
    both = lines(t.benchmark, True).unionByName(lines(t.documents, False))
    out = v.keyword_weights(both, WEIGHT_WORDS)
    return out.select("keyword", "good", "bad", r6("weight", "weight"))


@query(
    "q_discrete_dist",
    """SELECT n_files, n, round(100.0 * n / sum(n) OVER (), 6) AS pct, round(100.0 * sum(n) OVER (ORDER BY n_files) / sum(n) OVER (), 6) AS running_pct
    FROM (SELECT n_files, count(*) AS n FROM (SELECT commit_id, count(*) AS n_files FROM {v_file_changes} GROUP BY 1) GROUP BY 1)""",
)
def q_discrete_dist(t):
    per_commit = t.v_file_changes.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n_files"))
    out = v.discrete_distribution(per_commit, F.col("n_files"), "n_files")
    return out.select("n_files", "n", r6("pct", "pct"), r6("running_pct", "running_pct"))


@query(
    "q_histogram",
    """WITH w AS (SELECT len(list_filter(regexp_split_to_array(text, '[ ]+'), lambda t: t <> '')) AS v FROM documents)
    SELECT CAST(CASE WHEN v >= 1000 THEN 1000 ELSE floor(v / 50) * 50 END AS BIGINT) AS bin, count(*) AS n FROM w GROUP BY 1""",
)
def q_histogram(t):
    words = F.size(F.filter(F.split("text", "[ ]+"), lambda s: s != ""))
    return v.histogram(t.documents, words, 50, cap=1000)


@query(
    "q_top_k_per_group",
    """SELECT commit_id, path, side, line_no, code FROM (
      SELECT *, dense_rank() OVER (PARTITION BY commit_id ORDER BY path) AS file_no,
             row_number() OVER (PARTITION BY commit_id, path, side ORDER BY line_no) AS rn FROM {v_lines})
    WHERE file_no <= 2 AND rn <= 3""",
)
def q_top_k_per_group(t):
    return first_files_and_lines(t.v_lines, max_files=2, max_lines=3)


@query(
    "q_tfidf",
    f"""WITH tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), {_re(x.LONG_WORD)})) AS token FROM {{v_messages}})
      WHERE token NOT IN ('the', 'and', 'of') GROUP BY 1, 2),
    d AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
    w AS (SELECT id, token, tf, ln((1 + (SELECT count(*) FROM {{v_messages}})) / (1 + df)) + 1 AS idf FROM tf JOIN d USING (token))
    SELECT id, token, tf, round(idf, 6) AS idf, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)), 6) AS weight FROM w""",
)
def q_tfidf(t):
    out = v.tf_idf(t.v_messages, "id", x.long_words(F.col("text")), ["the", "and", "of"])
    return out.select("id", "token", "tf", r6("idf", "idf"), r6("weight", "weight"))


BAG = ["the", "and", "for", "with", "de", "la", "les", "der", "die", "und", "el", "los"]


@query(
    "q_bow_binary",
    "SELECT id, array_to_string(list_transform(["
    + ", ".join(f"'{w}'" for w in sorted(BAG))
    + f"], lambda w: CASE WHEN list_contains({_BLANKS}, w) THEN '1' ELSE '0' END), '') AS bits FROM {{v_messages}}",
)
def q_bow_binary(t):
    rows = t.v_messages.select("id", x.blank_tokens(F.col("text")).alias("tokens"))
    bag = v.binary_bag_of_words(rows, "tokens", BAG)
    bits = F.transform(vector_to_array("bag"), lambda b: b.cast("int").cast("string"))
    return bag.select("id", F.array_join(bits, "").alias("bits"))


@query(
    "q_word_rank",
    f"""SELECT word, round(avg(w), 6) AS value, count(*) AS n FROM (
      SELECT unnest(toks) AS word, unnest(list_transform(range(len(toks)), lambda i: sqrt(1 + i % 10))) AS w
      FROM (SELECT {_BLANKS} AS toks FROM {{v_messages}})) GROUP BY 1 HAVING count(*) >= 2""",
)
def q_word_rank(t):
    rows = t.v_messages.withColumn("tokens", x.blank_tokens(F.col("text")))
    weights = F.transform("tokens", lambda _, i: F.sqrt(1 + i % 10))
    return v.word_rank(rows, F.col("tokens"), weights).select("word", r6("value", "value"), "n")
