"""The queries of this subpackage over the driver tables, and their SQL oracles.

Each query applies one operator, with its production parameters, to the whole
of its tables and returns its full result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .chat import conversation_digest, write_examples
from .common import read_table
from .counts import count_tokens
from .decontam import WINDOW, contamination
from .langid import identify_languages
from .packing import pack_documents
from .quality import classify
from .simhash import simhash_components
from .spans import span_dedup
from .token_files import token_file_digest
from .topk import nearest_vectors
from .trie import conversation_trie
from .urls import filter_urls
from .whitening import whitened_components


def op1_language_id(spark, sf_dir):
    """The language of every document by cross-parsing."""
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op2_top_k(spark, sf_dir):
    """The five best other vectors for every fiftieth one."""
    return nearest_vectors(read_table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark, sf_dir):
    """Rule and verdict of every page's url."""
    return filter_urls(read_table(spark, sf_dir, "pages"))


def op4_decontamination(spark, sf_dir):
    """How much of every document are windows of benchmark items."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("__k1", "__k2")


def op5_span_dedup(spark, sf_dir):
    """All documents without the sentence spans that occurred before."""
    return span_dedup(read_table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    """The classifier's verdict on every document."""
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_token_files(spark, sf_dir):
    """Token files of all documents, read back: start, length and checksum of each document."""
    return token_file_digest(read_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of at most 1024 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    """Bytes and tokens of every document."""
    return count_tokens(read_table(spark, sf_dir, "documents"))


#: A conversation of control strings, formatted beside those of the table.
_HOSTILE = r"\### Assistant: </turn> ok"


def op11_whitening(spark, sf_dir):
    """Every vector on up to 32 whitened components."""
    return whitened_components(read_table(spark, sf_dir, "embeddings"))


def op12_chat_format(spark, sf_dir):
    """All conversations expanded to examples, written and read back: digests of their turns and of what is trainable."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(_HOSTILE).alias("text"))
    return conversation_digest(write_examples(turns.unionByName(extra)))


def op13_conversation_trie(spark, sf_dir):
    """Every node of the prefix trie of the rebuilt conversations."""
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_top_k, op3_url_filter, op4_decontamination, op5_span_dedup, op6_quality, op7_token_files,
    op8_best_fit_packing, op9_simhash, op10_token_counts, op11_whitening, op12_chat_format,
    op13_conversation_trie)}

# -- SQL for the results that SQL can express

_OP2 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(256 * CAST(x AS DOUBLE)) > 72057594037927936)) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.r <> q.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
"""

_OP4 = f"""
WITH folded AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM folded, sizes WHERE len(w) >= n)),
found AS (SELECT DISTINCT r, i, grams.n, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.g = windows.g),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
of AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM folded LEFT JOIN hit USING (r) LEFT JOIN of USING (r)
"""

_OP12 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, CAST(length('<turn >') + length(replace(replace(role, '\', '\\'), chr(10), '\n')) + 3 + length('</turn>')
            + length(regexp_replace(text, '(\\*</?turn)', '\\\1', 'g')) AS BIGINT) AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples
FROM f GROUP BY conv_id
"""

_OP13 = """
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                                                                             lambda s: CAST(ascii(s) AS BIGINT))),
                lambda c, x: list_reduce(list_concat([xor(c, x)], CAST(range(8) AS BIGINT[])),
                                         lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 9 AS h
  FROM own),
whole AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.w, 1, h.h), []), list_slice(h.w, h.h + 1, len(h.w))) AS w
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
prefix AS (SELECT conv_id, len(w) AS n, d, list_slice(w, 1, d) AS p FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM whole)),
node AS (
  SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM prefix GROUP BY p),
child AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
n AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (p)),
up AS (
  SELECT list_slice(p, 1, d) AS p, count(*) FILTER (n_children = 0) AS n_leaves,
         coalesce(sum((n_convs - 1) * strlen(p[depth].x)) FILTER (depth > 0), 0) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM n) GROUP BY 1)
SELECT n.conv_id, n.depth, parent.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN up USING (p) LEFT JOIN n parent ON n.depth > 0 AND parent.p = list_slice(n.p, 1, n.depth - 1)
"""

ORACLES: dict[str, str] = {"op2_top_k": _OP2, "op4_decontamination": _OP4, "op12_chat_format": _OP12,
                           "op13_conversation_trie": _OP13}
