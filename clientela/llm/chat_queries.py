"""Registered queries over conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, prefix_trie
from .registry import query, table


def _joined(name: str) -> Column:
    return F.array_join(F.transform(name, lambda s: s["text"]), "")


def _trained(name: str) -> Column:
    return F.length(
        F.array_join(F.transform(F.filter(name, lambda s: s["trained"]), lambda s: s["text"]), "")
    ).cast("long")


@query(
    """
    WITH said AS (
      SELECT conv_id, role, text,
             row_number() OVER (PARTITION BY conv_id
                                ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
      FROM conversations WHERE conv_id IS NOT NULL),
    sizes AS (SELECT conv_id, count(*) AS n FROM said GROUP BY conv_id),
    pairs AS (
      SELECT conv_id, n, conv_id % (n + 1) AS same,
             coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS next
      FROM sizes),
    rejected AS (
      SELECT p.conv_id, s.k, s.role, s.text
      FROM pairs p JOIN said s ON s.conv_id = p.conv_id AND s.k <= p.same
      UNION ALL
      SELECT p.conv_id, s.k, s.role, s.text
      FROM pairs p JOIN said s ON s.conv_id = p.next AND s.k > p.same),
    beside AS (
      SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.k, b.k) AS k,
             a.k IS NOT NULL AND b.k IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role
               AND a.text IS NOT DISTINCT FROM b.text AS alike
      FROM said a FULL JOIN rejected b ON b.conv_id = a.conv_id AND b.k = a.k),
    parts AS (
      SELECT conv_id, coalesce(min(k) FILTER (NOT alike) - 1, max(k)) AS p
      FROM beside GROUP BY conv_id),
    shown AS (
      SELECT which, conv_id, k, CASE WHEN role = 'assistant' THEN length(said) + 10 ELSE 0 END AS trained,
             '<|im_start|>' || head || chr(10) || said || '<|im_end|>' || chr(10) AS text
      FROM (SELECT which, conv_id, k, coalesce(role, 'user') AS role,
                   replace(coalesce(role, 'user'), '<|im_', '<| im_') AS head,
                   replace(coalesce(text, ''), '<|im_', '<| im_') AS said
            FROM (SELECT 'c' AS which, conv_id, k, role, text FROM said
                  UNION ALL SELECT 'r', conv_id, k, role, text FROM rejected)))
    SELECT p.conv_id, CAST(p.p AS BIGINT) AS prompt_turns,
           coalesce(string_agg(s.text, '' ORDER BY s.k) FILTER (which = 'c' AND s.k <= p.p), '') AS prompt,
           coalesce(string_agg(s.text, '' ORDER BY s.k) FILTER (which = 'c' AND s.k > p.p), '') AS chosen,
           coalesce(string_agg(s.text, '' ORDER BY s.k) FILTER (which = 'r' AND s.k > p.p), '') AS rejected,
           CAST(coalesce(sum(s.trained) FILTER (which = 'c' AND s.k > p.p), 0) AS BIGINT) AS chosen_trained,
           CAST(coalesce(sum(s.trained) FILTER (which = 'r' AND s.k > p.p), 0) AS BIGINT) AS rejected_trained
    FROM parts p JOIN shown s ON s.conv_id = p.conv_id GROUP BY p.conv_id, p.p
    """
)
def op1_preference(spark: SparkSession, folder: str) -> DataFrame:
    pairs = chat.format_pairs(chat.parted_pairs(table(spark, folder, "conversations")))
    return pairs.select(
        "conv_id",
        "prompt_turns",
        "prompt",
        _joined("chosen").alias("chosen"),
        _joined("rejected").alias("rejected"),
        _trained("chosen").alias("chosen_trained"),
        _trained("rejected").alias("rejected_trained"),
    )


_CRC = """
    crc_table AS (
      SELECT list_transform(range(256), lambda i: list_reduce(
               [i, 0, 0, 0, 0, 0, 0, 0, 0],
               lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    heads AS (
      SELECT conv_id, xor(list_reduce(
               list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                                                        lambda ch: CAST(ascii(ch) AS BIGINT))),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table)"""


@query(
    f"""
    WITH {_CRC},
    said AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
             coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations WHERE conv_id IS NOT NULL),
    plan AS (
      SELECT conv_id, h, conv_id - conv_id % 5 AS base,
             least(h, (SELECT count(*) FROM said s WHERE s.conv_id = k.conv_id - k.conv_id % 5))
               AS shared
      FROM heads k),
    turns AS (
      SELECT p.conv_id, s.pos AS depth, s.role, s.text
      FROM plan p JOIN said s ON s.conv_id = p.base AND s.pos <= p.h
      UNION ALL
      SELECT p.conv_id, s.pos - p.h + p.shared, s.role, s.text
      FROM plan p JOIN said s ON s.conv_id = p.conv_id AND s.pos > p.h),
    paths AS (
      SELECT conv_id, depth, strlen(text) AS bytes, md5(string_agg(
               md5(strlen(role) || ':' || role || text), '') OVER w) AS node
      FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
      UNION ALL SELECT conv_id, 0, 0, 'root' FROM heads),
    linked AS (
      SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
             depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM paths),
    nodes AS (
      SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id,
             count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                               FILTER (WHERE is_end), '')) AS ends_sha256
      FROM linked GROUP BY node),
    children AS (SELECT parent AS node, count(*) AS n FROM nodes GROUP BY parent),
    under AS (
      SELECT top.node, sum(n.saved) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
      FROM nodes n JOIN paths top ON top.conv_id = n.conv_id AND top.depth <= n.depth
      LEFT JOIN children c ON c.node = n.node GROUP BY top.node)
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id,
           CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
           CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens,
           n.ends_sha256
    FROM nodes n JOIN under u USING (node) LEFT JOIN nodes up ON up.node = n.parent
    LEFT JOIN children c ON c.node = n.node
    """
)
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))
