"""Query of the conversations' trie."""

from pyspark.sql import functions as F

from txnguard.llm.trie import paths, prefix_trie, turn_lists

GROUP, MOST = 5, 9


def rebuilt(conversations):
    """Each conversation c with the first h turns of c - c % 5 before its own turns after the first h, h = crc32(c) % 9.

    % is SQL's, with the sign of c. The other conversation's turns are none if it is absent."""
    lists = turn_lists(conversations)
    whose = F.col("conv_id") - F.col("conv_id") % GROUP
    own = lists.withColumns({"whose": whose, "h": (F.crc32(F.col("conv_id").cast("string")) % MOST).cast("int")})
    heads = lists.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("whose"), F.slice("turns", 1, MOST - 1).alias("head"))
    joined = own.join(heads, "whose", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    after = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return joined.select("conv_id", F.concat(head, after).alias("turns"))


def op11_prefix_trie(spark, sf_dir):
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie(paths(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


# DuckDB has no crc32: its table is computed, and a decimal id folded over it byte by byte.
SQL = """WITH RECURSIVE crc(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
  struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS turn FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list(turn ORDER BY place) AS turns FROM turns GROUP BY conv_id),
named AS (SELECT w.*, w.conv_id - w.conv_id % 5 AS whose, xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295::BIGINT) % 9 AS h FROM whole w, tab),
rebuilt AS (SELECT n.conv_id, list_concat(coalesce(b.turns[1:n.h], n.turns[1:0]), n.turns[n.h + 1:]) AS turns
  FROM named n LEFT JOIN whole b ON b.conv_id = n.whose),
members AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt),
nodes AS (SELECT depth, turns[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '') AS ends FROM members GROUP BY ALL),
ups AS (SELECT c.path, c.depth, c.conv_id, p.path AS up, p.conv_id AS up_id FROM nodes c JOIN nodes p ON p.depth = c.depth - 1 AND p.path = c.path[1:c.depth - 1]),
kids AS (SELECT up AS path, count(*) AS n FROM ups GROUP BY up),
own AS (SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.path[n.depth].x) END AS saved
  FROM nodes n LEFT JOIN kids k ON k.path = n.path),
along AS (SELECT unnest(range(depth + 1)) AS depth, path, n_children, saved FROM own),
sums AS (SELECT depth, path[1:depth] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM along GROUP BY ALL)
SELECT o.conv_id, o.depth, u.up_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, sha256(o.ends) AS ends_sha256
FROM own o JOIN sums s ON s.depth = o.depth AND s.path = o.path LEFT JOIN ups u ON u.path = o.path AND u.depth = o.depth"""

QUERIES = {"op11_prefix_trie": (op11_prefix_trie, SQL)}
