"""Shared CTEs of the reference SQL (log, first plays, samples, best rows, notes)."""

LOG = """log AS (SELECT o_custkey AS player, l_partkey AS item, CAST(epoch(o_orderdate) AS BIGINT) AS ts,
 l_orderkey * 8 + l_linenumber AS seq, l_extendedprice AS price, l_quantity AS ex, l_quantity * 2 AS acc,
 CASE WHEN l_linenumber = 7 THEN 8 ELSE l_linenumber - 1 END AS lamp, CAST(round(l_tax * 100) AS INT) AS bp
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

FP = LOG + """, fp AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY player, item
 ORDER BY ts, seq, price) AS rn FROM log) WHERE rn = 1 AND lamp <> 0 AND acc > 0)"""

ITEMS = """items AS (SELECT p_partkey AS item, p_size AS notes, CAST(p_size AS DOUBLE) AS x1, p_retailprice AS x2,
 p_brand AS brand, p_type AS kind, p_name AS title FROM part)"""

SAMPLES = FP + ", " + ITEMS + """, smp AS (SELECT fp.*, notes, x1, x2 FROM fp LEFT JOIN items USING (item))"""

BEST = LOG + """, best AS (SELECT player, item, acc, lamp, bp, plays FROM (SELECT *,
 count(*) OVER (PARTITION BY player, item) AS plays, row_number() OVER (PARTITION BY player, item
 ORDER BY acc DESC, lamp DESC, bp, ts DESC, seq DESC, price DESC) AS rn FROM log) WHERE rn = 1)"""

NOTES = """notes AS (SELECT user_id AS item, event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 2700000000 AS tick,
 CAST(json_extract(props, '$.k') AS INT) % 8 AS lane, CASE WHEN CAST(json_extract(props, '$.k') AS INT) >= 90 THEN 1 ELSE 0 END AS type,
 CAST(floor(value / 4) AS BIGINT) AS dur FROM events)"""

CLIENTS = "clients AS (SELECT c_custkey AS player, c_mktsegment AS client, c_nationkey AS team FROM customer)"

PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def draw_hex(*parts: str) -> str:
    return "substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 8)"


def draw(*parts: str) -> str:
    return "(CAST(concat('0x', " + draw_hex(*parts) + ") AS BIGINT) / 4294967296.0)"
