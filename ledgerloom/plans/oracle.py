"""Standard SQL pieces that the oracle statements share."""

LEDGER = """
n AS (SELECT count(*) AS n FROM customer),
ledger AS (
  SELECT * FROM (
    SELECT l_orderkey || '-' || l_linenumber AS tx_hash, 'w' || (o_custkey % n) AS from_addr,
           'w' || ((l_suppkey * 7 + l_partkey) % n) AS to_addr,
           CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(28,8)) AS value,
           CAST(epoch(l_shipdate) AS BIGINT) AS ts, l_orderkey AS block, CAST(l_linenumber AS INT) AS tx_index,
           CASE l_returnflag WHEN 'N' THEN 'ETH' WHEN 'A' THEN 'USDT' ELSE 'DAI' END AS asset,
           CASE l_returnflag WHEN 'N' THEN NULL WHEN 'A' THEN '0xusdt' ELSE '0xdai' END AS contract
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN n)
  WHERE from_addr <> to_addr),
tags AS (
  SELECT 'w' || k AS address, 'E' || (k % 5) AS entity, ['exchange', 'mixer', 'bridge', 'sanctioned'][k % 97 + 1] AS type
  FROM (SELECT unnest(range(n)) AS k FROM n) WHERE k % 97 <= 3),
clean AS (SELECT * FROM ledger WHERE value >= 1000)
"""

#: Flows of not-dust transfers, edges with their primary asset, and each sender's best 25.
FLOWS = """
flows AS (
  SELECT from_addr, to_addr, asset, sum(value) AS value, count(*) AS tx_count, max(ts) AS ts,
         (array_agg(tx_hash ORDER BY value DESC, ts, block, tx_index, tx_hash))[1] AS tx_hash,
         min((ts, block, tx_index, tx_hash)) AS first_seen
  FROM clean GROUP BY ALL),
edge AS (
  SELECT from_addr, to_addr, sum(tx_count) AS tx_count, max(ts) AS ts,
         coalesce(max(CASE WHEN asset = 'ETH' THEN value END), 0) AS native_max, max(value) AS any_max,
         (array_agg(asset ORDER BY asset = 'ETH' DESC, value DESC, asset DESC))[1] AS asset,
         (array_agg(value ORDER BY asset = 'ETH' DESC, value DESC, asset DESC))[1] AS value,
         min(first_seen) AS first_seen
  FROM flows GROUP BY ALL),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_addr ORDER BY native_max DESC, any_max DESC, first_seen, to_addr) AS rank FROM edge)
  WHERE rank <= 25)
"""



def _walk(depth: int) -> str:
    """The walk from w7, level by level: terminal wallets and those that the edges so far make suspected
    exchanges (fan-in at 6 and at the graph's own floor, no label) are not opened."""
    out = ["s0 AS (SELECT 'w7' AS address, 0 AS depth)", "o0 AS (SELECT * FROM s0)"]
    for k in range(1, depth + 1):
        union = lambda name, first: " UNION ALL ".join(f"SELECT * FROM {name}{i}" for i in range(first, k + 1))  # noqa: E731, B023
        before = " UNION ALL ".join(f"SELECT address FROM s{i}" for i in range(k))
        out += [
            f"e{k} AS (SELECT b.* FROM best b JOIN o{k - 1} o ON o.address = b.from_addr)",
            f"s{k} AS (SELECT DISTINCT to_addr AS address, {k} AS depth FROM e{k} WHERE to_addr NOT IN ({before}))",
            f"f{k} AS (SELECT w.address, count(DISTINCT e.from_addr) AS fan_in FROM ({union('s', 0)}) w LEFT JOIN ({union('e', 1)}) e ON e.to_addr = w.address AND e.from_addr <> e.to_addr GROUP BY w.address)",
            f"l{k} AS (SELECT greatest(6, list_sort(list(fan_in))[CAST(floor(0.95 * (count(*) - 1)) AS INT) + 1]) AS f FROM f{k})",
            f"o{k} AS (SELECT s.* FROM s{k} s JOIN f{k} USING (address), l{k} WHERE address NOT IN (SELECT address FROM tags WHERE type IN ('exchange', 'mixer', 'bridge'))"
            " AND (fan_in < f OR address IN (SELECT address FROM tags)))",
        ]
    seen = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(depth + 1))
    opened = " UNION ALL ".join(f"SELECT * FROM o{i}" for i in range(depth))
    return ",\n".join([*out, f"seen AS ({seen})", f"opened AS ({opened})"])


WALK = _walk(4)

#: Queue positions of the FIFO replay from w7.
FIFO = """
ev AS (
  SELECT *, ts || '|' || block || '|' || tx_index || '|' || tx_hash || '|' || asset || '|' || from_addr || '|' || to_addr || '|' || value || '|' || copy AS event
  FROM (SELECT *, row_number() OVER (PARTITION BY ts, block, tx_index, tx_hash, asset, from_addr, to_addr, value) AS copy FROM ledger)),
moves AS (
  SELECT from_addr AS wallet, asset, event, value, (ts, block, tx_index, tx_hash, from_addr, to_addr, value, copy) AS place, 1 AS out FROM ev WHERE from_addr <> 'w7'
  UNION ALL SELECT to_addr, asset, event, value, (ts, block, tx_index, tx_hash, from_addr, to_addr, value, copy), 0 FROM ev),
run AS (
  SELECT *, sum(CASE WHEN out = 1 THEN value ELSE 0 END) OVER w AS o, sum(CASE WHEN out = 0 THEN value ELSE 0 END) OVER w AS i
  FROM moves WINDOW w AS (PARTITION BY wallet, asset ORDER BY place, out ROWS UNBOUNDED PRECEDING)),
short AS (
  SELECT *, greatest(max(o - i) OVER (PARTITION BY wallet, asset ORDER BY place, out ROWS UNBOUNDED PRECEDING), 0) AS s FROM run),
prior AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY wallet, asset ORDER BY place, out), 0) AS s0 FROM short),
pos AS (
  SELECT wallet, asset, event, value, out,
         CASE WHEN out = 1 THEN o - value - s0 ELSE i - value END AS lo, CASE WHEN out = 1 THEN o - s ELSE i END AS hi,
         CASE WHEN out = 1 THEN s - s0 ELSE 0 END AS shortfall FROM prior),
points AS (
  SELECT wallet, asset, lo, max((event, hi)) FILTER (out = 1) AS d, max((event, hi, value)) FILTER (out = 0) AS c FROM pos WHERE hi > lo GROUP BY ALL),
sweep AS (
  SELECT wallet, asset, lo, lead(lo) OVER w AS next, last_value(d IGNORE NULLS) OVER r AS d, last_value(c IGNORE NULLS) OVER r AS c
  FROM points WINDOW w AS (PARTITION BY wallet, asset ORDER BY lo), r AS (PARTITION BY wallet, asset ORDER BY lo ROWS UNBOUNDED PRECEDING)),
draws AS (
  SELECT wallet, asset, d[1] AS debit, c[1] AS credit, least(coalesce(next, d[2]), d[2], c[2]) - lo AS amount, c[3] AS credit_value
  FROM sweep WHERE d IS NOT NULL AND c IS NOT NULL AND least(coalesce(next, d[2]), d[2], c[2]) > lo)
"""


def taint_rounds(rounds: int) -> str:
    """Rounds of the taint's linear system, one after another."""
    out = ["r0 AS (SELECT event, CAST(value AS DOUBLE) AS t FROM ev WHERE from_addr = 'w7')"]
    for k in range(1, rounds + 1):
        out.append(f"r{k} AS (SELECT debit AS event, sum(CAST(amount AS DOUBLE) / CAST(credit_value AS DOUBLE) * t) AS t FROM draws JOIN r{k - 1} ON credit = event GROUP BY debit)")
    union = " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(rounds + 1))
    return ",\n".join([*out, f"tainted AS (SELECT event, sum(t) AS tainted FROM ({union}) GROUP BY event)"])


#: Per wallet and asset: totals, recipients, dwell.
TOTALS = """
sides AS (
  SELECT from_addr AS wallet, asset, to_addr AS other, 1 AS out, sum(value) AS v, count(*) AS c FROM ledger GROUP BY ALL
  UNION ALL SELECT to_addr, asset, from_addr, 0, sum(value), count(*) FROM ledger GROUP BY ALL),
totals AS (
  SELECT wallet, asset, coalesce(sum(v) FILTER (out = 1), 0) AS sent, coalesce(sum(v) FILTER (out = 0), 0) AS received,
         CAST(coalesce(sum(c) FILTER (out = 1), 0) AS BIGINT) AS n_sent, CAST(coalesce(sum(c) FILTER (out = 0), 0) AS BIGINT) AS n_received,
         count(*) FILTER (out = 1) AS recipients, count(*) FILTER (out = 0) AS senders
  FROM sides GROUP BY ALL),
gaps AS (
  SELECT o.from_addr AS wallet, o.asset, o.tx_hash, o.ts, o.ts - i.ts AS dwell
  FROM ledger o ASOF JOIN (SELECT to_addr, asset, ts FROM ledger) i ON o.from_addr = i.to_addr AND o.asset = i.asset AND o.ts >= i.ts),
through AS (
  SELECT t.*, CAST(sent AS DOUBLE) / CAST(received AS DOUBLE) AS ratio, g.dwell, g.pairs
  FROM totals t JOIN (SELECT wallet, asset, median(dwell) AS dwell, count(*) AS pairs FROM gaps GROUP BY ALL) g USING (wallet, asset)
  WHERE sent > 0 AND received > 0),
paid AS (
  SELECT from_addr AS wallet, asset, to_addr AS other, sum(value) AS v, min((ts, block, tx_index, tx_hash)) AS first FROM ledger GROUP BY ALL)
"""


def statement(select: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(p.strip() for p in (LEDGER, *parts))}\n{select}"
