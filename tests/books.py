"""Small ledgers written as (sender, recipient, amount, time, asset...)."""

SCHEMA = "chain_id int, tx_hash string, from_addr string, to_addr string, value decimal(28,8), ts long, block long, tx_index int, asset string, contract string, decimals int"


def book(spark, rows):
    from decimal import Decimal

    out = []
    for i, r in enumerate(rows):
        a, b, v, ts = r[:4]
        more = r[4] if len(r) > 4 else {}
        asset = more.get("asset", "ETH")
        out.append((1, more.get("hash", f"0x{i:04d}"), a, b, Decimal(str(v)), ts, more.get("block", ts), more.get("tx_index", 0), asset, None if asset == "ETH" else "0x" + asset.lower(), 18))
    return spark.createDataFrame(out, SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame([("ethereum", a, e, t, "test") for a, e, t in rows] or [], "chain string, address string, entity string, type string, source string")
