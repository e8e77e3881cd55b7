"""Transfers: the one fact table, and where its rows come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CHAINS, EngineConfig
from ..operators import ordering
from ..operators.ordering import shares

AMOUNT = "decimal(28,8)"
#: An event's place in time; ties are broken by every field, so the order is total up to copies.
ORDER = ["ts", "block", "tx_index", "tx_hash", "asset", "from_addr", "to_addr", "value"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wallet_count(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "customer").count()


def transfer_count(spark: SparkSession, sf_dir: str) -> int:
    """Transfers of the ledger at most; from the files' footers."""
    return table(spark, sf_dir, "lineitem").count()


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order tables seen as transfers between wallets w0 .. w(n-1)."""
    n, most = F.lit(wallet_count(spark, sf_dir)), transfer_count(spark, sf_dir)
    item = shares(table(spark, sf_dir, "lineitem"), most, "l_orderkey")
    order = shares(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), most, "o_orderkey")
    asset = F.when(F.col("l_returnflag") == "N", "ETH").when(F.col("l_returnflag") == "A", "USDT").otherwise("DAI")
    if most > ordering.FEW * ordering.TASK_ROWS:  # an order comes once, so a task's share of them is small enough to be held
        order = order.hint("shuffle_hash")
    rows = item.join(order, item.l_orderkey == order.o_orderkey).select(
        F.lit(1).alias("chain_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("tx_hash"),
        F.concat(F.lit("w"), F.col("o_custkey") % n).alias("from_addr"),
        F.concat(F.lit("w"), (F.col("l_suppkey") * 7 + F.col("l_partkey")) % n).alias("to_addr"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast(AMOUNT).alias("value"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("ts"),
        F.col("l_orderkey").cast("long").alias("block"),
        F.col("l_linenumber").cast("int").alias("tx_index"),
        asset.alias("asset"),
        F.when(asset != "ETH", F.concat(F.lit("0x"), F.lower(asset))).alias("contract"),
        F.lit(18).alias("decimals"),
    )
    return rows.filter("from_addr <> to_addr")


def chain_table(spark: SparkSession) -> DataFrame:
    """The chains that can be traced."""
    return spark.createDataFrame([(i, *c) for i, c in CHAINS.items()], "chain_id int, slug string, name string, native string")


def wallet_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by residue of the wallet's number: 0 exchange, 1 mixer, 2 bridge, 3 sanctioned."""
    kinds = F.array(*map(F.lit, ("exchange", "mixer", "bridge", "sanctioned")))
    k = F.col("k")
    return (
        spark.range(wallet_count(spark, sf_dir))
        .select(F.col("id").alias("k"))
        .filter(k % 97 <= 3)
        .select(
            F.lit("ethereum").alias("chain"),
            F.concat(F.lit("w"), k).alias("address"),
            F.concat(F.lit("E"), k % 5).alias("entity"),
            F.element_at(kinds, (k % 97 + 1).cast("int")).alias("type"),
            F.lit("synthetic").alias("source"),
        )
    )


def tokens(spark: SparkSession) -> DataFrame:
    """Followed tokens of each chain; a row's own symbol and decimals are never trusted."""
    return spark.sql("select * from values (1, '0xusdt', 'USDT', 6), (1, '0xdai', 'DAI', 18), (137, '0xusdt', 'USDT', 6) as t(chain_id, contract, symbol, token_decimals)")


# ------------------------------------------------------------------- raw rows and their parsers


def normal_address(c: Column) -> Column:
    return F.lower(F.trim(c))


def valid_address(c: Column) -> Column:
    return F.coalesce(normal_address(c).rlike("^0x[0-9a-f]{40}$"), F.lit(False))


def unit(raw: Column, decimals: Column) -> Column:
    """Whole units of a raw integer amount."""
    return F.try_divide(raw.try_cast("double"), F.pow(F.lit(10.0), decimals))


def parse_native(raw: DataFrame, asset: str = "ETH") -> DataFrame:
    """Native rows, all columns strings: failed, self-sent, empty and malformed rows go."""
    rows = raw.select(
        "hash",
        normal_address(F.col("from")).alias("from_addr"),
        normal_address(F.col("to")).alias("to_addr"),
        unit(F.col("value"), F.lit(18)).alias("value"),
        F.col("timeStamp").try_cast("long").alias("ts"),
        F.col("blockNumber").try_cast("long").alias("block"),
        F.coalesce(F.col("transactionIndex").try_cast("int"), F.lit(0)).alias("tx_index"),
        F.coalesce("isError", F.lit("0")).alias("err"),
        *([normal_address(F.col("wallet")).alias("wallet")] if "wallet" in raw.columns else []),
    )
    if "wallet" in raw.columns:  # a history: rows that the wallet has no part in go
        rows = rows.filter("wallet = from_addr or wallet = to_addr").drop("wallet")
    good = rows.filter("err <> '1' and value > 0 and ts is not null and block is not null and from_addr <> '' and to_addr <> '' and from_addr <> to_addr")
    return good.drop("err").withColumn("asset", F.lit(asset))


def parse_tokens(raw: DataFrame, allow: DataFrame) -> DataFrame:
    """Token rows with the allowlist's symbol and decimals; ``symbol`` is null for tokens not
    followed, whose claimed symbol stays for the tally.  The allowlist is a short, fixed table."""
    rows = raw.withColumn("contract", F.lower("contractAddress")).join(F.broadcast(allow), ["chain_id", "contract"], "left")
    claimed = F.when(F.coalesce(F.trim("tokenSymbol"), F.lit("")) == "", "(unnamed token)").otherwise(F.substring(F.trim("tokenSymbol"), 1, 20))
    rows = rows.select(
        "chain_id", "hash", normal_address(F.col("from")).alias("from_addr"), normal_address(F.col("to")).alias("to_addr"), "contract", "symbol",
        claimed.alias("claimed"), unit(F.col("value"), F.col("token_decimals")).alias("value"), F.col("timeStamp").try_cast("long").alias("ts"),
    )
    return rows.filter("from_addr <> to_addr and ts is not null and (symbol is null or value > 0)")


def skipped_tokens(parsed: DataFrame, visited: DataFrame) -> DataFrame:
    """How many rows of each token not followed the visited wallets (column address) sent."""
    own = visited.select(F.col("address").alias("from_addr")).distinct()
    return parsed.filter("symbol is null").join(own, "from_addr", "left_semi").groupBy("chain_id", "claimed").agg(F.count("*").alias("n"))


def merged_histories(native: DataFrame, tokens: DataFrame) -> DataFrame:
    """Both streams of parsed rows as one ledger; copies stay, they are events of their own."""
    return native.unionByName(tokens.filter("symbol is not null").withColumnRenamed("symbol", "asset").drop("claimed"), allowMissingColumns=True)


def impersonated(skipped: DataFrame, allow: DataFrame) -> DataFrame:
    """Skipped tokens that claim a followed symbol of their chain."""
    followed = allow.select("chain_id", F.upper("symbol").alias("up")).distinct()
    return skipped.withColumn("up", F.upper("claimed")).join(F.broadcast(followed), ["chain_id", "up"], "left_semi").select("chain_id", "claimed", "n")


def token_note(skipped: DataFrame, allow: DataFrame, chain_id: int, shown: int = 8) -> DataFrame:
    """One row that tells which token transfers of a chain were not followed, none if all were.  Tokens that
    bear a followed asset's symbol are no gap: their contract is another one."""
    own = skipped.filter(F.col("chain_id") == chain_id).groupBy("chain_id", "claimed").agg(F.sum("n").alias("n"))
    fake = impersonated(own, allow).select("claimed", F.lit(True).alias("fake"))
    own = own.join(fake, "claimed", "left").withColumn("fake", F.coalesce("fake", F.lit(False)))
    followed = F.array(*map(F.lit, sorted(r.symbol for r in allow.filter(F.col("chain_id") == chain_id).select("symbol").distinct().collect())))
    top = own.orderBy(F.desc("n"), "claimed").limit(shown).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "claimed", "n", "fake"))).alias("top"))
    counts = own.agg(F.sum("n").alias("skipped_transfers"), F.count("*").alias("distinct_tokens"), F.max("fake").alias("any_fake")).filter("distinct_tokens > 0")
    # claimed symbols that equal a followed one in upper case: few spellings of few symbols
    fakes = own.filter("fake").agg(F.sort_array(F.collect_set("claimed")).alias("impersonated_symbols"))
    rows = counts.join(F.broadcast(top)).join(F.broadcast(fakes))  # a row each
    return rows.select(
        "skipped_transfers", "distinct_tokens", followed.cast("array<string>").alias("followed_assets"),
        F.transform("top", lambda x: F.struct(x["claimed"].alias("asset"), x["n"].alias("transfers"), x["fake"].alias("impersonating"))).alias("top_skipped"),
        "impersonated_symbols",
        F.lit("Tokens that are not on the list of followed ones were left out. Most are unasked-for spam, but a real trail in one of them would be missed too.").alias("reason"),
        F.when(F.col("any_fake"), F.concat(F.lit("Refused, not missed: these names are borne by contracts other than the real asset's: "), F.array_join("impersonated_symbols", ", "))).alias("impersonation_note"),
    )


def history(transfers: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Each wallet's most recent rows of either kind, both directions, at most ``history_rows`` each."""
    both = transfers.select(F.col("from_addr").alias("wallet"), *transfers.columns).unionByName(transfers.select(F.col("to_addr").alias("wallet"), *transfers.columns))
    return last_rows(both, cfg)


def last_rows(both: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Of rows by wallet the most recent of each kind."""
    both = both.withColumn("kind", F.when(F.col("contract").isNull(), "native").otherwise("token"))
    w = Window.partitionBy("wallet", "kind").orderBy(F.desc("block"), F.desc("tx_index"), F.desc("tx_hash"), *ORDER[4:])
    return both.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cfg.history_rows)


def observed(transfers: DataFrame, wallets: DataFrame) -> DataFrame:
    """Transfers that touch an observed wallet (column address), each once: on a ledger that holds a
    transfer once, that is the owner rule."""
    a = wallets.select("address").distinct()
    sent = transfers.join(a, transfers.from_addr == a.address, "left_semi")
    received = transfers.join(a, transfers.to_addr == a.address, "left_semi").join(a, transfers.from_addr == a.address, "left_anti")
    return sent.unionByName(received)


def owned(histories: DataFrame, wallets: DataFrame) -> DataFrame:
    """Events of histories (column wallet: whose history a row is in; the rest a transfer).  A transfer
    between two observed wallets (column address) is in both histories: the sender's copy counts where the
    sender is observed, the recipient's where it isn't.  Equal rows within one history are transfers of
    their own and stay."""
    seen = wallets.select(F.col("address").alias("from_addr")).distinct().withColumn("sender_seen", F.lit(True))
    rows = histories.join(seen, "from_addr", "left")
    owner = F.when(F.col("sender_seen"), F.col("from_addr")).otherwise(F.col("to_addr"))
    return rows.filter(F.col("wallet") == owner).select(*(c for c in histories.columns if c != "wallet"))


def mirrored(transfers: DataFrame, wallets: DataFrame) -> DataFrame:
    """The histories of wallets (column address): each transfer once for each end that is one of them."""
    ends = transfers.select(F.explode(F.array_distinct(F.array("from_addr", "to_addr"))).alias("wallet"), *transfers.columns)
    return ends.join(wallets.select(F.col("address").alias("wallet")).distinct(), "wallet", "left_semi")
