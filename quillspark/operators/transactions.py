"""The transaction graph: accounts that share hubs, velocity, signals."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import text as T
from quillspark.operators.ranking import distinct_rows, top_per


def hubs(txns: DataFrame) -> DataFrame:
    """Distinct (account, kind, hub) of the senders' devices and cards; few rows are alike."""
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("hub")) for k in ("device", "card")])
    rows = txns.select(F.col("from").alias("account"), F.explode(both).alias("h")).select("account", "h.*").where("hub is not null and hub <> ''")
    return distinct_rows(rows)


def rings(accounts: DataFrame, account_hubs: DataFrame, k: int = 5) -> DataFrame:
    """(account, peer, kind): accounts that share a hub, through the hub and only from the accounts asked for.

    The first k peers of an account are among the first k + 1 accounts of one of its hubs, so a hub that very many
    share sends no more than those.
    """
    own = account_hubs.join(accounts.select("account").distinct(), "account", "left_semi")
    peers = top_per(account_hubs, ["kind", "hub"], [F.col("account")], k + 1).select(F.col("account").alias("peer"), "kind", "hub")
    found = own.join(peers, ["kind", "hub"]).where("peer <> account").select("account", "peer", "kind").distinct()
    return top_per(found, ["account"], [F.col("peer"), F.col("kind")], k)


def velocity(txns: DataFrame, least: int = C.VELOCITY) -> DataFrame:
    """Accounts with many distinct outbound transactions."""
    return txns.groupBy(F.col("from").alias("account")).agg(F.countDistinct("txn_id").alias("n_txns")).where(F.col("n_txns") >= least)


def _told(template: str, **values: str) -> Column:
    """A fixed sentence with columns in its slots."""
    parts = [(F.lit(text), F.col(values[slot]).cast("string") if slot else F.lit("")) for text, slot, *_ in Formatter().parse(template)]
    return F.concat(*[x for pair in parts for x in pair])


def signals(queries: DataFrame, txns: DataFrame, k: int = 5) -> DataFrame:
    """(qid, text, doc_id, doc_type): ring and velocity sentences for the account a query names."""
    asked = queries.select("qid", T.account_id(F.col("text")).alias("account")).where("account is not null")
    sent = txns.withColumn("from", F.lower(F.col("from").cast("string")))
    ring = asked.join(rings(asked, hubs(sent), k), "account").select(
        "qid",
        _told(C.RING_TEXT, account="account", kind="kind", peer="peer").alias("text"),
        F.concat(F.lit("fraud:"), "account", F.lit(":"), "peer").alias("doc_id"),
    )
    own = sent.join(asked.select(F.col("account").alias("from")).distinct(), "from", "left_semi")
    fast = asked.join(velocity(own), "account").select(
        "qid",
        _told(C.VELOCITY_TEXT, account="account", n="n_txns").alias("text"),
        F.concat(F.lit("fraud:velocity:"), "account").alias("doc_id"),
    )
    return ring.union(fast).withColumn("doc_type", F.lit("fraud_graph"))
