"""The same money in the other ledgers: from any row, hop by hop, and how each hop was made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.views import links_by_narration
from ledgerloom.sources.ledgers import Ledgers

#: How a hop was made: the gateway's columns declare all but the one to the bank, where a reference stands in free text.
HOW = {
    "order": "the order itself", "payment": "payment of the order, by its order_id", "refund": "refund of the payment, by its payment_id", "chargeback": "chargeback of the payment, by its payment_id",
    "payout": "payout the payment names", "bank": "narration holds the payout's reference", "none": "no narration holds the payout's reference", "many": "several narrations hold the payout's reference",
    "no_utr": "the payout has no reference", "own_payout": "the payout itself", "own_bank": "the bank row itself", "unnamed": "the narration holds no payout's reference",
    "members": "payments the payout holds", "behind": "orders of these payments",
}
TABLES = ("orders", "payments", "refunds", "chargebacks", "settlements", "bank")


def _row(hop: int, table: str, id_: Column, how: Column | str, n: Column | None = None) -> list[Column]:
    how = F.lit(HOW[how]) if isinstance(how, str) else how
    return ["root_table", "root_id", F.lit(hop).alias("hop"), F.lit(table).alias("table"), id_.cast("string").alias("id"), how.alias("how"), (n if n is not None else F.lit(None)).cast("long").alias("n")]


def bank_hops(l: Ledgers) -> DataFrame:
    """(settlement_id, bank_row_id, how): the one row whose narration holds a payout's reference; none where there are none or several."""
    hits = links_by_narration(l).groupBy("settlement_id").agg(F.count("*").alias("k"), F.min("bank_row_id").alias("b"))
    rows = l.settlements.select("settlement_id", "utr").join(hits, "settlement_id", "left")
    how = F.when(F.col("utr").isNull(), HOW["no_utr"]).when(F.col("k").isNull(), HOW["none"]).when(F.col("k") > 1, HOW["many"]).otherwise(HOW["bank"])
    return rows.select("settlement_id", F.when(F.col("k") == 1, F.col("b")).alias("bank_row_id"), how.alias("how"))


def links(l: Ledgers, roots: DataFrame) -> DataFrame:
    """(root_table, root_id, hop, table, id, how, n) for rows ``roots`` (root_table, root_id): each row's chain.

    A root is walked up to its order first (a reversal through its payment), then down: all payments of the order, what was
    taken back of them, the payouts they name, the payouts' bank rows. A payout or a bank row lies upstream of many orders;
    from there the walk goes to the other of the two, and counts the payments and orders inside (id null, ``n``). A hop that can't
    be made has a row that says why. Every step is a join on one key: each root and each row of its chain meet once.
    """
    pay = l.payments.select("payment_id", "order_id", F.col("settlement_id").alias("sid"))
    back = l.refunds.select(F.lit("refunds").alias("t"), "item_id", "payment_id").unionByName(l.chargebacks.select(F.lit("chargebacks").alias("t"), "item_id", "payment_id"))
    root = roots.select("root_table", F.col("root_id").cast("string").alias("root_id")).distinct()
    of = lambda *t: root.where(F.col("root_table").isin(*t))
    # up
    by_item = of("refunds", "chargebacks").join(back, (F.col("root_table") == F.col("t")) & (F.col("root_id") == F.col("item_id"))).select("root_table", "root_id", "payment_id")
    at = of("payments").select("root_table", "root_id", F.col("root_id").alias("payment_id")).unionByName(by_item)
    order = of("orders").select("root_table", "root_id", F.col("root_id").alias("order_id")).unionByName(at.join(pay.select("payment_id", "order_id"), "payment_id").select("root_table", "root_id", "order_id")).where("order_id is not null").distinct()
    # down
    first = order.join(l.orders.select("order_id"), "order_id", "left_semi").select(*_row(0, "orders", F.col("order_id"), "order"))
    paid = order.join(pay, "order_id")
    second = paid.select(*_row(1, "payments", F.col("payment_id"), "payment"))
    taken = paid.join(back, "payment_id")
    third = [taken.where(F.col("t") == t).select(*_row(2, t, F.col("item_id"), t[:-1])) for t in ("refunds", "chargebacks")]
    booked = paid.select("root_table", "root_id", F.col("sid").alias("settlement_id")).join(l.settlements.select("settlement_id"), "settlement_id", "left_semi").distinct()
    fourth = booked.select(*_row(3, "settlements", F.col("settlement_id"), "payout"))
    hops = bank_hops(l)
    fifth = booked.join(hops, "settlement_id").select(*_row(4, "bank", F.col("bank_row_id"), F.col("how")))
    # from payouts and bank rows
    named = links_by_narration(l).join(l.settlements.select("settlement_id", "ord"), "settlement_id").groupBy("bank_row_id").agg(F.min_by("settlement_id", F.struct("ord", "settlement_id")).alias("settlement_id"))
    rows = of("bank").join(l.bank.select(F.col("bank_row_id").cast("string").alias("root_id")), "root_id", "left_semi").join(named.withColumnRenamed("bank_row_id", "root_id"), "root_id", "left")
    payout = of("settlements").join(l.settlements.select(F.col("settlement_id").alias("root_id")), "root_id", "left_semi").select("root_table", "root_id", F.col("root_id").alias("settlement_id"))
    either = payout.unionByName(rows.where("settlement_id is not null").select("root_table", "root_id", "settlement_id"))
    inside = pay.where("sid is not null").groupBy(F.col("sid").alias("settlement_id")).agg(F.count("*").alias("np"), F.countDistinct("order_id").alias("no"))
    held = either.join(inside, "settlement_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sides = [
        either.select(*_row(0, "settlements", F.col("settlement_id"), "own_payout")),
        payout.join(hops, "settlement_id").select(*_row(1, "bank", F.col("bank_row_id"), F.col("how"))),
        rows.where("settlement_id is not null").select(*_row(1, "bank", F.col("root_id"), "bank")),
        held.select(*_row(2, "payments", F.lit(None), "members", zero("np"))), held.select(*_row(3, "orders", F.lit(None), "behind", zero("no"))),
        rows.where("settlement_id is null").select(*_row(0, "bank", F.col("root_id"), "own_bank")), rows.where("settlement_id is null").select(*_row(1, "settlements", F.lit(None), "unnamed")),
    ]
    out = first
    for part in [second, *third, fourth, fifth, *sides]:
        out = out.unionByName(part)
    return out


def every_row(l: Ledgers) -> DataFrame:
    """(root_table, root_id) of all rows of all ledgers."""
    return l.entries().select(F.col("source").alias("root_table"), F.col("entry_id").alias("root_id"))


def traced_chain(r, l: Ledgers) -> DataFrame:
    """(order_id, outcome, payment_id, settlement_id, bank_row_id, chain_breaks_at, tier, reason, caused_by) of each decided order.

    The chain breaks at the first ledger its decision has no row of; the reason is the latest tier's decline of the order.
    """
    from ledgerloom.operators.exceptions import merge_declines

    told = r.declines.where("kind = 'orders'")
    last = merge_declines(told).select(F.col("entity_id").alias("order_id"), F.col("reason").alias("declined_for"), "caused_by")
    tier = told.groupBy(F.col("entity_id").alias("order_id")).agg(F.max("tier").alias("declined_at"))
    broke = F.when(F.col("payment_id").isNull(), "gateway payment").when(F.col("settlement_id").isNull(), "payout").when(F.col("bank_row_id").isNull(), "bank credit")
    rows = r.decisions.select("order_id", "outcome", "payment_id", "settlement_id", "bank_row_id").join(last, "order_id", "left").join(tier, "order_id", "left")
    return rows.select("order_id", "outcome", "payment_id", "settlement_id", "bank_row_id", broke.alias("chain_breaks_at"), F.col("declined_at").alias("tier"), F.col("declined_for").alias("reason"), "caused_by")
