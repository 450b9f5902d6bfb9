"""Replays of customers' calls over four tables: the state from orders, the calls from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import ledger as L
from sievework.plans.registry import query
from sievework.sources.readers import table

# Columns of the tables as SQL that both engines read.
_TRANSACTION = {"amount_cents": "CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE -1 END * CAST(floor(o_totalprice) AS BIGINT)", "description": "o_orderpriority", "disputed": "o_orderkey % 7 = 0", "posted_at": "CAST(o_orderdate AS {text})", "status": "o_orderstatus", "transaction_id": "concat('t', o_orderkey)"}
_TRANSFER = {"amount_cents": "CAST(floor(o_totalprice) AS BIGINT)", "created_at": "CAST(o_orderdate AS {text})", "recipient": "concat('Payee ', o_orderkey % 3)", "status": "CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'pending' END", "transfer_id": "concat('w', o_orderkey)"}
_CASE = {"case_id": "concat('c', o_orderkey)", "case_type": "'address_change'", "created_at": "CAST(o_orderdate AS {text})", "status": "'open'", "subject": "concat('Order ', o_orderkey)"}
_WANTED = {"transactions": "o_orderkey % 2 = 0", "transfers": "o_orderkey % 2 = 1", "service_cases": "o_orderkey % 5 = 0"}
_TOOL = "CASE event_id % 11 WHEN 0 THEN 'freeze_card' WHEN 1 THEN 'replace_card' WHEN 2 THEN 'dispute_transaction' WHEN 3 THEN 'cancel_transfer' WHEN 4 THEN 'list_cards' WHEN 5 THEN 'list_transactions' WHEN 6 THEN 'list_transfers' WHEN 7 THEN 'dispute_transaction' WHEN 8 THEN 'cancel_transfer' WHEN 9 THEN 'list_service_cases' ELSE 'close_account' END"
_CALL = {
    "last4": "CASE WHEN tool IN ('freeze_card', 'replace_card') AND k % 3 > 0 THEN CAST(1000 + k % 5 AS {text}) WHEN tool = 'list_cards' AND k % 7 = 0 THEN '1000' END",
    "transaction_id": "CASE WHEN tool = 'dispute_transaction' AND k % 4 IN (1, 3) THEN concat('t', k % 30 * 2) END",
    "description": "CASE WHEN tool = 'dispute_transaction' AND k % 4 > 1 THEN CASE k % 3 WHEN 0 THEN '1-urgent' WHEN 1 THEN '5-LOW' ELSE '2-High' END END",
    "transfer_id": "CASE WHEN tool = 'cancel_transfer' AND k % 5 = 1 THEN concat('w', k % 40) END",
    "recipient": "CASE WHEN tool = 'cancel_transfer' AND k % 5 IN (2, 1) AND k % 2 = 0 THEN concat('PAYEE ', k % 3) END",
    "limit": "CASE WHEN tool = 'list_transactions' AND k % 2 = 0 THEN k % 4 END",
}


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as calls in order."""
    told = table(spark, sf_dir, "events").withColumn("tool", F.expr(_TOOL)).withColumn("k", F.expr("CAST(floor(value * 7) AS BIGINT)"))
    call = F.struct("tool", *(F.expr(v.format(text="STRING")).alias(k) for k, v in _CALL.items())).cast(L.CALL)
    plans = told.groupBy(F.col("user_id").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("event_id", call.alias("call")))).alias("plan"))
    return plans.select("c_custkey", F.transform("plan", lambda p: p["call"]).alias("calls"))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``c_custkey, calls, r``: every customer's calls over the state that their orders give."""
    orders = table(spark, sf_dir, "orders")
    lists = {"transactions": (_TRANSACTION, L.TRANSACTION), "transfers": (_TRANSFER, L.TRANSFER), "service_cases": (_CASE, L.CASE)}
    items = [F.collect_list(F.when(F.expr(_WANTED[name]), F.struct("o_orderkey", F.struct(*(F.expr(v.format(text="STRING")).alias(k) for k, v in columns.items())).cast(kind).alias("x")))) for name, (columns, kind) in lists.items()]
    held = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(*(i.alias(k) for i, k in zip(items, lists, strict=True)))
    k = F.col("c_custkey")
    card = lambda n, status: F.struct(F.concat(F.lit(f"k{n}-"), k.cast("string")).alias("card_id"), (F.lit(1000 + n)).cast("string").alias("last4"), F.lit(("Gold", "Blue", "Cash")[n]).alias("name"), status.alias("status"))
    cards = F.array(card(0, F.when(k % 2 == 0, "frozen").otherwise("active")), card(1, F.lit("active")), card(2, F.when(k % 3 == 0, "closed").otherwise("active")))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(held, "c_custkey", "left").join(calls(spark, sf_dir), "c_custkey", "left")
    state = F.struct(cards.alias("cards"), *(F.transform(F.array_sort(name), lambda o: o["x"]).alias(name) for name in lists))
    return joined.select("c_custkey", "calls", L.replay(state, F.col("calls")).alias("r"))


def _pack(columns: dict[str, str]) -> str:
    return "{" + ", ".join(f"'{k}': {v.format(text='VARCHAR')}" for k, v in columns.items()) + "}"


def _newest(items: str, at: str) -> str:
    return f"list_transform(list_reverse_sort(list_transform(list_zip({items}, range(len({items}))), lambda z: {{'at': z[1].{at}, 'i': -z[2], 'x': z[1]}})), lambda o: o.x)"


def _places(items: str, test: str) -> str:
    return f"list_filter(range(len({items})), lambda i: {test.replace('@', items + '[i + 1]')})"


_OPEN, _PENDING = "@.amount_cents < 0 AND NOT @.disputed", "@.status = 'pending'"
_LATEST = "list_transform(list_reverse_sort(list_transform({places}, lambda i: {{{{'at': {items}[i + 1].{at}, 'i': -i}}}})), lambda o: -o.i)[1]"
_CHOSEN = f"""CASE WHEN last4 IS NULL THEN coalesce({_places('cards', "@.status = 'active'")}[1], 0) ELSE {_places('cards', '@.last4 = last4')}[1] END AS at_card,
 CASE WHEN description IS NOT NULL THEN CASE WHEN len({_places('transactions', _OPEN + ' AND lower(@.description) = lower(description)')}) = 1 THEN {_places('transactions', _OPEN + ' AND lower(@.description) = lower(description)')}[1] END
  WHEN transaction_id IS NOT NULL THEN {_places('transactions', '@.transaction_id = transaction_id')}[1] ELSE {_LATEST.format(places=_places('transactions', _OPEN), items='transactions', at='posted_at').replace('{{', '{').replace('}}', '}')} END AS at_debit,
 CASE WHEN recipient IS NOT NULL THEN CASE WHEN len({_places('transfers', _PENDING + ' AND lower(@.recipient) = lower(recipient)')}) = 1 THEN {_places('transfers', _PENDING + ' AND lower(@.recipient) = lower(recipient)')}[1] END
  WHEN transfer_id IS NOT NULL THEN {_places('transfers', _PENDING + ' AND @.transfer_id = transfer_id')}[1] ELSE {_LATEST.format(places=_places('transfers', _PENDING), items='transfers', at='created_at').replace('{{', '{').replace('}}', '}')} END AS at_transfer"""
_TAKES = " ".join(f"WHEN '{t}' THEN {list(names)}::VARCHAR[]" for t, names in L.ARGUMENTS.items())
_GIVEN = "list_filter([" + ", ".join(f"CASE WHEN {a if a != 'limit' else 'c_limit'} IS NOT NULL THEN '{a}' END" for a in _CALL) + "], lambda a: a IS NOT NULL)"
_PROBLEM = f"""CASE WHEN CASE tool {_TAKES} END IS NULL OR len(list_filter({_GIVEN}, lambda a: NOT list_contains(CASE tool {_TAKES} END, a))) > 0 THEN '{L.NOT_SUPPORTED}'
 WHEN tool = 'dispute_transaction' AND description IS NOT NULL AND transaction_id IS NOT NULL OR tool = 'cancel_transfer' AND recipient IS NOT NULL AND transfer_id IS NOT NULL THEN '{L.NOT_COMPLETED}'
 WHEN tool IN ('freeze_card', 'replace_card') AND at_card IS NULL OR tool = 'dispute_transaction' AND at_debit IS NULL OR tool = 'cancel_transfer' AND at_transfer IS NULL THEN '{L.NO_MATCH}' END AS problem"""


def _changed(items: str, fields: list[str], at: str, **new: str) -> str:
    made = "{" + ", ".join(f"'{f}': {new.get(f, items + '[i + 1].' + f)}" for f in fields) + "}"
    return f"list_transform(range(len({items})), lambda i: CASE WHEN i = {at} THEN {made} ELSE {items}[i + 1] END)"


_CARDS = ["card_id", "last4", "name", "status"]
_STATUS = "CASE tool WHEN 'freeze_card' THEN 'frozen' ELSE 'replacement_pending' END"
_NEXT = f"""SELECT c, n + 1 AS n, tool, problem, c_limit, CASE WHEN problem IS NULL AND tool IN ('freeze_card', 'replace_card') THEN {_changed('cards', _CARDS, 'at_card', status=_STATUS)} ELSE cards END AS cards,
 CASE WHEN problem IS NULL AND tool = 'dispute_transaction' THEN {_changed('transactions', list(_TRANSACTION), 'at_debit', disputed='true')} ELSE transactions END AS transactions,
 CASE WHEN problem IS NULL AND tool = 'cancel_transfer' THEN {_changed('transfers', list(_TRANSFER), 'at_transfer', status="'cancelled'")} ELSE transfers END AS transfers, service_cases,
 CASE WHEN problem IS NULL AND tool IN ('freeze_card', 'replace_card', 'dispute_transaction') THEN list_append(made, {{'case_id': 'generated_case_' || lpad((len(made) + 1)::VARCHAR, 3, '0'), 'case_type': CASE tool WHEN 'freeze_card' THEN 'stolen_card' WHEN 'replace_card' THEN 'replacement_card' ELSE 'transaction_dispute' END, 'created_at': 'generated-timestamp', 'status': 'open',
  'subject': CASE tool WHEN 'freeze_card' THEN 'Stolen Card for card ending ' || cards[at_card + 1].last4 WHEN 'replace_card' THEN 'Replacement Card for card ending ' || cards[at_card + 1].last4 ELSE 'Dispute ' || transactions[at_debit + 1].description || ' (' || transactions[at_debit + 1].transaction_id || ')' END}}) ELSE made END AS made, at_card, at_debit, at_transfer, envelopes FROM judged"""
_SORTED_CARDS = "list_transform(list_sort(list_transform(list_zip(cards, range(len(cards))), lambda z: {'name': z[1].name, 'i': z[2], 'c': z[1]})), lambda o: o.c)"
_RESULT = f"""CASE WHEN problem IS NOT NULL THEN NULL WHEN tool IN ('freeze_card', 'replace_card') THEN to_json(cards[at_card + 1]) WHEN tool = 'dispute_transaction' THEN to_json(transactions[at_debit + 1]) WHEN tool = 'cancel_transfer' THEN to_json(transfers[at_transfer + 1]) WHEN tool = 'list_cards' THEN to_json({_SORTED_CARDS})
 WHEN tool = 'list_transactions' THEN to_json(list_slice({_newest('transactions', 'posted_at')}, 1, coalesce(c_limit, 5))) WHEN tool = 'list_transfers' THEN to_json({_newest('transfers', 'created_at')}) WHEN tool = 'list_service_cases' THEN to_json(list_concat(made, {_newest('service_cases', 'created_at')})) END::VARCHAR"""
_STATES = f"""WITH RECURSIVE plan AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, tool, {', '.join(f"{v.format(text='VARCHAR')} AS {'c_limit' if k == 'limit' else k}" for k, v in _CALL.items())} FROM (SELECT *, {_TOOL} AS tool, CAST(floor(value * 7) AS BIGINT) AS k FROM events)),
 held AS (SELECT o_custkey, {', '.join(f"list({_pack(c)} ORDER BY o_orderkey) FILTER ({_WANTED[k]}) AS {k}" for k, c in (('transactions', _TRANSACTION), ('transfers', _TRANSFER), ('service_cases', _CASE)))} FROM orders GROUP BY o_custkey),
 walk AS (
  SELECT c_custkey AS c, 0::BIGINT AS n, [{{'card_id': 'k0-' || c_custkey, 'last4': '1000', 'name': 'Gold', 'status': CASE WHEN c_custkey % 2 = 0 THEN 'frozen' ELSE 'active' END}}, {{'card_id': 'k1-' || c_custkey, 'last4': '1001', 'name': 'Blue', 'status': 'active'}}, {{'card_id': 'k2-' || c_custkey, 'last4': '1002', 'name': 'Cash', 'status': CASE WHEN c_custkey % 3 = 0 THEN 'closed' ELSE 'active' END}}] AS cards,
   coalesce(transactions, []) AS transactions, coalesce(transfers, []) AS transfers, coalesce(service_cases, []) AS service_cases, CAST([] AS STRUCT(case_id VARCHAR, case_type VARCHAR, created_at VARCHAR, status VARCHAR, subject VARCHAR)[]) AS made, CAST([] AS STRUCT(tool VARCHAR, ok BOOLEAN, result VARCHAR, code VARCHAR, message VARCHAR)[]) AS envelopes
  FROM customer LEFT JOIN held ON o_custkey = c_custkey
  UNION ALL
  SELECT c, n, cards, transactions, transfers, service_cases, made, list_append(envelopes, {{'tool': tool, 'ok': problem IS NULL, 'result': {_RESULT}, 'code': CASE WHEN problem IS NOT NULL THEN 'backend_error' END, 'message': problem}}) FROM (
   {_NEXT.replace('FROM judged', f'FROM (SELECT *, {_PROBLEM} FROM (SELECT w.*, p.* EXCLUDE (user_id, i), {_CHOSEN} FROM walk w JOIN plan p ON p.user_id = w.c AND p.i = w.n + 1))')})
 ), ended AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC) = 1)"""
_SNAPSHOT = f"to_json({{'cards': {_SORTED_CARDS}, 'service_cases': list_concat(made, {_newest('service_cases', 'created_at')}), 'transactions': list_slice({_newest('transactions', 'posted_at')}, 1, 10), 'transfers': {_newest('transfers', 'created_at')}}})::VARCHAR"


@query(f"{_STATES} SELECT c AS c_custkey, n AS n_calls, len(list_filter(envelopes, lambda e: e.ok))::BIGINT AS n_ok, len(made)::BIGINT AS n_cases, CASE WHEN n > 0 THEN 'sha256:' || sha256({_SNAPSHOT}) END AS state_hash FROM ended")
def q_ledger_replay(spark, sf_dir):
    """Final states of all customers after their calls, as digests of canonical JSON."""
    r = F.col("r")
    shown = replayed(spark, sf_dir)
    return shown.select("c_custkey", F.size(r["envelopes"]).cast("bigint").alias("n_calls"), F.size(F.filter(r["envelopes"], lambda e: e["ok"])).cast("bigint").alias("n_ok"), F.size(r["made"]).cast("bigint").alias("n_cases"), L.state_hash(r, F.col("calls")).alias("state_hash"))


@query(f"{_STATES} SELECT c AS c_custkey, (j - 1)::INTEGER AS call_no, envelopes[j].tool AS tool, envelopes[j].ok AS ok, envelopes[j].result AS result, envelopes[j].message AS message FROM (SELECT c, envelopes, unnest(range(1, len(envelopes) + 1)) AS j FROM ended)")
def q_ledger_envelopes(spark, sf_dir):
    """The envelope of every call: what it returned or changed, or why it failed."""
    each = replayed(spark, sf_dir).select("c_custkey", F.posexplode("r.envelopes").alias("call_no", "e"))
    return each.select("c_custkey", "call_no", "e.tool", "e.ok", "e.result", "e.message")


_BUNDLE = "CASE c_custkey % 5 WHEN 0 THEN {open}'list_cards', 'list_transfers'{shut} WHEN 1 THEN {open}'list_service_cases', 'list_transactions', 'list_cards'{shut} WHEN 2 THEN {open}'list_cards', 'freeze_card'{shut} WHEN 3 THEN CAST({open}{shut} AS {none}) ELSE {open}'list_transfers', 'list_transfers'{shut} END"
_ANSWERS = {"list_cards": f"to_json({_SORTED_CARDS})", "list_transactions": f"to_json(list_slice({_newest('transactions', 'posted_at')}, 1, 5))", "list_transfers": f"to_json({_newest('transfers', 'created_at')})", "list_service_cases": f"to_json(list_concat(made, {_newest('service_cases', 'created_at')}))"}


@query(f"""{_STATES}, b AS (SELECT *, c AS c_custkey, {_BUNDLE.format(open='[', shut=']', none='VARCHAR[]').replace('c_custkey', 'c')} AS tools FROM ended), p AS (SELECT *, CASE WHEN len(tools) = 0 THEN 'empty_bundle' WHEN len(list_filter(tools, lambda t: NOT starts_with(t, 'list_'))) > 0 THEN 'not_a_read' END AS problem FROM b)
 SELECT c_custkey, problem, CASE WHEN problem IS NULL THEN array_to_string(list_filter([{", ".join(f"CASE WHEN list_contains(tools, '{t}') THEN '{t}=' || ({a})::VARCHAR END" for t, a in sorted(_ANSWERS.items()))}], lambda x: x IS NOT NULL), ';') ELSE '' END AS results FROM p""")
def q_read_bundles(spark, sf_dir):
    """Bundles of reads over one state of each customer, after their calls; a bundle that would write is refused."""
    tools = F.expr(_BUNDLE.format(open="array(", shut=")", none="array<string>"))
    read = replayed(spark, sf_dir).select("c_custkey", L.read_bundle(F.col("r"), tools).alias("b"))
    lines = F.transform(F.array_sort(F.map_entries("b.results")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return read.select("c_custkey", "b.problem", F.coalesce(F.array_join(lines, ";"), F.lit("")).alias("results"))
