"""Findings of round 3, on small tables."""

import json
import os
import random
import re
from decimal import Context, Decimal

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ledgerloom.functions import exact
from ledgerloom.operators import discovery, keyset, nodes, reconcile, rejects
from ledgerloom.plans import registry
from ledgerloom.sources.driver_tables import DriverTables
from ledgerloom.streaming import ingest, kept

SF = "/root/testdata/sf0.001"


def test_orders_of_a_ledger_beyond_a_million(spark, tmp_path):
    """a ledger's transactions on both sides of order 1,000,000 keep their order in the state that is reconciled."""
    for name in ("nation", "supplier", "lineitem"):
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    orders = pq.read_table(f"{SF}/orders.parquet").to_pandas()
    keys = 999_250 + orders["o_orderkey"]
    orders["o_orderkey"], orders["o_orderdate"] = keys, orders["o_orderdate"].dt.to_period("Y").dt.to_timestamp()
    pq.write_table(pa.Table.from_pandas(orders, preserve_index=False).cast(pq.read_schema(f"{SF}/orders.parquet").remove_metadata()), tmp_path / "orders.parquet")
    lines = pq.read_table(f"{SF}/lineitem.parquet").to_pandas()
    os.unlink(tmp_path / "lineitem.parquet")
    lines["l_orderkey"] += 999_250
    pq.write_table(pa.Table.from_pandas(lines, preserve_index=False).cast(pq.read_schema(f"{SF}/lineitem.parquet").remove_metadata()), tmp_path / "lineitem.parquet")
    got = registry.queries()["rec1_reconcile"](spark, str(tmp_path)).collect()
    assert len(got) == 25 and all(r["passed"] and r["discrepancies"] == 0 for r in got)


def test_sampled_account_without_movement(spark):
    """F8: who has no balance has 0, also where the table's texts stand beside its decimals."""
    ours = spark.createDataFrame([(1, "a", None, Decimal(0)), (1, "b", "2.5", Decimal(2))], "issuance_id long, address string, balance_text string, balance decimal(38,18)")
    theirs = spark.createDataFrame([(1, "b", "2.5")], "issuance_id long, address string, balance string")
    assert [tuple(r) for r in reconcile.totals(ours, theirs.withColumn("balance", F.col("balance").cast("decimal(38,18)"))).collect()] == [(1, 2, 0)]


def test_healing_sends_the_gaps(spark):
    """history isn't shuffled by bucket to meet the gaps."""
    gaps = spark.createDataFrame([(1, 5), (4, 9)], "from_ledger long, to_ledger long")
    history = spark.range(20).select(F.col("id").alias("ledger_index"), F.lit("x").alias("meta_json")).repartition(3)
    healed = ingest.heal(gaps, history)
    plan = healed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted(r["ledger_index"] for r in healed.collect()) == list(range(1, 10))


def _parses(frame) -> int:
    return frame._jdf.queryExecution().optimizedPlan().toString().count("from_json(")


def test_documents_are_read_once(spark):
    """Neither flattening nor rejects read a document in a filter and again behind it."""
    docs = spark.range(3).select(F.col("id").cast("string").alias("hash"), F.col("id").alias("ledger_index"), F.uuid().alias("meta_json"))
    assert _parses(nodes.flatten(docs)) == 1
    # Once in the filter, and once for the few that it leaves.
    assert _parses(docs.filter(rejects.reason("meta_json").isNotNull()).select("hash")) == 1


def test_kept_tables_are_narrow(spark):
    """Texts of documents are spelt as they are read and not cached."""
    t = DriverTables(spark, SF)
    t.documents_of_metadata()
    assert "meta_json" not in t._told().columns
    assert "hash" not in t._moved().columns


def test_short_and_long_amounts_of_one_key(spark):
    """nodes.deltas: decimals and limbs of one account in one transaction come together, exactly; what is no number is unknown."""
    rows = [
        ("h1", "ModifiedNode", "2.5", "1"), ("h1", "ModifiedNode", "1e30", "0"), ("h1", "CreatedNode", "1e-40", None),
        ("h2", "ModifiedNode", "1e-3", "0.5"), ("h2", "ModifiedNode", "0.5", "1e-3"), ("h3", "CreatedNode", "x", None),
        ("h4", "DeletedNode", "999999999.000000000000000001", None), ("h5", "CreatedNode", "12345678901234567890", None), ("h6", "CreatedNode", "100", None),
    ]
    v = spark.createDataFrame([(h, 1, "a", 7, k, a, b) for h, k, a, b in rows], "hash string, ledger_index long, address string, issuance_id long, node_kind string, amount_text string, before_text string")
    want = {
        "h1": "1000000000000000000000000000001.5" + "0" * 38 + "1", "h3": None, "h4": "-999999999.000000000000000001", "h5": "12345678901234567890", "h6": "100",
    }
    for versions in (v, v.withColumns({"amount": exact.decimal("amount_text"), "before": exact.decimal("before_text")})):
        got = {r["hash"]: r for r in nodes.deltas(versions).collect()}
        assert {h: r["delta_text"] for h, r in got.items()} == want
        assert got["h6"]["delta"] == 100 and str(got["h4"]["delta"]) == want["h4"] and got["h5"]["delta"] is None


def test_batches_leave_no_staged_files(spark, tmp_path):
    """a batch's documents lie in compressed files and are gone after it."""
    t, tables = DriverTables(spark, SF), ingest.Tables(spark, str(tmp_path))
    ingest.ingest_batch(tables, t.issuances(), ingest._as_events(t.documents_of_metadata().filter("ledger_index < 300")), 1)
    assert not os.listdir(tmp_path / "staged")
    assert tables.log("balance_deltas", ingest.SCHEMAS["balance_deltas"]).count() > 0


def test_pages_are_chosen_once(spark, tmp_path):
    """what names the parts of a page isn't worked out again for the join with their rows."""
    table = keyset.history(spark, str(tmp_path))
    table.append(spark.createDataFrame([("a", i, f"h{i}", "Payment") for i in range(9)], keyset.HISTORY), 0, 3)
    asked = spark.createDataFrame([("r", "a")], "request_id string, address string").withColumns(
        {"after": F.lit(None).cast("struct<ledger_index:long,hash:string>"), "forward": F.lit(True), "page": F.lit(2)}
    )
    rows = table.seek(table.chosen(asked))
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {"h0", "h1", "h2"} <= {r["hash"] for r in rows.collect()}


def _leaves(frame) -> set:
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    return {leaves.apply(i).nodeName() for i in range(leaves.size())}


def test_sides_of_digests_are_worked_out_once(spark):
    """neither side is made again for its digests and for its rows."""
    side = lambda more: spark.range(40).select((F.col("id") % 2).alias("issuance_id"), F.concat(F.lit("r"), "id").alias("address"), F.concat((F.col("id") * more).cast("string"), F.lit(".50")).alias("balance"))
    found = reconcile.compare_suspects(side(1), side(2), ranges=4)
    assert _leaves(found) == {"InMemoryRelation"}
    assert sorted(r["left_text"] for r in found.collect()) == sorted(f"{n}.5" for n in range(1, 40))


def test_canonical_texts_by_both_ways(spark):
    """a text that only has to be trimmed is told as the general parser tells it."""
    texts = ["0", "-0", "-0.000", "0.50", "-12.340", "007", ".5", "5.", "1e3", "+4", " 7.0 ", "x", "", "1.", "100", "-100.0", "9" * 28 + "." + "9" * 28, "1" * 29, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact.canonical("t").alias("a"), exact.canonical(F.col("t")).alias("b"), exact.text(exact.number("t")).alias("c"))
    assert all(r["a"] == r["b"] == r["c"] for r in rows.collect())


def test_long_and_short_amounts_of_one_key(spark):
    """a key's long amounts are summed with its short ones, what is no number makes the delta unknown, and nothing is left out."""
    rows = [("A", "1e30", "5"), ("A", "2.5", "1"), ("B", "1e30", "1e30"), ("C", "x", "1"), ("C", "2", "1"), ("D", "3", "3"), ("E", "1.25", None)]
    versions = spark.createDataFrame([(h, 1, "r", 7, "ModifiedNode" if b else "CreatedNode", a, b) for h, a, b in rows], "hash string, ledger_index long, address string, issuance_id long, node_kind string, amount_text string, before_text string")
    got = nodes.deltas(versions)
    assert {r["hash"]: r["delta_text"] for r in got.collect()} == {"A": "999999999999999999999999999996.5", "C": None, "E": "1.25"}
    # No sums of limbs are shuffled.
    assert "l9" not in got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[-1].split("\n")[0]


def test_steps_are_compiled(spark):
    """No step of the versions is a method that the JVM refuses to compile (over 8000 bytes)."""


    docs = spark.range(3).select(F.col("id").cast("string").alias("hash"), F.col("id").alias("ledger_index"), F.uuid().alias("meta_json"))
    issuances = DriverTables(spark, SF).issuances()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = nodes.versions(nodes.flatten(docs), issuances)._jdf.queryExecution()
        told = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", told))) < 8000


def test_edges_are_worked_out_once(spark):
    """however many rounds a closure takes, its edges are made once, and nobody is lost at a checkpoint."""
    made = spark.sparkContext.accumulator(0)

    def told(rows):
        made.add(1)
        return rows

    chain = [(f"a{i}", f"a{i + 1}", 100 - i) for i in range(9)] + [("a9", "a2", 7), ("b", "a1", 1)]
    edges = spark.createDataFrame(spark.sparkContext.parallelize(chain, 2).mapPartitions(told), "account string, party string, ledger_index long")
    seeds = spark.createDataFrame([("g", "a0"), ("h", "a8")], "group string, address string")
    got = {(r["group"], r["address"]): r["ledger"] for r in discovery.closure(edges, seeds, checkpoint_every=3).collect()}
    assert got == {("g", "a0"): None, **{("g", f"a{i}"): 7 if i == 2 else 101 - i for i in range(1, 10)}, **{("h", f"a{i}"): 7 if i == 2 else 101 - i for i in range(2, 10)}}
    assert made.value == 2


def _nodes_of(plan: str, name: str) -> int:
    return len(re.findall(rf"(?m)^[\s:+*()0-9-]*{name}\b", plan))


def test_parties_read_documents_once(spark):
    """owners of tokens and of lines come from one pass, with the same rows as from one pass each."""
    docs = spark.range(3).select(F.col("id").cast("string").alias("hash"), F.col("id").alias("ledger_index"), F.uuid().alias("meta_json"))
    assert _parses(nodes.owners(nodes.flatten(docs))) == 1
    entry = lambda kind, **fields: {"ModifiedNode": {"LedgerEntryType": kind, "LedgerIndex": "x", "FinalFields": fields}}
    line = {"LowLimit": {"issuer": "low", "value": "0"}, "HighLimit": {"issuer": "high", "value": "0"}}
    told = [entry("MPToken", Account="a"), entry("AccountRoot", Account="b"), entry("RippleState", **line, Account="c"), entry("RippleState", LowLimit=line["LowLimit"]), entry("Offer", Account="d"), entry("MPToken")]
    rows = spark.createDataFrame([("h", 1, json.dumps({"AffectedNodes": told}))], "hash string, ledger_index long, meta_json string")
    assert sorted(r["address"] for r in nodes.owners(nodes.flatten(rows)).collect()) == ["a", "b", "high", "low", "low"]


def test_documents_are_spelt_row_by_row(spark):
    """versions are spelt outside functions of arrays, which aren't compiled; a condition on the ledger is applied before."""
    plan = DriverTables(spark, SF).documents_of_metadata().filter("ledger_index > 2390")._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("InMemoryRelation")[0]
    assert "lambda" not in above and above.index("Filter") > above.index("Aggregate")


def test_versions_come_from_one_window(spark):
    """a customer's versions are worked out in one pass over one order."""
    t = DriverTables(spark, SF)
    plan = t.nodes()._jdf.queryExecution().optimizedPlan().toString()
    assert _nodes_of(plan.split("InMemoryRelation")[0], "Window") == 1


def test_batches_add_to_large_buckets(spark, tmp_path):
    """a batch doesn't rewrite what large buckets hold; readers see the newest of a few generations, whatever came twice or late."""
    table = kept.ObjectState(ingest.Tables(spark, str(tmp_path / "t")), buckets=2, small=0, runs=4)

    def batch(ledger, *objects):
        rows = [(o, f"H{ledger}", ledger, 0, "ModifiedNode", "MPToken", o == "o9", 4, "rI", "r" + o, f"{ledger}.5", None, 0) for o in objects]
        return spark.createDataFrame(rows, kept.VERSIONS)

    every = [f"o{i}" for i in range(20)]
    assert table.apply(batch(5, *every)) == [0, 1]
    # A batch that failed before its commit left files; the next one of this number doesn't count them.
    table._write(batch(99, *every), 2)
    (bucket,) = table.apply(batch(7, "o1"))
    assert table.apply(batch(6, "o1")) == table.apply(batch(7, "o1")) == [bucket]
    # The fourth generation of a bucket made one of all.
    assert sorted((r.bucket == bucket, r.generation) for r in table.commits().collect()) == [(False, 1), (True, 5)]
    table.apply(batch(8, "o1"))
    last = {(r.bucket == bucket, r.generation): r.n for r in table.commits().collect()}
    assert set(last) == {(False, 1), (True, 5), (True, 6)} and last[True, 6] == 1 and last[True, 5] + last[False, 1] == 20
    table.clean()
    got = {r.object_id: r for r in table.rows().collect()}
    assert {o: r.ledger_index for o, r in got.items()} == {o: 8 if o == "o1" else 5 for o in every}
    assert got["o1"].amount == Decimal("8.5") and got["o1"].before is None and got["o9"].deleted
    assert table.parity(batch(5, *every).union(batch(8, "o1"))).collect() == []


def test_long_amounts_are_summed_in_compiled_steps(spark):
    """F16: long amounts are parsed, subtracted, summed and told without functions of arrays, exactly, whatever their spelling."""
    rng, wide = random.Random(16), Context(prec=400)

    def spelt():
        digits = "".join(rng.choice("0123456789") for _ in range(rng.choice([1, 3, 19, 28, 40]))) + rng.choice(["", "00"])
        point = rng.choice([None, 0, 1, len(digits) - 1, len(digits)])
        body = digits if point is None else f"{digits[:point]}.{digits[point:]}"
        return rng.choice(["", "-", "+"]) + body + rng.choice(["", "", f"e{rng.randrange(-90, 41)}", f"E+{rng.randrange(20, 41)}", "e-20"])

    def told(n):
        plain = f"{n:f}"
        plain = plain.rstrip("0").rstrip(".") if "." in plain else plain
        return "0" if n == 0 else plain

    rows = [(k, spelt()) for k in range(60) for _ in range(rng.choice([1, 1, 2, 5]))]
    odd = ["x", "", "1e", "e5", ".", "1e99", "0e999", "-0", " 7.50 ", None]
    texts = spark.createDataFrame([*rows, *((100 + i, t) for i, t in enumerate(odd))], "k int, t string")
    out = exact.exact_sum(texts, ["k"], "t")
    got, want = {r["k"]: r["total"] for r in out.collect()}, {}
    for k, t in rows:
        want[k] = wide.add(want.get(k, Decimal(0)), wide.create_decimal(t))
    assert {k: v for k, v in got.items() if k < 100} == {k: told(v) for k, v in want.items()}
    single = {r["k"]: r["x"] for r in texts.filter("k >= 100 and t is not null").select("k", exact.text(exact.number("t")).alias("x")).collect()}
    assert {k: v for k, v in got.items() if k >= 100} == single
    assert "lambda q" not in out._jdf.queryExecution().optimizedPlan().toString()
    pairs = [(f"h{i}", "ModifiedNode", spelt(), spelt()) for i in range(80)] + [("h1", "CreatedNode", "1e40", None), ("h2", "DeletedNode", spelt(), None), ("h3", "CreatedNode", None, None)]
    v = spark.createDataFrame([(h, 1, "a", 7, k, a, b) for h, k, a, b in pairs], "hash string, ledger_index long, address string, issuance_id long, node_kind string, amount_text string, before_text string")
    want = {}
    for h, k, a, b in pairs:
        a, b = (wide.create_decimal(x or "0") for x in (a, b))
        want[h] = wide.add(want.get(h, Decimal(0)), -a if k == "DeletedNode" else wide.subtract(a, b))
    want = {h: told(n) for h, n in want.items() if n}
    for versions in (v, v.withColumns({"amount": exact.decimal("amount_text"), "before": exact.decimal("before_text")})):
        assert {r["hash"]: r["delta_text"] for r in nodes.deltas(versions).collect()} == want
