"""Pages from clustered history against a sorted list, and what is read for them."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import keyset

NONE = "address string, from_ledger long, to_ledger long"


def _table(spark, tmp_path, rows, runs=1, parts=12):
    table = keyset.history(spark, f"file://{tmp_path}/history")
    df = spark.createDataFrame(rows, "address string, ledger_index long, hash string, tx_type string")
    for run in range(runs):
        table.append(df.filter(F.col("ledger_index") % runs == run), run, parts)
    return table


def _pages(spark, table, asked):
    requests = spark.createDataFrame(asked, "request_id long, address string, low long, high long, forward boolean, limit int, marker string")
    accounts = spark.createDataFrame([("rBusy",), ("rQuiet",), ("rNew",)], "address string")
    got = {}
    for r in keyset.account_pages(requests, table, spark.createDataFrame([], NONE), accounts).collect():
        got.setdefault(r.request_id, []).append((r.rank, r.status, r.ledger_index, r.hash, r.next_marker))
    return {i: sorted(x, key=lambda y: (y[0] or 0)) for i, x in got.items()}


def test_pages_in_both_directions(spark, tmp_path):
    rng = random.Random(3)
    rows = [("rBusy", rng.randrange(400), f"h{i:05}", "Payment") for i in range(3000)] + [("rQuiet", i * 50, f"q{i}", "Payment") for i in range(5)]
    table = _table(spark, tmp_path, rows, runs=2)
    # A batch that comes again, and one whose rows are there already, change nothing.
    again = spark.createDataFrame(rows[::2], "address string, ledger_index long, hash string, tx_type string")
    table.append(again, 2, 5)
    table.append(again, 2, 5)
    asked = []
    for i in range(40):
        at = rng.choice(rows)
        low, high = (rng.randrange(300), 300 + rng.randrange(100)) if i % 3 == 0 else (-1, -1)
        marker = [None, f"{at[1]}:{at[2]}", "bad", f"{rng.randrange(500)}:h"][i % 4]
        asked.append((i, "rQuiet" if i % 10 == 9 else "rBusy", low, high, i % 2 == 0, rng.choice([1, 7, 200, 400]), marker))
    asked += [(98, "rNew", -1, -1, True, 5, None), (99, "rNobody", -1, -1, True, 5, None)]
    got = _pages(spark, table, asked)
    assert got[98] == [(None, "success", None, None, None)] and got[99] == [(None, "notInArchive", None, None, None)]
    for i, who, low, high, forward, limit, marker in asked[:-2]:
        own = sorted(((x[1], x[2]) for x in rows if x[0] == who and (low < 0 or low <= x[1] <= high)), reverse=not forward)
        if marker and ":" in marker:
            at = (int(marker.split(":")[0]), marker.split(":")[1])
            own = [x for x in own if (x > at if forward else x < at)]
        want = [(n + 1, "success", *x, f"{x[0]}:{x[1]}" if n + 1 == limit and len(own) > limit else None) for n, x in enumerate(own[:limit])]
        assert got[i] == (want or [(None, "success", None, None, None)]), (i, who, low, high, forward, limit, marker)


def test_parts_read_do_not_grow_with_history(spark, tmp_path):
    read = {}
    for n, parts in ((2_000, 10), (20_000, 100)):
        table = _table(spark, tmp_path / str(n), [("rBusy", i, f"h{i:06}", "Payment") for i in range(n)], parts=parts)
        one = spark.createDataFrame([(1, "rBusy", f"h{n // 2:06}", n // 2, True), (2, "rBusy", f"h{n // 2:06}", n // 2, False)], "request_id long, address string, hash string, l long, forward boolean")
        asked = one.select("request_id", "address", F.struct(F.col("l").alias("ledger_index"), "hash").alias("after"), "forward", F.lit(150).alias("page"))
        chosen = table.chosen(asked)
        read[n] = chosen.count()
        assert len({f for f in table.seek(chosen).inputFiles() if "/rows/" in f}) <= read[n]
    assert read[20_000] <= read[2_000] + 2 <= 8


def test_empty_and_compacted(spark, tmp_path):
    table = _table(spark, tmp_path / "a", [("rBusy", i, f"h{i}", None) for i in range(50)], runs=3, parts=2)
    whole = keyset.history(spark, f"file://{tmp_path}/b")
    table.compact(whole, 4)
    asked = [(1, "rBusy", -1, -1, False, 10, None), (2, "rQuiet", -1, -1, True, 10, None)]
    assert _pages(spark, table, asked) == _pages(spark, whole, asked) and whole.rows().count() == 50
    nothing = _table(spark, tmp_path / "c", [])
    assert _pages(spark, nothing, asked) == {i: [(None, "success", None, None, None)] for i in (1, 2)}
