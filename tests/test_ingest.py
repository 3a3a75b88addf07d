from datetime import datetime
from decimal import Decimal

import pytest

from rewindle.streaming.ingest import RESCUED, EvolvingIngest, wider


def drop(folder, name, text):
    from pathlib import Path

    Path(folder, "landing").mkdir(parents=True, exist_ok=True)
    Path(folder, "landing", name).write_text(text)


def test_columns_come_widen_and_go(spark, folder, rows):
    ingest = EvolvingIngest(f"{folder}/table", f"{folder}/landing")
    drop(folder, "1.csv", "id,n\n1,5\n2,\n")
    ingest.follow(spark).awaitTermination()
    assert ingest.columns(spark) == [("id", "bigint", False), ("n", "bigint", False)]
    drop(folder, "2.csv", "N,at,id\n1.25,2024-01-01 10:00:00,3\n")
    drop(folder, "3.csv", "id,code\n4,007\n")
    ingest.follow(spark).awaitTermination()
    assert dict((n, k) for n, k, _ in ingest.columns(spark)) == {"id": "bigint", "n": "decimal(38,9)", "at": "timestamp_ntz", "code": "string"}
    assert rows(ingest.read(spark), "id", "n", "at", "code") == sorted(
        [(1, Decimal(5), None, None), (2, None, None, None), (3, Decimal("1.25"), datetime(2024, 1, 1, 10), None), (4, None, None, "007")], key=repr
    )
    drop(folder, "4.csv", "id,n\n1e9,many\n")
    ingest.follow(spark).awaitTermination()
    # Nothing is lost: what was a number reads as the text it was, and old batches keep their types.
    assert rows(ingest.read(spark), "id", "n") == sorted([("1", "5"), ("2", None), ("3", "1.25"), ("4", None), ("1e9", "many")], key=repr)
    assert rows(ingest.read(spark, 0), "id", "n") == [(1, 5), (2, None)]
    ingest.follow(spark).awaitTermination()
    assert ingest.read(spark).count() == 5


def test_given_types_stay_and_unfit_values_are_rescued(spark, folder, rows):
    ingest = EvolvingIngest(f"{folder}/table", f"{folder}/landing", {"ID": "int", "price": "decimal(5,2)"})
    drop(folder, "1.csv", 'id,price,note\n1,2.50,"a, ""b"""\nx,3000000,\n,,c\n')
    ingest.follow(spark).awaitTermination()
    assert [(n, k, g) for n, k, g in ingest.columns(spark)] == [("id", "int", True), ("price", "decimal(5,2)", True), ("note", "string", False)]
    got = {r.id: (r.price, r.note, r[RESCUED]) for r in ingest.read(spark).where("id = 1").collect()}
    assert got[1] == (Decimal("2.50"), 'a, "b"', None)
    unfit = [r[RESCUED] for r in ingest.read(spark).where("id IS NULL").collect()]
    assert sorted(unfit, key=repr) == sorted([{"id": "x", "price": "3000000"}, None], key=repr)


def test_a_repeated_batch_counts_once(spark, folder, rows):
    ingest = EvolvingIngest(f"{folder}/table", f"{folder}/landing")
    drop(folder, "1.csv", "a\n1\n")
    for _ in range(2):
        ingest.take(spark, [f"{folder}/landing/1.csv"], 0)
    assert rows(ingest.read(spark), "a") == [(1,)]
    # Rows whose columns were not recorded yet do not count.
    spark.createDataFrame([("9",)], "a string").write.parquet(f"{folder}/table/data/batch=1")
    assert rows(ingest.read(spark), "a") == [(1,)]
    assert EvolvingIngest(f"{folder}/none", f"{folder}/landing").read(spark).count() == 0


@pytest.mark.parametrize(("one", "two", "both"), [("bigint", None, "bigint"), (None, None, None), ("bigint", "decimal(38,9)", "decimal(38,9)"), ("bigint", "timestamp_ntz", "string"), ("string", "bigint", "string")])
def test_wider(one, two, both):
    assert wider(one, two) == wider(two, one) == both
