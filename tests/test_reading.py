"""Quantities, chains and streams against stated cases and plain statements of their rules."""

import pytest
from pyspark.sql import functions as F

from fathom.functions.quantities import Operand, calculate, read_quantity
from fathom.sources import trace


@pytest.mark.parametrize(
    "text, typed, want",
    [
        ("3 V", False, ("3", "V", None)),
        (" −3,5 kV ", False, ("-3.5", "kV", None)),
        ("3 uA", False, ("3", "µA", None)),
        ("0.125 m", False, ("0.125", "m", None)),
        ("1,020", False, (None, "", "ambiguous_decimal_separator")),
        ("1.020", True, ("1.020", "", None)),
        ("3 to 5 V", False, (None, "", "not_a_single_quantity")),
        ("3 mv", False, (None, "", "not_a_single_quantity")),
        ("1" * 25, False, (None, "", "numeric_value_limit")),
        ("1e99", False, (None, "", "numeric_value_limit")),
        ("1" + " " * 80, False, (None, "", "numeric_value_limit")),
        (None, False, (None, "", "numeric_value_limit")),
    ],
)
def test_read_quantity(text, typed, want):
    got = read_quantity(text, typed)
    assert (got.value if got.value is None else str(got.value), got.unit, got.refusal) == want


def cells(*texts, **more):
    return [Operand(str(n), t, **more) for n, t in enumerate(texts)]


def test_calculations():
    assert calculate("sum", cells("3 V", "20 mV")).value == "3.02"
    assert calculate("mean", cells("1 m", "50 cm")).value == "0.75"
    assert calculate("difference", cells("1 kV", "1 V")).value == "0.999"
    assert (calculate("ratio", cells("1 V", "3 V")).value, calculate("ratio", cells("1 V", "3 V")).unit) == ("0." + "3" * 40, "")
    got = calculate("convert", cells("25 °C"), "K")
    assert (got.value, got.unit, got.rounded) == ("298.15", "K", False)
    assert calculate("convert", cells("5"), "mV", Operand("u", "V")).value == "5000"


@pytest.mark.parametrize(
    "code, got",
    [
        ("unsupported_operation", calculate("power", cells("1"))),
        ("operand_count_limit", calculate("sum", [])),
        ("operand_count_limit", calculate("sum", cells(*["1"] * 65))),
        ("duplicate_operand", calculate("sum", [Operand("a", "1"), Operand("a", "2")])),
        ("operand_count_mismatch", calculate("ratio", cells("1"))),
        ("cell_operand_required", calculate("sum", cells("1", is_cell=False))),
        ("formula_cache_absent", calculate("sum", cells("1", formula=True, cached=False))),
        ("incomplete_operand", calculate("sum", cells(None))),
        ("nonnumeric_cell_type", calculate("sum", cells("1", kind="date"))),
        ("not_a_single_quantity", calculate("sum", cells("about 1"))),
        ("ambiguous_decimal_separator", calculate("sum", cells("1.000"))),
        ("numeric_value_limit", calculate("sum", cells("1e30"))),
        ("incompatible_units", calculate("sum", cells("1 V", "1 A"))),
        ("temperature_arithmetic_unsupported", calculate("sum", cells("1 °C", "1 K"))),
        ("division_by_zero", calculate("ratio", cells("1 V", "0 V"))),
        ("unit_missing", calculate("convert", cells("1"), "V")),
        ("unit_binding_operation", calculate("sum", cells("1"), None, Operand("u", "V"))),
        ("unit_cell_required", calculate("convert", cells("1"), "V", Operand("0", "V"))),
        ("unit_cell_scope_mismatch", calculate("convert", cells("1"), "V", Operand("u", "V", sheet=("other",)))),
        ("incomplete_unit", calculate("convert", cells("1"), "V", Operand("u", None))),
        ("unit_not_supported", calculate("convert", cells("1"), "V", Operand("u", "parsec"))),
        ("conflicting_source_units", calculate("convert", cells("1 A"), "V", Operand("u", "V"))),
        ("numeric_result_limit", calculate("ratio", cells("9e24 kV", "1e-24 V"))),
    ],
)
def test_refusals(code, got):
    assert got.refusal == code and got.value is None


def test_chain(spark):
    rows = spark.createDataFrame([(k, n, 10 * n + k, None if n == 3 else f"{k}:{n}") for k in (1, 2, 3) for n in range(1, 40)], "key long, at long, id long, payload string")
    chained = trace.chain(rows.repartition(5))
    found = {r.id: r.status for r in trace.verify(chained).collect()}
    assert len(found) == 117 and set(found.values()) == {"ok"}
    bad = chained.where("id <> 51").withColumn("payload", F.when(F.col("id") == 82, "other").otherwise(F.col("payload")))
    bad = bad.withColumn("previous_sha256", F.when(F.col("id") == 103, F.lit("0" * 64)).otherwise(F.col("previous_sha256")))
    assert {r.id: r.status for r in trace.verify(bad).collect() if r.status != "ok"} == {61: "chain_broken", 82: "payload_modified", 103: "event_modified"}
    assert trace.verify(trace.chain(rows.limit(0))).count() == 0


def test_streams_resume(spark, tmp_path):
    """A second call over the same files adds nothing; a new file alone is read."""
    from fathom.streaming import event_counts

    data = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(data)
    half = events.approxQuantile("event_id", [0.5], 0.0)[0]
    folder, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    events.where(F.col("event_id") <= half).coalesce(1).write.parquet(folder)
    first = {tuple(r) for r in event_counts(spark, folder, check, out).collect()}
    again = [tuple(r) for r in event_counts(spark, folder, check, out).collect()]
    assert first and len(again) == len(set(again)) and set(again) >= first
    events.where(F.col("event_id") > half).coalesce(1).write.mode("append").parquet(folder)
    last = [tuple(r) for r in event_counts(spark, folder, check, out).collect()]
    assert len(last) == len({r[:2] for r in last}) and set(last) >= set(again)
    late = events.withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r["start"], r.event_type): r.n for r in late.groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert all(want[r[:2]] >= r[2] for r in last)
