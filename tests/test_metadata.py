from types import SimpleNamespace

from slotwise.plans import evidence


def test_all_errors_are_written(spark):
    made = lambda schema, rows=(): spark.createDataFrame(list(rows), schema)
    result = SimpleNamespace(
        coverage=made("files long", [(1,)]), periods=made("scope string, start_us long, end_us long"), slots=made("slot string"),
        files=made("family string, scope string, cpu string, path string"), diagnostics=made("message string", [(f"e{i:04}",) for i in range(1203)]),
    )
    assert evidence.metadata_document(result)["errors"] == [{"message": f"e{i:04}"} for i in range(1203)]
