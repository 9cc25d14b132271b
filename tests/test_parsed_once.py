"""The written warehouse parses the email events once and scans them after that."""

from merchantry.workloads import queries, reports


def test_events_are_scanned_not_parsed_again(spark, small):
    house = reports.written(spark, small)
    df = house.table("stg_klaviyo__events")
    assert "from_json" not in df._jdf.queryExecution().analyzed().toString().lower()
    assert house.table("stg_klaviyo__events") is df
    view = queries.warehouse(spark, small).table("stg_klaviyo__events")
    assert df.dtypes == view.dtypes and df.count() > 0
    assert df.exceptAll(view).isEmpty() and view.exceptAll(df).isEmpty()
