from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shopmetrics.operators import annotations as a

REQUEST = "date date, title string, description string, category string, created_by string"


def test_list_filters_and_order(make):
    rows = [
        {"id": i, "date": d, "title": t, "category": c}
        for i, d, t, c in [
            (1, "2026-03-01", "morning", "incident"), (2, "2026-03-01", "evening", "promotion"),
            (3, "2026-03-10", "x", "incident"), (4, "2026-03-20", "y", "other"), (5, "2026-03-31", "z", "other"),
        ]
    ]
    notes = make("annotations", rows)
    assert [r.id for r in a.annotations_list(notes).collect()] == [5, 4, 3, 2, 1]
    inclusive = a.annotations_list(notes, date(2026, 3, 10), date(2026, 3, 20))
    assert [r.id for r in inclusive.collect()] == [4, 3]
    assert a.annotations_count(inclusive).first().total == 2
    assert [r.id for r in a.annotations_list(notes, category="incident").collect()] == [3, 1]
    with pytest.raises(ValueError):
        a.annotations_list(notes, date(2026, 3, 20), date(2026, 3, 10))


def test_append_validates(spark, make):
    day = date(2026, 3, 15)
    rows = [
        (day, "ok", None, "campaign", "me"), (day, "default", "d" * 200, None, None), (None, "no date", None, None, None),
        (day, None, None, None, None), (day, "", None, None, None), (day, "x" * 201, None, None, None),
        (day, "t", "x" * 201, None, None), (day, "t", None, "party", None), (day, "t", None, None, "x" * 201),
    ]
    current = make("annotations", [{"id": 7, "date": day, "title": "old"}])
    ready, rejected = a.annotations_append(
        current, spark.createDataFrame(rows, REQUEST), F.lit("2026-03-16").cast("timestamp_ntz")
    )
    got = sorted((r.id, r.title, r.category, r.created_at) for r in ready.collect())
    at = datetime(2026, 3, 16)
    assert got == [(8, "default", "other", at), (9, "ok", "campaign", at)]
    assert sorted(r.reason for r in rejected.collect()) == [
        "category is unknown", "created_by is too long", "date is required", "description is too long",
        "title is required", "title is required", "title is too long",
    ]
    first, _ = a.annotations_append(make("annotations", []), spark.createDataFrame(rows[:1], REQUEST))
    assert first.first().id == 1


def test_overlay_keeps_bare_points(spark, make):
    trend = spark.createDataFrame([(date(2026, 3, 2), 1), (date(2026, 3, 9), 2)], "date date, v int")
    notes = make("annotations", [{"id": i, "date": f"2026-03-0{i}", "title": "n"} for i in (3, 4)])
    got = {(r.date, r.v, r.annotation_id) for r in a.annotations_overlay(trend, notes, "week").collect()}
    assert got == {(date(2026, 3, 2), 1, 3), (date(2026, 3, 2), 1, 4), (date(2026, 3, 9), 2, None)}
