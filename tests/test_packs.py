"""The shipped packs over small tables, written and read as files."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from pathlib import Path

import pytest

from metricspine import errors
from metricspine.facade import Guard, Spine

PACKS = Path(__file__).parents[1] / "metricspine" / "packs"
D = Decimal


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("shop"))

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")

    put("artist", [(1, "A"), (2, None)], "artist_id int, name string")
    put("album", [(1, "one", 1), (2, "two", 1), (3, "three", 2)], "album_id int, title string, artist_id int")
    put("genre", [(1, "Fado"), (2, "Polka")], "genre_id int, name string")
    put("media_type", [(1, "disc")], "media_type_id int, name string")
    put("track", [(1, "t1", 1, 1, 1, 100, D("0.99"), None), (2, "t2", 1, 2, 1, 200, D("0.99"), "c"), (3, "t3", 3, None, 1, 300, D("1.99"), None), (4, "t4", None, 2, 1, 400, D("0.99"), None)], "track_id int, name string, album_id int, genre_id int, media_type_id int, milliseconds int, unit_price decimal(10,2), composer string")
    put("playlist", [(1, "Music"), (2, "Music"), (3, "Rest")], "playlist_id int, name string")
    put("playlist_track", [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)], "playlist_id int, track_id int")
    put("customer", [(1, "x", "X", "US", None, "e", 2), (2, "y", "Y", None, None, "f", 2), (3, "z", "Z", "US", None, "g", None)], "customer_id int, first_name string, last_name string, country string, city string, email string, support_rep_id int")
    put("employee", [(1, "a", "Ostrom", None, None), (2, "e", "Lindqvist", None, 1)], "employee_id int, first_name string, last_name string, title string, reports_to int")
    put("invoice", [(1, 1, dt.datetime(2026, 1, 1), D("2.97"), "US"), (2, 2, dt.datetime(2026, 1, 2), D("1.99"), None)], "invoice_id int, customer_id int, invoice_date timestamp_ntz, total decimal(10,2), billing_country string")
    put("invoice_line", [(1, 1, 1, D("0.99"), 2), (2, 1, 2, D("0.99"), 1), (3, 2, 3, D("1.99"), 1)], "invoice_line_id int, invoice_id int, track_id int, unit_price decimal(10,2), quantity int")
    put("daily_inventory", [(1, dt.date(2026, 1, 1), 10), (1, dt.date(2026, 1, 3), 4), (2, dt.date(2026, 1, 3), 7), (4, dt.date(2026, 1, 1), 999)], "track_id int, as_of_date date, units_on_hand int")
    return at


def rows(s, engine=None, **spec):
    return sorted(s.query({"limit": None, **spec}, engine).rows, key=repr)


def test_music_store(spark, shop):
    s = Spine.load(spark, PACKS / "music_store.yaml", shop, verify=True, guard=Guard(timeout_ms=120_000))
    assert (len(s.ontology.objects), len(s.ontology.links), len(s.ontology.metrics)) == (10, 9, 8)
    lines = {"object": "Customer", "traverse": ["Customer_Invoices", "Invoice_Lines"]}
    # an invoice of two lines counts once
    assert rows(s, **lines, group_by=["country"], metrics=["invoice_total", "revenue", "units_sold"]) == sorted([("US", D("2.97"), D("2.97"), 3), (None, D("1.99"), D("1.99"), 1)], key=repr)
    lists = {"object": "Playlist", "traverse": ["Playlist_Tracks", "Track_InvoiceLines"]}
    assert rows(s, **lists, group_by=["id"], metrics=["revenue"]) == [(1, D("2.97")), (2, D("2.97")), (3, D("1.99"))]
    with pytest.raises(errors.NonAdditiveRefused):
        rows(s, **lists, group_by=["name"], metrics=["revenue"])
    assert rows(s, "identity", **lists, group_by=["name"], metrics=["revenue"]) == [("Music", D("2.97")), ("Rest", D("1.99"))]
    assert rows(s, object="Album", filters=[{"property": "Album_Tracks.genre", "op": "eq", "value": "Fado"}], group_by=["title"]) == [("one",)]
    assert rows(s, object="Track", metrics=["median_duration", "p90_duration", "track_count"]) == [(200, 400, 4)]
    assert rows(s, object="Track", traverse=["Track_Album"], group_by=["genre"], metrics=["track_count"]) == sorted([("Fado", 1), ("Polka", 1), (None, 1)], key=repr)
    assert rows(s, object="Customer", traverse=["Customer_SupportRep"], group_by=["Customer_SupportRep.last_name"], metrics=["customer_count"]) == [("Lindqvist", 2)]
    assert rows(s, object="Employee", traverse=["Employee_Manager"], group_by=["Employee_Manager.id"], metrics=["employee_count"]) == [(1, 1)]
    assert rows(s, object="Artist", traverse=["Artist_Albums", "Album_Tracks"], group_by=["name"], metrics=["track_count"]) == sorted([("A", 2), (None, 1)], key=repr)


def test_music_inventory(spark, shop):
    s = Spine.load(spark, PACKS / "music_inventory.yaml", shop, verify=True, guard=Guard(timeout_ms=120_000))
    assert rows(s, object="Inventory", metrics=["inventory_level"]) == [(11,)]
    assert rows(s, object="Inventory", group_by=["track_id"], metrics=["inventory_level"]) == [(1, 4), (2, 7), (4, 999)]
    assert rows(s, object="Track", traverse=["Track_Inventory"], group_by=["name"], metrics=["inventory_level"]) == [("t1", 4), ("t2", 7), ("t4", 999)]
