"""A dozen hand-checked rows that hit most cleaning rules."""

import datetime

import pytest

from tillscope.operators import clean, cleaning, profile

SCHEMA = (
    "row_id long, customer_ref_id long, item string, amount_usd double, date_purchase string, "
    "review_rating double, payment_method string"
)
ROWS = [
    (0, 501, "Scarf", 10.0, "2023-07-05", 4.0, "Card"),
    (1, 502, "Belt", 20.0, "07/06/2023", 5.0, "cash"),
    (2, 503, "Scarf", None, "2023/07/07", None, "Card"),
    (3, 504, "Boots", -75.0, "2023-07-08", 3.0, "Voucher"),
    (4, 505, "Handbag", 120.0, "2023-07-09", None, "Card"),
    (5, 506, "Belt", 24.0, "07-10-2023", 5.0, "Cash"),
    (6, 507, "o'neil  t-shirt", 39.5, "2023-07-11", 9.0, "Cash"),
    (7, 508, "Gloves", None, "2023-07-11", 5.0, "Card"),
    (8, 505, "Handbag", 120.0, "2023-07-09", None, "Card"),
    (9, 509, None, 200.0, "2023-07-12", None, "Voucher"),
    (10, 510, "Belt", 0.0, "2023/13/07", 3.0, " card "),
    (11, 511, "Scarf", 14.0, "1999-07-14", None, "Cash"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def cleaned(raw):
    return cleaning.clean_sales(raw, "row_id")


@pytest.fixture(scope="module")
def by_id(cleaned):
    return {r["row_id"]: r for r in cleaned.rows.collect()}


def test_semantic_types(raw):
    types = {r["column"]: r["semantic_type"] for r in profile.semantic_types(raw.drop("row_id")).collect()}
    assert types == {
        "customer_ref_id": "identifier",
        "item": "product",
        "amount_usd": "revenue",
        "date_purchase": "date",
        "review_rating": "rating",
        "payment_method": "payment_method",
    }


def test_first_copy_of_a_duplicate_stays(by_id):
    assert len(by_id) == 11 and 4 in by_id and 8 not in by_id


def test_formats_are_tried_in_order(by_id):
    assert by_id[1]["date_purchase"] == datetime.datetime(2023, 7, 6)
    assert by_id[2]["date_purchase"] == datetime.datetime(2023, 7, 7)
    assert by_id[5]["date_purchase"] == datetime.datetime(2023, 10, 7)


def test_bad_dates_take_the_date_before(by_id):
    assert by_id[10]["date_purchase"] == datetime.datetime(2023, 7, 12)
    assert by_id[11]["date_purchase"] == datetime.datetime(2023, 7, 12)


def test_text_is_title_case(by_id):
    assert by_id[6]["item"] == "O'Neil T-Shirt"
    assert by_id[10]["payment_method"] == "Card"


def test_amounts(by_id):
    assert by_id[3]["amount_usd"] == 75.0
    assert by_id[2]["amount_usd"] == 12.0  # median of the two other scarves
    # The gloves have no price of their own: median of 10 20 12 75 120 24 39.5 200 0 14.
    assert by_id[7]["amount_usd"] == 22.0


def test_ratings(by_id):
    assert by_id[6]["review_rating"] == 5.0
    assert by_id[2]["review_rating"] == 5.0  # most frequent after clipping


def test_issues(cleaned):
    found = {(r["column"], r["issue"]): r["count"] for r in cleaned.issues().collect()}
    assert found == {
        ("date_purchase", "unparseable_date"): 1,
        ("date_purchase", "invalid_date_range"): 1,
        ("amount_usd", "negative_values"): 1,
        ("amount_usd", "zero_values"): 1,
        ("review_rating", "out_of_range_ratings"): 1,
        (None, "exact_duplicates"): 1,
    }


def test_quality(cleaned):
    scores = cleaned.quality().first()
    # One null item is left among 66 cells; five entries besides the duplicates in 11 rows.
    assert scores["completeness"] == round(65 / 66 * 100, 2)
    assert scores["validity"] == round(100 - 5 / 11 * 100, 2)


def test_plan_and_choices(raw):
    plan = {r["step_id"]: r for r in cleaning.cleaning_plan(raw, "row_id").collect()}
    assert set(plan) == {
        "date_purchase_parse_date", "item_standardize_text", "payment_method_standardize_text",
        "amount_usd_fix_negative", "amount_usd_handle_outliers", "item_fill_missing", "amount_usd_fill_missing",
        "review_rating_fill_missing", "remove_duplicates",
    }
    assert not plan["amount_usd_handle_outliers"]["recommended"]
    rows, log = cleaning.apply_cleaning(raw, "row_id", {"amount_usd_fix_negative": True})
    amounts = {r["row_id"]: r["amount_usd"] for r in rows.collect()}
    assert len(amounts) == 12 and amounts[3] == 75.0 and amounts[2] is None
    statuses = {r["step_id"]: r["status"] for r in log.collect()}
    assert [k for k, v in statuses.items() if v == "applied"] == ["amount_usd_fix_negative"]


def test_service_policy_fills_every_column(raw):
    rows, _ = cleaning.apply_cleaning(raw, "row_id", "recommended")
    values = {r["row_id"]: r for r in rows.collect()}
    assert values[9]["item"] is not None and len(values) == 11


def test_cleaning_twice_changes_nothing(spark, cleaned):
    once = cleaned.rows.drop("row_id")
    again = cleaning.clean_sales(cleaned.rows, "row_id").rows.drop("row_id")
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_completeness_never_falls(raw, cleaned):
    share = lambda df: clean.completeness(df).first()[0]
    assert share(cleaned.rows.drop("row_id")) >= share(raw.drop("row_id"))


def test_known_date_shapes_keep_their_time(spark):
    texts = {
        "2023-07-05T10:00:00Z": (5, 10, 0), "2023-07-05T10:00:00+02:00": (5, 8, 0), "2023-07-05 14:30:15.123": (5, 14, 30),
        "2023/07/05 10:00": (5, 10, 0), "07/06/2023 2:30 PM": (6, 14, 30), "Jul 5 2023": (5, 0, 0), "5-Jul-2023": (5, 0, 0),
        "2023.07.05": (5, 0, 0), "05.07.2023 09:15": (5, 9, 15), "13/07/2023 23:59": (13, 23, 59),
    }
    rows = spark.createDataFrame([(t, t) for t in texts], "raw string, day string")
    for row in clean.parse_dates(rows, ["day"]).collect():
        day, hour, minute = texts[row["raw"]]
        assert row["day"].replace(second=0, microsecond=0) == datetime.datetime(2023, 7, day, hour, minute), row["raw"]


def test_filled_dates_and_actions(cleaned):
    filled = {(r["row_id"], r["value"]) for r in cleaned.filled_dates().collect()}
    assert filled == {(10, "2023/13/07"), (11, "1999-07-14")}
    actions = {(r["column"], r["action"]): r["cells"] for r in cleaned.actions().collect()}
    assert actions["date_purchase", "filled"] == 2 and actions["amount_usd", "made_positive"] == 1 and actions["review_rating", "clipped"] == 1
