"""Cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillscope.functions import dates
from tillscope.operators import clean, cleaning
from tillscope.plans import ctes, views
from tillscope.plans.registry import query
from tillscope.sources.tables import table

_M = ctes.MESSY
_PARSED = ctes.parse("order_date")
_TEXTS = ("product_category", "payment_method")


def _messy(spark, folder, *columns):
    rows = views.messy_orders(spark, folder)
    return rows.select(*columns) if columns else rows


# ---------------------------------------------------------------- formats


@query("parse_dates", f"with {_M} select row_id, {_PARSED} as order_date from messy")
def parse_dates(spark, folder):
    parsed = clean.parse_dates(_messy(spark, folder, "row_id", "order_date"), ["order_date"])
    return parsed.withColumn("order_date", F.to_date("order_date"))


# Ways to write a time: how Spark writes it, and what is left of the time in it.
_TIME_SHAPES = (
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "date_trunc('second', ts)"),
    ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", "date_trunc('second', ts) - interval 2 hour"),
    ("yyyy-MM-dd HH:mm:ss.SSS", "date_trunc('second', ts)"),
    ("yyyy/MM/dd HH:mm", "date_trunc('minute', ts)"),
    ("MM/dd/yyyy hh:mm a", "date_trunc('minute', ts)"),
    ("MMM d yyyy", "date_trunc('day', ts)"),
    ("d-MMM-yyyy", "date_trunc('day', ts)"),
    ("yyyy.MM.dd", "date_trunc('day', ts)"),
    ("dd.MM.yyyy HH:mm", "date_trunc('minute', ts)"),
    ("MMMM d, yyyy", "date_trunc('day', ts)"),
    ("yyyyMMdd", "date_trunc('day', ts)"),
    ("yyyy-MM-dd hh:mm:ss a", "date_trunc('second', ts)"),
)


@query(
    "parse_times",
    f"""select event_id, strftime(case event_id % {len(_TIME_SHAPES)}
    {' '.join(f'when {i} then {kept}' for i, (_, kept) in enumerate(_TIME_SHAPES))} end, '%Y-%m-%d %H:%M:%S') as parsed from events""",
)
def parse_times(spark, folder):
    """Times written in a dozen ways, read back with what each way keeps."""
    shape = F.col("event_id") % len(_TIME_SHAPES)
    text = F.coalesce(*[F.when(shape == i, F.date_format("ts", pattern)) for i, (pattern, _) in enumerate(_TIME_SHAPES)])
    rows = table(spark, folder, "events").select("event_id", text.alias("parsed"))
    return clean.parse_dates(rows, ["parsed"]).withColumn("parsed", F.date_format("parsed", "yyyy-MM-dd HH:mm:ss"))


_ISSUE = (
    f"case when order_date is not null and {_PARSED} is null then 'unparseable_date' "
    f"when year({_PARSED}) not between 2020 and 2025 then 'invalid_date_range' end"
)


@query(
    "date_range_check",
    f"""with {_M} select row_id, case when year({_PARSED}) between 2020 and 2025 then {_PARSED} end as order_date,
    {_ISSUE} as issue from messy""",
)
def date_range_check(spark, folder):
    rows = _messy(spark, folder, "row_id", "order_date")
    return clean.dates_with_issues(rows, "order_date", ["row_id"]).withColumn("order_date", F.to_date("order_date"))


@query(
    "date_summary",
    f"""with {_M}, i as (select order_date, {_ISSUE} as issue from messy) select 'order_date' as "column",
    count_if(order_date is not null and issue is null) as parsed, count_if(issue = 'unparseable_date') as unparseable,
    count_if(issue = 'invalid_date_range') as out_of_range from i""",
)
def date_summary(spark, folder):
    return clean.date_summary(_messy(spark, folder, "row_id", "order_date"), ["order_date"])


@query(
    "standardize_text",
    f"with {_M} select row_id, {', '.join(f'{ctes.standardize(c)} as {c}' for c in _TEXTS)} from messy",
)
def standardize_text(spark, folder):
    return clean.standardize_text(_messy(spark, folder, "row_id", *_TEXTS), _TEXTS)


@query(
    "standardize_documents",
    f"select doc_id, {ctes.standardize('text')} as text from documents",
)
def standardize_documents(spark, folder):
    return clean.standardize_text(table(spark, folder, "documents").select("doc_id", "text"), ["text"])


@query(
    "text_changes",
    f"with {_M} "
    + " union all ".join(
        f"select '{c}' as \"column\", count_if({ctes.standardize(c)} <> {c}) as changed from messy" for c in _TEXTS
    ),
)
def text_changes(spark, folder):
    return clean.text_changes(_messy(spark, folder, *_TEXTS), _TEXTS)


# ---------------------------------------------------------------- duplicates

_ALL = ", ".join(ctes.MESSY_COLUMNS)


@query("drop_duplicates", f"with {_M} select min(row_id) as row_id, {_ALL} from messy group by {_ALL}")
def drop_duplicates(spark, folder):
    return clean.drop_duplicates(_messy(spark, folder), "row_id")


@query(
    "duplicate_report",
    f"""with {_M}, d as (select row_id, row_number() over (partition by {_ALL} order by row_id) as copy from messy)
    select count(*) as duplicates, (select string_agg(row_id, ',' order by row_id)
    from (select row_id from d where copy > 1 order by row_id limit 10)) as first_ids from d where copy > 1""",
)
def duplicate_report(spark, folder):
    return clean.duplicate_report(_messy(spark, folder), "row_id")


# ---------------------------------------------------------------- invalid values

_SIGNED = ("purchase_amount", "quantity")


@query(
    "fix_negative",
    f"with {_M} select row_id, abs(purchase_amount) as purchase_amount, abs(quantity) as quantity from messy",
)
def fix_negative(spark, folder):
    return clean.fix_negative(_messy(spark, folder, "row_id", *_SIGNED), _SIGNED)


@query(
    "zero_report",
    f"with {_M} "
    + " union all ".join(
        f"""select '{c}' as "column", count_if({c} < 0) as negatives, count_if({c} = 0) as zeros,
        {ctes.rounded(f'count_if({c} = 0) / count(*) * 100', 2)} as zero_pct, case when count_if({c} = 0) = 0 then null
        when count_if({c} = 0) / count(*) * 100 < 5 then 'kept_as_is' else 'flagged_for_review' end as zero_action from messy"""
        for c in _SIGNED
    ),
)
def zero_report(spark, folder):
    return clean.sign_report(_messy(spark, folder, *_SIGNED), _SIGNED)


@query(
    "clip_rating",
    f"with {_M} select row_id, case when review_rating < 1 then 1.0::double when review_rating > 5 then 5.0::double "
    "else review_rating end as review_rating from messy",
)
def clip_rating(spark, folder):
    return clean.clip_rating(_messy(spark, folder, "row_id", "review_rating"), ["review_rating"])


@query(
    "rating_report",
    f"""with {_M} select 'review_rating' as "column", count_if(review_rating < 1 or review_rating > 5) as out_of_range from messy""",
)
def rating_report(spark, folder):
    return clean.rating_report(_messy(spark, folder, "review_rating"), ["review_rating"])


# ---------------------------------------------------------------- outliers


def fences(columns, source, group=None):
    """SQL: quartile fences per group, or of the whole table."""
    by = f"{group}, " if group else ""
    where = f"where {group} is not null group by {group}" if group else ""
    cells = ", ".join(
        f"case when count({c}) >= 4 then quantile_cont({c}, 0.25) - 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) end as low_{c}, "
        f"case when count({c}) >= 4 then quantile_cont({c}, 0.75) + 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) end as high_{c}"
        for c in columns
    )
    return f"select {by}{cells} from {source} {where}"


def clip(c):
    return f"case when {c} < low_{c} then low_{c} when {c} > high_{c} then high_{c} else cast({c} as double) end"


@query(
    "clip_outliers_by_group",
    f"""with {_M}, f as ({fences(_SIGNED, 'messy', 'product_category')})
    select row_id, m.product_category, {', '.join(f'round({clip(c)}, 6) as {c}' for c in _SIGNED)}
    from messy m left join f on f.product_category = m.product_category""",
)
def clip_outliers_by_group(spark, folder):
    rows = _messy(spark, folder, "row_id", "product_category", *_SIGNED)
    out = clean.clip_outliers_by_group(rows, _SIGNED, "product_category")
    return out.withColumns({c: F.round(c, 6) for c in _SIGNED})


@query(
    "outlier_counts_by_group",
    f"""with {_M}, f as ({fences(_SIGNED, 'messy', 'product_category')}),
    j as (select m.*, f.* exclude (product_category) from messy m join f on f.product_category = m.product_category) """
    + " union all ".join(
        f"""select '{c}' as "column", product_category as "group", count(*) as outliers from j
        where {c} < low_{c} or {c} > high_{c} group by 2"""
        for c in _SIGNED
    ),
)
def outlier_counts_by_group(spark, folder):
    rows = _messy(spark, folder, "product_category", *_SIGNED)
    return clean.outlier_counts_by_group(rows, _SIGNED, "product_category")


@query(
    "clip_outliers_global",
    f"""with {_M}, f as ({fences(_SIGNED, 'messy')})
    select row_id, {', '.join(f'round({clip(c)}, 6) as {c}' for c in _SIGNED)} from messy, f""",
)
def clip_outliers_global(spark, folder):
    out = clean.clip_outliers_global(_messy(spark, folder, "row_id", *_SIGNED), _SIGNED)
    return out.withColumns({c: F.round(c, 6) for c in _SIGNED})


# ---------------------------------------------------------------- missing values


def group_fill(statistic):
    return f"""f as (select product_category, {statistic} as fill from messy where product_category is not null group by 1),
    filled as (select row_id, m.product_category, coalesce(purchase_amount, fill) as purchase_amount
      from messy m left join f on f.product_category = m.product_category)
    select row_id, product_category, round(coalesce(purchase_amount, (select median(purchase_amount) from filled)), 6)
    as purchase_amount from filled"""


def _impute(spark, folder, method):
    rows = _messy(spark, folder, "row_id", "product_category", "purchase_amount")
    out = clean.impute_by_group(rows, "purchase_amount", "product_category", method)
    return out.withColumn("purchase_amount", F.round("purchase_amount", 6))


@query("impute_by_group", f"with {_M}, {group_fill('median(purchase_amount)')}")
def impute_by_group(spark, folder):
    return _impute(spark, folder, "median")


@query("impute_by_group_mean", f"with {_M}, {group_fill('avg(purchase_amount)')}")
def impute_by_group_mean(spark, folder):
    return _impute(spark, folder, "mean")


@query(
    "impute_by_group_mode",
    f"""with {_M}, c as (select product_category, purchase_amount as fill, count(*) as n from messy
      where product_category is not null and purchase_amount is not null group by 1, 2),
    f as (select product_category, fill from c qualify row_number() over (partition by product_category order by n desc, fill) = 1),
    filled as (select row_id, m.product_category, coalesce(purchase_amount, fill) as purchase_amount
      from messy m left join f on f.product_category = m.product_category)
    select row_id, product_category, round(coalesce(purchase_amount, (select median(purchase_amount) from filled)), 6)
    as purchase_amount from filled""",
)
def impute_by_group_mode(spark, folder):
    return _impute(spark, folder, "mode")


@query(
    "impute_median",
    f"with {_M} select row_id, "
    + ", ".join(f"round(coalesce({c}, (select median({c}) from messy)), 6) as {c}" for c in _SIGNED)
    + " from messy",
)
def impute_median(spark, folder):
    out = clean.impute_median(_messy(spark, folder, "row_id", *_SIGNED), _SIGNED)
    return out.withColumns({c: F.round(c, 6) for c in _SIGNED})


def mode(column, source="messy"):
    return (
        f"(select {column} from {source} where {column} is not null group by {column} "
        f"order by count(*) desc, {column} limit 1)"
    )


_MODAL = ("review_rating", "payment_method", "product_category")


@query(
    "impute_mode",
    f"with {_M} select row_id, {', '.join(f'coalesce({c}, {mode(c)}) as {c}' for c in _MODAL)} from messy",
)
def impute_mode(spark, folder):
    return clean.impute_mode(_messy(spark, folder, "row_id", *_MODAL), _MODAL)


def filled_in_order(column, key):
    return (
        f"coalesce(last_value({column} ignore nulls) over (order by {key} rows between unbounded preceding and current row), "
        f"first_value({column} ignore nulls) over (order by {key} rows between current row and unbounded following))"
    )


@query(
    "ffill_bfill",
    f"""with g as (select event_id, case when event_id % 7 in (0, 1) then null else cast(ts as date) end as event_date from events)
    select event_id, {filled_in_order('event_date', 'event_id')} as event_date from g""",
)
def ffill_bfill(spark, folder):
    return clean.fill_in_order(views.gappy_events(spark, folder), ["event_date"], "event_id", width=1000)


# ---------------------------------------------------------------- checks and scores


@query(
    "unusual_price",
    f"""with {_M}, s as (select product_category, median(purchase_amount) as m, stddev_samp(purchase_amount) as sd,
      count(*) as n from messy where product_category is not null group by 1)
    select m.product_category as product, count_if(abs(purchase_amount - s.m) > 3 * sd and n >= 2) as unusual
    from messy m join s on s.product_category = m.product_category group by 1""",
)
def unusual_price(spark, folder):
    return clean.unusual_prices(_messy(spark, folder, "product_category", "purchase_amount"), "purchase_amount", "product_category")


_SCORES = f"""select {ctes.rounded('c', 2)} as completeness, {ctes.rounded('v', 2)} as validity, 95.0::double as consistency,
    {ctes.rounded('c * 0.4 + v * 0.4 + 95.0 * 0.2', 2)} as overall from q"""
_FILLED = " + ".join(f"count({c})" for c in ctes.MESSY_COLUMNS)


@query(
    "completeness",
    f"""with {_M} select (1 - (count(*) * {len(ctes.MESSY_COLUMNS)} - ({_FILLED})) / (count(*) * {len(ctes.MESSY_COLUMNS)})) * 100
    as completeness from messy""",
)
def completeness(spark, folder):
    return clean.completeness(_messy(spark, folder).drop("row_id"))


@query(
    "quality_scores",
    f"""with {_M}, q as (select ({_FILLED}) / (count(*) * {len(ctes.MESSY_COLUMNS)}) * 100 as c,
      greatest(0.0, 100 - count_if({_ISSUE} is not null) / count(*) * 100) as v from messy)
    {_SCORES}""",
)
def quality_scores(spark, folder):
    rows = _messy(spark, folder)
    return clean.quality_scores(rows.drop("row_id"), clean.date_issues(rows, ["order_date"], "row_id"))


# ---------------------------------------------------------------- plan and full clean-up

_TYPES = {
    "order_id": "identifier",
    "customer_id": "identifier",
    "product_category": "product",
    "purchase_amount": "revenue",
    "quantity": "quantity",
    "review_rating": "rating",
    "payment_method": "payment_method",
    "order_date": "date",
}


def _plan_sql() -> str:
    steps = []
    for i, (c, t) in enumerate(_TYPES.items()):
        amount = t in ("revenue", "quantity")

        def step(action, reason, recommended="true", where="true", c=c, i=i, t=t):
            steps.append(
                f"""select {i} as ordinal, '{c}' as "column", '{t}' as semantic_type, '{c}_{action}' as step_id,
                '{action}' as action, {reason} as reason, {recommended} as recommended, count(*) - count({c}) as missing_count,
                count(*) as total_rows from messy having {where}"""
            )

        if t == "date":
            step("parse_date", "'Read dates in mixed formats'")
        if t in ("product", "payment_method"):
            step("standardize_text", "'Trim and title-case text'")
        if amount:
            step("fix_negative", f"'Make ' || count_if({c} < 0) || ' negative value(s) positive'", where=f"count_if({c} < 0) > 0")
            step("handle_outliers", "'Clip values outside the quartile fences'", "false")
        method = "median" if amount else "mode"
        step(
            "fill_missing",
            f"'Fill ' || (count(*) - count({c})) || ' missing value(s) with the {method}'",
            where=f"count(*) > count({c})",
        )
    steps.append(
        f"""select null, null, null, 'remove_duplicates', 'remove_duplicates',
        'Remove ' || (count(*) - (select count(*) from (select distinct {_ALL} from messy))) || ' repeated row(s)', true, null,
        count(*) from messy having count(*) > (select count(*) from (select distinct {_ALL} from messy))"""
    )
    return f"with {_M}, plan as ({' union all '.join(steps)}) "


@query("cleaning_plan", _plan_sql() + "select * from plan")
def cleaning_plan(spark, folder):
    return cleaning.cleaning_plan(_messy(spark, folder), "row_id")


@query(
    "cleaning_plan_summary",
    _plan_sql() + 'select count(distinct "column") as columns_needing_cleaning, count(*) as total_cleaning_steps from plan',
)
def cleaning_plan_summary(spark, folder):
    return cleaning.plan_summary(cleaning.cleaning_plan(_messy(spark, folder), "row_id"))


_DATED = f"case when year({_PARSED}) between 2020 and 2025 then {_PARSED} end"
# Formats standardised, then one copy of each row.
_DEDUPED = f"""{_M}, formatted as (select row_id, order_id, customer_id, {ctes.standardize('product_category')} as product_category,
      purchase_amount, quantity, review_rating, {ctes.standardize('payment_method')} as payment_method, {_DATED} as order_date from messy),
    deduped as (select min(row_id) as row_id, {_ALL} from formatted group by {_ALL})"""


def _applied_sql(outliers: bool) -> str:
    """Every step of the plan (or all but the outliers), as SQL."""
    clipped = (
        f"""f as ({fences(_SIGNED, 'signed', 'product_category')}),
        clipped as (select s.* replace ({', '.join(f'{clip(c)} as {c}' for c in _SIGNED)}) from signed s
          left join f on f.product_category = s.product_category)"""
        if outliers
        else "clipped as (select * from signed)"
    )
    return f"""with {_DEDUPED}, signed as (select * replace (abs(purchase_amount) as purchase_amount) from deduped),
    {clipped},
    g as (select product_category, median(purchase_amount) as fill from clipped where product_category is not null group by 1),
    half as (select c.* replace (coalesce(purchase_amount, fill) as purchase_amount) from clipped c
      left join g on g.product_category = c.product_category)
    select row_id, order_id, customer_id, coalesce(product_category, {mode('product_category', 'half')}) as product_category,
    round(coalesce(purchase_amount, (select median(purchase_amount) from half)), 6) as purchase_amount,
    round(coalesce(quantity, (select median(quantity) from half)), 6) as quantity,
    coalesce(review_rating, {mode('review_rating', 'half')}) as review_rating,
    coalesce(payment_method, {mode('payment_method', 'half')}) as payment_method, order_date from half"""


def _rounded(df):
    rounded = {c: F.round(F.col(c).cast("double"), 6) for c in _SIGNED}
    return df.withColumns({**rounded, "order_date": F.to_date("order_date")})


@query("apply_cleaning", _applied_sql(True))
def apply_cleaning(spark, folder):
    return _rounded(cleaning.apply_cleaning(_messy(spark, folder), "row_id")[0])


@query("apply_cleaning_recommended", _applied_sql(False))
def apply_cleaning_recommended(spark, folder):
    return _rounded(cleaning.apply_cleaning(_messy(spark, folder), "row_id", "recommended")[0])


_CLEANED = f"""{_DEDUPED}, valid as (select * replace (abs(purchase_amount) as purchase_amount,
      case when review_rating < 1 then 1.0::double when review_rating > 5 then 5.0::double else review_rating end as review_rating)
      from deduped),
    f as ({fences(_SIGNED, 'valid', 'product_category')}),
    clipped as (select s.* replace ({', '.join(f'{clip(c)} as {c}' for c in _SIGNED)}) from valid s
      left join f on f.product_category = s.product_category),
    g as (select product_category, median(purchase_amount) as fill from clipped where product_category is not null group by 1),
    half as (select c.* replace (coalesce(purchase_amount, fill) as purchase_amount) from clipped c
      left join g on g.product_category = c.product_category),
    cleaned as (select row_id, order_id, customer_id, product_category,
      coalesce(purchase_amount, (select median(purchase_amount) from half)) as purchase_amount, quantity,
      coalesce(review_rating, {mode('review_rating', 'half')}) as review_rating,
      coalesce(payment_method, {mode('payment_method', 'half')}) as payment_method,
      {filled_in_order('order_date', 'row_id')} as order_date from half)"""


@query(
    "clean_sales",
    f"""with {_CLEANED} select * replace (round(purchase_amount, 6) as purchase_amount, round(quantity, 6) as quantity) from cleaned""",
)
def clean_sales(spark, folder):
    return _rounded(cleaning.clean_sales(_messy(spark, folder), "row_id").rows)


_ISSUES = f"""{_CLEANED}, usual as (select product_category, median(purchase_amount) as m, stddev_samp(purchase_amount) as sd
      from cleaned where product_category is not null group by 1),
    issues as (
      select 'order_date' as "column", {_ISSUE} as issue, order_date as value, row_id, 1 as count, 'set_to_null' as action
        from messy where {_ISSUE} is not null
      union all select 'purchase_amount', 'negative_values', null, null, count_if(purchase_amount < 0), 'converted_to_absolute'
        from deduped having count_if(purchase_amount < 0) > 0
      union all select 'purchase_amount', 'zero_values', null, null, count_if(purchase_amount = 0),
        case when count_if(purchase_amount = 0) / count(*) * 100 < 5 then 'kept_as_is' else 'flagged_for_review' end
        from deduped having count_if(purchase_amount = 0) > 0
      union all select 'review_rating', 'out_of_range_ratings', null, null, count_if(review_rating < 1 or review_rating > 5), 'clipped_to_1_5'
        from deduped having count_if(review_rating < 1 or review_rating > 5) > 0
      union all select null, 'exact_duplicates', null, null, (select count(*) from messy) - count(*), 'removed' from deduped
      union all select null, 'unusual_price_for_product', null, null, count(*), 'reported' from cleaned c join usual u
        on u.product_category = c.product_category where abs(purchase_amount - m) > 3 * sd having count(*) > 0)"""


@query("cleaning_issues", f"with {_ISSUES} select * from issues")
def cleaning_issues(spark, folder):
    return cleaning.clean_sales(_messy(spark, folder), "row_id").issues()


@query(
    "clean_sales_quality",
    f"""with {_ISSUES}, q as (select ({_FILLED}) / (count(*) * {len(ctes.MESSY_COLUMNS)}) * 100 as c, greatest(0.0,
      100 - (select count(*) from issues where issue <> 'exact_duplicates') / count(*) * 100) as v from cleaned)
    {_SCORES}""",
)
def clean_sales_quality(spark, folder):
    return cleaning.clean_sales(_messy(spark, folder), "row_id").quality()


@query(
    "cleaning_actions",
    f"""with {_CLEANED}, b as (select c.*, d.purchase_amount as p0, d.quantity as q0, d.review_rating as r0, d.payment_method as m0, d.order_date as d0
      from cleaned c join deduped d on d.row_id = c.row_id),
    a as (select 'purchase_amount' as "column", 'filled' as action, count_if(p0 is null and purchase_amount is not null) as cells from b
      union all select 'purchase_amount', 'made_positive', count_if(p0 < 0) from b
      union all select 'purchase_amount', 'clipped', count_if(abs(p0) <> purchase_amount) from b
      union all select 'quantity', 'clipped', count_if(q0 <> quantity) from b
      union all select 'review_rating', 'filled', count_if(r0 is null and review_rating is not null) from b
      union all select 'review_rating', 'clipped', count_if(r0 <> review_rating) from b
      union all select 'payment_method', 'filled', count_if(m0 is null and payment_method is not null) from b
      union all select 'order_date', 'filled', count_if(d0 is null and order_date is not null) from b)
    select * from a where cells > 0""",
)
def cleaning_actions(spark, folder):
    return cleaning.clean_sales(_messy(spark, folder), "row_id").actions()


@query(
    "cleaning_filled_dates",
    f"""with {_DEDUPED} select d.row_id, 'order_date' as "column", m.order_date as value from deduped d join messy m on m.row_id = d.row_id
    where d.order_date is null""",
)
def cleaning_filled_dates(spark, folder):
    return cleaning.clean_sales(_messy(spark, folder), "row_id").filled_dates()
