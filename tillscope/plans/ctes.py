"""SQL text shared by the oracle queries: the views of views.py for DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

from tillscope.plans import views

SALES = (
    "sales as (select "
    + ", ".join(f"{sql} as {role}" for role, (_, sql) in views.ROLES.items())
    + " from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"
)

_LATER = "(cast(o_orderdate as date) + interval 300 month)"
_DAY = views.MESSY_DATE.format(
    iso=f"strftime({_LATER}, '%Y-%m-%d')",
    us=f"strftime({_LATER}, '%m/%d/%Y')",
    slash=f"strftime({_LATER}, '%Y/%m/%d')",
    dmy=f"strftime({_LATER}, '%d-%m-%Y')",
)
MESSY = (
    "messy as (select o_orderkey * 2 + c as row_id, "
    + ", ".join(f"{sql} as {name}" for name, sql in views.MESSY.items())
    + f", {_DAY} as order_date from orders, "
    "unnest(case when o_orderkey % 50 = 0 then [0, 1] else [0] end) as t(c))"
)
MESSY_COLUMNS = (*views.MESSY, "order_date")

CATALOGUE = f"""catalogue as (select event_id // 8 as "table", cast(event_id % 8 as int) as ordinal,
  case when event_id % 3 = 0 then concat(event_type, '_', {views.NAME_SQL}) else {views.NAME_SQL} end as "column",
  event_id % 2 = 0 as "numeric", event_id % 9 = 4 as temporal, (event_id % 101) / 100 as unique_ratio from events)"""

ROLE_MAPPING = f"""mapping as (select event_id // 8 as dataset, {views.ROLE_SQL} as role,
  case when (event_id * 13 + user_id) % 5 <> 0 then event_type end as "column" from events)"""

def rounded(value: str, digits: int) -> str:
    """Half-even on the binary value, which DuckDB's round() does not give on ties."""
    return f"cast(format('{{:.{digits}f}}', cast({value} as double)) as double)"


KPIS = {
    "Total Sales Amount": "cast(coalesce(sum(selling_price * quantity), 0) as double)",
    "Total Orders": "cast(count(distinct order_id) as double)",
    "Total Units Sold": "cast(sum(quantity) as double)",
    "Average Order Value": "cast(sum(selling_price * quantity) as double) / count(distinct order_id)",
    "Average Selling Price per Item": "cast(sum(selling_price) as double) / count(selling_price)",
    "Average Discount Percentage": "cast(sum(discount_percent) as double) / count(discount_percent)",
    "Discount Utilization Rate": (
        "cast(count(distinct case when discount_percent > 0 then order_id end) as double) / count(distinct order_id) * 100"
    ),
}
KPIS = {name: rounded(sql, 4) for name, sql in KPIS.items()}


def scalars(by: Sequence[str] = (), source: str = "sales", kpis: Sequence[str] = tuple(KPIS)) -> str:
    """Body of a CTE with long scalar metrics per ``by``."""
    columns = ", ".join([*by, *[f'{KPIS[k]} as "{k}"' for k in kpis]])
    names = ", ".join(f'"{k}"' for k in kpis)
    group = f" group by {', '.join(by)}" if by else ""
    wide = f"(select {columns} from {source}{group})"
    return f"select * from {wide} unpivot include nulls (value for kpi in ({names}))"


def panel(keys: Sequence[str] = (), unit: str = "month") -> str:
    """CTEs ending in ``panel``: monthly or weekly scalar metrics."""
    return (
        f"{SALES}, dated as (select *, cast(date_trunc('{unit}', order_date) as date) as period from sales), "
        f"panel as ({scalars([*keys, 'period'], 'dated')})"
    )


def title(text: str) -> str:
    """Title case of a SQL expression: every run of letters capitalised."""
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({text}), '\\p{{L}}+|\\P{{L}}+'), "
        "lambda w: case when w[1] = 'ß' then 'Ss' else upper(w[1]) end || w[2:]), '')"
    )


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def standardize(text: str) -> str:
    return f"regexp_replace({title(strip(text))}, '\\s+', ' ', 'g')"


def normalize(name: str) -> str:
    plain = f"regexp_replace(replace(replace({name}, '_', ' '), '-', ' '), '[^A-Za-z0-9\\s]', '', 'g')"
    split = f"case when contains({plain}, ' ') then {plain} else trim(regexp_replace({plain}, '([A-Z])', ' \\1', 'g')) end"
    return strip(f"regexp_replace({title(split)}, '\\s+', ' ', 'g')")


def parse(text: str) -> str:
    formats = ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y")
    return "cast(coalesce(" + ", ".join(f"try_strptime(trim({text}), '{f}')" for f in formats) + ") as date)"
