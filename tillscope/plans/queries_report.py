"""Report tables and text pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillscope.functions.text import strip_markup
from tillscope.operators import panel, report, texts, trend
from tillscope.operators.metrics import SCALARS, kpi_pack, sales_by
from tillscope.plans import ctes, views
from tillscope.plans.queries_metrics import pack_sql
from tillscope.plans.queries_trend import _BASELINE, _RECENT, _SPARK_TEXT, monthly_panel, series_sql
from tillscope.plans.registry import query
from tillscope.session import durable, work_folder
from tillscope.sources import sinks
from tillscope.sources.tables import spread, table

_K = ["category"]
_P = ctes.panel(_K)
_S = ctes.SALES


# ---------------------------------------------------------------- cards and families

_MONEY = "regexp_matches(lower(kpi), 'revenue|amount|price')"
_PERCENT = "regexp_matches(lower(kpi), 'percent|rate')"
_RATING = "regexp_matches(lower(kpi), 'rating|score')"


def cards_sql(keys=("category",)):
    """CTEs ending in ``cards`` over the CTE ``panel``."""
    by = ", ".join([*keys, "kpi"])
    return f"""m as (select max(period) as latest, (select max(period) from panel where period < (select max(period) from panel)) as prior from panel),
    pair as (select {by}, latest, prior, max(case when period = latest then value end) as value,
      max(case when period = prior then value end) as previous from panel, m where period >= prior group by all),
    c as (select *, (value - previous) / abs(previous) * 100 as pct, (value - previous) / previous * 100 as actual,
      {_BASELINE.replace('month(period)', 'month(latest)')} as expected from pair),
    t as (select *, case when pct > 2 then '↑' when pct < -2 then '↓' else '→' end as arrow,
      ' vs ' || strftime(prior, '%Y-%m') || ' (was ' as versus from c),
    sparks as (select {by}, {_SPARK_TEXT} as sparkline from panel where {_RECENT} group by {by}),
    cards as (select {by},
      case when value is null then 'N/A' when {_MONEY} then '$' || format('{{:,.2f}}', value)
        when {_PERCENT} then format('{{:.1f}}', value) || '%' when {_RATING} then format('{{:.2f}}', value) || ' / 5.0'
        else format('{{:,.0f}}', value) end as display,
      case when value is null then 'Calculation failed or no data available'
        when previous is null or previous = 0 then 'Period: ' || strftime(latest, '%Y-%m')
        when {_MONEY} then arrow || ' ' || format('{{:+.1f}}', pct) || '%' || versus || '$' || format('{{:,.2f}}', previous) || ')'
        when {_PERCENT} or {_RATING} then arrow || ' ' || format('{{:+.2f}}', value - previous) || ' points' || versus || format('{{:.2f}}', previous) || ')'
        else arrow || ' ' || format('{{:+.1f}}', pct) || '%' || versus || format('{{:,.0f}}', previous) || ')' end as description,
      case when value <> 0 and previous <> 0 then {ctes.rounded('actual - expected', 1)} end as seasonal_variance,
      case when value <> 0 and previous <> 0 then case when actual - expected > 5 then 'outperforming'
        when actual - expected < -5 then 'underperforming' else 'on_track' end end as seasonal, sparkline
      from t left join sparks using ({by}))"""


def _cards(spark, folder):
    cards = report.kpi_cards(monthly_panel(spark, folder), _K)
    return cards.withColumn(
        "sparkline", F.array_join(F.transform("sparkline", lambda v: v.cast("decimal(38,4)").cast("string")), ",")
    )


@query("kpi_cards", f"with {_P}, {cards_sql()} select * from cards")
def kpi_cards(spark, folder):
    return _cards(spark, folder)


def family_sql(name: str) -> str:
    cases = ""
    for title, words, also in report.FAMILIES:
        extra = f" and regexp_matches(lower({name}), '{'|'.join(also)}')" if also else ""
        cases += f" when regexp_matches(lower({name}), '{'|'.join(words)}'){extra} then '{title}'"
    return f"case{cases} else {name} end"


_DATED_SALES = f"{_S}, dated as (select *, cast(date_trunc('month', order_date) as date) as period from sales)"


@query(
    "label_cards",
    f"""with {_DATED_SALES}, p as ({pack_sql(['period'], 'dated')}), m as (select max(period) as latest,
      (select max(period) from p where period < (select max(period) from p)) as prior from p),
    l as (select kpi, latest, max(case when period = latest then label end) as label, max(case when period = prior then label end) as previous
      from p, m where label is not null and period >= prior group by kpi, latest)
    select kpi, coalesce(label, 'N/A') as display, 'Period: ' || strftime(latest, '%Y-%m') ||
    case when label <> previous then ' (was ' || previous || ')' else '' end as description from l""",
)
def label_cards(spark, folder):
    """Cards of the metrics whose value is a name."""
    return report.label_cards(durable(panel.category_panel(views.sales(spark, folder), "order_date", "month")))


@query(
    "pack_summary",
    f"""with {_DATED_SALES}, p as ({pack_sql(['period'], 'dated')}),
    k as (select period, kpi, case when count(category) > 0 then '{{' || string_agg('"' || category || '":' || cast(cast(value as decimal(38,4)) as varchar), ',' order by category) || '}}'
      else coalesce('"' || max(label) || '"', cast(cast(max(value) as decimal(38,4)) as varchar), 'null') end as content from p group by period, kpi)
    select period, '{{' || string_agg('"' || kpi || '":' || content, ',' order by kpi) || '}}' as summary from k group by period""",
)
def pack_summary(spark, folder):
    """All twelve metrics of each month as one JSON object, labels and categories included."""
    return sinks.pack_summary(kpi_pack(panel.add_period(views.sales(spark, folder), "order_date", "month"), ["period"]))


@query(
    "kpi_family",
    f"""with {ctes.CATALOGUE} select "column" as name, count(*) as rows, {family_sql('"column"')} as family
    from catalogue where not temporal group by 1""",
)
def kpi_family(spark, folder):
    return report.kpi_family(views.catalogue(spark, folder), "column", custom="temporal")


@query(
    "kpi_family_titles",
    f"""with {ctes.CATALOGUE}, f as (select "column" as name, count(*) as rows, {family_sql('"column"')} as family from catalogue group by 1)
    select family, min(name) as name, cast(sum(rows) as bigint) as rows from f group by family""",
)
def kpi_family_titles(spark, folder):
    return report.family_titles(report.kpi_family(views.catalogue(spark, folder), "column"))


# ---------------------------------------------------------------- breakdowns

# Products take the place of the categories, so that there are more than ten.
_DATED = f"""{_S}, dated as (select * replace (product as category), cast(date_trunc('month', order_date) as date) as period from sales),
    grouped as (select * from ({pack_sql(['period'], 'dated')}) where category is not null)"""
_TOP_OF_LATEST = f"""latest as (select * from grouped where period = (select max(period) from grouped) and value is not null),
    breakdown as (select kpi, cast(row_number() over w as int) as rank, category as name,
      case when {_MONEY.replace('price', 'sales')} then '$' || format('{{:,.2f}}', value) else format('{{:,.0f}}', value) end as display,
      value as raw_value, count(*) over (partition by kpi) as total_categories, {_MONEY.replace('price', 'sales')} as is_currency
      from latest window w as (partition by kpi order by value desc, category) qualify row_number() over w <= 10)"""
_BREAKDOWN = f"{_DATED}, {_TOP_OF_LATEST}"


def _breakdown(spark, folder):
    sales = views.sales(spark, folder).withColumn("category", F.col("product"))
    return report.category_breakdown(durable(panel.category_panel(sales, "order_date", "month")))


@query("category_breakdown", f"with {_BREAKDOWN} select * replace (round(raw_value, 6) as raw_value) from breakdown")
def category_breakdown(spark, folder):
    return _breakdown(spark, folder).withColumn("raw_value", F.round("raw_value", 6))


@query(
    "categories_hidden",
    f"""with {_BREAKDOWN} select kpi, max(total_categories) as total_categories, count(*) as shown,
    max(total_categories) - count(*) as hidden from breakdown group by kpi""",
)
def categories_hidden(spark, folder):
    return report.categories_hidden(_breakdown(spark, folder))


@query(
    "share_of_max",
    f"""with {_BREAKDOWN} select kpi, rank, name, round(raw_value, 6) as raw_value,
    round(raw_value / max(raw_value) over (partition by kpi) * 100, 3) as bar_pct from breakdown""",
)
def share_of_max(spark, folder):
    out = report.share_of_max(_breakdown(spark, folder))
    return out.withColumns({"raw_value": F.round("raw_value", 6), "bar_pct": F.round("bar_pct", 3)})


@query(
    "minmax_scale",
    f"""with {_P} select category, kpi, period, round((value - min(value) over w) / case when max(value) over w = min(value) over w
    then 1 else max(value) over w - min(value) over w end, 6) as scaled from panel window w as (partition by category, kpi)""",
)
def minmax_scale(spark, folder):
    return report.minmax_scale(monthly_panel(spark, folder), _K).withColumn("scaled", F.round("scaled", 6))


@query(
    "abbreviate_number",
    f"""with {_P} select category, kpi, period, case when value >= 1e6 then format('{{:.1f}}M', value / 1e6)
    when value >= 1e3 then format('{{:.1f}}K', value / 1e3) else format('{{:.0f}}', value) end as label from panel""",
)
def abbreviate_number(spark, folder):
    return report.axis_labels(monthly_panel(spark, folder), _K)


@query(
    "top5_summary",
    f"""with {_S}, g as (select product as category, cast(sum(selling_price * quantity) as double) as value from sales group by 1)
    select category, value, round(value / (select sum(value) from g) * 100, 6) as share_pct, (select count(*) from g) as total_categories,
    round((select sum(value) from g), 2) as total_value from g order by value desc, category limit 5""",
)
def top5_summary(spark, folder):
    sales = views.sales(spark, folder, ["selling_price", "quantity", "product"])
    out = report.top_summary(sales_by(sales, "product"))
    return out.withColumns({"share_pct": F.round("share_pct", 6), "total_value": F.round("total_value", 2)})


# ---------------------------------------------------------------- analysis texts

# Each document becomes an analysis text with headings, lists and a table.
_MARKDOWN = [
    "'intro ' ", "lang", "'\n## Executive Summary\n'", "text", "'\n# Key Insights  \n- '", "replace(text, '. ', '.\n* ')",
    "'\n## Recommendations\n1. **Act:** '", "replace(text, ', ', '\n2. **Do:** ')",
    "'\n## Table\n|---|---|\n| '", "replace(text, ' ', ' | ')", "' |\n| | |\n| end | row |\n## Executive Summary\nlast '", "source",
    "'\n#\nlost\n## Open'",
]
_MARKDOWN_SQL = " || ".join(_MARKDOWN)
_DOCS = f"docs as (select doc_id, {_MARKDOWN_SQL} as md from documents)"


def _docs(spark, folder):
    rows = spread(table(spark, folder, "documents").select("doc_id", "lang", "text", "source"))
    return rows.select("doc_id", F.expr(_MARKDOWN_SQL.replace("\n", "\\n")).alias("md"))


@query(
    "text_sections",
    f"""with {_DOCS}, l as (select doc_id, unnest(string_split(md, chr(10))) as line, generate_subscripts(string_split(md, chr(10)), 1) as i from docs),
    h as (select *, starts_with(line, '#') as head, sum(case when starts_with(line, '#') then 1 else 0 end) over (partition by doc_id order by i) as s from l),
    b as (select doc_id, s, max(case when head then {ctes.strip("regexp_replace(line, '^#*', '')")} end) as heading,
      coalesce({ctes.strip("string_agg(case when not head then line end, chr(10) order by i)")}, '') as body,
      count(*) as n, max(s) over (partition by doc_id) as last_s from h where s > 0 group by doc_id, s)
    select doc_id, heading, body from b where heading <> '' and (n > 1 or s < last_s)
    qualify row_number() over (partition by doc_id, heading order by s desc) = 1""",
)
def text_sections(spark, folder):
    return texts.text_sections(_docs(spark, folder), "doc_id", "md")


_LINES = f"""{_DOCS}, raw as (select doc_id, generate_subscripts(string_split(md, chr(10)), 1) as i,
      unnest(string_split(md, chr(10))) as line from docs), l as (select doc_id, i, {ctes.strip('line')} as line from raw)"""


@query(
    "text_list_items",
    f"""with {_LINES}, k as (select * from l where line <> '' and not starts_with(line, '#'))
    select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as position,
    case when regexp_matches(line, '^[0-9]+\\.\\s+.') then regexp_replace(line, '^[0-9]+\\.\\s+', '')
    when regexp_matches(line, '^[-*•] ') then line[3:] else line end as item from k""",
)
def text_list_items(spark, folder):
    return texts.text_list_items(_docs(spark, folder), "doc_id", "md")


@query(
    "text_tables",
    f"""with {_LINES}, c as (select doc_id, i, list_transform(string_split(line, '|')[2:-2], lambda x: {ctes.strip('x')}) as cells
      from l where contains(line, '|') and not starts_with(line, '|---')),
    k as (select * from c where len(list_filter(cells, lambda x: x <> '')) > 0),
    n as (select *, count(*) over (partition by doc_id) as rows from k)
    select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as row, cast(len(cells) as int) as columns,
    array_to_string(cells, '~') as cells from n where rows >= 2""",
)
def text_tables(spark, folder):
    out = texts.text_tables(_docs(spark, folder), "doc_id", "md")
    return out.select("doc_id", "row", F.size("cells").alias("columns"), F.array_join("cells", "~").alias("cells"))


@query(
    "strip_markup",
    f"""with {_DOCS} select doc_id, replace(regexp_replace(regexp_replace(regexp_replace(md, '\\*\\*([^*]+)\\*\\*', '<b>\\1</b>', 'g'),
    '\\*([^*]+)\\*', '<i>\\1</i>', 'g'), '(^|\\n)#{{1,6}}\\s+', '\\1', 'g'), chr(10), '<br/>') as plain from docs""",
)
def strip_markup_query(spark, folder):
    return _docs(spark, folder).select("doc_id", strip_markup(F.col("md")).alias("plain"))


@query(
    "text_summary",
    f"""with d as (select doc_id, replace(text, '. ', '.' || chr(10) || chr(10)) as md from documents),
    s as (select *, list_filter(regexp_split_to_array(md, '[.!?]\\s+'), lambda x: length(x) > 30 and not starts_with(x, '#')) as long from d)
    select doc_id, {ctes.strip("list_filter(string_split(md, chr(10) || chr(10)), lambda p: " + ctes.strip('p') + " <> '' and not starts_with(p, '#'))[1]")} as summary,
    coalesce(array_to_string(list_transform(long, lambda x: {ctes.strip('x')} || '.'), '~'), '') as sentences from s""",
)
def text_summary(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.expr("replace(text, '. ', '.\\n\\n')").alias("md"))
    out = texts.text_summary(docs, "doc_id", "md")
    return out.withColumn("sentences", F.array_join("sentences", "~"))


_NAMED = f"""{_LINES}, n as (select *, case when contains(line, '## Executive Summary') or contains(line, '## Summary') or contains(line, '# Executive Summary') then 'summary'
      when contains(line, '## Recommendations') or contains(line, '## Recommendation') or contains(line, '# Recommendations') then 'recommendations'
      when contains(line, '## Insights') or contains(line, '## Key Insights') or contains(line, '# Key Insights') then 'insights'
      when contains(line, '##') then 'none' end as opens from l),
    s as (select *, last_value(opens ignore nulls) over (partition by doc_id order by i) as section from n),
    content as (select doc_id, section, i, case
      when section = 'summary' and line <> '' and not regexp_matches(line, '^[0-9]+\\.\\s+\\*\\*') and not regexp_matches(line, '^[-*•] ')
        and not starts_with(line, '#') then line
      when section <> 'summary' and regexp_matches(line, '^[0-9]+\\.\\s+\\*\\*') then
        regexp_replace(regexp_replace(line, '\\*\\*([^*]+)\\*\\*:\\s*', '\\1: ', 'g'), '^[0-9]+\\.\\s+', '')
      when section <> 'summary' and regexp_matches(line, '^[-*•] ') then {ctes.strip('line[3:]')} end as content
      from s where opens is null and section in ('summary', 'insights', 'recommendations'))"""


@query(
    "named_sections",
    f"""with {_NAMED} select doc_id, section, cast(row_number() over (partition by doc_id, section order by i) as int) as position, content
    from content where content is not null""",
)
def named_sections(spark, folder):
    return texts.named_sections(_docs(spark, folder), "doc_id", "md")


@query(
    "named_sections_fallback",
    f"""with docs as (select doc_id, text as md from documents),
    s as (select doc_id, {ctes.strip('x')} || '.' as content, i from (select doc_id, unnest(regexp_split_to_array(md, '[.!?]\\s+')) as x,
      generate_subscripts(regexp_split_to_array(md, '[.!?]\\s+'), 1) as i from docs) where length(x) > 30 and not starts_with(x, '#'))
    select doc_id, 'summary' as section, cast(row_number() over (partition by doc_id order by i) as int) as position, content from s""",
)
def named_sections_fallback(spark, folder):
    """Texts without a summary section are summed up by their long sentences."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("md"))
    return texts.named_sections(docs, "doc_id", "md", fallback=True)


# ---------------------------------------------------------------- assembly


_REPORT = f"""with {series_sql(())}, {cards_sql(())}, dated_all as (select *, cast(date_trunc('month', order_date) as date) as period from sales),
    grouped as (select * from ({pack_sql(['period'], 'dated_all')}) where category is not null),
    {_TOP_OF_LATEST}, {_NAMED},
    texts as (select doc_id, section, row_number() over (partition by doc_id, section order by i) as position, content
      from content where content is not null)
    select 'title' as section, 'title' as item, 1 as position, '{report.TITLE}' as content
    union all select 'kpis', kpi, 1, display || ' ' || description from cards
    union all select 'explanations', {family_sql('kpi')}, 1, min(kpi) from cards group by 2
    union all select 'breakdowns', kpi, rank, name || ': ' || display from breakdown
    union all select 'trends', kpi, 1, trend || ' ' || case when pct = 0 then 'minimal change' else format('{{:+.1f}}%', pct) end || ', ' || volatility
      from facts where points >= 2
    union all select section, doc_id::varchar, position, content from texts"""


def _report(spark, folder):
    # The pack is computed once and feeds cards, trends and breakdowns.
    pack = durable(kpi_pack(panel.add_period(views.sales(spark, folder), "order_date", "month"), ["period"]))
    months = pack.where(F.col("kpi").isin(*SCALARS)).select("period", "kpi", "value")
    breakdown = report.category_breakdown(pack.where(F.col("category").isNotNull()))
    facts = trend.trend_facts(months, kpis=tuple(ctes.KPIS))
    cards = durable(report.kpi_cards(months))
    return report.report_tables(
        cards, breakdown, facts, texts.named_sections(_docs(spark, folder), "doc_id", "md").withColumnRenamed("doc_id", "source")
    )


@query("report_tables", _REPORT)
def report_tables(spark, folder):
    return _report(spark, folder)


@query("report_json", _REPORT)
def report_json(spark, folder):
    """The report written as JSON lines and read back; compressed, as names and words repeat in every line."""
    path = work_folder(spark, "report")
    sinks.write_report(_report(spark, folder), path, "gzip")
    return spark.read.schema("section string, item string, position int, content string").json(path)


@query(
    "as_json",
    f"""with {_P} select '{{"category":"' || category || '","kpi":"' || kpi || '","period":"' || strftime(period, '%Y-%m-%d')
    || '","label":"' || format('{{:.2f}}', value) || '"}}' as record from panel""",
)
def as_json(spark, folder):
    rows = monthly_panel(spark, folder).select("category", "kpi", "period", F.replace(F.format_number("value", 2), F.lit(","), F.lit("")).alias("label"))
    return sinks.as_json(rows)
