"""Sources, sinks, load checks, profiling and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillscope.functions.numbers import null_nonfinite
from tillscope.operators import matching, panel, profile
from tillscope.plans import ctes, views
from tillscope.plans.registry import query
from tillscope.session import work_folder
from tillscope.sources import csv, sinks
from tillscope.sources.tables import table

# ---------------------------------------------------------------- sources and checks


@query(
    "csv_scan",
    """select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority from orders""",
)
def csv_scan(spark, folder):
    path = work_folder(spark, "orders-csv")
    orders = table(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    orders.write.option("header", True).csv(path)
    return csv.csv_scan(spark, path)


@query(
    "encoding_audit",
    """select lang, case when lang = 'fr' then 'latin1' else 'utf-8' end as encoding, count(*) as rows,
       cast(sum(length(text)) as bigint) as chars
       from (select lang, regexp_replace(text, '[^ -~À-ÿ\n]', ' ', 'g') as text from documents) group by lang""",
)
def encoding_audit(spark, folder):
    """French texts are written in Latin-1, the rest in UTF-8; the encodings are found again from the bytes."""
    path = work_folder(spark, "encodings")
    docs = table(spark, folder, "documents").select(
        "lang", F.regexp_replace("text", "[^ -~À-ÿ\\n]", " ").alias("text"), F.col("lang").alias("folder")
    )
    options = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    for name, part in (("ISO-8859-1", F.col("lang") == "fr"), ("UTF-8", F.col("lang") != "fr")):
        docs.where(part).write.mode("append").partitionBy("folder").options(encoding=name, **options).csv(path)
    kinds = csv.encoding_audit(spark, path)
    language = F.regexp_extract("file", "folder=([^/]+)/", 1)
    found = kinds.groupBy(language.alias("lang")).agg(F.max("encoding").alias("encoding"))
    rows = csv.csv_scan_any(
        spark, path, "lang string, text string", escape='"', multiLine=True, lineSep="\n",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    counts = rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars")
    )
    return counts.join(found, "lang").select("lang", "encoding", "rows", "chars")


@query(
    "csv_broken_rows",
    """select 'orders' as "table", count(*) as rows, count_if(o_orderkey % 97 = 0) as corrupt_rows, 'corrupt rows' as status,
    false as loadable from orders""",
)
def csv_broken_rows(spark, folder):
    """Some prices are no numbers: the scan keeps their rows as text beside nulls, and the check counts them."""
    path = work_folder(spark, "broken-csv")
    price = F.when(F.col("o_orderkey") % 97 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    table(spark, folder, "orders").select("o_orderkey", price.alias("price"), "o_orderstatus").write.option("header", True).csv(path)
    rows = csv.csv_scan(spark, path, "o_orderkey long, price double, o_orderstatus string", corrupt="_corrupt")
    return csv.load_checks(rows, "orders", corrupt="_corrupt")


@query(
    "csv_split_records",
    """select count(*) as records, sum(length(text)) as chars, true as open_lines from documents""",
)
def csv_split_records(spark, folder):
    """Texts with line breaks inside quotes: the check finds open lines, and a multi-line scan reads every record whole."""
    path = work_folder(spark, "multiline-csv")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    docs.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    opened = csv.split_records(spark, path).agg((F.sum("open_lines") > 0).alias("open")).scalar()
    rows = csv.csv_scan(
        spark, path, "doc_id long, text string", escape='"', multiLine=True, lineSep="\n",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return rows.agg(F.count("doc_id").alias("records"), F.sum(F.length("text")).alias("chars")).withColumn("open_lines", opened)


CHECKED = ("region", "customer", "part", "orders", "lineitem", "events", "documents")


@query(
    "load_checks",
    " union all ".join(
        f"select '{t}' as \"table\", count(*) as rows, case when count(*) = 0 then 'empty' "
        f"when count(*) > 50000 then 'more rows than usual' else 'ok' end as status, count(*) >= 1 as loadable from {t}"
        for t in CHECKED
    ),
)
def load_checks(spark, folder):
    out = None
    for name in CHECKED:
        one = csv.load_checks(table(spark, folder, name), name, max_rows=50_000)
        out = one if out is None else out.unionByName(one)
    return out


_NUMERIC = ("row_id", "order_id", "customer_id", "purchase_amount", "quantity", "review_rating")


@query(
    "validate_numeric",
    f"with {ctes.MESSY} "
    + " union all ".join(
        f"""select '{c}' as "column", count(*) - count({c}) as missing, count_if({c} < 0) as negative,
        case when count(*) > count({c}) then 'contains missing values'
             when count_if({c} < 0) > 0 then 'contains negative values' end as problem from messy"""
        for c in _NUMERIC
    ),
)
def validate_numeric(spark, folder):
    return profile.validate_numeric(views.messy_orders(spark, folder))


@query(
    "validate_dates",
    f"""with {ctes.MESSY}, bad as (select row_id, order_date from messy where {ctes.parse('order_date')} is null)
    select (select count(*) from messy) as rows, (select count(*) from bad) as invalid,
    (select count(*) from bad) = 0 as valid,
    (select string_agg(order_date, ', ' order by row_id) from (select * from bad order by row_id limit 5)) as examples""",
)
def validate_dates(spark, folder):
    return profile.validate_dates(views.messy_orders(spark, folder), "order_date", "row_id")


@query(
    "load_metadata",
    """select 'orders.parquet' as filename, count(*) as row_count, 6 as column_count, 'o_orderdate' as date_column,
    strftime(min(o_orderdate), '%Y-%m-%d') as date_start, strftime(max(o_orderdate), '%Y-%m-%d') as date_end,
    'o_orderkey:bigint, o_custkey:bigint, o_orderstatus:string, o_totalprice:double, o_orderdate:timestamp_ntz, o_orderpriority:string'
    as column_types from orders""",
)
def load_metadata(spark, folder):
    return csv.load_metadata(table(spark, folder, "orders"), "o_orderdate")


@query(
    "preview",
    f"""with {ctes.MESSY} select cast(row_id as varchar) as row_id, cast(order_id as varchar) as order_id,
    coalesce(product_category, '') as product_category,
    coalesce(cast(cast(purchase_amount as decimal(18,2)) as varchar), '') as purchase_amount,
    coalesce(payment_method, '') as payment_method, order_date from messy order by messy.row_id limit 5""",
)
def preview(spark, folder):
    rows = views.messy_orders(spark, folder).select(
        "row_id", "order_id", "product_category", F.col("purchase_amount").cast("decimal(18,2)").alias("purchase_amount"),
        "payment_method", "order_date",
    )
    return profile.preview(rows, "row_id")


_SAMPLED = ("order_id", "product_category", "quantity", "payment_method", "order_date")


@query(
    "sample_values",
    f"with {ctes.MESSY}, cells as ("
    + " union all ".join(
        f"select '{c}' as \"column\", row_id, cast({c} as varchar) as value from messy where {c} is not null"
        for c in _SAMPLED
    )
    + """) select "column", position, value from (select "column", value,
    cast(row_number() over (partition by "column" order by row_id) as int) as position from cells) where position <= 3""",
)
def sample_values(spark, folder):
    rows = views.messy_orders(spark, folder).select("row_id", *_SAMPLED)
    return profile.sample_values(rows, "row_id", columns=6).where(F.col("column") != "row_id")


@query(
    "override_union",
    """with base as (select c_custkey as key, cast(c_acctbal as decimal(18,2)) as amount from customer),
    newer as (select o_custkey as key, sum(cast(o_totalprice as decimal(18,2))) as amount from orders group by 1)
    select key, cast(amount as double) as amount, 'orders' as origin from newer union all
    select key, cast(amount as double), 'customer' from base where key not in (select key from newer)""",
)
def override_union(spark, folder):
    base = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").cast("double").alias("amount"), F.lit("customer").alias("origin")
    )
    newer = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("key")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount"), F.lit("orders").alias("origin")
    )
    return matching.override_union(base, newer, "key")


@query(
    "supplement_union",
    """select p_partkey as key, p_name as label from part union all
    select o_orderkey, o_orderstatus from orders where o_orderkey not in (select p_partkey from part)""",
)
def supplement_union(spark, folder):
    base = table(spark, folder, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("label"))
    extra = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("label"))
    return matching.supplement_union(base, extra, "key")


@query(
    "latest_by_key",
    """select o_custkey as customer, o_orderkey as order_id, o_orderstatus as status from orders
    qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1""",
)
def latest_by_key(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status")
    )
    return matching.latest_by_key(orders, "customer", "order_id")


@query(
    "kpi_summary",
    f"""with {ctes.panel()} select period, '{{' || string_agg('"' || kpi || '":' ||
    cast(cast(value as decimal(38,4)) as varchar), ',' order by kpi) || '}}' as summary from panel group by period""",
)
def kpi_summary(spark, folder):
    return sinks.kpi_summary(panel.kpi_panel(views.sales(spark, folder), "order_date", "month"))


@query(
    "null_nonfinite",
    """select event_id, case when event_id % 11 in (0, 1, 2) then null else value end as value,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts,
    coalesce(case when event_id % 11 = 3 then null else cast(value as varchar) end, 'null') as item from events""",
)
def null_nonfinite_query(spark, folder):
    bad = F.expr(
        "case event_id % 11 when 0 then double('NaN') when 1 then double('Infinity') when 2 then double('-Infinity') "
        "else value end"
    )
    events = table(spark, folder, "events").select(
        "event_id", bad.alias("value"), "ts", F.expr("array(if(event_id % 11 = 3, double('NaN'), value))").alias("items")
    )
    clean = null_nonfinite(events)
    item = F.coalesce(F.get("items", F.lit(0)).cast("string"), F.lit("null"))
    return clean.select("event_id", "value", "ts", item.alias("item"))


# ---------------------------------------------------------------- profiling


def _profile_sql() -> str:
    parts = []
    for i, c in enumerate(("row_id", *ctes.MESSY_COLUMNS)):
        number = c in _NUMERIC
        stats = (
            f"cast(min({c}) as double), cast(max({c}) as double), round(avg({c}), 6), round(median({c}), 6), round(stddev_samp({c}), 4)"
            if number
            else "null, null, null, null, null"
        )
        parts.append(
            f"select {i} as ordinal, '{c}' as \"column\", count(*) as rows, count(*) - count({c}) as null_count, "
            f"{ctes.rounded(f'(count(*) - count({c})) / count(*) * 100', 2)} as null_pct, count(distinct {c}) as unique_count, "
            f"{ctes.rounded(f'count(distinct {c}) / count(*) * 100', 2)} as unique_pct, {stats} from messy"
        )
    names = '(ordinal, "column", rows, null_count, null_pct, unique_count, unique_pct, min, max, mean, median, std)'
    return f"with {ctes.MESSY}, p{names} as ({' union all '.join(parts)}) select * from p"


@query("profile_columns", _profile_sql())
def profile_columns(spark, folder):
    out = profile.profile_columns(views.messy_orders(spark, folder)).drop("dtype")
    return out.withColumns(
        {"mean": F.round("mean", 6), "median": F.round("median", 6), "std": F.round("std", 4)}
    )


_TOP = ("product_category", "payment_method", "order_date")


@query(
    "top_values",
    f"with {ctes.MESSY}, v as ("
    + " union all ".join(
        f"select '{c}' as \"column\", {c} as value, count(*) as count from messy where {c} is not null group by {c}"
        for c in _TOP
    )
    + """) select "column", value, count, cast(row_number() over (partition by "column" order by count desc, value) as int)
    as rank from v qualify row_number() over (partition by "column" order by count desc, value) <= 5""",
)
def top_values(spark, folder):
    return profile.top_values(views.messy_orders(spark, folder))


def _semantic_sql(name: str) -> str:
    cases = " ".join(
        f"when regexp_matches(lower({name}), '{'|'.join(words)}') then '{kind}'"
        for kind, words in profile.SEMANTIC_KEYWORDS
    )
    return f"""case {cases} when unique_ratio > 0.95 then 'identifier' when unique_ratio < 0.05 then 'categorical'
    when "numeric" then 'numeric' else 'categorical' end"""


@query(
    "semantic_type",
    f"""with {ctes.CATALOGUE} select "table", ordinal, "column", {_semantic_sql('"column"')} as semantic_type from catalogue""",
)
def semantic_type(spark, folder):
    kind = profile.semantic_type(F.col("column"), F.col("unique_ratio"), F.col("numeric"))
    return views.catalogue(spark, folder).select("table", "ordinal", "column", kind.alias("semantic_type"))


@query(
    "semantic_types_of_table",
    """with o as (select count(*) as n, count(distinct o_orderstatus) as s, count(distinct o_orderpriority) as p from orders)
    select * from (values (0, 'o_orderkey'), (1, 'o_custkey'), (3, 'o_totalprice'), (4, 'o_orderdate')) v(ordinal, "column"),
    lateral (select case "column" when 'o_orderkey' then 'identifier' when 'o_custkey' then
    (select case when count(distinct o_custkey) / count(*) > 0.95 then 'identifier' when count(distinct o_custkey) / count(*) < 0.05
     then 'categorical' else 'numeric' end from orders) when 'o_totalprice' then 'revenue' else 'date' end as semantic_type)
    union all select 2, 'o_orderstatus', case when s / n < 0.05 then 'categorical' else 'categorical' end from o
    union all select 5, 'o_orderpriority', 'categorical' from o""",
)
def semantic_types_of_table(spark, folder):
    return profile.semantic_types(table(spark, folder, "orders")).drop("dtype")


@query(
    "coarse_type",
    f"""with {ctes.MESSY} select * from (values (0, 'row_id', 'numeric'), (1, 'order_id', 'numeric'), (2, 'customer_id', 'numeric'),
    (3, 'product_category', null), (4, 'purchase_amount', 'numeric'), (5, 'quantity', 'numeric'), (6, 'review_rating', 'numeric'),
    (7, 'payment_method', null), (8, 'order_date', null)) v(ordinal, "column", t),
    lateral (select coalesce(t, case "column"
    when 'product_category' then (select case when count(distinct product_category) / count(*) < 0.2 then 'categorical' else 'text' end from messy)
    when 'payment_method' then (select case when count(distinct payment_method) / count(*) < 0.2 then 'categorical' else 'text' end from messy)
    else (select case when count_if({ctes.parse('order_date')} is null) = 0 then 'date'
          when count(distinct order_date) / count(*) < 0.2 then 'categorical' else 'text' end from messy) end) as coarse_type)""".replace(
        "select * from", 'select ordinal, "column", coarse_type from'
    ),
)
def coarse_type(spark, folder):
    return profile.coarse_types(views.messy_orders(spark, folder))


_DATE_TEXTS = {
    "iso": ("date_format(ts, 'yyyy-MM-dd')", "strftime(ts, '%Y-%m-%d')"),
    "day_first": ("date_format(ts, 'dd/MM/yyyy')", "strftime(ts, '%d/%m/%Y')"),
    "month_first": ("date_format(ts, 'MM/dd/yyyy')", "strftime(ts, '%m/%d/%Y')"),
    "dashes": ("date_format(ts, 'MM-dd-yyyy')", "strftime(ts, '%m-%d-%Y')"),
    "compact": ("date_format(ts, 'yyyyMMdd')", "strftime(ts, '%Y%m%d')"),
    "mixed": (
        "if(event_id % 2 = 0, date_format(ts, 'yyyy-MM-dd'), date_format(ts, 'yyyy/MM/dd'))",
        "case when event_id % 2 = 0 then strftime(ts, '%Y-%m-%d') else strftime(ts, '%Y/%m/%d') end",
    ),
}
_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y", "%Y%m%d", "%d%m%Y", "%m%d%Y")


def _format_sql() -> str:
    parts = []
    for name, (_, sql) in _DATE_TEXTS.items():
        cases = " ".join(f"when count(try_strptime(x, '{f}')) = count(x) then '{f}'" for f in _FORMATS)
        parts.append(f"select '{name}' as \"column\", case {cases} end as format from (select {sql} as x from events)")
    return " union all ".join(parts)


@query("infer_date_format", _format_sql())
def infer_date_format(spark, folder):
    events = table(spark, folder, "events").select(*[F.expr(sql).alias(n) for n, (sql, _) in _DATE_TEXTS.items()])
    return profile.infer_date_formats(events, list(_DATE_TEXTS))


@query(
    "detect_time_column",
    f"""with {ctes.MESSY} select case when count({ctes.parse('order_date')}) > count(*) * 0.5 then 'order_date' end
    as time_column from messy""",
)
def detect_time_column(spark, folder):
    return profile.time_columns(views.messy_orders(spark, folder))


@query(
    "normalize_names",
    f"""with {ctes.CATALOGUE}, n as (select "table", "column", {ctes.normalize('"column"')} as normalized from catalogue)
    select *, count(*) over (partition by "table", normalized) as sharing from n""",
)
def normalize_names(spark, folder):
    return matching.normalize_names(views.catalogue(spark, folder))


@query(
    "metric_columns",
    f"""with {ctes.CATALOGUE} select "table", ordinal, "column", "numeric",
    not (regexp_matches(lower("column"), 'date|time|timestamp|day|month|year') or temporal) as countable from catalogue""",
)
def metric_columns(spark, folder):
    return profile.metric_columns(views.catalogue(spark, folder)).select("table", "ordinal", "column", "numeric", "countable")


@query(
    "classify_dataset",
    f"""with {ctes.CATALOGUE}, n as (select "table" as dataset, ordinal, {ctes.normalize('"column"')} as name from catalogue),
    m as (select *, regexp_matches(name, '{'|'.join(matching.STRONG_TERMS)}') as s,
    regexp_matches(name, '{'|'.join(matching.AMBIGUOUS_TERMS)}') as a from n),
    g as (select dataset, count(*) as columns, count_if(s) as strong, count_if(a) as ambiguous,
    coalesce(string_agg(case when s then name end, ', ' order by ordinal), '') as matched from m group by dataset)
    select *, case when strong >= columns / 2 then true when strong = 0 and ambiguous = 0 then false else strong > 0 end as is_sales,
    case when strong >= columns / 2 then 'strong terms in half of the columns' when strong = 0 and ambiguous = 0
    then 'no sales terms' else strong || ' strong term(s)' end as reason from g""",
)
def classify_dataset(spark, folder):
    return matching.classify_datasets(views.catalogue(spark, folder))


# ---------------------------------------------------------------- matching

FUZZY_TARGETS = ("small bolt", "red gear", "gizmo large", "hot plate", "widget blue", "old ring")


def lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence as a fold over the letters of ``a``; each step is one table row."""
    return (
        f"list_last(list_reduce(list_concat([list_transform(range(len({b}) + 1), lambda z: 0)], "
        f"list_transform(range(len({a})), lambda i: [cast(i as int)])), "
        f"lambda row, step: list_reduce(list_concat([[0]], list_transform(range(len({b})), lambda j: [cast(j as int)])), "
        f"lambda acc, j: list_append(acc, case when {a}[step[1] + 1] = {b}[j[1] + 1] then row[j[1] + 1] + 1 "
        f"else greatest(row[j[1] + 2], list_last(acc)) end))))"
    )


def token_ratio_sql(left: str, right: str, source: str, keep: str) -> str:
    """CTE body: ``keep`` columns and the word-set score of two text columns."""
    words = lambda c: f"list_sort(list_distinct(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')))"
    return f"""select {keep}, case when len(ta) = 0 or len(tb) = 0 then 0.0
      when len(s) > 0 and (len(da) = 0 or len(db) = 0) then 100.0
      when len(s) = 0 then 100.0 * (1 - (len(da) + len(db) - 2 * lcs) / (len(da) + len(db)))
      else greatest(100.0 * (1 - (len(da) + len(db) - 2 * lcs) / (2 * (len(s) + 1) + len(da) + len(db))),
                    100.0 * (1 - (1 + len(da)) / (2 * len(s) + 1 + len(da))),
                    100.0 * (1 - (1 + len(db)) / (2 * len(s) + 1 + len(db)))) end as score
      from (select *, case when len(da) = 0 or len(db) = 0 then 0 else {lcs_sql('da', 'db')} end as lcs from (
        select *, array_to_string(list_filter(ta, lambda w: list_contains(tb, w)), ' ') as s,
        array_to_string(list_filter(ta, lambda w: not list_contains(tb, w)), ' ') as da,
        array_to_string(list_filter(tb, lambda w: not list_contains(ta, w)), ' ') as db
        from (select *, {words(left)} as ta, {words(right)} as tb from {source})))"""


def _values(names) -> str:
    return "(values " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(names)) + ") t(pos, target)"


@query(
    "fuzzy_match",
    f"""with pairs as (select * from (select p_name as name, count(*) as rows from part group by 1), {_values(FUZZY_TARGETS)}),
    scored as ({token_ratio_sql('name', 'target', 'pairs', 'name, rows, pos, target')})
    select name, rows, case when score >= 75 then target end as match, round(score, 6) as score from scored
    qualify row_number() over (partition by name order by score desc, pos) = 1""",
)
def fuzzy_match(spark, folder):
    out = matching.fuzzy_match(table(spark, folder, "part"), "p_name", FUZZY_TARGETS)
    return out.withColumn("score", F.round("score", 6))


_PAIRS = f"""names as (select distinct {ctes.normalize('"column"')} as name from catalogue),
    pairs as (select * from names, {_values(matching.SALES_SYNONYMS)}),
    scored as ({token_ratio_sql('target', 'name', 'pairs', 'name, pos, target')}),
    best as (select "table" as dataset, ordinal, "column", pos, target, score from catalogue
      join scored on scored.name = {ctes.normalize('catalogue."column"')}
      qualify row_number() over (partition by "table", pos order by score desc, ordinal) = 1)"""


@query(
    "best_columns",
    f"""with {ctes.CATALOGUE}, {_PAIRS} select dataset, cast(pos as int) as position, target,
    case when score >= 55 then "column" end as "column", round(score, 6) as score from best""",
)
def best_columns(spark, folder):
    out = matching.best_columns(views.catalogue(spark, folder), matching.SALES_SYNONYMS, threshold=55)
    return out.withColumn("score", F.round("score", 6))


@query(
    "find_sales_column",
    f"""with {ctes.CATALOGUE}, {_PAIRS}, good as (select * from best where score >= 80
    qualify row_number() over (partition by dataset order by score desc, pos) = 1)
    select d.dataset, "column", target as synonym, round(score, 6) as score
    from (select distinct "table" as dataset from catalogue) d left join good on good.dataset = d.dataset""",
)
def find_sales_column(spark, folder):
    out = matching.find_sales_column(views.catalogue(spark, folder))
    return out.withColumn("score", F.round("score", 6))


@query(
    "cosine_match",
    """with q as (select vec_id, cast(embedding as double[]) as v from embeddings where label < 5),
    c as (select vec_id as cid, cast(embedding as double[]) as w from embeddings where label >= 5),
    s as (select vec_id, cid, list_cosine_similarity(v, w) as score from q, c)
    select vec_id, case when score >= 0.8 then cid end as match, round(score, 6) as score from s
    qualify row_number() over (partition by vec_id order by score desc, cid) = 1""",
)
def cosine_match(spark, folder):
    vectors = table(spark, folder, "embeddings")
    out = matching.cosine_match(vectors.where("label < 5"), vectors.where("label >= 5"), "vec_id", "embedding")
    return out.withColumn("score", F.round("score", 6))


_KPI_RULES = {
    m.name: (m.roles, m.needs) for m in matching.METRICS
}


def _applicable_sql() -> str:
    flag = lambda role: f"coalesce(bool_or(role = '{role}' and \"column\" is not null), false)"
    parts = []
    for name, (roles, needs) in _KPI_RULES.items():
        every = {r for n in (name, *needs) for r in _KPI_RULES[n][0]}
        test = " and ".join(flag(r) for r in sorted(every))
        parts.append(f"select dataset, '{name}' as kpi, {str(bool(needs)).lower()} as derived, {test} as calculable from mapping group by dataset")
    return f"with {ctes.ROLE_MAPPING}, applicability as ({' union all '.join(parts)}) "


@query("metric_applicability", _applicable_sql() + "select * from applicability")
def metric_applicability(spark, folder):
    return matching.metric_applicability(views.role_mapping(spark, folder))


@query(
    "match_rate",
    _applicable_sql()
    + """select dataset, count_if(calculable) as calculable, round(avg(cast(calculable as int)), 6) as match_rate,
    avg(cast(calculable as int)) < 0.3 as needs_supplement from applicability group by dataset""",
)
def match_rate(spark, folder):
    out = matching.match_rate(matching.metric_applicability(views.role_mapping(spark, folder)))
    return out.withColumn("match_rate", F.round("match_rate", 6))


@query(
    "time_coverage",
    """select 'month' as unit, count(distinct date_trunc('month', o_orderdate)) as periods,
    count(distinct date_trunc('month', o_orderdate)) >= 2 as enough from orders union all
    select 'week', count(distinct date_trunc('week', ts)), count(distinct date_trunc('week', ts)) >= 2 from events""",
)
def time_coverage(spark, folder):
    months = profile.time_coverage(table(spark, folder, "orders"), "o_orderdate", "month")
    return months.unionByName(profile.time_coverage(table(spark, folder, "events"), "ts", "week"))
