"""Queries of the cell rules over a second messy view, one column per kind of damage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.dataset import ROW, Dataset
from tabloom.functions import text as X
from tabloom.operators import rules as R
from tabloom.operators.personal import personal_columns
from tabloom.operators.profile import profile
from tabloom.plans.queries import SQL_MESS, mess, query, view

_SUM = " + ".join(f"cast(substring(lpad(cast(c_custkey as string), 7, '1'), {i + 1}, 1) as int) * {8 - i}" for i in range(7))
MORE = f"""select c_custkey as id,
  case when c_custkey % 20 = 0 then 'CafÃ© ' || cast(c_custkey as string) else 'Café ' || cast(c_custkey as string) end as place,
  case c_custkey % 10 when 0 then 'Ltd Unit' || cast(c_nationkey as string) when 1 then 'Unit' || cast(c_nationkey as string) || ', Ltd' else 'Unit' || cast(c_nationkey as string) || ' Ltd' end as company,
  case c_custkey % 3 when 0 then 'sw' || cast(c_custkey % 9 + 1 as string) || 'a1aa' when 1 then 'SW' || cast(c_custkey % 9 + 1 as string) || 'A  1AA' else 'SW' || cast(c_custkey % 9 + 1 as string) || 'A 1AA' end as postcode,
  'gb ' || lpad(cast(c_custkey as string), 7, '1') || lpad(cast(case when c_custkey % 4 = 0 then 98 - ({_SUM}) % 97 else 97 - ({_SUM}) % 97 end as string), 2, '0') as vat_number,
  case when c_custkey % 6 = 0 then 'sc' || lpad(cast(c_custkey as string), 6, '0') when c_custkey % 6 = 1 then 'x-' || cast(c_custkey as string) else cast(c_custkey % 1000 as string) end as company_number,
  case when c_custkey % 40 = 3 then '2-Sep' else 'MARK' || cast(c_custkey as string) end as gene,
  case when c_custkey % 50 = 7 then 99999 when c_custkey % 90 = 11 then 5000 else c_custkey % 60 + 10 end as amount
from {{customer}}"""
SQL_MORE = MORE.format(customer="customer")
PLAIN = "trim(regexp_replace({0}, ' +', ' ', 'g'))"


def more(spark: SparkSession, d: str, *columns: str) -> Dataset:
    """The second view, with the named columns alone: a rule reads no other."""
    data = view(spark, d, MORE, "id").named().select("id", *columns)
    return Dataset.of(data, "id")


def _written(rule: str, data: Dataset, column: str) -> DataFrame:
    wide, fixes, _ = R.build(data, profile(data, samples=False))
    i = data.index(column)
    return R.patches(wide, [f for f in fixes if f.rule == rule and f.column == i]).select(F.col(ROW).alias("id"), "before", "after")


def _rule(rule: str, column: str):
    def run(spark, d):
        return _written(rule, more(spark, d, column), column)

    run.__name__ = f"rule_{rule.replace('-', '_')}"
    return run


for _r, _c, _after, _where in (
    ("fix-encoding", "place", "replace(place, 'Ã©', 'é')", "place like '%Ã©%'"),
    ("normalize-postcode", "postcode", "upper(substr(postcode, 1, 4)) || ' 1AA'", "postcode <> upper(substr(postcode, 1, 4)) || ' 1AA'"),
    ("normalize-company-number", "company_number", "case when company_number like 'sc%' then upper(company_number) else lpad(company_number, 8, '0') end", "company_number not like 'x-%'"),
):
    query(f"select id, {_c} as before, {_after} as after from ({SQL_MORE}) where {_where}")(_rule(_r, _c))

_VALID = f"""(select id, vat_number, (({_SUM.replace("c_custkey", "id")}) + cast(substr(vat_number, 11, 2) as int)) as total from ({SQL_MORE}))"""
query(f"select id, vat_number as before, 'GB' || substr(vat_number, 4) as after from {_VALID} where total % 97 = 0 or (total + 55) % 97 = 0")(_rule("normalize-vat", "vat_number"))

query(f"""with v as (select id, {PLAIN.format("company")} as v, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(company), '[^a-z0-9]+'), lambda x: x <> '')), ' ') as k from ({SQL_MORE})),
n as (select k, v, count(*) as n, min(id) as first from v group by all),
w as (select k, arg_max(v, (n, -first)) as w from n group by k having count(distinct lower(v)) > 1)
select id, v as before, w as after from v join w using (k) where lower(v) <> lower(w)""")(_rule("standardise-values", "company"))


@query(f"""with v as (select id, segment, {PLAIN.format("segment")} as v from ({SQL_MESS}) where segment is not null),
n as (select lower(v) as k, v, count(*) as n, cast(regexp_matches(v, '[A-Z]') as int) + cast(regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]') as int) as q, min(id) as first from v group by all),
w as (select k, arg_max(v, (n, q, -first)) as w from n group by k having count(*) > 1)
select id, segment as before, w as after from v join w on lower(v) = k where v <> w""")
def rule_consistent_casing(spark, d):
    return _written("consistent-casing", Dataset.of(mess(spark, d).named().select("id", "segment"), "id"), "segment")


@query(f"""select id, spend as before, case when spend like '(%' then '-' || replace(replace(spend, '(', ''), ')', '') else replace(replace(spend, '£', ''), ',', '') end as after
from ({SQL_MESS}) where spend like '(%' or spend like '£%'""")
def rule_normalize_number(spark, d):
    return _written("normalize-number", Dataset.of(mess(spark, d).named().select("id", "spend"), "id"), "spend")


@query(f"""with m as ({SQL_MORE}) select id, 'invalid-vat' as rule from {_VALID} where not (total % 97 = 0 or (total + 55) % 97 = 0)
union all select id, 'invalid-company-number' from m where company_number like 'x-%'
union all select id, 'invalid-email' from ({SQL_MESS}) where email not like '%@%'""")
def rule_invalid_values(spark, d):
    first = more(spark, d, "vat_number", "company_number")
    second = Dataset.of(mess(spark, d).named().select("id", "email"), "id")
    out = []
    for data in (first, second):
        wide, _, flags = R.build(data, profile(data, samples=False))
        hits = F.array(*[F.when(g.hit, F.lit(g.rule)) for g in flags])
        out.append(wide.df.select(F.col(ROW).alias("id"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("rule")))
    return out[0].unionByName(out[1])


_FAKE = "x in (9999, 99999, 999999, 9999999, 99999999, -1, -99, -999, -9999)"


@query(f"""with v as (select cast(amount as double) as x from ({SQL_MORE})), s as (select list_sort(list(x)) as l, count(*) as n, min(x) as low, avg(x) as mean from v),
q as (select n, l[cast(floor((n - 1) * 0.25) as int) + 1] as q1, l[cast(floor((n - 1) * 0.5) as int) + 1] as middle, l[cast(floor((n - 1) * 0.75) as int) + 1] as q3, low, mean from s),
f as (select *, low > 0 and middle > 0 and mean > 1.5 * middle as logs from q),
o as (select x, {_FAKE} as fake from v, f where case when logs then log10(x) < log10(q1) - 3 * (log10(q3) - log10(q1)) or log10(x) > log10(q3) + 3 * (log10(q3) - log10(q1)) else x < q1 - 3 * (q3 - q1) or x > q3 + 3 * (q3 - q1) end)
select n, q1, middle, q3, (select count(*) from o where fake) as placeholder,
 (select case when count(*) <= greatest(2, 0.1 * (select n from f)) then count(*) else 0 end from o where not fake) as genuine, logs from f""")
def rule_outliers(spark, d):
    data = more(spark, d, "amount")
    g = R.outliers(data, data.index("amount"))
    return spark.createDataFrame([(g["n"], g["q1"], g["median"], g["q3"], g["placeholder"], g["genuine"], g["log"])], "n long, q1 double, middle double, q3 double, placeholder long, genuine long, logs boolean")


@query(f"select count(*) as dates from ({SQL_MORE}) where gene = '2-Sep'")
def rule_excel_dates(spark, d):
    """Cells that a spreadsheet turned into dates, where they are at most a fifth of a column's."""
    data = more(spark, d, "gene")
    c = profile(data, samples=False).columns[data.index("gene")]
    n = c.facts["excel_date"] if 1 <= c.facts["excel_date"] <= 0.2 * c.non_empty else 0
    return spark.createDataFrame([(n,)], "dates long")


_CARD = "'4' || lpad(cast(o_orderkey as {text}), 15, '0')"
_DOUBLED = "cast(substring(card, i, 1) as int) * (case when i % 2 = 1 then 2 else 1 end)"


@query(f"""with c as (select o_orderpriority as priority, {_CARD.format(text='varchar')} as card from orders),
d as (select priority, list_sum(list_transform(range(1, 17), lambda i: ({_DOUBLED}) // 10 + ({_DOUBLED}) % 10)) % 10 = 0 as valid from c)
select priority, count(*) as n, count(*) filter (where valid) as valid from d group by priority""")
def check_card_numbers(spark, d):
    """Sixteen-digit numbers whose check digit holds, of each priority; some are written with spaces."""
    card = F.expr(_CARD.format(text="string"))
    spaced = F.when(F.col("o_orderkey") % 2 == 0, F.regexp_replace(card, r"(\d{4})(?=\d)", "$1 ")).otherwise(card)
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.count_if(X.luhn(spaced)).alias("valid"))


@query("select 'postcode' as name, 'postcodes' as label")
def rule_personal_data(spark, d):
    """Columns with personal data, and which kind."""
    data = more(spark, d, "place", "company", "postcode", "amount")
    found = personal_columns(data, profile(data, samples=False))
    return spark.createDataFrame(list(found.items()), "name string, label string")
