"""Registered queries of the table operators, and the SQL that they are held against.

The driver's tables are clean, so MESS renders a deterministic messy view of customers in SQL that both engines read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.dataset import ROW, Dataset
from tabloom.operators import constraints as C
from tabloom.operators import reshape as S
from tabloom.operators import rules as R
from tabloom.operators.aggregate import Aggregation, group_by
from tabloom.operators.diff import diff_tables
from tabloom.operators.join import join_tables, key_rates
from tabloom.operators.profile import profile, profile_frame, top_values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MESS = """select c_custkey as id,
  case c_custkey % 7 when 0 then '  ' || c_name when 1 then upper(c_name) when 2 then 'N/A' when 3 then null when 4 then replace(c_name, '#', '  #') else c_name end as name,
  case c_custkey % 5 when 0 then '£' || cast(c_custkey as string) || ',000' when 1 then '(' || cast(c_custkey as string) || ')' when 2 then 'pending' when 3 then '' else cast(c_custkey as string) end as spend,
  case c_custkey % 4 when 0 then lower(c_mktsegment) when 1 then c_mktsegment || ' ' when 2 then null else c_mktsegment end as segment,
  case when c_custkey % 9 = 0 then 'YES' when c_custkey % 3 = 0 then 'yes' else 'no' end as active,
  lpad(cast(c_custkey % 28 + 1 as string), 2, '0') || '/0' || cast(c_custkey % 9 + 1 as string) || '/2024' as joined_date,
  case c_custkey % 3 when 0 then 'User' || cast(c_custkey as string) || '@Mail.COM' when 1 then ' user' || cast(c_custkey as string) || '@mail.com' else 'nobody' end as email,
  '07700' || lpad(cast(c_custkey as string), 6, '9') as phone,
  lpad(cast(c_custkey % 1000000 as string), 6, '1') as sort_code
from {customer}"""
LEFT = "select o_orderkey as id, case o_custkey % 4 when 0 then ' Cust-' || cast(o_custkey as string) when 1 then 'CUST-' || cast(o_custkey as string) when 2 then 'cust' || cast(o_custkey as string) else null end as ck, o_orderstatus as status from {orders}"
RIGHT = "select c_custkey as cid, 'cust-' || cast(c_custkey as string) as ck, c_mktsegment as segment from {customer} where c_custkey % 5 <> 0"
MUTATED = "select c_custkey, case when c_custkey % 10 = 3 then c_name || 'x' else c_name end as c_name, c_mktsegment, c_nationkey from {customer} where c_custkey % 11 <> 0 union all select c_custkey + 10000000, c_name, c_mktsegment, c_nationkey from {customer} where c_custkey % 50 = 1"
SQL_MESS, SQL_LEFT, SQL_RIGHT, SQL_MUTATED = (x.format(customer="customer", orders="orders") for x in (MESS, LEFT, RIGHT, MUTATED))
MISSING = "(trim(coalesce({0}, '')) = '' or lower(trim({0})) in ('na', 'n/a', 'n.a.', '#n/a', '#na', 'null', 'none', 'nan', 'nil', '-', '--'))"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def view(spark: SparkSession, d: str, sql: str, order: str) -> Dataset:
    tables = {t: read(spark, d, t) for t in ("customer", "orders") if "{" + t + "}" in sql}
    return Dataset.of(spark.sql(sql, **tables), order)


def mess(spark: SparkSession, d: str) -> Dataset:
    return view(spark, d, MESS, "id")


def table(spark: SparkSession, d: str, name: str, order: str) -> Dataset:
    return Dataset.of(read(spark, d, name), order)


@query("""select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as average, min(o_totalprice) as low, max(o_totalprice) as high from orders group by 1""")
def agg_group_basic(spark, d):
    a = [Aggregation("count", None, "n"), *[Aggregation(k, "o_totalprice", n) for k, n in (("sum", "total"), ("mean", "average"), ("min", "low"), ("max", "high"))]]
    g = group_by(table(spark, d, "orders", "o_orderkey"), ["o_orderpriority"], a).table.named()
    return g.withColumns({"total": F.round("total", 2), "average": F.round("average", 4)})


@query("select l_returnflag, median(l_quantity) as middle from lineitem group by 1")
def agg_median(spark, d):
    return group_by(table(spark, d, "lineitem", "l_orderkey"), ["l_returnflag"], [Aggregation("median", "l_quantity", "middle")]).table.named()


@query(f"""with m as ({SQL_MESS}), k as (select *, case when {MISSING.format("segment")} then null else lower(trim(segment)) end as key from m)
select arg_min(case when key is null then null else segment end, id) filter (key is not null) as segment, count(*) as n, count(distinct case when not {MISSING.format("name")} then lower(trim(name)) end) as names from k group by key""")
def agg_count_distinct(spark, d):
    return group_by(mess(spark, d), ["segment"], [Aggregation("count", None, "n"), Aggregation("count-distinct", "name", "names")]).table.named()


@query(f"""with m as ({SQL_MESS}), v as (select active, spend, case when spend like '(%' then -cast(replace(replace(spend, '(', ''), ')', '') as double)
 else try_cast(replace(replace(spend, '£', ''), ',', '') as double) end as x from m)
select min(active) as k, sum(x) as total, count(*) filter (trim(spend) <> '' and x is null) as ignored from v group by lower(active)""")
def agg_money_text(spark, d):
    s = group_by(mess(spark, d), ["active"], [Aggregation("sum", "spend", "total")]).source
    return s.select(F.when(F.col("_key0") == "yes", "YES").otherwise(F.col("_key0")).alias("k"), F.col("_value0").alias("total"), F.col("_ignored0").alias("ignored"))


@query("select count(*) as n, round(sum(value), 4) as total from events")
def agg_global(spark, d):
    return group_by(table(spark, d, "events", "event_id"), [], [Aggregation("count", None, "n"), Aggregation("sum", "value", "total")]).table.named().withColumn("total", F.round("total", 4))


def _joined(kind: str):
    def run(spark, d):
        return join_tables(view(spark, d, LEFT, "id"), view(spark, d, RIGHT, "cid"), kind, [("ck", "ck")]).table.named()

    run.__name__ = f"join_{kind}"
    key = "coalesce(l.ck, r.ck)" if kind == "full" else "l.ck"
    return query(f"""select l.id, {key} as ck, l.status, r.cid, r.segment from ({SQL_LEFT}) l {kind} join ({SQL_RIGHT}) r on lower(trim(l.ck)) = r.ck""")(run)


for _kind in ("inner", "left", "full"):
    _joined(_kind)


@query(f"""with h as (select l.id, max(case when l.ck = r.ck then 1 else 0 end) as e, max(case when trim(l.ck) = r.ck then 1 else 0 end) as s from ({SQL_LEFT}) l join ({SQL_RIGHT}) r on lower(trim(l.ck)) = r.ck group by 1)
select count(*) filter (e = 1) as exact, count(*) filter (e = 0 and s = 1) as whitespace_only, count(*) filter (e = 0 and s = 0) as case_only from h""")
def join_provenance(spark, d):
    p = join_tables(view(spark, d, LEFT, "id"), view(spark, d, RIGHT, "cid"), "left", [("ck", "ck")]).provenance()
    return spark.createDataFrame([tuple(p.values())], ", ".join(f"{k} long" for k in p))


@query(f"""with m as (select l.id, l.ck from ({SQL_LEFT}) l left join ({SQL_RIGHT}) r on lower(trim(l.ck)) = r.ck where r.ck is null)
select id, case when m.ck is null then 'empty-key' when p.k is not null then 'punctuation' else 'absent' end as reason
from m left join (select distinct replace(ck, '-', '') as k from ({SQL_RIGHT})) p on replace(lower(trim(m.ck)), '-', '') = p.k""")
def join_miss_reasons(spark, d):
    return join_tables(view(spark, d, LEFT, "id"), view(spark, d, RIGHT, "cid"), "left", [("ck", "ck")]).unmatched_left().select(F.col(ROW).alias("id"), "reason")


@query("select c_custkey as id, count(*) as matches from customer join orders on c_custkey = o_custkey group by 1 having count(*) > 1")
def join_fan_out(spark, d):
    l, r = table(spark, d, "customer", "c_custkey"), table(spark, d, "orders", "o_orderkey")
    return join_tables(l, r, "left", [("c_custkey", "o_custkey")]).fan_out().select(F.col(ROW).alias("id"), "matches")


@query()
def join_key_rates(spark, d):
    return spark.createDataFrame(key_rates(table(spark, d, "customer", "c_custkey"), view(spark, d, MUTATED, "c_custkey")), "header string, rate double")


@query("""select c_custkey, split_part(c_name, '#', 1) as c_name_1, split_part(c_name, '#', 2) as c_name_2, c_mktsegment from customer""")
def split_text(spark, d):
    data = Dataset.of(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    return S.split_column(data, 1, "#", ["c_name_1", "c_name_2"]).named()


@query("select p_partkey, concat_ws(' / ', p_brand, p_type) as kind, p_size from part")
def merge_cols(spark, d):
    return S.merge_columns(Dataset.of(read(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"), "p_partkey"), [1, 2], " / ", "kind").named()


@query("""select r_name as nation, 'n' as "Field", 1 as "Value" from region where false
union all select n_name, 'n_nationkey', n_nationkey from nation union all select n_name, 'n_regionkey', n_regionkey from nation""")
def unpivot_cols(spark, d):
    data = Dataset.of(read(spark, d, "nation").select(F.col("n_name").alias("nation"), "n_nationkey", "n_regionkey", F.col("n_nationkey").alias("_o")).select("nation", "n_nationkey", "n_regionkey"), "n_nationkey")
    return S.unpivot(data, [1, 2]).named()


@query("""select p_partkey as id, p_brand as before, replace(p_brand, 'Brand', '$B\\') as after from part where p_brand like '%Brand%'""")
def find_replace(spark, d):
    data = Dataset.of(read(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    return S.find_replace(data, S.Search("bRAND", "$B\\")).select(F.col(ROW).alias("id"), "before", "after")


@query("select n_nationkey, n_regionkey from nation where n_nationkey not in (3, 5, 7)")
def delete_rows_and_column(spark, d):
    return S.delete_column(S.delete_rows(table(spark, d, "nation", "n_nationkey"), [3, 5, 7, -1]), 1).named()


_PROFILED = ["name", "spend", "segment", "active", "email"]


@query(f"with m as ({SQL_MESS}) " + " union all ".join(f"""select '{c}' as "column", count(*) as rows, count(*) filter (not {MISSING.format(c)}) as non_empty, count(*) filter ({MISSING.format(c)}) as empty,
 count(*) filter ({MISSING.format(c)} and trim(coalesce({c}, '')) <> '') as sentinels, count(distinct case when not {MISSING.format(c)} then lower(trim({c})) end) as distinct_values from m""" for c in _PROFILED))
def profile_columns(spark, d):
    p = profile_frame(mess(spark, d)).filter(F.col("column").isin(_PROFILED))
    return p.select("column", "rows", "non_empty", "empty", "sentinels", F.col("distinct").alias("distinct_values"))


@query("""with l as (select 'p_brand' as "column", p_brand as value from part union all select 'p_type', p_type from part),
c as (select "column", value, count(*) as n from l group by 1, 2), r as (select *, cast(row_number() over (partition by "column" order by n desc, value) as integer) as rank from c)
select * from r where rank <= 3""")
def profile_top_values(spark, d):
    return top_values(Dataset.of(read(spark, d, "part").select("p_brand", "p_type", "p_partkey").withColumnRenamed("p_partkey", "k"), "k")).filter("column <> 'k'")


def _patches(rule: str, column: str):
    def run(spark, d):
        data = mess(spark, d)
        wide, fixes, _ = R.build(data, profile(data, samples=False))
        i = data.index(column)
        return R.patches(wide, [f for f in fixes if f.rule == rule and f.column == i]).select(F.col(ROW).alias("id"), "before", "after")

    run.__name__ = f"rule_{rule.replace('-', '_')}"
    return run


for _rule, _column, _after, _where in (
    ("trim-whitespace", "name", "trim(regexp_replace(name, ' +', ' ', 'g'))", "trim(regexp_replace(name, ' +', ' ', 'g')) <> name"),
    ("normalize-missing", "name", "cast(null as string)", "name = 'N/A'"),
    ("normalize-boolean", "active", "'yes'", "active = 'YES'"),
    ("normalize-date", "joined_date", "substr(joined_date, 7, 4) || '-' || substr(joined_date, 4, 2) || '-' || substr(joined_date, 1, 2)", "true"),
    ("normalize-email", "email", "lower(trim(email))", "email like '%@%' and lower(trim(email)) <> email"),
    ("normalize-phone", "phone", "'+44 ' || substr(phone, 2, 4) || ' ' || substr(phone, 6, 6)", "true"),
    ("normalize-sort-code", "sort_code", "substr(sort_code, 1, 2) || '-' || substr(sort_code, 3, 2) || '-' || substr(sort_code, 5, 2)", "true"),
):
    query(f"select id, {_column} as before, {_after} as after from ({SQL_MESS}) where {_where}")(_patches(_rule, _column))


@query(f"""with m as ({SQL_MESS}), k as (select id, lower(trim(regexp_replace(coalesce(segment, ''), ' +', ' ', 'g'))) || '|' || active as key, segment, active from m)
select id, min(id) over (partition by lower(key)) as duplicate_of from k qualify id > min(id) over (partition by lower(key))""")
def dedupe_key(spark, d):
    return R.duplicates(mess(spark, d), ["segment", "active"]).select(F.col(ROW).alias("id"), "duplicate_of")


@query(f"""with m as ({SQL_MESS}) select
 (select count(*) from m where trim(coalesce(name, '')) = '') as not_null, (select count(*) from m where email <> '' and not regexp_matches(email, '@')) as regex,
 (select count(*) from m where id < 10 or id > 1000) as range, (select count(*) from m where active not in ('yes', 'YES')) as allowed,
 (select sum(n - 1)::bigint from (select count(*) as n from m where trim(coalesce(segment, '')) <> '' group by lower(trim(segment)))) as uniques""")
def constraint_counts(spark, d):
    c = [C.Constraint("not-null", "name"), C.Constraint("regex", "email", pattern="@"), C.Constraint("range", "id", least=10, most=1000), C.Constraint("allowed-values", "active", values=("Yes",)), C.Constraint("unique", "segment")]
    found = {f.rule: f.count for f in C.check(mess(spark, d), c)}
    return spark.createDataFrame([tuple(found.get(f"constraint-{x.kind}", 0) for x in c)], "not_null long, regex long, range long, allowed long, uniques long")


@query(f"""select case when b.c_custkey is null then 'added' when a.c_custkey is null then 'removed' when a.c_name <> b.c_name then 'changed' else 'unchanged' end as status,
 cast(coalesce(a.c_custkey, b.c_custkey) as string) as key from (select c_custkey, c_name from customer) b full join ({SQL_MUTATED}) a on a.c_custkey = b.c_custkey""")
def diff_keyed(spark, d):
    before = Dataset.of(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), "c_custkey")
    return diff_tables(before, view(spark, d, MUTATED, "c_custkey")).rows.select("status", "key")


@query()
def rule_dependencies(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    bad = F.when(F.col("c_custkey") % 97 == 0, "ELSEWHERE").otherwise(F.col("n_regionkey").cast("string"))
    data = Dataset.of(c.select("c_custkey", "n_name", bad.alias("region")), "c_custkey")
    return R.dependencies(data, profile(data, samples=False))


@query()
def near_duplicates(spark, d):
    names = read(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("description"))
    return R.near_duplicates(Dataset.of(names, "p_partkey"))


@query()
def clean_apply(spark, d):
    from tabloom.plans.cleanse import Options, analyse, cleaned

    data = mess(spark, d)
    prof = profile(data, samples=False)
    wide, fixes, _ = R.build(data, prof)
    return cleaned(wide, fixes, Options()).named()


@query()
def score_card(spark, d):
    from dataclasses import astuple

    from tabloom.plans.cleanse import Options, cleanse

    s = cleanse(mess(spark, d), Options(projection=False)).score
    return spark.createDataFrame([astuple(s)], "validity int, consistency int, completeness int, uniqueness int, composite int")


@query()
def constraint_suggest(spark, d):
    data = mess(spark, d)
    return spark.createDataFrame([(c.kind, c.column, list(c.values)) for c in C.suggest(data, profile(data, samples=False))], "kind string, column string, values array<string>")


@query(f"""with l as ({SQL_LEFT} where o_orderkey % 7 <> 0), r as ({SQL_RIGHT}), j as (
 select l.id, case when l.id is null then r.ck else l.ck end as ck, l.status, r.cid, r.segment from l full join r on lower(trim(l.ck)) = lower(r.ck) and l.ck is not null)
select id, trim(ck) as ck, status, cid, segment from j""")
def recipe_join(spark, d):
    """A recipe that joins and cleans: every joined row is there once, those of the right alone too."""
    from tabloom.plans.cleanse import Options
    from tabloom.plans.recipe import Recipe, run

    left = view(spark, d, LEFT + " where o_orderkey % 7 <> 0", "id")
    off = {"consistent-casing", "standardise-values", "remove-duplicate-rows"}
    plan = Recipe(Options(disabled=frozenset(off), projection=False), join={"type": "full", "keys": [["ck", "ck"]]})
    return run(left, plan, view(spark, d, RIGHT, "cid"))[1].named()
