"""Editions and their release times, staged selection, frozen folders, and resume with inputs made anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cascade as cs
from tidemark.operators import editions as ed
from tidemark.operators import resume as rs
from tidemark.plans import base as b
from tidemark.plans.catalogue import query
from tidemark.sources import frozen, parts, shared

# ------------------------------------------------ editions
# A listing is an order priority; a page is its orders of one status in a month, by halves of the customers.  The page is dated by the
# week of its first order and lists its own month first, then the two months before.
_PAGES = """po as (select o_orderpriority listing, date_trunc('month', o_orderdate) m, o_orderstatus || o_custkey % 2 half, cast(date_trunc('week', min(o_orderdate)) as date) as day, min(o_orderkey) k from orders group by 1, 2, 3),
pages as (select listing, m, half, case when k % 9 = 0 then null else day end as release_day, case when k % 4 = 0 then cast(day + interval 35 day as date) end next_day from po),
seen as (select listing, half, m, m - to_months(cast(j as int)) em, j + 1 as position, k from po, unnest(range(3)) t(j)),
editions as (select listing, strftime(em, '%Y-%m') edition, max(case when k % 50 = 0 then 2 else 1 end) n_files from seen group by 1, 2),
dated as (select listing, strftime(m, '%Y-%m') edition, case when count(distinct release_day) = 1 then min(release_day) end as day, case when count(distinct release_day) = 1 then 'agreed' when count(distinct release_day) > 1 then 'conflicting' else 'absent' end day_status from pages group by 1, 2),
cal as (select o_orderpriority listing, cast(date_trunc('week', o_orderdate) as date) as day, case when count(distinct o_custkey % 3 * 300 + 420) = 1 then min(o_custkey % 3 * 300 + 420) end as minute, case when count(distinct o_custkey % 3 * 300 + 420) = 1 then 'agreed' else 'conflicting' end minute_status
  from orders where o_orderstatus = 'F' and o_custkey % 11 = 3 group by 1, 2),
ev as (select e.listing, e.edition, d.day, coalesce(d.day_status, 'absent') day_status, c.minute, coalesce(c.minute_status, 'absent') minute_status, n_files from editions e left join dated d using (listing, edition) left join cal c on c.listing = e.listing and c.day = d.day)"""
#: London's clock is an hour ahead from 01:00 UTC on the last Sunday of March to 01:00 UTC on that of October.
_LONDON = """case when {t} >= make_timestamp(year({t}), 3, 31, 1, 0, 0) - to_days(cast(dayofweek(make_date(year({t}), 3, 31)) as int)) and {t} < make_timestamp(year({t}), 10, 31, 2, 0, 0) - to_days(cast(dayofweek(make_date(year({t}), 10, 31)) as int)) then {t} - interval 1 hour else {t} end"""
_SPAN = f"""sp as (select *, {_LONDON.format(t="(cast(day as timestamp) + to_minutes(cast(coalesce(minute, 0) as int)))")} opens, case when minute is not null then {_LONDON.format(t="(cast(day as timestamp) + to_minutes(cast(minute as int)))")} + interval 1 minute else {_LONDON.format(t="(cast(day as timestamp) + interval 1 day)")} end closes from ev)"""


def _editions(spark, d):
    o = b.read(spark, d, "orders")
    p = o.groupBy(F.col("o_orderpriority").alias("listing"), F.date_trunc("month", "o_orderdate").alias("m"), F.concat("o_orderstatus", (F.col("o_custkey") % 2).cast("string")).alias("half"))
    p = p.agg(F.date_trunc("week", F.min("o_orderdate")).cast("date").alias("day"), F.min("o_orderkey").alias("k")).withColumn("page", F.concat_ws(" ", F.date_format("m", "yyyyMM"), "half"))
    pages = p.select("listing", "page", F.when(F.col("k") % 9 != 0, F.col("day")).alias("release_day"), F.when(F.col("k") % 4 == 0, F.date_add("day", 35)).alias("next_day"))
    back = p.select("listing", "page", "m", "k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"))
    label = F.date_format(F.add_months("m", -F.col("j")), "yyyy-MM")
    shown = F.when(F.col("k") % 2 == 0, F.concat(F.lit("  Edition of  "), label)).otherwise(F.concat(F.lit("EDITION of "), label))
    entries = back.select("listing", "page", (F.col("j") + 1).alias("position"), shown.alias("label"), F.when(F.col("k") % 50 == 0, 2).otherwise(1).alias("files"))
    calendar = o.select(F.col("o_orderpriority").alias("listing"), F.date_trunc("week", "o_orderdate").cast("date").alias("day"), (F.col("o_custkey") % 3 * 300 + 420).cast("int").alias("minute"), (F.col("o_orderstatus") == "F").alias("published"), (F.col("o_custkey") % 11 == 3).alias("lists_dataset"))
    return pages, entries, calendar


def _plain(label):
    return F.substring_index(label, " ", -1)


@query(f"""with {_PAGES}, {_SPAN} select listing, edition, cast(day as varchar) as day, day_status, minute, minute_status, n_files, strftime(opens, '%Y-%m-%d %H:%M') opens, strftime(closes, '%Y-%m-%d %H:%M') closes from sp""")
def edition_evidence(spark, d):
    """Every edition with what its records agree on, and the span of instants in which it came out, in UTC."""
    e = ed.evidence(*_editions(spark, d))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return e.select("listing", _plain(F.col("edition")).alias("edition"), F.col("day").cast("string").alias("day"), "day_status", F.col("minute").cast("long").alias("minute"), "minute_status", F.col("n_files").cast("long").alias("n_files"), at("opens"), at("closes"))


@query(f"""with {_PAGES}, {_SPAN}, asked as (select o_orderpriority listing, year(o_orderdate) ask, cast(cast(max_by(o_orderdate, o_orderkey) as date) as timestamp) + to_minutes(cast(max_by(o_custkey, o_orderkey) % 1440 as int)) at_ from orders group by 1, 2),
j as (select sp.*, ask, at_, case when day is null then 'undated' when closes <= at_ then 'out' when opens >= at_ then 'later' else 'within' end state from sp join asked using (listing)),
t as (select *, state = 'out' and day = max(case when state = 'out' then day end) over (partition by listing, ask) top from j),
g as (select listing, ask, at_, count_if(coalesce(top, false)) tops, min(case when top then edition end) edition, min(case when top then day end) as day, min(case when top then n_files end) n_files, count_if(state = 'out') n_out, count_if(state = 'later') n_later, count_if(state = 'within') n_within, count_if(state = 'undated') n_undated from t group by 1, 2, 3),
o as (select *, case when tops = 0 then 'none' when tops > 1 then 'tie' when n_files <> 1 then 'files' else 'selected' end outcome from g),
newest as (select listing, max_by(m, (coalesce(release_day, date '0001-01-01'), strftime(m, '%Y%m') || ' ' || half)) m from pages group by 1),
nx as (select listing, strftime(m, '%Y-%m') edition, max(next_day) next_day from pages group by 1, 2),
x as (select o.*, n.m newest, next_day from o left join newest n using (listing) left join nx using (listing, edition))
select listing, ask, case when outcome = 'selected' then edition end edition, case when outcome = 'selected' then cast(day as varchar) end as day, outcome,
 outcome = 'selected' and (coalesce({_LONDON.format(t="cast(next_day as timestamp)")} >= at_, false) or edition in (strftime(newest - interval 1 month, '%Y-%m'), strftime(newest - interval 2 month, '%Y-%m')) and exists (select 1 from j where j.listing = x.listing and j.ask = x.ask and j.state = 'later' and j.edition = strftime(strptime(x.edition || '-01', '%Y-%m-%d') + interval 1 month, '%Y-%m'))) complete,
 n_out, n_later, n_within, n_undated from x""")
def edition_resolution(spark, d):
    """The edition that was the latest at an instant of each year, or why none can be named; whether a later one is ruled out."""
    o = b.read(spark, d, "orders")
    asked = o.groupBy(F.col("o_orderpriority").alias("listing"), F.year("o_orderdate").alias("ask")).agg(F.max(F.struct("o_orderkey", "o_orderdate", "o_custkey")).alias("z"))
    asked = asked.select("listing", "ask", F.timestamp_seconds(F.unix_date(F.col("z.o_orderdate").cast("date")) * 86400 + F.col("z.o_custkey") % 1440 * 60).alias("at"))
    r = ed.resolve(*_editions(spark, d), asked)
    return r.select("listing", "ask", _plain(F.col("edition")).alias("edition"), F.col("day").cast("string").alias("day"), "outcome", "complete", "n_out", "n_later", "n_within", "n_undated")


@query(f"""with {_PAGES}, {_SPAN} select listing, count(*) editions, count_if(day_status = 'agreed') days_agreed, count_if(day_status = 'conflicting') days_conflicting, count_if(day_status = 'absent') days_absent,
 count_if(minute_status = 'agreed') minutes_agreed, count_if(minute_status = 'conflicting') minutes_conflicting, count_if(n_files <> 1) several_files, count(distinct day) as days from sp group by 1""")
def null_spec_counts(spark, d):
    """What the evidence of each listing's editions amounts to: agreed, conflicting and absent days and minutes."""
    e = ed.evidence(*_editions(spark, d))
    n = lambda c, v: F.count_if(F.col(c) == v)
    return e.groupBy("listing").agg(
        F.count("*").alias("editions"), n("day_status", "agreed").alias("days_agreed"), n("day_status", "conflicting").alias("days_conflicting"), n("day_status", "absent").alias("days_absent"), n("minute_status", "agreed").alias("minutes_agreed"),
        n("minute_status", "conflicting").alias("minutes_conflicting"), F.count_if(F.col("n_files") != 1).alias("several_files"), F.count_distinct("day").alias("days"),
    )


# ------------------------------------------------ staged selection
# The rules (stage, field, pattern, whether it must be found).
RULES = [(1, "type", "STEEL|BRASS|COPPER|TIN|NICKEL|[aeiou]", True), (1, "name", "^$", False), (2, "size", "^[1-9]$|^1[0-9]$", True), (3, "key", "[05]$", True), (3, "size", "7", False), (4, "key", "[0-4][05]$", True)]


@query(r"""with c as (select p_brand brand, p_partkey cand, regexp_matches(p_type, 'STEEL|BRASS|COPPER|TIN|NICKEL|[aeiou]') and p_name <> '' s1, p_size between 1 and 19 s2, p_partkey % 5 = 0 and cast(p_size as varchar) not like '%7%' s3, p_partkey % 5 = 0 and p_partkey % 100 < 50 s4 from part),
f as (select *, case when not s1 then 1 when not s2 then 2 when not s3 then 3 when not s4 then 4 end gone from c),
n as (select brand, j stage, count_if(gone is null or gone > j) k from f, unnest(range(1, 5)) t(j) group by 1, 2), d as (select brand, coalesce(min(case when k <= 1 then stage end), 4) stage from n group by 1),
o as (select d.brand, d.stage, case n.k when 1 then 'chosen' when 0 then 'nothing' else 'several' end outcome from d join n using (brand, stage))
select brand, cand as candidate, case when gone <= stage then gone end dropped_at, outcome = 'chosen' and coalesce(gone > stage, true) as chosen, outcome, stage from f join o using (brand)""")
def staged_selection(spark, d):
    """Rules as data narrow each brand's parts until one is left; rivals show the stage at which they left."""
    p = b.read(spark, d, "part")
    fields = F.create_map(F.lit("type"), "p_type", F.lit("name"), "p_name", F.lit("size"), F.col("p_size").cast("string"), F.lit("key"), F.lpad(F.col("p_partkey").cast("string"), 2, "0"))
    candidates = p.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("candidate"), fields.alias("fields"))
    return cs.cascade(candidates, spark.createDataFrame(RULES, "stage int, field string, pattern string, wanted boolean"), ["brand"])


# ------------------------------------------------ frozen folders and resume
_BOOKS = """f as (select 'n' || c_nationkey || '-' || lower(c_mktsegment) || '.txt' as file, string_agg(c_custkey || ':' || cast(cast(c_acctbal as decimal(18,2)) as varchar), ';' order by c_custkey) content from customer group by c_nationkey, c_mktsegment),
h as (select file, octet_length(encode(content)) bytes, sha256(content) sha256, sha256(file) place from f)"""


def _account_files(spark, d) -> str:
    c = b.read(spark, d, "customer")
    line = F.concat_ws(":", F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line"))))["line"]  # a file's content
    books = c.groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("-"), F.lower("c_mktsegment"), F.lit(".txt")).alias("name")).agg(F.array_join(rows, ";").alias("text"))
    path = shared.new_path(spark, "accounts")
    parts.write_files(books.select("name", F.col("text").cast("binary").alias("content")), path)
    return path


@query(f"""with {_BOOKS}, n as (select count(*) n, case when count(*) > 64*256 then 3 when count(*) > 64*16 then 2 when count(*) > 64 then 1 else 0 end depth from h),
l as (select depth as level, left(place, depth) prefix, count(*) n_files, sha256(string_agg(file || ':' || sha256, ',' order by file || ':' || sha256)) sha256 from h, n group by depth, left(place, depth)),
k as (select 0 as level, '' prefix, cast(sum(n_files) as bigint) n_files, sha256(string_agg(prefix || ':' || sha256, ',' order by prefix || ':' || sha256)) sha256 from l where level = 1 having count(*) > 0)
select * from l union all select * from k""")
def frozen_tree(spark, d):
    """The hash tree of a folder of account files."""
    return frozen.tree(frozen.leaves(spark, _account_files(spark, d)))


@query(f"""with {_BOOKS} select file, sha256 was, case when place < '8' then sha256(content || ';0:0.00') end now from h join f using (file) where file like 'n1%'""")
def frozen_changes(spark, d):
    """Files that changed or went after their folder was frozen, found from the root of its tree down."""
    path = _account_files(spark, d)
    frozen.freeze(spark, path)
    odd = spark.read.format("binaryFile").option("pathGlobFilter", "n1*.txt").load(path).select(F.substring_index("path", "/", -1).alias("name"), F.concat("content", F.lit(";0:0.00").cast("binary")).alias("content"))
    later = shared.new_path(spark, "accounts-later")
    same = spark.read.format("binaryFile").option("pathGlobFilter", "n[!1]*.txt").load(path).select(F.substring_index("path", "/", -1).alias("name"), "content")
    parts.write_files(odd.where(F.sha2("name", 256) < "8").unionByName(same), later)
    frozen.copy_mark(spark, path, later)
    return frozen.changed(spark, later)


@query("""with o as (select o_custkey k, o_orderkey, o_totalprice, o_orderdate from orders), cut as (select max(o_orderdate) - interval 200 day at_ from orders),
a as (select k, count(*) n from o group by 1), b as (select k, count(*) n, count_if(o_orderkey % 10 = 0) odd from o, cut where o_orderdate < at_ and k % 3 <> 0 group by 1)
select k as custkey, case when b.k is null then 'run' when a.n = b.n then 'keep' else 'quarantine' end as action, case when b.k is null then null when odd > 0 then 'failed' else 'ok' end status from a left join b using (k)""")
def resume_plan(spark, d):
    """A ledger made before the last 200 days, for two thirds of the customers, against inputs made anew: what is run, kept or set aside.
    Failures that are stored are kept as they are."""
    o = b.read(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    cut = o.agg((F.max("o_orderdate") - F.expr("interval 200 day")).alias("at"))
    old = o.join(F.broadcast(cut), F.col("o_orderdate") < F.col("at")).where("custkey % 3 <> 0").drop("at")  # one row
    columns = ["o_orderkey", "o_totalprice", "o_orderdate"]
    failed = old.groupBy("custkey").agg(F.when(F.count_if(F.col("o_orderkey") % 10 == 0) > 0, "failed").otherwise("ok").alias("status"))
    ledger = rs.input_hash(old, ["custkey"], columns).join(failed, "custkey")
    return rs.decide(rs.input_hash(o, ["custkey"], columns), ledger, ["custkey"]).select("custkey", "action", "status")
