"""Matching of webhook events, late events, and replay."""

from functools import reduce

from pyspark.sql import functions as F

from ...operators import deliveries as D, matching as M, replay as RP, reports as REP
from ...sources.tables import stored
from .. import standins as S
from ..registry import query
from .functions import PROJECT_EVENTS

LINKS = PROJECT_EVENTS + """
, jl as (select tenant_id || ':' || lower(link_ref) as ref_key, min(id) as job_id, arg_min(customer_id, id) as job_owner,
    nullif(arg_min(link_modified, id), '') as job_stored from job where link_ref <> '' group by 1)
, cl as (select tenant_id || ':' || lower(link_ref) as ref_key, min(id) as cust_id,
    nullif(arg_min(link_modified, id), '') as cust_stored from cust where link_ref <> '' group by 1)
, be as (select tenant_id || ':' || lower(email) as email_key, min(id) as id from cust where email <> '' group by 1)
, bp as (select tenant_id || ':' || phone as phone_key, min(id) as id from cust group by 1)
, cls as (
  select pe.*, jl.job_id, jl.job_owner, case when jl.job_id is null then cl.cust_id end as cust_id,
    coalesce(be.id, bp.id) as found, case when be.id is not null then 'email'
      when bp.id is not null then 'phone' end as found_by,
    case when jl.job_id is not null then job_stored else cust_stored end as stored
  from pe left join jl using (ref_key) left join cl using (ref_key)
    left join be using (email_key) left join bp using (phone_key))
, classified as (
  select seq, reference,
    case when ref_key is null then 'skipped'
      when coalesce(job_id, cust_id) is not null and modified <> '' and stored is not null
        and modified <= stored then 'skipped-stale'
      when job_id is not null then 'updated-job' when cust_id is not null then 'updated-customer'
      when found is not null then 'created-job' else 'created-customer' end as action,
    job_id, case when ref_key is null or job_id is not null then null
      when cust_id is not null then cust_id else found end as customer_id,
    case when ref_key is null then null when coalesce(job_id, cust_id) is not null then 'reference'
      else found_by end as matched_by
  from cls)
"""

GUARD = LINKS + """
, guard as (
  select *, greatest(max(nullif(modified, '')) over (partition by ref_key order by seq
      rows between unbounded preceding and 1 preceding), stored) as prev_modified
  from cls where ref_key is not null)
, marked as (
  select *, coalesce(not (modified <> '' and modified <= prev_modified), true) as applied from guard)
, folded as (
  select ref_key, any_value(job_id) as job_id, any_value(cust_id) as cust_id,
    arg_max(quote_value, seq) filter (where applied and quote_value <> '') as quote_value,
    arg_max(installation_value, seq) filter (where applied and installation_value <> '')
      as installation_value,
    arg_max(ext_status, seq) filter (where applied and ext_status <> '') as ext_status,
    max(nullif(modified, '')) filter (where applied) as modified
  from marked group by ref_key)
"""

DEALS = GUARD + """
select f.ref_key, case when f.job_id is not null then 'job' when f.cust_id is not null
    then 'customer' end as held_before,
  case when f.cust_id is not null then f.quote_value
    else coalesce(f.quote_value, j.quote_value, '') end as quote_value,
  case when f.cust_id is not null then f.installation_value
    else coalesce(f.installation_value, j.installation_value, '') end as installation_value,
  f.ext_status,
  coalesce(f.modified, j.link_modified, c.link_modified, '') as modified
from folded f left join job j on j.id = f.job_id left join cust c on c.id = f.cust_id
"""


def events(spark, sf):
    return D.project_events(D.capture_raw_event(S.deliveries(spark, sf)))


def keys(spark, sf):
    return M.job_keys(S.jobs(spark, sf)), M.customer_keys(S.customers(spark, sf))


@query("link_event_to_job", LINKS + """
select seq, job_id, job_owner as customer_id from cls where job_id is not null
""")
def link_event_to_job(spark, sf):
    jobs, _ = keys(spark, sf)
    return M.link_event_to_job(events(spark, sf), jobs).select("seq", "job_id", "customer_id")


@query("link_event_to_customer", LINKS + "select seq, cust_id as customer_id from cls where cust_id is not null")
def link_event_to_customer(spark, sf):
    return M.link_event_to_customer(events(spark, sf), *keys(spark, sf)).select("seq", "customer_id")


@query("identity_match", LINKS + "select seq, found as matched_customer, found_by as matched_by from cls")
def identity_match(spark, sf):
    _, customers = keys(spark, sf)
    return M.identity_match(events(spark, sf), customers).select(
        "seq", "matched_customer", "matched_by"
    )


@query("unmatched_events", LINKS + "select seq, reference from classified where action = 'created-customer'")
def unmatched_events(spark, sf):
    return M.unmatched_events(events(spark, sf), *keys(spark, sf)).select("seq", "reference")


@query("classify_event", LINKS + """
select seq, reference, action, case action when 'skipped' then 'no reference on project' end as reason,
  job_id, customer_id, matched_by from classified
""")
def classify_event(spark, sf):
    return M.classify_event(events(spark, sf), *keys(spark, sf))


@query("apply_action_summary", LINKS + "select action, count(*) as events from classified group by action")
def apply_action_summary(spark, sf):
    return M.apply_action_summary(M.classify_event(events(spark, sf), *keys(spark, sf)))


@query("first_match", """
select tenant_id || ':' || lower(email) as email_key, min(id) as customer_id, arg_min(name, id) as name
from cust where email <> '' group by 1
""")
def first_match(spark, sf):
    _, customers = keys(spark, sf)
    return M.first_match(customers, "email_key", "customer_id", ["customer_id", "name"])


def guarded(spark, sf):
    links = M.links_by_reference(*keys(spark, sf)).select("ref_key", "stored")
    with_ref = events(spark, sf).filter(F.col("ref_key").isNotNull())
    return M.staleness_guard(
        with_ref.join(links, "ref_key", "left"), "ref_key", "seq", "modified", stored="stored"
    )


@query("staleness_guard", GUARD + "select seq, ref_key, prev_modified, applied from marked")
def staleness_guard(spark, sf):
    return guarded(spark, sf).select("seq", "ref_key", "prev_modified", "applied")


@query("fold_sparse_updates", GUARD + """
select ref_key, quote_value, installation_value, ext_status, modified from folded
""")
def fold_sparse_updates(spark, sf):
    return M.fold_sparse_updates(
        guarded(spark, sf), "ref_key", "seq",
        ["quote_value", "installation_value", "ext_status", "modified"],
    )


def now():
    return F.lit(S.NOW).cast("timestamp")


def deals(events_df, jobs_before, customers_before, jobs, customers):
    """Deal fields of whichever record holds each reference of the events."""
    fields = ["quote_value", "installation_value", "ext_status", "modified"]
    held_before = M.links_by_reference(
        M.job_keys(jobs_before), M.customer_keys(customers_before)
    ).select("ref_key", F.col("linked").alias("held_before"))
    by_rank = [
        REP.linked_records(df).withColumn("rank", F.lit(rank))
        for rank, df in enumerate((jobs, customers))
    ]
    holders = M.first_match(
        reduce(lambda a, b: a.unionByName(b), by_rank).withColumn("at", F.struct("rank", "id")),
        "ref_key", "at", fields,
    )
    refs = events_df.select("ref_key").filter(F.col("ref_key").isNotNull()).distinct()
    return refs.join(holders, "ref_key").join(held_before, "ref_key", "left").select(
        "ref_key", "held_before", *fields
    )


# Every applied event in turn. `st` holds what each step changed: customers by id with their e-mail and
# phone of the moment (t = 'c'), targets of new references (t = 'r'), and the step with the last id (t = 'n').
REPLAYED = GUARD + """
, custk as (select id, tenant_id, case when email <> '' then tenant_id || ':' || lower(email) end as email_key,
    tenant_id || ':' || phone as phone_key from cust)
, steps as (
  select row_number() over (order by m.seq) as n, m.seq, m.ref_key, m.email_key, m.phone_key,
    coalesce(m.job_id, m.cust_id) is null as is_new, case when m.job_id is null then m.cust_id else o.id end as patched
  from marked m left join custk o on o.id = m.job_owner and o.tenant_id = m.tenant_id
  where m.applied)
, st(t, k, n, email_key, phone_key, customer, matched_by) using key (t, k) as (
  select 'n', '', 0, cast(null as varchar), cast(null as varchar), (select max(id) from cust), cast(null as varchar)
  union all
  select u.t, u.k, u.n, u.email_key, u.phone_key, u.customer, u.matched_by from (
    select s.*, st.customer as last, r.customer as target,
      (select min(id) from (
        select cast(k as bigint) as id from recurring.st where t = 'c' and email_key = s.email_key
        union all select id from custk c where c.email_key = s.email_key
          and not exists (select 1 from recurring.st x where x.t = 'c' and x.k = cast(c.id as varchar)))) as by_email,
      (select min(id) from (
        select cast(k as bigint) as id from recurring.st where t = 'c' and phone_key = s.phone_key
        union all select id from custk c where c.phone_key = s.phone_key
          and not exists (select 1 from recurring.st x where x.t = 'c' and x.k = cast(c.id as varchar)))) as by_phone
    from st join steps s on st.t = 'n' and s.n = st.n + 1
      left join recurring.st r on r.t = 'r' and r.k = s.ref_key) e
  left join recurring.st h on h.t = 'c' and h.k = cast(coalesce(e.patched, e.target) as varchar)
  left join custk b on b.id = coalesce(e.patched, e.target),
  lateral (
    select 'n' as t, '' as k, e.n as n, cast(null as varchar) as email_key, cast(null as varchar) as phone_key,
      e.last + case when e.is_new and e.target is null and e.by_email is null and e.by_phone is null then 1 else 0 end
        as customer, cast(null as varchar) as matched_by
    union all
    select 'r', e.ref_key, e.n, null, null, coalesce(e.by_email, e.by_phone, e.last + 1),
      case when e.by_email is not null then 'email' when e.by_phone is not null then 'phone' end
    where e.is_new and e.target is null
    union all
    select 'c', cast(e.last + 1 as varchar), e.n, e.email_key, e.phone_key, null, null
    where e.is_new and e.target is null and e.by_email is null and e.by_phone is null
    union all
    select 'c', cast(coalesce(e.patched, e.target) as varchar), e.n,
      coalesce(e.email_key, case when h.k is null then b.email_key else h.email_key end),
      coalesce(e.phone_key, case when h.k is null then b.phone_key else h.phone_key end), null, null
    where coalesce(e.patched, e.target) is not null) u)
, made as (
  select k as ref_key, customer, matched_by, n as first_n, case when matched_by is not null then
    (select max(id) from job) + row_number() over (partition by matched_by is null order by n) end as job_id
  from st where t = 'r')
, shown as (
  select m.seq, m.reference, m.applied, row_number() over (partition by m.ref_key order by m.seq) = 1
      and made.ref_key is not null as starts,
    case when coalesce(m.job_id, made.job_id) is null then 'customer' else 'job' end as kind,
    coalesce(m.job_id, made.job_id) as job_id, coalesce(made.customer, m.cust_id) as customer_id, made.matched_by
  from marked m left join made on made.ref_key = m.ref_key)
select seq, reference, case when starts then 'created-' || kind when applied then 'updated-' || kind
    else 'skipped-stale' end as action, cast(null as varchar) as reason, job_id,
  case when kind = 'customer' or starts then customer_id end as customer_id,
  case when starts then matched_by else 'reference' end as matched_by from shown
union all
select seq, reference, 'skipped', 'no reference on project', null, null, null from pe where ref_key is null
"""


@query("replay_events", REPLAYED, recursive=True)
def replay_events(spark, sf):
    """Every event applied in turn."""
    return RP.replay(events(spark, sf), S.jobs(spark, sf), S.customers(spark, sf), now()).actions


@query("replay_deals", DEALS)
def replay_deals(spark, sf):
    # All three are read several times over, so their documents are made and taken apart once.
    jobs, customers = stored(S.jobs(spark, sf), "jobs"), stored(S.customers(spark, sf), "customers")
    given = stored(events(spark, sf), "events")
    done = RP.replay(given, jobs, customers, now())
    return deals(
        given, jobs, customers, RP.merged(jobs, stored(done.jobs, "changed-jobs")),
        RP.merged(customers, stored(done.customers, "changed-customers")),
    )
