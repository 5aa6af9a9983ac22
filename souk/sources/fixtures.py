"""Stand-in marketplace tables derived from the driver's TPC-H-ish parquet.

These only produce rows in the marketplace schema; they do none of the
operators' work.  Each definition is one SQL template whose table
references are ``{placeholders}``: Spark fills them with DataFrames through
``spark.sql(text, **frames)``; the DuckDB oracle fills them with CTE names.
The same text therefore feeds both sides of the correctness check.

``k`` (bookings) and ``pk`` (collaborations) are helper columns used by later
definitions; the canonical tables drop them.
"""

from __future__ import annotations

import re

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Order matters: a definition may only use raw tables and earlier definitions.
FIXTURE_SQL: dict[str, str] = {
    "users": """
select 'u-c-'||s_suppkey id, s_name name, 'c'||s_suppkey||'@creator.test' email, 'creator' role,
       'https://a.test/c'||s_suppkey avatar_url, (select min(o_orderdate) from {orders}) created_at
from {supplier}
union all
select 'u-b-'||c_custkey, c_name, 'b'||c_custkey||'@brand.test', 'brand', 'https://a.test/b'||c_custkey,
       coalesce((select min(o_orderdate) from {orders} oo where oo.o_custkey=c_custkey),
                (select min(o_orderdate) from {orders}))
from {customer}
union all
select 'u-a-0', 'Admin', 'a0@admin.test', 'admin', cast(null as varchar(20)), (select min(o_orderdate) from {orders})
""",
    "creator_profiles": """
select 'c-'||s_suppkey id, 'u-c-'||s_suppkey user_id, 'creator_'||s_suppkey username,
       d.text bio,
       case when s_suppkey%10=9 then null when s_suppkey%10=8 then '' when s_suppkey%5=0 then 'Technology'
            when s_suppkey%5=1 then 'Fashion' when s_suppkey%5=2 then 'Food' when s_suppkey%5=3 then 'Lifestyle'
            else 'Memes' end category,
       n_name city, r_name country, case when s_suppkey%3=0 then 0 else 1 end verified,
       cast(cast(s_suppkey%50 as decimal(10,0))*0.1 as decimal(3,2)) rating,
       cast(0 as decimal(3,2)) collaboration_rating, e.ts created_at
from {supplier} join {nation} on s_nationkey=n_nationkey join {region} on n_regionkey=r_regionkey
left join {documents} d on d.doc_id=s_suppkey left join {events} e on e.event_id=s_suppkey
""",
    "brand_profiles": """
select 'b-'||c_custkey id, 'u-b-'||c_custkey user_id, c_name company_name, c_mktsegment industry,
       'https://b'||c_custkey||'.test' website, uu.created_at
from {customer} join {users} uu on uu.id='u-b-'||c_custkey
""",
    "creator_platforms": """
select 'p-'||user_id||'-'||event_type id, 'c-'||user_id creator_id,
       case event_type when 'view' then 'Instagram' when 'click' then 'YouTube' when 'purchase' then 'Telegram'
                       when 'signup' then 'TikTok' else 'Podcast' end platform_name,
       '@h'||user_id username, 'https://s.test/'||user_id||'/'||event_type profile_url,
       cast(count(*)*5000+max(event_id) as int) followers, cast(max(value) as decimal(5,2)) engagement_rate
from {events}
where user_id%10<>7 and user_id in (select s_suppkey from {supplier}) and (user_id+length(event_type))%3<>0
group by user_id, event_type
""",
    "promotion_packages": """
select 'k-'||l_suppkey||'-'||l_partkey id, 'c-'||l_suppkey creator_id, min(p_name) package_name,
       min(p_type||' '||p_brand) description, cast(min(l_extendedprice) as decimal(12,2)) price,
       min(p_size) delivery_days, min(l_shipdate) created_at
from {lineitem} join {part} on l_partkey=p_partkey
where l_suppkey%11<>5
group by l_suppkey, l_partkey
""",
    "campaigns": """
select 'cm-'||o_custkey||'-'||substring(o_orderpriority,1,1) id, 'b-'||o_custkey brand_id,
       'Campaign '||o_custkey||' '||min(o_orderpriority) title, 'brief '||o_custkey description,
       cast(max(o_totalprice) as decimal(12,2)) budget,
       min(case when o_custkey%4=0 then 'Technology' when o_custkey%4=1 then 'Fashion'
                when o_custkey%4=2 then 'Food' else 'Memes' end) category,
       min(case substring(o_orderpriority,1,1) when '3' then 'paused' when '4' then 'completed'
                when '5' then 'cancelled' else 'active' end) status,
       min(o_orderdate) created_at
from {orders}
where o_custkey%5<>0
group by o_custkey, substring(o_orderpriority,1,1)
""",
    "bookings": """
select q.*,
       case when status in ('completed','content_submitted','content_rejected') then 'https://p.test/'||k end content_url,
       case when status in ('completed','content_submitted','content_rejected') then 'url' end content_type,
       case when status='content_rejected' then 'Content did not meet requirements' end rejection_reason
from (
  select 'bk-'||o_orderkey id, o_orderkey k, 'b-'||o_custkey brand_id, 'c-'||(c%1000000) creator_id,
         case when (c%1000000)%11=5 then null
              else 'k-'||(c%1000000)||'-'||cast((c-c%1000000)/1000000 as bigint) end package_id,
         case when o_custkey%5<>0 and o_orderkey%4=0
              then 'cm-'||o_custkey||'-'||substring(o_orderpriority,1,1) end campaign_id,
         case when o_orderstatus='F' then 'completed'
              when o_orderstatus='O' and o_orderkey%2=0 then 'content_rejected'
              when o_orderstatus='O' then 'cancelled'
              when o_orderkey%3=0 then 'pending' when o_orderkey%3=1 then 'accepted'
              else 'content_submitted' end status,
         cast(o_totalprice as decimal(12,2)) price, o_orderpriority notes, o_orderdate created_at
  from {orders} join (select l_orderkey, max(l_partkey*1000000+l_suppkey) c from {lineitem} group by l_orderkey) x
       on l_orderkey=o_orderkey
) q
""",
    "campaign_invites": """
select 'ci-'||campaign_id||'-'||creator_id id, campaign_id, creator_id,
       case when min(k)%3=0 then 'pending' when min(k)%3=1 then 'accepted' else 'declined' end status
from {bookings}
where campaign_id is not null and k%8=0
group by campaign_id, creator_id
""",
    "payments": """
select 'pay-'||k id, id booking_id, 'ord-'||k razorpay_order_id, price amount,
       case when status in ('completed','content_submitted','content_rejected') then 'completed'
            when k%2=0 then 'pending' else 'failed' end payment_status, created_at
from {bookings} where status not in ('pending','cancelled')
union all
select 'pay-'||k||'-x', id, 'ord-'||k||'-x', price, 'failed', created_at
from {bookings} where status='completed' and k%97=0
union all
select 'pay-'||k, id, 'ord-'||k, price, 'refunded', created_at
from {bookings} where status='cancelled' and k%5=0
""",
    "escrow_wallet": """
select 'e-'||k id, id booking_id, price amount,
       case when status='cancelled' then 'refunded' when status='completed' and k%10<>1 then 'released'
            else 'held' end status, created_at
from {bookings}
where status in ('completed','content_submitted','content_rejected') or (status='cancelled' and k%5=0)
""",
    "creator_earnings": """
select 'ce-'||k id, creator_id, id booking_id, price amount,
       case when k%7=0 then 'pending' else 'paid' end status, created_at
from {bookings} where status='completed' and k%10<>1
""",
    "withdrawals": """
select 'w-'||k id, creator_id,
       cast(case when creator_id like '%4' then price*10 else price*0.25 end as decimal(12,2)) amount,
       case k%4 when 0 then 'pending' when 1 then 'approved' when 2 then 'rejected' else 'paid' end status,
       '{{"upi_id":"u'||k||'"}}' details, created_at
from {bookings} where status='completed' and k%5=2
""",
    "reviews": """
select 'r-'||k id, id booking_id, brand_id, creator_id, cast(1+(k*7)%5 as int) rating,
       'review '||k comment, created_at
from {bookings} where status='completed' and k%3<>0
""",
    "collaborations": """
select 'cl-'||p_partkey id, p_partkey pk, 'c-'||(p_partkey%(select count(*) from {supplier})) creator_id,
       p_name title, 'about '||p_name description,
       case p_partkey%3 when 0 then 'Instagram' when 1 then 'YouTube' else 'Telegram' end platform,
       p_type category, n_name location, p_size*1000 followers_required, p_brand collaboration_type,
       case p_partkey%4 when 0 then 'open' when 1 then 'in_progress' when 2 then 'completed' else 'cancelled' end status,
       (select min(l_shipdate) from {lineitem} li where li.l_partkey=p_partkey) created_at
from {part} join {nation} on n_nationkey=p_partkey%25
""",
    "collaboration_requests": """
select 'cq-'||l_partkey||'-'||l_suppkey id, 'cl-'||l_partkey collaboration_id, 'c-'||l_suppkey creator_id,
       case (l_partkey+l_suppkey)%3 when 0 then 'pending' when 1 then 'accepted' else 'rejected' end status,
       'let us work' message, min(l_shipdate) created_at
from {lineitem} join {collaborations} cc on cc.pk=l_partkey
where cc.creator_id<>'c-'||l_suppkey
group by l_partkey, l_suppkey
""",
    "collaboration_participants": """
select 'h-'||id id, id collaboration_id, creator_id, 'host' role, created_at joined_at from {collaborations}
union all
select 'j-'||id, collaboration_id, creator_id, 'collaborator', created_at
from {collaboration_requests} where status='accepted'
""",
    "collaboration_reviews": """
select 'cr-'||a.id||'-'||b.id id, a.collaboration_id, a.creator_id reviewer_id, b.creator_id creator_id,
       cast(1+(length(a.id)*3+length(b.creator_id)+c.pk)%5 as int) rating, 'fine work' comment,
       b.joined_at created_at
from {collaboration_participants} a
join {collaboration_participants} b
  on a.collaboration_id=b.collaboration_id and a.creator_id<>b.creator_id and a.role='host'
join {collaborations} c on c.id=a.collaboration_id
where c.status='completed'
""",
    "collaboration_messages": """
select 'mm-'||p.id id, p.collaboration_id, 'u-'||p.creator_id sender_id, 'hello from '||p.creator_id message,
       p.joined_at created_at
from {collaboration_participants} p join {collaborations} c on c.id=p.collaboration_id
where c.pk%4 in (1,2)
""",
    "messages": """
select 'm-'||conv_id||'-'||turn id,
       case when conv_id%13=0 and turn=1 then null
            when role='user' then 'u-'||b.brand_id when role='assistant' then 'u-'||b.creator_id else 'u-a-0' end sender_id,
       case role when 'user' then 'u-'||b.creator_id else 'u-'||b.brand_id end receiver_id,
       case when role<>'system' then b.id end booking_id, v.text message,
       coalesce(e.ts,(select min(ts) from {events})) created_at
from {conversations} v join {bookings} b on b.k=conv_id left join {events} e on e.event_id=conv_id*20+turn
""",
    "notifications": """
select 'n-'||event_id id, 'u-c-'||user_id user_id, event_type title, props message, '/'||event_type link,
       event_id%3=0 is_read, ts created_at
from {events} where user_id in (select s_suppkey from {supplier})
""",
    "admin_logs": """
select 'al-'||event_id id, 'Reviewed event '||event_id action, 'u-a-0' admin_id, ts created_at
from {events} where event_type='error'
""",
}

# Named extra inputs: tables with injected faults for the checks, the two
# notification shapes for the drift merge, and command tables for the jobs.
EXTRA_SQL: dict[str, str] = {
    "faulty_bookings": """
select id, brand_id, case when k%101=4 then 'c-missing' else creator_id end creator_id, package_id, campaign_id,
       case when k%101=2 then 'archived' when k%101=7 then null else status end status,
       case when k%101=0 then null else price end price, notes, content_url,
       case when k%101=5 then repeat('x', 60) else content_type end content_type,
       rejection_reason, created_at
from {bookings}
union all
select id, brand_id, creator_id, package_id, campaign_id, status, price, notes, content_url, content_type,
       rejection_reason, created_at
from {bookings} where k%101=1
union all
select upper(id), brand_id, creator_id, package_id, campaign_id, status, price, notes, content_url, content_type,
       rejection_reason, created_at
from {bookings} where k%101=9
""",
    "faulty_reviews": """
select id, booking_id, brand_id, creator_id,
       case when cast(substring(id, 3) as bigint)%101=3 then 0
            when cast(substring(id, 3) as bigint)%101=6 then 6 else rating end rating,
       comment, created_at
from {reviews}
""",
    "raw_payments": """
select id, booking_id,
       case when length(id)%4=1 and cast(amount*100 as bigint)%19=0 then repeat('o', 201) else razorpay_order_id end razorpay_order_id,
       cast(null as varchar(200)) razorpay_payment_id,
       case when cast(amount*100 as bigint)%23=0 then '12'||cast(amount as varchar(30))||'0000000' when cast(amount*100 as bigint)%29=0 then '98765432109.5'
            when cast(amount*100 as bigint)%31=0 then 'n/a' when cast(amount*100 as bigint)%37=0 then '9999999999.99'
            else cast(amount as varchar(30)) end amount,
       payment_status, created_at
from {payments}
""",
    "notifications_old": """
select 'n-'||event_id id, 'u-c-'||user_id user_id, props message,
       case when event_id%3=0 then 1 else 0 end read_status, ts created_at
from {events} where user_id in (select s_suppkey from {supplier}) and event_id%2=0
""",
    "notifications_new": """
select 'n-'||event_id id, 'u-c-'||user_id user_id, event_type title, props message, '/'||event_type link,
       event_id%3=0 is_read, ts created_at
from {events} where user_id in (select s_suppkey from {supplier}) and event_id%2=1
""",
}

from souk.sources.commands import COMMAND_SQL  # noqa: E402

EXTRA_SQL.update(COMMAND_SQL)
ALL_SQL: dict[str, object] = {**FIXTURE_SQL, **EXTRA_SQL}


def sql_for(name: str, engine: str) -> str:
    """The definition text of ``name`` for ``engine`` ('spark' or 'duckdb')."""
    d = ALL_SQL[name]
    return d[engine] if isinstance(d, dict) else d

_PLACEHOLDER = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def references(name: str) -> list[str]:
    """Tables (raw or derived) that the definition of ``name`` reads."""
    return sorted(set(_PLACEHOLDER.findall(sql_for(name, "spark"))))


def closure(names) -> list[str]:
    """Derived tables needed for ``names``, in definition order."""
    need: set[str] = set()

    def visit(n: str) -> None:
        if n in need or n not in ALL_SQL:
            return
        need.add(n)
        for r in references(n):
            visit(r)

    for n in names:
        visit(n)
    return [n for n in ALL_SQL if n in need]
