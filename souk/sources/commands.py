"""Stand-in command tables for the jobs, derived from ``events``
(FIXTURES.md §3): ``cmd_id = seq = event_id``, payloads from the event and
the stand-in tables.  They only shape input rows; the jobs do the work.

A definition is either one SQL text for both engines or a dict with a
``spark`` and a ``duckdb`` text where the dialects differ (HMAC).
"""

from __future__ import annotations

# An invented test key for the payment-callback signatures (not a secret).
TEST_KEY = b"k" * 20


def _pads(key: bytes) -> tuple[str, str]:
    k = key.ljust(64, b"\x00")
    return bytes(b ^ 0x36 for b in k).hex(), bytes(b ^ 0x5C for b in k).hex()


_IPAD, _OPAD = _pads(TEST_KEY)

N = "(select count(*) from {orders})"
# a third of the commands aim at one booking, the rest at all of them
TK = "(case when event_id%3=0 then 7 else (event_id*7) % " + N + " end)"

_T11 = """
select e.event_id cmd_id, e.event_id seq, 'u-'||b.brand_id actor_user_id,
       'ord-'||b.k order_id, 'pay_'||e.event_id payment_id,
       case when e.event_id%29=0 then 'bad-signature' else {sig} end signature,
       case when e.event_id%41=0 then 'bk-missing' else b.id end booking_id
from (select event_id, """ + TK + """ tk from {events} where event_type='purchase') e
join {bookings} b on b.k = e.tk
"""
_MSG = "'ord-'||b.k||'|'||'pay_'||e.event_id"

COMMAND_SQL: dict[str, object] = {
    "cmd_t06": """
select e.event_id cmd_id, e.event_id seq,
       case when e.event_id%13=0 then 'u-'||b.creator_id else 'u-'||b.brand_id end actor_user_id,
       case when e.event_id%23=0 then 'c-missing' else b.creator_id end creator_id,
       case when e.event_id%17=0 then 'k-missing' else b.package_id end package_id,
       case when e.event_id%19=0 then 'cm-missing' when e.event_id%2=0 then b.campaign_id else '' end campaign_id,
       'note '||e.event_id notes
from (select event_id, (event_id*7) % """ + N + """ tk from {events} where event_type='purchase') e
join {bookings} b on b.k = e.tk
""",
    "cmd_t07": """
select event_id cmd_id, event_id seq, 'u-a-0' actor_user_id,
       case when event_id%37=0 then 'bk-missing-'||event_id
            else 'bk-'||""" + TK + """ end booking_id,
       case when event_id%31=0 then 'archived' when event_type='view' then 'accepted'
            when event_type='click' then 'cancelled' else 'completed' end status
from {events} where event_type in ('view','click','purchase')
""",
    "cmd_t08": """
select e.event_id cmd_id, e.event_id seq, case when e.event_type='click' then 'submit' else 'reject' end kind,
       case when (e.event_type='click') = (e.event_id%23<>0) then 'u-'||b.creator_id else 'u-'||b.brand_id end actor_user_id,
       'bk-'||e.tk booking_id,
       case when e.event_id%29=0 then 'doc'||e.event_id||'.pdf' when e.event_id%3=0 then 'Clip'||e.event_id||'.MP4'
            when e.event_id%3=1 then 'photo'||e.event_id||'.PnG' end file_name,
       case when e.event_id%29=0 then 'application/pdf' when e.event_id%3=0 then 'video/mp4'
            when e.event_id%3=1 then 'image/png' end mime_type,
       case when e.event_id%3=2 then 'https://x.test/'||e.event_id end content_url,
       case when e.event_id%2=0 then 'note '||e.event_id end content_note,
       case when e.event_id%4=1 then null else 'blurry '||e.event_id end rejection_reason
from (select event_id, event_type, """ + TK + """ tk from {events}
      where event_type in ('click','view')) e
join {bookings} b on b.k = e.tk
""",
    "cmd_t10": """
select event_id cmd_id, event_id seq, 'u-a-0' actor_user_id,
       'bk-'||""" + TK + """ booking_id, 'order_'||event_id order_id
from {events} where event_type='purchase'
""",
    "cmd_t11": {
        "spark": _T11.replace("{sig}", f"sha2(concat(unhex('{_OPAD}'), unhex(sha2(concat(unhex('{_IPAD}'), "
                                       f"cast({_MSG} as binary)), 256))), 256)"),
        "duckdb": _T11.replace("{sig}", f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || "
                                        f"encode({_MSG}))))"),
    },
    "cmd_t12": """
select event_id cmd_id, event_id seq, 'u-a-0' actor_user_id,
       'bk-'||""" + TK + """ booking_id
from {events} where event_type='error'
""",
    "cmd_t13": """
select event_id cmd_id, event_id seq,
       case when event_id%13=0 then 'u-b-1' else 'u-c-'||(user_id % (select count(*) from {supplier})) end actor_user_id,
       cast(cast(value*3 as decimal(12,2)) as string) amount,
       case when event_id%7<>0 and event_id%3<>0 then 'upi'||event_id end upi_id,
       case when event_id%7<>0 and event_id%3=0 then 'acct'||event_id end bank_account,
       case when event_id%7<>0 and event_id%3=0 then 'IFSC'||event_id end ifsc_code,
       case when event_id%7<>0 and event_id%3=0 then 'Holder '||event_id end account_holder
from {events} where event_type='purchase'
""",
    "cmd_t14": """
select e.event_id cmd_id, e.event_id seq, 'u-a-0' actor_user_id,
       case when e.event_id%11=0 then 'w-missing' else w.id end withdrawal_id,
       case e.event_id%3 when 0 then 'approved' when 1 then 'rejected' else 'paid' end status,
       case when e.event_id%2=0 then 'bad docs '||e.event_id end note
from (select event_id, (user_id*7) % """ + N + """ tk from {events} where event_type='error') e
join {withdrawals} w on w.id = 'w-'||(e.tk - e.tk%5 + 2)
""",
}

# orders and callbacks of one batch: a third for one accepted booking, the others for the accepted
# bookings whose number and the event's agree modulo a fifteenth of all, or for any booking
_FIFTEENTH = f"(1 + cast(({N} - {N} % 15) / 15 as bigint))"
_PAY = """
select e.event_id * """ + N + """ + e.k cmd_id, e.event_id * """ + N + """ + e.k seq,
       case when e.event_type in ('purchase','click') then 'order' else 'callback' end kind, 'u-b-1' actor_user_id,
       case when e.event_id%43=0 then 'bk-missing' else 'bk-'||e.k end booking_id, e.oid order_id,
       case when e.event_type not in ('purchase','click') then 'pay_'||e.event_id end payment_id,
       case when e.event_type in ('purchase','click') then cast(null as varchar(64)) when e.event_id%29=0 then 'bad-signature' else {sig} end signature
from (
  select event_id, event_type, k,
         case when event_id%47=0 then 'po-any-'||(event_id%5) when event_type not in ('purchase','click') and event_id%16=1 then 'ord-'||k
              else 'po-'||k||'-'||(case when event_id%3=0 then event_id%211 else event_id%6 end) end oid
  from (
    select event_id, event_type, (select min(k) from {bookings} where status='accepted') k from {events} where event_id%3=0
    union all
    select a.event_id, a.event_type, b.k
    from (select event_id, event_type, event_id % """ + _FIFTEENTH + """ em from {events} where event_id%3<>0) a
    join (select k, k % """ + _FIFTEENTH + """ bm from {bookings} where status='accepted') b on b.bm = a.em
    union all
    select a.event_id, a.event_type, b.k
    from (select event_id, event_type, (event_id*7) % """ + N + """ tk from {events} where event_id%3=1) a
    join {bookings} b on b.k = a.tk and b.status<>'accepted') x) e
"""
_PAY_MSG = "e.oid||'|'||'pay_'||e.event_id"
COMMAND_SQL["cmd_payment_batch"] = {
    "spark": _PAY.replace("{sig}", f"sha2(concat(unhex('{_OPAD}'), unhex(sha2(concat(unhex('{_IPAD}'), cast({_PAY_MSG} as binary)), 256))), 256)"),
    "duckdb": _PAY.replace("{sig}", f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode({_PAY_MSG}))))"),
}

# four events make two requests and two decisions: on the request before, on one three back, or on a stored withdrawal
_WD = """
select event_id cmd_id, event_id seq, case when event_id%4<2 then 'request' else 'decide' end kind,
       case when event_id%4>=2 then 'u-a-0' when event_id%61=0 then 'u-b-1' when event_id%3=0 then 'u-c-1'
            else 'u-c-'||(user_id % (select count(*) from {supplier})) end actor_user_id,
       case when event_id%4<2 then cast(cast(value * (case when event_id%7=0 then 90000 else 30 end) as decimal(12,2)) as string) end amount,
       case when event_id%4<2 and event_id%19<>0 and event_id%5<>0 then 'upi'||event_id end upi_id,
       case when event_id%4<2 and event_id%19<>0 and event_id%5=0 then 'acct'||event_id end bank_account,
       case when event_id%5=0 then 'IFSC'||event_id end ifsc_code, case when event_id%5=0 then 'Holder '||event_id end account_holder,
       case when event_id%4=2 and event_id%10=0 then w.id when event_id%4=2 then {one} when event_id%4=3 then {two} end withdrawal_id,
       case when event_id%4>=2 then case event_id%5 when 0 then 'rejected' when 1 then 'rejected' when 2 then 'paid' else 'approved' end end status,
       case when event_id%4=2 then 'bad docs '||event_id end note
from {events}
left join (select id, cast(substring(id, 3) as bigint) wk from {withdrawals}) w
  on w.wk = (event_id*7) % """ + N + """ - ((event_id*7) % """ + N + """) % 5 + 2
"""


def _request_id(cmd: str, hashed: str) -> str:
    return f"regexp_replace(substr({hashed.replace('?', cmd)}, 1, 32), '^(........)(....)(....)(....)(............)$', "


def _withdrawals(hashed: str, shape: str) -> str:
    one, two = (_request_id(f"cast(event_id - {n} as string)", hashed) + shape + ")" for n in (1, 3))
    return _WD.replace("{one}", one).replace("{two}", two)


COMMAND_SQL["cmd_withdrawal_batch"] = {
    "spark": _withdrawals("sha2('t13|'||?, 256)", "'$1-$2-$3-$4-$5'"),
    "duckdb": _withdrawals("sha256('t13|'||?)", r"'\1-\2-\3-\4-\5'"),
}

S = "(select count(*) from {supplier})"
C = "(select count(*) from {customer})"


def _pick(table: str, event_type: str) -> str:
    """Events of one type, each paired with a row of ``table`` that some key of
    the source tables names (an equi-join on the id; no numbering of rows)."""
    e = (f"(select event_id, user_id, value, (event_id*7) % {N} tk, event_id % (select count(*) from {{part}}) pk "
         f"from {{events}} where event_type='{event_type}') e")
    booking = f"{e} join {{bookings}} bb on bb.k = e.tk"
    # one line of the order, any of them, by the event's number
    line = (f"{e} join (select l_orderkey ok, count(*) nl from {{lineitem}} group by l_orderkey) ol on ol.ok = e.tk "
            f"join {{lineitem}} li on li.l_orderkey = e.tk and li.l_linenumber = 1 + e.event_id % ol.nl")
    request = "'cq-'||li.l_partkey||'-'||li.l_suppkey"
    source, target = {
        "promotion_packages": (booking, "bb.package_id"),
        "campaigns": (booking, "'cm-'||substring(bb.brand_id,3)||'-'||(1+e.event_id%5)"),
        "collaborations": (e, "'cl-'||e.pk"),
        "collaboration_requests": (line, request),
        "collaboration_participants": (line, f"case when e.event_id%2=0 then 'h-cl-'||e.pk else 'j-'||{request} end"),
    }[table]
    return f"{source} join {{{table}}} t on t.id = {target}"


COMMAND_SQL.update({
    "cmd_t01": """
select event_id cmd_id, event_id seq, 'New User '||event_id name,
       case when event_id%13=0 then 'c'||(user_id % """ + S + """)||'@creator.test'
            when event_id%11=0 then 'Dup'||user_id||'@new.test'
            else 'new'||event_id||'@new.test' end email,
       event_id%17<>0 password_given,
       case event_id%5 when 0 then 'bad' when 1 then 'brand' when 2 then 'admin' else 'creator' end role,
       case when event_id%3=0 then 'Co '||event_id end company_name,
       case when event_id%7=0 then 'creator_'||(user_id % """ + S + """)
            when event_id%7=1 then 'handle'||(user_id % 20) end username
from {events} where event_type='signup'
""",
    "cmd_t02": """
select event_id cmd_id, event_id seq,
       case when event_id%9=0 then 'github' when event_id%2=0 then 'google' else 'facebook' end provider,
       'pid'||user_id provider_id,
       case when event_id%4=0 then 'c'||(user_id % """ + S + """)||'@creator.test'
            when event_id%4=1 then 'social'||user_id||'@new.test' end email,
       'Social  User '||user_id name, 'https://img.test/'||user_id avatar_url
from {events} where event_type='signup'
""",
    "cmd_t03_platforms": """
select event_id cmd_id, event_id seq,
       case when event_id%9=0 then 'u-b-1' else 'u-c-'||(user_id % """ + S + """) end actor_user_id,
       case when event_id%10=0 then null else 'Net'||(event_id%4) end platform_name, '@n'||event_id username,
       'https://n.test/'||event_id profile_url, cast(event_id*10 as int) followers,
       cast(cast(event_id % 1000 as decimal(10,0)) * 0.01 as decimal(5,2)) engagement_rate
from {events} where event_type='click'
""",
    "cmd_t03_packages": """
select event_id cmd_id, event_id seq,
       case when event_id%9=0 then 'u-b-1' else 'u-c-'||(user_id % """ + S + """) end actor_user_id,
       case when event_id%10=0 then null else 'Pkg '||event_id end package_name, 'desc '||event_id description,
       cast(value*100 as decimal(12,2)) price, cast(1+event_id%9 as int) delivery_days
from {events} where event_type='view'
""",
    "cmd_t03_campaigns": """
select event_id cmd_id, event_id seq,
       case when event_id%9=0 then 'u-c-1' else 'u-b-'||(user_id % """ + C + """) end actor_user_id,
       case when event_id%10=0 then null else 'Camp '||event_id end title, 'brief '||event_id description,
       cast(value*1000 as decimal(12,2)) budget, case when event_id%2=0 then 'Food' else 'Memes' end category
from {events} where event_type='purchase'
""",
    "cmd_t04_packages": """
select e.event_id cmd_id, e.event_id seq,
       case when e.event_id%2=0 then 'u-'||t.creator_id else 'u-c-1' end actor_user_id,
       case when e.event_id%19=0 then 'k-missing' else t.id end target_id,
       'Renamed '||e.event_id package_name, cast(null as string) description,
       cast(e.value*50 as decimal(12,2)) price,
       case when e.event_id%13=0 then null else cast(2+e.event_id%5 as int) end delivery_days
from """ + _pick("promotion_packages", "click") + """
""",
    "cmd_t04_campaigns": """
select e.event_id cmd_id, e.event_id seq,
       case when e.event_id%2=0 then 'u-'||t.brand_id else 'u-b-1' end actor_user_id, t.id target_id,
       'Retitled '||e.event_id title, 'new brief' description, cast(e.value*500 as decimal(12,2)) budget,
       'Food' category, case when e.event_id%7=0 then 'bogus' else 'paused' end status
from """ + _pick("campaigns", "view") + """
""",
    "cmd_t04_profile": """
select event_id cmd_id, event_id seq, 'u-c-'||(user_id % """ + S + """) actor_user_id, 'bio '||event_id bio,
       'Food' category, 'City '||(event_id%5) city, 'Country' country,
       case when event_id%7=0 then null
            when event_id%5=0 then 'creator_'||((user_id+1) % """ + S + """)
            else 'creator_'||(user_id % """ + S + """) end username
from {events} where event_type='signup'
""",
    "cmd_t04_avatar": """
select event_id cmd_id, event_id seq, 'u-c-'||(user_id % """ + S + """) actor_user_id,
       case when event_id%11=0 then null else '/uploads/a'||event_id||'.png' end avatar_url
from {events} where event_type='error'
""",
    "cmd_t05_packages": """
select e.event_id cmd_id, e.event_id seq,
       case when e.event_id%2=0 then 'u-'||t.creator_id else 'u-c-1' end actor_user_id, t.id target_id
from """ + _pick("promotion_packages", "error") + """
""",
    "cmd_t05_campaigns": """
select e.event_id cmd_id, e.event_id seq,
       case when e.event_id%2=0 then 'u-'||t.brand_id else 'u-b-1' end actor_user_id, t.id target_id
from """ + _pick("campaigns", "error") + """
""",
    "cmd_t15": """
select e.event_id cmd_id, e.event_id seq,
       case when e.event_id%13=0 then 'u-'||b.creator_id else 'u-'||b.brand_id end actor_user_id,
       case when e.event_id%29=0 then '' else b.id end booking_id,
       case when e.event_id%17=0 then 0 else cast(1+e.event_id%7 as int) end rating, 'nice '||e.event_id comment
from (select event_id, """ + TK + """ tk from {events} where event_type='view') e
join {bookings} b on b.k = e.tk
""",
    "cmd_t16": """
select event_id cmd_id, event_id seq,
       case when event_id%9=0 then 'u-b-1' else 'u-c-'||(user_id % """ + S + """) end actor_user_id,
       case when event_id%10=0 then '' else 'Collab '||event_id end title, 'about '||event_id description,
       'YouTube' platform, 'Food' category, 'City' location,
       case when event_id%2=0 then null else cast(1000*(event_id%5) as int) end followers_required,
       'paid' collaboration_type
from {events} where event_type='click'
""",
    "cmd_t17": """
select event_id cmd_id, event_id seq,
       case when event_id%9=0 then 'u-b-1' else 'u-c-'||(user_id % """ + S + """) end actor_user_id,
       'cl-'||(event_id % (select count(*) from {part})) collaboration_id,
       case when event_id%2=0 then 'please '||event_id end message
from {events} where event_type='view'
""",
    "cmd_t18": """
select e.event_id cmd_id, e.event_id seq,
       case when e.event_id%5=0 then 'u-c-1' else 'u-'||c.creator_id end actor_user_id,
       t.collaboration_id, case when e.event_id%11=0 then 'cq-missing' else t.id end request_id,
       case when e.event_id%3=0 then 'reject' else 'accept' end decision
from """ + _pick("collaboration_requests", "click") + """
join {collaborations} c on c.id = t.collaboration_id
""",
    "cmd_t19": """
select e.event_id cmd_id, e.event_id seq,
       case when e.event_id%4=0 then 'u-c-1' else 'u-'||t.creator_id end actor_user_id, t.id collaboration_id
from """ + _pick("collaborations", "purchase") + """
""",
    "cmd_t20": """
select e.event_id cmd_id, e.event_id seq,
       case when e.event_id%6=0 then 'u-c-'||(e.user_id % """ + S + """) else 'u-'||t.creator_id end actor_user_id,
       t.collaboration_id, case when e.event_id%31=0 then '   ' when e.event_id%31=1 then chr(10)||chr(9)||' ' else 'hi '||e.event_id end message
from """ + _pick("collaboration_participants", "signup") + """
""",
    "cmd_t21": """
select event_id cmd_id, event_id seq,
       case when event_id%3=0 then 'u-c-'||(user_id % """ + S + """) when event_id%3=1 then 'u-b-'||(user_id % """ + C + """)
            else 'u-a-0' end actor_user_id,
       case when event_id%17=0 then null when event_id%19=0 then 'u-missing'
            else 'u-c-'||((user_id+3) % """ + S + """) end receiver_id,
       case when event_id%23=0 then 'bk-missing' when event_id%2=0 then 'bk-'||((event_id*7) % """ + N + """) end booking_id,
       'hello '||event_id message
from {events} where event_type='click'
""",
    "cmd_t22": """
select event_id cmd_id, event_id seq, 'u-c-'||(user_id % """ + S + """) actor_user_id,
       case when event_id%2=0 then null else 'n-'||(event_id-1) end notification_id
from {events} where event_type='view'
""",
    "cmd_t23": """
select event_id cmd_id, event_id seq, 'u-a-0' actor_user_id,
       case when event_id%2=0 then 'u-c-'||(user_id % """ + S + """) else 'u-b-'||(user_id % """ + C + """) end user_id
from {events} where event_type='error'
""",
    "cmd_t24": """
select event_id cmd_id, event_id seq, 'u-a-0' actor_user_id, 'u-b-'||(user_id % """ + C + """) user_id,
       case event_id%4 when 0 then 'creator' when 1 then 'brand' when 2 then 'admin' else 'superuser' end role
from {events} where event_type='signup'
""",
    "cmd_t25": """
select event_id cmd_id, event_id seq, 'u-a-0' actor_user_id,
       case when event_id%13=0 then 'c-missing' else 'c-'||(user_id % """ + S + """) end creator_profile_id,
       event_id%2=0 verified
from {events} where event_type='click'
""",
    "cmd_t26": """
select e.event_id cmd_id, e.event_id seq, 'u-'||t.creator_id actor_user_id, t.collaboration_id,
       case when e.event_id%7=0 then t.creator_id when e.event_id%19=0 then 'c-missing'
            else 'c-'||(e.user_id % """ + S + """) end creator_id,
       cast(1+e.event_id%6 as int) rating, 'great '||e.event_id comment
from """ + _pick("collaboration_participants", "purchase") + """
""",
})

P = "(select count(*) from {part})"

COMMAND_SQL.update({
    # stream inputs (W1-W3): notification events and socket presence events
    "notify_events": """
select case event_type when 'view' then 'booking_created' when 'click' then 'collab_message'
                       when 'purchase' then 'payment_received' when 'signup' then 'collab_review'
                       else 'withdrawal_rejected' end event,
       cast(event_id as string) event_key,
       case when event_type='click' then cast(null as string) else 'u-c-'||(user_id % """ + S + """) end user_id,
       case when event_type='click' then 'cl-'||(event_id % """ + P + """) else 'bk-'||event_id end ref_id,
       cast(null as string) title_text, value amount,
       case when event_id%2=0 then 'note '||event_id end note, cast(1+event_id%5 as string) rating,
       cast(null as string) sender_label, ts created_at, 'u-c-'||(user_id % """ + S + """) actor_user_id
from {events}
""",
    "presence_events": """
select event_id eid, ts, 'u-c-'||(user_id % """ + S + """) user_id,
       's-'||(user_id % """ + S + """)||'-'||(event_id%3) socket_id,
       case when event_type='signup' then 'register' else 'disconnect' end kind
from {events} where event_type in ('signup','error')
""",
})
