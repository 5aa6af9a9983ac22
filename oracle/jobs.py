"""DuckDB oracles for the table jobs.

Each job is re-derived in SQL from the reference handlers' gate order;
in-batch ordering uses ROW_NUMBER / LAG / running aggregates per key.
"""

from __future__ import annotations

from souk.catalog import BATCH_TS
from oracle.queries import dbl

TS = f"TIMESTAMP '{BATCH_TS}'"
BOOKING_ENUM = "('pending','accepted','content_submitted','content_rejected','completed','cancelled')"


def uid(*parts: str) -> str:
    """det_uuid: sha256 of the parts joined by '|', shaped 8-4-4-4-12."""
    return (f"regexp_replace(substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 32), "
            r"'^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')")


def nid(job: str, key: str = "cmd_id", user: str = "user_id") -> str:
    return uid(f"'{job}'", "'n'", f"CAST({key} AS VARCHAR)", user)


def locale(x: str) -> str:
    """toLocaleString() of a non-negative amount: thousands separators, at most 3 decimals."""
    return (f"(format('{{:,}}', CAST(floor({x}) AS BIGINT)) || CASE WHEN {x} = floor({x}) THEN '' "
            f"ELSE '.' || rtrim(substr(format('{{:.3f}}', {x} - floor({x})), 3), '0') END)")


def notif(job: str, src: str, user: str, title: str | None, message: str, link: str | None,
          key: str = "cmd_id") -> str:
    t = f"'{title}'" if title else "'Notification'"
    lk = f"{link}" if link else "CAST(NULL AS VARCHAR)"
    return (f"SELECT {nid(job, key, user)} AS id, {user} AS user_id, {t} AS title, {message} AS message, "
            f"{lk} AS link, FALSE AS is_read, {TS} AS created_at FROM {src}")


def rejects(src: str = "r") -> str:
    return f"SELECT cmd_id, reason FROM {src} WHERE reason IS NOT NULL"


# ------------------------------------------------------------------ T6
T06 = f"""
WITH c AS (
  SELECT c.*, bp.id AS bp_id, pkg.id AS pkg, pkg.price AS pprice, cm.id AS cm, cp.id AS cpid, cp.user_id AS cuser
  FROM cmd_t06 c
  LEFT JOIN brand_profiles bp ON bp.user_id = c.actor_user_id
  LEFT JOIN promotion_packages pkg ON pkg.id = c.package_id
  LEFT JOIN campaigns cm ON cm.id = c.campaign_id AND cm.brand_id = bp.id
  LEFT JOIN creator_profiles cp ON cp.id = c.creator_id),
r AS (SELECT *, CASE WHEN bp_id IS NULL THEN 'no_brand_profile' WHEN pkg IS NULL THEN 'package_not_found'
                     WHEN coalesce(campaign_id, '') <> '' AND cm IS NULL THEN 'campaign_not_owned'
                     WHEN cpid IS NULL THEN 'creator_not_found' END AS reason,
             {uid("'t06'", "CAST(cmd_id AS VARCHAR)")} AS new_bid FROM c)
"""
T06_BOOKINGS = dbl(T06 + f"""
SELECT * FROM bookings UNION ALL
SELECT new_bid, bp_id, creator_id, package_id, CASE WHEN coalesce(campaign_id, '') <> '' THEN campaign_id END,
       'pending', pprice, notes, NULL, NULL, NULL, NULL, {TS} FROM r WHERE reason IS NULL""", "price")
T06_NOTIF = T06 + notif("t06", "r WHERE reason IS NULL", "cuser", "New Booking Request",
                        "'You have a new booking request from a brand. Booking #' || new_bid", "'/creator/bookings'")

# ------------------------------------------------------------------ T7
T07 = f"""
WITH c AS (SELECT c.*, b.id AS bid, b.creator_id AS bcreator, b.price AS bprice
           FROM cmd_t07 c LEFT JOIN bookings b ON b.id = c.booking_id),
r AS (SELECT *, CASE WHEN bid IS NULL THEN 'not_found' WHEN status NOT IN {BOOKING_ENUM} THEN 'enum' END AS reason
      FROM c),
last AS (SELECT booking_id, status FROM (
           SELECT booking_id, status, row_number() OVER (PARTITION BY booking_id ORDER BY seq DESC) AS rn
           FROM r WHERE reason IS NULL) x WHERE rn = 1),
done AS (SELECT DISTINCT booking_id, bcreator, bprice FROM r WHERE reason IS NULL AND status = 'completed')
"""
T07_BOOKINGS = dbl(T07 + """
SELECT b.* REPLACE (coalesce(last.status, b.status) AS status) FROM bookings b LEFT JOIN last ON last.booking_id = b.id""",
                   "price")
T07_ESCROW = dbl(T07 + """
SELECT e.* REPLACE (CASE WHEN e.booking_id IN (SELECT booking_id FROM done) THEN 'released' ELSE e.status END AS status)
FROM escrow_wallet e""", "amount")
T07_EARNINGS = dbl(T07 + f"""
SELECT * FROM creator_earnings UNION ALL
SELECT {uid("'t07'", "d.booking_id")}, d.bcreator, d.booking_id, d.bprice, 'paid', {TS}
FROM done d WHERE NOT EXISTS (SELECT 1 FROM creator_earnings ce WHERE ce.booking_id = d.booking_id)""", "amount")
T07_NOTIF = T07 + notif("t07", "r JOIN creator_profiles cp ON cp.id = r.bcreator WHERE r.reason IS NULL AND r.status = 'completed'",
                        "cp.user_id", "Payment Released",
                        "'Booking #' || r.booking_id || ' is completed and payment has been released!'",
                        "'/creator/earnings'", key="r.cmd_id")

# ------------------------------------------------------------------ T8 + T9
T08 = """
WITH info AS (
  SELECT b.id AS bid, b.status AS status0, cp.user_id AS creator_user, bp.user_id AS brand_user,
         EXISTS (SELECT 1 FROM payments p WHERE p.booking_id = b.id AND p.payment_status = 'completed') AS paid
  FROM bookings b LEFT JOIN creator_profiles cp ON cp.id = b.creator_id LEFT JOIN brand_profiles bp ON bp.id = b.brand_id),
c AS (
  SELECT c.*, i.*,
    lower(regexp_extract(c.file_name, '[^/\\\\](\\.[^./\\\\]*)$', 1)) AS ext,
    CASE WHEN c.kind = 'submit' AND coalesce(c.file_name, '') <> ''
              AND NOT regexp_matches(lower(regexp_extract(c.file_name, '[^/\\\\](\\.[^./\\\\]*)$', 1)), 'jpeg|jpg|png|gif|webp|mp4|mov|avi|mkv|webm')
              AND NOT regexp_matches(coalesce(c.mime_type, ''), 'jpeg|jpg|png|gif|webp|mp4|mov|avi|mkv|webm') THEN 'file_type'
         WHEN i.bid IS NULL THEN 'not_found'
         WHEN c.kind = 'submit' AND coalesce(i.creator_user = c.actor_user_id, FALSE) = FALSE THEN 'not_your_booking'
         WHEN c.kind = 'reject' AND coalesce(i.brand_user = c.actor_user_id, FALSE) = FALSE THEN 'not_your_booking'
    END AS pre,
    CASE WHEN c.kind = 'submit' AND NOT i.paid THEN 'unpaid'
         WHEN c.kind = 'submit' AND coalesce(c.file_name, '') = '' AND coalesce(c.content_url, '') = '' THEN 'no_content'
    END AS post,
    CASE WHEN i.status0 IN ('accepted', 'content_rejected') THEN 'A' WHEN i.status0 = 'content_submitted' THEN 'B'
         ELSE 'X' END AS cls0
  FROM cmd_t08 c LEFT JOIN info i ON i.bid = c.booking_id),
eff AS (SELECT cmd_id, booking_id, seq, kind, cls0,
               lag(kind) OVER (PARTITION BY booking_id ORDER BY seq) AS prev FROM c WHERE pre IS NULL AND post IS NULL),
eff2 AS (SELECT *, (prev IS NULL OR prev <> kind) AS start FROM eff),
eff3 AS (SELECT *, sum(CAST(start AS INTEGER)) OVER (PARTITION BY booking_id ORDER BY seq
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM eff2),
valid AS (SELECT cmd_id FROM eff3 WHERE cls0 <> 'X' AND start
            AND (run > 1 OR (kind = 'submit' AND cls0 = 'A') OR (kind = 'reject' AND cls0 = 'B'))),
c2 AS (SELECT c.*, c.cmd_id IN (SELECT cmd_id FROM valid) AS ok FROM c),
c3 AS (SELECT *, last(CASE WHEN ok THEN kind END IGNORE NULLS) OVER (PARTITION BY booking_id ORDER BY seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kb FROM c2),
r AS (SELECT *, coalesce(pre,
        CASE WHEN NOT ((kind = 'submit' AND coalesce(CASE kb WHEN 'submit' THEN 'B' WHEN 'reject' THEN 'A' END, cls0) = 'A')
                    OR (kind = 'reject' AND coalesce(CASE kb WHEN 'submit' THEN 'B' WHEN 'reject' THEN 'A' END, cls0) = 'B'))
             THEN 'bad_status' END, post) AS reason,
        CASE WHEN coalesce(file_name, '') <> ''
             THEN '/uploads/content/content_' || actor_user_id || '_' || CAST(cmd_id AS VARCHAR) || regexp_extract(file_name, '[^/\\\\](\\.[^./\\\\]*)$', 1)
             ELSE content_url END AS url,
        CASE WHEN coalesce(file_name, '') <> ''
             THEN CASE WHEN ext IN ('.mp4', '.mov', '.avi', '.mkv', '.webm') THEN 'video' ELSE 'image' END
             ELSE 'url' END AS ctype,
        CASE WHEN coalesce(content_note, '') <> '' THEN content_note END AS note,
        CASE WHEN coalesce(rejection_reason, '') <> '' THEN rejection_reason ELSE 'Content did not meet requirements' END AS rtext
      FROM c3),
lastv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY seq DESC) AS rn
                         FROM r WHERE reason IS NULL) x WHERE rn = 1),
lasts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY seq DESC) AS rn
                         FROM r WHERE reason IS NULL AND kind = 'submit') x WHERE rn = 1)
"""
T08_BOOKINGS = dbl(T08 + """
SELECT b.* REPLACE (
  CASE WHEN lv.booking_id IS NULL THEN b.status WHEN lv.kind = 'submit' THEN 'content_submitted' ELSE 'content_rejected' END AS status,
  CASE WHEN ls.booking_id IS NOT NULL THEN ls.url ELSE b.content_url END AS content_url,
  CASE WHEN ls.booking_id IS NOT NULL THEN ls.ctype ELSE b.content_type END AS content_type,
  CASE WHEN ls.booking_id IS NOT NULL THEN ls.note ELSE b.content_note END AS content_note,
  CASE WHEN lv.booking_id IS NULL THEN b.rejection_reason WHEN lv.kind = 'reject' THEN lv.rtext END AS rejection_reason)
FROM bookings b LEFT JOIN lastv lv ON lv.booking_id = b.id LEFT JOIN lasts ls ON ls.booking_id = b.id""", "price")
T08_NOTIF = T08 + f"""
SELECT * FROM (
{notif("t08", "r WHERE reason IS NULL AND kind = 'submit'", "brand_user", None,
       "'Creator has submitted content for Booking #' || booking_id || '. Please review it.'", None)}
UNION ALL
{notif("t08", "r WHERE reason IS NULL AND kind = 'reject'", "creator_user", None,
       "'Your content for Booking #' || booking_id || ' was rejected. Reason: ' || rtext || '. Please resubmit.'", None)}
) n WHERE user_id IS NOT NULL"""

# ------------------------------------------------------------------ T10
T10 = """
WITH c AS (SELECT c.*, b.id AS bid, b.status AS bstatus, b.price AS bprice,
                  EXISTS (SELECT 1 FROM payments p WHERE p.booking_id = c.booking_id AND p.payment_status = 'completed') AS paid
           FROM cmd_t10 c LEFT JOIN bookings b ON b.id = c.booking_id),
r AS (SELECT *, CASE WHEN bid IS NULL THEN 'not_found' WHEN bstatus <> 'accepted' THEN 'not_accepted'
                     WHEN paid THEN 'already_paid' END AS reason FROM c),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY seq DESC) AS rn
                        FROM r WHERE reason IS NULL) x WHERE rn = 1),
openp AS (SELECT * FROM (SELECT id, booking_id, row_number() OVER (PARTITION BY booking_id ORDER BY created_at, id) AS rn
                         FROM payments WHERE payment_status <> 'completed') x WHERE rn = 1)
"""
T10_PAYMENTS = dbl(T10 + f"""
SELECT p.* REPLACE (
  CASE WHEN l.booking_id IS NOT NULL THEN l.order_id ELSE p.razorpay_order_id END AS razorpay_order_id,
  CASE WHEN l.booking_id IS NOT NULL THEN NULL ELSE p.razorpay_payment_id END AS razorpay_payment_id,
  CASE WHEN l.booking_id IS NOT NULL THEN 'pending' ELSE p.payment_status END AS payment_status)
FROM payments p LEFT JOIN openp op ON op.id = p.id LEFT JOIN last l ON l.booking_id = op.booking_id
UNION ALL
SELECT {uid("'t10'", "l.booking_id")}, l.booking_id, l.order_id, CAST(NULL AS VARCHAR), l.bprice, 'pending', {TS}
FROM last l WHERE NOT EXISTS (SELECT 1 FROM openp op WHERE op.booking_id = l.booking_id)""", "amount")
T10_ORDERS = T10 + """
SELECT cmd_id, booking_id, order_id, CAST(round(bprice * 100) AS BIGINT) AS amount_paise, 'INR' AS currency
FROM r WHERE reason IS NULL"""

# ------------------------------------------------------------------ T11
_IPAD_OPAD = None


def _t11() -> str:
    from souk.sources.commands import TEST_KEY
    k = TEST_KEY.ljust(64, b"\x00")
    ipad, opad = bytes(b ^ 0x36 for b in k).hex(), bytes(b ^ 0x5C for b in k).hex()
    msg = "encode(order_id || '|' || payment_id)"
    sig = f"sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || {msg})))"
    return f"""
WITH c AS (SELECT c.*, b.id AS bid, b.price AS bprice, b.creator_id AS bcreator, b.brand_id AS bbrand
           FROM cmd_t11 c LEFT JOIN bookings b ON b.id = c.booking_id),
r AS (SELECT *, CASE WHEN {sig} <> signature THEN 'signature_mismatch' WHEN bid IS NULL THEN 'booking_not_found' END AS reason
      FROM c),
lastp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY seq DESC) AS rn
                         FROM r WHERE reason IS NULL) x WHERE rn = 1),
held AS (SELECT DISTINCT booking_id, bprice FROM r WHERE reason IS NULL)
"""


T11 = _t11()
T11_PAYMENTS = dbl(T11 + """
SELECT p.* REPLACE (CASE WHEN l.order_id IS NOT NULL THEN l.payment_id ELSE p.razorpay_payment_id END AS razorpay_payment_id,
                    CASE WHEN l.order_id IS NOT NULL THEN 'completed' ELSE p.payment_status END AS payment_status)
FROM payments p LEFT JOIN lastp l ON l.order_id = p.razorpay_order_id""", "amount")
T11_ESCROW = dbl(T11 + f"""
SELECT e.* REPLACE (CASE WHEN e.booking_id IN (SELECT booking_id FROM held) THEN 'held' ELSE e.status END AS status)
FROM escrow_wallet e
UNION ALL
SELECT {uid("'t11'", "h.booking_id")}, h.booking_id, h.bprice, 'held', {TS} FROM held h
WHERE NOT EXISTS (SELECT 1 FROM escrow_wallet e WHERE e.booking_id = h.booking_id)""", "amount")
T11_NOTIF = T11 + notif("t11", "r JOIN brand_profiles bp ON bp.id = r.bbrand JOIN creator_profiles cp ON cp.id = r.bcreator "
                               "WHERE r.reason IS NULL", "cp.user_id", None,
                        "'Payment received for booking #' || r.booking_id || '. Please submit your content.'", None,
                        key="r.cmd_id")

# ------------------------------------------------------------------ T12
T12 = """
WITH held AS (SELECT DISTINCT booking_id FROM escrow_wallet WHERE status = 'held'),
hamt AS (SELECT booking_id, min(amount) AS amount FROM escrow_wallet WHERE status = 'held' GROUP BY booking_id),
c AS (SELECT c.*, c.booking_id IN (SELECT booking_id FROM held) AS has_held FROM cmd_t12 c),
r AS (SELECT *, CASE WHEN NOT has_held OR row_number() OVER (PARTITION BY booking_id, has_held ORDER BY seq) > 1
                     THEN 'no_held_escrow' END AS reason FROM c),
rel AS (SELECT booking_id FROM r WHERE reason IS NULL)
"""
T12_ESCROW = dbl(T12 + """
SELECT e.* REPLACE (CASE WHEN e.booking_id IN (SELECT booking_id FROM rel) THEN 'released' ELSE e.status END AS status)
FROM escrow_wallet e""", "amount")
T12_BOOKINGS = dbl(T12 + """
SELECT b.* REPLACE (CASE WHEN b.id IN (SELECT booking_id FROM rel) THEN 'completed' ELSE b.status END AS status)
FROM bookings b""", "price")
T12_NOTIF = T12 + notif("t12", "r JOIN bookings b ON b.id = r.booking_id JOIN creator_profiles cp ON cp.id = b.creator_id "
                               "JOIN hamt h ON h.booking_id = r.booking_id WHERE r.reason IS NULL", "cp.user_id", None,
                        f"'Payment of ₹' || {locale('CAST(h.amount AS DOUBLE)')} || ' released for booking #' || r.booking_id || '. 🎉'",
                        None, key="r.cmd_id")
T12_AUDIT = T12 + f"""
SELECT {uid("'t12'", "'a'", "CAST(cmd_id AS VARCHAR)")} AS id, 'Released escrow payment for booking #' || booking_id AS action,
       actor_user_id AS admin_id, {TS} AS created_at FROM r WHERE reason IS NULL"""

# ------------------------------------------------------------------ T13
T13 = """
WITH bal AS (
  SELECT cp.id AS cid,
         coalesce((SELECT CAST(sum(amount) AS DOUBLE) FROM creator_earnings e WHERE e.creator_id = cp.id AND e.status = 'paid'), 0)
       - coalesce((SELECT CAST(sum(amount) AS DOUBLE) FROM withdrawals w WHERE w.creator_id = cp.id AND w.status IN ('pending', 'approved')), 0) AS avail0,
         EXISTS (SELECT 1 FROM withdrawals w WHERE w.creator_id = cp.id AND w.status = 'pending') AS pending0
  FROM creator_profiles cp),
c AS (
  SELECT c.*, cp.id AS cpid, TRY_CAST(regexp_extract(c.amount, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)', 1) AS DOUBLE) AS amt,
         coalesce(b.avail0, 0) AS avail0, coalesce(b.pending0, FALSE) AS pending0
  FROM cmd_t13 c LEFT JOIN creator_profiles cp ON cp.user_id = c.actor_user_id LEFT JOIN bal b ON b.cid = cp.id),
s AS (SELECT *, CASE WHEN coalesce(amount, '') = '' OR amt IS NULL OR amt < 100 THEN 'min_amount'
                     WHEN coalesce(upi_id, '') = '' AND coalesce(bank_account, '') = '' THEN 'no_payout_details'
                     WHEN cpid IS NULL THEN 'no_profile' END AS static,
             CAST(amt AS DECIMAL(12,2)) AS stored FROM c),
win AS (SELECT cpid AS wc, min(seq) AS wseq FROM s WHERE static IS NULL AND amt <= avail0 AND NOT pending0 GROUP BY cpid),
w2 AS (SELECT win.*, s.stored AS wstored FROM win JOIN s ON s.cpid = win.wc AND s.seq = win.wseq),
r AS (SELECT s.*, coalesce(static,
        CASE WHEN amt > CASE WHEN w2.wseq IS NOT NULL AND s.seq > w2.wseq THEN avail0 - CAST(w2.wstored AS DOUBLE) ELSE avail0 END
             THEN 'insufficient_balance' END,
        CASE WHEN pending0 OR (w2.wseq IS NOT NULL AND s.seq > w2.wseq) THEN 'pending_exists' END) AS reason
      FROM s LEFT JOIN w2 ON w2.wc = s.cpid)
"""
T13_WITHDRAWALS = dbl(T13 + f"""
SELECT * FROM withdrawals UNION ALL
SELECT {uid("'t13'", "CAST(cmd_id AS VARCHAR)")}, cpid, stored, 'pending',
       '{{' || concat_ws(',', CASE WHEN upi_id IS NOT NULL THEN '"upi_id":' || to_json(upi_id) END,
                              CASE WHEN bank_account IS NOT NULL THEN '"bank_account":' || to_json(bank_account) END,
                              CASE WHEN ifsc_code IS NOT NULL THEN '"ifsc_code":' || to_json(ifsc_code) END,
                              CASE WHEN account_holder IS NOT NULL THEN '"account_holder":' || to_json(account_holder) END) || '}}',
       {TS} FROM r WHERE reason IS NULL""", "amount")
T13_NOTIF = T13 + notif("t13", "r WHERE reason IS NULL", "actor_user_id", None,
                        f"'Withdrawal request of ₹' || {locale('amt')} || ' submitted. We''ll process it within 2-3 business days.'",
                        None)

# ------------------------------------------------------------------ T14
T14 = """
WITH c AS (SELECT c.*, w.id AS wid, w.creator_id AS wc, w.amount AS wamount
           FROM cmd_t14 c LEFT JOIN withdrawals w ON w.id = c.withdrawal_id),
r AS (SELECT *, CASE WHEN status NOT IN ('approved', 'rejected') OR status IS NULL THEN 'invalid_status'
                     WHEN wid IS NULL THEN 'not_found' END AS reason FROM c),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY withdrawal_id ORDER BY seq DESC) AS rn
                        FROM r WHERE reason IS NULL) x WHERE rn = 1)
"""
T14_WITHDRAWALS = dbl(T14 + """
SELECT w.* REPLACE (coalesce(l.status, w.status) AS status) FROM withdrawals w LEFT JOIN last l ON l.withdrawal_id = w.id""",
                      "amount")
T14_NOTIF = T14 + notif(
    "t14", "r JOIN creator_profiles cp ON cp.id = r.wc JOIN users u ON u.id = cp.user_id WHERE r.reason IS NULL", "u.id", None,
    f"CASE WHEN r.status = 'approved' THEN '✅ Your withdrawal of ₹' || {locale('CAST(r.wamount AS DOUBLE)')} || "
    "' has been approved! Funds will be transferred within 1-2 business days.' "
    f"ELSE '❌ Your withdrawal request of ₹' || {locale('CAST(r.wamount AS DOUBLE)')} || ' was rejected. ' || "
    "CASE WHEN coalesce(r.note, '') <> '' THEN r.note ELSE 'Please contact support.' END END", None, key="r.cmd_id")
T14_AUDIT = T14 + f"""
SELECT {uid("'t14'", "'a'", "CAST(cmd_id AS VARCHAR)")} AS id,
       'Approved withdrawal #' || withdrawal_id || ' of ₹' || CAST(wamount AS VARCHAR) || ' for creator #' || wc AS action,
       actor_user_id AS admin_id, {TS} AS created_at FROM r WHERE reason IS NULL AND status = 'approved'"""

SQL: dict[str, str] = {
    "t06_create_bookings__bookings": T06_BOOKINGS,
    "t06_create_bookings__rejects": T06 + rejects(),
    "t06_create_bookings__notifications": T06_NOTIF,
    "t07_booking_status__bookings": T07_BOOKINGS,
    "t07_booking_status__escrow_wallet": T07_ESCROW,
    "t07_booking_status__creator_earnings": T07_EARNINGS,
    "t07_booking_status__rejects": T07 + rejects(),
    "t07_booking_status__notifications": T07_NOTIF,
    "t08_content_review__bookings": T08_BOOKINGS,
    "t08_content_review__rejects": T08 + rejects(),
    "t08_content_review__notifications": T08_NOTIF,
    "t10_payment_orders__payments": T10_PAYMENTS,
    "t10_payment_orders__rejects": T10 + rejects(),
    "t10_payment_orders__orders": T10_ORDERS,
    "t11_settle_payments__payments": T11_PAYMENTS,
    "t11_settle_payments__escrow_wallet": T11_ESCROW,
    "t11_settle_payments__rejects": T11 + rejects(),
    "t11_settle_payments__notifications": T11_NOTIF,
    "t12_release_escrow__escrow_wallet": T12_ESCROW,
    "t12_release_escrow__bookings": T12_BOOKINGS,
    "t12_release_escrow__rejects": T12 + rejects(),
    "t12_release_escrow__notifications": T12_NOTIF,
    "t12_release_escrow__audit": T12_AUDIT,
    "t13_request_withdrawals__withdrawals": T13_WITHDRAWALS,
    "t13_request_withdrawals__rejects": T13 + rejects(),
    "t13_request_withdrawals__notifications": T13_NOTIF,
    "t14_decide_withdrawals__withdrawals": T14_WITHDRAWALS,
    "t14_decide_withdrawals__rejects": T14 + rejects(),
    "t14_decide_withdrawals__notifications": T14_NOTIF,
    "t14_decide_withdrawals__audit": T14_AUDIT,
}
