"""DuckDB oracles for batches whose commands depend on each other: the state of
each key is carried from command to command by a recursive query."""

from __future__ import annotations

from oracle.jobs import TS, locale, notif, rejects, uid
from oracle.queries import dbl


def _signature() -> str:
    from souk.sources.commands import TEST_KEY
    k = TEST_KEY.ljust(64, b"\x00")
    ipad, opad = bytes(b ^ 0x36 for b in k).hex(), bytes(b ^ 0x5C for b in k).hex()
    return f"sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode(order_id || '|' || payment_id))))"


# ------------------------------------------------------------------ T10 + T11
# a booking's state is the order id on its first open payment and the command that paid it
PAY = f"""
WITH RECURSIVE gated AS (
  SELECT c.*, b.price AS bprice, b.creator_id AS bcreator, b.brand_id AS bbrand,
         CASE WHEN kind = 'callback' THEN
                CASE WHEN {_signature()} <> signature THEN 'signature_mismatch' WHEN b.id IS NULL THEN 'booking_not_found' END
              WHEN b.id IS NULL THEN 'not_found' WHEN b.status <> 'accepted' THEN 'not_accepted'
              WHEN EXISTS (SELECT 1 FROM payments p WHERE p.booking_id = c.booking_id AND p.payment_status = 'completed') THEN 'already_paid'
         END AS early
  FROM cmd_payment_batch c LEFT JOIN bookings b ON b.id = c.booking_id),
open_pay AS (
  SELECT id, booking_id, razorpay_order_id AS oid, row_number() OVER (PARTITION BY booking_id ORDER BY created_at, id) AS place
  FROM payments p WHERE payment_status <> 'completed'
    AND NOT EXISTS (SELECT 1 FROM payments d WHERE d.booking_id = p.booking_id AND d.payment_status = 'completed')),
other_ids AS (SELECT booking_id, list(oid) AS oids FROM open_pay WHERE place > 1 GROUP BY booking_id),
bears AS (
  SELECT booking_id, order_id AS oid FROM gated WHERE early IS NULL AND kind = 'order'
  UNION SELECT booking_id, oid FROM open_pay),
happens AS (
  SELECT booking_id, seq, kind, order_id AS oid FROM gated WHERE early IS NULL AND kind = 'order'
  UNION ALL
  SELECT h.booking_id, g.seq, g.kind, h.oid FROM gated g JOIN bears h ON h.oid = g.order_id WHERE g.early IS NULL AND g.kind = 'callback'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY seq) AS i FROM happens),
steps AS (
  SELECT n.booking_id, 0::bigint AS i, any_value(o.oid) AS slot, CAST(NULL AS BIGINT) AS paid_at
  FROM (SELECT DISTINCT booking_id FROM numbered) n LEFT JOIN open_pay o ON o.booking_id = n.booking_id AND o.place = 1 GROUP BY n.booking_id
  UNION ALL
  SELECT s.booking_id, n.i, CASE WHEN n.kind = 'order' THEN n.oid ELSE s.slot END,
         CASE WHEN n.kind = 'callback' AND (coalesce(n.oid = s.slot, FALSE) OR coalesce(list_contains(x.oids, n.oid), FALSE)) THEN n.seq END
  FROM steps s JOIN numbered n ON n.booking_id = s.booking_id AND n.i = s.i + 1 LEFT JOIN other_ids x ON x.booking_id = s.booking_id
  WHERE s.paid_at IS NULL),
paid AS (SELECT booking_id, max(paid_at) AS paid_at FROM steps GROUP BY booking_id),
r AS (
  SELECT g.*, coalesce(early, CASE WHEN kind = 'order' AND seq > paid_at THEN 'already_paid' END) AS reason
  FROM gated g LEFT JOIN paid p ON p.booking_id = g.booking_id),
last_order AS (
  SELECT booking_id, max(seq) AS since, arg_max(order_id, seq) AS oid, any_value(bprice) AS bprice
  FROM r WHERE reason IS NULL AND kind = 'order' GROUP BY booking_id),
before AS (
  SELECT p.* REPLACE (coalesce(l.oid, p.razorpay_order_id) AS razorpay_order_id,
                      CASE WHEN l.oid IS NULL THEN p.razorpay_payment_id END AS razorpay_payment_id,
                      CASE WHEN l.oid IS NULL THEN p.payment_status ELSE 'pending' END AS payment_status), l.since
  FROM payments p LEFT JOIN open_pay o ON o.id = p.id AND o.booking_id = p.booking_id AND o.place = 1
  LEFT JOIN last_order l ON l.booking_id = o.booking_id
  UNION ALL
  SELECT {uid("'t10'", "l.booking_id")}, l.booking_id, l.oid, CAST(NULL AS VARCHAR), l.bprice, 'pending', {TS}, l.since
  FROM last_order l WHERE l.booking_id NOT IN (SELECT booking_id FROM open_pay)),
last_call AS (
  SELECT order_id, max(seq) AS seq, arg_max(payment_id, seq) AS payment_id FROM r WHERE reason IS NULL AND kind = 'callback' GROUP BY order_id),
held AS (SELECT DISTINCT booking_id, bprice FROM r WHERE reason IS NULL AND kind = 'callback')
"""
PAY_PAYMENTS = dbl(PAY + """
SELECT b.* EXCLUDE (since) REPLACE (CASE WHEN c.seq > coalesce(since, -1) THEN c.payment_id ELSE razorpay_payment_id END AS razorpay_payment_id,
                    CASE WHEN c.seq > coalesce(since, -1) THEN 'completed' ELSE payment_status END AS payment_status)
FROM before b LEFT JOIN last_call c ON c.order_id = b.razorpay_order_id""", "amount")
PAY_ESCROW = dbl(PAY + f"""
SELECT e.* REPLACE (CASE WHEN e.booking_id IN (SELECT booking_id FROM held) THEN 'held' ELSE e.status END AS status) FROM escrow_wallet e
UNION ALL
SELECT {uid("'t11'", "h.booking_id")}, h.booking_id, h.bprice, 'held', {TS} FROM held h
WHERE NOT EXISTS (SELECT 1 FROM escrow_wallet e WHERE e.booking_id = h.booking_id)""", "amount")
PAY_NOTIF = PAY + notif("t11", "r JOIN brand_profiles bp ON bp.id = r.bbrand JOIN creator_profiles cp ON cp.id = r.bcreator "
                               "WHERE r.reason IS NULL AND r.kind = 'callback'", "cp.user_id", None,
                        "'Payment received for booking #' || r.booking_id || '. Please submit your content.'", None, key="r.cmd_id")
PAY_ORDERS = PAY + """
SELECT cmd_id, booking_id, order_id, CAST(round(bprice * 100) AS BIGINT) AS amount_paise, 'INR' AS currency
FROM r WHERE reason IS NULL AND kind = 'order'"""

def details() -> str:
    """The payout details as JSON without those not given."""
    given = ", ".join(f"""CASE WHEN {c} IS NOT NULL THEN '"{c}":' || to_json({c}) END""" for c in ("upi_id", "bank_account", "ifsc_code", "account_holder"))
    return f"'{{' || concat_ws(',', {given}) || '}}'"


# ------------------------------------------------------------------ T13 + T14
# a creator's state is what counts as withdrawn, how many are pending, and the status of every withdrawal touched
WD = f"""
WITH RECURSIVE c AS (
  SELECT c.*, cp.id AS cpid, try_cast(regexp_extract(amount, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+))', 1) AS DOUBLE) AS amt
  FROM cmd_withdrawal_batch c LEFT JOIN creator_profiles cp ON cp.user_id = c.actor_user_id),
asked AS (
  SELECT *, CASE WHEN coalesce(amount, '') = '' OR amt IS NULL OR amt < 100 THEN 'min_amount'
                 WHEN coalesce(upi_id, '') = '' AND coalesce(bank_account, '') = '' THEN 'no_payout_details'
                 WHEN cpid IS NULL THEN 'no_profile' END AS early, {uid("'t13'", "CAST(cmd_id AS VARCHAR)")} AS rid
  FROM c WHERE kind = 'request'),
judged AS (
  SELECT d.cmd_id, d.seq, d.actor_user_id, d.withdrawal_id, d.status, d.note, coalesce(w.creator_id, a.cpid) AS creator,
         coalesce(w.amount, CAST(a.amt AS DECIMAL(12,2))) AS wamount, w.status AS stored,
         CASE WHEN d.status IS NULL OR d.status NOT IN ('approved', 'rejected') THEN 'invalid_status'
              WHEN w.id IS NULL AND a.rid IS NULL THEN 'not_found' END AS early
  FROM c d LEFT JOIN withdrawals w ON w.id = d.withdrawal_id
  LEFT JOIN asked a ON a.rid = d.withdrawal_id AND a.early IS NULL AND a.seq < d.seq WHERE d.kind = 'decide'),
happens AS (
  SELECT cmd_id, seq, cpid AS creator, 'request' AS kind, rid AS wid, amt, CAST(amt AS DECIMAL(12,2)) AS money, CAST(NULL AS VARCHAR) AS status,
         CAST(NULL AS VARCHAR) AS stored FROM asked WHERE early IS NULL
  UNION ALL SELECT cmd_id, seq, creator, 'decide', withdrawal_id, NULL, wamount, status, stored FROM judged WHERE early IS NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY seq) AS i FROM happens),
earned AS (SELECT creator_id, sum(amount) AS total FROM creator_earnings WHERE status = 'paid' GROUP BY creator_id),
held AS (
  SELECT creator_id, sum(CASE WHEN status IN ('pending', 'approved') THEN amount ELSE 0 END) AS total,
         count(*) FILTER (status = 'pending') AS pending FROM withdrawals GROUP BY creator_id),
begin_ AS (
  SELECT n.creator, coalesce(e.total, 0)::DECIMAL(18,2) AS earned, coalesce(h.total, 0)::DECIMAL(18,2) AS withdrawn, coalesce(h.pending, 0)::BIGINT AS pending
  FROM (SELECT DISTINCT creator FROM numbered) n LEFT JOIN earned e ON e.creator_id = n.creator LEFT JOIN held h ON h.creator_id = n.creator),
steps AS (
  SELECT creator, 0::BIGINT AS i, CAST(NULL AS BIGINT) AS cmd_id, earned, withdrawn, pending, CAST(map([], []) AS MAP(VARCHAR, VARCHAR)) AS seen,
         CAST(NULL AS VARCHAR) AS late FROM begin_
  UNION ALL
  SELECT creator, i, cmd_id, earned,
         (withdrawn + CASE WHEN late IS NOT NULL THEN 0 WHEN kind = 'request' THEN money
                           WHEN was IN ('pending', 'approved') AND status = 'rejected' THEN -money
                           WHEN was NOT IN ('pending', 'approved') AND status = 'approved' THEN money ELSE 0 END)::DECIMAL(18,2),
         pending + CASE WHEN late IS NOT NULL THEN 0 WHEN kind = 'request' THEN 1 WHEN was = 'pending' THEN -1 ELSE 0 END,
         CASE WHEN late IS NULL THEN map_concat(seen, map([wid], [coalesce(status, 'pending')])) ELSE seen END, late
  FROM (
    SELECT x.*, CASE WHEN kind = 'request' THEN
                       CASE WHEN amt > CAST(earned AS DOUBLE) - CAST(withdrawn AS DOUBLE) THEN 'insufficient_balance'
                            WHEN pending > 0 THEN 'pending_exists' END
                     WHEN was IS NULL THEN 'not_found' END AS late
    FROM (
      SELECT s.creator, n.i, n.cmd_id, s.earned, s.withdrawn, s.pending, s.seen, n.kind, n.wid, n.amt, n.money, n.status,
             coalesce(s.seen[n.wid], n.stored) AS was
      FROM steps s JOIN numbered n ON n.creator = s.creator AND n.i = s.i + 1) x) y),
lates AS (SELECT cmd_id, late FROM steps WHERE cmd_id IS NOT NULL),
req AS (SELECT a.*, coalesce(early, late) AS reason FROM asked a LEFT JOIN lates USING (cmd_id)),
dec AS (SELECT j.*, coalesce(early, late) AS reason FROM judged j LEFT JOIN lates USING (cmd_id)),
r AS (SELECT cmd_id, reason FROM req UNION ALL SELECT cmd_id, reason FROM dec),
last AS (SELECT withdrawal_id, arg_max(status, seq) AS status FROM dec WHERE reason IS NULL GROUP BY withdrawal_id),
dec_who AS (SELECT d.*, u.id AS uid FROM dec d JOIN creator_profiles cp ON cp.id = d.creator JOIN users u ON u.id = cp.user_id WHERE d.reason IS NULL)
"""
WD_ROWS = dbl(WD + f"""
SELECT q.* REPLACE (coalesce(l.status, q.status) AS status) FROM (
  SELECT * FROM withdrawals UNION ALL
  SELECT rid, cpid, CAST(amt AS DECIMAL(12,2)), 'pending', {details()}, {TS} FROM req r WHERE reason IS NULL) q
LEFT JOIN last l ON l.withdrawal_id = q.id""", "amount")
WD_NOTIF = WD + "SELECT * FROM (" + notif(
    "t13", "req WHERE reason IS NULL", "actor_user_id", None,
    f"'Withdrawal request of ₹' || {locale('amt')} || ' submitted. We''ll process it within 2-3 business days.'", None) + " UNION ALL " + notif(
    "t14", "dec_who", "uid", None,
    f"CASE WHEN status = 'approved' THEN '✅ Your withdrawal of ₹' || {locale('CAST(wamount AS DOUBLE)')} || "
    "' has been approved! Funds will be transferred within 1-2 business days.' "
    f"ELSE '❌ Your withdrawal request of ₹' || {locale('CAST(wamount AS DOUBLE)')} || ' was rejected. ' || "
    "CASE WHEN coalesce(note, '') <> '' THEN note ELSE 'Please contact support.' END END", None) + ") n"
WD_AUDIT = WD + f"""
SELECT {uid("'t14'", "'a'", "CAST(cmd_id AS VARCHAR)")} AS id,
       'Approved withdrawal #' || withdrawal_id || ' of ₹' || CAST(wamount AS VARCHAR) || ' for creator #' || creator AS action,
       actor_user_id AS admin_id, {TS} AS created_at FROM dec WHERE reason IS NULL AND status = 'approved'"""

# ------------------------------------------------------------------ T2
# the state is one map: who holds a provider id (google_id:x), what a user holds (google_id@u), whose an email is (e:x)
T02 = f"""
WITH RECURSIVE known AS (
  SELECT l.*, CASE provider WHEN 'google' THEN 'google_id' WHEN 'facebook' THEN 'facebook_id' END AS col,
         CASE WHEN coalesce(email, '') <> '' THEN lower(email) END AS em
  FROM cmd_t02 l),
mails AS (SELECT lower(email) AS em, min(id) AS id FROM users GROUP BY 1),
numbered AS (
  SELECT k.*, u.id AS stored, row_number() OVER (ORDER BY seq) AS i, {uid("'t02'", "CAST(cmd_id AS VARCHAR)")} AS made
  FROM known k LEFT JOIN mails u ON u.em = k.em WHERE k.col IS NOT NULL),
steps AS (
  SELECT 0::BIGINT AS i, CAST(NULL AS BIGINT) AS cmd_id, CAST(NULL AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS method,
         (SELECT CAST(map(list(k), list(v)) AS MAP(VARCHAR, VARCHAR)) FROM (
            SELECT unnest(['google_id:' || google_id, 'google_id@' || id, 'facebook_id:' || facebook_id, 'facebook_id@' || id,
                           'social_provider@' || id]) AS k,
                   unnest([id, google_id, id, facebook_id, social_provider]) AS v FROM users) WHERE k IS NOT NULL AND v IS NOT NULL) AS m
  UNION ALL
  SELECT i, cmd_id, user_id, method,
         CASE WHEN method = 'provider' THEN m
              WHEN method = 'email' THEN map_concat(m, map([col || ':' || provider_id, col || '@' || user_id, 'social_provider@' || user_id],
                                                           [user_id, provider_id, provider]))
              ELSE map_concat(m, map([col || ':' || provider_id, col || '@' || user_id, 'social_provider@' || user_id,
                                      'e:' || coalesce(em, lower(provider || '_' || provider_id || '@noemail.local'))],
                                     [user_id, provider_id, provider, user_id])) END
  FROM (
    SELECT x.*, CASE WHEN m[col || '@' || holder] = provider_id THEN holder ELSE coalesce(mailer, made) END AS user_id,
           CASE WHEN m[col || '@' || holder] = provider_id THEN 'provider' WHEN mailer IS NOT NULL THEN 'email' ELSE 'created' END AS method
    FROM (
      SELECT n.*, coalesce(s.m, CAST(map([], []) AS MAP(VARCHAR, VARCHAR))) AS m, s.m[n.col || ':' || n.provider_id] AS holder,
             coalesce(n.stored, s.m['e:' || n.em]) AS mailer
      FROM steps s JOIN numbered n ON n.i = s.i + 1) x) y),
done AS (SELECT cmd_id, user_id, method FROM steps WHERE cmd_id IS NOT NULL),
final AS (SELECT arg_max(m, i) AS m FROM steps),
made AS (SELECT k.*, d.user_id FROM known k JOIN done d USING (cmd_id) WHERE d.method = 'created')
"""
T02_USERS = T02 + f"""
SELECT * EXCLUDE (m) REPLACE (m['google_id@' || id] AS google_id, m['facebook_id@' || id] AS facebook_id, m['social_provider@' || id] AS social_provider)
FROM (SELECT * FROM users UNION ALL BY NAME
      SELECT user_id AS id, name, CASE WHEN coalesce(email, '') <> '' THEN email ELSE provider || '_' || provider_id || '@noemail.local' END AS email,
             'creator' AS role, avatar_url, {TS} AS created_at FROM made) q, final"""
T02_PROFILES = dbl(T02 + f"""
SELECT * FROM creator_profiles UNION ALL BY NAME
SELECT {uid("'t02c'", "CAST(cmd_id AS VARCHAR)")} AS id, user_id,
       regexp_replace(lower(CASE WHEN coalesce(name, '') <> '' THEN name ELSE 'user' END), '\\s+', '_', 'g') || '_' || substr(user_id, 1, 8) AS username,
       0 AS verified, 0.0::DECIMAL(3,2) AS rating, 0.0::DECIMAL(3,2) AS collaboration_rating, {TS} AS created_at FROM made""",
                   "rating", "collaboration_rating")

SQL: dict[str, str] = {
    "t10_t11_payments__payments": PAY_PAYMENTS,
    "t10_t11_payments__escrow_wallet": PAY_ESCROW,
    "t10_t11_payments__rejects": PAY + rejects(),
    "t10_t11_payments__notifications": PAY_NOTIF,
    "t10_t11_payments__orders": PAY_ORDERS,
    "t13_t14_withdrawals__withdrawals": WD_ROWS,
    "t13_t14_withdrawals__rejects": WD + rejects(),
    "t13_t14_withdrawals__notifications": WD_NOTIF,
    "t13_t14_withdrawals__audit": WD_AUDIT,
    "t02_resolve_identities__resolved": T02 + "SELECT * FROM done",
    "t02_resolve_identities__users": T02_USERS,
    "t02_resolve_identities__creator_profiles": T02_PROFILES,
    "t02_resolve_identities__rejects": T02 + "SELECT cmd_id, 'unknown_provider' AS reason FROM known WHERE col IS NULL",
}
