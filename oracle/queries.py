"""DuckDB oracle bodies for the read queries, written from what each query

Cards (a profile with its user) and per-key figures are common tables; each
filter of a search is a set of ids and the search is their intersection; pages
are cut by position.  LIKE under a case- and accent-insensitive collation is
written as ``strip_accents(lower(col)) LIKE strip_accents(lower('%x%'))``.
Decimal outputs are cast to DOUBLE, as the Spark side does.
"""

from __future__ import annotations

from souk.catalog import (COLLAB_FILTERED, COLLAB_WILDCARD, SEARCH_FILTERED, SEARCH_PLATFORM, SEARCH_TEXT,
                          SEARCH_WILDCARD)


def dbl(body: str, *cols: str) -> str:
    rep = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({body}) _q"


def like(col: str, text: str) -> str:
    t = text.replace("'", "''")
    return f"strip_accents(lower({col})) LIKE '%' || strip_accents(lower('{t}')) || '%'"


#: Common tables: whose a profile is, and what hangs on a key.
CARDS: dict[str, str] = {
    "creator_card": """SELECT p.id AS creator_id, p.user_id AS creator_user_id, p.username, p.verified, p.rating, p.collaboration_rating,
           person.name, person.email, person.avatar_url
    FROM creator_profiles p, users person WHERE person.id = p.user_id""",
    "brand_card": """SELECT p.id AS brand_id, p.user_id AS brand_user_id, p.company_name, person.name, person.avatar_url
    FROM brand_profiles p, users person WHERE person.id = p.user_id""",
    "firms": "SELECT id AS brand_id, user_id AS brand_user_id, company_name FROM brand_profiles",
    "handles": "SELECT id AS creator_id, user_id AS creator_user_id, username FROM creator_profiles",
    "packs": "SELECT id AS package_id, package_name, description AS package_desc, delivery_days FROM promotion_packages",
    "paid": """SELECT booking_id, payment_status, razorpay_order_id, razorpay_payment_id, amount AS paid_amount FROM payments""",
    "locked": "SELECT booking_id, status AS escrow_status FROM escrow_wallet",
    "reach": "SELECT creator_id, max(followers) AS max_followers FROM creator_platforms GROUP BY creator_id",
    "cheapest": "SELECT creator_id, min(price) AS min_price FROM promotion_packages GROUP BY creator_id",
}


def using(cards: str, body: str) -> str:
    """The body with the named common tables before it."""
    return "WITH " + ", ".join(f"{c} AS ({CARDS[c]})" for c in cards.split()) + "\n" + body.strip()


def page_of(body: str, order: str, page, limit) -> str:
    """The rows of a page, by their position in the order."""
    last = int(page) * int(limit)
    return f"SELECT * FROM ({body}) whole QUALIFY row_number() OVER (ORDER BY {order}) BETWEEN {last - int(limit) + 1} AND {last}"


def pages_of(ids: str, page, limit) -> str:
    return (f"SELECT count(*) AS total, CAST({int(page)} AS INTEGER) AS page, "
            f"CAST((count(*) + {int(limit)} - 1) // {int(limit)} AS BIGINT) AS pages FROM ({ids}) found")


def wanted_creators(category=None, platform=None, location=None, search=None) -> str:
    """Ids of the creators (with a user) that every given filter finds."""
    sets = ["SELECT creator_id FROM creator_card"]
    if category:
        sets.append(f"SELECT id FROM creator_profiles WHERE {like('category', category)}")
    if location:
        sets.append(f"SELECT id FROM (SELECT id, unnest([city, country]) AS place FROM creator_profiles) WHERE {like('place', location)}")
    if search:
        sets.append(f"SELECT id FROM (SELECT p.id, unnest([k.name, p.username, p.bio]) AS told FROM creator_profiles p "
                    f"JOIN creator_card k ON k.creator_id = p.id) WHERE {like('told', search)}")
    if platform:
        sets.append(f"SELECT creator_id FROM creator_platforms WHERE {like('platform_name', platform)}")
    return " INTERSECT ".join(sets)


def search_sql(min_followers=None, max_price=None, page="1", limit="12", **flt) -> str:
    keep = [f"creator_id IN ({wanted_creators(**flt)})"]
    if min_followers:
        keep.append(f"max_followers >= {int(min_followers)}")
    if max_price:
        keep.append(f"min_price <= {float(max_price)}")
    found = f"""SELECT creator_id AS id, k.username, p.bio, p.category, p.city, p.country, k.verified, k.rating, p.created_at, k.name, k.avatar_url,
         min_price, max_followers
  FROM creator_card k JOIN (SELECT id AS creator_id, bio, category, city, country, created_at FROM creator_profiles) p USING (creator_id)
  LEFT JOIN cheapest USING (creator_id) LEFT JOIN reach USING (creator_id) WHERE {' AND '.join(keep)}"""
    return dbl(using("creator_card cheapest reach", page_of(found, "rating DESC, verified DESC, id", page, limit)),
               "rating", "min_price", "max_followers")


def search_total_sql(page="1", limit="12", min_followers=None, max_price=None, **flt) -> str:
    return using("creator_card", pages_of(wanted_creators(**flt), page, limit))


def campaigns_sql(status=None, category=None, page=1, limit=10) -> str:
    sets = ["SELECT id FROM campaigns"]
    if status:
        sets.append(f"SELECT id FROM campaigns WHERE status = '{status}'")
    if category:
        sets.append(f"SELECT id FROM campaigns WHERE {like('category', category)}")
    rows = f"""SELECT c.*, k.company_name, k.avatar_url AS brand_avatar FROM campaigns c JOIN brand_card k USING (brand_id)
  WHERE c.id IN ({' INTERSECT '.join(sets)})"""
    return dbl(using("brand_card", page_of(rows, "created_at DESC, id", page, limit)), "budget")


def wanted_collabs(platform=None, category=None, location=None, followers_required=None) -> str:
    sets = ["SELECT id FROM collaborations WHERE status = 'open' OR status = 'in_progress'"]
    sets += [f"SELECT id FROM collaborations WHERE {like(col, text)}"
             for col, text in (("platform", platform), ("category", category), ("location", location)) if text]
    if followers_required:
        sets.append(f"SELECT id FROM collaborations WHERE followers_required <= {int(followers_required)}")
    return " INTERSECT ".join(f"({x})" for x in sets)


OWNED = """SELECT c.*, k.name AS creator_name, k.avatar_url AS creator_avatar, k.username AS creator_username,
         k.rating AS creator_rating, k.collaboration_rating, k.verified
  FROM collaborations c JOIN creator_card k USING (creator_id)"""


def tally(table: str, key: str, name: str, among: str = "TRUE") -> str:
    """(key, number of rows) of a table."""
    return f"SELECT {key}, count(*) AS {name} FROM {table} WHERE {among} GROUP BY {key}"


def collabs_sql(page=1, limit=12, **flt) -> str:
    rows = f"""SELECT o.*, coalesce(n.request_count, 0) AS request_count FROM ({OWNED}) o
  LEFT JOIN ({tally("collaboration_requests", "collaboration_id", "request_count")}) n ON n.collaboration_id = o.id
  WHERE o.id IN ({wanted_collabs(**flt)})"""
    return dbl(using("creator_card", page_of(rows, "created_at DESC, id", page, limit)), "creator_rating", "collaboration_rating")


def collabs_total_sql(page=1, limit=12, **flt) -> str:
    return pages_of(wanted_collabs(**flt), page, limit)


#: Payments whose booking, brand and creator are there.
SETTLED = """SELECT p.*, b.price AS booking_price, b.status AS booking_status, firms.company_name, handles.username AS creator_username
  FROM payments p JOIN (SELECT id AS booking_id, price, status, brand_id, creator_id FROM bookings) b USING (booking_id)
  JOIN firms USING (brand_id) JOIN handles USING (creator_id)"""

PROFIT_ROWS = f"""SELECT id, booking_id, amount, payment_status, created_at, company_name AS brand_name, creator_username,
       ROUND(amount * 0.10, 2) AS platform_fee, ROUND(amount * 0.90, 2) AS creator_payout, escrow_status
FROM ({SETTLED}) s LEFT JOIN locked USING (booking_id) WHERE payment_status = 'completed'"""

#: A booking with the package and the payments that may be missing.
BOOKED = "FROM bookings b LEFT JOIN packs USING (package_id) LEFT JOIN paid ON paid.booking_id = b.id"


def per_creator(table: str, statuses: str) -> str:
    return f"SELECT creator_id, sum(amount) AS total FROM {table} WHERE status IN ({statuses}) GROUP BY creator_id"


def doc_children(table: str, name: str) -> str:
    return f"(SELECT count(*) FROM {table} x WHERE x.creator_id = d.id) AS {name}"


def listed(table: str, text: str, key: str, order: str, name: str) -> str:
    """The rows of one key as one text, in order."""
    return f"coalesce((SELECT string_agg({text}, ';' ORDER BY {order}) FROM {table} x WHERE x.{key} = d.id), '') AS {name}"


CREATOR_DOC = "SELECT p.*, k.name, k.email, k.avatar_url FROM creator_profiles p JOIN creator_card k ON k.creator_id = p.id"
TOP_REVIEWS = """top_reviews AS (
  SELECT r.creator_id, r.id, k.name AS brand_name, r.created_at FROM reviews r JOIN brand_card k USING (brand_id)
  QUALIFY row_number() OVER (PARTITION BY r.creator_id ORDER BY r.created_at DESC, r.id) <= 10)"""
#: Children of a collaboration whose creator has a user.
TEAM = "SELECT j.collaboration_id, creator_id AS id, k.username, k.rating, k.collaboration_rating, k.name, k.avatar_url, j.role, j.joined_at " \
       "FROM collaboration_participants j JOIN creator_card k USING (creator_id)"
ASKED = "SELECT q.*, k.username AS applicant_username, k.name AS applicant_name, k.avatar_url AS applicant_avatar, " \
        "k.rating AS applicant_rating FROM collaboration_requests q JOIN creator_card k USING (creator_id)"
JUDGED = "SELECT v.*, k.name AS reviewer_name, k.avatar_url AS reviewer_avatar FROM collaboration_reviews v " \
         "JOIN creator_card k ON k.creator_id = v.reviewer_id"

SQL: dict[str, str] = {
    "q01_creator_categories": """
SELECT min(category) AS category FROM creator_profiles
WHERE coalesce(category, '') <> '' GROUP BY strip_accents(lower(category))""",
    "q02_search_creators": search_sql(),
    "q02_search_creators_filtered": search_sql(**SEARCH_FILTERED),
    "q02_search_creators_text": search_sql(**SEARCH_TEXT),
    "q02_search_creators_wildcard": search_sql(**SEARCH_WILDCARD),
    "q02_search_creators_platform_page2": search_sql(**SEARCH_PLATFORM),
    "q03_attach_platforms": """
SELECT id, username, f.platform_name AS platform, CAST(f.followers AS DOUBLE) AS followers, CAST(f.engagement_rate AS DOUBLE) AS engagement_rate
FROM (SELECT id, username FROM creator_profiles)
LEFT JOIN (SELECT creator_id AS id, platform_name, followers, engagement_rate FROM creator_platforms) f USING (id)""",
    "q04_search_creators_total": search_total_sql(),
    "q04_search_creators_total_filtered": search_total_sql(**SEARCH_FILTERED),
    "q05_creator_profile_doc": dbl(using("creator_card brand_card", f""", {TOP_REVIEWS}
SELECT d.*, {doc_children("creator_platforms", "n_platforms")}, {doc_children("promotion_packages", "n_packages")},
       coalesce((SELECT string_agg(id, ',' ORDER BY created_at DESC, id) FROM top_reviews t WHERE t.creator_id = d.id), '') AS review_ids,
       coalesce((SELECT string_agg(brand_name, ',' ORDER BY created_at DESC, id) FROM top_reviews t WHERE t.creator_id = d.id), '') AS review_brands
FROM ({CREATOR_DOC}) d"""), "rating", "collaboration_rating"),
    "q05_creator_profile_doc__keyed": dbl(using("creator_card brand_card", f""", {TOP_REVIEWS}
SELECT d.*, {listed("creator_platforms", "id || ':' || platform_name || ':' || followers", "creator_id", "id", "platforms")},
       {listed("promotion_packages", "id || ':' || package_name", "creator_id", "id", "packages")},
       {listed("top_reviews", "id || ':' || brand_name", "creator_id", "created_at DESC, id", "reviews")}
FROM ({CREATOR_DOC}) d WHERE strip_accents(lower(username)) = 'creator_1'"""), "rating", "collaboration_rating"),
    "q06_own_profile_doc__keyed": dbl(using("creator_card", f"""
SELECT d.* EXCLUDE (email), {listed("creator_platforms", "id || ':' || platform_name || ':' || followers", "creator_id", "id", "platforms")},
       {listed("promotion_packages", "id || ':' || package_name", "creator_id", "id", "packages")}
FROM ({CREATOR_DOC}) d WHERE user_id = 'u-c-1'"""), "rating", "collaboration_rating"),
    "q05_profile_children": """
SELECT creator_id, 'platform' AS kind, id AS item_id, platform_name AS name, CAST(followers AS DOUBLE) AS amount
FROM creator_platforms
UNION ALL
SELECT creator_id, 'package', id, package_name, CAST(price AS DOUBLE) FROM promotion_packages""",
    "q06_own_profile_doc": dbl(using("creator_card", f"""
SELECT d.* EXCLUDE (email), {doc_children("creator_platforms", "n_platforms")}, {doc_children("promotion_packages", "n_packages")}
FROM ({CREATOR_DOC}) d"""), "rating", "collaboration_rating"),
    "q07_earnings_statement": dbl(using("brand_card packs", """
SELECT e.*, b.booking_date, k.name AS brand_name, packs.package_name
FROM creator_earnings e JOIN (SELECT id AS booking_id, created_at AS booking_date, brand_id, package_id FROM bookings) b USING (booking_id)
JOIN brand_card k USING (brand_id) LEFT JOIN packs USING (package_id)"""), "amount"),
    "q07_earnings_total": """
SELECT creator_id, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n_earnings FROM creator_earnings
WHERE booking_id IN (SELECT id FROM bookings WHERE brand_id IN (SELECT id FROM brand_profiles WHERE user_id IN (SELECT id FROM users)))
GROUP BY creator_id""",
    "q08_list_campaigns": campaigns_sql(),
    "q08_list_campaigns_filtered": campaigns_sql(status="active", category="tech", page=2),
    "q09_brand_campaigns": dbl("SELECT * FROM campaigns", "budget"),
    "q10_bookings_for_brand": dbl(using("creator_card packs paid", f"""
SELECT b.*, k.username AS creator_username, k.name AS creator_name, k.avatar_url AS creator_avatar, k.creator_user_id,
       packs.package_name, paid.payment_status {BOOKED} JOIN creator_card k ON k.creator_id = b.creator_id"""), "price"),
    "q11_bookings_for_creator": dbl(using("brand_card packs paid", f"""
SELECT b.*, k.company_name AS brand_name, k.avatar_url AS brand_avatar, packs.package_name, paid.payment_status
{BOOKED} JOIN brand_card k ON k.brand_id = b.brand_id"""), "price"),
    "q12_bookings_recent": dbl(using("firms handles", page_of("""
SELECT b.*, firms.company_name AS brand_name, handles.username AS creator_username
FROM bookings b JOIN firms USING (brand_id) JOIN handles USING (creator_id)""", "created_at DESC, id", 1, 100)), "price"),
    "q13_booking_detail": dbl(using("creator_card brand_card packs paid locked", f"""
SELECT b.*, c.username AS creator_username, c.name AS creator_name, c.avatar_url AS creator_avatar, k.company_name AS brand_name,
       k.avatar_url AS brand_avatar, packs.package_name, packs.package_desc, packs.delivery_days, paid.payment_status,
       paid.razorpay_order_id, paid.razorpay_payment_id, paid.paid_amount, locked.escrow_status
{BOOKED} LEFT JOIN locked ON locked.booking_id = b.id
JOIN brand_card k ON k.brand_id = b.brand_id JOIN creator_card c ON c.creator_id = b.creator_id"""), "price", "paid_amount", "delivery_days"),
    "q14_payment_and_escrow": dbl("""
WITH first_payment AS (
  SELECT booking_id, id AS payment_id, razorpay_order_id, razorpay_payment_id, amount AS payment_amount, payment_status,
         created_at AS payment_created_at
  FROM payments QUALIFY row_number() OVER (PARTITION BY booking_id ORDER BY created_at, id) = 1),
escrow AS (SELECT booking_id, id AS escrow_id, amount AS escrow_amount, status AS escrow_status, created_at AS escrow_created_at FROM escrow_wallet)
SELECT * FROM (SELECT id AS booking_id FROM bookings) LEFT JOIN first_payment USING (booking_id) LEFT JOIN escrow USING (booking_id)""",
                                  "payment_amount", "escrow_amount"),
    "q15_payments_recent": dbl(using("firms handles", page_of(f"SELECT * EXCLUDE (booking_status) FROM ({SETTLED})", "created_at DESC, id", 1, 100)),
                               "amount", "booking_price"),
    "q16_list_users": "SELECT id, name, email, role, avatar_url, created_at FROM users",
    "q17_pending_creators": dbl(using("creator_card", f"SELECT * FROM ({CREATOR_DOC}) d WHERE verified = 0"), "rating", "collaboration_rating"),
    "q18_transactions": dbl(using("firms handles locked", f"SELECT s.*, locked.escrow_status FROM ({SETTLED}) s LEFT JOIN locked USING (booking_id)"),
                            "amount", "booking_price"),
    "q19_platform_stats": """
SELECT u.n AS total_users, c.n AS total_creators, b.n AS total_brands, k.n AS total_bookings, CAST(coalesce(p.s, 0) AS DOUBLE) AS total_revenue
FROM (SELECT count(*) AS n FROM users) u, (SELECT count(*) AS n FROM creator_profiles) c, (SELECT count(*) AS n FROM brand_profiles) b,
     (SELECT count(*) AS n FROM bookings) k, (SELECT sum(amount) FILTER (payment_status = 'completed') AS s FROM payments) p""",
    "q20_brand_booking_history": dbl(using("firms handles packs paid", f"""
SELECT firms.brand_user_id AS history_user_id, b.*, packs.package_name, handles.username AS creator_username, paid.payment_status, paid.paid_amount
{BOOKED} LEFT JOIN handles ON handles.creator_id = b.creator_id JOIN firms ON firms.brand_id = b.brand_id
WHERE firms.brand_user_id IN (SELECT id FROM users WHERE role = 'brand')"""), "price", "paid_amount"),
    "q21_brand_campaign_history": dbl(using("firms", f"""
SELECT firms.brand_user_id AS history_user_id, c.*, coalesce(n.invite_count, 0) AS invite_count
FROM campaigns c JOIN firms USING (brand_id)
LEFT JOIN ({tally("campaign_invites", "campaign_id", "invite_count", "id IS NOT NULL")}) n ON n.campaign_id = c.id
WHERE firms.brand_user_id IN (SELECT id FROM users WHERE role = 'brand')"""), "budget"),
    "q22_creator_booking_history": dbl(using("firms handles packs paid", f"""
SELECT handles.creator_user_id AS history_user_id, b.*, packs.package_name, firms.company_name AS brand_name, paid.payment_status, paid.paid_amount
{BOOKED} LEFT JOIN firms ON firms.brand_id = b.brand_id JOIN handles ON handles.creator_id = b.creator_id
WHERE handles.creator_user_id IN (SELECT id FROM users WHERE role = 'creator')"""), "price", "paid_amount"),
    "q23_creator_collab_history": using("creator_card handles", """, ties AS (
  SELECT id AS collaboration_id, creator_id FROM collaborations
  UNION SELECT collaboration_id, creator_id FROM collaboration_participants)
SELECT h.creator_user_id AS history_user_id, c.id, c.title, c.platform, c.category, c.status, c.collaboration_type, c.created_at,
       k.name AS owner_name, CASE c.creator_id WHEN h.creator_id THEN 'owner' ELSE 'participant' END AS role_in_collab
FROM ties JOIN handles h USING (creator_id) JOIN collaborations c ON c.id = ties.collaboration_id
JOIN creator_card k ON k.creator_id = c.creator_id
WHERE h.creator_user_id IN (SELECT id FROM users WHERE role = 'creator')"""),
    "q24_platform_profit": dbl(using("firms handles locked", PROFIT_ROWS), "amount", "platform_fee", "creator_payout"),
    "q25_platform_profit_totals": using("firms handles locked", f"""
SELECT 10 AS platform_fee_percent, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_revenue,
       CAST(coalesce(sum(platform_fee), 0) AS DOUBLE) AS total_platform_profit,
       CAST(coalesce(sum(creator_payout), 0) AS DOUBLE) AS total_creator_payout, count(*) AS n_transactions
FROM ({PROFIT_ROWS}) rows_"""),
    "q26_withdrawal_history": dbl("SELECT * FROM withdrawals", "amount"),
    "q27_available_balance": dbl(f"""
SELECT creator_id, coalesce(e.total, 0) AS earned, coalesce(w.total, 0) AS withdrawn,
       greatest(0, coalesce(e.total, 0) - coalesce(w.total, 0)) AS available
FROM (SELECT id AS creator_id FROM creator_profiles)
LEFT JOIN ({per_creator("creator_earnings", "'paid'")}) e USING (creator_id)
LEFT JOIN ({per_creator("withdrawals", "'pending', 'approved'")}) w USING (creator_id)""", "earned", "withdrawn", "available"),
    "q28_withdrawal_queue": dbl(using("creator_card", """
SELECT w.*, k.username AS creator_username, k.name AS creator_name, k.email AS creator_email, k.avatar_url AS creator_avatar
FROM withdrawals w JOIN creator_card k USING (creator_id)"""), "amount"),
    "q29_withdrawal_totals": """
WITH flows AS (
  SELECT CASE WHEN status = 'paid' THEN amount ELSE 0 END AS came, 0 AS went FROM creator_earnings
  UNION ALL SELECT 0, CASE WHEN status IN ('pending', 'approved', 'paid') THEN amount ELSE 0 END FROM withdrawals)
SELECT CAST(greatest(0, coalesce(sum(came), 0) - coalesce(sum(went), 0)) AS DOUBLE) AS available_balance,
       CAST(coalesce(sum(went), 0) AS DOUBLE) AS total_withdrawn FROM flows""",
    "q30_booking_thread": """
SELECT m.*, person.name AS sender_name, person.avatar_url AS sender_avatar
FROM messages m, users person WHERE person.id = m.sender_id AND m.booking_id IS NOT NULL""",
    "q31_inbox": """
WITH cards AS (SELECT id AS uid, name, avatar_url FROM users),
full_rows AS (
  SELECT m.*, s.name AS sender_name, s.avatar_url AS sender_avatar, r.name AS receiver_name, r.avatar_url AS receiver_avatar
  FROM messages m JOIN cards s ON s.uid = m.sender_id JOIN cards r ON r.uid = m.receiver_id),
parties AS (SELECT sender_id AS inbox_user_id, * FROM full_rows
            UNION ALL SELECT receiver_id, * FROM full_rows WHERE receiver_id <> sender_id)
SELECT id, sender_id, receiver_id, booking_id, message, created_at, inbox_user_id, sender_name, sender_avatar,
       receiver_name, receiver_avatar
FROM parties QUALIFY row_number() OVER (PARTITION BY inbox_user_id ORDER BY created_at DESC, id) <= 100""",
    "q32_notification_feed": """
SELECT id, user_id, title, message, link, is_read, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rn FROM notifications) x
WHERE rn <= 50""",
    "q33_creator_reviews": using("brand_card", """
SELECT r.*, k.name AS brand_name, k.avatar_url AS brand_avatar FROM reviews r JOIN brand_card k USING (brand_id)"""),
    "q34_brand_reviews": using("creator_card", """
SELECT r.*, k.name AS creator_name, k.avatar_url AS creator_avatar, k.username AS creator_username, r.booking_id AS booking_id_ref
FROM reviews r JOIN creator_card k USING (creator_id) WHERE r.booking_id IN (SELECT id FROM bookings)"""),
    "q35_list_collaborations": collabs_sql(),
    "q35_list_collaborations_filtered": collabs_sql(**COLLAB_FILTERED),
    "q35_list_collaborations_wildcard": collabs_sql(**COLLAB_WILDCARD),
    "q36_list_collaborations_total": collabs_total_sql(),
    "q36_list_collaborations_total_filtered": collabs_total_sql(**COLLAB_FILTERED),
    "q37_collaboration_doc": dbl(using("creator_card", f"""
SELECT d.*, coalesce(p.n_participants, 0) AS n_participants, coalesce(q.n_requests, 0) AS n_requests, coalesce(v.n_reviews, 0) AS n_reviews
FROM ({OWNED}) d
LEFT JOIN ({tally(f"({TEAM})", "collaboration_id", "n_participants")}) p ON p.collaboration_id = d.id
LEFT JOIN ({tally(f"({ASKED})", "collaboration_id", "n_requests")}) q ON q.collaboration_id = d.id
LEFT JOIN ({tally(f"({JUDGED})", "collaboration_id", "n_reviews")}) v ON v.collaboration_id = d.id"""), "creator_rating", "collaboration_rating"),
    "q37_collaboration_doc__keyed": dbl(using("creator_card", f"""
SELECT d.*, {listed(f"({TEAM})", "id || ':' || role || ':' || name", "collaboration_id", "id", "participants")},
       {listed(f"({ASKED})", "id || ':' || status || ':' || applicant_name", "collaboration_id", "created_at DESC, id", "requests")},
       {listed(f"({JUDGED})", "id || ':' || rating || ':' || reviewer_name", "collaboration_id", "created_at DESC, id", "reviews")}
FROM ({OWNED}) d WHERE d.id = 'cl-2'"""), "creator_rating", "collaboration_rating"),
    "q37_collaboration_parts__participants": dbl(using("creator_card", TEAM), "rating", "collaboration_rating"),
    "q37_collaboration_parts__requests": dbl(using("creator_card", ASKED), "applicant_rating"),
    "q37_collaboration_parts__reviews": using("creator_card", JUDGED),
    "q38_my_collaborations": """
WITH mine AS (
  SELECT creator_id AS self_id, id, 'owner' AS my_role, 'owned' AS list FROM collaborations
  UNION ALL SELECT j.creator_id, j.collaboration_id, j.role, 'participating' FROM collaboration_participants j
  WHERE (j.creator_id, j.collaboration_id) NOT IN (SELECT (creator_id, id) FROM collaborations))
SELECT self_id, c.*, my_role, list FROM mine JOIN collaborations c USING (id)""",
    "q39_collaboration_thread": using("creator_card", """
SELECT m.*, k.name AS sender_name, k.avatar_url AS sender_avatar, k.username AS sender_username
FROM collaboration_messages m JOIN creator_card k ON k.creator_user_id = m.sender_id"""),
    "q40_collaboration_reviews_for": using("creator_card", f"""
SELECT v.*, c.title AS collaboration_title FROM ({JUDGED}) v JOIN (SELECT id AS collaboration_id, title FROM collaborations) c USING (collaboration_id)"""),
    "q41_resolve_profile": """
SELECT actor_user_id, role, max(c) AS creator_profile_id, max(b) AS brand_profile_id FROM (
  SELECT u.id AS actor_user_id, u.role, p.id AS c, NULL AS b FROM users u LEFT JOIN creator_profiles p ON p.user_id = u.id
  UNION ALL SELECT u.id, u.role, NULL, p.id FROM users u JOIN brand_profiles p ON p.user_id = u.id)
GROUP BY actor_user_id, role""",
    "s4_withdrawal_details": """
SELECT id, creator_id, d->>'upi_id' AS upi_id, d->>'bank_account' AS bank_account, d->>'ifsc_code' AS ifsc_code,
       d->>'account_holder' AS account_holder
FROM (SELECT id, creator_id, CAST(details AS JSON) AS d FROM withdrawals)""",
}
