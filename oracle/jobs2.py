"""DuckDB oracles for T1, T3-T5, T15-T26."""

from __future__ import annotations

from oracle.jobs import TS, locale, notif, rejects, uid  # noqa: F401
from oracle.queries import dbl
from souk.sources.schema import FOREIGN_KEYS, delete_order

ENC = ("replace(replace(replace(replace(replace(replace(url_encode(name), '+', '%20'), '%21', '!'), '%27', ''''), "
       "'%28', '('), '%29', ')'), '%7E', '~')")

# ------------------------------------------------------------------ T1
T01 = r"""
WITH RECURSIVE c AS (
  SELECT c.*, lower(email) AS ek,
         CASE WHEN coalesce(username, '') <> '' THEN username ELSE split_part(email, '@', 1) END AS uname,
         CASE WHEN role = 'creator' THEN lower(CASE WHEN coalesce(username, '') <> '' THEN username
                                                    ELSE split_part(email, '@', 1) END) END AS uk,
         EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = lower(c.email)) AS e_used,
         EXISTS (SELECT 1 FROM creator_profiles p WHERE lower(p.username) =
                 lower(CASE WHEN coalesce(c.username, '') <> '' THEN c.username ELSE split_part(c.email, '@', 1) END)
                 AND c.role = 'creator') AS u_used,
         CASE WHEN coalesce(name, '') = '' OR coalesce(email, '') = '' OR NOT coalesce(password_given, FALSE)
                   OR coalesce(role, '') = '' THEN 'missing_fields'
              WHEN role NOT IN ('creator', 'brand', 'admin') THEN 'invalid_role' END AS static
  FROM cmd_t01 c),
cand AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM c WHERE static IS NULL AND NOT e_used AND NOT u_used),
walk(rn, emails, unames, acc) AS (
  SELECT 0, []::VARCHAR[], []::VARCHAR[], []::BIGINT[]
  UNION ALL
  SELECT x.rn,
         CASE WHEN NOT list_contains(w.emails, x.ek) AND (x.uk IS NULL OR NOT list_contains(w.unames, x.uk))
              THEN list_append(w.emails, x.ek) ELSE w.emails END,
         CASE WHEN NOT list_contains(w.emails, x.ek) AND (x.uk IS NULL OR NOT list_contains(w.unames, x.uk))
                   AND x.uk IS NOT NULL THEN list_append(w.unames, x.uk) ELSE w.unames END,
         CASE WHEN NOT list_contains(w.emails, x.ek) AND (x.uk IS NULL OR NOT list_contains(w.unames, x.uk))
              THEN list_append(w.acc, x.cmd_id) ELSE w.acc END
  FROM walk w JOIN cand x ON x.rn = w.rn + 1),
accepted AS (SELECT unnest(acc) AS cmd_id FROM walk WHERE rn = (SELECT max(rn) FROM walk)),
acc AS (SELECT c.* FROM c WHERE cmd_id IN (SELECT cmd_id FROM accepted)),
r AS (SELECT c.*, coalesce(static,
        CASE WHEN e_used OR EXISTS (SELECT 1 FROM acc a WHERE a.ek = c.ek AND a.seq < c.seq) THEN 'email_taken' END,
        CASE WHEN u_used OR EXISTS (SELECT 1 FROM acc a WHERE a.uk = c.uk AND a.seq < c.seq) THEN 'username_taken' END,
        CASE WHEN c.cmd_id NOT IN (SELECT cmd_id FROM accepted) THEN 'not_accepted' END) AS reason,
        """ + uid("'t01'", "CAST(cmd_id AS VARCHAR)") + """ AS new_uid
      FROM c)
"""
T01_USERS = T01 + f"""
SELECT * FROM users UNION ALL
SELECT new_uid, name, email, role, 'https://api.dicebear.com/7.x/avataaars/svg?seed=' || {ENC}, {TS}, NULL, NULL, NULL
FROM r WHERE reason IS NULL"""
T01_CREATORS = dbl(T01 + f"""
SELECT * FROM creator_profiles UNION ALL
SELECT {uid("'t01c'", "CAST(cmd_id AS VARCHAR)")}, new_uid, uname, NULL, NULL, NULL, NULL, 0, 0.00, 0.00, {TS}
FROM r WHERE reason IS NULL AND role = 'creator'""", "rating", "collaboration_rating")
T01_BRANDS = T01 + f"""
SELECT * FROM brand_profiles UNION ALL
SELECT {uid("'t01b'", "CAST(cmd_id AS VARCHAR)")}, new_uid,
       CASE WHEN coalesce(company_name, '') <> '' THEN company_name ELSE name END, NULL, NULL, {TS}
FROM r WHERE reason IS NULL AND role = 'brand'"""

# ------------------------------------------------------------------ T3
T03P = """
WITH r AS (SELECT c.*, cp.id AS pid,
                  CASE WHEN cp.id IS NULL THEN 'profile_not_found' WHEN c.platform_name IS NULL THEN 'not_null' END AS reason
           FROM cmd_t03_platforms c LEFT JOIN creator_profiles cp ON cp.user_id = c.actor_user_id)
"""
T03P_TABLE = dbl(T03P + f"""
SELECT * FROM creator_platforms UNION ALL
SELECT {uid("'t03'", "'creator_platforms'", "CAST(cmd_id AS VARCHAR)")}, pid, platform_name, username, profile_url,
       followers, engagement_rate FROM r WHERE reason IS NULL""", "engagement_rate")
T03K = """
WITH r AS (SELECT c.*, cp.id AS pid,
                  CASE WHEN cp.id IS NULL THEN 'profile_not_found'
                       WHEN c.package_name IS NULL OR c.price IS NULL OR c.delivery_days IS NULL THEN 'not_null' END AS reason
           FROM cmd_t03_packages c LEFT JOIN creator_profiles cp ON cp.user_id = c.actor_user_id)
"""
T03K_TABLE = dbl(T03K + f"""
SELECT * FROM promotion_packages UNION ALL
SELECT {uid("'t03'", "'promotion_packages'", "CAST(cmd_id AS VARCHAR)")}, pid, package_name, description, price,
       delivery_days, {TS} FROM r WHERE reason IS NULL""", "price")
T03C = """
WITH r AS (SELECT c.*, bp.id AS bid,
                  CASE WHEN bp.id IS NULL THEN 'profile_not_found' WHEN c.title IS NULL THEN 'not_null' END AS reason
           FROM cmd_t03_campaigns c LEFT JOIN brand_profiles bp ON bp.user_id = c.actor_user_id)
"""
T03C_TABLE = dbl(T03C + f"""
SELECT * FROM campaigns UNION ALL
SELECT {uid("'t03'", "'campaigns'", "CAST(cmd_id AS VARCHAR)")}, bid, title, description, budget, category, 'active', {TS}
FROM r WHERE reason IS NULL""", "budget")

# ------------------------------------------------------------------ T4
T04K = """
WITH r AS (SELECT c.*, CASE WHEN cp.id IS NULL THEN 'profile_not_found'
                            WHEN c.package_name IS NULL OR c.price IS NULL OR c.delivery_days IS NULL THEN 'invalid_value'
                            WHEN k.id IS NULL THEN 'not_found' WHEN k.creator_id <> cp.id THEN 'not_owner' END AS reason
           FROM cmd_t04_packages c LEFT JOIN creator_profiles cp ON cp.user_id = c.actor_user_id
           LEFT JOIN promotion_packages k ON k.id = c.target_id),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY seq DESC) AS rn
                        FROM r WHERE reason IS NULL) x WHERE rn = 1)
"""
T04K_TABLE = dbl(T04K + """
SELECT k.* REPLACE (CASE WHEN l.target_id IS NOT NULL THEN l.package_name ELSE k.package_name END AS package_name,
                    CASE WHEN l.target_id IS NOT NULL THEN l.description ELSE k.description END AS description,
                    CASE WHEN l.target_id IS NOT NULL THEN l.price ELSE k.price END AS price,
                    CASE WHEN l.target_id IS NOT NULL THEN l.delivery_days ELSE k.delivery_days END AS delivery_days)
FROM promotion_packages k LEFT JOIN last l ON l.target_id = k.id""", "price")
T04C = """
WITH r AS (SELECT c.*, CASE WHEN bp.id IS NULL THEN 'profile_not_found'
                            WHEN c.title IS NULL OR (c.status IS NOT NULL AND c.status NOT IN ('active','paused','completed','cancelled'))
                                 THEN 'invalid_value'
                            WHEN k.id IS NULL THEN 'not_found' WHEN k.brand_id <> bp.id THEN 'not_owner' END AS reason
           FROM cmd_t04_campaigns c LEFT JOIN brand_profiles bp ON bp.user_id = c.actor_user_id
           LEFT JOIN campaigns k ON k.id = c.target_id),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY seq DESC) AS rn
                        FROM r WHERE reason IS NULL) x WHERE rn = 1)
"""
T04C_TABLE = dbl(T04C + """
SELECT k.* REPLACE (CASE WHEN l.target_id IS NOT NULL THEN l.title ELSE k.title END AS title,
                    CASE WHEN l.target_id IS NOT NULL THEN l.description ELSE k.description END AS description,
                    CASE WHEN l.target_id IS NOT NULL THEN l.budget ELSE k.budget END AS budget,
                    CASE WHEN l.target_id IS NOT NULL THEN l.category ELSE k.category END AS category,
                    CASE WHEN l.target_id IS NOT NULL THEN l.status ELSE k.status END AS status)
FROM campaigns k LEFT JOIN last l ON l.target_id = k.id""", "budget")
T04P = """
WITH r AS (SELECT c.*, cp.id AS pid,
                  CASE WHEN cp.id IS NULL THEN 'profile_not_found' WHEN c.username IS NULL THEN 'not_null'
                       WHEN EXISTS (SELECT 1 FROM creator_profiles o WHERE lower(o.username) = lower(c.username)
                                    AND o.id <> cp.id) THEN 'username_taken' END AS reason
           FROM cmd_t04_profile c LEFT JOIN creator_profiles cp ON cp.user_id = c.actor_user_id),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY seq DESC) AS rn
                        FROM r WHERE reason IS NULL) x WHERE rn = 1)
"""
T04P_TABLE = dbl(T04P + """
SELECT p.* REPLACE (CASE WHEN l.pid IS NOT NULL THEN l.bio ELSE p.bio END AS bio,
                    CASE WHEN l.pid IS NOT NULL THEN l.category ELSE p.category END AS category,
                    CASE WHEN l.pid IS NOT NULL THEN l.city ELSE p.city END AS city,
                    CASE WHEN l.pid IS NOT NULL THEN l.country ELSE p.country END AS country,
                    CASE WHEN l.pid IS NOT NULL THEN l.username ELSE p.username END AS username)
FROM creator_profiles p LEFT JOIN last l ON l.pid = p.id""", "rating", "collaboration_rating")
T04A = """
WITH r AS (SELECT c.*, CASE WHEN avatar_url IS NULL THEN 'no_file' END AS reason FROM cmd_t04_avatar c),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY actor_user_id ORDER BY seq DESC) AS rn
                        FROM r WHERE reason IS NULL) x WHERE rn = 1)
"""
T04A_TABLE = T04A + """
SELECT u.* REPLACE (CASE WHEN l.actor_user_id IS NOT NULL THEN l.avatar_url ELSE u.avatar_url END AS avatar_url)
FROM users u LEFT JOIN last l ON l.actor_user_id = u.id"""

# ------------------------------------------------------------------ T5
T05K = """
WITH r AS (SELECT c.*, CASE WHEN cp.id IS NULL THEN 'profile_not_found'
                            WHEN NOT EXISTS (SELECT 1 FROM promotion_packages k WHERE k.id = c.target_id AND k.creator_id = cp.id)
                                 THEN 'not_owner' END AS reason
           FROM cmd_t05_packages c LEFT JOIN creator_profiles cp ON cp.user_id = c.actor_user_id),
gone AS (SELECT DISTINCT target_id AS id FROM r WHERE reason IS NULL)
"""
T05K_PKG = dbl(T05K + "SELECT * FROM promotion_packages WHERE id NOT IN (SELECT id FROM gone)", "price")
T05K_BK = dbl(T05K + """
SELECT b.* REPLACE (CASE WHEN b.package_id IN (SELECT id FROM gone) THEN NULL ELSE b.package_id END AS package_id)
FROM bookings b""", "price")
T05C = """
WITH r AS (SELECT c.*, CASE WHEN bp.id IS NULL THEN 'profile_not_found'
                            WHEN NOT EXISTS (SELECT 1 FROM campaigns k WHERE k.id = c.target_id AND k.brand_id = bp.id)
                                 THEN 'not_owner' END AS reason
           FROM cmd_t05_campaigns c LEFT JOIN brand_profiles bp ON bp.user_id = c.actor_user_id),
gone AS (SELECT DISTINCT target_id AS id FROM r WHERE reason IS NULL)
"""
T05C_CM = dbl(T05C + "SELECT * FROM campaigns WHERE id NOT IN (SELECT id FROM gone)", "budget")
T05C_INV = T05C + "SELECT * FROM campaign_invites WHERE campaign_id IS NULL OR campaign_id NOT IN (SELECT id FROM gone)"
T05C_BK = dbl(T05C + """
SELECT b.* REPLACE (CASE WHEN b.campaign_id IN (SELECT id FROM gone) THEN NULL ELSE b.campaign_id END AS campaign_id)
FROM bookings b""", "price")

# ------------------------------------------------------------------ T15
T15 = """
WITH c AS (
  SELECT c.*, bp.id AS bpid, b.id AS bid, b.creator_id AS bcreator,
         EXISTS (SELECT 1 FROM reviews r WHERE r.booking_id = c.booking_id) AS had,
         CASE WHEN coalesce(c.booking_id, '') = '' OR coalesce(c.rating, 0) = 0 THEN 'missing_fields'
              WHEN bp.id IS NULL THEN 'not_brand' WHEN b.id IS NULL THEN 'booking_not_completed' END AS static
  FROM cmd_t15 c LEFT JOIN brand_profiles bp ON bp.user_id = c.actor_user_id
  LEFT JOIN bookings b ON b.id = c.booking_id AND b.brand_id = bp.id AND b.status = 'completed'),
win AS (SELECT booking_id, min(seq) AS wseq FROM c WHERE static IS NULL AND NOT had AND rating BETWEEN 1 AND 5
        GROUP BY booking_id),
r AS (SELECT c.*, coalesce(static, CASE WHEN had OR w.wseq < c.seq THEN 'already_reviewed' END,
                           CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating_range' END) AS reason
      FROM c LEFT JOIN win w ON w.booking_id = c.booking_id),
allrev AS (SELECT id, booking_id, brand_id, creator_id, rating, comment, created_at FROM reviews UNION ALL
           SELECT """ + uid("'t15'", "CAST(cmd_id AS VARCHAR)") + f""", booking_id, bpid, bcreator, rating, comment, {TS}
           FROM r WHERE reason IS NULL)
"""
T15_REVIEWS = T15 + "SELECT * FROM allrev"
T15_PROFILES = T15 + """,
av AS (SELECT creator_id, (((2 * ((20000 * SUM(rating) + COUNT(*)) // (2 * COUNT(*))) + 100) // 200) / 100.0) AS v
       FROM allrev WHERE creator_id IN (SELECT bcreator FROM r WHERE reason IS NULL) GROUP BY creator_id)
SELECT p.* REPLACE (coalesce(av.v, CAST(p.rating AS DOUBLE)) AS rating, CAST(p.collaboration_rating AS DOUBLE) AS collaboration_rating)
FROM creator_profiles p LEFT JOIN av ON av.creator_id = p.id"""

# ------------------------------------------------------------------ T16
T16 = """
WITH r AS (SELECT c.*, cp.id AS pid,
                  CASE WHEN coalesce(c.title, '') = '' THEN 'missing_title' WHEN cp.id IS NULL THEN 'not_creator' END AS reason,
                  """ + uid("'t16'", "CAST(c.cmd_id AS VARCHAR)") + """ AS cid
           FROM cmd_t16 c LEFT JOIN creator_profiles cp ON cp.user_id = c.actor_user_id)
"""
T16_COLLABS = T16 + f"""
SELECT * FROM collaborations UNION ALL
SELECT cid, pid, title, description, platform, category, location,
       CASE WHEN coalesce(followers_required, 0) <> 0 THEN followers_required ELSE 0 END, collaboration_type, 'open', {TS}
FROM r WHERE reason IS NULL"""
T16_PARTS = T16 + f"""
SELECT * FROM collaboration_participants UNION ALL
SELECT {uid("'t16h'", "CAST(cmd_id AS VARCHAR)")}, cid, pid, 'host', {TS} FROM r WHERE reason IS NULL"""

# ------------------------------------------------------------------ T17
T17 = """
WITH c AS (
  SELECT c.*, cp.id AS pid, col.id AS colid, col.creator_id AS owner, col.title AS ctitle,
         EXISTS (SELECT 1 FROM collaboration_requests q WHERE q.collaboration_id = c.collaboration_id AND q.creator_id = cp.id) AS had,
         CASE WHEN cp.id IS NULL THEN 'not_creator' WHEN col.id IS NULL THEN 'not_found'
              WHEN col.status <> 'open' THEN 'not_open' WHEN col.creator_id = cp.id THEN 'own_collaboration' END AS static
  FROM cmd_t17 c LEFT JOIN creator_profiles cp ON cp.user_id = c.actor_user_id
  LEFT JOIN collaborations col ON col.id = c.collaboration_id),
win AS (SELECT collaboration_id, pid, min(seq) AS wseq FROM c WHERE static IS NULL AND NOT had GROUP BY collaboration_id, pid),
r AS (SELECT c.*, coalesce(static, CASE WHEN had OR w.wseq < c.seq THEN 'already_applied' END) AS reason
      FROM c LEFT JOIN win w ON w.collaboration_id = c.collaboration_id AND w.pid = c.pid)
"""
T17_REQ = T17 + f"""
SELECT * FROM collaboration_requests UNION ALL
SELECT {uid("'t17'", "CAST(cmd_id AS VARCHAR)")}, collaboration_id, pid, 'pending',
       CASE WHEN coalesce(message, '') <> '' THEN message END, {TS} FROM r WHERE reason IS NULL"""
T17_NOTIF = T17 + notif("t17", "r JOIN creator_profiles o ON o.id = r.owner WHERE r.reason IS NULL", "o.user_id",
                        "New Collaboration Request", "'New collaboration request for \"' || r.ctitle || '\"'",
                        "'/collaboration/' || r.collaboration_id", key="r.cmd_id")

# ------------------------------------------------------------------ T18
T18 = """
WITH c AS (
  SELECT c.*, cp.id AS pid, col.id AS colid, col.title AS ctitle, q.id AS qid, q.creator_id AS applicant
  FROM cmd_t18 c LEFT JOIN creator_profiles cp ON cp.user_id = c.actor_user_id
  LEFT JOIN collaborations col ON col.id = c.collaboration_id AND col.creator_id = cp.id
  LEFT JOIN collaboration_requests q ON q.id = c.request_id AND q.collaboration_id = c.collaboration_id),
r AS (SELECT *, CASE WHEN decision NOT IN ('accept', 'reject') OR decision IS NULL THEN 'invalid_decision'
                     WHEN colid IS NULL THEN 'not_owner'
                     WHEN decision = 'accept' AND qid IS NULL THEN 'request_not_found' END AS reason FROM c),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seq DESC) AS rn
                        FROM r WHERE reason IS NULL AND qid IS NOT NULL) x WHERE rn = 1),
acc AS (SELECT r.*, ap.user_id AS app_user FROM r LEFT JOIN creator_profiles ap ON ap.id = r.applicant
        WHERE r.reason IS NULL AND r.decision = 'accept')
"""
T18_REQ = T18 + """
SELECT q.* REPLACE (CASE WHEN l.request_id IS NULL THEN q.status WHEN l.decision = 'accept' THEN 'accepted'
                         ELSE 'rejected' END AS status)
FROM collaboration_requests q LEFT JOIN last l ON l.request_id = q.id"""
T18_COL = T18 + """
SELECT c.* REPLACE (CASE WHEN c.id IN (SELECT collaboration_id FROM acc) THEN 'in_progress' ELSE c.status END AS status)
FROM collaborations c"""
T18_PART = T18 + f"""
SELECT * FROM collaboration_participants UNION ALL
SELECT {uid("'t18'", "collaboration_id", "applicant")}, collaboration_id, applicant, 'collaborator', {TS}
FROM (SELECT DISTINCT collaboration_id, applicant FROM acc) a
WHERE NOT EXISTS (SELECT 1 FROM collaboration_participants p WHERE p.collaboration_id = a.collaboration_id
                  AND p.creator_id = a.applicant)"""
T18_MSG = T18 + f"""
SELECT * FROM messages UNION ALL
SELECT {uid("'t18m'", "CAST(cmd_id AS VARCHAR)")}, actor_user_id, app_user, NULL,
       'Your collaboration request for "' || ctitle || '" was accepted! Let''s discuss the details here.', {TS}
FROM acc WHERE app_user IS NOT NULL"""
T18_NOTIF = T18 + notif("t18", "acc WHERE app_user IS NOT NULL", "app_user", "Collaboration Accepted",
                        "'Your collaboration request for \"' || ctitle || '\" was accepted! 🎉'",
                        "'/collaboration/' || collaboration_id")

# ------------------------------------------------------------------ T19
T19 = """
WITH r AS (SELECT c.*, cp.id AS pid, col.title AS ctitle, CASE WHEN col.id IS NULL THEN 'not_owner' END AS reason
           FROM cmd_t19 c LEFT JOIN creator_profiles cp ON cp.user_id = c.actor_user_id
           LEFT JOIN collaborations col ON col.id = c.collaboration_id AND col.creator_id = cp.id)
"""
T19_COL = T19 + """
SELECT c.* REPLACE (CASE WHEN c.id IN (SELECT collaboration_id FROM r WHERE reason IS NULL) THEN 'completed'
                         ELSE c.status END AS status) FROM collaborations c"""
T19_NOTIF = T19 + notif(
    "t19", "r JOIN collaboration_participants j ON j.collaboration_id = r.collaboration_id "
           "JOIN creator_profiles p2 ON p2.id = j.creator_id WHERE r.reason IS NULL AND j.creator_id <> r.pid",
    "p2.user_id", "Collaboration Completed",
    "'Collaboration \"' || r.ctitle || '\" has been marked complete. Please leave a review!'",
    "'/collaboration/' || r.collaboration_id", key="r.cmd_id")

# ------------------------------------------------------------------ T20
T20 = """
WITH r AS (SELECT c.*, CASE WHEN NOT coalesce(regexp_matches(c.message, '[^\\s\\x{A0}\\x{2028}\\x{2029}\\x{3000}\\x{FEFF}]'), false) THEN 'empty_message'
                            WHEN cp.id IS NULL THEN 'no_profile'
                            WHEN NOT EXISTS (SELECT 1 FROM collaboration_participants j WHERE j.collaboration_id = c.collaboration_id
                                             AND j.creator_id = cp.id) THEN 'not_participant' END AS reason
           FROM cmd_t20 c LEFT JOIN creator_profiles cp ON cp.user_id = c.actor_user_id)
"""
T20_MSG = T20 + f"""
SELECT * FROM collaboration_messages UNION ALL
SELECT {uid("'t20'", "CAST(cmd_id AS VARCHAR)")}, collaboration_id, actor_user_id, message, {TS} FROM r WHERE reason IS NULL"""
T20_NOTIF = T20 + notif(
    "t20", "r JOIN collaboration_participants j ON j.collaboration_id = r.collaboration_id "
           "JOIN creator_profiles p2 ON p2.id = j.creator_id WHERE r.reason IS NULL AND p2.user_id <> r.actor_user_id",
    "p2.user_id", "New Collaboration Message", "'New message in collaboration chat'",
    "'/collaboration/' || r.collaboration_id", key="r.cmd_id")

# ------------------------------------------------------------------ T21
T21 = """
WITH r AS (SELECT c.*, s.email AS semail,
                  CASE WHEN s.role = 'creator' THEN 'creator_cannot_send'
                       WHEN coalesce(c.receiver_id, '') = '' OR coalesce(c.message, '') = '' THEN 'missing_fields'
                       WHEN s.id IS NULL THEN 'sender_not_found'
                       WHEN NOT EXISTS (SELECT 1 FROM users u WHERE u.id = c.receiver_id) THEN 'receiver_not_found'
                       WHEN coalesce(c.booking_id, '') <> '' AND NOT EXISTS (SELECT 1 FROM bookings b WHERE b.id = c.booking_id)
                            THEN 'booking_not_found' END AS reason
           FROM cmd_t21 c LEFT JOIN users s ON s.id = c.actor_user_id)
"""
T21_MSG = T21 + f"""
SELECT * FROM messages UNION ALL
SELECT {uid("'t21'", "CAST(cmd_id AS VARCHAR)")}, actor_user_id, receiver_id,
       CASE WHEN coalesce(booking_id, '') <> '' THEN booking_id END, message, {TS} FROM r WHERE reason IS NULL"""
T21_NOTIF = T21 + notif("t21", "r WHERE reason IS NULL", "receiver_id", "New Message",
                        "'New message from ' || semail", "'/brand/messages'")

# ------------------------------------------------------------------ T22
T22_NOTIF = """
SELECT n.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM cmd_t22 c WHERE c.notification_id = n.id AND c.actor_user_id = n.user_id)
                          OR EXISTS (SELECT 1 FROM cmd_t22 c WHERE c.notification_id IS NULL AND c.actor_user_id = n.user_id)
                         THEN TRUE ELSE n.is_read END AS is_read)
FROM notifications n"""


# ------------------------------------------------------------------ T23 (delete closure from the FK list)
def _closure(seed_sql: str) -> str:
    ctes = []
    for t in delete_order():
        parts = [seed_sql] if t == "users" else []
        for fk in FOREIGN_KEYS:
            if fk.table == t and fk.on_delete == "cascade":
                parts.append(f"SELECT id FROM {t} WHERE {fk.column} IN (SELECT id FROM del_{fk.parent})")
        if not parts:
            parts = [f"SELECT id FROM {t} WHERE FALSE"]
        ctes.append(f"del_{t} AS ({' UNION '.join(parts)})")
    return "WITH " + ",\n".join(ctes) + "\n"


def _after_delete(t: str) -> str:
    sets = []
    for fk in FOREIGN_KEYS:
        if fk.table == t and fk.on_delete == "set_null":
            sets.append(f"CASE WHEN x.{fk.column} IN (SELECT id FROM del_{fk.parent}) THEN NULL ELSE x.{fk.column} END "
                        f"AS {fk.column}")
    star = f"x.* REPLACE ({', '.join(sets)})" if sets else "x.*"
    return f"SELECT {star} FROM {t} x WHERE x.id NOT IN (SELECT id FROM del_{t})"


T23_SEED = "SELECT user_id AS id FROM cmd_t23"
T23 = _closure(T23_SEED)
T23_MONEY = {"bookings": ("price",), "payments": ("amount",), "creator_profiles": ("rating", "collaboration_rating")}


def _t23(t: str) -> str:
    body = T23 + _after_delete(t)
    return dbl(body, *T23_MONEY[t]) if t in T23_MONEY else body


T23_AUDIT = f"""
SELECT {uid("'t23'", "'a'", "CAST(cmd_id AS VARCHAR)")} AS id, 'Deleted user ' || user_id AS action,
       actor_user_id AS admin_id, {TS} AS created_at FROM cmd_t23"""

# ------------------------------------------------------------------ T24, T25
T24 = """
WITH r AS (SELECT c.*, CASE WHEN role NOT IN ('creator', 'brand', 'admin') OR role IS NULL THEN 'enum' END AS reason
           FROM cmd_t24 c),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn
                        FROM r WHERE reason IS NULL) x WHERE rn = 1)
"""
T24_USERS = T24 + """
SELECT u.* REPLACE (coalesce(l.role, u.role) AS role) FROM users u LEFT JOIN last l ON l.user_id = u.id"""
T24_AUDIT = T24 + f"""
SELECT {uid("'t24'", "'a'", "CAST(cmd_id AS VARCHAR)")} AS id, 'Changed role of user ' || user_id || ' to ' || role AS action,
       actor_user_id AS admin_id, {TS} AS created_at FROM r WHERE reason IS NULL"""
T25 = """
WITH c AS (SELECT c.*, coalesce(verified, FALSE) AS v FROM cmd_t25 c),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY creator_profile_id ORDER BY seq DESC) AS rn FROM c) x
         WHERE rn = 1)
"""
T25_PROFILES = dbl(T25 + """
SELECT p.* REPLACE (CASE WHEN l.creator_profile_id IS NOT NULL THEN CAST(l.v AS INTEGER) ELSE p.verified END AS verified)
FROM creator_profiles p LEFT JOIN last l ON l.creator_profile_id = p.id""", "rating", "collaboration_rating")
T25_AUDIT = T25 + f"""
SELECT {uid("'t25'", "'a'", "CAST(cmd_id AS VARCHAR)")} AS id,
       CASE WHEN v THEN 'Verified' ELSE 'Unverified' END || ' creator profile ' || creator_profile_id AS action,
       actor_user_id AS admin_id, {TS} AS created_at FROM c"""
T25_NOTIF = T25 + notif("t25", "c JOIN creator_profiles p ON p.id = c.creator_profile_id", "p.user_id", None,
                        "CASE WHEN c.v THEN 'Your profile has been verified! ✅' "
                        "ELSE 'Your profile verification was revoked.' END", None, key="c.cmd_id")

# ------------------------------------------------------------------ T26
T26 = """
WITH c AS (
  SELECT c.*, cp.id AS pid, t.id AS tid, t.user_id AS tuser,
         EXISTS (SELECT 1 FROM collaboration_reviews x WHERE x.collaboration_id = c.collaboration_id
                 AND x.reviewer_id = cp.id AND x.creator_id = c.creator_id) AS had,
         CASE WHEN coalesce(c.collaboration_id, '') = '' OR coalesce(c.creator_id, '') = '' OR coalesce(c.rating, 0) = 0
                   THEN 'missing_fields'
              WHEN cp.id IS NULL THEN 'not_creator'
              WHEN NOT EXISTS (SELECT 1 FROM collaboration_participants j WHERE j.collaboration_id = c.collaboration_id
                               AND j.creator_id = cp.id) THEN 'not_participant'
              WHEN c.creator_id = cp.id THEN 'self_review'
              WHEN NOT EXISTS (SELECT 1 FROM collaborations col WHERE col.id = c.collaboration_id AND col.status = 'completed')
                   THEN 'not_completed' END AS static
  FROM cmd_t26 c LEFT JOIN creator_profiles cp ON cp.user_id = c.actor_user_id
  LEFT JOIN creator_profiles t ON t.id = c.creator_id),
win AS (SELECT collaboration_id, pid, creator_id, min(seq) AS wseq FROM c
        WHERE static IS NULL AND rating BETWEEN 1 AND 5 AND NOT had AND tid IS NOT NULL
        GROUP BY collaboration_id, pid, creator_id),
r AS (SELECT c.*, coalesce(static, CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating_range' END,
                           CASE WHEN had OR w.wseq < c.seq THEN 'already_reviewed' END,
                           CASE WHEN tid IS NULL THEN 'creator_not_found' END) AS reason
      FROM c LEFT JOIN win w ON w.collaboration_id = c.collaboration_id AND w.pid = c.pid AND w.creator_id = c.creator_id),
allrev AS (SELECT * FROM collaboration_reviews UNION ALL
           SELECT """ + uid("'t26'", "CAST(cmd_id AS VARCHAR)") + f""", collaboration_id, pid, creator_id, rating, comment, {TS}
           FROM r WHERE reason IS NULL)
"""
T26_REVIEWS = T26 + "SELECT * FROM allrev"
T26_PROFILES = T26 + """,
av AS (SELECT creator_id, (((2 * ((20000 * SUM(rating) + COUNT(*)) // (2 * COUNT(*))) + 100) // 200) / 100.0) AS v
       FROM allrev WHERE creator_id IN (SELECT creator_id FROM r WHERE reason IS NULL) GROUP BY creator_id)
SELECT p.* REPLACE (CAST(p.rating AS DOUBLE) AS rating, coalesce(av.v, CAST(p.collaboration_rating AS DOUBLE)) AS collaboration_rating)
FROM creator_profiles p LEFT JOIN av ON av.creator_id = p.id"""
T26_NOTIF = T26 + notif("t26", "r WHERE reason IS NULL", "tuser", None,
                        "'You received a ' || CAST(rating AS VARCHAR) || '⭐ collaboration review!'", None)

SQL: dict[str, str] = {
    "t01_register_users__users": T01_USERS,
    "t01_register_users__creator_profiles": T01_CREATORS,
    "t01_register_users__brand_profiles": T01_BRANDS,
    "t01_register_users__rejects": T01 + rejects(),
    "t03_append_platforms__creator_platforms": T03P_TABLE,
    "t03_append_platforms__rejects": T03P + rejects(),
    "t03_append_packages__promotion_packages": T03K_TABLE,
    "t03_append_packages__rejects": T03K + rejects(),
    "t03_append_campaigns__campaigns": T03C_TABLE,
    "t03_append_campaigns__rejects": T03C + rejects(),
    "t04_update_packages__promotion_packages": T04K_TABLE,
    "t04_update_packages__rejects": T04K + rejects(),
    "t04_update_campaigns__campaigns": T04C_TABLE,
    "t04_update_campaigns__rejects": T04C + rejects(),
    "t04_update_profile__creator_profiles": T04P_TABLE,
    "t04_update_profile__rejects": T04P + rejects(),
    "t04_update_avatar__users": T04A_TABLE,
    "t04_update_avatar__rejects": T04A + rejects(),
    "t05_delete_packages__promotion_packages": T05K_PKG,
    "t05_delete_packages__bookings": T05K_BK,
    "t05_delete_packages__rejects": T05K + rejects(),
    "t05_delete_campaigns__campaigns": T05C_CM,
    "t05_delete_campaigns__campaign_invites": T05C_INV,
    "t05_delete_campaigns__bookings": T05C_BK,
    "t05_delete_campaigns__rejects": T05C + rejects(),
    "t15_submit_reviews__reviews": T15_REVIEWS,
    "t15_submit_reviews__creator_profiles": T15_PROFILES,
    "t15_submit_reviews__rejects": T15 + rejects(),
    "t16_create_collaborations__collaborations": T16_COLLABS,
    "t16_create_collaborations__collaboration_participants": T16_PARTS,
    "t16_create_collaborations__rejects": T16 + rejects(),
    "t17_apply_collaborations__collaboration_requests": T17_REQ,
    "t17_apply_collaborations__rejects": T17 + rejects(),
    "t17_apply_collaborations__notifications": T17_NOTIF,
    "t18_decide_requests__collaboration_requests": T18_REQ,
    "t18_decide_requests__collaborations": T18_COL,
    "t18_decide_requests__collaboration_participants": T18_PART,
    "t18_decide_requests__messages": T18_MSG,
    "t18_decide_requests__rejects": T18 + rejects(),
    "t18_decide_requests__notifications": T18_NOTIF,
    "t19_complete_collaborations__collaborations": T19_COL,
    "t19_complete_collaborations__rejects": T19 + rejects(),
    "t19_complete_collaborations__notifications": T19_NOTIF,
    "t20_post_collab_messages__collaboration_messages": T20_MSG,
    "t20_post_collab_messages__rejects": T20 + rejects(),
    "t20_post_collab_messages__notifications": T20_NOTIF,
    "t21_send_messages__messages": T21_MSG,
    "t21_send_messages__rejects": T21 + rejects(),
    "t21_send_messages__notifications": T21_NOTIF,
    "t22_mark_read__notifications": T22_NOTIF,
    **{f"t23_delete_users__{t}": _t23(t) for t in ("users", "creator_profiles", "brand_profiles", "bookings",
                                                   "payments", "messages", "admin_logs", "reviews",
                                                   "collaboration_participants")},
    "t23_delete_users__audit": T23_AUDIT,
    "t24_change_roles__users": T24_USERS,
    "t24_change_roles__rejects": T24 + rejects(),
    "t24_change_roles__audit": T24_AUDIT,
    "t25_verify_creators__creator_profiles": T25_PROFILES,
    "t25_verify_creators__notifications": T25_NOTIF,
    "t25_verify_creators__audit": T25_AUDIT,
    "t26_collab_reviews__collaboration_reviews": T26_REVIEWS,
    "t26_collab_reviews__creator_profiles": T26_PROFILES,
    "t26_collab_reviews__rejects": T26 + rejects(),
    "t26_collab_reviews__notifications": T26_NOTIF,
}
