"""DuckDB oracles for the stream jobs (the batch answer over all input)."""

from __future__ import annotations

from oracle.checks import ratings_sql
from oracle.jobs import locale, uid

W1 = f"""
WITH fan AS (
  SELECT ev.* REPLACE (p2.user_id AS user_id) FROM notify_events ev
  JOIN collaboration_participants j ON j.collaboration_id = ev.ref_id
  JOIN creator_profiles p2 ON p2.id = j.creator_id
  WHERE ev.user_id IS NULL AND ev.event = 'collab_message' AND p2.user_id <> ev.actor_user_id),
allv AS (SELECT * FROM notify_events WHERE user_id IS NOT NULL UNION ALL SELECT * FROM fan)
SELECT {uid("'w1'", "'n'", "event_key", "user_id")} AS id, user_id,
       CASE event WHEN 'booking_created' THEN 'New Booking Request' WHEN 'collab_message' THEN 'New Collaboration Message'
            ELSE 'Notification' END AS title,
       CASE event WHEN 'booking_created' THEN 'You have a new booking request from a brand. Booking #' || ref_id
                  WHEN 'collab_message' THEN 'New message in collaboration chat'
                  WHEN 'payment_received' THEN 'Payment received for booking #' || ref_id || '. Please submit your content.'
                  WHEN 'collab_review' THEN 'You received a ' || rating || '⭐ collaboration review!'
                  ELSE '❌ Your withdrawal request of ₹' || {locale('amount')} || ' was rejected. ' || coalesce(note, '') END
         AS message,
       CASE event WHEN 'booking_created' THEN '/creator/bookings' WHEN 'collab_message' THEN '/collaboration/' || ref_id
            END AS link,
       FALSE AS is_read, created_at
FROM allv"""

W2 = """
WITH lr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, eid DESC) AS rn
                           FROM presence_events WHERE kind = 'register') x WHERE rn = 1)
SELECT lr.user_id, lr.socket_id, lr.ts AS registered_at,
       NOT EXISTS (SELECT 1 FROM presence_events d WHERE d.kind = 'disconnect' AND d.user_id = lr.user_id
                   AND d.socket_id = lr.socket_id AND (d.ts > lr.ts OR (d.ts = lr.ts AND d.eid > lr.eid))) AS online
FROM lr"""

W3 = """
WITH r AS (
  SELECT n.id, n.user_id, n.created_at,
         (SELECT max(ts) FROM presence_events p WHERE p.user_id = n.user_id AND p.kind = 'register'
                 AND p.ts < n.created_at) AS rts
  FROM notifications n),
r2 AS (
  SELECT r.*, (SELECT arg_max(socket_id, eid) FROM presence_events p WHERE p.user_id = r.user_id AND p.kind = 'register'
                      AND p.ts = r.rts) AS rsock,
              (SELECT max(eid) FROM presence_events p WHERE p.user_id = r.user_id AND p.kind = 'register'
                      AND p.ts = r.rts) AS reid
  FROM r),
r3 AS (
  SELECT r2.*, rts IS NOT NULL AND NOT EXISTS (
           SELECT 1 FROM presence_events d WHERE d.user_id = r2.user_id AND d.kind = 'disconnect'
           AND d.socket_id = r2.rsock AND (d.ts > r2.rts OR (d.ts = r2.rts AND d.eid > r2.reid))
           AND d.ts < r2.created_at) AS delivered
  FROM r2)
SELECT id, user_id, created_at, delivered, CASE WHEN delivered THEN rsock END AS socket_id FROM r3"""

SQL = {
    "w1_notification_stream": W1,
    "w2_presence_stream": W2,
    "w3_deliver_online": W3,
    "w3_delivery_stream": W3,
    "w4_rating_stream": ratings_sql("reviews", "rating"),
}
