"""Keyed calls of the read operators: one key, as each endpoint answers.

``KEYED`` names for each set-wide query the operator, its key parameter, the
result column that holds the key, and the key asked for.  The filter is on
the operator's own parameter, so it reaches the scan.
"""

from __future__ import annotations

from souk.operators import admin, bookings, collaborations, creators, messaging, money

BRAND, CREATOR, BOOKING, COLLAB = "b-1", "c-1", "bk-7", "cl-2"
BRAND_USER, CREATOR_USER = "u-b-1", "u-c-1"

#: set-wide query -> (operator, key parameter, key column of the result, key)
KEYED: dict[str, tuple] = {
    "q05_profile_children": (creators.profile_children, "creator_id", "creator_id", CREATOR),
    "q07_earnings_statement": (creators.earnings_statement, "creator_id", "creator_id", CREATOR),
    "q07_earnings_total": (creators.earnings_total, "creator_id", "creator_id", CREATOR),
    "q09_brand_campaigns": (bookings.brand_campaigns, "brand_id", "brand_id", BRAND),
    "q10_bookings_for_brand": (bookings.bookings_for_brand, "brand_id", "brand_id", BRAND),
    "q11_bookings_for_creator": (bookings.bookings_for_creator, "creator_id", "creator_id", CREATOR),
    "q13_booking_detail": (bookings.booking_detail, "booking_id", "id", BOOKING),
    "q14_payment_and_escrow": (bookings.payment_and_escrow, "booking_id", "booking_id", BOOKING),
    "q16_list_users": (admin.user_card, "user_id", "id", CREATOR_USER),
    "q20_brand_booking_history": (admin.brand_booking_history, "user_id", "history_user_id", BRAND_USER),
    "q21_brand_campaign_history": (admin.brand_campaign_history, "user_id", "history_user_id", BRAND_USER),
    "q22_creator_booking_history": (admin.creator_booking_history, "user_id", "history_user_id", CREATOR_USER),
    "q23_creator_collab_history": (admin.creator_collab_history, "user_id", "history_user_id", CREATOR_USER),
    "q26_withdrawal_history": (money.withdrawal_history, "creator_id", "creator_id", CREATOR),
    "q27_available_balance": (money.available_balance, "creator_id", "creator_id", CREATOR),
    "q30_booking_thread": (messaging.booking_thread, "booking_id", "booking_id", BOOKING),
    "q31_inbox": (messaging.inbox, "user_id", "inbox_user_id", CREATOR_USER),
    "q32_notification_feed": (messaging.notification_feed, "user_id", "user_id", CREATOR_USER),
    "q33_creator_reviews": (messaging.creator_reviews, "creator_id", "creator_id", CREATOR),
    "q34_brand_reviews": (messaging.brand_reviews, "brand_id", "brand_id", BRAND),
    "q38_my_collaborations": (collaborations.my_collaborations, "creator_id", "self_id", CREATOR),
    "q39_collaboration_thread": (collaborations.collaboration_thread, "collaboration_id", "collaboration_id", COLLAB),
    "q40_collaboration_reviews_for": (collaborations.collaboration_reviews_for, "creator_id", "creator_id", CREATOR),
}
