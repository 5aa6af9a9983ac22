"""The reference's seed dataset as a table bundle.

Symbolic keys become fixed ids; passwords are not carried over.  Rows
without an explicit creation time get ``SEED_TS`` (the database default
would be the load time).
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import SparkSession

from souk.sources.schema import SCHEMAS, TABLES
from souk.sources.tables import Market

SEED_TS = dt.datetime(2025, 1, 1, 0, 0, 0)
D = Decimal

# The seed rows of the reference (ids replaced, passwords dropped).
USERS = [
    ("u-admin", "Admin User", "admin@marketplace.com", "admin", "https://api.dicebear.com/7.x/avataaars/svg?seed=admin"),
    ("u-b1", "TechGiant Corp", "techgiant@brand.com", "brand", "https://api.dicebear.com/7.x/initials/svg?seed=TG"),
    ("u-b2", "FashionForward Ltd", "fashion@brand.com", "brand", "https://api.dicebear.com/7.x/initials/svg?seed=FF"),
    ("u-b3", "FoodieWorld", "foodie@brand.com", "brand", "https://api.dicebear.com/7.x/initials/svg?seed=FW"),
    ("u-c1", "Priya Sharma", "priya@creator.com", "creator", "https://api.dicebear.com/7.x/avataaars/svg?seed=priya"),
    ("u-c2", "Rahul Verma", "rahul@creator.com", "creator", "https://api.dicebear.com/7.x/avataaars/svg?seed=rahul"),
    ("u-c3", "Sneha Patel", "sneha@creator.com", "creator", "https://api.dicebear.com/7.x/avataaars/svg?seed=sneha"),
    ("u-c4", "Arjun Kapoor", "arjun@creator.com", "creator", "https://api.dicebear.com/7.x/avataaars/svg?seed=arjun"),
    ("u-c5", "Meera Nair", "meera@creator.com", "creator", "https://api.dicebear.com/7.x/avataaars/svg?seed=meera"),
]
BRANDS = [
    ("b1", "u-b1", "TechGiant Corp", "Technology", "https://techgiant.com"),
    ("b2", "u-b2", "FashionForward Ltd", "Fashion & Lifestyle", "https://fashionforward.com"),
    ("b3", "u-b3", "FoodieWorld", "Food & Beverage", "https://foodieworld.com"),
]
CREATORS = [
    ("c1", "u-c1", "priya_creates", "Lifestyle & beauty content creator. Love sharing tips and reviews!",
     "Lifestyle", "Mumbai", "India", 1, D("4.80")),
    ("c2", "u-c2", "rahul_tech", "Tech reviewer and gadget enthusiast. 500K+ YouTube subscribers.",
     "Technology", "Bangalore", "India", 1, D("4.60")),
    ("c3", "u-c3", "sneha_style", "Fashion influencer and trend curator from Delhi.",
     "Fashion", "Delhi", "India", 0, D("4.30")),
    ("c4", "u-c4", "arjun_memes", "Running the most followed meme page on Instagram. Viral content daily!",
     "Memes", "Hyderabad", "India", 1, D("4.90")),
    ("c5", "u-c5", "meera_food", "Food blogger and recipe creator. Telegram channel with 50K foodies.",
     "Food", "Chennai", "India", 1, D("4.70")),
]
PLATFORMS = [
    ("p1", "c1", "Instagram", "@priya_creates", "https://instagram.com/priya_creates", 250000, D("5.80")),
    ("p2", "c1", "YouTube", "Priya Creates", "https://youtube.com/@priyacreates", 85000, D("4.20")),
    ("p3", "c2", "YouTube", "Rahul Tech", "https://youtube.com/@rahultech", 520000, D("6.10")),
    ("p4", "c2", "Instagram", "@rahul_tech", "https://instagram.com/rahultech", 120000, D("3.90")),
    ("p5", "c3", "Instagram", "@sneha_style", "https://instagram.com/snehastyle", 180000, D("7.20")),
    ("p6", "c4", "Instagram", "@arjun_memes_official", "https://instagram.com/arjunmemes", 890000, D("12.50")),
    ("p7", "c4", "Telegram", "Meme Palace", "https://t.me/memepalace", 145000, D("8.30")),
    ("p8", "c5", "Telegram", "Meera Food Diaries", "https://t.me/meerafood", 52000, D("15.20")),
    ("p9", "c5", "Instagram", "@meera_food", "https://instagram.com/meerafood", 95000, D("6.80")),
]
PACKAGES = [
    ("k1", "c1", "Instagram Story Mention", "1 story with swipe-up link, 24hr visibility, 250K+ reach", D("2500.00"), 2),
    ("k2", "c1", "Instagram Post + Reel", "Dedicated post + 30-sec reel, stays on profile forever", D("8000.00"), 5),
    ("k3", "c2", "YouTube Dedicated Review", "10-15 min dedicated product review video, 500K+ subscribers",
     D("25000.00"), 7),
    ("k4", "c2", "YouTube Integration (60s)", "60 second integration in my next tech video", D("12000.00"), 5),
    ("k5", "c3", "Instagram Fashion Collab", "Full outfit post featuring your product with detailed caption",
     D("5500.00"), 3),
    ("k6", "c4", "Meme Page Post", "Viral meme post featuring your brand organically, 900K reach", D("15000.00"), 1),
    ("k7", "c4", "Telegram Shoutout", "Pinned promotional message to 145K Telegram subscribers", D("4000.00"), 1),
    ("k8", "c5", "Recipe Integration", "Your product featured in a recipe video/post for food audience",
     D("6000.00"), 4),
    ("k9", "c5", "Telegram Campaign", "5 promotional messages over 1 week to 52K engaged foodies", D("8500.00"), 7),
]
CAMPAIGNS = [
    ("camp1", "b1", "New Smartphone Launch", "Looking for tech creators to review our latest flagship smartphone",
     D("100000.00"), "Technology", "active"),
    ("camp2", "b2", "Summer Collection Promo", "Fashion creators needed for summer collection showcase",
     D("50000.00"), "Fashion", "active"),
    ("camp3", "b3", "Healthy Snack Launch", "Food creators to promote our new range of healthy snacks",
     D("35000.00"), "Food", "active"),
    ("camp4", "b1", "App Download Campaign", "Drive app downloads through creator promotions on all platforms",
     D("75000.00"), "Technology", "active"),
]


def seed_rows() -> dict[str, list[tuple]]:
    ts = SEED_TS
    return {
        "users": [(i, n, e, r, a, ts, None, None, None) for i, n, e, r, a in USERS],
        "brand_profiles": [(i, u, c, ind, w, ts) for i, u, c, ind, w in BRANDS],
        "creator_profiles": [(i, u, un, bio, cat, city, ctry, ver, rat, D("0.00"), ts)
                             for i, u, un, bio, cat, city, ctry, ver, rat in CREATORS],
        "creator_platforms": PLATFORMS,
        "promotion_packages": [(i, c, n, d, p, dd, ts) for i, c, n, d, p, dd in PACKAGES],
        "campaigns": [(i, b, t, d, bud, cat, st, ts) for i, b, t, d, bud, cat, st in CAMPAIGNS],
    }


def load_seed(spark: SparkSession) -> Market:
    """The seed as a bundle; tables without seed rows are empty."""
    rows = seed_rows()
    frames = {t: spark.createDataFrame(rows.get(t, []), SCHEMAS[t]) for t in TABLES}
    return Market(spark, lambda name: frames[name])
