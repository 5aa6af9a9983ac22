"""T2 against a step-by-step simulation of the login handler: a
written-out case and random logins over few ids and emails."""

import random

import pytest

from souk.plans.accounts import resolve_identities
from tests.helpers import bundle, ts

USERS = [{"id": "u1", "name": "Ann", "email": "ann@x.test", "role": "brand", "google_id": "g-ann", "created_at": ts(0)},
         {"id": "u2", "name": "Bob", "email": "Bob@x.test", "role": "creator", "created_at": ts(1)}]
LOGINS = [  # cmd_id, provider, provider_id, email, name
    (1, "google", "g-ann", None, "Ann"),            # provider match
    (2, "facebook", "f-bob", "bob@x.test", "Bob"),  # email link (case-insensitive)
    (3, "google", "g-new", "new@x.test", "New  Person"),
    (4, "facebook", "f-new", "new@x.test", "New Person"),  # same email as a user created in this batch
    (5, "google", "g-anon", None, "Anon"),
    (6, "google", "g-anon", None, "Anon"),          # same provider id, no email
    (7, "github", "gh-1", "z@x.test", "Z"),         # no id column for this provider
]


def random_logins(seed, n=70):
    rng = random.Random(seed)
    out = []
    for c in range(1, n + 1):
        prov = rng.choice(["google", "google", "facebook", "github"])
        email = rng.choice([None, None, "", "a@x.test", "B@x.test", "bob@x.test", "ann@x.test", "c@x.test"])
        out.append((c, prov, rng.choice(["g-ann", "f-bob", "i1", "i2", "i3", "i4"]), email, rng.choice(["Ann", "New  One", None])))
    return out


def simulate(LOGINS):
    users = {u["id"]: dict(u) for u in USERS}
    out, rejects, created = {}, {}, []
    for cmd, prov, pid, email, name in LOGINS:
        col = {"google": "google_id", "facebook": "facebook_id"}.get(prov)
        if col is None:
            rejects[cmd] = "unknown_provider"
            continue
        hit = [u for u in users.values() if u.get(col) == pid]
        if hit:
            out[cmd] = hit[0]["id"]
            continue
        if email:
            hit = [u for u in users.values() if u["email"].lower() == email.lower()]
            if hit:
                hit[0][col], hit[0]["social_provider"] = pid, prov
                out[cmd] = hit[0]["id"]
                continue
        uid = f"new{cmd}"
        users[uid] = {"id": uid, "email": email or f"{prov}_{pid}@noemail.local", col: pid, "social_provider": prov}
        created.append(uid)
        out[cmd] = uid
    return out, rejects, users, created


@pytest.mark.parametrize("LOGINS", [LOGINS, random_logins(1), random_logins(2)], ids=["written", "random1", "random2"])
def test_resolve_identities_matches_simulation(spark, LOGINS):
    m = bundle(spark, users=USERS)
    cmds = spark.createDataFrame([(c, c, p, i, e, n, None) for c, p, i, e, n in LOGINS],
                                 "cmd_id long, seq long, provider string, provider_id string, email string, "
                                 "name string, avatar_url string")
    res = resolve_identities(m, cmds, "2024-02-01 00:00:00")
    want_out, want_rej, want_users, created = simulate(LOGINS)
    got = {r.cmd_id: r.user_id for r in res.output("resolved").collect()}
    # created ids differ in form; map them by the command that created them
    new_ids = {got[int(u[3:])]: u for u in created}
    assert {c: new_ids.get(u, u) for c, u in got.items()} == want_out
    assert {r.cmd_id: r.reason for r in res.rejects.collect()} == want_rej
    users = {new_ids.get(r.id, r.id): r for r in res.tables["users"].collect()}
    assert set(users) == set(want_users)
    for uid, u in want_users.items():
        for col in ("google_id", "facebook_id", "social_provider"):
            assert getattr(users[uid], col) == u.get(col), (uid, col)
        assert users[uid].email == u["email"]
    for col in ("google_id", "facebook_id"):  # the unique indexes hold
        held = [getattr(u, col) for u in users.values() if getattr(u, col) is not None]
        assert len(held) == len(set(held))
    if len(LOGINS) != 7:
        return
    names = {r.user_id: r.username for r in res.tables["creator_profiles"].collect()}
    assert names[[k for k, v in new_ids.items() if v == "new3"][0]].startswith("new_person_")


def test_profile_names_match_a_simulation(spark):
    from souk.plans.catalog_rows import update_own_profile

    rng = random.Random(5)
    held = {f"c{i}": f"name{i}" for i in range(4)}
    users = [{"id": f"u{i}", "name": "N", "email": f"{i}@x.test", "role": "creator", "created_at": ts(i)} for i in range(4)]
    m = bundle(spark, users=users, creator_profiles=[{"id": p, "user_id": "u" + p[1:], "username": n} for p, n in held.items()])
    cmds = [(c, c, f"u{rng.randrange(5)}", rng.choice(["name0", "Name1", "name2", "fresh_name", "Fresh_Name", "other", None])) for c in range(1, 45)]
    want, now = {}, {p: n.lower() for p, n in held.items()}
    last = dict(held)
    for c, _, actor, name in cmds:
        p = "c" + actor[1:]
        if p not in now:
            want[c] = "profile_not_found"
        elif name is None:
            want[c] = "not_null"
        elif any(q != p and n == name.lower() for q, n in now.items()):
            want[c] = "username_taken"
        else:
            now[p], last[p] = name.lower(), name
    df = spark.createDataFrame([(c, s, a, n, None, None, None, None) for c, s, a, n in cmds],
                               "cmd_id long, seq long, actor_user_id string, username string, bio string, category string, city string, country string")
    res = update_own_profile(m, df)
    assert {r.cmd_id: r.reason for r in res.rejects.collect()} == want
    assert {r.id: r.username for r in res.tables["creator_profiles"].collect()} == last
