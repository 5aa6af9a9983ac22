"""All oracle bodies, keyed like ``souk.catalog.REGISTRY``."""

from __future__ import annotations

from oracle.checks import SQL as CHECK_SQL
from oracle.jobs import SQL as JOB_SQL
from oracle.joint import SQL as JOINT_SQL
from oracle.jobs2 import SQL as JOB2_SQL
from oracle.queries import SQL
from oracle.streams import SQL as STREAM_SQL
from souk.keyed import KEYED

ORACLES: dict[str, str] = {**SQL, **JOB_SQL, **JOB2_SQL, **JOINT_SQL, **CHECK_SQL, **STREAM_SQL}
# a keyed call answers the rows of the set-wide question that hold its key
ORACLES.update({f"{name}__keyed": f"SELECT * FROM ({ORACLES[name]}) AS keyed_rows WHERE {column} = '{key}'"
                for name, (_, _, column, key) in KEYED.items()})
