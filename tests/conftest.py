import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnloom.runtime import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    session.conf.set("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled", "false")
    return session


DIALOGUE = (
    "rec_id bigint, dial_id string, domains array<string>, source string, split string, collected_at timestamp, loaded_at timestamp, turns array<struct<turn_id:int,system:string,user:string,"
    "state:struct<active_intent:string,slot_values:map<string,string>>,taklabels:array<struct<slot:string,`label-1`:string,`label-2`:string,prev_val:string,curr_val:string>>,tasklabel:string,candidates:array<string>>>"
)


@pytest.fixture(scope="session")
def dialogues(spark):
    """rows -> a dialogue table; a row is (rec_id, {columns}), turns as dicts with system, user, state, events."""

    def turn(i, t):
        if t is None:
            return None
        events = t.get("events", [])
        return (t.get("turn_id", i), t.get("system"), t.get("user"), ("x", t["state"]) if "state" in t else None, None if events is None else [(e.get("slot"), e.get("label1"), e.get("label2"), e.get("prev"), e.get("curr")) for e in events], t.get("tasklabel"), t.get("candidates"))

    def make(rows, extra=()):
        out = [(r, c.get("dial_id"), c.get("domains"), c.get("source"), c.get("split"), None, None, None if c.get("turns") is None else [turn(i, t) for i, t in enumerate(c["turns"])]) for r, c in rows]
        df = spark.createDataFrame(out, DIALOGUE)
        from pyspark.sql import functions as F

        return df.withColumns({name: F.lit("clash") for name in extra})

    return make
