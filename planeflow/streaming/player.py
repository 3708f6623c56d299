"""Playback as a stream: packets against a fixed tick; late ones are shown late and counted, never dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .. import constants as K

STATE = "shown long, late long, worst long, free double"
OUT = "stream_id string, shown long, late long, worst long"


def _advance(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    shown, late, worst, free = state.get if state.exists else (0, 0, 0, 0.0)
    for part in parts:
        for n, cycles in part.sort_values("n")[["n", "cycles"]].itertuples(index=False):
            due = 2.0 * n * K.CYCLES_PER_VBL
            if cycles > 0 and n > 0:  # a repeat needs no work, and frame 0 is drawn before the clock starts
                behind = max(0, -int(-(free + cycles - due) // K.CYCLES_PER_VBL))
                late, worst = late + (behind > 0), max(worst, behind)
                free = due + behind * K.CYCLES_PER_VBL
            shown += 1
    state.update((shown, late, worst, free))
    yield pd.DataFrame({"stream_id": [key[0]], "shown": [shown], "late": [late], "worst": [worst]})


def lateness(packets: DataFrame) -> DataFrame:
    """A running count for each stream of (stream_id, n, cycles); packets of one trigger are taken in order of n."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return packets.groupBy("stream_id").applyInPandasWithState(_advance, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
