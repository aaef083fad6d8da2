"""Request limits of several windows at once, as a service refuses by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Requests of a client in a minute and in a day.
LIMITS = ((10, "1 minute"), (200, "1 day"))


def refusals(requests: DataFrame, client: str, ts: str, order: tuple[str, ...] = (), limits: tuple[tuple[int, str], ...] = LIMITS) -> DataFrame:
    """The requests with ``refused``: whether any window of the client, from whole minutes or days on, was full before.

    Every request counts in every window, refused or not. ``order`` parts requests of one time.
    """
    out, full = requests, []
    for k, (limit, every) in enumerate(limits):
        out = out.withColumn(f"_w{k}", F.window(F.col(ts).cast("timestamp"), every)["start"])
        out = out.withColumn(f"_n{k}", F.row_number().over(Window.partitionBy(client, f"_w{k}").orderBy(ts, *order)))
        full.append(F.col(f"_n{k}") > limit)
    some = full[0]
    for f in full[1:]:
        some = some | f
    return out.withColumn("refused", some).drop(*[f"_{x}{k}" for k in range(len(limits)) for x in "wn"])
