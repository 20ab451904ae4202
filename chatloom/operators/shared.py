"""States that several windows edit: merged whole, compared, taken over from elsewhere.

A state is rows (part, id, value), one for each part and id: entities of several kinds, the set `dismissed` (no values), the
map `positions`, and `setting`, whose rows are single values by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PEOPLE, DISMISSED, POSITIONS, SETTING = "people", "dismissed", "positions", "setting"
PARTS = ("tasks", "places", PEOPLE, "checkins", "events", "candidates", DISMISSED, POSITIONS, SETTING)
MODEL_VERSION, DISMISSAL_VERSION = "people_model_version", "people_dismissal_version"


def projected(state: DataFrame) -> DataFrame:
    """What of a state is shared."""
    return state.where(F.col("part").isin(*PARTS)).select("part", "id", "value")


def merged(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """part, id, value: the local side's changes since the base on top of the remote state. Of entities a deletion on either side
    wins; of the map a local change wins; of settings the local value if it changed, the remote one else.

    All parts go through the same two joins on (part, id)."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("part", "id", F.col("value").alias(f"{name}_value"), F.lit(True).alias(f"in_{name}"))

    every = side(base, "base").join(side(local, "local"), ["part", "id"], "full").join(side(remote, "remote"), ["part", "id"], "full")
    b, l, r = (F.coalesce(F.col(f"in_{n}"), F.lit(False)) for n in ("base", "local", "remote"))
    changed = (b != l) | ~F.col("base_value").eqNullSafe(F.col("local_value"))
    mine, dropped = l & changed, b & ~l
    part = F.col("part")
    stays = (
        F.when(part == SETTING, F.when(changed, l).otherwise(r))
        .when(part == DISMISSED, (r & ~dropped) | (l & ~b))
        .when(part == POSITIONS, ~dropped & (mine | r))
        .otherwise(~dropped & ~(b & ~r) & (mine | r))
    )
    return every.where(stays).select("part", "id", F.when(mine, F.col("local_value")).otherwise(F.col("remote_value")).alias("value"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """part, added, removed, changed: how many rows of a part left has on top of right, lacks and has otherwise; only parts that differ."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("part", "id", F.col("value").alias(f"{name}_value"), F.lit(True).alias(f"in_{name}"))

    both = side(left, "left").join(side(right, "right"), ["part", "id"], "full")
    added, removed = F.col("in_right").isNull(), F.col("in_left").isNull()
    changed = ~added & ~removed & ~F.col("left_value").eqNullSafe(F.col("right_value"))
    out = both.groupBy("part").agg(*[F.count_if(c).alias(n) for n, c in (("added", added), ("removed", removed), ("changed", changed))])
    return out.where("added + removed + changed > 0")


def _settings(state: DataFrame) -> dict[str, str]:
    """The versions of a state: two rows at most."""
    return {r["id"]: r["value"] for r in state.where((F.col("part") == SETTING) & F.col("id").isin(MODEL_VERSION, DISMISSAL_VERSION)).collect()}


def hydrated(current: DataFrame, base: DataFrame, remote: DataFrame, model_version: str, dismissal_version: str) -> tuple[DataFrame, DataFrame | None]:
    """The state to go on with, and what must be written back (None: nothing, the remote state has it all).

    People of another model version go; dismissals of the current dismissal version stay where the merged ones are of another;
    what is not shared stays as it is."""
    settings = F.col("part") == SETTING
    versions = _settings(merged(base.where(settings), current.where(settings), remote.where(settings)))
    own = _settings(current).get(DISMISSAL_VERSION)
    keep_people = versions.get(MODEL_VERSION) == model_version
    keep_dismissals = own == dismissal_version and versions.get(DISMISSAL_VERSION) != dismissal_version
    whole = merged(base, projected(current), remote)
    dismissals = (F.col("part") == DISMISSED) | (settings & (F.col("id") == DISMISSAL_VERSION))
    state = whole if not keep_dismissals else whole.where(~dismissals).unionByName(projected(current).where(dismissals))
    if not keep_people:
        state = state.where(F.col("part") != PEOPLE)
    version = state.sparkSession.range(1).select(F.lit(SETTING).alias("part"), F.lit(MODEL_VERSION).alias("id"), F.lit(model_version).alias("value"))
    state = state.where(~(settings & (F.col("id") == MODEL_VERSION))).unionByName(version)
    state = state.unionByName(current.where(~F.col("part").isin(*PARTS)).select("part", "id", "value"))
    return state, None if keep_people and differences(whole, remote).isEmpty() else whole
