"""Lineups of every slate: branch and bound over prefixes, and an exact diversified choice in batches.

A slate's pool is one row, some dozens of players. Sets are found by prefixes of two players, dealt over tasks where
there are fewer slates than tasks: a prefix is passed over when its bound, the best that its rest could score with
whole salaries replaced by a price for each dollar, is below the k-th best set that the task has found. The best
``at_once`` allowed sets of each slate are then chosen from in order; as limits only ever tighten, no set outside them
can come before those inside, so the choice goes on until they run out, and the next round looks for the best sets
that are still allowed. Slates that are complete, or have no more sets, take no part in further rounds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeframe.functions import domain as D
from strikeframe.sources.scratch import discard, written

#: Up to so many players the sets that may follow each are kept; sums that sort out sets may be off by so much.
MOST_KEPT, SLACK = 40, 1e-6
#: So many slates' sets are held as Python objects at a time.
SLATES_AT_ONCE = 16

SETS = "array<struct<score: double, salary: long, members: array<int>, risk: double>>"


@dataclass(frozen=True)
class Rules:
    """The limits of a lineup, unless others are given."""

    size: int = 6
    cap: int = 50_000
    floor: int = 47_000
    max_avg_risk: float = 0.42
    one_per_fight: bool = True


@lru_cache(maxsize=64)
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int16).reshape(-1, k)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few slates, so that memory doesn't grow with the rows of a batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLATES_AT_ONCE):
            yield batch.slice(start, SLATES_AT_ONCE)


class Pool:
    """A slate's players in the order of their ids, and the best sets of them."""

    def __init__(self, players: list[dict], rules: Rules):
        self.rules = rules
        self.salary = np.array([p["salary"] for p in players], np.int64)
        self.score = np.array([p["score"] for p in players], float)
        self.risk = np.array([p["risk"] for p in players], float)
        fights: dict[str, int] = {}
        self.fight = np.array([fights.setdefault(p["fight_id"], len(fights)) for p in players], np.int64)
        rate = self.score.sum() / max(1, self.salary.sum())
        self.prices = np.array([0.0, 0.25, 0.5, 1.0, 2.0]) * max(0.0, rate)
        self.known: dict[int, tuple[np.ndarray, ...]] = {}

    def bounds(self) -> np.ndarray:
        """What no set that begins with players i < j exceeds; minus infinity for other pairs."""
        n, left = len(self.salary), self.rules.size - 2
        out = np.full((n, n), -np.inf)
        worth = self.score[:, None] - self.prices * self.salary[:, None]
        for j in range(1, n - left):
            rest = np.sort(worth[j + 1 :], 0)[::-1][:left].sum(0) if left else np.zeros(len(self.prices))
            first = worth[:j] + worth[j] + rest + self.prices * self.rules.cap
            out[:j, j] = first.min(1) if left else self.score[:j] + self.score[j]
        return out

    def rest(self, j: int) -> tuple[np.ndarray, ...]:
        """The sets that may follow player j, with their salaries, scores and risks."""
        if j not in self.known:
            picks = _choices(len(self.salary) - j - 1, self.rules.size - 2).astype(np.int64) + j + 1
            found = (picks, self.salary[picks].sum(1), self.score[picks].sum(1), self.risk[picks].sum(1))
            if len(self.salary) > MOST_KEPT:
                return found
            self.known[j] = found
        return self.known[j]

    def sets(self, i: int, j: int, least: float, full: np.ndarray, taken: np.ndarray, most_shared: int) -> tuple[np.ndarray, ...]:
        """Members, salary, risk and score of the allowed sets that begin with i and j and may reach the least score.

        Sums run from the first member on; those that sort out sets beforehand do not, and leave some slack.
        """
        rules = self.rules
        picks, salary, score, risk = self.rest(j)
        paid = self.salary[i] + self.salary[j]
        may = (salary >= rules.floor - paid) & (salary <= rules.cap - paid) & (risk <= rules.size * rules.max_avg_risk - self.risk[i] - self.risk[j] + SLACK)
        may &= score >= least - self.score[i] - self.score[j] - SLACK
        at = np.flatnonzero(may)
        members = np.hstack([np.broadcast_to([i, j], (len(at), 2)), picks[at]])
        members = members[~full[members].any(1)]
        if rules.one_per_fight and len(members):
            held = np.sort(self.fight[members], 1)
            members = members[(held[:, 1:] != held[:, :-1]).all(1)]
        if len(taken) and len(members):
            within = np.zeros((len(members), len(self.salary)), np.int16)
            np.put_along_axis(within, members, 1, 1)
            members = members[(within @ taken.T <= most_shared).all(1)]
        risks, scores = np.zeros(len(members)), np.zeros(len(members))
        for seat in range(rules.size):
            risks, scores = risks + self.risk[members[:, seat]], scores + self.score[members[:, seat]]
        fits = risks <= rules.size * rules.max_avg_risk
        return members[fits], self.salary[members[fits]].sum(1), risks[fits], scores[fits]

    def best(self, k: int, share: int, shares: int, full: np.ndarray, taken: np.ndarray, most_shared: int) -> list[tuple]:
        """The k best allowed sets of this share's prefixes: higher scores, then salaries, then earlier members first."""
        bounds = self.bounds()
        bounds[full, :] = bounds[:, full] = -np.inf
        firsts, seconds = np.nonzero(np.isfinite(bounds))
        order = np.argsort(-bounds[firsts, seconds], kind="stable")[share::shares]
        found = (np.zeros((0, self.rules.size), np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        least = -np.inf
        for i, j in zip(firsts[order], seconds[order], strict=True):
            if bounds[i, j] < least - SLACK:
                break  # bounds fall from here on
            more = self.sets(i, j, least, full, taken, most_shared)
            if not len(more[3]):
                continue
            every = tuple(np.concatenate(x) for x in zip(found, more, strict=True))
            if len(every[3]) > k:
                least = np.partition(every[3], len(every[3]) - k)[len(every[3]) - k]
                every = tuple(x[every[3] >= least] for x in every)
            found = every
        order = np.lexsort((*found[0].T[::-1], -found[1], -found[3]))[:k]
        return [(float(s), int(m), [int(x) for x in p], float(r)) for p, m, r, s in zip(*(x[order] for x in found), strict=True)]


def chosen(sets: list[tuple], taken: list[list[int]], n: int, size: int, min_unique: int, most_each: int) -> list[tuple]:
    """The sets that are taken in turn: each shares few enough members with all before, and none has a full member."""
    used = Counter(m for t in taken for m in t)
    before = [set(t) for t in taken]
    out = []
    for entry in sets:
        if len(before) == n:
            break
        members = entry[2]
        if any(used[m] >= most_each for m in members) or any(len(b.intersection(members)) > size - min_unique for b in before):
            continue
        out.append(entry)
        before.append(set(members))
        used.update(members)
    return out


def _limits(players: int, taken: list[list[int]], most_each: int) -> tuple[np.ndarray, np.ndarray]:
    within = np.zeros((len(taken), players), np.int16)
    for row, members in enumerate(taken):
        within[row, members] = 1
    return within.sum(0) >= most_each if taken else np.zeros(players, bool), within


def _pools(players: DataFrame, slate: str | None, score: Column) -> DataFrame:
    """A row for each slate with its players in the order of their ids; players without id, fight or salary are left out."""
    key = F.col(slate) if slate else F.lit(0)
    valid = players.where((F.col("salary") > 0) & (F.length("player_id") > 0) & (F.length("fight_id") > 0))
    one = F.struct("player_id", "fight_id", F.col("salary").cast("long").alias("salary"), F.coalesce(F.col("risk").cast("double"), F.lit(0.0)).alias("risk"), score.cast("double").alias("score"))
    return valid.groupBy(key.alias("slate")).agg(F.sort_array(F.collect_list(one)).alias("pool"))


def optimized(
    players: DataFrame, slate: str | None = None, mode: str = "gpp", n: int = 20, ownership_weight: float = 0.0, min_unique: int = 1, max_exposure: float = 0.65, rules: Rules = Rules(), at_once: int = 256
) -> DataFrame:
    """slate, rank, members, salary, risk and score of the best n lineups of each slate (0 if no column names it): each has
    ``min_unique`` members that any other lacks, and no player is in more than ``max_exposure`` of n."""
    spark = players.sparkSession
    most_each = max(1, round(n * max_exposure))
    scratch: list[str] = []
    pools = written(_pools(players, slate, D.player_score(mode, ownership_weight)), "lineups-pools", scratch)
    tasks = spark.sparkContext.defaultParallelism
    shares = max(1, -(-tasks // max(1, pools.count())))
    kind = pools.schema["slate"].dataType

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            out = []
            for row in batch.to_pylist():
                full, taken = _limits(len(row["pool"]), [s["members"] for s in row["taken"]], most_each)
                out.append([dict(zip(("score", "salary", "members", "risk"), s, strict=True)) for s in Pool(row["pool"], rules).best(at_once, row["share"], shares, full, taken, rules.size - min_unique)])
            yield pa.RecordBatch.from_arrays([batch.column("slate"), pa.array(out, sets_type)], names=["slate", "sets"])

    def taken_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            out, open_ = [], []
            for row in batch.to_pylist():
                sets = [(s["score"], s["salary"], s["members"], s["risk"]) for s in row["sets"]]
                old = [(s["score"], s["salary"], s["members"], s["risk"]) for s in row["taken"]]
                new = old + chosen(sets, [s[2] for s in old], n, rules.size, min_unique, most_each)
                out.append([dict(zip(("score", "salary", "members", "risk"), s, strict=True)) for s in new])
                open_.append(len(new) < n and len(sets) == at_once)
            yield pa.RecordBatch.from_arrays([batch.column("slate"), pa.array(out, sets_type), pa.array(open_)], names=["slate", "taken", "open"])

    sets_type = pa.list_(pa.struct([("score", pa.float64()), ("salary", pa.int64()), ("members", pa.list_(pa.int32())), ("risk", pa.float64())]))
    state = pools.select("slate", F.array().cast(SETS).alias("taken"), F.lit(True).alias("open"))
    finished, slate_type = [], kind.simpleString()
    while True:
        active = state.where("open").join(pools, "slate")
        dealt = active.select("slate", "taken", "pool", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")).repartition(4 * tasks, "slate", "share")
        sets = dealt.select("slate", "taken", "pool", "share").mapInArrow(found, f"slate {slate_type}, sets {SETS}")
        order = F.transform("all", lambda s: F.struct((-s["score"]).alias("a"), (-s["salary"]).alias("b"), s["members"].alias("members"), s.alias("s")))
        merged = sets.groupBy("slate").agg(F.flatten(F.collect_list("sets")).alias("all")).select("slate", F.transform(F.slice(F.sort_array(order), 1, at_once), lambda x: x["s"]).alias("sets"))
        state = written(active.select("slate", "taken").join(merged, "slate").mapInArrow(taken_of, f"slate {slate_type}, taken {SETS}, open boolean"), "lineups-state")
        finished.append(state.where("not open").select("slate", "taken"))
        if state.where("open").isEmpty():
            break
    whole = finished[0]
    for more in finished[1:]:
        whole = whole.unionByName(more)
    rows = whole.join(pools, "slate").select("slate", "pool", F.posexplode("taken").alias("place", "s"))
    out = rows.select("slate", (F.col("place") + 1).alias("rank"), F.transform("s.members", lambda m: F.get(F.col("pool"), m)["player_id"]).alias("members"), "s.salary", "s.risk", "s.score")
    out = written(out, "lineups")
    discard(spark, scratch)
    return out


def described(lineups: DataFrame, players: DataFrame, slate: str | None = None) -> DataFrame:
    """Lineups with totals and their players, those with the highest mean first."""
    keyed = players.select(F.col(slate).alias("slate") if slate else F.lit(0).alias("slate"), "player_id", "player_name", "fight_id", "salary", "proj_mean", "proj_floor", "proj_ceiling", "own_proj")
    each = lineups.select("slate", "rank", F.explode("members").alias("player_id")).join(keyed, ["slate", "player_id"])
    first = F.sort_array(F.collect_list(F.struct((-F.col("proj_mean")).alias("o"), "player_id", "player_name", "fight_id", "salary", "proj_mean")))
    totals = [F.sum(c).alias(f"total_{n}") for c, n in (("proj_mean", "mean"), ("proj_floor", "floor"), ("proj_ceiling", "ceiling"), ("own_proj", "ownership"))]
    sums = each.groupBy("slate", "rank").agg(*totals, F.transform(first, lambda p: p.dropFields("o")).alias("players"))
    return lineups.withColumn("avg_risk", F.col("risk") / F.size("members")).drop("members", "risk").join(sums, ["slate", "rank"])


def exposures(lineups: DataFrame) -> DataFrame:
    """How many of a slate's lineups each player is in, and their share."""
    counts = lineups.select("slate", F.explode("members").alias("player_id")).groupBy("slate", "player_id").agg(F.count("*").alias("n"))
    return counts.join(lineups.groupBy("slate").agg(F.count("*").alias("lineups")), "slate").withColumn("exposure", F.col("n") / F.col("lineups"))
