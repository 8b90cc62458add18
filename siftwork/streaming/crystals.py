"""Families of questions that keep being answered well, found as outcomes come in: state by key, with windows, bounds, cooldown and decay."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# --- fixed values: outcomes for a bound, kept of a family, chance to be wrong, least gain, likeness of questions and of fragments, families, wait ---
SAMPLES, WINDOW, DELTA, GAIN, LIKE_QUESTION, LIKE_FRAGMENTS, FAMILIES, WAIT = 5, 16, 0.05, 0.10, 0.25, 0.5, 256, 32
TOKENS, OUTSIDE, RECIPE = 32, 5, 8
STOP_WORDS = frozenset(
    "a an the of to in for on and or is are was were be do does this that it its with from by as at i we you my our your they them he she his her but not no so if then than when while please needs need needed have has had can".split()
)
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # else a query with timers runs batch after batch and never ends
}
FAMILY = "tokens string, fragments string, rewards string, recipes string, n long, total double, fired long, at long"
EVENTS = "family string, at long, n long, mean double, bound double, baseline double, effect double, recipe string"


def question_tokens(text: str) -> set[str]:
    """Words of over two characters in lower case, marks taken out, without those that carry no content."""
    words = ("".join(c for c in w if c.isalnum() or c in "_-") for w in (text or "").lower().split())
    return {w for w in words if len(w) > 2 and w not in STOP_WORDS}


def alike(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def bound(mean: float, n: int, delta: float = DELTA) -> float:
    """Hoeffding's lower bound of a mean of n numbers from 0 to 1, wrong with a chance of delta."""
    return mean - math.sqrt(math.log(1.0 / max(delta, 1e-9)) / (2.0 * n)) if n > 0 else 0.0


class Families:
    """The families of one key, as a mapping of small records, and the sums of all outcomes. A record has what FAMILY names."""

    def __init__(self, records: dict[str, dict], seen: int = 0, total: float = 0.0, born: int = 0):
        self.records, self.seen, self.total, self.born, self.touched, self.gone = records, seen, total, born, set(), set()

    def observe(self, question: str, fragments: str, reward: float, baseline: float, at: int) -> dict | None:
        """Takes an outcome in; an event if its family is now surely better than all others by the least gain.

        A question joins the family that is likest by words and fragments together, if both are like enough, else it
        begins one; where there are too many, the one that was met longest ago goes. Of its tokens a family keeps
        the first 32 in order. Empty questions are passed over.
        """
        if not question:
            return None
        reward, baseline = min(1.0, max(0.0, reward)), min(1.0, max(0.0, baseline))
        tokens, pieces = question_tokens(question), set(filter(None, (fragments or "").split(",")))
        self.seen, self.total = self.seen + 1, self.total + reward
        best, name = -1.0, None
        for other in sorted(self.records):
            r = self.records[other]
            a, b = alike(set(r["tokens"].split()), tokens), alike(set(filter(None, r["fragments"].split(","))), pieces)
            if a >= LIKE_QUESTION and b >= LIKE_FRAGMENTS and a + b > best:
                best, name = a + b, other
        if name is None:
            if len(self.records) >= FAMILIES:
                oldest = min(self.records, key=lambda k: (self.records[k]["at"], k))
                del self.records[oldest]
                self.touched.discard(oldest)
                self.gone.add(oldest)
            name, self.born = f"f{self.born:06d}", self.born + 1
            self.records[name] = {"tokens": "", "fragments": "", "rewards": "", "recipes": "", "n": 0, "total": 0.0, "fired": -1, "at": at}
        r = self.records[name]
        r["tokens"] = " ".join(sorted(set(r["tokens"].split()) | tokens)[:TOKENS])
        r["fragments"] = ",".join(sorted(set(filter(None, r["fragments"].split(","))) | pieces))
        rewards = [*filter(None, r["rewards"].split(",")), repr(reward)][-WINDOW:]
        recipes = ([*r["recipes"].split("|"), ",".join(sorted(pieces))] if r["n"] else [",".join(sorted(pieces))])[-WINDOW:]
        r |= {"rewards": ",".join(rewards), "recipes": "|".join(recipes), "n": r["n"] + 1, "total": r["total"] + reward, "at": at}
        self.touched.add(name)
        return self._event(name, r, [float(x) for x in rewards], recipes, baseline, at)

    def _event(self, name: str, r: dict, rewards: list[float], recipes: list[str], baseline: float, at: int) -> dict | None:
        n = len(rewards)
        if n < SAMPLES or (r["fired"] >= 0 and r["n"] - r["fired"] < WAIT):
            return None
        mean = sum(rewards) / n
        low = bound(mean, n)
        others = self.seen - r["n"]
        outside = (self.total - r["total"]) / others if others >= OUTSIDE else baseline
        if low <= outside + GAIN:
            return None
        r["fired"] = r["n"]
        counts: dict[str, int] = {}
        for recipe in recipes:
            for piece in filter(None, recipe.split(",")):
                counts[piece] = counts.get(piece, 0) + 1
        top = sorted(counts, key=lambda p: (-counts[p], p))[:RECIPE]
        return {"family": name, "at": at, "n": n, "mean": mean, "bound": low, "baseline": outside, "effect": low - outside, "recipe": ",".join(top)}


def _crystallizer(by: str, kind: str, order: str, idle_ms: int | None):
    names = [f.split()[0] for f in FAMILY.split(", ")]

    class Crystallizer(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.totals = handle.getValueState("totals", "seen long, total double, born long")
            self.families = handle.getMapState("families", "name string", FAMILY)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            seen, total, born = self.totals.get() if self.totals.exists() else (0, 0.0, 0)
            known = {k[0]: dict(zip(names, v, strict=True)) for k, v in self.families.iterator()}
            state, out = Families(known, seen, total, born), []
            new = pd.concat(list(rows)).sort_values(order)
            for question, fragments, reward, baseline, at in zip(new["question"], new["fragments"], new["reward"], new["baseline"], new[order], strict=True):
                event = state.observe(question, fragments, float(reward), float(baseline), int(at))
                if event:
                    out.append({by: key[0], **event})
            for name in state.gone:
                if self.families.containsKey((name,)):
                    self.families.removeKey((name,))
            for name in state.touched:
                self.families.updateValue((name,), tuple(state.records[name][n] for n in names))
            self.totals.update((state.seen, state.total, state.born))
            if idle_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle_ms)
            yield pd.DataFrame(out, columns=[by, *[f.split()[0] for f in EVENTS.split(", ")]])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            """A key that nothing was heard of for so long is forgotten."""
            self.families.clear()
            self.totals.clear()
            yield pd.DataFrame(columns=[by, *[f.split()[0] for f in EVENTS.split(", ")]])

        def close(self) -> None:
            pass

    return Crystallizer(), f"{by} {kind}, {EVENTS}"


def crystallize(outcomes: DataFrame, key: str, order: str, idle_ms: int | None = None) -> DataFrame:
    """A stream of events (key, family, at, n, mean, bound, baseline, effect, recipe) of a stream of outcomes.

    outcomes has key, order, question, fragments (names with commas between), reward and baseline. An event says
    that a family of questions is answered better than all else of its key: Hoeffding's bound of the mean of its
    last 16 rewards is over the mean of the others by a tenth; then it waits for 32 more of its own. State is 256
    families a key at most, each in one entry of a map, and three totals. Within a batch outcomes count in order.
    With idle_ms a timer forgets keys that are silent for so long, with the next batch. The session needs the
    settings of STATE.
    """
    processor, schema = _crystallizer(key, dict(outcomes.dtypes)[key], order, idle_ms)
    rows = outcomes.select(key, order, "question", "fragments", "reward", "baseline")
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime")
