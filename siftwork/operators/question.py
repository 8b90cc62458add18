"""Selection for questions: sentences of the best files in shares of a budget, whole files in order, and log-determinant choice without a question."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.routing import sentence_terms
from ..sources.shared import written
from .channel import fill
from .retrieval import bm25_many

# --- fixed values: BM25's saturation and length, files for a question, least share, weight of relevance, least sentence ---
K1, B, FILES, FLOOR, RELEVANCE, LEAST = 1.5, 0.75, 12, 256, 0.7, 20
# --- fixed values: dimensions of concepts, strength of the prior, worth of stale fragments, least gain ---
DIMENSIONS, PRIOR, STALE, GAIN = 64, 1e-2, 0.1, 1e-6


def file_scores(files: DataFrame, questions: DataFrame, key: str, text: str, item: str, question: str, parts: bool = False) -> DataFrame:
    """Rows (item, key, score): BM25 of every file for every question, over identifiers and their parts; to nine places."""
    scores = bm25_many(files, questions, key, text, item, question, K1, B, terms=sentence_terms, coverage=0.0, parts=parts)
    return scores.select(item, key, F.round("score", 9).alias("score")).where("score > 0")


def shares(scores: DataFrame, budget: int, item: str, key: str, files: int = FILES) -> DataFrame:
    """Rows (item, key, score, place, share): each question's best files, and what of the budget each may use, in proportion to its score and the floor at least.

    Ties go to the greater key. With floors the shares may be more than the budget in all: they are taken up in
    order, and what is left bounds each.
    """
    by = Window.partitionBy(item)
    best = scores.withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), F.desc(key)))).where(F.col("place") <= files)
    part = F.floor(F.lit(budget) * (F.col("score") / F.sum("score").over(by.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).cast("long")
    return best.withColumn("share", F.greatest(part, F.lit(FLOOR).cast("long")))


def sentences(text: Column) -> Column:
    """Sentences of twenty characters or more: cut behind full stops, and at blank lines, lines that end in ; and closing braces."""
    cut = F.split(text, r"(?<=[.!?])\s+|(?<=\n\n)|(?<=;\n)|(?<=\}\n)")
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) >= LEAST)


def sentence_relevance(rows: DataFrame, questions: DataFrame, item: str, key: str, question: str) -> DataFrame:
    """rows (item, key, at, terms) with relevance: BM25 of each sentence for its question, in the corpus of the file's sentences.

    Everything is a join or a sum by (item, key): a file's sentences are never in one place.
    """
    asked = questions.select(F.col(item).alias("_i"), F.explode(F.array_distinct(sentence_terms(F.col(question)))).alias("term")).distinct()
    stats = rows.groupBy(item, key).agg(F.count("*").alias("n"), F.greatest(F.avg(F.size("terms")), F.lit(1.0)).alias("avg"))
    tf = rows.select(item, key, "at", F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy(item, key, "at", "len", "term").agg(F.count("*").alias("tf"))
    tf = tf.join(asked, F.col(item).eqNullSafe(F.col("_i")) & (tf["term"] == asked["term"])).select(item, key, "at", "len", tf["term"], "tf")
    df = tf.groupBy(item, key, "term").agg(F.count("*").alias("df"))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * (1.0 - B + B * F.col("len") / F.col("avg")))
    found = tf.join(df, [item, key, "term"]).join(stats, [item, key]).groupBy(item, key, "at").agg(F.round(F.sum(part), 9).alias("relevance"))
    return rows.join(found, [item, key, "at"])


def _spread(relevance: np.ndarray, cost: np.ndarray, sets: list[set], budget: int) -> list[int]:
    """Places picked by relevance less likeness to those picked, until the budget is full; ties go to the first."""
    picked, used, near = [], 0, np.zeros(len(relevance))
    open_ = relevance > 0
    while open_.any() and used < budget:
        score = RELEVANCE * relevance - (1 - RELEVANCE) * near if picked else relevance
        k = int(np.where(open_, np.round(score, 9), -np.inf).argmax())
        open_[k] = False
        if used + cost[k] <= budget:
            picked.append(k)
            used += int(cost[k])
            near = np.maximum(near, [len(s & sets[k]) / len(s | sets[k]) if s and sets[k] else 0.0 for s in sets])
    return picked


def compressed(files: DataFrame, questions: DataFrame, budget: int, key: str = "doc_id", text: str = "text", item: str = "item_id", question: str = "text") -> DataFrame:
    """Rows (item, place, key, tokens, excerpt): for each question the sentences that answer it, from its best files, within the budget.

    Files are ranked by BM25; the best get shares of the budget; in each file sentences are scored by BM25 among
    its own and picked one after another for relevance and against likeness. What a file's excerpt uses (a quarter
    of its characters) is taken off before the next file. Questions without terms, and files without a fitting
    sentence, give nothing; null texts are no files. What a task holds at once are the sentences, of a question's
    twelve files at most, that share a term with it.
    """
    files = files.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    best = written(shares(file_scores(files, questions, key, text, item, question), budget, item, key), "question-shares")
    chosen = files.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(best.select(key).distinct(), F.col("_k") == F.col(key), "left_semi")
    cut = chosen.select("_k", F.posexplode(sentences(F.col("_t"))).alias("at", "sentence")).withColumn("terms", sentence_terms(F.col("sentence")))
    rows = best.select(item, key, "place", "share").join(cut, F.col(key) == F.col("_k")).drop("_k")
    scored = sentence_relevance(rows, questions, item, key, question)
    kinds = dict(best.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = budget, []
        for place, f in pdf.sort_values(["place", "at"]).groupby("place"):
            if left <= 0:
                break
            size = f["sentence"].str.len().to_numpy()
            picked = _spread(f["relevance"].to_numpy(float), np.maximum(1, size // 4), [set(t) for t in f["terms"]], min(int(f["share"].iloc[0]), left))
            if picked:
                excerpt = "\n".join(f["sentence"].iloc[sorted(picked)])
                tokens = max(1, len(excerpt) // 4)
                left -= tokens
                out.append((f[item].iloc[0], place, f[key].iloc[0], tokens, excerpt))
        return pd.DataFrame(out, columns=[item, "place", key, "tokens", "excerpt"])

    return scored.groupBy(item).applyInPandas(run, f"{item} {kinds[item]}, place int, {key} {kinds[key]}, tokens long, excerpt string")


def is_stale(text: Column) -> Column:
    return text.contains("\nstatus: stale") | text.startswith("status: stale")


def whole_files(fragments: DataFrame, questions: DataFrame, budget: int, file: str, key: str, text: str, tokens: str, item: str = "item_id", question: str = "text") -> DataFrame:
    """Rows (item, file, key, tokens, place): files by descending BM25, all their fragments in order as they fit the budget, stale ones of a file last.

    A file's terms are those of its fragments, whose counts are added up. Ties go to the greater file. No file's or question's rows are held in one task: first fit goes round by round.
    """
    scores = written(file_scores(fragments, questions, file, text, item, question, parts=True), "question-files")
    rows = scores.join(fragments.select(file, key, tokens, is_stale(F.col(text)).alias("_stale")), file)
    rows = rows.withColumn("_key", F.struct(file, key))
    room = scores.select(item).distinct().withColumn("room", F.lit(budget))
    taken = fill(rows.select(item, "_key", tokens, "score", "_stale"), room, item, "_key", [F.desc("score"), F.desc(F.col(f"_key.{file}")), F.asc("_stale"), F.asc(f"_key.{key}")], tokens)
    return taken.select(item, f"_key.{file}", f"_key.{key}", tokens, "place")


@pandas_udf(ArrayType(DoubleType()))
def concepts(terms: pd.Series) -> pd.Series:
    """Signed feature hashing of different terms to an array of unit length: the 32-bit start of a term's MD5 gives its place and its sign."""
    out = []
    for row in terms:
        marks = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in set(() if row is None else row)], np.int64)
        v = np.bincount(marks % DIMENSIONS, np.where(marks >> 31, 1.0, -1.0), DIMENSIONS)
        norm = np.linalg.norm(v)
        out.append((v / norm if norm > 1e-12 else v).tolist())
    return pd.Series(out)


def _gains(vectors: np.ndarray, tau: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    return np.log1p(tau * np.maximum(np.einsum("ij,jk,ik->i", vectors, inverse, vectors), 0.0))


def _worth(gains: np.ndarray, tokens: np.ndarray, criterion: str) -> np.ndarray:
    return np.round(gains / np.maximum(tokens, 1) if criterion == "density" else gains, 12)


def log_det(rows: DataFrame, budget: int, group: str, key: str, criterion: str = "density", tokens: str = "tokens", tau: str = "tau", vector: str = "vector", keep: int = 2000, block: int = 20_000) -> DataFrame:
    """Rows (group, key, place, gain): greedy maximum of the log-determinant of prior plus tau v v^T, for every group at once.

    Each pick is of the greatest gain for its tokens (density), of the greatest gain (gain), or only the first
    of those (singleton), among what fits the rest of the budget, until no gain is left; ties go to the smaller
    key. Rows without tau or tokens don't count.

    A group may be of any size. A pass scores all open rows in blocks, and brings the keep best of each group,
    with the best score among the others, to one task. As gains only shrink when more is picked, the task may go
    on picking for as long as its best is no worse than that bound, and renews the inverse by rank one; then the
    next pass scores anew what is left. Every pass picks at least one row in each group that still has one.

    Only groups that need another pass hand on their inverse (32 KB, null for that of the prior alone), and those
    are never broadcast: in Parquet, equal ones are so small that a join would take them for a small table.
    """
    kinds = dict(rows.dtypes)
    g, k = f"{group} {kinds[group]}", f"{key} {kinds[key]}"
    open_ = rows.select(group, key, F.col(tokens).cast("long").alias("_t"), F.col(tau).cast("double").alias("_tau"), F.col(vector).alias("_v")).where((F.col("_tau") > 0) & (F.col("_t") > 0) & (F.col("_t") <= budget))
    sizes = written(open_.groupBy(group).agg(F.count("*").alias("_n")), "question-sizes")
    open_ = open_.join(sizes, group).withColumn("_b", F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / block))).drop("_n")
    state = written(sizes.select(group, F.lit(None).cast("binary").alias("_m"), F.lit(budget).cast("long").alias("_left"), F.lit(0).alias("_done")), "question-state")
    limit = 1 if criterion == "singleton" else None

    def inverse_of(state: pd.DataFrame) -> np.ndarray:
        m = state["_m"].iloc[0]
        return np.eye(DIMENSIONS) / PRIOR if m is None else np.frombuffer(m).reshape(DIMENSIONS, DIMENSIONS).copy()

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[group, key, "_t", "_tau", "_v", "_s"])
        left = left[left["_t"] <= right["_left"].iloc[0]]
        inverse = inverse_of(right)
        gains = _gains(np.stack(left["_v"]), left["_tau"].to_numpy(float), inverse) if len(left) else np.zeros(0)
        out = left.assign(_s=_worth(gains, left["_t"].to_numpy(), criterion), _gain=gains)
        return out[out["_gain"] >= GAIN][[group, key, "_t", "_tau", "_v", "_s"]]

    def pick(best: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        names = [group, key, "place", "gain", "_m", "_left", "_done"]
        if best.empty or at.empty:
            return pd.DataFrame(columns=names)
        best = best.sort_values(["_s", key], ascending=[False, True])
        bound = best["_s"].iloc[keep] if len(best) > keep else -np.inf
        best = best.iloc[:keep].sort_values(key).reset_index(drop=True)
        inverse, left, done = inverse_of(at), int(at["_left"].iloc[0]), int(at["_done"].iloc[0])
        v, t, w = np.stack(best["_v"]), best["_t"].to_numpy(np.int64), best["_tau"].to_numpy(float)
        rest, out = np.ones(len(best), bool), []
        while limit is None or done < limit:
            fits = rest & (t <= left)
            if not fits.any():
                break
            gains = _gains(v, w, inverse)
            worth = np.where(fits & (gains >= GAIN), _worth(gains, t, criterion), -np.inf)
            i = int(worth.argmax())
            if worth[i] == -np.inf or (out and worth[i] <= bound):  # another may be as good: score all anew
                break
            out.append((best[key].iloc[i], done, float(gains[i])))
            rest[i], left, done = False, left - int(t[i]), done + 1
            u = inverse @ v[i]
            inverse -= w[i] / (1 + w[i] * float(v[i] @ u)) * np.outer(u, u)
        rows_ = [(best[group].iloc[0], i, p, x, None, None, None) for i, p, x in out]
        if bound > -np.inf and left > 0 and (limit is None or done < limit):  # something is behind the bound
            rows_.append((best[group].iloc[0], None, None, None, inverse.tobytes(), left, done))
        return pd.DataFrame(rows_, columns=names).astype({key: "object"})

    taken: list[DataFrame] = []
    while True:
        spots = open_.select(F.col(group).alias("_of"), F.col("_b").alias("_at")).distinct()
        each = state.hint("merge").join(spots, F.col(group).eqNullSafe(F.col("_of"))).select("_of", "_at", "_m", "_left")  # the state of a group for each of its blocks
        scored = open_.groupBy(group, "_b").cogroup(each.groupBy("_of", "_at")).applyInPandas(score, f"{g}, {k}, _t long, _tau double, _v array<double>, _s double")
        best = scored.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_s"), F.asc(key)))).where(F.col("_r") <= keep + 1).drop("_r")
        got = written(best.groupBy(group).cogroup(state.groupBy(group)).applyInPandas(pick, f"{g}, {k}, place int, gain double, _m binary, _left long, _done int"), "question-picked")
        picks = got.where(F.col("place").isNotNull()).select(group, key, "place", "gain")
        taken.append(picks)
        state = got.where(F.col("place").isNull()).select(group, "_m", "_left", "_done")
        if state.isEmpty():
            return reduce(DataFrame.unionByName, taken)
        open_ = written(open_.join(state.select(group), group, "left_semi").join(picks.select(group, key), [group, key], "left_anti"), "question-open")


def best_of(choices: dict[str, DataFrame], group: str) -> DataFrame:
    """The choice whose gains are the most in all, for each group; of equal ones (to nine places) the first named. Rows (group, key, place, criterion)."""
    every = reduce(DataFrame.unionByName, [c.withColumn("criterion", F.lit(n)).withColumn("_o", F.lit(-o)) for o, (n, c) in enumerate(choices.items())])
    totals = every.groupBy(group, "criterion", "_o").agg(F.round(F.sum("gain"), 9).alias("_g"))
    win = totals.groupBy(group).agg(F.max_by("criterion", F.struct("_g", "_o")).alias("criterion"))
    return every.join(win, [group, "criterion"]).drop("_o", "gain")


def without_question(fragments: DataFrame, budget: int, group: str, key: str, text: str, tokens: str, keep: int = 2000, block: int = 20_000) -> DataFrame:
    """Rows (group, key, place, criterion): a diverse choice of every group's fragments, the best of three greedy ones. A fragment's concepts are all terms of its text."""
    rows = fragments.select(group, key, F.col(tokens).alias("tokens"), F.when(is_stale(F.col(text)), STALE).otherwise(1.0).alias("tau"), concepts(F.array_distinct(sentence_terms(F.col(text)))).alias("vector"))
    rows = written(rows, "question-concepts")  # three choices read it
    return best_of({c: log_det(rows, budget, group, key, c, keep=keep, block=block) for c in ("density", "gain", "singleton")}, group)
