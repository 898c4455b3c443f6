"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked to target
marginals of each of the three in turn until all hold. Documents are then
sampled with their cell's calibrated probability, by a hash of their id. Where
the raked weight asks for more than a cell holds, its probability is one and
the raking goes on with the others.

Cells are aggregated by Spark over all documents and every source and language
keeps its own. Up to ``DRIVER_CELLS`` cells are raked on the driver; more stay
in a written table of one row a source, where the same steps are taken: a
source is raked within its row, and only the sums by language and by topic come
to the driver, which holds the languages' names. The topic is the largest of
``TOPICS`` signed random projections of a text's words, the same in every run.

Default targets temper the marginals: a name's share of tokens to the power
``temper``, scaled to sum to one. ``keep`` is the share of all tokens to sample.

Nulls and ties: a null source or language is a name of its own; a null or empty
text has no tokens, belongs to topic 0 and is sampled like its cell. Repeated
ids share their fate. Rows without an id stay in :func:`sample`. All columns are kept. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.idfilter import without_ids
from tessera.llm.shared import forget, forget_since, live, written
from tessera.llm.textarrays import NOT_SPACE, byte_table, chunks, hash_runs, mix, runs

TOPICS = 16
DRIVER_CELLS = 1 << 20   # more cells are raked by Spark, with the same result
ROUNDS_A_TABLE = 8       # rounds of raking between two written tables
AXES = ("source", "lang", "topic")


def topic_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(topic, words) of every text."""
    topic, words = [], []
    for i, j, buf, off in chunks(column):
        s, e, doc = runs(buf, off, NOT_SPACE)
        h = hash_runs(buf, s, e, byte_table(fold_case=True))
        n = np.bincount(doc, minlength=j - i)
        total = np.zeros((j - i, TOPICS))
        signs = mix(h ^ np.uint64(0x70B1C5))
        for t in range(TOPICS):
            total[:, t] = np.bincount(doc, 2.0 * ((signs >> np.uint64(t)) & np.uint64(1)) - 1.0, minlength=j - i)
        topic.append(total.argmax(axis=1)), words.append(n)
    return (np.concatenate(topic), np.concatenate(words)) if topic else (np.zeros(0, int), np.zeros(0, int))


def described(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """(id, source, lang, topic, tokens) of every document."""
    def task(batches):
        for batch in batches:
            topic, words = topic_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(topic.astype(str)),
                                              pa.array(words.astype(np.int64))], names=["id", "source", "lang", "topic", "tokens"])
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0null"))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       name(source_col).alias("source"), name(lang_col).alias("lang")) \
        .mapInArrow(task, "id long, source string, lang string, topic string, tokens long")


def step(p, full, of, have, stuck, goal):
    """Probabilities after one axis is raked; ``of`` is each cell's name, the others are by name."""
    scale = np.where(have > stuck, np.maximum(goal - stuck, 0) / np.maximum(have - stuck, 1e-12), 1.0)
    # a name that asks for less than its full cells hold lowers them too
    lower = np.where(goal < stuck, goal / np.maximum(have, 1e-12), 1.0)
    p = np.where(full, p * lower[of], np.where(goal[of] < stuck[of], p * lower[of], p * scale[of]))
    return np.clip(p, 0.0, 1.0)


def rake(tokens: np.ndarray, names: list[np.ndarray], targets: list[np.ndarray], keep: float, rounds: int = 500) -> np.ndarray:
    """Sampling probability of every cell.

    ``names[a]`` is each cell's index on axis ``a``, ``targets[a]`` the shares of its names.
    """
    total = tokens.sum()
    p = np.full(len(tokens), min(1.0, keep))
    if not total or keep >= 1:
        return np.ones(len(tokens)) if keep >= 1 else p
    for _ in range(rounds):
        before = p.copy()
        for of, want in zip(names, targets):
            full = p >= 1.0
            goal = keep * total * want
            have = np.bincount(of, tokens * p, minlength=len(want))
            stuck = np.bincount(of, tokens * full, minlength=len(want))
            p = step(p, full, of, have, stuck, goal)
        if np.abs(p - before).max() < 1e-9:
            break
    return p


def tempered(tokens: np.ndarray, of: np.ndarray, n: int, temper: float) -> np.ndarray:
    share = np.bincount(of, tokens, minlength=n) / max(tokens.sum(), 1)
    w = share ** temper
    w[share == 0] = 0
    return w / w.sum() if w.sum() else w


def probabilities(cells: DataFrame, keep: float, temper: float, targets: dict[str, dict[str, float]] | None = None):
    """Cells (source, lang, topic, tokens) of a bounded table with their probability, as a pandas frame."""
    cells = cells.toPandas()
    cells = cells.sort_values(list(AXES), ignore_index=True)
    tokens = cells["tokens"].to_numpy(float)
    names, want = [], []
    for axis in AXES:
        label, of = np.unique(cells[axis].to_numpy(str), return_inverse=True)
        given = (targets or {}).get(axis)
        share = np.array([given.get(x, 0.0) for x in label]) if given else tempered(tokens, of, len(label), temper)
        names.append(of), want.append(share / share.sum() if share.sum() else share)
    cells["probability"] = rake(tokens, names, want, keep)
    return cells


def shares(cells: DataFrame, axis: str, temper: float, given: dict[str, float] | None) -> DataFrame:
    """(axis, want): each name's target share, from all its tokens or as given."""
    by = cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias("n"))
    if given:
        table = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{axis} string, w double")
        by = by.join(table, axis, "left").select(axis, F.coalesce("w", F.lit(0.0)).alias("w"))
    else:
        total = max(by.agg(F.sum("n")).first()[0] or 0, 1)
        by = by.select(axis, F.when(F.col("n") > 0, F.pow(F.col("n") / F.lit(float(total)), F.lit(temper))).otherwise(0.0).alias("w"))
    by = written(by, "shares")
    total = by.agg(F.sum("w")).first()[0] or 0.0
    return by.select(axis, (F.col("w") / F.lit(total or 1.0)).alias("want"))


RAKED = "source string, want double, lang array<int>, topic array<int>, tokens array<double>, p array<double>"


def raked_table(cells: DataFrame, keep: float, temper: float, targets: dict | None = None, rounds: int = 500) -> DataFrame:
    """(source, lang, topic, probability): :func:`rake` over cells of any number.

    Each source is a row with its cells; a task repeats the steps since the last
    written table on it and returns sums by language or topic for the next one.
    """
    targets = targets or {}
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total or keep >= 1:
        return cells.select(*AXES, F.lit(float(min(1.0, keep))).alias("probability"))
    known = {a: sorted((r[0], r[1]) for r in shares(cells, a, temper, targets.get(a)).collect()) for a in ("lang", "topic")}
    goals = [keep * total * np.array([w for _, w in known[a]]) for a in ("lang", "topic")]
    at = {a: cells.sparkSession.createDataFrame([(n, i) for i, (n, _) in enumerate(known[a])], f"{a} string, {a}_at int") for a in known}
    state = cells.join(at["lang"], "lang").join(at["topic"], "topic").groupBy("source").agg(F.sort_array(F.collect_list(
        F.struct("lang_at", "topic_at", F.col("tokens").cast("double").alias("tokens")))).alias("c"))
    state = state.join(shares(cells, "source", temper, targets.get("source")), "source").select(
        "source", "want", F.col("c.lang_at").alias("lang"), F.col("c.topic_at").alias("topic"), F.col("c.tokens").alias("tokens"),
        F.transform("c", lambda x: F.lit(float(min(1.0, keep)))).alias("p"))
    state = written(state, "raking")

    def replay(batch, past):
        """(tokens, lang, topic, p, largest change since the last start of a round) after the steps ``past``."""
        n = np.diff(batch.column(2).offsets.to_numpy())
        source = np.repeat(np.arange(len(n)), n)
        lang, topic, tokens, p = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5))
        begin, change = p, 0.0
        for axis, have, stuck in past:
            if axis == 0:
                begin = p
                have = np.bincount(source, tokens * p, minlength=len(n))
                stuck = np.bincount(source, tokens * (p >= 1.0), minlength=len(n))
            goal = keep * total * batch.column(1).to_numpy() if axis == 0 else goals[axis - 1]
            p = step(p, p >= 1.0, (source, lang, topic)[axis], have, stuck, goal)
            if axis == 2:
                change = float(np.abs(p - begin).max()) if len(p) else 0.0
        return tokens, lang, topic, p, change

    def sums(past, axis):
        """(have, stuck, largest change of the last round) by name of an axis after the steps ``past``."""
        def task(batches):
            have, stuck, most = np.zeros(len(goals[axis - 1])), np.zeros(len(goals[axis - 1])), 0.0
            for batch in batches:
                tokens, lang, topic, p, change = replay(batch, past)
                of = lang if axis == 1 else topic
                have += np.bincount(of, tokens * p, minlength=len(have))
                stuck += np.bincount(of, tokens * (p >= 1.0), minlength=len(have))
                most = max(most, change)
            i = np.append(np.flatnonzero(have), -1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(np.append(have[i[:-1]], most)), pa.array(np.append(stuck[i[:-1]], 0.0))],
                                             names=["i", "have", "stuck"])
        rows = state.mapInArrow(task, "i long, have double, stuck double").groupBy("i").agg(
            F.when(F.col("i") < 0, F.max("have")).otherwise(F.sum("have")).alias("have"), F.sum("stuck").alias("stuck")).toPandas()
        rows = rows.sort_values("i")
        most, rows = float(rows["have"].iloc[0]), rows.iloc[1:]
        have, stuck = np.zeros(len(goals[axis - 1])), np.zeros(len(goals[axis - 1]))
        have[rows["i"]], stuck[rows["i"]] = rows["have"], rows["stuck"]
        return have, stuck, most

    def moved(past):
        def task(batches):
            for batch in batches:
                p = replay(batch, past)[3]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.ListArray.from_arrays(batch.column(2).offsets, pa.array(p))],
                                                 names=["source", "want", "lang", "topic", "tokens", "p"])
        return written(state.mapInArrow(task, RAKED), "raking")

    past = []
    for r in range(rounds):
        if r and r % ROUNDS_A_TABLE == 0:
            later = moved(past)
            forget(state)
            state, past = later, []
        past.append((0, None, None))
        have, stuck, _ = sums(past, 1)
        past.append((1, have, stuck))
        have, stuck, _ = sums(past, 2)
        past.append((2, have, stuck))
        # the last round's change is only known once its steps are repeated
        if r % ROUNDS_A_TABLE == ROUNDS_A_TABLE - 1 and sums(past, 2)[2] < 1e-9:
            break
    state = moved(past)
    cell = state.select("source", F.explode(F.arrays_zip("lang", "topic", "p")).alias("c")).select(
        "source", F.col("c.lang").alias("lang_at"), F.col("c.topic").alias("topic_at"), F.col("c.p").alias("probability"))
    return cell.join(at["lang"], "lang_at").join(at["topic"], "topic_at").select(*AXES, "probability")


def mix_sources(docs: DataFrame, keep: float = 0.8, temper: float = 0.7, targets: dict | None = None, seed: int = 17,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(id, source, lang, topic, tokens, probability, kept) of every document."""
    spark = docs.sparkSession
    rows = written(described(docs, id_col, text_col, source_col, lang_col), "described")
    cells = written(rows.groupBy(*AXES).agg(F.sum("tokens").alias("tokens")), "cells")
    if cells.count() <= DRIVER_CELLS:
        found = probabilities(cells, keep, temper, targets)
        if not len(found):
            return rows.select("*", F.lit(1.0).alias("probability"), F.lit(True).alias("kept"))
        table = spark.createDataFrame(found[[*AXES, "probability"]])
    else:
        table = raked_table(cells, keep, temper, targets)
    u = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))
    # the join is broadcast only while the cells' size allows
    return rows.join(table, list(AXES)).withColumn("kept", u < F.col("probability")) \
        .select("id", *AXES, "tokens", "probability", "kept")


def sample(docs: DataFrame, keep: float = 0.8, temper: float = 0.7, targets: dict | None = None, seed: int = 17,
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The documents kept, with all their columns."""
    before = set(live)
    fate = written(mix_sources(docs, keep, temper, targets, seed, id_col, text_col, source_col, lang_col), "fate")
    forget_since(docs.sparkSession, before, fate)
    return without_ids(docs, fate.filter(~F.col("kept")).select("id"), id_col)
