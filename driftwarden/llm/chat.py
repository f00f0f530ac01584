"""Transcripts to canonical turns: roles by a hidden Markov model.

The lines of a transcript are observed through features (speaker marker at the start, length, question
mark, blank lines after it, code), which are taken as independent given the role.  Start, transition and emission
probabilities are given, or counts over all lines whose turn has a known role and which are not held out, on top of a
prior by which a marker tells its own role.  Steps to a line with a marker or to a given turn have probabilities of their own.  Viterbi finds the most likely roles; neighbouring lines of one role
become one turn, markers are dropped and the turn is rendered.

All transcripts form one chain that starts anew at each first line.  A line is a 3 x 3 matrix of log
probabilities, a block of lines the max-plus product of its matrices, and a block of blocks the
product of theirs, so a transcript of any length is reduced in a tree.  On the way back every block gets the roles
before and at its end and finds those between.  No task holds more than a block.  Lines are joined to pieces within a block,
and the pieces of a turn that goes over several blocks are linked and joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftwarden.llm.components import components
from driftwarden.llm.frames import groups
from driftwarden.session import stage_table

ROLES = ("system", "user", "assistant")
BLOCK = 512
# fixed values: names that transcripts give to speakers
SPEAKERS = {"system": "system|instruction|context", "user": "user|human|customer|question|q",
            "assistant": "assistant|ai|bot|agent|gpt|model|answer|a"}
MARK = r"^\s*(?:<\|(?:im_start\|>)?|#{1,4}\s*|\[|\*\*|>\s*)?(?i:NAMES)(?:\s*(?:\|>|\]|:\s*\*\*|\*\*\s*:?|:|>)\s*)"
ANY_MARK = MARK.replace("NAMES", "|".join(SPEAKERS.values()))
LINE = r"\n(?=[^\n]*\S)"      # blank lines belong to the line before them
# fixed values: pseudo-counts of a role's lines, by marker (none, system, user, assistant) and role; of steps without a marker to the same role
MARK_PRIOR = np.array([[.5, .5, .5], [.495, .0025, .0025], [.0025, .495, .0025], [.0025, .0025, .495]])
PRIOR_LINES, PRIOR_SHARE, PRIOR_STAY = 200, 0.01, 4
FEATURES = {"mark": 4, "size": 10, "asks": 2, "lines": 4, "code": 2, "opens": 2}


def known_role(role: Column) -> Column:
    """0, 1, 2 for system, user, assistant and the names used for them, else null."""
    name = F.lower(F.trim(role))
    out = F.lit(None).cast("int")
    for i, key in enumerate(ROLES):
        out = F.when(name.isin(SPEAKERS[key].split("|")), F.lit(i)).otherwise(out)
    return out


def observed(text: Column) -> dict[str, Column]:
    mark = F.lit(0)
    for i, key in enumerate(ROLES):
        mark = F.when(F.rlike(text, F.lit(MARK.replace("NAMES", SPEAKERS[key]))), i + 1).otherwise(mark)
    count = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return {"mark": mark, "size": F.least(F.floor(F.log2(F.length(text) + 1)), F.lit(13)).cast("int") - 4,
            "asks": F.contains(text, F.lit("?")).cast("int"), "lines": F.least(count, F.lit(3)),
            "code": (F.contains(text, F.lit("```")) | F.contains(text, F.lit("    "))).cast("int")}


def held_out(conv_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(conv_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def chained(lines: DataFrame, raw: bool = False) -> DataFrame:
    """Lines in order of conv_id, turn, place with their place `seq` in the chain, the block, whether they open a row, features.

    The line that opens a row shows the features of the whole row, besides its own marker; in `raw` rows are lines and open nothing.
    """
    rows = lines.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text", "role")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_whole", F.struct(*[v.alias(k) for k, v in observed(F.col("text")).items()]))
    rows = rows.select("conv_id", "turn", "role", "_tie", "_row", "_whole", F.posexplode(F.split("text", LINE)).alias("_line", "text"))
    ordered = stage_table(rows.orderBy("conv_id", "turn", "_tie", "_row", "_line").withColumn("_at", F.monotonically_increasing_id()), "lines")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)     # one row per partition
    offsets = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    opens = (F.col("_line") == 0) & F.lit(not raw)
    features = {k: F.greatest(v if k == "mark" else F.when(opens, F.col("_whole")[k]).otherwise(v), F.lit(0))
                for k, v in observed(F.col("text")).items()} | {"opens": opens.cast("int")}
    return (ordered.withColumn("_part", part).join(offsets, "_part")
            .withColumn("seq", F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .select("seq", F.floor(F.col("seq") / BLOCK).alias("block"), "conv_id", "turn", "role", "text",
                    opens.alias("opens"), known_role(F.col("role")).alias("known"), held_out("conv_id").alias("held_out"), F.struct(*[v.alias(k) for k, v in features.items()]).alias("seen")))


def with_previous(rows: DataFrame) -> DataFrame:
    """`first`, `before`: whether the row starts a transcript, and the known role of the row before it in the chain.

    A window per block; a block's first row finds its predecessor through a join of one row per block.
    """
    inside = Window.partitionBy("block").orderBy("seq")
    lagged = rows.withColumn("_p", F.lag(F.struct("conv_id", "known")).over(inside))
    ends = rows.filter(F.col("seq") % BLOCK == BLOCK - 1).select(
        (F.col("block") + 1).alias("_next"), F.struct("conv_id", "known").alias("_q"))
    joined = lagged.join(ends, (F.col("block") == F.col("_next")) & (F.col("seq") % BLOCK == 0), "left")
    previous = F.coalesce("_p", "_q")
    first = previous.isNull() | ~previous["conv_id"].eqNullSafe(F.col("conv_id"))
    return joined.withColumn("first", first).withColumn("before", F.when(~first, previous["known"])).drop("_p", "_q", "_next")


def learn(rows: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities from counts over lines with a known role that are not held out; one and the prior are added to each count."""
    known = rows.filter(F.col("known").isNotNull() & ~F.col("held_out"))
    kinds = [F.struct(F.lit("start").alias("kind"), F.when(F.col("first"), F.lit(0)).alias("value"), F.col("known").alias("role")),
             F.struct(F.when((F.col("seen.mark") > 0) | F.col("opens"), F.lit("move")).otherwise(F.lit("stay")).alias("kind"), F.col("before").alias("value"), F.col("known").alias("role"))]
    kinds += [F.struct(F.lit(k).alias("kind"), F.col(f"seen.{k}").cast("int").alias("value"), F.col("known").alias("role")) for k in FEATURES]
    counts = known.select(F.inline(F.array(*kinds))).filter("value is not null").groupBy("kind", "value", "role").count().collect()
    tables = {"start": np.ones((1, 3)), "move": np.ones((3, 3)), "stay": np.ones((3, 3)), **{k: np.ones((n, 3)) for k, n in FEATURES.items()}}
    for kind, value, role, n in counts:
        tables[kind][value, role] += n
    tables["mark"] += MARK_PRIOR * (PRIOR_LINES + PRIOR_SHARE * (tables["mark"].sum(axis=0) - FEATURES["mark"]))
    tables["stay"] += PRIOR_STAY * np.eye(3)
    out = {k: np.log(v / v.sum(axis=0)) for k, v in tables.items() if k in FEATURES}
    for k in ("start", "move", "stay"):
        out[k] = np.log(tables[k] / tables[k].sum(axis=1, keepdims=True))
    return out


def line_matrices(first: np.ndarray, seen: dict[str, np.ndarray], model: dict[str, np.ndarray]) -> np.ndarray:
    """One matrix per line: [role before, role] -> log probability of the step and of what is seen."""
    emitted = sum(model[k][seen[k]] for k in FEATURES if k != "opens")
    step = np.where(((seen["mark"] > 0) | (seen["opens"] > 0))[:, None, None], model["move"][None, :, :], model["stay"][None, :, :])
    step = np.where(first[:, None, None], model["start"][0][None, None, :], step)
    return step + emitted[:, None, :]


def product(mats: np.ndarray) -> np.ndarray:
    """Max-plus product; the largest entry is set to 0, which keeps long chains in range."""
    out = mats[0]
    for m in mats[1:]:
        out = (out[:, :, None] + m[None, :, :]).max(axis=1)
        out = out - out.max()
    return out


def decode(mats: np.ndarray, before: int, last: int | None) -> np.ndarray:
    """The best states after each matrix, from state `before` to state `last` (the best one if None)."""
    score, back = mats[0][before], []
    for m in mats[1:]:
        paths = score[:, None] + m
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0)
        score = score - score.max()
    state = int(score.argmax()) if last is None else last
    out = [state]
    for step in reversed(back):
        state = int(step[state])
        out.append(state)
    return np.array(out[::-1])


def recover_roles(rows: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """seq, state, previous (state of the line before in the chain) of every row of `with_previous`."""
    def seen(pdf):
        values = pd.DataFrame(pdf["seen"].tolist())
        return line_matrices(pdf["first"].to_numpy(bool), {k: values[k].to_numpy() for k in FEATURES}, model)

    def mats(pdf):
        return np.array(pdf["mat"].tolist()).reshape(-1, 3, 3)

    def reduce(of, child, parent):
        def run(batches):
            for pdf in groups(batches, [parent]):
                pdf = pdf.sort_values(child)
                yield pd.DataFrame({"node": [int(pdf[parent].iloc[0])], "mat": [product(of(pdf)).ravel()]})
        return run

    narrow = rows.select("block", "seq", "first", "seen").repartition("block").sortWithinPartitions("block")
    levels = [stage_table(narrow.mapInPandas(reduce(seen, "seq", "block"), "node long, mat array<double>"), "level")]
    while levels[-1].count() > 1:
        up = (levels[-1].withColumn("parent", F.floor(F.col("node") / BLOCK)).repartition("parent").sortWithinPartitions("parent"))
        levels.append(stage_table(up.mapInPandas(reduce(mats, "node", "parent"), "node long, mat array<double>"), "level"))

    def spread(of, child, parent, name):
        def run(batches):
            for pdf in groups(batches, [parent]):
                pdf = pdf.sort_values(child)
                end = pdf["last"].iloc[0]
                states = decode(of(pdf), int(pdf["before"].iloc[0]), None if end < 0 else int(end))
                yield pd.DataFrame({name: pdf[child].to_numpy(), "before": np.append(pdf["before"].iloc[0], states[:-1]).astype(np.int32),
                                    "last": states.astype(np.int32)})
        return run

    # the whole chain starts with a first line, so any state may stand before it
    bounds = levels[-1].select("node", F.lit(0).alias("before"), F.lit(-1).alias("last"))
    for level in reversed(levels[:-1]):
        down = level.withColumn("parent", F.floor(F.col("node") / BLOCK)).join(bounds.withColumnRenamed("node", "parent"), "parent")
        bounds = stage_table(down.repartition("parent").sortWithinPartitions("parent").mapInPandas(
            spread(mats, "node", "parent", "node"), "node long, before int, last int"), "bounds")
    leaf = (rows.select("block", "seq", "first", "seen")
            .join(bounds.withColumnRenamed("node", "block"), "block").repartition("block").sortWithinPartitions("block"))
    return leaf.mapInPandas(spread(seen, "seq", "block", "seq"), "seq long, before int, last int").select(
        "seq", F.col("last").alias("state"), F.col("before").alias("previous"))


def merged(lines: DataFrame) -> DataFrame:
    """conv_id, turn, role, held_out, state, n_lines, body per run of lines (`starts` marks the first line of a run).

    A piece is what a block has of a run.  Pieces are made by a window per block; those that go on the last
    piece of the block before are linked with it.
    """
    inside = Window.partitionBy("block").orderBy("seq")
    begins = F.when(F.col("starts") | (F.col("seq") % BLOCK == 0), F.col("seq"))
    # another role's marker inside a turn is text
    own = F.col("starts") | (F.col("seen.mark") == F.col("state") + 1)
    body = F.when(own, F.regexp_replace("text", ANY_MARK, "")).otherwise(F.col("text"))
    joined = lambda at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "body"))), lambda x: x["body"]), "\n")
    head = F.struct("seq", "starts", "conv_id", "turn", "role", "held_out", "state")
    pieces = stage_table(lines.withColumn("body", body).withColumn("piece", F.max(begins).over(inside)).groupBy("block", "piece").agg(
        F.min(head).alias("head"), F.count("*").alias("n_lines"), joined("seq").alias("body")), "pieces")
    ends = pieces.groupBy((F.col("block") + 1).alias("block")).agg(F.max("piece").alias("b"))
    links = pieces.filter("not head.starts").select("block", F.col("piece").alias("a")).join(ends, "block").select("a", "b")
    found = components(links).select(F.col("node").alias("piece"), F.col("component").alias("run"))
    runs = pieces.join(found, "piece", "left").groupBy(F.coalesce("run", "piece").alias("run")).agg(
        F.min("head").alias("head"), F.sum("n_lines").alias("n_lines"), joined("piece").alias("body"))
    return runs.select("head.conv_id", "head.turn", "head.role", "head.held_out", "head.state", "n_lines", "body")


def parse_transcripts(lines: DataFrame, model: dict[str, np.ndarray] | None = None, across: bool = False,
                      raw: bool = False) -> DataFrame:
    """conv_id, turn, role, held_out, parsed_role, n_lines, rendered per turn found in `lines` (conv_id, turn, role, text).

    Each text is cut into its lines (blank ones stay with the line before), which are the model's observations.  Neighbouring
    lines of one role are one turn; a turn ends with its row, unless `across` is set: then it ends with
    the role or the transcript.  With `raw`, rows are lines and not turns, as from `split_transcripts`.  conv_id, turn and role are those of the turn's first line.
    `model` has log probabilities as from `learn`.  Without it `role` is used to learn from, where it is known and the
    transcript is not held out (crc32 of conv_id as text, modulo 3, is not 1); it is never used to parse.  Rows without
    conv_id form one transcript, the first; rows are ordered by turn, null
    first, ties by a hash of text and role; repeated rows each bring their lines; a null or empty
    text is an empty line; without known roles and model only the prior tells roles.  An empty table gives no rows.
    """
    rows = stage_table(with_previous(chained(lines, raw)), "chain")
    if not rows.take(1):
        return rows.select("conv_id", "turn", "role", "held_out", F.lit("").alias("parsed_role"), F.lit(0).cast("long").alias("n_lines"), F.lit("").alias("rendered"))
    states = recover_roles(rows, learn(rows) if model is None else model)
    starts = F.col("first") | (F.col("state") != F.col("previous"))
    turns = merged(rows.join(states, "seq").withColumn("starts", starts if across or raw else starts | F.col("opens")))
    name = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("state") + 1)
    return turns.select(
        "conv_id", "turn", "role", "held_out", name.alias("parsed_role"), "n_lines",
        F.concat(F.lit("<|"), name, F.lit("|>\n"), F.trim("body"), F.lit("\n<|end|>")).alias("rendered"))


def split_transcripts(transcripts: DataFrame) -> DataFrame:
    """Lines (conv_id, turn, role: null, text) of whole transcripts (conv_id, text); blank lines are left out."""
    line = F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    return (transcripts.select("conv_id", line.alias("turn", "text")).filter(F.trim("text") != "")
            .select("conv_id", F.col("turn").cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), "text"))
