"""Chat transcripts: roles recovered line by line by a hidden Markov model, and canonical turns rendered from them.

A transcript is lines of text, some of which open a turn with a speaker marker ("User:", "[assistant]", "### System:").
States are (role, opening or going on).  A line's observation is its marker, if it has one, and whether it is long, ends
as a question, or is blank.  Initial, transition and emission probabilities are counted over labelled lines with
additive smoothing.  Viterbi runs over blocks of lines: a block's best score from each state before it to each state at
its end is a matrix, matrices of successive blocks are combined in groups of ``FAN``, level by level, and the states at
the blocks' ends are then fixed from the top down; so a transcript of any length is exact, and no task holds more than a
block's lines or a group's matrices.

A turn that was recovered reaches from a line that opens one to the next such line, wherever the raw turns end.

Defined results: a null text is an empty line, a null turn is taken as 0.  A row without a transcript id is a transcript of
its own, shown as -1.  Rows that repeat a turn are one turn of all their lines.  Lines are ordered by turn, place in the
turn, and text.  A turn follows the one with the next smaller number.  Ties between paths go to the state that comes first
in ``STATES``.  An empty table gives an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import sorted_groups, stage_table

ROLES = ("system", "user", "assistant")
STATES = [(r, o) for r in range(len(ROLES)) for o in (True, False)]
#: The words that stand for a role in a marker.
MARKERS = {"system": "system|context|instructions", "user": "user|human|customer|q", "assistant": "assistant|bot|ai|agent|a"}
MARKER = r"^\s*(?:#{1,4}\s*|\*\*|\[|<\|?)?(?i:(%s))(?:\]|\|?>)?(?:\*\*)?\s*(?:\([^)]{0,30}\))?\s*(?:[:>\]]|-\s|\|>)\s*(?:\*\*)?\s*"
ANY = MARKER % "|".join(MARKERS.values())
#: Observations: marker (0: none, else the role's number plus 1) and three yes-or-no features.
N_OBS = (len(ROLES) + 1) * 8
LONG = 120
#: Turns of a block, and matrices of a group.
BLOCK, FAN = 64, 256
#: Groups of a batch that goes back to Spark.
MANY = 256
PRIOR = 0.5
#: What names a transcript.
KEY = ["conv", "lone"]


def observation(line: Column) -> Column:
    """The number of a line's observation."""
    word = F.lower(F.regexp_extract(line, ANY, 1))
    marker = F.lit(0)
    for k, names in enumerate(MARKERS.values()):
        marker = F.when(word.isin(names.split("|")), k + 1).otherwise(marker)
    rest = F.regexp_replace(line, ANY, "")
    out = marker * 8
    for k, flag in enumerate([F.length(rest) > LONG, rest.rlike(r"\?\s*$"), F.trim(rest) == ""]):
        out = out + flag.cast("int") * (1 << k)
    return out.cast("int")


def lines_of(turns: DataFrame, id_col: str, turn_col: str, text_col: str, role_col: str | None = None) -> DataFrame:
    """(conv, lone, turn, part, line, obs[, state]) of turns' raw texts: one row per line.  lone is 0, or a number of its own
    for each row without an id; stage the lines where they are read more than once, so that these numbers stay."""
    conv = F.col(id_col).cast("long")
    keys = [F.coalesce(conv, F.lit(-1)).alias("conv"), F.when(conv.isNull(), F.monotonically_increasing_id() + 1).otherwise(0).alias("lone"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn")]
    every = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")
    rows = turns.select(*keys, *([F.col(role_col).alias("role")] if role_col else []), F.posexplode(every).alias("part", "line"))
    rows = rows.withColumn("obs", observation(F.col("line")))
    out = [*KEY, "turn", "part", "line", "obs"]
    if role_col:
        state = F.lit(None).cast("int")
        for k, (role, opening) in enumerate(STATES):
            state = F.when((F.col("role") == ROLES[role]) & ((F.col("part") == 0) == F.lit(opening)), k).otherwise(state)
        rows, out = rows.withColumn("state", state), [*out, "state"]
    return rows.select(*out)


class Model:
    """Log probabilities: step (state before x state) and emit (state x observation).  The last state is the beginning of
    a transcript, which only comes first and emits nothing."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> None:
        n = len(STATES)
        log = lambda x: np.log((x + PRIOR) / (x + PRIOR).sum(axis=-1, keepdims=True))
        self.step, self.emit = np.full((n + 1, n + 1), -np.inf), np.full((n + 1, N_OBS), -np.inf)
        self.step[:n, :n], self.step[n, :n], self.emit[:n] = log(step), log(start), log(emit)
        # A line that goes on has the role of the line before, and a transcript begins with a turn.
        for a, b in itertools.product(range(n + 1), range(n)):
            if not STATES[b][1] and (a == n or STATES[a][0] != STATES[b][0]):
                self.step[a, b] = -np.inf


def fit(lines: DataFrame) -> Model:
    """Counts over labelled lines; only the tables of counts, whose size is fixed, reach the driver."""
    n = len(STATES)
    emit, step, start = np.zeros((n, N_OBS)), np.zeros((n, n)), np.zeros(n)
    known = lines.where(F.col("state").isNotNull())
    for s, o, c in known.groupBy("state", "obs").count().collect():
        emit[s, o] = c
    # Within a turn, each line goes on from the one before; between turns, from the last line of the turn before: within a
    # block of turns by the order there, and for a block's first turn by the order of blocks, of which there are few.
    block = F.floor(F.col("turn") / BLOCK).cast("long").alias("b0")
    turn = known.groupBy(*KEY, block, "turn").agg(F.min("state").alias("opened"), F.max("part").alias("last"))
    ended = F.col("opened") + F.when(F.col("last") > 0, 1).otherwise(0)
    turn = stage_table(turn.withColumn("ended", ended).withColumn("from", F.lag("ended").over(W.partitionBy(*KEY, "b0").orderBy("turn"))), "turns")
    blocks = turn.groupBy(*KEY, "b0").agg(F.min_by("opened", "turn").alias("opened"), F.max_by("ended", "turn").alias("ended"))
    blocks = blocks.withColumn("from", F.lag("ended").over(W.partitionBy(*KEY).orderBy("b0")))
    steps = turn.where(F.col("from").isNotNull()).select("from", "opened").unionByName(blocks.select("from", "opened"))
    for a, b, c in steps.groupBy("from", "opened").count().collect():
        if a is None:
            start[b] += c
        else:
            step[a, b] += c
    for s, c, more in turn.groupBy("opened").agg(F.count_if(F.col("last") > 0), F.sum(F.greatest(F.col("last") - 1, F.lit(0)))).collect():
        step[s, s + 1] += c
        step[s + 1, s + 1] += more
    return Model(start, step, emit)


def joined(mats: list[np.ndarray]) -> np.ndarray:
    """Best scores from each state before the first to each state at the end of the last."""
    out = mats[0]
    for x in mats[1:]:
        out = (out[:, :, None] + x[None]).max(axis=1)
    return out


def best_ends(mats: list[np.ndarray], before: int, end: int) -> list[int]:
    """The best state at the end of each of successive steps, the last being ``end``."""
    score, back = mats[0][before], []
    for x in mats[1:]:
        every = score[:, None] + x
        back.append(every.argmax(axis=0))
        score = every.max(axis=0)
    path = [end]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """(conv, lone, turn, part, line, state, b0, nth, opener) for (conv, lone, turn, part, line, obs): the best path of each
    transcript.  nth numbers the lines of block b0 in order; opener is the nth of the line that opens the turn which the line
    is in, or null where that is in an earlier block."""
    n = len(STATES) + 1
    per_obs = [model.step + model.emit[None, :, o] for o in range(N_OBS)]
    opens = np.array([o for _, o in STATES])
    rows = lines if "lone" in lines.columns else lines.withColumn("lone", F.lit(0).cast("long"))
    rows = rows.withColumn("b0", F.floor(F.col("turn") / BLOCK).cast("long"))

    def up(rows: DataFrame, key: str, of: str, load) -> DataFrame:  # noqa: ANN001
        """(*KEY, key, mat) of the runs of equal (*KEY, key), from their members in order."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for g in sorted_groups(batches, [*KEY, key]):
                held.append((*(g[c][0].as_py() for c in (*KEY, key)), joined(load(g)).tobytes()))
                if len(held) == MANY:
                    yield batch_of(held, [*KEY, key, "mat"])
                    held = []
            if held:
                yield batch_of(held, [*KEY, key, "mat"])

        dealt = rows.repartition(*KEY, key).sortWithinPartitions(*KEY, key, *of.split())
        return dealt.mapInArrow(run, f"conv long, lone long, {key} long, mat binary")

    def from_obs(g: pa.Table) -> list[np.ndarray]:
        return [per_obs[o] for o in g["obs"].to_numpy().tolist()]

    def from_mats(g: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(x, np.float64).reshape(n, n) for x in g["mat"].to_pylist()]

    def down(rows: DataFrame, key: str, of: str, out: list[str], load, told: str, tell) -> DataFrame:  # noqa: ANN001
        """The members of the runs of equal (*KEY, key, before, end) with what ``tell(before, ends)`` says of them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Table] = []
            for g in sorted_groups(batches, [*KEY, key]):
                before = g["before"][0].as_py()
                new = g.select(out)
                for name, column in tell(before, best_ends(load(g), before, g["end"][0].as_py())).items():
                    new = new.append_column(name, column)
                held.append(new)
                if sum(map(len, held)) >= MANY * 8 or len(held) == MANY:
                    yield from pa.concat_tables(held).combine_chunks().to_batches()
                    held = []
            if held:
                yield from pa.concat_tables(held).combine_chunks().to_batches()

        kinds = dict(rows.dtypes)
        ddl = ", ".join([*(f"{c} {kinds[c]}" for c in out), told])
        return rows.repartition(*KEY, key).sortWithinPartitions(*KEY, key, *of.split()).mapInArrow(run, ddl)

    def as_bounds(before: int, ends: list[int]) -> dict[str, pa.Array]:
        return {"before": pa.array([before, *ends[:-1]], pa.int32()), "end": pa.array(ends, pa.int32())}

    def as_lines(before: int, ends: list[int]) -> dict[str, pa.Array]:
        nth = np.arange(len(ends))
        opener = np.maximum.accumulate(np.where(opens[ends], nth, -1))
        return {"state": pa.array(ends, pa.int32()), "nth": pa.array(nth, pa.int64()), "opener": pa.array(opener, pa.int64(), mask=opener < 0)}

    levels = [stage_table(up(rows.select(*KEY, "b0", "turn", "part", "line", "obs"), "b0", "turn part line", from_obs), "blocks")]
    while True:
        k = len(levels) - 1
        least, most = levels[k].agg(F.min(f"b{k}"), F.max(f"b{k}")).first()
        if least == most or least is None:
            break
        higher = levels[k].withColumn(f"b{k + 1}", F.floor(F.col(f"b{k}") / FAN).cast("long"))
        if least < 0 <= most and -1 <= least and most <= 0:
            # Turns on either side of 0 never meet by division; the two last blocks make one.
            higher = higher.withColumn(f"b{k + 1}", F.lit(0).cast("long"))
        levels.append(stage_table(up(higher, f"b{k + 1}", f"b{k}", from_mats), "blocks"))
    top = len(levels) - 1

    def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [int(np.frombuffer(x, np.float64).reshape(n, n)[n - 1].argmax()) for x in batch["mat"].to_pylist()]
            yield pa.record_batch([*(batch[c] for c in (*KEY, f"b{top}")), pa.array([n - 1] * len(ends), pa.int32()), pa.array(ends, pa.int32())], names=[*KEY, f"b{top}", "before", "end"])

    ends = levels[top].mapInArrow(ending, f"conv long, lone long, b{top} long, before int, end int")
    for k in range(top - 1, -1, -1):
        members = levels[k].withColumn(f"b{k + 1}", F.floor(F.col(f"b{k}") / FAN).cast("long"))
        least, most = members.agg(F.min(f"b{k}"), F.max(f"b{k}")).first()
        if -1 <= least and most <= 0:
            members = members.withColumn(f"b{k + 1}", F.lit(0).cast("long"))
        members = members.join(ends, [*KEY, f"b{k + 1}"])
        ends = stage_table(down(members, f"b{k + 1}", f"b{k}", [*KEY, f"b{k}"], from_mats, "before int, end int", as_bounds), "block-ends")
    members = rows.join(ends, [*KEY, "b0"])
    return down(members, "b0", "turn part line", [*KEY, "turn", "part", "line", "b0"], from_obs, "state int, nth long, opener long", as_lines)


def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * (len(names) - 1), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def recovered(parsed: DataFrame) -> DataFrame:
    """(conv, lone, turn, part, role, lines, until, text) of each recovered turn: turn and part are those of the line that
    opens it, until is the raw turn of its last line.  The text is canonical: the role's header, then the lines, the first
    without its marker.  ``parsed`` should be staged."""
    role = F.element_at(F.array(*[F.lit(ROLES[r]) for r, _ in STATES]), F.col("state") + 1)
    keyed = parsed.withColumns({"role": role, "open_block": F.col("b0"), "open_nth": F.col("opener")})
    # Lines before the first opening of their block belong to the last one of an earlier block.
    last = parsed.groupBy(*KEY, "b0").agg(F.max(F.when(F.col("opener").isNotNull(), F.struct("b0", "opener"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(W.partitionBy(*KEY).orderBy("b0").rowsBetween(W.unboundedPreceding, -1))
    last = last.withColumn("before", before).select(*KEY, "b0", "before")
    late = keyed.where("opener IS NULL").join(last, [*KEY, "b0"])
    late = late.withColumns({"open_block": F.col("before.b0"), "open_nth": F.col("before.opener")}).drop("before")
    every = keyed.where("opener IS NOT NULL").unionByName(late)
    first = (F.col("b0") == F.col("open_block")) & (F.col("nth") == F.col("open_nth"))
    text = F.when(first, F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.regexp_replace("line", ANY, ""))).otherwise(F.col("line"))
    out = every.groupBy(*KEY, "open_block", "open_nth").agg(F.sort_array(F.collect_list(F.struct("b0", "nth", "turn", "part", "role", text.alias("text")))).alias("x"))
    one = F.element_at("x", 1)
    return out.select(
        *KEY, one["turn"].alias("turn"), one["part"].alias("part"), one["role"].alias("role"), F.size("x").alias("lines"),
        F.element_at("x", -1)["turn"].alias("until"), F.array_join(F.transform("x", lambda y: y["text"]), "\n").alias("text"), "open_block", "open_nth",
    )


def rendered(parsed: DataFrame) -> DataFrame:
    """(conv, turn, role, opened, text): of each raw turn, the role of its first line, how many recovered turns it opens,
    and the canonical text of these as a whole, wherever they end (null if it opens none: it is part of an earlier one).
    Joined in order, the texts give the transcript."""
    parsed = stage_table(parsed, "parsed")
    role = F.element_at(F.array(*[F.lit(ROLES[r]) for r, _ in STATES]), F.min_by("state", F.struct("b0", "nth")) + 1)
    raw = parsed.groupBy(*KEY, "turn").agg(role.alias("role"))
    turns = recovered(parsed).groupBy(*KEY, "turn").agg(F.sort_array(F.collect_list(F.struct("open_block", "open_nth", "text"))).alias("x"))
    turns = turns.select(*KEY, "turn", F.size("x").alias("opened"), F.array_join(F.transform("x", lambda y: y["text"]), "\n").alias("text"))
    return raw.join(turns, [*KEY, "turn"], "left").select("conv", "turn", "role", F.coalesce("opened", F.lit(0)).alias("opened"), "text")


def raw_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns as a chat log would show them: markers of one style for a transcript, every eighth turn without one."""
    style = F.pmod(F.xxhash64(id_col), F.lit(4))
    name = F.when(F.col(role_col) == "user", F.when(style == 1, "Human").otherwise("User")).when(F.col(role_col) == "system", "System").otherwise("Assistant")
    marker = F.when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), name, F.lit(": ")))
    marker = marker.when(style == 2, F.concat(F.lit("["), F.lower(name), F.lit("]: "))).otherwise(F.concat(F.lit("**"), name, F.lit(":** ")))
    bare = F.pmod(F.xxhash64(id_col, turn_col), F.lit(8)) == 0
    text = F.coalesce(F.col(text_col), F.lit(""))
    return turns.select(id_col, turn_col, role_col, F.when(bare, text).otherwise(F.concat(marker, text)).alias(text_col))
