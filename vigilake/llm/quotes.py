"""Chat formatting by quotation linking.

Messages are cut into lines; leading ``>`` signs give a line's quote level, and
lines in a row of one level are a passage. Passages and their lines are
normalised and hashed. Quoted ones are joined to the latest message before them
in the conversation that says the same without quoting; the nearest level's link
is the message that is replied to. Messages then follow the one they answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilake.llm.common import SPACE_CHARS, SPACES, staged

MARKS = r"^(?:[\x20\t]*>)+[\x20\t]?"
ATTRIBUTION = r"^(?:On .* wrote|Am .* schrieb.*|Le .* a écrit|El .* escribió)\s*:\s*$"
# A conversation is worked on in stretches of so many turns (2 to the power).
STRETCH_BITS = 8


def normal(text: Column) -> Column:
    """Lower-cased, runs of spaces as one."""
    return F.btrim(F.regexp_replace(F.lower(text), SPACES, " "), F.lit(SPACE_CHARS))


def lines(messages: DataFrame) -> DataFrame:
    """One row per line: key, place, level, and the line without marks."""
    cut = messages.select("conv", "turn", "row", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1)).alias("at", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    return cut.select("conv", "turn", "row", "at", F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace("line", MARKS, "").alias("line"))


def passages(cut: DataFrame) -> DataFrame:
    """Runs of lines of one level: key, level, run, hash, and the run's lines.
    Blank lines part nothing and count for nothing, nor do lines that introduce
    the deeper quote after them."""
    order = Window.partitionBy("conv", "turn", "row").orderBy("at")
    said = cut.withColumn("norm", normal(F.col("line"))).where("norm <> ''").withColumn("deeper", F.lead("level").over(order) > F.col("level"))
    own = said.where(~(F.coalesce("deeper", F.lit(False)) & F.col("line").rlike(ATTRIBUTION)))
    moved = own.withColumn("new", (F.col("level") != F.lag("level", 1, -1).over(order)).cast("int"))
    runs = moved.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "norm"))), lambda s: s["norm"])
    return runs.groupBy("conv", "turn", "row", "run", "level").agg(listed.alias("norms")).withColumn("hash", F.md5(F.array_join("norms", "\n")))


def _units(parts: DataFrame) -> DataFrame:
    """A passage by its hash, and each of its lines by theirs."""
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.col("hash").alias("hash")))
    each = F.transform(F.array_distinct("norms"), lambda n: F.struct(F.lit(False).alias("whole"), F.md5(n).alias("hash")))
    return parts.select("conv", "turn", "row", "run", "level", F.explode(F.concat(whole, each)).alias("u")).select("conv", "turn", "row", "run", "level", "u.*")


def _replies(parts: DataFrame) -> DataFrame:
    """All that a message says between and after quotes, as one passage."""
    runs = F.array_sort(F.collect_list(F.struct("run", "norms")))
    norms = parts.where("level = 0").groupBy("conv", "turn", "row").agg(F.flatten(F.transform(runs, lambda r: r["norms"])).alias("norms"), F.count(F.lit(1)).alias("n"))
    return norms.where("n > 1").select("conv", "turn", F.lit(True).alias("whole"), F.md5(F.array_join("norms", "\n")).alias("hash"))


def _latest(said: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv, whole, hash, turn, to, alone): the latest turn before one that
    asks which says the same, and whether it is the only one before. Stretches
    of turns are worked on apart; one row of each is carried on."""
    key = ["conv", "whole", "hash"]
    points = said.select(*key, "turn", F.lit(True).alias("says"), F.lit(False).alias("asks")).union(
        asked.select(*key, "turn", F.lit(False), F.lit(True)))
    turns = points.groupBy(*key, "turn").agg(F.max(F.when(F.col("says"), F.col("turn"))).alias("own"), F.max("asks").alias("asks"))
    turns = turns.withColumn("stretch", F.shiftright("turn", STRETCH_BITS))
    inside = Window.partitionBy(*key, "stretch").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    near = turns.select("*", F.min("own").over(inside).alias("first"), F.max("own").over(inside).alias("last")).where("asks")
    ends = turns.groupBy(*key, "stretch").agg(F.min("own").alias("first"), F.max("own").alias("last"))
    far = ends.select(*key, "stretch", F.min("first").over(across).alias("far_first"), F.max("last").over(across).alias("far_last"))
    first, last = F.coalesce("far_first", "first"), F.coalesce("last", "far_last")
    return near.join(far, [*key, "stretch"]).where(last.isNotNull()).select(*key, "turn", last.alias("to"), (first == last).alias("alone"))


def links(parts: DataFrame) -> DataFrame:
    """(conv, turn, row, run, level, to): the turn that a quoted passage is from.
    A passage found whole beats one found line by line, and lines that one turn
    alone says beat those that recur; then the turn with the most lines counts,
    then the latest."""
    units = _units(parts)
    said = units.where("level = 0").select("conv", "turn", "whole", "hash").union(_replies(parts))
    quoted = units.where("level > 0")
    met = quoted.join(_latest(said, quoted), ["conv", "whole", "hash", "turn"])
    rank = F.when(F.col("whole"), 0).when(F.col("alone"), 1).otherwise(2)
    votes = met.groupBy("conv", "turn", "row", "run", "level", "to").agg(F.min(rank).alias("rank"), F.count(F.lit(1)).alias("n"))
    return votes.groupBy("conv", "turn", "row", "run", "level").agg(F.max_by("to", F.struct(-F.col("rank"), "n", "to")).alias("to"))


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conversation, turn, role, text without quotes,
    reply_to (turn), thread (the turn the chain of replies starts with), the
    numbers of quoted passages and of those linked, and the chat line. In the
    order of (thread, turn) every message follows what it answers.

    NULL texts are empty; messages without a conversation or turn keep their
    text but link with nothing; repeated rows are messages of their own. A
    message that quotes nothing known starts a thread. Other columns are not
    read, whatever their names.
    """
    own = staged(messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"),
        F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row")), "messages")
    cut = lines(own)
    parts = staged(passages(cut), "passages")
    found = staged(links(parts.where("conv is not null and turn is not null")), "quotes")
    counts = parts.where("level > 0").groupBy("row").agg(F.count(F.lit(1)).alias("n_quotes"))
    linked = found.groupBy("row").agg(F.count(F.lit(1)).alias("n_linked"), F.min_by("to", F.struct("level", -F.col("to"))).alias("reply_to"))
    # Quoted lines and the line that introduces them go.
    order = Window.partitionBy("row").orderBy("at")
    kept = cut.withColumn("next", F.lead("level").over(order)).where(~((F.col("level") > 0) | (F.col("line").rlike(ATTRIBUTION) & (F.coalesce("next", F.lit(0)) > 0))))
    clean = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l")).select(
        "row", F.btrim(F.array_join(F.transform("l", lambda s: s["line"]), "\n"), F.lit(SPACE_CHARS)).alias("clean"))
    told = staged(
        own.drop("text").join(clean, "row", "left").join(counts, "row", "left").join(linked, "row", "left"), "told")
    roots = _roots(told.where("reply_to is not null").groupBy("conv", "turn").agg(F.min("reply_to").alias("to")))
    text = F.coalesce("clean", F.lit(""))
    return told.join(roots, ["conv", "turn"], "left").select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), text.alias(text_col), "reply_to",
        F.coalesce("root", "turn").alias("thread"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), text).alias("chat"),
    )


def _roots(replies: DataFrame) -> DataFrame:
    """(conv, turn, root): where the chain of replies of a turn starts.

    Turns of one stretch of the conversation that each answer the turn before
    are one run, found in one pass. The first turns of runs are then linked by
    doubling pointers: replies name earlier turns, so the number of rounds is
    the logarithm of the longest chain of runs.
    """
    order = Window.partitionBy("conv", F.shiftright("turn", STRETCH_BITS)).orderBy("turn")
    first = F.when(~F.lag("turn").over(order).eqNullSafe(F.col("to")), F.col("turn"))
    runs = staged(
        replies.withColumn("first", first).withColumn("first", F.max("first").over(order.rowsBetween(Window.unboundedPreceding, 0))), "runs")
    run_of = runs.select("conv", F.col("turn").alias("to"), F.col("first").alias("further"))
    moving, done = staged(
        runs.where("turn = first").join(run_of, ["conv", "to"], "left").select("conv", "first", F.coalesce("further", "to").alias("root")), "roots"), None
    while not moving.isEmpty():
        every = moving if done is None else moving.union(done)
        ahead = every.select("conv", F.col("first").alias("root"), F.col("root").alias("further"))
        step = staged(
            moving.join(ahead, ["conv", "root"], "left").select("conv", "first", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        # Runs at the start of their chain are left alone from here on.
        still, moving = step.where("not moved").drop("moved"), step.where("moved").drop("moved")
        done = still if done is None else done.union(still)
    return runs.join(done if done is not None else moving, ["conv", "first"]).select("conv", "turn", "root")


def as_mails(chats: DataFrame) -> DataFrame:
    """Conversations as mail clients send them: a turn quotes the turn numbered
    one less under a line that introduces it, and the one before that one level
    deeper; of repeated turns the smallest text is quoted. Turns without a
    conversation or number quote nothing.

    Stretches of a conversation are built apart; each is also given the last
    two turns of the stretch before it.
    """
    stretch, place = F.shiftright("turn", STRETCH_BITS), F.pmod(F.col("turn"), F.lit(2**STRETCH_BITS))
    keyed = chats.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    dealt = keyed.where("conv_id is not null and turn is not null").withColumn(
        "stretch", F.explode(F.when(place >= 2**STRETCH_BITS - 2, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))))
    order = Window.partitionBy("conv_id", "stretch").orderBy("turn")
    before, two = F.min("text").over(order.rangeBetween(-1, -1)), F.min("text").over(order.rangeBetween(-2, -2))
    marked = lambda text, marks: F.concat(F.lit(marks), F.regexp_replace(text, "\n", f"\n{marks}"))
    seen = dealt.withColumn("before", before).withColumn("two", two).where(F.col("stretch") == stretch)
    quoted = F.when(F.col("before").isNull(), "").otherwise(F.concat(
        F.lit("\nOn an earlier day they wrote:\n"), marked(F.col("before"), "> "),
        F.when(F.col("two").isNull(), "").otherwise(F.concat(F.lit("\n"), marked(F.col("two"), ">> ")))))
    sent = seen.select("conv_id", "turn", "role", F.concat("text", quoted).alias("text"))
    return sent.union(keyed.where("conv_id is null or turn is null"))
