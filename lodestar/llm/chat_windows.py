"""Chat formatting in budgeted windows, with DataFrame functions only.

Template: a turn is <s>role, a line feed, the text, </s>. Inside roles and texts the
escape character and the first characters of control strings are replaced (fixed values
below), so that <s>, </s>, [INST] and the like can't occur in them; the replacement is
undone exactly. Line feeds in a role are replaced too.

Windows: running sums of turn tokens choose the spans. The system turn (the first turn,
where it has that role) opens every window; turns before the span are repeated as long as
they fit in the history budget; new turns follow until the window budget is full, one at
least. Every turn is new in exactly one window. The loss mask lies over the texts of new
assistant turns; repeated ones are masked. A turn counts a quarter of its UTF-8 bytes,
rounded up, and TURN_TOKENS for the template: a fixed rule, not a tokenizer's count.

Rows are ordered by turn, then role, then text (nulls first), so repeated and tied rows
have a defined place. A null role or text is empty; a null conv_id is a conversation of
its own. Repeated rows are turns each; a turn over the budget is a window of its own, whole.
Only numbers of a conversation are folded as a whole; texts meet per window. Other columns
are not read, so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Escapes, in the order in which they are applied (fixed values).
ESCAPES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2")]
LINE = ("\n", "\\3")
TURN_TOKENS = 4


def _key(c: Column) -> Column:
    """The conversation: one for nulls, apart from all numbers."""
    return F.struct(c.isNull().alias("none"), F.coalesce(c, F.lit(0)).cast("long").alias("id")).alias("key")


def escape(c: Column, more: list[tuple[str, str]] = []) -> Column:  # noqa: B006
    for a, b in [*ESCAPES, *more]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, more: list[tuple[str, str]] = []) -> Column:  # noqa: B006
    for a, b in reversed([*ESCAPES, *more]):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """conv_id, window, formatted, n_repeated, loss (start, length) in code points from 1."""
    rows = turns.select(
        _key(F.col("conv_id").cast("long")),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    in_order = W.partitionBy("key").orderBy("turn", "role", "text")
    counted = rows.select("*", (F.ceil(F.octet_length("text") / 4) + TURN_TOKENS).alias("tokens"), (F.row_number().over(in_order) - 1).alias("idx"))
    by_idx = W.partitionBy("key").orderBy("idx")
    system = F.col("role").eqNullSafe("system") & (F.col("idx") == 0)
    summed = counted.select("*", system.alias("system"), (F.sum(F.when(system, 0).otherwise(F.col("tokens"))).over(by_idx.rowsBetween(W.unboundedPreceding, 0))).alias("upto"))
    summed = summed.withColumn("before", F.col("upto") - F.when(F.col("system"), 0).otherwise(F.col("tokens")))
    # turns before this one whose tokens, with all between, fit in the history; the system turn isn't among them
    reach = W.partitionBy("key").orderBy("before").rangeBetween(-history, -1)
    summed = summed.withColumn("back", F.count(F.when(~F.col("system"), 1)).over(reach))

    numbers = summed.groupBy("key").agg(
        F.max(F.when(F.col("system"), F.col("tokens")).otherwise(0)).alias("head"),
        F.array_sort(F.collect_list(F.when(~F.col("system"), F.struct("idx", "before", "upto", "back")))).alias("list"),
        F.count(F.lit(1)).alias("n"),
    )
    # fold: a span starts at the first turn that no longer fits
    starts = F.expr(
        f"""aggregate(list, cast(array() as array<struct<idx:int, before:bigint, back:bigint>>), (found, t) ->
              case when size(found) = 0 or t.upto - element_at(found, -1).before > greatest({budget} - {history} - head, 1)
                   then concat(found, array(struct(t.idx as idx, t.before as before, t.back as back))) else found end)"""
    )
    spans = numbers.select("key", "n", (F.col("head") > 0).alias("has_head"), starts.alias("starts"))
    # a conversation of a system turn alone has one window
    spans = spans.withColumn("starts", F.expr("case when size(starts) = 0 then array(struct(cast(0 as int) as idx, 0L as before, 0L as back)) else starts end"))
    windows = spans.select("key", "n", "has_head", "starts", F.posexplode("starts").alias("window", "at")).select(
        "key",
        "window",
        F.col("at.idx").alias("first"),
        F.expr(
            """concat(case when has_head and at.idx > 0 then array(0) else cast(array() as array<int>) end,
                      sequence(cast(at.idx - at.back as int), cast(coalesce(try_element_at(starts, window + 2).idx, n) - 1 as int)))"""
        ).alias("members"),
    )
    wanted = windows.select("key", "window", "first", F.explode("members").alias("idx"))
    placed = wanted.join(summed.select("key", "idx", "role", "text"), ["key", "idx"])
    is_new = (F.col("idx") >= F.col("first")) | ((F.col("window") == 0) & (F.col("idx") == 0))
    role, text = escape(F.col("role"), [LINE]), escape(F.col("text"))
    marked = placed.select("key", "window", F.struct("idx", is_new.alias("new"), (F.col("role") == "assistant").alias("target"), F.concat(F.lit("<s>"), role, F.lit("\n")).alias("open"), text.alias("body")).alias("seg"))
    packed = marked.groupBy("key", "window").agg(F.array_sort(F.collect_list("seg")).alias("segs"))
    loss = F.expr(
        """aggregate(segs, struct(1 as at, cast(array() as array<struct<start:int, length:int>>) as loss), (s, g) ->
             struct(s.at + char_length(g.open) + char_length(g.body) + 4 as at,
                    case when g.new and g.target then concat(s.loss, array(struct(s.at + char_length(g.open) as start, char_length(g.body) as length))) else s.loss end as loss)).loss"""
    )
    return packed.select(
        F.when(~F.col("key.none"), F.col("key.id")).alias("conv_id"),
        "window",
        F.expr("array_join(transform(segs, g -> concat(g.open, g.body, '</s>')), '')").alias("formatted"),
        F.expr("size(filter(segs, g -> not g.new))").alias("n_repeated"),
        loss.alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its formatted windows hold: turns and texts under the loss mask."""
    segments = F.expr("slice(split(formatted, '</s>', -1), n_repeated + 1, greatest(size(split(formatted, '</s>', -1)) - 1 - n_repeated, 0))")
    read = windows.select(
        _key(F.col("conv_id")),
        "window",
        segments.alias("segs"),
        F.expr("array_join(transform(loss, x -> substring(formatted, x.start, x.length)), '')").alias("under"),
        F.char_length("formatted").alias("chars"),
    )
    def turn(g: Column) -> Column:
        role = F.substring_index(F.substring(g, 4, 1 << 30), "\n", 1)
        text = F.substring(g, F.locate("\n", g) + 1, F.char_length(g))
        return F.concat(unescape(role, [LINE]), F.lit("\n"), unescape(text), F.lit("\n"))

    read = read.select("key", "window", F.size("segs").alias("n"), F.array_join(F.transform("segs", turn), "").alias("turns"), unescape(F.col("under")).alias("under"), "chars")
    whole = read.groupBy("key").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "under"))).alias("list"), F.sum("chars").alias("formatted_chars"))
    turns, under = F.array_join(F.col("list.turns"), ""), F.array_join(F.col("list.under"), "")
    return whole.select(
        F.when(~F.col("key.none"), F.col("key.id")).alias("conv_id"),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
