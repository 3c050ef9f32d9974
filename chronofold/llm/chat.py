"""Chat formatting into budgeted, turn-aligned windows, in DataFrame operations only.

A turn is written ``[role]text[/]`` with the control characters of role and
text escaped (``\\`` ``[`` ``]`` ``<`` become a backslash and one letter), so no
text can open or close a turn and the original is restored exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Workspace

#: Fixed escape pairs of the template: character, then its letter after a backslash.
ESCAPES = (("[", "o"), ("]", "c"), ("<", "t"))
TURN_END = "[/]"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for char, letter in ESCAPES:
        c = F.replace(c, F.lit(char), F.lit("\\" + letter))
    return c


def unescape(c: Column) -> Column:
    """Inverse of :func:`escape`: halves between doubled backslashes hold only letter escapes."""

    def part(p: Column) -> Column:
        for char, letter in ESCAPES:
            p = F.replace(p, F.lit("\\" + letter), F.lit(char))
        return p

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit("["), escape(role), F.lit("]"), escape(text), F.lit(TURN_END))


def format_windows(rows: DataFrame, budget: int = 1024, history: int = 192, target_role: str = "assistant") -> DataFrame:
    """Windows of whole turns: conv_id, window_no, formatted, loss_spans, n_repeated, n_tokens.

    ``rows`` has conv_id, turn, role, text; other columns are not read.  Turns
    are ordered by (turn, role, text), so ties and repeated rows keep a defined
    place; null roles and texts count as empty; rows of a null conv_id form one
    conversation.  A turn costs its white-space-separated words plus two.
    Prefix sums of these costs cut the turns after a leading system turn into
    spans: a window holds the system turn, up to ``history`` tokens of the turns
    before its span, and the span.  No turn is cut.  A window has at most
    ``budget`` tokens, unless the system turn and one turn of its own are larger
    together: then it holds just these two (or that one, without a system turn).
    ``loss_spans`` are (start, length) in characters of ``formatted`` over the
    texts of the target turns of the span only, so repeated targets are masked
    and each is learnt once.  An empty table gives no windows.

    A conversation's turns are gathered in one row while its spans are chosen,
    so it has to fit in a row; each window then carries its own turns only.
    """
    if budget < 1 or history < 0:
        raise ValueError("budget must be positive and history not negative")
    cost = F.regexp_count("text", F.lit(r"\S+")).cast("long") + 2
    base = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tok", cost)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    item = F.struct(F.col("i"), F.col("cum"), F.col("tok"), F.col("role"), F.col("text"))
    convs = (
        base.withColumns({"cum": F.sum("tok").over(order), "i": F.count(F.lit(1)).over(order).cast("int") - 1})
        .groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("turns"))
        .withColumn("n_sys", (F.get("turns", F.lit(0))["role"] == "system").cast("int"))
        .withColumn("sys_tok", F.when(F.col("n_sys") == 1, F.get("turns", F.lit(0))["tok"]).otherwise(F.lit(0)).cast("long"))
    )
    first = F.struct(F.array(F.col("n_sys")).alias("starts"), F.col("sys_tok").alias("before"))

    free = F.greatest(F.lit(budget).cast("long") - F.col("sys_tok"), F.lit(0).cast("long"))
    reserve = F.least(F.lit(history).cast("long"), F.floor(free / 2))  # kept free for history after the first span

    def step(acc: Column, x: Column) -> Column:
        room = F.col("free") - F.when(F.size(acc["starts"]) > 1, F.col("reserve")).otherwise(F.lit(0))
        start = x["cum"] - x["tok"]
        cut = (x["i"] > F.col("n_sys")) & (x["cum"] - acc["before"] > room) & (start > acc["before"])
        return F.struct(F.when(cut, F.array_append(acc["starts"], x["i"])).otherwise(acc["starts"]).alias("starts"), F.when(cut, start).otherwise(acc["before"]).alias("before"))

    body = F.slice("turns", F.col("n_sys") + 1, F.greatest(F.size("turns") - F.col("n_sys"), F.lit(0)))
    spans = convs.withColumns({"free": free, "reserve": reserve}).withColumn("starts", F.aggregate(body, first, step)["starts"])
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("turns")))

    def place(x: Column, no: Column) -> Column:
        """A span with its tokens before and the room it leaves for history."""
        turn = F.get("turns", x["s"])
        at = F.coalesce(turn["cum"] - turn["tok"], F.col("sys_tok"))
        own = F.coalesce(F.get("turns", x["e"] - 1)["cum"], F.col("sys_tok")) - at
        return F.struct(no.alias("no"), x["s"].alias("s"), x["e"].alias("e"), at.alias("at"), F.least(F.lit(history).cast("long"), F.col("free") - own).alias("room"))

    def recall(x: Column) -> Column:
        """How many turns before the span its room holds; a turn costs two tokens or more."""
        most = F.least(F.lit(history // 2), x["s"] - F.col("n_sys"))
        held = F.filter(F.slice("turns", x["s"] - most + 1, most), lambda t: x["at"] - (t["cum"] - t["tok"]) <= x["room"])
        return F.struct(x["no"].alias("no"), x["s"].alias("s"), x["e"].alias("e"), F.size(held).alias("n_hist"))

    def gather(x: Column) -> Column:
        """The window's own turns, so that no window carries the whole conversation."""
        kept = F.concat(F.slice("turns", F.lit(1), F.col("n_sys")), F.slice("turns", x["s"] - x["n_hist"] + 1, x["e"] - x["s"] + x["n_hist"]))
        return F.struct(x["no"].alias("window_no"), x["s"].alias("s"), x["n_hist"].alias("n_hist"), kept.alias("kept"))

    placed = F.transform(F.arrays_zip(F.col("starts").alias("s"), ends.alias("e")), place)
    spans = spans.select("conv_id", "n_sys", F.explode(F.transform(F.transform(placed, recall), gather)).alias("w"))
    spans = spans.select("conv_id", "w.window_no", "w.s", "w.kept", (F.when(F.col("w.window_no") > 0, F.col("n_sys")).otherwise(F.lit(0)) + F.col("w.n_hist")).alias("n_repeated"))
    pieces = F.transform("kept", lambda x: F.struct(((x["role"] == target_role) & (x["i"] >= F.col("s"))).alias("loss"), escape(x["role"]).alias("role"), escape(x["text"]).alias("text"), x["tok"].alias("tok")))
    spans = spans.select("conv_id", "window_no", "n_repeated", pieces.alias("p"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def mark(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["role"]) + 2
        span = F.struct(start.alias("start"), F.length(p["text"]).alias("length"))
        return F.struct((start + F.length(p["text"]) + len(TURN_END)).alias("at"), F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    joined = F.array_join(F.transform("p", lambda p: F.concat(F.lit("["), p["role"], F.lit("]"), p["text"], F.lit(TURN_END))), "")
    tokens = F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + p["tok"])
    return spans.select("conv_id", "window_no", joined.alias("formatted"), F.aggregate("p", empty, mark)["spans"].alias("loss_spans"), "n_repeated", tokens.alias("n_tokens"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Undo the template from the windows alone: one row per conversation.

    Turns repeated as history or as system turn are counted once; the loss text
    is what the loss spans cover, unescaped.
    """
    pieces = F.split("formatted", r"\[/\]", -1)
    new = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0)))
    turns = F.transform(new, lambda p: F.struct(unescape(F.substr(F.substring_index(p, "]", 1), F.lit(2))).alias("role"), unescape(F.substr(p, F.length(F.substring_index(p, "]", 1)) + 2)).alias("text")))
    loss = F.transform("loss_spans", lambda x: unescape(F.substr(F.col("formatted"), x["start"] + 1, x["length"])))
    part = windows.select("conv_id", F.struct("window_no", turns.alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").cast("long").alias("chars")).alias("w"))
    whole = part.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return whole.select("conv_id", F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"), F.array_join(F.transform("w", lambda w: w["loss"]), "").alias("loss_text"), F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w["chars"]).alias("formatted_chars"))


def chat_digest(rows: DataFrame, budget: int = 1024, history: int = 192) -> DataFrame:
    """Format all conversations, write the windows, read them back, and digest what was read.

    A conversation is one row of the result, so its whole text has to fit in a
    row (2 GB); conversations are independent of each other.
    """
    work = Workspace(rows.sparkSession, "chat")
    windows = work.table(format_windows(rows, budget, history), "windows")
    back = read_windows(windows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars",
    )
