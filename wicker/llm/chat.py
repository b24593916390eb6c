"""Chat formatting: turn-aligned windows within a token budget, the loss mask and the way back to the turns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Control strings of common chat templates, which texts may not contain unescaped.
CONTROLS = ["<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TURN, TEXT, END = CONTROLS[:3]


@dataclass(frozen=True)
class ChatFormat:
    """budget: tokens of a window; history_tokens and history_turns: what a window repeats of the turns before it."""

    budget: int = 1024
    history_tokens: int = 128
    history_turns: int = 2


def escape(text: Column) -> Column:
    """No control string stays: a backslash follows its first character; backslashes are doubled."""
    quoted = "|".join(c[0].replace("[", "\\[") + "(?=" + "".join("\\" + x if x in "[]|" else x for x in c[1:]) + ")" for c in CONTROLS)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({quoted})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    """The cost of a text: words and single marks, as a count that needs no vocabulary."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]")).cast("long") + 3


def format_conversations(turns: DataFrame, how: ChatFormat = ChatFormat()) -> DataFrame:
    """One row per window: conv_id, window (from 0), n_turns of the conversation, n_repeated (turns at the window's head
    that an earlier window had), first_turn (position of its first new turn), n_tokens, formatted, loss_spans (start
    and length in code points within formatted).

    Turns are ordered by turn, then role and text; rows that repeat count each. Prefix sums of the turns' tokens give
    the spans: a window takes new turns while system turn, repeated history and new turns stay within the budget, and
    always one new turn, even a longer one: no turn is cut or left out. The first turn is retained in every window if
    its role is system. History is the longest run of the latest turns within both limits that fits beside the first new turn. Assistant
    turns are targets in the window that has them as new turns; repeated ones are masked. A null text or role counts
    as empty, a null turn comes first, rows with a null conv_id form one conversation; an empty table gives no rows.
    A conversation is one row here: its digest and its windows need it whole."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = turns.select("conv_id", F.col("turn").alias("t"), role.alias("r"), text.alias("x"))
    one = one.select("conv_id", "t", "r", "x", tokens(F.col("x")).alias("n"), F.concat(F.lit(TURN), escape(F.col("r")), F.lit(TEXT), escape(F.col("x")), F.lit(END)).alias("piece"))
    one = one.withColumn("len", F.length("piece").cast("long")).withColumn("head", F.length(escape(F.col("r"))))
    before = Window.partitionBy("conv_id").orderBy("t", "r", "x").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("tok", F.sum("n").over(before)).withColumn("at", F.sum("len").over(before))
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("t", "r", "x", "tok", "at", "n", "len", "head", "piece"))).alias("s"))
    whole = whole.select("conv_id", *(F.expr(f"s.{c}") for c in ("n", "len", "head", "piece")), F.expr("s.r").alias("role"), *(F.concat(F.array(F.lit(0).cast("long")), F.expr(f"s.{c}")).alias(c) for c in ("tok", "at")))
    whole = whole.withColumn("sys", F.expr("if(role[0] = 'system' and size(n) > 1, 1, 0)"))
    # the state is where the open window begins, its history, and where windows began so far; positions are from 0
    history = f"filter(sequence(greatest(sys, i - {how.history_turns}), i), h -> tok[i] - tok[h] <= least({how.history_tokens}, {how.budget} - sys * n[0] - n[i]) or h = i)[0]"
    start = "named_struct('from', 0, 'hist', 0, 'starts', array(named_struct('b', 0, 'h', 0)))"
    opened = f"named_struct('from', i, 'hist', {history}, 'starts', concat(a.starts, array(named_struct('b', i, 'h', {history}))))"
    grown = f"if(tok[i + 1] - tok[a.hist] + if(a.from = 0, 0, sys * n[0]) <= {how.budget}, a, {opened})"
    whole = whole.withColumn("starts", F.expr(f"if(size(n) < 2, array(named_struct('b', 0, 'h', 0)), aggregate(sequence(1, size(n) - 1), {start}, (a, i) -> {grown}, a -> a.starts))"))
    window = """transform(starts, (w, k) -> named_struct(
        'window', k, 'b', w.b, 'h', w.h, 'e', if(k + 1 < size(starts), starts[k + 1].b, size(n)), 'sys', if(k = 0, 0, sys)))"""
    rows = whole.select("*", F.explode(F.expr(window)).alias("w"))
    base = "(w.sys * at[1] + at[w.b] - at[w.h])"
    span = f"named_struct('start', {base} + at[j] - at[w.b] + {len(TURN) + len(TEXT)} + head[j], 'length', len[j] - head[j] - {len(TURN) + len(TEXT) + len(END)})"
    return rows.select(
        "conv_id", F.col("w.window").cast("long").alias("window"), F.size("n").cast("long").alias("n_turns"),
        F.expr("cast(w.sys + w.b - w.h as long)").alias("n_repeated"), F.expr("cast(w.b as long)").alias("first_turn"),
        F.expr("w.sys * n[0] + tok[w.e] - tok[w.h]").alias("n_tokens"),
        F.expr("concat(if(w.sys = 1, piece[0], ''), array_join(slice(piece, w.h + 1, w.e - w.h), ''))").alias("formatted"),
        F.expr(f"transform(filter(sequence(w.b, w.e - 1), j -> role[j] = 'assistant'), j -> {span})").alias("loss_spans"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns (role and text), loss_text and formatted_chars, from the windows' formatted text and
    spans alone; turns that a window repeats are left out."""
    parts = windows.select(
        "conv_id", "window", F.length("formatted").cast("long").alias("chars"),
        F.expr(f"slice(split(formatted, '{_literal(TURN)}', -1), cast(n_repeated + 2 as int), 1000000000)").alias("new"),
        F.expr("transform(loss_spans, s -> substring(formatted, cast(s.start + 1 as int), cast(s.length as int)))").alias("loss"))
    turn = f"transform(new, x -> split(left(x, length(x) - {len(END)}), '{_literal(TEXT)}', 2))"
    parts = parts.select("conv_id", "chars", F.struct("window", F.expr(turn).alias("turns"), F.array_join("loss", "").alias("loss")).alias("p"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sum("chars").alias("formatted_chars"))
    turns = F.transform(F.flatten(F.col("p.turns")), lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))
    return whole.select("conv_id", F.expr("cast(size(flatten(p.turns)) as long)").alias("n_turns"), turns.alias("turns"), unescape(F.array_join("p.loss", "")).alias("loss_text"), "formatted_chars")


def _literal(marker: str) -> str:
    """A marker as a pattern, in a SQL string."""
    return "".join("\\\\" + c if c in "|[]" else c for c in marker)
