r"""Chat formatting into budgeted, turn-aligned windows.

A turn is written ``<turn>ROLE<text>TEXT</turn>``.  Inside roles and texts ``\`` becomes
``\b`` and ``<`` becomes ``\l``, so a marker never occurs in them and every text can be
read back.  Running sums of turn tokens deal a conversation's turns to windows: a window
has whole turns of at most the budget, or one longer turn.  Every window after the first
begins with the system turn and with the last turns of the window before, as far as the
history budget goes.  Only assistant texts are under the loss mask, and only in the
window where they are new: what a window repeats is masked.

Defined results: turns are ordered by turn number, then role and text, nulls first; a
null text or role is empty; rows that repeat are turns of their own; a null conv_id is
a conversation of its own.  The system turn is the first turn, if its role is
``system``.  Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlens.llm.common import table, text_or_empty

BUDGET = 1024
HISTORY = 256
#: Tokens that the markers of a turn count for.
TURN_TOKENS = 4
TOKEN_PATTERN = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"

OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _spans(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns with their window, whether new there, and their place in it."""
    conv = Window.partitionBy("conv_id")
    ordered = conv.orderBy("turn", "role", "text")
    t = (turns.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty().alias("text"))
         .withColumn("tokens", F.regexp_count("text", F.lit(TOKEN_PATTERN)).cast("long") + TURN_TOKENS)
         .withColumn("no", F.row_number().over(ordered))
         .withColumn("is_system", (F.col("no") == 1) & (F.col("role") == "system")))
    # A first system turn opens the first window and is repeated; it isn't summed.
    t = (t.withColumn("system_tokens", F.max(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(conv))
         .withColumn("room", F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(1)))
         .withColumn("end", F.sum(F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("begin", F.when(F.col("is_system"), F.col("end")).otherwise(F.col("end") - F.col("tokens"))))
    # Turns that end in one multiple of the room are together; the one that begins before it is alone.
    cell = F.floor((F.greatest(F.col("end"), F.lit(1)) - 1) / F.col("room"))
    t = t.withColumn("window", (2 * cell + (F.col("begin") >= cell * F.col("room")).cast("int")).cast("long"))
    # The system turn goes with the first of the others.
    t = t.withColumn("window", F.when(F.col("is_system"), F.coalesce(F.lead("window").over(ordered), F.lit(0))).otherwise(F.col("window")))
    span = (t.groupBy("conv_id", "window").agg(F.max("end").alias("stop"))
            .withColumn("next", F.lead("window").over(conv.orderBy("window")))
            .withColumn("is_first", F.row_number().over(conv.orderBy("window")) == 1))
    own = span.select(F.col("conv_id").alias("c"), F.col("window").alias("w"), "stop", "next")
    t = t.join(own, t.conv_id.eqNullSafe(own.c) & (t.window == own.w)).drop("c", "w")
    new = t.select("conv_id", "window", F.lit(True).alias("new"), "no", "role", "text")
    again = (t.filter(F.col("next").isNotNull() & ~F.col("is_system") & (F.col("stop") - F.col("begin") <= history))
             .select("conv_id", F.col("next").alias("window"), F.lit(False).alias("new"), "no", "role", "text"))
    system = t.filter("is_system").select(F.col("conv_id").alias("c"), "no", "role", "text")
    later = span.filter(~F.col("is_first")).select("conv_id", "window")
    kept = (later.join(system, later.conv_id.eqNullSafe(system.c))
            .select("conv_id", "window", F.lit(False).alias("new"), "no", "role", "text"))
    return new.unionAll(again).unionAll(kept)


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window (ordered, not gapless), text, n_turns,
    n_repeated (turns at its head that an earlier window has) and loss, the spans
    (array of start, length in code points of ``text``) that are learned."""
    piece = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY), escape(F.col("text")), F.lit(CLOSE))
    body = F.length(F.lit(OPEN)) + F.length(escape(F.col("role"))) + F.length(F.lit(BODY))
    parts = (_spans(turns, budget, history)
             .select("conv_id", "window", "no", "new", piece.alias("piece"), body.alias("body"),
                     F.length(escape(F.col("text"))).alias("size"), (F.col("new") & (F.col("role") == "assistant")).alias("learned"))
             .withColumn("at", F.coalesce(F.sum(F.length("piece")).over(
                 Window.partitionBy("conv_id", "window").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    rows = F.sort_array(F.collect_list(F.struct("no", "piece", "new", "learned", (F.col("at") + F.col("body")).alias("start"), "size")))
    return (parts.groupBy("conv_id", "window").agg(rows.alias("rows"))
            .select("conv_id", "window", F.array_join("rows.piece", "").alias("text"), F.size("rows").alias("n_turns"),
                    F.size(F.filter("rows", lambda r: ~r["new"])).alias("n_repeated"),
                    F.transform(F.filter("rows", lambda r: r["learned"]),
                                lambda r: F.struct(r["start"].alias("start"), r["size"].cast("long").alias("length"))).alias("loss")))


def read_windows(windows: DataFrame) -> DataFrame:
    """Windows read back from ``text``, ``n_repeated`` and ``loss`` alone: conv_id,
    window, turns (array of role, text; only new ones) and learned (array of texts)."""
    pieces = F.split("text", CLOSE)
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    new = F.slice(whole, F.col("n_repeated") + 1, F.size(whole))

    def parse(p: Column) -> Column:
        halves = F.split(F.substring(p, len(OPEN) + 1, F.length(p)), BODY)
        return F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(F.get(halves, F.lit(1))).alias("text"))

    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.select("conv_id", "window", F.transform(new, parse).alias("turns"), learned.alias("learned"),
                          F.length("text").cast("long").alias("chars"))


def digest(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows."""
    part = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_windows(windows).select("conv_id", "window", F.size("turns").alias("n"), part.alias("part"),
                                        F.array_join("learned", "").alias("learned"), "chars")
    w = F.sort_array(F.collect_list(F.struct("window", "part", "learned")))
    joined = read.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), w.alias("w"), F.sum("chars").alias("formatted_chars"))
    text, learned = F.array_join("w.part", ""), F.array_join("w.learned", "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return joined.select("conv_id", "n_turns", sha(text).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
                         sha(learned).alias("loss_sha256"), "formatted_chars")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -7, whose texts hold control strings."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return digest(format_windows(given.unionByName(added)))


ORACLE = r"""
WITH base AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t0 AS (SELECT *, len(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}+|[^\s\p{Z}\p{L}\p{M}\p{N}]')) + 4 AS tokens,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS no FROM base),
t1 AS (SELECT *, no = 1 AND role = 'system' AS sys FROM t0),
t2 AS (SELECT *, greatest(1024 - 256 - max(CASE WHEN sys THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id), 1) AS room,
         sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY no) AS fin FROM t1),
t3 AS (SELECT *, CASE WHEN sys THEN fin ELSE fin - tokens END AS beg, (greatest(fin, 1) - 1) // room AS cell FROM t2),
t4 AS (SELECT *, 2 * cell + (beg >= cell * room)::INT AS win0 FROM t3),
t5 AS (SELECT *, CASE WHEN sys THEN coalesce(lead(win0) OVER (PARTITION BY conv_id ORDER BY no), 0) ELSE win0 END AS win,
         13 + 6 + length(role) + length(text) + 2 * 0
           + (length(role) - length(replace(replace(role, '\', ''), '<', ''))) + (length(text) - length(replace(replace(text, '\', ''), '<', ''))) AS chars FROM t4),
sp AS (SELECT conv_id, win, max(fin) AS stop, lead(win) OVER (PARTITION BY conv_id ORDER BY win) AS nxt FROM t5 GROUP BY conv_id, win),
again AS (SELECT conv_id, sum(chars) AS c FROM t5 JOIN sp USING (conv_id, win) WHERE nxt IS NOT NULL AND NOT sys AND stop - beg <= 256 GROUP BY conv_id),
syst AS (SELECT t5.conv_id, any_value(chars) * (count(*) - 1) AS c FROM t5 JOIN sp ON t5.conv_id = sp.conv_id WHERE sys GROUP BY t5.conv_id),
agg AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
          coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY no), '') AS learned, sum(chars) AS c FROM t5 GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  (agg.c + coalesce(again.c, 0) + coalesce(syst.c, 0))::BIGINT AS formatted_chars
FROM agg LEFT JOIN again USING (conv_id) LEFT JOIN syst USING (conv_id)
"""
