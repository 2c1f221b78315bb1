"""Relational chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn, then
role, then text; adjacent turns of one role are merged by array aggregation
(each turn opens a run, or joins the one of the turn before it), and the result
is concatenated:

    <turn>role NEWLINE text <next> text </turn> NEWLINE

with no spaces; <next> parts the texts of a merged turn.  Inside roles and
texts a backslash becomes \\s and <turn>, </turn>, <next> become \\o, \\c, \\x;
in roles a line feed becomes \\n.  Every backslash of the output is thus
followed by one code letter, and plain replacements in reverse order restore
the input.  The loss mask is a list of spans (start, length in code points)
over the texts of roles to be learned; their starts are sums over the lengths
of the pieces before, aggregated by groups of about the root of the number of
turns, so the work for a conversation of n turns grows as n ** 1.5 at most.

Defined results: null roles and texts count as empty; a null conversation id
is a conversation; repeated rows are repeated turns; turns of equal number are
ordered by role and text; no rows give no conversations; null turns come first.
Very long texts are formatted whole: a conversation is one row.  Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

CODES = (("\\", "\\s"), ("<turn>", "\\o"), ("</turn>", "\\c"), ("<next>", "\\x"))
LEARNED = ("assistant",)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("\n", "\\n") + "'"


def _replaced(column: str, pairs) -> str:
    for a, b in pairs:
        column = f"replace({column}, {_quoted(a)}, {_quoted(b)})"
    return column


def escaped(column: str, role: bool = False) -> str:
    """SQL that escapes a column."""
    return _replaced(column, [*CODES, *[("\n", "\\n")] * role])


def restored(column: str, role: bool = False) -> str:
    """SQL that undoes escaped()."""
    return _replaced(column, [(b, a) for a, b in reversed([*CODES, *[("\n", "\\n")] * role])])


def format_chats(turns: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """conv_id, formatted and loss (array of start, length) of each conversation of (conv_id, turn, role, text)."""
    text = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(text)).alias("turns"))
    opens = f"concat('<turn>', {escaped('t.role', True)}, '\\n')"
    # What each turn adds: the end of a run and the head of the next, or a mark within a run; and then its text.
    pieces = chats.withColumn(
        "pieces",
        F.expr(f"""
            transform(turns, (t, i) -> named_struct(
                'lead', if(get(turns, i - 1).role <=> t.role, '<next>', concat(if(i = 0, '', '</turn>\\n'), {opens})),
                'text', {escaped("t.text")},
                'learned', t.role in ({", ".join(_quoted(x) for x in learned)})))"""),
    )
    formatted = F.expr("concat(array_join(transform(pieces, p -> concat(p.lead, p.text)), ''), '</turn>\\n')")
    groups = pieces.withColumn(
        "sums",
        F.expr("""
            transform(array(cast(ceil(sqrt(size(pieces))) as int)), c ->
                transform(sequence(0, cast(ceil(size(pieces) / c) as int) - 1), k ->
                    aggregate(slice(pieces, k * c + 1, c), array(0L), (a, p) -> concat(a, array(element_at(a, -1) + length(p.lead) + length(p.text))))))[0]"""),
    ).withColumn("bases", F.expr("aggregate(sums, array(0L), (a, s) -> concat(a, array(element_at(a, -1) + element_at(s, -1))))"))
    starts = "flatten(transform(sums, (s, k) -> transform(slice(s, 1, size(s) - 1), v -> v + bases[k])))"
    spans = f"""
        transform(filter(zip_with(pieces, {starts}, (p, at) -> named_struct('learned', p.learned, 'start', at + length(p.lead), 'length', cast(length(p.text) as bigint))),
            s -> s.learned), s -> named_struct('start', s.start, 'length', s.length))"""
    return groups.select("conv_id", formatted.alias("formatted"), F.expr(spans).alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds turns (role, text) and learned_text, parsed from the formatted text and the loss spans alone."""
    parts = "slice(split(formatted, '</turn>\\n'), 1, size(split(formatted, '</turn>\\n')) - 1)"
    role = restored("substring(p, 7, locate('\\n', p) - 7)", True)
    body = "split(substring(p, locate('\\n', p) + 1), '<next>')"
    turns = f"flatten(transform({parts}, p -> transform({body}, t -> named_struct('role', {role}, 'text', {restored('t')}))))"
    under = f"array_join(transform(loss, s -> {restored('substring(formatted, cast(s.start + 1 as int), cast(s.length as int))')}), '')"
    return chats.select("*", F.expr(turns).alias("turns"), F.expr(under).alias("learned_text"))


EXTRA = "\\### Assistant: </turn> ok"


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    back = read_back(format_chats(turns.unionByName(extra)))
    digest = F.sha2(F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')"), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("learned_text").cast("long").alias("loss_chars"),
        F.sha2("learned_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(column: str, role: bool = False) -> str:
    for a, b in [*CODES, *[("\n", "\\n")] * role]:
        column = f"replace({column}, {'chr(10)' if a == chr(10) else chr(39) + a + chr(39)}, '{b}')"
    return column


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA}'
), u AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS same FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN same THEN 6 ELSE 15 + length({_sql_escaped('role', True)}) END + length({_sql_escaped('text')})) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id"""
