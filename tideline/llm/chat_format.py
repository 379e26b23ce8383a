"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A layout is known by the hash of its nested field paths. A table of mixed layouts has the columns of all of them, as a reader
of JSON lines gives them; a row's layout is the hash of the paths that hold something in that row (``row_fingerprint``),
and the mapping under that hash says, as SQL, how the row gives ``array<struct<role, text>>``. A table with one row for
each turn is known by the fingerprint of its schema and nested first. Turns are then written in one template whose
control strings cannot occur inside a text (they are escaped reversibly), with a loss mask over the assistants' texts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import let
from tideline.storage import read_table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings with a meaning in common chat templates; none may appear inside a formatted text.
CONTROL = r"(<)(?=\|im_start\||\|im_end\||\|endoftext\||/?s>|/?<SYS>>|</SYS>>)|(\[)(?=/?INST\])"

#: The columns of all layouts together.
FIELDS = (
    "messages array<struct<role: string, content: string>>, conversations array<struct<`from`: string, value: string>>, "
    "prompt string, response string, completion string, instruction string, input string, output string, question string, answer string"
)
#: Names that the from/value layout gives to roles.
FROM = {"human": "user", "gpt": "assistant"}


def _pair(user: str, assistant: str) -> str:
    return f"array(struct('user' as role, {user} as text), struct('assistant' as role, {assistant} as text))"


_ROLE = "case " + " ".join(f"when m.`from` = '{a}' then '{b}'" for a, b in FROM.items()) + " else m.`from` end"
#: layout -> (nested field paths, SQL that gives the turns).
MAPPINGS = {
    "messages": (("messages[].content", "messages[].role"), "transform(messages, m -> struct(m.role as role, m.content as text))"),
    "from_value": (("conversations[].from", "conversations[].value"), f"transform(conversations, m -> struct({_ROLE} as role, m.value as text))"),
    "prompt_response": (("prompt", "response"), _pair("prompt", "response")),
    "prompt_completion": (("completion", "prompt"), _pair("prompt", "completion")),
    "instruction": (("input", "instruction", "output"), _pair("concat_ws('\\n\\n', instruction, nullif(input, ''))", "output")),
    "instruction_output": (("instruction", "output"), _pair("instruction", "output")),
    "question_answer": (("answer", "question"), _pair("question", "answer")),
}
#: The table layout with one row for each turn.
TURN_ROWS = ("conv_id", "role", "text", "turn")


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Dotted paths of the leaves; ``[]`` marks an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def _held(kind: T.DataType, value: Column, at: str) -> list[tuple[str, Column]]:
    """Each leaf's path and whether ``value`` holds anything there (in any element of an array)."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _held(f.dataType, value.getField(f.name), f"{at}.{f.name}")]
    if isinstance(kind, T.ArrayType):

        def anywhere(leaf: int) -> Column:
            return F.coalesce(F.exists(value, lambda e: _held(kind.elementType, e, f"{at}[]")[leaf][1]), F.lit(False))

        return [(path, anywhere(leaf)) for leaf, path in enumerate(field_paths(kind, at))]
    return [(at, value.isNotNull())]


def _fitted(value: Column, own: T.DataType, kind: T.DataType) -> Column:
    """``value`` with the type ``kind``; fields of structs go by name."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        has = set(own.elementType.names)
        return F.transform(value, lambda e: F.struct(*((e[f.name] if f.name in has else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.elementType.fields)))
    return value.cast(kind)


def row_fingerprint(schema: T.StructType, fields: list[str]) -> Column:
    """The fingerprint of the paths under ``fields`` that hold something in a row; null where none does."""
    held = [x for f in schema.fields if f.name in fields for x in _held(f.dataType, F.col(f"`{f.name}`"), f.name)]
    paths = F.array_compact(F.array(*(F.when(has, F.lit(path)) for path, has in sorted(held, key=lambda x: x[0]))))
    return F.when(F.size(paths) > 0, F.sha2(F.array_join(paths, "\n"), 256))


def canonical_turns(df: DataFrame, id: str = "conv_id") -> DataFrame:
    """``conv_id, turns, layout, raw`` by fingerprints.

    A table with one row for each turn is nested: turns are ordered by turn (null last), role and text; repeated rows stay. Any
    other table is taken row by row: first by the paths of all its columns but the id, then by those that some mapping knows,
    so that extra fields do no harm. A row of no known layout keeps its whole content as JSON in ``raw`` and has null turns. A
    table none of whose columns a mapping knows raises ``ValueError``. Empty tables give empty results.
    """
    if fingerprint(p for p in field_paths(df.schema) if p in TURN_ROWS) == fingerprint(TURN_ROWS):
        return nest(df).select("conv_id", F.col("rows").alias("turns"), F.lit("turn_rows").alias("layout"), F.lit(None).cast("string").alias("raw"))
    known = T.StructType.fromDDL(FIELDS)
    own = {f.name: f.dataType for f in df.schema.fields}
    usable = [f.name for f in known.fields if f.name in own and set(field_paths(f.dataType, f.name)) & set(field_paths(own[f.name], f.name))]
    if not usable:
        raise ValueError(f"no mapping for a table with the fields {sorted(field_paths(df.schema))}")
    rows = df.select(
        F.col(id).alias("conv_id"),
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
        *((_fitted(F.col(f.name), own[f.name], f.dataType) if f.name in usable else F.lit(None).cast(f.dataType)).alias(f.name) for f in known.fields),
        row_fingerprint(df.schema, [c for c in df.columns if c != id]).alias("whole"),
    )
    rows = rows.withColumn("part", row_fingerprint(rows.schema, [f.name for f in known.fields]))
    turns, layout = F.lit(None).cast("array<struct<role: string, text: string>>"), F.lit(None).cast("string")
    for column in ("part", "whole"):  # what the whole row says comes last and so wins
        for name, (paths, sql) in MAPPINGS.items():
            hit = F.col(column) == fingerprint(paths)
            turns, layout = F.when(hit, F.expr(sql)).otherwise(turns), F.when(hit, F.lit(name)).otherwise(layout)
    return rows.select("conv_id", turns.alias("turns"), layout.alias("layout"), F.when(layout.isNull(), F.to_json("row")).alias("raw"))


def turns_from_json(df: DataFrame, payload: str, id: str) -> DataFrame:
    """``canonical_turns`` of JSON strings in any of the layouts; what is no object of a known layout comes back in ``raw``."""
    parsed = df.select(F.col(id).alias("conv_id"), F.col(payload).alias("_payload"), F.from_json(F.col(payload), FIELDS).alias("p")).select("conv_id", "_payload", "p.*")
    return canonical_turns(parsed).select("conv_id", "turns", "layout", F.get_json_object("raw", "$._payload").alias("raw"))


def nest(turns: DataFrame, chunk: int = 64) -> DataFrame:
    """``conv_id, rows``: the turns (role, text; null is empty) of each conversation in order. A long conversation meets in
    two steps, ``chunk`` turn numbers at a time."""
    row = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("t"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    part = turns.select("conv_id", F.floor(F.col("turn") / chunk).alias("c"), row.alias("row"))
    parts = part.groupBy("conv_id", "c").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit((1 << 63) - 1)).alias("c"), "rows"))).alias("parts"))
    return whole.select("conv_id", F.transform(F.flatten(F.transform("parts", lambda p: p["rows"])), lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows"))


def as_layouts(nested: DataFrame) -> DataFrame:
    """``conv_id`` and the columns of all layouts, each conversation in one: a user's and an assistant's turn alone in one of the
    five paired layouts, the others as messages or, where every role has a name there, as from/value; by a hash of the id.
    The inverse of ``canonical_turns``: a table as it would come from several sources."""
    r = F.col("rows")
    pick = lambda n: F.pmod(F.xxhash64("conv_id"), F.lit(n))
    paired = (F.size(r) == 2) & (F.get(r, F.lit(0))["role"] == "user") & (F.get(r, F.lit(1))["role"] == "assistant")
    named = F.forall(r, lambda t: t["role"].isin(*FROM.values()))
    kind = F.when(paired, pick(5)).when(named & (pick(2) == 0), 5).otherwise(6)
    first, second = F.get(r, F.lit(0))["text"], F.get(r, F.lit(1))["text"]
    back = F.lit(None).cast("string")
    role = lambda t: F.coalesce(*(F.when(t["role"] == b, F.lit(a)) for a, b in FROM.items()), back)
    tagged = nested.withColumn("kind", kind)
    on = lambda *kinds: F.col("kind").isin(*kinds)
    return tagged.select(
        "conv_id",
        F.when(on(6), F.transform(r, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("messages"),
        F.when(on(5), F.transform(r, lambda t: F.struct(role(t).alias("from"), t["text"].alias("value")))).alias("conversations"),
        F.when(on(0, 1), first).alias("prompt"),
        F.when(on(0), second).alias("response"),
        F.when(on(1), second).alias("completion"),
        F.when(on(2, 3), first).alias("instruction"),
        F.when(on(2), F.lit("")).alias("input"),
        F.when(on(2, 3), second).alias("output"),
        F.when(on(4), first).alias("question"),
        F.when(on(4), second).alias("answer"),
    )


def escape(text: Column) -> Column:
    """A backslash before each backslash and inside each control string; ``unescape`` drops them again."""
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for char, code in (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def unescape_role(role: Column) -> Column:
    for char, code in (("[", "%5B"), ("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def format_chat(convs: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of ``conv_id, turns``.

    A span says which turn, and the start (from 0) and length of the assistant's text inside that turn's own piece of
    ``formatted``, which ends with END: no offset depends on the turns before, so that time grows with the length of a
    conversation. A null text or role is empty; null turns are none. An empty table gives an empty result.
    """
    turns = F.coalesce("turns", F.array().cast("array<struct<role: string, text: string>>"))
    piece = lambda t: F.struct((F.coalesce(t["role"], F.lit("")) == "assistant").alias("a"), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"))

    def written(made: Column) -> Column:
        text = F.array_join(F.transform(made, lambda m: F.concat(m["head"], m["body"], F.lit(END))), "")
        spans = F.transform(made, lambda m, k: F.when(m["a"], F.struct(k.alias("turn"), F.length(m["head"]).alias("start"), F.length(m["body"]).alias("length"))))
        return F.struct(text.alias("formatted"), F.array_compact(spans).alias("loss_spans"))

    return convs.select("conv_id", let(F.transform(turns, piece), written).alias("x")).select("conv_id", "x.formatted", "x.loss_spans")


def parse_chat(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text, formatted`` read back from the output alone."""
    turn = lambda p: F.struct(
        unescape_role(F.regexp_extract(p, r"^<\|im_start\|>([^\n]*)\n", 1)).alias("role"),
        unescape(F.regexp_replace(p, r"^<\|im_start\|>[^\n]*\n", "")).alias("text"),
    )

    def read(pieces: Column) -> Column:
        masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.get(pieces, s["turn"]), s["start"] + 1, s["length"])))
        return F.struct(F.transform(pieces, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"))

    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    return formatted.select("conv_id", let(pieces, read).alias("x"), "formatted").select("conv_id", "x.turns", "x.loss_text", "formatted")


#: Conversation -1: both sides say control strings.
PLANTED = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select(*TURN_ROWS)
    own = spark.sql(f"select -1L as conv_id, role, '{PLANTED}' as text, turn from values ('user', 0L), ('assistant', 1L) as t(role, turn)")
    mixed = as_layouts(nest(table.unionByName(own)))
    read = parse_chat(format_chat(canonical_turns(mixed)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(text, '\', '\\'),
    '<(\|im_start\||\|im_end\||\|endoftext\||/?s>|/?<SYS>>|</SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g'), '^$', '') AS body FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(length(replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B')) + length(body) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
