"""Chat formatting by schema fingerprints; DataFrame functions only.

A record is a JSON text, or a struct, of any known layout. The nested paths of its fields, without their types, are hashed;
the hash picks a declarative mapping that gives canonical turns (role, content). Turns are written as
``<|im_start|>role<|im_sep|>content<|im_end|>`` and a line feed, with spans (start, length) of what a model is trained on:
the contents of assistant turns. In roles and contents a backslash is doubled, and every control string gets a backslash
behind its first character; taking a backslash away before any character undoes both.

Cases: null and absent fields are empty texts; a record without turns formats to an empty text; a record that is null, no
JSON or of an unknown layout has null layout, turns and text; repeated rows stay repeated; turns that tie come in
order of role and text; an empty table gives no rows; columns other than id and record play no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed strings that mark turns in this or other templates.
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class Layout:
    """Either a list of messages at ``items`` with the fields ``role`` and ``content`` and other names of roles,
    or ``turns``: a role and the fields whose texts, where not empty, make up its content."""

    name: str
    items: str = ""
    role: str = "role"
    content: str = "content"
    names: dict[str, str] = field(default_factory=dict)
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def paths(self) -> str:
        if self.items:
            first, second = sorted((self.role, self.content))
            return f"OBJECT<{self.items}: ARRAY<OBJECT<{first}: , {second}: >>>"
        return "OBJECT<" + ", ".join(f"{f}: " for f in sorted(f for _, fields in self.turns for f in fields)) + ">"

    def fields(self) -> set[str]:
        return {self.items} if self.items else {f for _, fields in self.turns for f in fields}

    def canonical(self, v: Column) -> Column:
        """Turns of a variant."""
        return self.read(lambda f: F.try_variant_get(v, f"$.{f}", "string"), lambda f: F.try_variant_get(v, f"$.{f}", f"array<struct<{self.role}:string,{self.content}:string>>"))

    def read(self, text: Callable[[str], Column], listed: Callable[[str], Column]) -> Column:
        """Turns, from what a field of texts and the field of messages hold."""
        if not self.items:
            made = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[F.coalesce(text(f), F.lit("")) for f in fields]), lambda x: x != ""), "\n\n").alias("content")) for role, fields in self.turns]
            return F.array(*made).cast(TURNS)
        got = listed(self.items)

        def turn(x: Column) -> Column:
            role = F.coalesce(x[self.role], F.lit(""))
            for other, name in self.names.items():
                role = F.when(x[self.role] == other, name).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(x[self.content], F.lit("")).alias("content"))

        return F.coalesce(F.transform(got, turn), F.array().cast(TURNS))


LAYOUTS = (
    Layout("messages", items="messages"),
    Layout("shared", items="conversations", role="from", content="value", names={"human": "user", "gpt": "assistant"}),
    Layout("prompt_response", turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system_prompt_response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question_answer", turns=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(v: Column) -> Column:
    """Hash of the nested field paths of a variant; values and their types play no part."""
    paths = F.regexp_replace(F.schema_of_variant(v), r"\b(STRING|VOID|BIGINT|DOUBLE|BOOLEAN|VARIANT|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "")
    return F.xxhash64(F.regexp_replace(paths, r": ARRAY<>", ": ARRAY"))


def canonical_turns(records: DataFrame, id_col: str, record_col: str, layouts=LAYOUTS) -> DataFrame:
    """(id, layout, turns) per row of records; null for a record that Spark's variant does not hold, as of a text of over 20 million characters."""
    parsed = records.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(record_col).cast("string")).alias("v")).withColumn("print", fingerprint(F.col("v")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        is_it = F.col("print") == F.xxhash64(F.lit(layout.paths()))
        if layout.items:  # a list without members has the same paths up to the list
            is_it = is_it | (F.col("print") == F.xxhash64(F.lit(f"OBJECT<{layout.items}: ARRAY>")))
        name, turns = F.when(is_it, layout.name).otherwise(name), F.when(is_it, layout.canonical(F.col("v"))).otherwise(turns)
    return parsed.select("id", name.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """(id, layout, text, spans) from canonical turns."""
    ready = turns.select("id", "layout", F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("loss"), F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("head"), escape(t["content"]).alias("body"))).alias("t"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["head"])
        span = F.array(F.struct((begin + 1).alias("start"), F.length(t["body"]).alias("length")))
        return F.struct((begin + F.length(t["body"]) + len(END)).alias("at"), F.when(t["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return ready.select("id", "layout", text.alias("text"), F.aggregate("t", nothing, step)["spans"].alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(id, turns, trained, n_chars): turns parsed from the text and the unescaped texts under the mask."""
    bodies = F.filter(F.split("text", r"<\|im_end\|>\n"), lambda x: x != "")
    header = len(START)

    parts = F.transform(bodies, lambda x: F.split(x, r"<\|im_sep\|>", 2))
    turns = F.transform(parts, lambda p: F.struct(unescape(F.substring(p[0], header + 1, 1 << 30)).alias("role"), unescape(p[1]).alias("content")))
    trained = F.transform("spans", lambda s: unescape(F.substring(F.col("text"), s["start"], s["length"])))
    return formatted.select("id", turns.alias("turns"), trained.alias("trained"), F.length("text").alias("n_chars"))


def _shape(value: Column, kind: T.DataType) -> Column:
    """value with its texts emptied and one member of each shape in its lists: it has the paths of value, at a small size."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_shape(value[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.array_distinct(F.transform(value, lambda x: _shape(x, kind.elementType)))
    return F.when(value.isNotNull(), F.lit(""))


def nested_turns(records: DataFrame, id_col: str, record_col: str, layouts: tuple[Layout, ...]) -> DataFrame:
    """(id, layout, turns) per row of records: as canonical_turns, of records that are structs, whose null fields count as absent.

    The fingerprint is that of the record's shape, so that no text is put into JSON, whose size is limited.
    """
    kind = records.schema[record_col].dataType
    record = F.col(record_col)
    shape = F.parse_json(F.to_json(_shape(record, kind), {"ignoreNullFields": "true"}))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        if layout.fields() <= set(kind.fieldNames()):  # no record has a field that the struct has not
            is_it = F.col("print") == F.xxhash64(F.lit(layout.paths()))
            if layout.items:
                is_it = is_it | (F.col("print") == F.xxhash64(F.lit(f"OBJECT<{layout.items}: ARRAY>")))
            made = layout.read(lambda f: F.col("record")[f], lambda f: F.col("record")[f])
            name, turns = F.when(is_it, layout.name).otherwise(name), F.when(is_it, made).otherwise(turns)
    return records.select(F.col(id_col).alias("id"), record.alias("record"), fingerprint(shape).alias("print")).select("id", name.alias("layout"), turns.alias("turns"))


def nested_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, record): rows by turn as structs, in the layout that a conversation's roles fit; the fields of other layouts are null."""
    turn = F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("m"))
    roles, text = F.transform(F.slice("m", 1, 4), lambda x: x["role"]), lambda k: F.get("m", F.lit(k))["content"]
    two, three = (roles == F.array(*map(F.lit, names)) for names in (("user", "assistant"), ("system", "user", "assistant")))
    talk = F.forall("m", lambda x: x["role"].isin("user", "assistant"))
    shared = F.transform("m", lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"), x["content"].alias("value")))
    plain = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    record = F.struct(
        F.when(three, text(0)).alias("system"),
        F.when(two, text(0)).when(three, text(1)).alias("prompt"),
        F.when(two, text(1)).when(three, text(2)).alias("response"),
        F.when(~two & ~three & talk, shared).alias("conversations"),
        F.when(~two & ~three & ~talk, plain).alias("messages"),
    )
    return grouped.select("id", record.alias("record"))


def records_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, record): those of nested_records as JSON texts."""
    return nested_records(rows, id_col, turn_col, role_col, text_col).select("id", F.to_json("record", {"ignoreNullFields": "true"}).alias("record"))


def turns_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, layout, turns): what canonical_turns makes of records_of(rows), for texts of any size: through the same mappings, from structs."""
    return nested_turns(nested_records(rows, id_col, turn_col, role_col, text_col), "id", "record", LAYOUTS)


def op10_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema))
    back = read_back(format_turns(turns_of(rows)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return back.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("n_chars").cast("long").alias("formatted_chars"),
    )
