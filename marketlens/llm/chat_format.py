"""Chat formatting by schema fingerprinting.

Records of many layouts (prompt and response, instruction and input, message lists, one row per turn) sit in one
table whose columns are the union of the layouts. A record's layout is the set of nested field paths that are not
null in it (array elements count as ``[]``); the hash of that set, the schema fingerprint, picks the mapping that
turns the record into canonical turns (role, text). Mappings are declared, not programmed: lists of ``Turn``
and ``Each`` over field paths. Paths that a layout may lack are declared optional, and each combination has its
fingerprint. Records of an unknown layout give no turns; ``layouts`` reports them with their paths.

``format_turns`` writes every turn between its role's marks and says which characters of the output carry loss (texts of
the ``loss_roles``). Control strings inside a text, and inside the names of roles the template does not know,
are broken by a backslash after their first character, backslashes are doubled: no mark can be forged, and
``unescape`` gives the text back. ``read_back`` parses the output of a conversation, row by row in order, as a stream:
however long a conversation is, a task holds one Arrow batch of it.

Null role or text counts as empty. Turns are ordered by turn number (null first), place in the record,
role and text; repeated rows are turns of their own. Rows with a null conversation id form one conversation, whose id is
null. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Turn:
    """One turn: ``role`` is a constant, or a path if it starts with ``$``; ``text`` lists the paths joined by a blank line."""

    role: str
    text: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for every element of the array at ``path``; ``role`` and ``text`` are fields of the element.

    ``roles`` renames roles, such as ``human`` to ``user``.
    """

    path: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Mapping:
    """Turns of the records whose non-null paths are ``required`` and any of ``optional``."""

    name: str
    required: tuple[str, ...]
    turns: tuple[Turn | Each, ...]
    optional: tuple[str, ...] = ()

    def layouts(self) -> Iterator[tuple[str, ...]]:
        subsets = chain.from_iterable(combinations(self.optional, k) for k in range(len(self.optional) + 1))
        return (tuple(sorted({*self.required, *more})) for more in subsets)


ROWS = Mapping("turn rows", (), (Turn("$role", ("text",)),), optional=("turn", "role", "text"))
PROMPT = Mapping("prompt and response", ("prompt", "response"), (Turn("user", ("prompt",)), Turn("assistant", ("response",))))
INSTRUCTION = Mapping("instruction", ("instruction", "output"), (Turn("user", ("instruction", "input")), Turn("assistant", ("output",))),
                      optional=("input",))
MESSAGES = Mapping("messages", ("messages[].role", "messages[].content"), (Each("messages", "role", "content"),))
SHARED = Mapping("from and value", ("conversations[].from", "conversations[].value"),
                 (Each("conversations", "from", "value", {"human": "user", "gpt": "assistant"}),))
MAPPINGS = (ROWS, PROMPT, INSTRUCTION, MESSAGES, SHARED)


def fingerprint(paths: tuple[str, ...]) -> str:
    """Hash of a layout's sorted paths: 32 hex digits."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:32]


def _leaves(kind: T.DataType) -> list[list[str]]:
    """Steps from a value of type ``kind`` to each of its leaves: field names, and ``[]`` into an array."""
    if isinstance(kind, T.StructType):
        return [[f.name, *rest] for f in kind for rest in _leaves(f.dataType)]
    if isinstance(kind, T.ArrayType):
        return [["[]", *rest] for rest in _leaves(kind.elementType)]
    return [[]]


def _present(value: Column, steps: list[str]) -> Column:
    """Whether a non-null leaf lies at ``steps`` below ``value`` (for an array: in some element)."""
    if not steps:
        return value.isNotNull()
    if steps[0] == "[]":
        return F.coalesce(F.exists(value, lambda e: _present(e, steps[1:])), F.lit(False))
    return _present(value.getField(steps[0]), steps[1:])


def _descend(value: Column, path: str) -> Column:
    for name in path.split("."):
        value = value.getField(name)
    return value


def layout_paths(records: DataFrame, columns: list[str]) -> Column:
    """Sorted non-null field paths of a record over ``columns``, a line each."""
    found = {".".join([c, *steps]).replace(".[]", "[]"): _present(F.col(c), steps)
             for c in columns for steps in _leaves(records.schema[c].dataType)}
    return F.concat_ws("\n", *[F.when(found[path], F.lit(path)) for path in sorted(found)])


def layouts(records: DataFrame, columns: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Layouts in use: fingerprint, paths, the mapping's name (null if unknown) and the number of records."""
    names = {fingerprint(p): m.name for m in mappings for p in m.layouts()}
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return records.groupBy(layout_paths(records, columns).alias("paths")).agg(F.count("*").alias("records")) \
        .withColumn("fingerprint", F.substring(F.sha2("paths", 256), 1, 32)).withColumn("mapping", F.try_element_at(known, "fingerprint"))


def _value(records: DataFrame, path: str) -> Column:
    """The field at a dotted path as a string; null if the table has no such column."""
    head = path.split(".")[0]
    return F.col(path).cast("string") if head in records.columns else F.lit(None).cast("string")


def _element_turn(t: Each):
    """Function from an array element to its turn."""
    def turn(e: Column) -> Column:
        named = F.coalesce(_descend(e, t.role).cast("string"), F.lit(""))
        role = named
        for old, new in t.roles.items():
            role = F.when(named == old, F.lit(new)).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(_descend(e, t.text).cast("string"), F.lit("")).alias("text"))

    return turn


def _turns(records: DataFrame, mapping: Mapping) -> Column:
    """array<struct<role, text>> of a record by ``mapping``."""
    parts = []
    for t in mapping.turns:
        if isinstance(t, Each):
            parts.append(F.transform(F.col(t.path), _element_turn(t)))
            continue
        role = F.coalesce(_value(records, t.role[1:]), F.lit("")) if t.role.startswith("$") else F.lit(t.role)
        parts.append(F.array(F.struct(role.alias("role"), F.concat_ws("\n\n", *[_value(records, p) for p in t.text]).alias("text"))))
    return F.concat(*parts)


def canonical_turns(records: DataFrame, id_col: str = "conv_id", order_col: str | None = "turn",
                    mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id, turn, place, role, text): the turns of every record of a known layout.

    All columns but ``id_col`` take part in the layout if some mapping names them. ``turn`` is ``order_col`` (null if
    the record has none), ``place`` the position within the record.
    """
    named = {re.split(r"[.\[]", p)[0] for m in mappings for p in (*m.required, *m.optional)}
    columns = [c for c in records.columns if c in named and c != id_col]
    usable = [m for m in mappings if {re.split(r"[.\[]", p)[0] for p in m.required} <= set(columns)]
    print_ = F.substring(F.sha2(layout_paths(records, columns), 256), 1, 32)
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in usable:
        turns = F.when(F.col("__print").isin(sorted({fingerprint(p) for p in m.layouts()})), _turns(records, m)).otherwise(turns)
    order = F.col(order_col).cast("long") if order_col in records.columns else F.lit(None).cast("long")
    return records.withColumn("__print", print_).select(F.col(id_col).alias("id"), order.alias("turn"), F.posexplode(turns).alias("place", "t")) \
        .select("id", "turn", "place", F.col("t.role").alias("role"), F.col("t.text").alias("text"))


@dataclass(frozen=True)
class Template:
    """Marks around the texts of known roles; other roles (and texts in them) use ``other``, which names the role.

    ``controls`` are the strings that never occur in the output but as marks.
    """

    roles: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    loss_roles: tuple[str, ...]
    controls: tuple[str, ...]

    @property
    def control_pattern(self) -> str:
        """Alternatives, longest first, as (first character)(rest); plain characters only."""
        return "|".join(re.escape(c) for c in sorted(self.controls, key=lambda c: (-len(c), c)))

    def marks(self) -> re.Pattern:
        """A formatted turn: one group pair per known role, and the role name and text of any other."""
        forms = [re.escape(a) + r"(.*?)" + re.escape(b) for a, b in self.roles.values()]
        a, b, c = map(re.escape, self.other)
        return re.compile("|".join([*forms, f"{a}(.*?){b}(.*?){c}"]), re.DOTALL)


INSTRUCT = Template(
    roles={"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")},
    other=("[ROLE]", "[TEXT]", "[/TEXT]"), loss_roles=("assistant",),
    controls=("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/TEXT]"))


def escape(text: Column, template: Template) -> Column:
    """``text`` without control strings: backslashes doubled, one more behind the first character of each control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in sorted(template.controls, key=lambda c: (-len(c), c)):
        doubled = F.replace(doubled, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return doubled


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def format_turns(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """``turns`` with each turn's part of the output: ``formatted`` and the loss mask in it, code points [loss_from, loss_to)."""
    a, b, c = (F.lit(x) for x in template.other)
    before = F.concat(a, escape(F.col("role"), template), b)
    after = c
    for role, (start, end) in template.roles.items():
        mine = F.col("role") == role
        before, after = F.when(mine, F.lit(start)).otherwise(before), F.when(mine, F.lit(end)).otherwise(after)
    body = escape(F.col("text"), template)
    loss = F.col("role").isin(*template.loss_roles)
    return turns.select("*", before.alias("__a"), body.alias("__t"), after.alias("__b")).select(
        *turns.columns, F.concat("__a", "__t", "__b").alias("formatted"),
        F.when(loss, F.length("__a")).otherwise(0).alias("loss_from"),
        F.when(loss, F.length("__a") + F.length("__t")).otherwise(0).alias("loss_to"))


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation, parsed from its output: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``formatted`` has id, turn, place, formatted, loss_from, loss_to; the output of a conversation is its parts in order.
    """
    kind = formatted.schema["id"].dataType.simpleString()
    known = list(template.roles)

    def parse(part: str, marks: re.Pattern) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(part):
            m = marks.match(part, at)
            if m is None or m.end() == at:
                raise ValueError(f"not a formatted turn: {part[at:at + 80]!r}")
            groups = m.groups()
            for role, text in zip(known, groups, strict=False):
                if text is not None:
                    yield role, unescape(text)
                    break
            else:
                yield unescape(groups[-2]), unescape(groups[-1])
            at = m.end()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = template.marks()
        names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64() if kind == "bigint" else None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out: list[tuple] = []
        current, begun = None, False
        n, loss, size, turns_hash, loss_hash = 0, 0, 0, None, None

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            kinds[0] = batch.schema.field("id").type
            cols = [batch.column(c).to_pylist() for c in ("id", "formatted", "loss_from", "loss_to")]
            for conv, part, a, b in zip(*cols, strict=True):
                if not begun or conv != current:
                    if begun:
                        out.append((current, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), size))
                    current, begun = conv, True
                    n, loss, size, turns_hash, loss_hash = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in parse(part, marks):
                    turns_hash.update(f"{role}\n{text}\n".encode())
                    n += 1
                if b > a:
                    learned = unescape(part[a:b])
                    loss += len(learned)
                    loss_hash.update(learned.encode())
                size += len(part)
            yield rows()
        if begun:
            out.append((current, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), size))
            yield rows()

    parts = formatted.select("id", "turn", "role", "text", "place", "formatted", "loss_from", "loss_to").repartition("id") \
        .sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "place", "role", "text") \
        .select("id", "formatted", "loss_from", "loss_to")
    return parts.mapInArrow(work, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
