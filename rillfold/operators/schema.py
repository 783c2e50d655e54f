"""Types and schemas of logs: the type language, Spark types, and what a log tells of its base table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Native types and the Spark types that hold them.
NATIVE = {
    "ASCII": "string", "BIGINT": "bigint", "BLOB": "binary", "BOOLEAN": "boolean", "COUNTER": "bigint", "DATE": "date", "DECIMAL": "decimal(38,10)",
    "DOUBLE": "double", "DURATION": "struct<months:bigint,days:bigint,nanos:bigint>", "FLOAT": "float", "INET": "string", "INT": "int", "SMALLINT": "smallint",
    "TEXT": "string", "TIME": "bigint", "TIMESTAMP": "timestamp", "TIMEUUID": "string", "TINYINT": "tinyint", "UUID": "string", "VARCHAR": "string", "VARINT": "decimal(38,0)",
}
ARITY = {"LIST": 1, "SET": 1, "MAP": 2}
META = "cdc$"


class SchemaConflict(ValueError):
    """Log and base table contradict each other in a way that can't be resolved without a guess."""


@dataclass(frozen=True)
class Type:
    """A type of the log; `frozen` says nothing for native types."""

    name: str
    args: tuple[Type, ...] = ()
    frozen: bool = False
    udt: str | None = None
    fields: tuple[str, ...] = ()

    @property
    def native(self) -> bool:
        return self.name in NATIVE

    @property
    def atomic(self) -> bool:
        return self.native or self.frozen

    def text(self) -> str:
        inner = self.udt if self.udt else f"{self.name}<{', '.join(a.text() for a in self.args)}>" if self.args else self.name
        return f"FROZEN<{inner}>" if self.frozen and not self.native else inner

    def spark(self) -> str:
        if self.native:
            return NATIVE[self.name]
        inner = [a.spark() for a in self.args]
        if self.name in ("LIST", "SET"):
            return f"array<{inner[0]}>"
        if self.name == "MAP":
            return f"array<struct<key:{inner[0]},value:{inner[1]}>>" if self.args[0].holds_map() else f"map<{inner[0]},{inner[1]}>"
        names = self.fields or tuple(f"_{i + 1}" for i in range(len(inner)))
        return f"struct<{','.join(f'{n}:{t}' for n, t in zip(names, inner))}>"

    def holds_map(self) -> bool:
        return self.name == "MAP" or any(a.holds_map() for a in self.args)


def parse(text: str, udts: dict[str, list[tuple[str, str]]] | None = None) -> Type:
    """Read a type in any spelling. udts: fields of user-defined types by lower-case name; unknown names raise."""
    s = "".join(text.split())
    at = 0

    def one() -> Type:
        nonlocal at
        start = at
        while at < len(s) and s[at] not in "<>,":
            at += 1
        name = s[start:at].upper()
        args: list[Type] = []
        if at < len(s) and s[at] == "<":
            at += 1
            while True:
                args.append(one())
                if at >= len(s):
                    raise ValueError(f"unclosed type {text!r}")
                at += 1
                if s[at - 1] == ">":
                    break
        if name == "FROZEN":
            if len(args) != 1:
                raise ValueError(f"FROZEN takes one type: {text!r}")
            a = args[0]
            return Type(a.name, a.args, True, a.udt, a.fields)
        if name in NATIVE and not args:
            return Type(name)
        if name in ARITY and len(args) == ARITY[name] or name == "TUPLE" and args:
            return Type(name, tuple(args))
        if udts and name.lower() in udts:
            members = udts[name.lower()]
            return Type("UDT", tuple(parse(t, udts) for _, t in members), False, name.lower(), tuple(n for n, _ in members))
        raise ValueError(f"unknown type {text!r}")

    result = one()
    if at != len(s):
        raise ValueError(f"text after the type: {text!r}")
    return result


@dataclass(frozen=True)
class ColumnDef:
    name: str
    index: int
    log_type: Type
    base_type: Type | None = None
    kind: str | None = None

    @property
    def meta(self) -> bool:
        return self.name.startswith(META)


@dataclass(frozen=True)
class LogSchema:
    """The columns of a log in order, with what is known of the base table."""

    columns: tuple[ColumnDef, ...] = field(default_factory=tuple)

    def column(self, which: str | int) -> ColumnDef:
        for c in self.columns:
            if which in (c.name, c.index):
                return c
        raise KeyError(which)

    def base(self) -> list[ColumnDef]:
        return [c for c in self.columns if not c.meta]

    def meta(self) -> list[ColumnDef]:
        return [c for c in self.columns if c.meta]

    def of_kind(self, kind: str) -> list[ColumnDef]:
        return [c for c in self.base() if c.kind == kind]

    def deleted(self, name: str) -> ColumnDef:
        """The column that says whether `name` was set to null; only regular columns have one."""
        return self.column(f"{META}deleted_{name}")

    def deleted_elements(self, name: str) -> ColumnDef:
        """The column with the elements taken out of a collection that isn't frozen."""
        return self.column(f"{META}deleted_elements_{name}")

    def struct(self) -> T.StructType:
        """The Spark schema; kind and base type are metadata of the fields."""
        out = T.StructType()
        for c in self.columns:
            out.add(c.name, T._parse_datatype_string(c.log_type.spark()), True, {"kind": c.kind, "base_type": c.base_type.text() if c.base_type else None} if c.kind else None)
        return out


def infer(log: list[tuple[str, str]], base: dict[str, tuple[str, str]]) -> LogSchema:
    """The schema of a log from its columns `(name, type)`, and of its base table `{name: (kind, type)}`.

    The log is the truth; the base table, which may be older or newer, tells kinds, and whether a map
    by TIMEUUID is a list. A clustering column of the base that the log lacks was renamed, so an unknown
    column of the log is then taken for it, unless the base knows it as regular.
    """
    names = {n for n, _ in log}
    renamed = any(kind == "CLUSTERING_KEY" and n not in names for n, (kind, _) in base.items())
    out = []
    for i, (name, text) in enumerate(log):
        t = parse(text)
        if name.startswith(META):
            out.append(ColumnDef(name, i, t))
            continue
        known = base.get(name)
        if known and known[0] in ("PARTITION_KEY", "CLUSTERING_KEY"):
            kind = known[0]
        elif f"{META}deleted_{name}" in names or known:
            kind = "REGULAR"
        else:
            kind = "CLUSTERING_KEY" if renamed else "REGULAR"
        out.append(ColumnDef(name, i, t, _base_type(name, t, names, known), kind))
    return LogSchema(tuple(out))


def _base_type(name: str, t: Type, names: set[str], known: tuple[str, str] | None) -> Type:
    if t.native or f"{META}deleted_elements_{name}" not in names:
        return t
    loose = Type(t.name, t.args, False, t.udt, t.fields)
    if t.name != "MAP" or t.args[0].name != "TIMEUUID":
        return loose
    # A list is logged as a map by TIMEUUID; only the base table tells which it was.
    if known is None:
        raise SchemaConflict(f"{name}: a list or a map, and the base table has no such column")
    b = parse(known[1])
    if b.name == "LIST" and b.args[0] == t.args[1]:
        return Type("LIST", (t.args[1],))
    if b.name == "MAP" and b.args == t.args:
        return loose
    raise SchemaConflict(f"{name}: logged as {t.text()}, but the base table has {b.text()}")


INFERRED = "table_name string, file_id bigint, column_index int, column_name string, log_type string, base_type string, kind string, spark_type string, deleted int, deleted_elements int, problem string"


def _inferred(group):
    """One header, a few dozen rows."""
    import pandas as pd

    group = group.sort_values(["column_index", "name"]).drop_duplicates("name")
    base = {r.name_: (r.kind, r.base) for r in group.rename(columns={"name": "name_"}).itertuples() if r.kind and r.base}
    out, problem = LogSchema(), None
    try:
        out = infer(list(zip(group["name"], group["type"])), base)
    except ValueError as e:  # an unknown type, or a contradiction that only a guess could resolve
        problem = str(e)

    def place(find, name: str) -> int | None:
        try:
            return find(name).index
        except KeyError:
            return None

    rows = [(c.index, c.name, c.log_type.text(), c.base_type.text() if c.base_type else None, c.kind, c.log_type.spark(), place(out.deleted, c.name), place(out.deleted_elements, c.name), None) for c in out.columns] or [(None, None, None, None, None, None, None, None, problem)]
    df = pd.DataFrame(rows, columns=["column_index", "column_name", "log_type", "base_type", "kind", "spark_type", "deleted", "deleted_elements", "problem"])
    df.insert(0, "file_id", group["file_id"].iloc[0])
    df.insert(0, "table_name", group["table_name"].iloc[0])
    return df.astype({c: "Int64" for c in ("column_index", "deleted", "deleted_elements")})


def inferred(headers: DataFrame) -> DataFrame:
    """`INFERRED`: the schema of each log file, inferred from its header, with the places of the columns that tell of deletions.

    A header is a small unit by nature. Names compare as in `drift`; of repeated columns the first counts. A header that can't be
    understood gives one row with the problem. Headers without table or file, and columns without name or type, are left out.
    """
    from rillfold.operators.drift import norm_kind, norm_name

    rows = headers.where("table_name is not null and file_id is not null and column_name is not null and cdc_log_data_type is not null").select(
        "table_name", "file_id", "column_index", norm_name(F.col("column_name")).alias("name"), F.col("cdc_log_data_type").alias("type"), F.col("base_table_data_type").alias("base"), norm_kind(F.col("base_table_column_kind")).alias("kind")
    )
    return rows.distinct().groupBy("table_name", "file_id").applyInPandas(_inferred, INFERRED)


def type_texts(spellings: DataFrame) -> DataFrame:
    """`(spelling, text)` of a column of types, each read and written again; null where it can't be read."""

    def run(frames):
        for f in frames:
            f = f.set_axis(["spelling"], axis=1)
            yield f.assign(text=[_text(s) for s in f["spelling"]])

    return spellings.mapInPandas(run, "spelling string, text string")


def _text(s: str | None) -> str | None:
    try:
        return parse(s).text() if s is not None else None
    except ValueError:
        return None


#: The columns that every log has.
COMMON = [("cdc$stream_id", "BLOB"), ("cdc$time", "TIMEUUID"), ("cdc$batch_seq_no", "INT"), ("cdc$end_of_batch", "BOOLEAN"), ("cdc$operation", "TINYINT"), ("cdc$ttl", "BIGINT")]


def log_columns(base: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """The columns of the log of a base table `(name, kind, type)`."""
    out = list(COMMON)
    for name, kind, text in base:
        t = parse(text)
        logged = t.text()
        if not t.atomic:
            inner = Type("MAP", (Type("TIMEUUID"), t.args[0]), True) if t.name == "LIST" else Type(t.name, t.args, True, t.udt, t.fields)
            logged = inner.text()
            element = {"LIST": "TIMEUUID", "SET": t.args[0].text(), "MAP": t.args[0].text()}.get(t.name, "SMALLINT")
            out.append((f"cdc$deleted_elements_{name}", f"FROZEN<SET<{element}>>"))
        if kind == "REGULAR":
            out.append((f"cdc$deleted_{name}", "BOOLEAN"))
        out.append((name, logged))
    return out
