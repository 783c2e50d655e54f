"""Schemas that drift from file to file: a report of each change, and one consistent table.

File headers are normalised in parallel, one row per file and column, and each file is compared with the
one before it by an aggregation over (table, file, column); what goes on from file to file (the file before, the last known kind) is scanned
in pieces of 30 days, so a table with very many files is no larger a unit of work than any other. Renames are decided by values: only bodies of files that lost and gained a
column of one kind are parsed, only those columns travel, and each pair of columns is summed up before the
shuffle. Types are folded through a promotion lattice, in which any two types have a least upper bound.

Names compare without letter case, surrounding quotes and blanks; types without letter case and blanks,
VARCHAR being TEXT; kinds without letter case, an unknown kind being the last known one of that column.

Defined cases: header rows without table, file or column name are ignored; repeated headers count once; of
contradicting rows for one column the greatest type and kind hold; a kind that was never known differs from
none and may match any in a rename; bodies that are null or no JSON object have no values; of repeated
records of a row the one with the lowest number counts; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rillfold.operators import ordered
from rillfold.session import kept

#: A column is renamed if more than this share of the rows with both values agree.
MOST = 0.5
#: Longer values are compared by a digest.
PLAIN_CHARS = 48

KINDS = ["PARTITION_KEY", "CLUSTERING_KEY", "REGULAR"]

# Numeric types by rank, each a superset of the former as far as whole numbers or magnitudes go.
WHOLE = ["TINYINT", "SMALLINT", "INT", "BIGINT", "VARINT"]
REAL = ["FLOAT", "DOUBLE", "DECIMAL"]
SPARK_TYPES = {"TINYINT": "tinyint", "SMALLINT": "smallint", "INT": "int", "BIGINT": "bigint", "COUNTER": "bigint", "VARINT": "decimal(38,0)", "FLOAT": "float", "DOUBLE": "double", "DECIMAL": "decimal(38,10)", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp"}


def norm_name(c: Column) -> Column:
    return F.lower(F.trim(c, F.lit("\" '`\t")))


def norm_type(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(c), r"\s+", ""), r"\bVARCHAR\b", "TEXT")


def norm_kind(c: Column) -> Column:
    k = F.upper(F.trim(c))
    return F.when(k.isin(KINDS), k)


def promote(a: str, b: str) -> str:
    """The least type that holds the values of both; TEXT is the top."""
    if a == b:
        return a
    a, b = ("BIGINT" if x == "COUNTER" else x for x in (a, b))
    if a in WHOLE and b in WHOLE:
        return max(a, b, key=WHOLE.index)
    if a in REAL and b in REAL:
        return max(a, b, key=REAL.index)
    if {a, b} <= {*WHOLE, *REAL}:
        whole, real = (a, b) if a in WHOLE else (b, a)
        if real == "DECIMAL" or WHOLE.index(whole) > 2:
            return "DECIMAL"
        return "DOUBLE" if whole == "INT" or real == "DOUBLE" else "FLOAT"
    if {a, b} == {"DATE", "TIMESTAMP"}:
        return "TIMESTAMP"
    if {a, b} == {"UUID", "TIMEUUID"}:
        return "UUID"
    return "TEXT"


def promoted(types: Column) -> Column:
    """The fold of an array of normalised types through `promote`, as an expression."""
    whole, real = F.array(*map(F.lit, WHOLE)), F.array(*map(F.lit, REAL))
    types = F.array_distinct(F.transform(types, lambda t: F.when(t == "COUNTER", F.lit("BIGINT")).otherwise(t)))
    all_in = lambda values: F.size(F.array_except(types, F.array(*map(F.lit, values)))) == 0
    top = lambda ladder, names: F.element_at(ladder, F.array_max(F.transform(types, lambda t: F.array_position(ladder, t))).cast("int"))
    wide = F.exists(types, lambda t: t.isin("BIGINT", "VARINT", "DECIMAL"))
    return (
        F.when(F.size(types) == 1, types[0]).when(all_in(WHOLE), top(whole, WHOLE)).when(all_in(REAL), top(real, REAL))
        .when(all_in(WHOLE + REAL), F.when(wide, "DECIMAL").when(F.exists(types, lambda t: t.isin("INT", "DOUBLE")), "DOUBLE").otherwise("FLOAT"))
        .when(all_in(["DATE", "TIMESTAMP"]), "TIMESTAMP").when(all_in(["UUID", "TIMEUUID"]), "UUID").otherwise("TEXT")
    )


def _at(c: str = "effective_at") -> Column:
    """A time as microseconds, null before all others."""
    return F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(-(1 << 62)))


def _month(c: str = "at") -> Column:
    """What lies within 30 days is one unit of an ordered scan, so a table with very many files is several."""
    return F.floor(F.col(c) / F.lit(30 * 86400 * 1_000_000)).cast("bigint")


def files(headers: DataFrame) -> DataFrame:
    """`(table_name, file_id, effective_at, at, before, after)`: each file of each table, with those before and after it by the time its schema took effect."""
    known = headers.where("table_name is not null and file_id is not null").groupBy("table_name", "file_id").agg(F.min("effective_at").alias("effective_at")).withColumn("at", _at())
    return ordered.neighbours(known, ["table_name"], ["at", "file_id"], _month(), "file_id", "before", "after")


def columns(headers: DataFrame) -> DataFrame:
    """`(table_name, file_id, before, after, effective_at, at, name, type, kind)` of the base columns, kinds filled in."""
    named = headers.where("table_name is not null and file_id is not null and column_name is not null").select("table_name", "file_id", norm_name(F.col("column_name")).alias("name"), norm_type(F.col("cdc_log_data_type")).alias("type"), norm_kind(F.col("base_table_column_kind")).alias("kind"))
    one = named.where(~F.col("name").startswith("cdc$")).groupBy("table_name", "file_id", "name").agg(F.max("type").alias("type"), F.max("kind").alias("kind"))
    placed = one.join(files(headers), ["table_name", "file_id"])
    return ordered.last_known(placed, ["table_name", "name"], ["at", "file_id"], _month(), F.col("kind"), "kind")


def compared(cols: DataFrame) -> DataFrame:
    """Per (table, file, column) of `columns`: what it was in the file before (`old`) and is in this one (`new`); null where it is absent."""
    none = F.lit(None).cast("struct<type:string,kind:string>")
    this = F.struct("type", "kind")
    sides = F.array_compact(F.array(
        F.when(F.col("before").isNotNull(), F.struct("file_id", "before", this.alias("new"), none.alias("old"))),
        F.when(F.col("after").isNotNull(), F.struct(F.col("after").alias("file_id"), F.col("file_id").alias("before"), none.alias("new"), this.alias("old"))),
    ))
    each = cols.select("table_name", "name", F.explode(sides).alias("s")).select("table_name", "s.file_id", "s.before", "name", "s.new", "s.old")
    return each.groupBy("table_name", "file_id", "before", "name").agg(F.max("new").alias("new"), F.max("old").alias("old"))


def rename_votes(diff: DataFrame, records: DataFrame) -> DataFrame:
    """`(file_id, old_name, new_name, both, same)` of each lost and gained column of one kind: rows for which both files have a value, and those that agree."""
    moved = diff.where("new is null or old is null").groupBy("file_id", "before").agg(
        F.collect_list(F.when(F.col("new").isNull(), F.struct("name", F.col("old.kind").alias("kind")))).alias("lost"),
        F.collect_list(F.when(F.col("old").isNull(), F.struct("name", F.col("new.kind").alias("kind")))).alias("gained"),
    )
    # One row per file: pairs of its few columns.
    fits = lambda a, b: F.coalesce(a["kind"] == b["kind"], F.lit(True))
    pairs = F.flatten(F.transform("lost", lambda a: F.transform(F.filter("gained", lambda b: fits(a, b)), lambda b: F.struct(a["name"].alias("old_name"), b["name"].alias("new_name")))))
    changed = moved.select("file_id", "before", pairs.alias("pairs")).where(F.size("pairs") > 0)
    sides = F.array(F.struct("file_id", F.lit(True).alias("is_new"), F.array_distinct(F.col("pairs.new_name")).alias("names")), F.struct(F.col("before").alias("file_id"), F.lit(False).alias("is_new"), F.array_distinct(F.col("pairs.old_name")).alias("names")))
    needed = changed.select(F.col("file_id").alias("change"), "pairs", F.explode(sides).alias("s")).select("s.file_id", F.struct("change", "s.is_new", "s.names").alias("w"))
    wanted = needed.groupBy("file_id").agg(F.collect_list("w").alias("wanted"))
    bodies = records.where("body is not null and row_key is not null").select("file_id", "record_no", "row_key", "body").join(wanted, "file_id")
    entries = bodies.select("row_key", "record_no", "wanted", F.explode(F.map_entries(F.from_json("body", T.MapType(T.StringType(), T.StringType())))).alias("e")).where("e.value is not null")
    values = entries.select("row_key", "record_no", norm_name(F.col("e.key")).alias("name"), F.when(F.length("e.value") <= PLAIN_CHARS, F.concat(F.lit("="), F.col("e.value"))).otherwise(F.sha2(F.col("e.value"), 256)).alias("value"), "wanted")
    spread = values.select("row_key", "record_no", "value", "name", F.explode(F.filter("wanted", lambda x: F.array_contains(x["names"], F.col("name")))).alias("w"))
    first = spread.groupBy(F.col("w.change").alias("file_id"), "row_key", F.col("w.is_new").alias("is_new"), "name").agg(F.min_by("value", F.coalesce("record_no", F.lit((1 << 63) - 1))).alias("value"))
    # A row's values on either side are at most as many as its columns.
    row = first.groupBy("file_id", "row_key").agg(F.collect_list(F.when(~F.col("is_new"), F.struct("name", "value"))).alias("olds"), F.collect_list(F.when(F.col("is_new"), F.struct("name", "value"))).alias("news"))
    met = F.flatten(F.transform("olds", lambda a: F.transform("news", lambda b: F.struct(a["name"].alias("old_name"), b["name"].alias("new_name"), (a["value"] == b["value"]).alias("same")))))
    votes = row.select("file_id", F.explode(met).alias("m")).groupBy("file_id", "m.old_name", "m.new_name").agg(F.count(F.lit(1)).alias("both"), F.sum(F.col("m.same").cast("bigint")).alias("same"))
    real = changed.select("file_id", F.explode("pairs").alias("p")).select("file_id", "p.old_name", "p.new_name")
    return votes.join(real, ["file_id", "old_name", "new_name"])


def renames(votes: DataFrame) -> DataFrame:
    """`(file_id, old_name, new_name)`: pairs that agree in most rows and are each other's best."""
    share = F.col("same") / F.col("both")
    fit = votes.where(share > MOST).groupBy("file_id").agg(F.collect_list(F.struct(share.alias("share"), "same", "old_name", "new_name")).alias("all"))
    # Of equal ones the name that comes first.
    beats = lambda x, y, other: (x["share"] > y["share"]) | ((x["share"] == y["share"]) & ((x["same"] > y["same"]) | ((x["same"] == y["same"]) & (x[other] < y[other]))))
    rival = lambda x, side, other: F.exists("all", lambda y: (y[side] == x[side]) & beats(y, x, other))
    best = F.filter("all", lambda x: ~rival(x, "old_name", "new_name") & ~rival(x, "new_name", "old_name"))
    return fit.select("file_id", F.explode(best).alias("b")).select("file_id", "b.old_name", "b.new_name")


def _report(diff: DataFrame, moved: DataFrame) -> DataFrame:
    """`diff` with `change_kind`, a row for each change."""
    moves = moved.select("file_id", F.explode(F.array(F.struct(F.col("new_name").alias("name"), F.lit("renamed").alias("how")), F.struct(F.col("old_name").alias("name"), F.lit("gone").alias("how")))).alias("m")).select("file_id", "m.name", "m.how")
    kinds = F.array_compact(F.array(
        F.when(F.col("old").isNull(), F.coalesce("how", F.lit("added"))),
        F.when(F.col("new").isNull() & F.col("how").isNull(), "removed"),
        F.when(F.col("old.type") != F.col("new.type"), "retyped"),
        F.when(F.col("old.kind") != F.col("new.kind"), "rekinded"),
    ))
    return diff.join(moves, ["file_id", "name"], "left").select("table_name", "file_id", F.explode(kinds).alias("change_kind"), F.col("name").alias("column_name"), "old", "new")


def changes(headers: DataFrame, records: DataFrame) -> DataFrame:
    """`(table_name, file_id, change_kind, column_name)` for each change between a file and the one before it."""
    diff = kept(compared(columns(headers)), "drift")
    return _report(diff, renames(rename_votes(diff, records))).drop("old", "new")


def changelog(headers: DataFrame, records: DataFrame) -> DataFrame:
    """The report in order: `changes` with the time each took effect and the old and new type and kind of the column."""
    diff = kept(compared(columns(headers)), "drift")
    when = headers.where("table_name is not null and file_id is not null").groupBy("table_name", "file_id").agg(F.min("effective_at").alias("effective_at"))
    report = _report(diff, renames(rename_votes(diff, records))).join(when, ["table_name", "file_id"])
    return report.select("table_name", "file_id", "column_name", "change_kind", F.col("old.type").alias("old_type"), F.col("new.type").alias("new_type"), F.col("old.kind").alias("old_kind"), F.col("new.kind").alias("new_kind"), "effective_at")


def union_schema(headers: DataFrame) -> DataFrame:
    """`(table_name, column_name, type)`: every column a table ever had, with the least type that holds all its types."""
    cols = columns(headers).where("type is not null")
    return cols.groupBy("table_name", F.col("name").alias("column_name")).agg(promoted(F.collect_set("type")).alias("type"))


def canonical_names(headers: DataFrame, records: DataFrame) -> DataFrame:
    """`(table_name, file_id, name, type, column_name)`: the name that a column of a file has in the unified table.

    That is the last name it came to bear. Each stretch of files in which a name goes on without a gap is a node,
    a rename makes the old name's stretch the parent of the new one's, and pointers to parents are doubled
    until they point to the first, so a chain of n renames takes about log2(n) rounds over stretches, not files.
    A column that was removed and comes back is one; of columns that bear one last name but lived side by side,
    all but the first get the file they began in as a suffix.
    """
    cols = kept(columns(headers), "drift")
    lone = ordered.neighbours(cols, ["table_name", "name"], ["at", "file_id"], _month(), "file_id", "own_before", "own_after").drop("own_after")
    fresh = F.when(F.col("own_before") == F.col("before"), F.lit(None)).otherwise(F.col("file_id"))
    runs = kept(ordered.last_known(lone, ["table_name", "name"], ["at", "file_id"], _month(), fresh, "start").drop("own_before"), "drift")
    diff = kept(compared(cols), "drift")
    moved = renames(rename_votes(diff, records)).join(diff.select("table_name", "file_id", "before", F.col("name").alias("new_name")), ["file_id", "new_name"])
    moved = moved.select("table_name", F.col("before").alias("file_id"), F.col("old_name").alias("name"), F.col("file_id").alias("moved_at"), "new_name")
    edges = moved.join(runs.select("table_name", "file_id", "name", "start"), ["table_name", "file_id", "name"]).select("table_name", F.col("new_name").alias("name"), F.col("moved_at").alias("start"), F.struct("name", "start").alias("parent"))
    nodes = runs.groupBy("table_name", "name", "start").agg(F.min("at").alias("begins"), F.max("at").alias("ends"))
    nodes = nodes.join(edges, ["table_name", "name", "start"], "left").withColumn("parent", F.coalesce("parent", F.struct("name", "start")))
    while True:
        nodes = kept(nodes, "drift")
        up = nodes.select("table_name", F.struct("name", "start").alias("parent"), F.col("parent").alias("above"))
        doubled = nodes.join(up, ["table_name", "parent"])
        if doubled.where("above <> parent").limit(1).count() == 0:
            break
        nodes = doubled.select("table_name", "name", "start", "begins", "ends", F.col("above").alias("parent"))
    whole = nodes.groupBy("table_name", "parent").agg(F.max_by("name", F.struct("begins", "start")).alias("last_name"), F.min("begins").alias("begins"), F.max("ends").alias("ends"))
    earlier = F.max("ends").over(Window.partitionBy("table_name", "last_name").orderBy("begins", "parent").rowsBetween(Window.unboundedPreceding, -1))
    named = whole.withColumn("column_name", F.when(earlier >= F.col("begins"), F.concat_ws("@", "last_name", F.col("parent.start").cast("string"))).otherwise(F.col("last_name")))
    final = nodes.join(named.select("table_name", "parent", "column_name"), ["table_name", "parent"]).select("table_name", "name", "start", "column_name")
    return runs.join(final, ["table_name", "name", "start"]).select("table_name", "file_id", "name", "type", "column_name")


_BODY = T.MapType(T.StringType(), T.StringType())


def _body_map() -> Column:
    """A body's values as text. Numbers keep all their digits, as `from_json` wouldn't let them, and nested objects are sorted by key, so equal ones are equal text; it reads bodies that name a column twice, which the former refuses."""
    return F.coalesce(F.expr("try_variant_get(try_parse_json(body), '$', 'map<string,string>')"), F.from_json("body", _BODY))


def first_records(records: DataFrame) -> DataFrame:
    """`(file_id, row_key, record_no, m)`: of repeated records of a row the readable one with the lowest number, its body as a map.

    A row none of whose records can be read keeps the lowest number and no map. Records without row key aren't repetitions of each other.
    """
    read = records.where("file_id is not null").select("file_id", "row_key", "record_no", _body_map().alias("m"))
    text = F.to_json("m")  # a map can't be compared
    rank = F.struct(F.col("m").isNull(), F.coalesce("record_no", F.lit((1 << 63) - 1)))
    one = read.where("row_key is not null").groupBy("file_id", "row_key").agg(F.min_by(F.struct("record_no", text.alias("t")), rank).alias("r"))
    return one.select("file_id", "row_key", "r.record_no", F.from_json("r.t", _BODY).alias("m")).unionByName(read.where("row_key is null"))


def held(value: Column, kind: Column) -> Column:
    """The text of a value in a type, without loss; null where the type can't hold it.

    Whole numbers, booleans, dates and times are read and written again. Reals, and whole numbers of any length, stay as they were written,
    since no Spark type holds all of them; any other type takes any text.
    """
    bare = F.trim(value)
    out = value
    for name in ("TINYINT", "SMALLINT", "INT", "BIGINT", "BOOLEAN", "DATE", "TIMESTAMP"):
        out = F.when(kind == name, bare.try_cast(SPARK_TYPES[name]).cast("string")).otherwise(out)
    out = F.when(kind == "VARINT", F.when(bare.rlike(r"^[+-]?[0-9]+$"), bare)).otherwise(out)
    return F.when(kind.isin(*REAL), F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare)).otherwise(out)


def _named(headers: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per file the names of its columns in the unified table and their types, as a map; and the columns of each table."""
    names = kept(canonical_names(headers, records), "drift")
    union = names.where("type is not null").groupBy("table_name", "column_name").agg(promoted(F.collect_set("type")).alias("union_type"))
    per_file = names.join(union, ["table_name", "column_name"]).groupBy("table_name", "file_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("column_name", "union_type")))).alias("names"))
    return per_file, union


def unified_values(headers: DataFrame, records: DataFrame) -> DataFrame:
    """All base tables as one: `(table_name, file_id, record_no, row_key, column_name, type, value, refused)`.

    One row for each value of each record, under the column's name in the unified table, as text in its
    promoted type (`held`). A value that this type can't hold is null and `refused`. Repeated records of a row count once.
    """
    per_file, _ = _named(headers, records)
    entries = first_records(records).where("m is not null").join(per_file, "file_id").select("table_name", "file_id", "record_no", "row_key", "names", F.explode(F.map_entries("m")).alias("e"))
    values = entries.where("e.value is not null").withColumn("c", F.try_element_at("names", norm_name(F.col("e.key")))).where("c is not null")
    cast = held(F.col("e.value"), F.col("c.union_type"))
    return values.select("table_name", "file_id", "record_no", "row_key", "c.column_name", F.col("c.union_type").alias("type"), cast.alias("value"), cast.isNull().alias("refused"))


def unified_rows(headers: DataFrame, records: DataFrame) -> DataFrame:
    """Every record of every base table, those without values too, with all columns of its table: `(table_name, file_id, record_no, row_key, columns)`.

    columns: an array of `(name, type, value)` in order of names, the same names and types for each record of a table; a missing or refused value is null.
    """
    return _rows(headers, records)[0]


def _rows(headers: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`unified_rows`, and the columns of each table with their types."""
    per_file, union = _named(headers, records)
    whole = union.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct(F.col("column_name").alias("name"), F.col("union_type").alias("type")))).alias("whole"))
    rows = first_records(records).join(per_file.join(whole, "table_name"), "file_id")
    known = F.filter(F.transform(F.coalesce(F.map_entries("m"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(F.try_element_at("names", norm_name(e["key"]))["column_name"].alias("name"), e["value"].alias("value"))), lambda e: e["name"].isNotNull())
    rows = rows.select("table_name", "file_id", "record_no", "row_key", "whole", known.alias("known"))
    value = lambda c: F.filter("known", lambda e: e["name"] == c["name"])
    columns = F.transform("whole", lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"), held(F.get(value(c), F.lit(0))["value"], c["type"]).alias("value")))
    return rows.select("table_name", "file_id", "record_no", "row_key", columns.alias("columns")), union


def unified(headers: DataFrame, records: DataFrame, table_name: str) -> DataFrame:
    """The records of one base table in one schema: `file_id, record_no, row_key` and a typed column each, renamed ones under their last name.

    The schema of one table is small and known to the driver. A value that its Spark type can't hold is null (of decimals, what exceeds
    `decimal(38,10)`; `unified_rows` keeps those); a record without values is a row of nulls. Repeated records of a row count once.
    """
    rows, union = _rows(headers.where(F.col("table_name") == table_name), records)
    schema = sorted((r.column_name, r.union_type) for r in union.collect())
    value = lambda i, t: F.col("columns")[i]["value"]
    typed = lambda i, t: value(i, t).try_cast(SPARK_TYPES[t]) if t in SPARK_TYPES else value(i, t)
    exact = lambda i, t: F.when(value(i, t).try_cast("decimal(38,18)") == typed(i, t), typed(i, t)) if t == "DECIMAL" else typed(i, t)
    return rows.select("file_id", "record_no", "row_key", *[exact(i, t).alias(f"c_{n}") for i, (n, t) in enumerate(schema)])
