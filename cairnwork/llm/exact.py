"""Exact deduplication by deterministic block naming, in DataFrame functions only.

A normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are
sorted and each gets an integer name; then adjacent names are paired, the distinct pairs
sorted and named, and so on until every document has one name. Two texts have the same
(level, name) exactly if they are the same text: that each sort key stands for one block
content is checked against the contents, and pairs of names are compared as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwork.llm.rows import chosen, join_common, row_table, stable
from cairnwork.storage import materialize, working

ABSENT = -1


def without_blanks(text: Column) -> Column:
    """The text without space and U+0009 to U+000D; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", "")


def _blocks(packed: str, size: int) -> str:
    """SQL for the array of ``size``-byte blocks of a binary column; an empty text is one empty block."""
    last = f"cast(greatest(0, (octet_length({packed}) - 1) div {size}) as int)"
    return f"transform(sequence(0, {last}), i -> substring({packed}, i * {size} + 1, {size}))"


def sorted_names(keys: DataFrame, *columns: str) -> DataFrame:
    """Distinct ``keys`` with ``name``: an integer that rises in the order of ``columns``."""
    ranged = keys.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return materialize(ranged.withColumn("name", F.monotonically_increasing_id()), "names")


def _named_blocks(packed: DataFrame, size: int, salt: int) -> tuple[DataFrame, DataFrame] | None:
    """(rows with block keys, names of the keys); None if two contents have one key.

    Blocks sort by a 128-bit key. The contents are shuffled once, as distinct (key, block)
    with map-side combination, only to check that no key stands for two of them.
    """
    key = f"struct(xxhash64({salt}, b) as a, xxhash64(b, {salt}) as b)"
    rows = materialize(
        packed.select("row", "id", "points", F.sha2("packed", 256).alias("text_sha256"), F.expr(f"transform({_blocks('packed', size)}, b -> {key})").alias("keys")),
        "block-keys",
    )
    contents = packed.select(F.explode(F.expr(_blocks("packed", size))).alias("b")).select(F.expr(key).alias("key"), "b")
    distinct = contents.groupBy("key.a", "key.b", F.col("b").alias("block")).agg(F.count("*").alias("n")).select("a", "b", "n")
    names = sorted_names(distinct.groupBy("a", "b").agg(F.count("*").alias("contents"), F.sum("n").alias("n")), "a", "b")
    return (rows, names) if names.where("contents > 1").isEmpty() else None


def _regrouped(positions: DataFrame) -> DataFrame:
    names = F.expr("transform(array_sort(collect_list(struct(pos, name))), x -> x.name)")
    return materialize(positions.groupBy("row").agg(names.alias("names")), "level")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4096) -> DataFrame:
    """One row for each row of ``docs``, which ``stable`` returned: row, id, points (code points), text_sha256, level and name.

    Levels needed are the logarithm of the longest text in blocks; from each level on only
    texts of more than one name take part. A level is one sort of distinct pairs and one join.
    """
    packed = row_table(
        docs,
        id=F.col(id_col),
        points=F.coalesce(F.length(text_col), F.lit(0)).cast("bigint"),
        packed=without_blanks(F.col(text_col)).cast("binary"),
    )
    salt, found = 0, None
    while found is None:
        found, salt = _named_blocks(packed, size, salt), salt + 1
    rows, names = found
    positions = rows.select("row", F.posexplode("keys").alias("pos", "key")).select("row", "pos", "key.a", "key.b")
    table = _regrouped(join_common(positions, names, ["a", "b"], "n").select("row", "pos", "name"))
    done, level = [], 0
    while True:
        done.append(table.where("size(names) = 1").select("row", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        rest = table.where("size(names) > 1")
        if rest.isEmpty():
            break
        pairs = f"transform(sequence(0, (size(names) - 1) div 2), i -> struct(names[2 * i] as a, coalesce(get(names, 2 * i + 1), {ABSENT}L) as b))"
        positions = rest.select("row", F.posexplode(F.expr(pairs)).alias("pos", "pair")).select("row", "pos", "pair.a", "pair.b")
        names = sorted_names(positions.groupBy("a", "b").agg(F.count("*").alias("n")), "a", "b")
        table = _regrouped(join_common(positions, names, ["a", "b"], "n").select("row", "pos", "name"))
        level += 1
    return rows.drop("keys").join(reduce(DataFrame.unionByName, done), "row")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4096) -> DataFrame:
    """``(id_col, keep_id, group_size, kept, text_sha256)`` for each row of ``docs``.

    Texts are equal when identical after deleting space and U+0009 to U+000D; null counts as
    empty and all empty texts are one group. The row with the most code points in its original
    text stays, then the least id, a null id last; of rows that tie in all this the first by
    file and place in the file stays. An empty table gives no rows; other columns are not read.
    """
    return _groups(stable(docs), id_col, text_col, size).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def _groups(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(row, id, keep_id, group_size, kept, text_sha256) for each row of a stable frame."""
    with working() as keep:
        rows = keep(materialize(identify(docs, id_col, text_col, size), "identities"))
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("row").alias("row")))
    groups = materialize(rows.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    return join_common(rows, groups, ["level", "name"], "group_size").select(
        "row", "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay by the rules of ``exact_duplicates``, with all their columns as they are; none of an empty table."""
    docs = stable(docs)
    return chosen(docs, _groups(docs, id_col, text_col, size).where("kept"))
