"""Queries that write result tables and answer jobs to the shared folder and read them back."""

from pyspark.sql import functions as F

from crossloom.functions import vectors as V
from crossloom.operators import jobs as J
from crossloom.operators.ordering import dense_index
from crossloom.plans.q_instructions import echo_model
from crossloom.plans.registry import ORACLE, QUERIES, query
from crossloom.session import shared_folder
from crossloom.sources import matrix as M
from crossloom.sources import sinks as O

EXPORTED = {"splits": "leave_one_out", "profiles": "detailed_profile_text", "instructions": "instructions_profile"}


def lines_sql(name, columns):
    text = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns)
    return f"SELECT '{name}' AS name, user_id, md5({text}) AS line FROM ({ORACLE[EXPORTED[name]]})"


COLUMNS = {"splits": ("split", "items", "target_item"), "profiles": ("profile_text",), "instructions": ("split", "instruction", "input", "output", "target_item_id", "target_domain")}


@query("table_exports", "S11", "@ all_lines AS (" + " UNION ALL ".join(f"({lines_sql(n, c)})" for n, c in COLUMNS.items()) + ") @ SELECT name, user_id, line FROM all_lines")
def _(t):
    """Splits, profiles and instructions laid out by user, read back from their files."""
    tables = {name: QUERIES[q](t.spark, t.sf_dir).select("user_id", *COLUMNS[name]) for name, q in EXPORTED.items()}
    folder = shared_folder(t.spark, "exports")
    prefix = folder.rsplit("/", 1)[1].replace("-", "_") + "_"
    O.export_tables(tables, folder, prefix, by={"splits": ["split"], "instructions": ["split"]}, buckets=8)
    out = None
    for name, columns in COLUMNS.items():
        line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
        part = t.spark.table(prefix + name).select(F.lit(name).alias("name"), "user_id", F.md5(line.cast("binary")).alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


@query("matrix_files", "S8", """
SELECT row_number() OVER (ORDER BY id) - 1 AS row, CAST(len(embedding) AS INT) AS dim, round(list_dot_product(embedding, list_transform(range(1, len(embedding) + 1), lambda x: CAST(x AS DOUBLE))), 4) + 0.0 AS total FROM vectors""")
def _(t):
    """The vectors by row number, written as matrices of 300 rows and read back by ranges."""
    rows = dense_index(t.vectors.select("id", "embedding"), ["id"], "row")
    path = shared_folder(t.spark, "matrices")
    M.write_matrix(rows, path, 300)
    first = F.regexp_extract("file", r"part-0*(\d+)\.npy$", 1).cast("long")
    back = M.read_matrix(t.spark, path, 1 << 16).withColumn("row", first + F.col("row"))
    place = F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: i.cast("double"))
    return back.select("row", F.size("embedding").alias("dim"), (F.round(V.dot(V.doubles(F.col("embedding")), place), 4) + 0.0).alias("total"))


@query("resumed_answers", "L15 UD1", """
SELECT item_id, CASE WHEN len(string_split(prompt, ' ')) % 2 = 0 THEN upper(left(prompt, 20)) END AS prediction, CASE WHEN len(string_split(prompt, ' ')) % 2 = 1 THEN 'ValueError: odd prompt' END AS error
FROM (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN 'Item ' || p_name ELSE 'An item ' || p_name || ' ' || p_type END AS prompt FROM part)""")
def _(t):
    """The answers of a job that is stopped after one wave and goes on; failed rows are tried again and fail again."""
    made = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Item "), "p_name")).otherwise(
        F.concat(F.lit("An item "), "p_name", F.lit(" "), "p_type"))
    todo = t.table("part").select(F.col("p_partkey").alias("item_id"), made.alias("prompt"))
    path = shared_folder(t.spark, "answers")
    J.run_shards(todo, path, echo_model, "item_id", wave=1, max_waves=1)
    J.run_shards(todo, path, echo_model, "item_id")
    return J.answers(t.spark, path).drop("prompt")
