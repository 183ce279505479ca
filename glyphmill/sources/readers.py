"""Sources: every reader gives an explicit order key, since rows of a table have no order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_id (increasing within a file), text of text files."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("text"))


def text_column(df: DataFrame) -> DataFrame:
    """The column text if there is one, else the first, as text."""
    name = "text" if "text" in df.columns else df.columns[0]
    return df.select(F.col(f"`{name}`").cast("string").alias("text"))


def arrow_file(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow IPC file (Spark has no reader for it): bytes by the binary source, batches in Arrow."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                file = pa.ipc.open_file(pa.py_buffer(content.as_py()))
                i = file.schema.get_field_index("text")
                for b in map(file.get_batch, range(file.num_record_batches)):
                    yield pa.RecordBatch.from_arrays([b.column(max(i, 0)).cast(pa.string())], ["text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "text string")


def corpus_lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line: the lines of a table of documents."""
    return docs.select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("pos", "line"))


def tsv_pairs(lines: DataFrame, text: str = "text") -> DataFrame:
    """prompt, target of lines with two fields or more; the others are dropped, further fields ignored."""
    fields = F.split(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""), "\t")
    return lines.withColumn("_f", fields).filter(F.size("_f") >= 2).withColumn("prompt", F.get("_f", F.lit(0))).withColumn("target", F.get("_f", F.lit(1))).drop("_f")


def json_rows(lines: DataFrame, schema: str, text: str = "text", strict: bool = False) -> DataFrame:
    """Parsed lines; malformed ones fail (strict) or are dropped."""
    parsed = F.from_json(F.col(text), schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    is_object = F.col(text).rlike(r"^\s*\{.*\}\s*$") & F.get_json_object(F.col(text), "$").isNotNull()
    rows = lines if strict else lines.filter(is_object)
    return rows.withColumn("row", parsed)


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One document per file; a malformed one gives nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def prompt_half(text: Column) -> Column:
    """The first half of a line, one character at least."""
    return F.substring(text, F.lit(1), F.greatest(F.lit(1), F.floor(F.char_length(text) / 2).cast("int")))


def estimated_rows(df: DataFrame, text: str = "text", key: str = "doc_id", sample: int = 1000) -> DataFrame:
    """sampled, mean_bytes, estimate: total bytes over the mean length of the first rows."""
    first = df.orderBy(key).limit(sample).agg(F.count("*").alias("sampled"), F.avg(F.octet_length(text) + 1).alias("mean_bytes"))
    total = df.agg(F.sum(F.octet_length(text) + 1).alias("bytes"))
    return first.crossJoin(F.broadcast(total)).select("sampled", "mean_bytes", F.floor(F.col("bytes") / F.col("mean_bytes")).alias("estimate"))
