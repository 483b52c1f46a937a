"""Sources and sinks.

All readers are Spark data sources with explicit schemas (no inference
passes); file-derived facts (run and pass names, checkpoint step numbers)
come from the hidden ``_metadata.file_path`` column. Trees of training runs hold many small
files: tasks list and read those (``run_tree``), so that the driver does not list them.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chatloom.session import checkpoint_dir, cut_lineage

MESSAGE_FIELDS = "role string, content variant, name string, tool_calls variant, tool_call_id string"
REQUEST_SCHEMA = (
    "request_id bigint, conversation_id string, user string, timestamp timestamp_ntz, model string, n int, "
    "temperature double, top_p double, max_tokens int, presence_penalty double, frequency_penalty double, "
    f"top_logprobs int, messages array<struct<{MESSAGE_FIELDS}>>, _corrupt_record string"
)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def sliced_stream(df: DataFrame, order: str, slices: int = 3, closing: DataFrame | None = None) -> tuple[DataFrame, list[Callable[[], None]]]:
    """``df`` as a stream that arrives in ``slices`` parts, ascending by ``order`` (nulls first), and then ``closing``.

    Returns the stream and one function per part that adds it to the stream's folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "slices")
    shares = [(i + 1) / slices for i in range(slices - 1)]
    at = F.col(order) if df.schema[order].dataType.typeName() != "timestamp_ntz" else F.unix_micros(F.col(order).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(at, shares, 10_000).alias("cuts")).first().cuts or []
    place = F.lit(0)
    for cut in cuts:
        place = place + F.coalesce(at > cut, F.lit(False)).cast("int")

    def add(part: int) -> Callable[[], None]:
        return lambda: df.where(place == part).write.mode("append").parquet(path)

    df.limit(0).write.parquet(path)
    feeds = [add(i) for i in range(len(cuts) + 1)]
    if closing is not None:
        feeds.append(lambda: closing.select(df.columns).write.mode("append").parquet(path))
    return spark.readStream.schema(df.schema).parquet(path), feeds


def closing_row(df: DataFrame, event_time: str, after: dt.timedelta) -> DataFrame:
    """One row of nulls but for its event time, ``after`` past the latest of ``df``: it moves a stream's watermark past all of them."""
    last = df.agg(F.max(event_time).alias("last")).select(F.timestamp_add("MICROSECOND", F.lit(int(after.total_seconds() * 1_000_000)).cast("long"), F.col("last")).alias("last"))
    return last.select(*[(F.col("last") if f.name == event_time else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields])


def write_request_log(requests: DataFrame, path: str) -> None:
    """Chat requests as JSON lines with polymorphic content written as raw JSON values."""
    msgs = F.transform(
        "messages",
        lambda m: F.struct(
            m["role"].alias("role"),
            F.try_parse_json(m["content"]).alias("content"),
            m["name"].alias("name"),
            F.try_parse_json(m["tool_calls"]).alias("tool_calls"),
            m["tool_call_id"].alias("tool_call_id"),
        ),
    )
    cols = [c for c in requests.columns if c != "messages"]
    requests.select(F.to_json(F.struct(*cols, msgs.alias("messages"))).alias("value")).write.mode("overwrite").text(path)


def _normalise_messages(df: DataFrame) -> DataFrame:
    """Variant content -> JSON text, the representation the content functions take."""
    return df.withColumn(
        "messages",
        F.transform(
            "messages",
            lambda m: F.struct(
                m["role"].alias("role"),
                F.to_json(m["content"]).alias("content"),
                m["name"].alias("name"),
                F.to_json(m["tool_calls"]).alias("tool_calls"),
                m["tool_call_id"].alias("tool_call_id"),
            ),
        ),
    )


def read_requests(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Chat-request log, one JSON object per line; bad lines kept in ``_corrupt_record``."""
    reader = (spark.readStream if stream else spark.read).schema(REQUEST_SCHEMA).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record"
    )
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _normalise_messages(reader.json(path))


CHECKPOINT_SCHEMA = (
    "checkpoint_id string, adapter_path string, timestamp string, metrics map<string,double>, "
    "parent_checkpoint string, training_samples bigint, can_rollback boolean, deployed boolean, gguf_model_path string"
)


def read_checkpoints(spark: SparkSession, directory: str) -> DataFrame:
    """S3: every ``*_metadata.json`` (one JSON document per file), newest first; unreadable files skipped."""
    df = (
        spark.read.schema(CHECKPOINT_SCHEMA)
        .option("multiLine", True)
        .option("mode", "DROPMALFORMED")
        .option("pathGlobFilter", "*_metadata.json")
        .json(directory)
        .where(F.col("checkpoint_id").isNotNull())
        .withColumn("source_file", F.col("_metadata.file_path"))
    )
    return df.orderBy(F.col("timestamp").desc_nulls_last(), F.col("checkpoint_id").desc())


META_SCHEMA = "timestamp string, train_loss double, eval_loss double, train_samples bigint, val_samples bigint, epochs double"
STATE_SCHEMA = "global_step bigint, log_history array<struct<eval_loss:double,eval_runtime:double,loss:double,step:bigint>>"


#: The files of a run whose content is read; of the others the path is enough.
RUN_DOCUMENTS = ("training_metadata.json", "trainer_state.json")


def _hidden(rel: str) -> bool:
    """Whether Spark's readers would pass over a file with this path."""
    return any(x.startswith(".") or (x.startswith("_") and "=" not in x) or x.endswith("._COPYING_") for x in rel.split("/"))


def _decoded(content: bytes) -> str | None:
    try:
        return content.decode(json.detect_encoding(content))
    except UnicodeDecodeError:
        return None


def run_tree(spark: SparkSession, root: str) -> DataFrame:
    """(rel, content), pinned: the files in the run folders of ``root``, with the content of ``RUN_DOCUMENTS``.

    One task lists the names of the run folders; they are dealt out, and the tasks list and read
    them. No file's status or content goes through the driver, and the tree is listed once. A root
    that only Spark's file systems open is listed by Spark.
    """
    base = re.sub("^file:/*", "/", root)
    try:
        there = fs.FileSystem.from_uri(base)[0].get_file_info(fs.FileSystem.from_uri(base)[1]).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        there = False
    if not there:
        rel = F.regexp_replace("path", _root_pattern(root), "").alias("rel")
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        contents = reader.option("pathGlobFilter", f"{{{','.join(RUN_DOCUMENTS)}}}").load(root).select(rel, "content").mapInPandas(
            lambda batches: (pdf.assign(content=pdf["content"].map(_decoded)) for pdf in batches), "rel string, content string")
        paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(rel)
        return cut_lineage(paths.join(contents, "rel", "left"))

    def folders(batches):
        store, top = fs.FileSystem.from_uri(base)
        for _ in batches:
            yield pd.DataFrame({"run": [x.base_name for x in store.get_file_info(fs.FileSelector(top)) if x.type == fs.FileType.Directory]})

    def files(batches):
        store, top = fs.FileSystem.from_uri(base)
        rows, held = [], 0
        for pdf in batches:
            for run in pdf["run"]:
                for x in store.get_file_info(fs.FileSelector(f"{top.rstrip('/')}/{run}", recursive=True)):
                    rel = x.path[len(top.rstrip("/")) + 1:]
                    if not x.is_file or _hidden(rel):
                        continue
                    content = None
                    if x.base_name in RUN_DOCUMENTS:
                        with store.open_input_stream(x.path) as own:
                            content = _decoded(own.read())
                    rows.append((rel, content))
                    held += len(rel) + len(content or "")
                    if held > 4 << 20:
                        yield pd.DataFrame(rows, columns=["rel", "content"], dtype=object)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["rel", "content"], dtype=object)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = spark.range(0, 1, 1, 1).mapInPandas(folders, "run string").repartition(parts, "run")
    return cut_lineage(runs.mapInPandas(files, "rel string, content string"))


def _documents(files: DataFrame, name: str, schema: str) -> DataFrame:
    """(rel, the columns of ``schema``) of the JSON documents of this name (one a file, or a list of them); malformed ones are skipped."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    content = F.col("content")
    one = F.from_json(content, f"{schema}, _bad string", options)
    found = F.when(content.rlike(r"^\s*\["), F.from_json(content, f"array<struct<{_struct_fields(schema)},_bad:string>>", options)).otherwise(F.array(one))
    rows = files.where(F.element_at(F.split("rel", "/"), -1) == name).select("rel", F.explode(found).alias("_doc"))
    return rows.where(F.col("_doc").isNotNull() & F.col("_doc._bad").isNull()).select("rel", "_doc.*").drop("_bad")


def _struct_fields(schema: str) -> str:
    return StructType.fromDDL(schema).simpleString()[len("struct<"):-1]


def _run_folders(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run, pass_dir) of all pass folders, and (run, pass_dir, folder) of the highest-numbered checkpoint folder of every run or pass.

    Folders are seen through the files in them; a name without a number counts as 0.
    """
    run = F.regexp_extract("rel", r"^([^/]+)/", 1).alias("run")
    passes = files.select(run, F.regexp_extract("rel", r"^[^/]+/(pass_[^/]*)/", 1).alias("pass_dir")).where("pass_dir <> ''").distinct()
    own = files.where(F.col("rel").rlike(r"^[^/]+/(pass_[^/]*/)?checkpoint-[^/]*/")).select(
        run, F.regexp_extract("rel", r"^[^/]+/(pass_[^/]*)/", 1).alias("pass_dir"),
        F.regexp_extract("rel", r"^[^/]+/(?:pass_[^/]*/)?(checkpoint-[^/]*)/", 1).alias("folder"))
    number = F.coalesce(F.regexp_extract("folder", r"^checkpoint-([0-9]+)(-|$)", 1).try_cast("bigint"), F.lit(0))
    highest = own.groupBy("run", "pass_dir").agg(F.max_by("folder", F.struct(number, "folder")).alias("folder"))
    return passes, highest


def _states(files: DataFrame, schema: str, highest: DataFrame) -> DataFrame:
    """Trainer states in the highest checkpoint folders: (run, pass_dir, the columns of ``schema``); unreadable ones are skipped."""
    return (
        _documents(files.where(F.col("rel").rlike(r"^[^/]+/(pass_[^/]*/)?checkpoint-[^/]*/trainer_state\.json$")), "trainer_state.json", schema)
        .withColumns({
            "run": F.regexp_extract("rel", r"^([^/]+)/", 1), "pass_dir": F.regexp_extract("rel", r"^[^/]+/(pass_[^/]*)/", 1),
            "folder": F.regexp_extract("rel", r"/(checkpoint-[^/]*)/", 1)})
        .join(highest, ["run", "pass_dir", "folder"], "left_semi").drop("rel", "folder")
    )


def read_training_history(spark: SparkSession, directory: str) -> DataFrame:
    """One row per run, or per ``pass_N_layers_A_B`` folder of a run that has pass folders.

    The last ``log_history`` entry of the ``trainer_state.json`` in the highest-numbered
    ``checkpoint-K`` folder overrides ``eval_loss`` when non-null and supplies ``eval_runtime``
    and ``global_step``; a highest folder without a readable state changes nothing.
    Ascending by timestamp.
    """
    files = run_tree(spark, directory.rstrip("/"))
    passes, highest = _run_folders(files)
    meta = (
        _documents(files, "training_metadata.json", META_SCHEMA).withColumnRenamed("rel", "_rel")
        .withColumns({"run": F.regexp_extract("_rel", r"^([^/]+)/", 1),
                      "pass_dir": F.regexp_extract("_rel", r"^[^/]+/(pass_[^/]+)/training_metadata\.json$", 1)})
        .where((F.size(F.split("_rel", "/")) == 2) | F.col("pass_dir").rlike("^pass_[0-9]+_[^_]*_[^_]*_[^_]*"))
    )
    # a run with pass folders, reported or not, has rows for its passes only
    meta = meta.join(passes.select("run").distinct().withColumn("_seq", F.lit(True)), "run", "left").where(
        F.col("_seq").isNull() == (F.col("pass_dir") == ""))
    states = _states(files, STATE_SCHEMA, highest).where(F.size("log_history") > 0).select(
        "run", "pass_dir", "global_step", F.element_at("log_history", -1).alias("_last"))
    j = meta.join(states, ["run", "pass_dir"], "left")
    pass_no = F.regexp_extract("pass_dir", r"^pass_([0-9]+)_", 1).try_cast("int")
    layers = F.concat(F.regexp_extract("pass_dir", r"^pass_[^_]+_[^_]*_([^_]*)_", 1), F.lit("-"),
                      F.regexp_extract("pass_dir", r"^pass_[^_]+_[^_]*_[^_]*_([^_/]*)", 1))
    name = F.when(F.col("pass_dir") == "", F.col("run")).otherwise(
        F.format_string("%s - Pass %d (Layers %s)", F.col("run"), pass_no, layers)
    )
    return j.select(
        "timestamp",
        "train_loss",
        F.coalesce(F.col("_last.eval_loss"), F.col("eval_loss")).alias("eval_loss"),
        "train_samples",
        "val_samples",
        "epochs",
        name.alias("checkpoint_name"),
        F.col("_last.eval_runtime").alias("eval_runtime"),
        "global_step",
    ).orderBy(F.coalesce(F.col("timestamp"), F.lit("")), "checkpoint_name")


def _root_pattern(directory: str) -> str:
    """Regex of a file path's part up to and including ``directory``, whatever scheme either is written with."""
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", directory.rstrip("/"))
    return "^.*?" + re.escape(path) + "/"


def write_files(files: DataFrame, directory: str) -> None:
    """One text file per row of (path relative to ``directory``, content), written by the tasks.

    Rows are dealt out by path: a small table, of few partitions, may describe many files.
    Rewriting a path replaces it, so a retried task leaves the same files."""
    base = re.sub("^file:/*", "/", directory.rstrip("/"))

    def write(batches):
        store, root = fs.FileSystem.from_uri(base)
        made = None
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                target = f"{root}/{path}"
                if (folder := target.rpartition("/")[0]) != made:
                    store.create_dir(folder, recursive=True)
                    made = folder
                with store.open_output_stream(target) as out:
                    out.write(content.encode())
            yield pdf[["path"]]

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files.select("path", "content").repartition(parts, "path").mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()


# Keywords of the relevant-log filter.
LOG_KEYWORDS = ["Training", "PASS", "epoch", "loss", "CPU", "Merging", "complete"]


def scan_training_logs(lines: DataFrame, tail: int = 50, keep: int = 10) -> DataFrame:
    """Per log (log_id, line_no, line): mode label, first PASS / Epoch / timestamp, and the
    last ``keep`` keyword lines among the last ``tail`` lines, stripped, in original order.

    First matches are ``min_by`` aggregates; the tail uses rank filters that Spark
    turns into a partial per-partition limit before the shuffle.
    """
    # fixed values: the trainer's log formats
    pass_rx = r"PASS (\d+)/(\d+): Training layers (\d+)-(\d+)"
    epoch_rx = r"Epoch (\d+)/(\d+)"
    ts_rx = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
    line = F.col("line")
    firsts = lines.groupBy("log_id").agg(
        F.bool_or(line.contains("CPU TRAINING MODE ENABLED")).alias("_cpu"),
        F.bool_or(line.contains("Loading base model")).alias("_load"),
        F.bool_or(line.contains("8-bit quantization")).alias("_8bit"),
        F.min_by(line, F.when(line.rlike(pass_rx), F.col("line_no"))).alias("_pass"),
        F.min_by(line, F.when(line.rlike(epoch_rx), F.col("line_no"))).alias("_epoch"),
        F.min_by(line, F.when(line.rlike(ts_rx), F.col("line_no"))).alias("_ts"),
    )
    summary = firsts.select(
        "log_id",
        F.when(F.col("_cpu"), F.lit("CPU")).when(F.col("_load") & F.col("_8bit"), F.lit("GPU (8-bit)")).alias("training_mode"),
        F.regexp_extract("_pass", pass_rx, 1).try_cast("int").alias("current_pass"),
        F.regexp_extract("_pass", pass_rx, 2).try_cast("int").alias("total_passes"),
        F.when(F.col("_pass").isNotNull(), F.concat(F.regexp_extract("_pass", pass_rx, 3), F.lit("-"), F.regexp_extract("_pass", pass_rx, 4))).alias("current_layers"),
        F.regexp_extract("_epoch", epoch_rx, 1).try_cast("int").alias("current_epoch"),
        F.regexp_extract("_epoch", epoch_rx, 2).try_cast("int").alias("total_epochs"),
        F.when(F.col("_ts").isNotNull(), F.regexp_extract("_ts", ts_rx, 1)).alias("last_log_time"),
    )
    by_log = Window.partitionBy("log_id").orderBy(F.col("line_no").desc())
    hit = None
    for k in LOG_KEYWORDS:
        hit = line.contains(k) if hit is None else (hit | line.contains(k))
    recent = lines.withColumn("_r", F.row_number().over(by_log)).where(F.col("_r") <= tail).where(hit)
    recent = recent.withColumn("_h", F.row_number().over(by_log)).where(F.col("_h") <= keep)
    from chatloom.functions.content import WS

    logs = recent.groupBy("log_id").agg(
        F.array_sort(F.collect_list(F.struct("line_no", F.regexp_replace(line, f"^{WS}+|{WS}+$", "").alias("l")))).alias("_l")
    ).select("log_id", F.transform("_l", lambda x: x["l"]).alias("logs"))
    return summary.join(logs, "log_id", "left").withColumn("logs", F.coalesce("logs", F.array().cast("array<string>")))


def write_interactions(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append interactions as parquet partitioned by date (enables partition pruning)."""
    df.withColumn("date", F.to_date("timestamp")).write.mode(mode).partitionBy("date").parquet(path)


def batch_sink(path: str):
    """Writes a micro-batch to a partition ``batch=<id>`` of its own, so a replayed batch replaces itself."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_interactions(batch, f"{path.rstrip('/')}/batch={batch_id}", mode="overwrite")

    return sink


def write_interactions_stream(stream: DataFrame, path: str, checkpoint: str):
    """S6 (streaming): each micro-batch through ``batch_sink``; exactly-once by batch id.

    The table is partitioned by ``batch`` and ``date``.
    """
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch_sink(path))


def export_training_set(ds: DataFrame, path: str) -> None:
    """SFT or DPO rows as JSON lines for a trainer."""
    ds.write.mode("overwrite").json(path)


PASS_STATE_SCHEMA = (
    "epoch double, global_step bigint, max_steps bigint, "
    "log_history array<struct<eval_loss:double,eval_runtime:double,loss:double,step:bigint>>"
)


def read_pass_tree(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files of sequential runs: (pass metadata, latest trainer state per pass, pass directories seen).

    A pass directory is any ``<run>/pass_N_layers_A_B/`` holding at least one file.
    """
    files = run_tree(spark, directory.rstrip("/"))
    run = F.regexp_extract("_rel", r"^([^/]+)/", 1)
    pdir = F.regexp_extract("_rel", r"^[^/]+/(pass_[0-9]+_[^/]+)/", 1)
    meta = (
        _documents(files, "training_metadata.json", META_SCHEMA).withColumnRenamed("rel", "_rel").select(run.alias("run"), pdir.alias("pass_dir"), "*")
        .where(F.col("pass_dir") != "").drop("_rel")
    )
    passes, highest = _run_folders(files)
    states = _states(files, PASS_STATE_SCHEMA, highest).where("pass_dir <> ''").select(
        "run", "pass_dir", F.struct("epoch", "global_step", "max_steps", F.try_element_at("log_history", F.lit(-1)).alias("_last")).alias("_st"))
    return meta, states, passes.where(F.col("pass_dir").rlike("^pass_[0-9]+_"))
