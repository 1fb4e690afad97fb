"""Readers and writers: text logs of messages, codebooks, electrode tables, binary recordings, sessions.

A log has one message a line: `rts:<int> sts:<int>  t:<TYPE> ts:<int> <payload> <-<client>`. Lines of other types are
dropped. Order within a session is (sts, ts, line hash): line numbers do not survive split files.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Message types in the order in which a line is tested for them.
TYPES = ["STIMULUSEVENT", "DATAPACKET", "MODECHANGE", "NEWTARGET", "SELECTION", "DATAHEADER", "PREDICTEDTARGETPROB"]


def _once(df: DataFrame, **columns) -> DataFrame:
    """df + columns, each worked out once a row: a filter on them, or on what is made of them, does not repeat their expressions."""
    d = df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once"))
    return d.select(*[c for c in df.columns if c not in columns], *[f"_once.{n}" for n in columns])


def parse_log(lines: DataFrame, server_time: bool = True) -> DataFrame:
    """lines(session, value) -> session, rts, sts, ts, raw_ts, msg_type, client, payload."""
    kind = F.lit(None).cast("string")
    for t in reversed(TYPES):
        kind = F.when(F.col("value").contains(t), t).otherwise(kind)
    num = lambda name: F.regexp_extract("value", rf"\b{name}:(-?\d+)", 1).try_cast("long")
    raw = F.regexp_extract("value", r"\st:\w+\s+ts:(-?\d+)", 1).try_cast("long")
    d = _once(lines, value=F.col("value")).withColumn("msg_type", kind).where("msg_type is not null")
    return d.select(
        "session", num("rts").alias("rts"), num("sts").alias("sts"), (num("sts") if server_time else raw).alias("ts"), raw.alias("raw_ts"), "msg_type",
        F.regexp_extract("value", r"<-(\S*)\s*$", 1).alias("client"), F.trim(F.regexp_extract("value", r"\st:\w+\s+ts:-?\d+(.*?)(?:<-\S*\s*)?$", 1)).alias("payload"),
    )


def read_log(spark: SparkSession, path: str, server_time: bool = True) -> DataFrame:
    """Messages of all recordings at a path or glob; the session is the file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("session"), "value")
    return parse_log(lines, server_time)


def parse_stimulus(messages: DataFrame) -> DataFrame:
    """session, ts, obj, state (0..255) of STIMULUSEVENT payloads `v[n]:{id,state}{id,state}`."""
    pairs = F.regexp_extract_all("payload", F.lit(r"\{(-?\d+,-?\d+)\}"), F.lit(1))
    d = messages.where("msg_type = 'STIMULUSEVENT'").select("session", "ts", F.explode(pairs).alias("_p"))
    state = F.split("_p", ",")[1].try_cast("int")
    return d.select("session", "ts", F.split("_p", ",")[0].try_cast("int").alias("obj"), F.when(state < 0, state + 256).otherwise(state).alias("state"))


def parse_packets(messages: DataFrame) -> DataFrame:
    """session, ts, rts, nsamp, samples (array of arrays) of DATAPACKET payloads `v[nchxnsamp]:[a,b,][c,d,]`. The numbers are
    read in order and cut to the shape told, samples first."""
    a, b = (F.regexp_extract("payload", r"v\[(\d+)x(\d+)\]", k).try_cast("int") for k in (1, 2))
    numbers = F.transform(F.regexp_extract_all(F.regexp_extract("payload", r"\]:(.*)$", 1), F.lit(r"([-+0-9.eE]+)"), F.lit(1)), lambda x: x.try_cast("double"))
    d = _once(messages.where("msg_type = 'DATAPACKET'"), _n=b, _m=a, _v=numbers).where("_n > 0 and _m > 0 and size(_v) >= _n * _m")
    rows = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.slice("_v", (i * F.col("_m") + 1).try_cast("int"), F.col("_m")))
    return d.select("session", "ts", "rts", F.col("_n").alias("nsamp"), rows.alias("samples"))


def explode_packets(packets: DataFrame) -> DataFrame:
    return packets.select("session", "ts", "nsamp", F.posexplode("samples").alias("k", "x"))


def parse_markers(messages: DataFrame) -> DataFrame:
    """session, ts, kind, obj, mode of NEWTARGET, SELECTION (with its id) and MODECHANGE."""
    d = messages.where(F.col("msg_type").isin("NEWTARGET", "SELECTION", "MODECHANGE"))
    number = F.regexp_extract("payload", r"\b(?:id|objID):(-?\d+)", 1)
    mode = F.regexp_extract("payload", r"mode:(\S+)", 1)
    return d.select("session", "ts", F.col("msg_type").alias("kind"), F.when(number != "", number.try_cast("int")).alias("obj"), F.when(mode != "", mode).alias("mode"))


def parse_headers(messages: DataFrame) -> DataFrame:
    """session, ts, fs, nch, labels of DATAHEADER payloads `fs250.0 ch[2]:Cz,Pz`."""
    d = messages.where("msg_type = 'DATAHEADER'")
    labels = F.transform(F.split(F.regexp_extract("payload", r"ch\[\d+\]:(\S*)", 1), ","), lambda x: F.trim(x))
    return d.select("session", "ts", F.regexp_extract("payload", r"fs:?([0-9.]+)", 1).try_cast("double").alias("fs"), F.regexp_extract("payload", r"ch\[(\d+)\]", 1).try_cast("int").alias("nch"), labels.alias("labels"))


def parse_predictions(messages: DataFrame) -> DataFrame:
    d = messages.where("msg_type = 'PREDICTEDTARGETPROB'")
    return d.select("session", "ts", F.regexp_extract("payload", r"Yest:(-?\d+)", 1).try_cast("int").alias("yest"), F.regexp_extract("payload", r"Perr:([-0-9.eE]+)", 1).try_cast("double").alias("perr"))


def parse_codebook(files: DataFrame) -> DataFrame:
    """files(name, value: whole text) -> name, event_idx, time_ms, obj, level. The first array holds times, the second one row
    an object; `#` starts a comment, arrays end at an empty line."""
    text = F.regexp_replace("value", r"#[^\n]*", "")
    arrays = F.filter(F.split(text, r"\n\s*\n"), lambda a: F.trim(F.regexp_replace(a, r"\s+", " ")) != "")
    words = lambda s: F.filter(F.split(F.trim(s), r"[\s,]+"), lambda w: w != "")
    d = files.select("name", F.transform(words(F.element_at(arrays, 1)), lambda w: w.try_cast("double")).alias("_t"), F.filter(F.split(F.element_at(arrays, 2), "\n"), lambda r: F.trim(r) != "").alias("_r"))
    d = d.select("name", "_t", F.posexplode("_r").alias("obj", "_row")).select("name", "_t", "obj", F.posexplode(words(F.col("_row"))).alias("event_idx", "_v"))
    return d.select("name", "event_idx", F.element_at("_t", F.col("event_idx") + 1).alias("time_ms"), "obj", F.col("_v").try_cast("double").alias("level"))


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    return parse_codebook(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value"))


def cap_positions(cap: DataFrame) -> DataFrame:
    """cap(name, lat, lng, and more) + xyz and xy; angles over two pi are degrees (for the whole table)."""
    import math

    most = cap.agg(F.greatest(F.max(F.abs("lat")), F.max(F.abs("lng"))).alias("_most"))  # one row
    turn = F.when(F.col("_most") > 2 * math.pi, math.pi / 180).otherwise(1.0)
    d = cap.join(F.broadcast(most)).withColumns({"_a": F.col("lat") * turn, "_b": F.col("lng") * turn})
    return d.select(*cap.columns, (F.sin("_a") * F.cos("_b")).alias("x3"), (F.sin("_a") * F.sin("_b")).alias("y3"), F.cos("_a").alias("z3"), (F.col("_a") * F.cos("_b")).alias("x2"), (F.col("_a") * F.sin("_b")).alias("y2"))


def read_cap(spark: SparkSession, path: str) -> DataFrame:
    return cap_positions(spark.read.csv(path, sep="\t", schema="name string, lat double, lng double"))


def list_sessions(spark: SparkSession, path: str, matching: str = ".*", newest: int = 0) -> DataFrame:
    """session, path, run (the last number of the file name), modified, bytes; newest: only so many."""
    f = spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).where(F.col("path").rlike(matching))
    name = F.element_at(F.split("path", "/"), -1)
    run = F.regexp_extract(name, r"(\d+)\D*$", 1)
    d = f.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("session"), "path", F.when(run != "", run.try_cast("int")).alias("run"), "modified", "bytes")
    return d.orderBy(F.desc("modified"), "path").limit(newest) if newest else d.orderBy("run", "path")


#: The numbers of the value types of a recorded buffer, as numpy names (0 are characters).
VALUE_TYPES = {0: "S1", 1: "<u1", 2: "<u2", 3: "<u4", 4: "<u8", 5: "<i1", 6: "<i2", 7: "<i4", 8: "<i8", 9: "<f4", 10: "<f8"}
HEADER = "session string, nch int, nsamp long, nevents long, fs double, data_type int"


def _session(path: str) -> str:
    return path.rstrip("/").rsplit("/", 2)[-2]


def read_buffer_header(spark: SparkSession, path: str) -> DataFrame:
    """session (the folder's name), nch, nsamp, nevents, fs, data_type of recordings under path: one file `header` a session, of
    three unsigned integers, a float and two unsigned integers, each of four bytes."""
    from pulsegrid.shared import ship

    ship(spark)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(_session(p), *struct.unpack_from("<IIIfI", bytes(c))) for p, c in zip(f["path"], f["content"], strict=True) if len(c) >= 20]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER.split(", ")])

    return spark.read.format("binaryFile").load(f"{path}/*/header").select("path", "content").mapInPandas(decode, HEADER)


def read_buffer_dir(spark: SparkSession, path: str, slice_bytes: int = 64 << 20) -> DataFrame:
    """session, samp, x of recordings: the file `samples` of a session holds nch values a sample of the header's type. A file of any size is
    read by many tasks, each a range of whole samples of about slice_bytes; bytes after the last whole sample are left out. The folder must be one that pyarrow
    can open (local, HDFS, S3, Google Cloud)."""
    from pulsegrid.shared import ship

    ship(spark)
    files = spark.read.format("binaryFile").load(f"{path}/*/samples").select("path", F.col("length"), F.element_at(F.split("path", "/"), -2).alias("session"))  # names and lengths alone
    d = files.join(F.broadcast(read_buffer_header(spark, path).select("session", "nch", "data_type")), "session")  # a row a recording
    width = F.element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in VALUE_TYPES]), F.array(*[F.lit(np.dtype(t).itemsize) for t in VALUE_TYPES.values()])), F.col("data_type")) * F.col("nch")
    d = d.withColumn("width", width.cast("long")).withColumn("n", F.floor(F.col("length") / F.col("width"))).where("n > 0")
    per = F.greatest(F.floor(F.lit(slice_bytes) / F.col("width")), F.lit(1))
    d = d.withColumn("per", per).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("per"))))
    d = d.select("session", "path", "nch", "data_type", "width", "first", F.least("per", F.col("n") - F.col("first")).alias("count"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    d = d.repartition(tasks, "path", "first")  # a number: the adaptive planner would join such short rows into one task

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, at = pafs.FileSystem.from_uri(_uri(r["path"]))
                with fs.open_input_file(at) as f:
                    f.seek(r["first"] * r["width"])
                    for k in range(0, r["count"], 10_000):
                        n = min(10_000, r["count"] - k)
                        x = np.frombuffer(f.read(n * r["width"]), VALUE_TYPES[r["data_type"]]).astype(float)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * r["nch"], pa.int32()), pa.array(x))
                        yield pa.RecordBatch.from_arrays([pa.repeat(r["session"], n), pa.array(np.arange(n) + r["first"] + k), lists], names=["session", "samp", "x"])

    return d.mapInArrow(decode, "session string, samp long, x array<double>")


def _uri(path: str) -> str:
    """file:/a as file:///a."""
    return re.sub(r"^file:/+", "file:///", path)


def read_buffer_events(spark: SparkSession, path: str) -> DataFrame:
    """session, samp, type, value, offset, duration of the file `events` of each session. Records are eight four-byte numbers
    (type and value: kind and count of each; sample, offset, duration, bytes of the payload) and the payload. Numbers that are
    no characters are joined by commas; a record whose payload is too short is left out."""
    from pulsegrid.shared import ship

    ship(spark)
    schema = "session string, samp long, type string, value string, offset int, duration int"

    def said(kind: int, n: int, raw: bytes) -> str:
        return raw.decode("utf-8", "replace") if kind == 0 else ",".join(str(v) for v in np.frombuffer(raw, VALUE_TYPES[kind], n).tolist())

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                rows, at, content = [], 0, bytes(content)
                while at + 32 <= len(content):
                    tk, tn, vk, vn, samp, offset, duration, size = struct.unpack_from("<IIIIiiiI", content, at)
                    body = content[at + 32 : at + 32 + size]
                    at += 32 + size
                    if tk in VALUE_TYPES and vk in VALUE_TYPES:
                        a, b = (n * np.dtype(VALUE_TYPES[k]).itemsize for k, n in ((tk, tn), (vk, vn)))
                        if a + b <= len(body):
                            rows.append((_session(p), samp, said(tk, tn, body[:a]), said(vk, vn, body[a : a + b]), offset, duration))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(f"{path}/*/events").select("path", "content").mapInPandas(decode, schema)


def save(df: DataFrame, path: str, by: str = "session") -> None:
    """Trial data, statistics or scores as Parquet, in folders by session."""
    df.write.partitionBy(by).mode("overwrite").parquet(path)
