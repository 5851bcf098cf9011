"""Ledger lakes and archives as tables: listings, manifests, states and access logs."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions.ids import key_range

#: Fixed values of the format: object metadata (numbers with their greatest value) and the manifest's fields.
METADATA_NUMBERS = {"start-ledger": 2**32 - 1, "end-ledger": 2**32 - 1, "start-ledger-close-time": None, "end-ledger-close-time": None, "protocol-version": 2**32 - 1}
METADATA_TEXTS = ("core-version", "network-passphrase", "compression-type", "version")
MANIFEST = ".config.json"
MANIFEST_FIELDS = ("networkPassphrase", "version", "compression", "ledgersPerBatch", "batchesPerPartition")


def listing(spark: SparkSession, folder: str, *, glob: str = "*") -> DataFrame:
    """Files below a folder: (path, size); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("size"))


def ledger_files(files: DataFrame, *, path: str = "path", after: str | None = None, up_to: str | None = None) -> DataFrame:
    """Ledger files between two keys with the sequences they hold; files that name none are left out."""
    first, last = key_range(F.col(path))
    out = files.withColumns({"first": first, "last": last}).where("first is not null")
    if after is not None:
        out = out.where(F.col(path) > after)
    return out if up_to is None else out.where(F.col(path) <= up_to)


def covering(files: DataFrame, *, low: int, high: int) -> DataFrame:
    """The files that hold a sequence from ``low`` to ``high``."""
    return files.where((F.col("last") >= low) & (F.col("first") <= high))


def archive_files(files: DataFrame, *, path: str = "path") -> DataFrame:
    """An archive's checkpoint files: (category, checkpoint)."""
    pattern = r"(?:^|/)([a-z]+)/[0-9a-f]{2}/[0-9a-f]{2}/[0-9a-f]{2}/\1-([0-9a-f]{8})\."
    found = files.select(F.regexp_extract(path, pattern, 1).alias("category"), F.conv(F.regexp_extract(path, pattern, 2), 16, 10).cast("long").alias("checkpoint"))
    return found.where("category <> ''")


def archive_states(spark: SparkSession, folder: str) -> DataFrame:
    """Archive states (JSON), one row a file: server, current ledger and the hashes of all levels."""
    schema = "version int, server string, currentLedger long, networkPassphrase string, currentBuckets array<struct<curr:string,snap:string,next:struct<state:int,output:string>>>"
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(folder)


def object_metadata(metadata: Column) -> Column:
    """A struct of what a ledger file's object metadata (a map of texts) says; nulls for what it lacks. A number that is none, or is out of range, is an error."""

    def number(key: str, top: int | None) -> Column:
        text = F.try_element_at(metadata, F.lit(key))
        value = text.cast("long")  # fails on what is no number
        return value if top is None else F.when((value < 0) | (value > top), F.raise_error(F.concat(F.lit(f"{key} out of range: "), text)).cast("long")).otherwise(value)

    return F.struct(
        *[number(k, top).alias(k.replace("-", "_")) for k, top in METADATA_NUMBERS.items()],
        *[F.try_element_at(metadata, F.lit(k)).alias(k.replace("-", "_")) for k in METADATA_TEXTS],
    )


def _manifest(spark: SparkSession, folder: str, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _checked(schema: dict) -> dict:
    files, ledgers = schema.get("batchesPerPartition") or 0, schema.get("ledgersPerBatch") or 0
    if files < 1 or ledgers < 1 or files * ledgers >= 2**32:
        raise ValueError(f"ledgersPerBatch ({ledgers}) and batchesPerPartition ({files}) must be above 0 and their product below 2^32")
    return schema


def read_manifest(spark: SparkSession, folder: str, *, name: str = MANIFEST) -> dict | None:
    """A lake's manifest, null if it has none."""
    path, fs = _manifest(spark, folder, name)
    if not fs.exists(path):
        return None
    opened = fs.open(path)  # by the file system, as Spark's readers skip names that begin with a dot
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))
    finally:
        opened.close()
    return {k: found[k] for k in MANIFEST_FIELDS if found.get(k) is not None}


def load_schema(spark: SparkSession, folder: str, config: dict, *, name: str = MANIFEST) -> dict:
    """How a lake packs its ledgers: by its manifest; without one by ``config``, which must then say so."""
    found = read_manifest(spark, folder, name=name)
    source = config if found is None else found
    return _checked({k: source.get(k) for k in ("ledgersPerBatch", "batchesPerPartition")})


def publish_manifest(spark: SparkSession, folder: str, config: dict, *, name: str = MANIFEST) -> tuple[dict, bool]:
    """The lake's manifest and whether it was made now, from ``config``; one that is there must agree with all that ``config`` sets."""
    path, fs = _manifest(spark, folder, name)
    if not fs.exists(path):
        _checked(config)
    try:
        out = fs.create(path, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
            raise
    else:
        out.write(bytearray(json.dumps(config), "utf-8"))
        out.close()
        return config, True
    found = read_manifest(spark, folder, name=name) or {}
    differ = [f"{k}: {v!r} here, {found.get(k)!r} there" for k, v in config.items() if v and found.get(k) != v]
    if differ:
        raise ValueError("the manifest differs: " + "; ".join(differ))
    return _checked(found), False


def requests(lines: DataFrame, *, line: str = "value", status: str = "^2", path: str | None = None) -> DataFrame:
    """GET requests of access-log lines with a matching target status: (method, uri). The quoted request has three parts."""
    asked = F.split(F.regexp_extract(line, r'"([A-Z]+ [^"]*)"', 1), " ")
    fields = F.split(F.col(line), " ")
    out = lines.select(asked.alias("asked"), F.get(fields, F.lit(9)).alias("status")).where((F.size("asked") == 3) & F.col("status").rlike(status))
    out = out.select(F.col("asked")[0].alias("method"), F.col("asked")[1].alias("uri")).where("method = 'GET'")
    return out if path is None else out.where(F.col("uri").rlike(path))


def route_of(uri: Column, routes: list[tuple[str, str]]) -> Column:
    """The name of the first route whose pattern fits; else the address itself."""
    out = uri
    for pattern, name in reversed(routes):
        out = F.when(uri.rlike(pattern), F.lit(name)).otherwise(out)
    return out
