"""Digests of archive contents from the bytes up, and what they say of the digests that headers state. Digests are hex texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Digest of a result set without entries: four zero bytes. Fixed value of the format.
EMPTY_RESULTS = "df3f619804a92fdb4057192dc43dd748ea778adc52bc498ce80524c014b81119"
#: Encodings of transaction sets without transactions, around the hash of the header before: the old form, two sequential
#: phases, and a sequential and a parallel one. Fixed values of the format.
EMPTY_SETS = (("", ""), ("00000001", "00000002" + "00000000" * 4), ("00000001", "00000002" + "00000000" * 2 + "00000001" + "00000000" * 2))


def digest(hexed: Column) -> Column:
    """SHA-256 of bytes in hex; null for null and for text that is no hex."""
    return F.sha2(F.try_to_binary(hexed, F.lit("hex")), 256)


def level_hash(curr: Column, snap: Column) -> Column:
    """Digest of a level's two hashes; an empty or null one adds no byte, one that is not of 32 bytes makes it null."""
    part = lambda h: F.when(F.coalesce(h, F.lit("")) == "", F.lit(b"")).when(F.octet_length(h) == 64, F.unhex(h))
    return F.sha2(F.concat(part(curr), part(snap)), 256)


def bucket_list_hash(levels: Column) -> Column:
    """Digest over the digests of all levels (structs of ``curr`` and ``snap``) in their order; null if one of them is."""
    each = F.transform(levels, lambda level: level_hash(level["curr"], level["snap"]))
    return F.sha2(F.unhex(F.array_join(each, "", "no hex")), 256)


def set_hashes(envelopes: DataFrame, headers: DataFrame, *, sequence: str = "sequence", body: str = "body", previous: str = "prev_hash") -> DataFrame:
    """(sequence, hash) of the old form of transaction sets: the hash of the header before, then all envelopes by their own digest.

    Envelopes that are the same twice count twice. A ledger without envelopes gives no row. A digest needs its bytes
    together, so one ledger's envelopes meet in one row; a ledger is bounded by the network, not by the archive. Digests and
    bodies are moved as bytes, half as long as their text, and sort alike.
    """
    one = F.struct(F.unhex(F.sha2(body, 256)).alias("own"), F.col(body).cast("binary").alias("bytes"))
    sets = envelopes.groupBy(sequence).agg(F.array_sort(F.collect_list(one)).alias("__txs"))
    rows = sets.join(headers.select(sequence, previous), sequence)
    return rows.select(sequence, digest(F.concat(F.col(previous), F.array_join(F.transform("__txs", lambda x: F.hex(x["bytes"])), ""))).alias("hash"))


def is_empty_set(stated: Column, previous: Column) -> Column:
    """Is the stated hash that of a set without transactions, in any form?"""
    return stated.isin(*[digest(F.concat(F.lit(head), previous, F.lit(tail))) for head, tail in EMPTY_SETS])


def hash_report(headers: DataFrame, sets: DataFrame, results: DataFrame) -> DataFrame:
    """What in an archive is not what headers say, as (what, sequence, expected, actual); ``actual`` is null where the object is missing.

    ``headers``: (sequence, content: binary, hash, prev_hash, set_hash, result_hash). ``sets`` and ``results``: (sequence, hash) of what is
    there, by ``set_hashes`` or the digest of the bytes. Four checks: ``header content``, a header's bytes against its own hash;
    ``ledger header``, the hash that the next header names; ``transaction set`` and ``result set``, the hashes that headers name. Missing
    objects do not count where none is needed: the header before the first, sets and result sets without entries. One
    left join each, by sequence; nothing but wrong rows is kept.
    """
    c = F.col
    own = headers.select(F.lit("header content").alias("what"), "sequence", c("hash").alias("expected"), F.sha2("content", 256).alias("actual")).where(~c("expected").eqNullSafe(c("actual")))
    first = headers.agg(F.min("sequence").alias("__first"))

    def against(what: str, expected: DataFrame, actual: DataFrame, exempt: Column) -> DataFrame:
        found = expected.join(actual.select(c("sequence").alias("__of"), c("hash").alias("actual")), c("sequence") == c("__of"), "left")
        wrong = ~c("expected").eqNullSafe(c("actual")) & ~(c("actual").isNull() & F.coalesce(exempt, F.lit(False)))
        return found.where(wrong).select(F.lit(what).alias("what"), "sequence", "expected", "actual")

    before = headers.select((c("sequence") - 1).alias("sequence"), c("prev_hash").alias("expected")).crossJoin(F.broadcast(first))  # one row
    chain = against("ledger header", before, headers.select("sequence", F.sha2("content", 256).alias("hash")), c("sequence") == c("__first") - 1)
    txs = against("transaction set", headers.select("sequence", c("set_hash").alias("expected"), is_empty_set(c("set_hash"), c("prev_hash")).alias("__empty")), sets, c("__empty"))
    outcome = against("result set", headers.select("sequence", c("result_hash").alias("expected")), results, c("expected") == EMPTY_RESULTS)
    return own.unionByName(chain).unionByName(txs).unionByName(outcome)


def bucket_report(referenced: DataFrame, buckets: DataFrame) -> DataFrame:
    """(hash, verdict) of all buckets that states refer to: ``missing``, ``invalid`` (its content has another digest) or ``ok``.

    ``referenced``: (hash), with repeats; empty hashes and those of zeros stand for no bucket. ``buckets``: (hash, content: binary), the
    name that a bucket has and its bytes, unpacked. Contents are digested where they are read; only digests are shuffled.
    """
    c = F.col
    wanted = referenced.where(~F.coalesce(c("hash"), F.lit("")).isin("", "0" * 64)).select("hash").distinct()
    there = buckets.select(c("hash").alias("__name"), (F.sha2("content", 256) == c("hash")).alias("__same"))
    there = there.groupBy("__name").agg(F.bool_and(F.coalesce("__same", F.lit(False))).alias("__same"))
    verdict = F.when(c("__name").isNull(), "missing").when(c("__same"), "ok").otherwise("invalid")
    return wanted.join(there, c("hash") == c("__name"), "left").select("hash", verdict.alias("verdict"))


def list_hash_report(states: DataFrame, headers: DataFrame) -> DataFrame:
    """(sequence, expected, actual) of states (sequence, levels) whose bucket lists are not what the header (sequence, bucket_list_hash) of their ledger names."""
    c = F.col
    told = headers.select("sequence", c("bucket_list_hash").alias("expected"))
    found = states.select("sequence", bucket_list_hash(c("levels")).alias("actual")).join(told, "sequence", "left")
    return found.where(~c("expected").eqNullSafe(c("actual"))).select("sequence", "expected", "actual")
