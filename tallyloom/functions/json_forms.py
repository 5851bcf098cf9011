"""JSON of operations, effects, claim predicates and prices as columns, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.staged import staged

_ASSET = "asset_type string, asset_code string, asset_issuer string"
_OFFER = "amount string, price string, price_r struct<n:long,d:long>, buying_asset_type string, buying_asset_code string, buying_asset_issuer string, selling_asset_type string, selling_asset_code string, selling_asset_issuer string"
_PATH = f"{_ASSET}, from string, to string, amount string, path array<struct<asset_type:string,asset_code:string,asset_issuer:string>>, source_amount string, source_asset_type string, source_asset_code string, source_asset_issuer string"
#: Fields of all operations, and those of each type by its number. Fixed values of the format.
OPERATION = "id string, paging_token string, transaction_successful boolean, source_account string, type string, type_i int, created_at string, transaction_hash string"
OPERATIONS = {
    0: "starting_balance string, funder string, account string",
    1: f"{_ASSET}, from string, to string, amount string",
    2: f"{_PATH}, source_max string",
    3: f"{_OFFER}, offer_id string",
    4: _OFFER,
    5: "home_domain string, inflation_dest string, master_key_weight int, signer_key string, signer_weight int, set_flags array<int>, clear_flags array<int>, low_threshold int, med_threshold int, high_threshold int",
    6: f"{_ASSET}, limit string, trustee string, trustor string, liquidity_pool_id string",
    7: f"{_ASSET}, trustee string, trustor string, authorize boolean, authorize_to_maintain_liabilities boolean",
    8: "account string, into string",
    9: "",
    10: "name string, value string",
    11: "bump_to string",
    12: f"{_OFFER}, offer_id string",
    13: f"{_PATH}, destination_min string",
    14: "asset string, amount string, claimants array<struct<destination:string>>",
    15: "balance_id string, claimant string",
    16: "sponsored_id string",
    17: "begin_sponsor string",
    18: "account_id string, claimable_balance_id string, data_account_id string, data_name string, offer_id string, trustline_account_id string, trustline_asset string, signer_account_id string, signer_key string",
    19: f"{_ASSET}, from string, amount string",
    20: "balance_id string",
    21: f"{_ASSET}, trustor string, set_flags array<int>, clear_flags array<int>",
    22: "liquidity_pool_id string, reserves_max array<struct<asset:string,amount:string>>, min_price string, max_price string, reserves_deposited array<struct<asset:string,amount:string>>, shares_received string",
    23: "liquidity_pool_id string, reserves_min array<struct<asset:string,amount:string>>, shares string, reserves_received array<struct<asset:string,amount:string>>",
    24: "function string, parameters array<struct<value:string,type:string>>, address string, salt string",
    25: "extend_to int",
    26: "",
}


def typed_operations(rows: DataFrame, json: str) -> DataFrame:
    """Operations of all types from their JSON, in one pass: what all have, and for each type a struct ``own_<type_i>`` of its own fields.

    A text is parsed once, to a VARIANT, and read by the fields of its type; the structs of other types are null. Text that
    is no JSON, or that has no known type, gives no row. Written with ``partitionBy("type_i")``, the rows of a type are a folder
    whose files hold its struct alone, so that types need not be told apart again.
    """
    c = F.col
    parsed = staged(rows.select(F.try_parse_json(json).alias("__v")), {"type_i": F.try_variant_get("__v", "$.type_i", "int"), "__v": c("__v")})
    parsed = parsed.where(c("type_i").isin(*OPERATIONS))
    common = [x.strip().split(" ")[0] for x in OPERATION.split(",")]
    kinds = dict(x.strip().split(" ", 1) for x in OPERATION.split(","))
    shared = [F.try_variant_get("__v", f"$.{n}", kinds[n]).alias(n) for n in common if n != "type_i"]
    own = [F.when(c("type_i") == k, F.try_variant_get("__v", "$", "struct<" + ", ".join(_fields(kind)) + ">")).alias(f"own_{k}") for k, kind in OPERATIONS.items() if kind]
    return parsed.select("type_i", *shared, *own)


def _fields(text: str) -> list[str]:
    """``name kind, ...`` as ``name: kind`` parts; commas inside angle brackets do not part."""
    out, depth = [""], 0
    for ch in text:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [f"`{n}`: {kind}" for n, kind in (x.strip().split(" ", 1) for x in out)]


def operation_rows(rows: DataFrame, json: str, type_i: int) -> DataFrame:
    """Operations of one type, with the fields that all have and those that this type has."""
    out = typed_operations(rows, json).where(F.col("type_i") == type_i)
    shared = [x.strip().split(" ")[0] for x in OPERATION.split(",")]
    return out.select(*shared, *([f"own_{type_i}.*"] if OPERATIONS[type_i] else []))


def effect_rows(rows: DataFrame, json: str) -> DataFrame:
    """Effects from their JSON: what all have, and ``details``, the text of all other fields by name."""
    common = ("id", "paging_token", "account", "type", "type_i", "created_at")
    parsed = rows.select(F.from_json(json, "map<string,string>").alias("m"))
    return parsed.select(*[F.try_element_at("m", F.lit(n)).cast("int" if n == "type_i" else "string").alias(n) for n in common], F.map_filter("m", lambda k, _: ~k.isin(*common)).alias("details"))


def price(json: Column) -> Column:
    """n and d of a price, given as numbers or as text; null where there is none."""
    return F.struct(*[F.get_json_object(json, f"$.{k}").try_cast("long").alias(k) for k in ("n", "d")])


def iso_seconds(text: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 time in UTC, of any year, also beyond four digits or below 0; null for other text."""
    pattern = r"^([-+]?\d+)-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})Z$"
    y, m, d, hh, mm, ss = (F.regexp_extract(text, pattern, k).try_cast("long") for k in range(1, 7))
    year = y - F.when(m <= 2, 1).otherwise(0)  # years from March on, in cycles of 400
    era = F.floor(year / 400)
    of_era = year - era * 400
    of_year = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    days = era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468
    return F.when(text.rlike(pattern), (days * 86400 + hh * 3600 + mm * 60 + ss).cast("long"))


def predicate(json: Column) -> Column:
    """A claim predicate as (kind, seconds, parts); of several keys the first in this order counts: unconditional, rel_before, abs_before, not, and, or.

    ``parts`` is the JSON of the predicates inside, to be read in the same way.
    """
    at = lambda key: F.get_json_object(json, f"$.{key}")
    many = lambda key: F.from_json(at(key), "array<string>")
    make = lambda kind, seconds=None, parts=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None) if seconds is None else seconds).cast("long").alias("seconds"), (F.lit(None) if parts is None else parts).cast("array<string>").alias("parts"))
    return (
        F.when(at("unconditional") == "true", make("unconditional"))
        .when(at("rel_before").isNotNull(), make("rel_before", at("rel_before").try_cast("long")))
        .when(at("abs_before").isNotNull(), make("abs_before", iso_seconds(at("abs_before"))))
        .when(at("not").isNotNull(), make("not", parts=F.array(at("not"))))
        .when(at("and").isNotNull(), make("and", parts=many("and")))
        .when(at("or").isNotNull(), make("or", parts=many("or")))
    )


def predicate_json(kind: Column, seconds: Column, parts: Column) -> Column:
    """The JSON of a predicate from what ``predicate`` returns; times as ISO 8601 in UTC and as seconds."""
    inner = F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    iso = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return (
        F.when(kind == "unconditional", F.lit('{"unconditional":true}'))
        .when(kind == "rel_before", F.concat(F.lit('{"rel_before":"'), seconds.cast("string"), F.lit('"}')))
        .when(kind == "abs_before", F.concat(F.lit('{"abs_before":"'), iso, F.lit('","abs_before_epoch":"'), seconds.cast("string"), F.lit('"}')))
        .when(kind == "not", F.concat(F.lit('{"not":'), F.get(parts, F.lit(0)), F.lit("}")))
        .when(kind.isin("and", "or"), F.concat(F.lit('{"'), kind, F.lit('":'), inner, F.lit("}")))
    )


def event_types(text: Column) -> Column:
    """A comma-joined list of event types as a sorted set; empty for empty text."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")))
