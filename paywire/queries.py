"""Registered queries over the messages of plans.synth, each with DuckDB SQL over the source tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywire.functions import ebcdic, sm
from paywire.functions.bytesx import bcd_decode, bcd_encode, hexdump, squeeze, to_hex
from paywire.operators import conformance as conf
from paywire.operators import fixed, mtmx, mx, redact, swift
from paywire.operators.fieldspec import SpecTable
from paywire.operators.gates import Gate
from paywire.operators import iso8583 as iso
from paywire.plans import synth
from paywire.sources import files, log, store
from paywire.sources.places import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def registered(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return registered


_CENTS = "floor(o_totalprice * 100 + 0.5)::BIGINT"
_CODE = "CASE o_orderstatus WHEN 'F' THEN '00' WHEN 'O' THEN '05' ELSE '12' END"
_PAN = "'4' || lpad(o_custkey::VARCHAR, 15, '0')"
SPEC = conf.MaskSpec("orders", (conf.Mask(7, "volatile"), conf.Mask(11, "volatile"), conf.Mask(52, "crypto"), conf.Mask(49, "intended-delta", b"840")))


@query(f"""
SELECT * FROM (
  SELECT o_orderkey, unnest([0, 2, 3, 4, 7, 11, 39, 41, 48, 49, 70]) AS number,
    unnest(['0210', {_PAN}, left(o_orderpriority, 1) || '00000', lpad({_CENTS}::VARCHAR, 12, '0'), strftime(o_orderdate, '%m%d%H%M%S'), lpad((o_orderkey % 1000000)::VARCHAR, 6, '0'),
      {_CODE}, 'T' || lpad((o_custkey % 10000000)::VARCHAR, 7, '0'), o_orderpriority, '840', CASE WHEN o_orderkey % 5 = 0 THEN '301' END]) AS value FROM orders) WHERE value IS NOT NULL""")
def iso8583_parse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = synth.iso_wires(spark, sf_dir).select("o_orderkey", iso.parse(F.col("wire"), "hybrid").alias("m"))
    return iso.long_view(parsed, "m", ["o_orderkey"]).select("o_orderkey", "number", F.decode("value", "US-ASCII").alias("value"))


@query(f"SELECT {_CODE} AS code, count(*) AS n, sum({_CENTS})::BIGINT AS cents FROM orders GROUP BY ALL")
def iso8583_response_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = synth.iso_wires(spark, sf_dir).select(iso.parse(F.col("wire"), "hybrid").alias("m"))
    values = m.select(*(F.decode(iso.field(F.col("m"), n), "US-ASCII").alias(f"f{n}") for n in (4, 39)))
    return values.groupBy(F.col("f39").alias("code")).agg(F.count("*").alias("n"), F.sum(F.col("f4").cast("long")).alias("cents"))


@query("SELECT o_orderkey % 5 = 0 AS wide, count(*) AS n, count(*) FILTER (o_orderkey % 5 = 0) AS with_70 FROM orders GROUP BY ALL")
def iso8583_secondary_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wires = synth.iso_wires(spark, sf_dir)
    seen = wires.select((F.substring(F.hex("wire"), 9, 1) >= "8").alias("wide"), iso.field(iso.parse(F.col("wire"), "hybrid"), 70).alias("f70"))
    return seen.groupBy("wide").agg(F.count("*").alias("n"), F.count("f70").alias("with_70"))


@query(f"""
SELECT CASE o_orderkey % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'ascii' ELSE 'binary' END AS dialect, {_CODE} AS code, count(*) AS n, sum(o_custkey)::BIGINT AS customers
FROM orders GROUP BY ALL""")
def iso8583_dialect_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = synth.iso_wires(spark, sf_dir, dialect=None).select(iso.sniff(F.col("wire")).alias("m"))
    text = lambda n: F.decode(iso.field(F.col("m"), n), "US-ASCII")
    rows = m.select(F.col("m.dialect").alias("dialect"), text(39).alias("code"), F.substring(text(2), 2, 15).cast("long").alias("customer"))
    return rows.groupBy("dialect", "code").agg(F.count("*").alias("n"), F.sum("customer").alias("customers"))


@query(f"""
SELECT o_orderkey, lower(hex('0210') || CASE WHEN o_orderkey % 5 = 0 THEN 'F22000000281800004' || '00000000000000' ELSE '7220000002818000' END
  || hex('16' || {_PAN} || left(o_orderpriority, 1) || '00000' || lpad({_CENTS}::VARCHAR, 12, '0') || strftime(o_orderdate, '%m%d%H%M%S')
  || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') || {_CODE} || 'T' || lpad((o_custkey % 10000000)::VARCHAR, 7, '0')
  || lpad(length(o_orderpriority)::VARCHAR, 3, '0') || o_orderpriority || '840' || CASE WHEN o_orderkey % 5 = 0 THEN '301' ELSE '' END)) AS wire_hex
FROM orders""")
def iso8583_build_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.iso_wires(spark, sf_dir).select("o_orderkey", to_hex(F.col("wire")).alias("wire_hex"))


@query("""
SELECT o_orderkey % 4 AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'InsufficientBytes' WHEN 1 THEN 'TrailingBytes' WHEN 2 THEN 'InvalidMti' END AS code, count(*) AS n
FROM orders GROUP BY ALL""")
def iso8583_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, wire = F.col("o_orderkey") % 4, F.col("wire")
    cut = F.expr("substring(wire, 1, octet_length(wire) - 1)")
    damaged = F.when(kind == 0, cut).when(kind == 1, F.concat(wire, F.lit(bytearray(b"x")))).when(kind == 2, F.concat(F.lit(bytearray(b"X")), F.expr("substring(wire, 2)"))).otherwise(wire)
    rows = synth.iso_wires(spark, sf_dir).select(kind.alias("kind"), iso.parse(damaged, "hybrid")["error"]["code"].alias("code"))
    return rows.groupBy("kind", "code").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderkey % 5 = 0 AS rejected, CASE WHEN o_orderkey % 5 = 0 THEN 70 ELSE 0 END AS field FROM orders")
def iso8583_closed_spec_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paywire.operators.fieldspec import FieldSpec

    own = FieldSpec()
    closed = FieldSpec.closed("no 70", [d for n, d in own.fields.items() if n != 70])
    error = F.col("e")
    return synth.iso_wires(spark, sf_dir).select("o_orderkey", iso.parse(F.col("wire"), "hybrid", closed)["error"].alias("e")).select("o_orderkey", error.isNotNull().alias("rejected"), F.coalesce(error["field"], F.lit(0)).alias("field"))


@query("""
SELECT o_orderkey % 10 AS k, CASE o_orderkey % 10 WHEN 0 THEN 'ISO 8583:1987' WHEN 1 THEN 'ISO 8583:1993' WHEN 2 THEN 'ISO 8583:2003' WHEN 8 THEN 'National' WHEN 9 THEN 'Private' ELSE 'Reserved' END AS version,
  'Financial' AS class, 'Request response' AS function, 'Acquirer' AS origin, count(*) AS n FROM orders GROUP BY ALL""")
def iso8583_mti_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 10
    rows = synth.table(spark, sf_dir, "orders").select(k.alias("k"), iso.decode_mti(F.concat(k.cast("string"), F.lit("210"))).alias("m"))
    return rows.groupBy("k", "m.version", "m.class", "m.function", "m.origin").agg(F.count("*").alias("n"))


@query("SELECT CASE o_orderkey % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'ascii' ELSE 'binary' END AS dialect, o_orderkey % 3 = 0 AS ok, true AS same_ok, count(*) AS n FROM orders GROUP BY ALL")
def iso8583_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wires = synth.iso_wires(spark, sf_dir, dialect=None)
    dialect = F.when(F.col("o_orderkey") % 3 == 0, "hybrid").when(F.col("o_orderkey") % 3 == 1, "ascii").otherwise("binary")
    rows = iso.round_trip(iso.round_trip(wires, "wire").withColumnRenamed("trip", "t"), "wire", same_dialect=True)
    rows = rows.select(dialect.alias("dialect"), F.col("t.ok").alias("ok"), F.col("trip.ok").alias("same_ok"))
    return rows.groupBy("dialect", "ok", "same_ok").agg(F.count("*").alias("n"))


_DIFF = """
WITH f AS (
  SELECT o_orderkey, unnest([0, 2, 3, 4, 7, 11, 39, 41, 48, 49, 52, 70]) AS field, o_orderpriority AS p FROM orders),
d AS (
  SELECT o_orderkey, field::INT AS field,
    CASE WHEN field IN (7, 11) THEN 'volatile' WHEN field = 52 THEN 'crypto' WHEN field = 49 THEN 'intended-delta' ELSE 'stable' END AS mask,
    CASE WHEN field IN (7, 11) THEN 'volatile-normalized' WHEN field = 52 THEN 'crypto-excluded' WHEN field = 49 THEN 'intended-delta'
         WHEN field = 39 AND o_orderkey % 11 = 0 OR field = 41 AND o_orderkey % 17 = 0 OR field = 48 AND o_orderkey % 13 = 0 THEN 'UNEXPLAINED' ELSE 'equal' END AS verdict,
    CASE WHEN field = 39 AND o_orderkey % 11 = 0 THEN 'value_diff' WHEN field = 41 AND o_orderkey % 17 = 0 THEN 'presence_mismatch' WHEN field = 48 AND o_orderkey % 13 = 0 THEN 'length_diff' END AS reason
  FROM f WHERE field <> 70 OR o_orderkey % 5 = 0)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conf.check_wires(synth.captures(spark, sf_dir), ["o_orderkey"], "request", "legacy", "migrated", SPEC)


@query(_DIFF + "SELECT * FROM d")
def conformance_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).drop("counted")


_COVER = """, c AS (
  SELECT o_orderkey, count(*) FILTER (mask IN ('stable', 'intended-delta') AND verdict IN ('equal', 'intended-delta')) AS checked, count(*) FILTER (mask IN ('stable', 'intended-delta')) AS total,
    max((verdict = 'UNEXPLAINED')::INT) AS gate FROM d GROUP BY 1)"""


@query(_DIFF + _COVER + "SELECT o_orderkey, checked, total, (100 * checked // total)::INT AS percent, gate FROM c")
def conformance_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = synth.captures(spark, sf_dir)
    return conf.capture_coverage(conf.wire_diffs(captures, ["o_orderkey"], "request", "legacy", "migrated", SPEC), ["o_orderkey"])


@query(_DIFF + _COVER + "SELECT count(*) AS inputs, count(*) FILTER (gate = 1) AS drifted, 0::BIGINT AS errors, max(gate) AS gate FROM c")
def conformance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conf.batch_gate(conformance_coverage(spark, sf_dir))


@query("SELECT o_orderkey, 41 AS number FROM orders WHERE o_orderkey % 17 = 0")
def conformance_lost_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields on the legacy side alone, by an anti join of the long views.

    Spark takes a view for smaller than its table, as it doesn't count the rows that the fields become, so it is told not to broadcast it.
    """
    view = lambda migrated: iso.long_view(synth.iso_wires(spark, sf_dir, migrated).select("o_orderkey", iso.parse(F.col("wire"), "hybrid").alias("m")), "m", ["o_orderkey"]).select("o_orderkey", "number")
    return view(False).join(view(True).hint("merge"), ["o_orderkey", "number"], "left_anti")


@query(_DIFF + "SELECT field, mask, verdict, reason, count(*) AS n FROM d GROUP BY ALL")
def conformance_long_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same diff from two separate tables of fields, by a full outer join."""
    view = lambda migrated: iso.long_view(synth.iso_wires(spark, sf_dir, migrated).select("o_orderkey", iso.parse(F.col("wire"), "hybrid").alias("m")), "m", ["o_orderkey"]).withColumn("occurrence", F.lit(0))
    rows = conf.diff_views(view(False), view(True), ["o_orderkey"], SPEC)
    return rows.groupBy("field", "mask", "verdict", "reason").agg(F.count("*").alias("n"))


@query("""
SELECT * FROM (
  SELECT o_orderkey, unnest(['20', '32A', '50K', '59', '70']) AS tag,
    unnest([o_orderkey::VARCHAR, strftime(o_orderdate, '%y%m%d') || 'USD' || (c // 100)::VARCHAR || ',' || lpad((c % 100)::VARCHAR, 2, '0'),
      '/12345' || chr(13) || chr(10) || left(rtrim(repeat(c_name || ' ', (1 + o_orderkey % 9)::INT)), 140), '/67890' || chr(13) || chr(10) || 'SOME CREDITOR', CASE WHEN o_orderkey % 4 <> 0 THEN 'ORDER ' || o_orderkey || ' PAID' END]) AS value
  FROM (SELECT *, floor(o_totalprice * 100 + 0.5)::BIGINT AS c FROM orders JOIN customer ON o_custkey = c_custkey)) WHERE value IS NOT NULL""")
def swift_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = synth.mt_mx(spark, sf_dir).select("o_orderkey", F.explode(swift.parse(F.col("mt"))["b4"]).alias("f"))
    return parsed.select("o_orderkey", "f.tag", "f.value")


@query("""
SELECT o_orderkey % 4 AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'InvalidDate' WHEN 1 THEN 'InvalidCurrency' WHEN 2 THEN 'InvalidAmount' END AS error, count(*) AS n,
  count(*) FILTER (o_orderkey % 4 = 3) AS currencies FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def swift_32a_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, kind = F.col("raw"), F.col("o_orderkey") % 4
    rows = synth.mt_mx(spark, sf_dir).select("o_orderkey", swift.first(swift.parse(F.col("mt"))["b4"], "32A").alias("raw"))
    bad = F.when(kind == 0, F.concat(F.lit("010230"), F.expr("substring(raw, 7)"))).when(kind == 1, F.concat(F.left(raw, F.lit(6)), F.lit("us1"), F.expr("substring(raw, 10)"))).when(kind == 2, F.replace(raw, F.lit(","), F.lit("."))).otherwise(raw)
    found = rows.select(kind.alias("kind"), swift.decode_32a(bad).alias("d"))
    return found.groupBy("kind", F.col("d.error").alias("error")).agg(F.count("*").alias("n"), F.count("d.currency").alias("currencies"))


@query("""
SELECT o_orderkey, CASE WHEN ok THEN '12345' END AS account, CASE WHEN ok THEN replace(upper(name), '#', '-') END AS name, CASE WHEN NOT ok THEN 'InvalidLength' END AS error
FROM (SELECT *, length(name) <= 35 AS ok FROM (SELECT o_orderkey, left(rtrim(repeat(c_name || ' ', (1 + o_orderkey % 9)::INT)), 140) AS name FROM orders JOIN customer ON o_custkey = c_custkey))""")
def swift_50k_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are in mixed case with a `#`, so they are judged in capitals without it; a refused field has no account."""
    raw = F.upper(F.replace(swift.first(swift.parse(F.col("mt"))["b4"], "50K"), F.lit("#"), F.lit("-")))
    rows = synth.mt_mx(spark, sf_dir).select("o_orderkey", raw.alias("raw")).select("o_orderkey", swift.decode_50k(F.col("raw")).alias("d"))
    return rows.select("o_orderkey", "d.account", F.array_join("d.lines", "|").alias("name"), "d.error")


@query("""
SELECT o_orderkey % 5 AS kind, CASE o_orderkey % 5 WHEN 0 THEN 'MissingTextTerminator' WHEN 1 THEN 'DuplicateBlock' WHEN 2 THEN 'UnbalancedBrace' WHEN 3 THEN 'UnexpectedTrailingBytes' END AS error, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def swift_block_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, mt = F.col("o_orderkey") % 5, F.col("mt")
    bad = F.when(kind == 0, F.replace(mt, F.lit("\r\n-}"), F.lit("}"))).when(kind == 1, F.concat(mt, F.lit("{1:AGAIN}"))).when(kind == 2, F.regexp_replace(mt, r"\}$", "")).when(kind == 3, F.concat(mt, F.lit("x"))).otherwise(mt)
    rows = synth.mt_mx(spark, sf_dir).select(kind.alias("kind"), swift.parse(bad)["error"].alias("error"))
    return rows.groupBy("kind", "error").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, true AS same FROM orders JOIN customer ON o_custkey = c_custkey")
def swift_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.mt_mx(spark, sf_dir).select("o_orderkey", "mt", swift.parse(F.col("mt")).alias("b"))
    return rows.select("o_orderkey", (swift.build(F.col("b"))["wire"] == F.col("mt")).alias("same"))


_TYPES = "CASE c_custkey % 5 WHEN 0 THEN 'pacs.008.001.08' WHEN 1 THEN 'pacs.004.001.09' WHEN 2 THEN 'pacs.003.001.08' WHEN 3 THEN 'pain.001.001.09' END"
_ADDRESS = f"""
WITH a AS (SELECT c_custkey, c_custkey % 4 AS s, c_custkey % 5 = 4 AS bad, left(n_name, 2) AS cc, {_TYPES} AS message_type FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (
  SELECT c_custkey, NULL::VARCHAR AS message_type, NULL::VARCHAR AS party, NULL::VARCHAR AS verdict, NULL::VARCHAR AS town_name, NULL::VARCHAR AS country, -1 AS unstructured_lines, 'MalformedXml' AS error FROM a WHERE bad
  UNION ALL SELECT c_custkey, message_type, 'debtor', 'compliant', 'Town ' || c_custkey, cc, 0, NULL FROM a WHERE NOT bad
  UNION ALL SELECT c_custkey, message_type, 'creditor', CASE s WHEN 0 THEN 'compliant' WHEN 3 THEN 'no_address' ELSE 'missing_structured' END,
    CASE WHEN s IN (0, 2) THEN 'Town ' || c_custkey END, CASE s WHEN 0 THEN cc END, CASE s WHEN 1 THEN 2 WHEN 3 THEN -1 ELSE 0 END, NULL FROM a WHERE NOT bad)"""


@query(_ADDRESS + "SELECT * FROM r")
def mx_address_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.check_addresses(synth.address_envelopes(spark, sf_dir), ["c_custkey"], "xml").drop("remediation").fillna(-1, ["unstructured_lines"])


@query(_ADDRESS + """, m AS (SELECT c_custkey, bool_or(error IS NOT NULL) AS e, coalesce(bool_and(verdict = 'compliant'), false) AS g FROM r GROUP BY 1)
SELECT count(*) FILTER (NOT e AND g) AS compliant, count(*) FILTER (NOT e AND NOT g) AS non_compliant, count(*) FILTER (e) AS errors, 2 AS gate FROM m""")
def mx_address_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.address_gate(mx.check_addresses(synth.address_envelopes(spark, sf_dir), ["c_custkey"], "xml"), ["c_custkey"])


@query(_ADDRESS + "SELECT message_type, party, verdict, count(*) AS n FROM r WHERE error IS NULL GROUP BY ALL")
def mx_address_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mx.check_addresses(synth.address_envelopes(spark, sf_dir), ["c_custkey"], "xml").where("error is null")
    return rows.groupBy("message_type", "party", "verdict").agg(F.count("*").alias("n"))


_PAIRS = """
WITH p AS (
  SELECT o_orderkey AS k, rtrim(repeat(c_name || ' ', (1 + o_orderkey % 9)::INT)) AS name FROM orders JOIN customer ON o_custkey = c_custkey),
v AS (
  SELECT k AS o_orderkey, 'debtor_name' AS role, CASE WHEN length(name) > 140 THEN 'truncated' ELSE 'equal' END AS verdict, CASE WHEN length(name) > 140 THEN name[141:] END AS lost_suffix FROM p
  UNION ALL SELECT k, 'creditor_name', CASE WHEN k % 7 = 0 THEN 'mismatch' ELSE 'equal' END, NULL FROM p
  UNION ALL SELECT k, 'remittance_info', CASE WHEN k % 12 = 0 THEN 'absent_both' WHEN k % 6 = 0 THEN 'added' WHEN k % 4 = 0 THEN 'dropped' WHEN k % 5 = 0 THEN 'reformatted' ELSE 'equal' END, NULL FROM p
  UNION ALL SELECT k, 'settlement_amount', 'equal', NULL FROM p
  UNION ALL SELECT k, 'settlement_currency', 'equal', NULL FROM p)"""


@query(_PAIRS + "SELECT role, verdict, count(*) AS n FROM v GROUP BY ALL")
def mtmx_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mtmx.diff(synth.mt_mx(spark, sf_dir), ["o_orderkey"], "mt", "mx")
    return rows.groupBy("role", "verdict").agg(F.count("*").alias("n"))


@query(_PAIRS + "SELECT o_orderkey, role, verdict, lost_suffix FROM v WHERE verdict IN ('truncated', 'dropped')")
def mtmx_lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtmx.lossy(mtmx.diff(synth.mt_mx(spark, sf_dir), ["o_orderkey"], "mt", "mx")).select("o_orderkey", "role", "verdict", "lost_suffix")


LAYOUT = fixed.Layout("reply", (("code", 4), ("status", 2), ("account", 20), ("amount", 12)))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("0210"), F.lit("OK"), F.lpad(F.col("l_orderkey").cast("string"), 20, "0"), F.lpad(F.floor(F.col("l_extendedprice")).cast("string"), 12, "0"), F.when(F.col("l_linenumber") == 7, "PLUS").otherwise(""))
    return synth.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.encode(text, "US-ASCII").alias("frame"))


@query("SELECT CASE l_linenumber WHEN 7 THEN 42 ELSE 38 END AS length, count(*) AS frames, count(*) FILTER (l_linenumber <> 7) AS matched, CASE WHEN bool_or(l_linenumber = 7) THEN '-' ELSE 'matched' END AS verdict FROM lineitem GROUP BY 1")
def layout_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed.by_length(_frames(spark, sf_dir), "frame", LAYOUT)


@query("SELECT count(*) AS frames, count(*) FILTER (l_linenumber <> 7) AS matched, 0 AS gate FROM lineitem")
def layout_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed.layout_gate(_frames(spark, sf_dir), "frame", LAYOUT)


@query("SELECT l_orderkey, l_linenumber, lpad(l_orderkey::VARCHAR, 20, '0') AS account, floor(l_extendedprice)::BIGINT AS amount FROM lineitem WHERE l_linenumber <> 7")
def layout_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = _frames(spark, sf_dir).select("l_orderkey", "l_linenumber", LAYOUT.tiles(F.col("frame")).alias("t")).where("t is not null")
    text = lambda k: F.decode(F.col("t")[k]["value"], "US-ASCII")
    return tiles.select("l_orderkey", "l_linenumber", text(2).alias("account"), text(3).cast("long").alias("amount"))


TRACE_KEYS = 5000  # order keys to a trace file


def _trace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: trace files of a customer group and a range of order keys: a dump of each priority, and one cut off at the end."""
    h = F.hex(F.encode("o_orderpriority", "US-ASCII"))
    pairs = F.regexp_extract_all(h, F.lit("(..)"), F.lit(1))
    dump = F.concat(F.lit("x\n[buffer dump: in length="), F.length("o_orderpriority").cast("string"), F.lit("]\n\n"), F.array_join(F.slice(pairs, 1, 16), " "), F.lit("  AB CD gutter\n"))
    path = F.concat_ws("/", F.col("o_custkey") % 50, F.floor(F.col("o_orderkey") / TRACE_KEYS))
    rows = synth.table(spark, sf_dir, "orders").groupBy(path.alias("path")).agg(F.array_join(F.collect_list(dump), "").alias("content"))
    return rows.withColumn("content", F.concat("content", F.lit("[buffer dump: in length=40]\n00 01\n")))


@query("SELECT o_custkey % 50 AS path, count(*) AS frames, sum(length(o_orderpriority))::BIGINT AS bytes, 1::BIGINT AS dropped FROM orders GROUP BY 1")
def trace_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces = files.explode_traces(_trace_files(spark, sf_dir)).withColumn("path", F.substring_index("path", "/", 1).cast("long"))
    return traces.groupBy("path").agg(F.count("frame").alias("frames"), F.sum(F.octet_length("frame")).cast("long").alias("bytes"), F.max("dropped").cast("long").alias("dropped"))


@query("SELECT c_custkey, lower(hex(translate(regexp_replace(upper(c_name), '[^A-I0-9]', '', 'g'), '0123456789ABCDEFGHI', 'ðñòóôõö÷øùÁÂÃÄÅÆÇÈÉ'))) AS utf8_of_codes FROM customer")
def ebcdic_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters A to I and digits; the codes are shown as the UTF-8 of the characters of those numbers."""
    data = ebcdic.encode(F.regexp_replace(F.upper("c_name"), "[^A-I0-9]", ""))["data"]
    return synth.table(spark, sf_dir, "customer").select("c_custkey", to_hex(F.encode(F.decode(data, "ISO-8859-1"), "UTF-8")).alias("utf8_of_codes"))


@query("SELECT c_custkey, c_name AS back_037, c_name AS back_500, c_custkey % 3 = 0 AS refused, CASE WHEN c_custkey % 3 = 0 THEN length(c_name) ELSE -1 END::INT AS position FROM customer")
def ebcdic_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("\u20ac"))).otherwise(F.col("c_name")).alias("odd"))
    back = lambda page: ebcdic.decode(ebcdic.encode(F.col("c_name"), page)["data"], page)
    odd = ebcdic.encode(F.col("odd"))
    return rows.select("c_custkey", back("037").alias("back_037"), back("500").alias("back_500"), odd["bad"].isNotNull().alias("refused"), F.coalesce(odd["position"], F.lit(-1)).alias("position"))


@query(f"SELECT o_orderkey, left({_PAN}, 6) || 'XXXXXX' || right({_PAN}, 4) AS pan, 'REDACTED' AS terminal, repeat('X', length(o_orderpriority)::INT) AS note, '2,41,48' AS touched, 100000::BIGINT AS anonymity, false AS low FROM orders")
def redact_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redact.sanitize(synth.iso_wires(spark, sf_dir), ["o_orderkey"], "wire")
    back = done.select("*", iso.parse(F.col("wire"), "hybrid").alias("m"))
    text = lambda n: F.decode(iso.field(F.col("m"), n), "US-ASCII")
    return back.select("o_orderkey", text(2).alias("pan"), text(41).alias("terminal"), text(48).alias("note"), F.array_join("touched", ",").alias("touched"), "anonymity", F.col("low_anonymity").alias("low"))


@query("SELECT CASE o_orderkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' ELSE 'PackedAccountNumber' END AS result, count(*) AS n FROM orders GROUP BY ALL")
def redact_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redact.sanitize(synth.iso_wires(spark, sf_dir, dialect=None), ["o_orderkey"], "wire")
    return done.groupBy(F.coalesce("error", F.lit("ok")).alias("result")).agg(F.count("*").alias("n"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of a source: of every third source the latest is cut by two bytes, of every third it has its last byte changed."""
    docs = synth.table(spark, sf_dir, "documents").select("source", "doc_id", F.encode("text", "UTF-8").alias("payload"))
    made = log.log_files(docs, "source", "doc_id", "payload")
    kind = F.when(F.col("latest"), F.substring("path", F.lit(4), F.length("path")).cast("int") % 3)
    cut = F.expr("substring(content, 1, octet_length(content) - 2)")
    bad = F.expr("concat(substring(content, 1, octet_length(content) - 1), unhex('00'))")
    return log.explode_logs(made.select("path", F.when(kind == 1, cut).when(kind == 2, bad).otherwise(F.col("content")).alias("content")))


_LOG = "WITH d AS (SELECT source AS path, doc_id, text, replace(source, 'src', '')::INT % 3 AS kind, doc_id = max(doc_id) OVER (PARTITION BY source) AS last FROM documents) "


@query(_LOG + "SELECT path, count(*) AS records, sum(strlen(text))::BIGINT AS bytes FROM d WHERE kind = 0 OR NOT last GROUP BY 1")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _logs(spark, sf_dir).where("payload is not null")
    return good.groupBy("path").agg(F.count("*").alias("records"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))


@query(_LOG + "SELECT path, CASE kind WHEN 1 THEN 'TruncatedPayload' ELSE 'Checksum' END AS kind, strlen(text)::BIGINT AS need FROM d WHERE last AND kind > 0")
def log_corruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logs(spark, sf_dir).where("tail is not null").select("path", F.col("tail.kind").alias("kind"), F.col("tail.need").alias("need"))


@query()
def sm3_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.table(spark, sf_dir, "documents").select("doc_id", to_hex(sm.sm3(F.encode("text", "UTF-8"))).alias("sm3"))


@query()
def sm4_encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in CBC mode and back."""
    key, iv = bytes(range(16)), bytes(range(16, 32))
    rows = synth.table(spark, sf_dir, "customer").select("c_custkey", "c_name", sm.sm4(F.encode("c_name", "UTF-8"), key, iv)["data"].alias("e"))
    return rows.select("c_custkey", to_hex(F.col("e")).alias("encrypted"), F.decode(sm.sm4(F.col("e"), key, iv, decrypt=True)["data"], "UTF-8").alias("back"))


@query("SELECT o_orderkey, lpad(o_custkey::VARCHAR, 7, '0') AS digits, '0' || lpad(o_custkey::VARCHAR, 7, '0') AS packed FROM orders")
def bcd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lpad(F.col("o_custkey").cast("string"), 7, "0")
    packed = bcd_encode(digits, 4)
    return synth.table(spark, sf_dir, "orders").select("o_orderkey", bcd_decode(packed, 7).alias("digits"), to_hex(packed).alias("packed"))


@query("SELECT c_custkey, '00000000  ' || rpad(array_to_string(regexp_extract_all(lower(hex(left(c_name, 8))), '..'), ' '), 23, ' ') || '  ' || repeat(' ', 23) || '  |' || left(c_name, 8) || '|' AS dump, 'a b' AS squeezed FROM customer")
def hexdump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.table(spark, sf_dir, "customer").select("c_custkey", hexdump(F.encode(F.left("c_name", F.lit(8)), "US-ASCII")).alias("dump"), squeeze(F.lit(" a\t \u00a0b\n")).alias("squeezed"))


@query()
def hexdump_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, dumped to the last byte, and squeezed; hexdump_lines holds the first line's form against SQL."""
    data = F.encode("text", "UTF-8")
    return synth.table(spark, sf_dir, "documents").select("doc_id", hexdump(data, 2**31 - 1).alias("dump"), squeeze(F.col("text")).alias("squeezed"))


@query("""
SELECT c_custkey, '00000000  ' || h1 || '  ' || h2 || '  |' || c_name[:16] || '|' || chr(10) || '00000010  ' || rpad(h3, 23, ' ') || '  ' || repeat(' ', 23) || '  |' || c_name[17:] || '|' AS dump
FROM (SELECT c_custkey, c_name, array_to_string(p[1:8], ' ') AS h1, array_to_string(p[9:16], ' ') AS h2, array_to_string(p[17:], ' ') AS h3
  FROM (SELECT *, regexp_extract_all(lower(hex(c_name)), '..') AS p FROM customer))""")
def hexdump_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole names, which take two lines."""
    return synth.table(spark, sf_dir, "customer").select("c_custkey", hexdump(F.encode("c_name", "US-ASCII")).alias("dump"))


def _replaced(start: int, text: str) -> F.Column:
    """The hybrid wire with `text` from byte `start` (from 1) on."""
    return F.expr(f"concat(substring(wire, 1, {start - 1}), encode('{text}', 'US-ASCII'), substring(wire, {start + len(text)}))")


@query("""
SELECT o_orderkey % 7 AS kind, CASE o_orderkey % 7 WHEN 0 THEN 'InvalidLengthPrefix' WHEN 1 THEN 'LengthExceedsMax' WHEN 2 THEN 'InvalidBitmapHex' WHEN 3 THEN 'InvalidBcdNibble' WHEN 4 THEN 'UnknownField' WHEN 5 THEN 'InsufficientBytes' END AS code,
  CASE WHEN o_orderkey % 7 IN (0, 1, 4) THEN 2 END::INT AS field, CASE WHEN o_orderkey % 7 IN (0, 3) THEN CASE o_orderkey % 7 WHEN 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 20 ELSE 12 END ELSE 0 END END::INT AS place, count(*) AS n
FROM orders GROUP BY ALL""")
def iso8583_more_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error kinds that iso8583_parse_errors does not make; places are those of a prefix and of the type."""
    from paywire.operators.fieldspec import FieldSpec

    closed = FieldSpec.closed("no 2", [d for n, d in FieldSpec().fields.items() if n != 2])
    kind, prefix = F.col("o_orderkey") % 7, F.when(F.col("o_orderkey") % 5 == 0, 21).otherwise(13)
    at_prefix = lambda text: F.when(prefix == 21, _replaced(21, text)).otherwise(_replaced(13, text))
    ways = [(at_prefix("x6"), "hybrid", None), (at_prefix("99"), "hybrid", None), (_replaced(5, "zz"), "ascii", None), (F.concat(F.lit(bytearray(b"\x0a\x10")), F.expr("substring(wire, 5)")), "binary", None), (F.col("wire"), "hybrid", closed), (F.expr("substring(wire, 1, 3)"), "hybrid", None)]
    error = F.lit(None).cast("struct<code:string,field:int,offset:int>")
    for k, (wire, dialect, spec) in enumerate(ways):
        found = iso.parse(wire, dialect, spec) if spec else iso.parse(wire, dialect)
        error = F.when(kind == k, found["error"].cast("struct<code:string,field:int,offset:int>")).otherwise(error)
    rows = synth.iso_wires(spark, sf_dir).select(kind.alias("kind"), error.alias("e"))
    return rows.groupBy("kind", F.col("e.code").alias("code"), F.when(F.col("kind").isin(0, 1, 4), F.col("e.field")).alias("field"), F.when(F.col("kind").isin(0, 3), F.col("e.offset")).alias("place")).agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey % 9 AS kind, CASE o_orderkey % 9 WHEN 0 THEN 'InvalidMti' WHEN 1 THEN 'InvalidFieldNumber' WHEN 2 THEN 'InvalidFieldNumber' WHEN 3 THEN 'InvalidValue' WHEN 4 THEN 'FixedLengthMismatch' WHEN 5 THEN 'LengthExceedsMax' WHEN 6 THEN 'InvalidBcdDigit' WHEN 7 THEN 'InvalidMti' END AS code,
  CASE o_orderkey % 9 WHEN 1 THEN 129 WHEN 3 THEN 3 WHEN 4 THEN 3 WHEN 5 THEN 2 WHEN 6 THEN 3 END::INT AS field, o_orderkey % 9 = 8 AS built, count(*) AS n
FROM orders GROUP BY ALL""")
def iso8583_build_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL numbers and values are errors like others, and fail no job."""
    kind = F.col("o_orderkey") % 9
    text = lambda c: F.encode(c, "US-ASCII")
    number = F.when(kind == 1, 129).when(kind == 2, F.lit(None)).when(kind == 5, 2).otherwise(3).cast("int")
    value = F.when(kind == 3, F.lit(None)).when(kind == 4, text(F.lit("1"))).when(kind == 5, text(F.repeat(F.lit("4"), F.lit(20)))).when(kind == 6, text(F.lit("12345x"))).otherwise(text(F.lit("000000")))
    mti = F.when(kind == 0, F.lit("02x0")).when(kind == 7, F.lit(None)).otherwise(F.lit("0210"))
    made = iso.build(mti, F.array(F.struct(number.alias("number"), value.alias("value"))), F.when(kind == 6, F.lit("binary")).otherwise(F.lit("hybrid")))
    rows = synth.table(spark, sf_dir, "orders").select(kind.alias("kind"), made.alias("b"))
    return rows.groupBy("kind", F.col("b.error.code").alias("code"), F.col("b.error.field").alias("field"), F.col("b.wire").isNotNull().alias("built")).agg(F.count("*").alias("n"))


@query(f"""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'InvalidFieldNumber' WHEN 2 THEN 'InvalidValue' END AS error,
  CASE WHEN o_orderkey % 4 IN (0, 3) THEN {_PAN} END AS pan, CASE o_orderkey % 4 WHEN 0 THEN 'abc' WHEN 3 THEN o_orderpriority END AS note
FROM orders""")
def iso8583_json_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written as JSON, with hex values, a key that is no number and hex that is none, built and parsed again."""
    kind = F.col("o_orderkey") % 4
    pan = F.concat(F.lit("4"), F.lpad(F.col("o_custkey").cast("string"), 15, "0"))
    note = F.when(kind == 0, F.lit('"48": "hex:61 62 63"')).when(kind == 1, F.lit('"x48": "abc"')).when(kind == 2, F.lit('"48": {"hex": "6"}')).otherwise(F.concat(F.lit('"48": {"hex": "'), F.hex(F.encode("o_orderpriority", "US-ASCII")), F.lit('"}')))
    text = F.concat(F.lit('{"mti": "0210", "fields": {"2": "'), pan, F.lit('", '), note, F.lit("}}"))
    rows = synth.table(spark, sf_dir, "orders").select("o_orderkey", files.json_message(text).alias("j"))
    made = rows.select("o_orderkey", iso.build(F.col("j.mti"), F.col("j.fields")).alias("b")).select("o_orderkey", "b", iso.parse(F.col("b.wire"), "hybrid").alias("m"))
    value = lambda n: F.decode(iso.field(F.col("m"), n), "US-ASCII")
    return made.select("o_orderkey", F.col("b.error.code").alias("error"), value(2).alias("pan"), value(48).alias("note"))


@query("""
SELECT o_orderkey, unnest([3, 4, 39, 48]) AS number, unnest(['n', 'n', 'an', 'ans']) AS type, unnest([6, 12, 2, length(o_orderpriority)])::INT AS length,
  unnest([left(o_orderpriority, 1) || '00000', lpad(floor(o_totalprice * 100 + 0.5)::BIGINT::VARCHAR, 12, '0'), CASE o_orderstatus WHEN 'F' THEN '00' WHEN 'O' THEN '05' ELSE '12' END, o_orderpriority]) AS value_text,
  unnest([NULL, NULL, NULL, 'Order note']) AS own_name FROM orders""")
def iso8583_message_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views under a spec from TOML that gives field 48 a name of its own; four of the fields, each checked against its hex."""
    from paywire.operators.fieldspec import FieldSpec

    spec = FieldSpec.from_toml('name = "own"\n[[field]]\nnumber = 48\ntype = "ans"\nlength = {lllvar = 999}\nname = "Order note"\n')
    parsed = synth.iso_wires(spark, sf_dir).select("o_orderkey", iso.parse(F.col("wire"), "hybrid", spec).alias("m"))
    rows = iso.message_view(parsed, "m", ["o_orderkey"], spec).where(F.col("number").isin(3, 4, 39, 48) & (F.unhex("value_hex") == F.encode("value_text", "US-ASCII")))
    return rows.select("o_orderkey", "number", "type", "length", "value_text", F.when(F.col("number") == 48, F.col("name")).alias("own_name"))


@query("""
SELECT o_orderkey, '{3:{108:' || o_orderkey || '}{119:STP}}' AS block3, '{5:{CHK:123456789ABC}{TNG:}}' AS block5, o_orderkey::VARCHAR AS user_reference, 'STP' AS flag, '' AS training FROM orders""")
def swift_tagged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks 3 and 5, read and built again."""
    mt = F.concat(F.lit("{1:F01X}{3:{108:"), F.col("o_orderkey").cast("string"), F.lit("}{119:STP}}{4:\r\n:20:A\r\n-}{5:{CHK:123456789ABC}{TNG:}}"))
    rows = synth.table(spark, sf_dir, "orders").select("o_orderkey", swift.parse(mt).alias("b"))
    wire = swift.build(F.col("b"))["wire"]
    part = lambda k, end: F.regexp_extract(wire, rf"(\{{{k}:.*\}}){end}", 1)
    return rows.select("o_orderkey", part(3, r"\{4").alias("block3"), part(5, "$").alias("block5"), swift.first(F.col("b.b3"), "108").alias("user_reference"), swift.first(F.col("b.b3"), "119").alias("flag"), swift.first(F.col("b.b5"), "TNG").alias("training"))


@query("""
SELECT o_orderkey % 5 AS kind, CASE o_orderkey % 5 WHEN 0 THEN 'MissingBlockSeparator' WHEN 1 THEN 'InvalidBlockId' WHEN 2 THEN 'MalformedField' WHEN 3 THEN 'MalformedTag' END AS error, count(*) AS n FROM orders GROUP BY ALL""")
def swift_more_block_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 5
    mt = F.when(kind == 0, F.lit("{1F01X}")).when(kind == 1, F.lit("{7:X}")).when(kind == 2, F.lit("{4:\r\n:20:A\r\n:-x\r\n-}")).when(kind == 3, F.lit("{3:{108}}")).otherwise(F.lit("{1:F01X}"))
    return synth.table(spark, sf_dir, "orders").select(kind.alias("kind"), swift.parse(mt)["error"].alias("error")).groupBy("kind", "error").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey % 6 AS kind, CASE o_orderkey % 6 WHEN 0 THEN 'InvalidTag' WHEN 1 THEN 'InvalidSubTag' WHEN 2 THEN 'ValueSplitsField' WHEN 3 THEN 'ValueEndsBlock' WHEN 4 THEN 'BraceInValue' END AS error, o_orderkey % 6 = 5 AS built, count(*) AS n FROM orders GROUP BY ALL""")
def swift_build_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 6
    pair = lambda tag, value: F.array(F.struct(tag.alias("tag"), value.alias("value")))
    value = F.when(kind == 2, F.lit("A\n:B")).when(kind == 3, F.lit("A\r\n-\r\nB")).when(kind == 4, F.lit("A}B")).otherwise(F.lit("A"))
    blocks = F.struct(F.lit("F01X").alias("b1"), F.lit(None).cast("string").alias("b2"), F.when(kind == 1, pair(F.lit("1{8"), F.lit("x"))).alias("b3"), pair(F.when(kind == 0, F.lit("2 0")).otherwise(F.lit("20")), value).alias("b4"), F.lit(None).alias("b5"), F.lit(None).cast("string").alias("error")).cast(swift.BLOCKS)
    made = synth.table(spark, sf_dir, "orders").select(kind.alias("kind"), swift.build(blocks).alias("b"))
    return made.groupBy("kind", F.col("b.error").alias("error"), F.col("b.wire").isNotNull().alias("built")).agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey % 4 AS kind, CASE o_orderkey % 4 WHEN 1 THEN 'InvalidLength' WHEN 2 THEN 'InvalidCharset' END AS error, CASE o_orderkey % 4 WHEN 3 THEN 'raw' ELSE 'reference' END AS semantic,
  count(*) AS n, count(*) FILTER (o_orderkey % 4 = 0) AS references_, count(*) FILTER (o_orderkey % 4 = 3) AS raws FROM orders GROUP BY ALL""")
def swift_20_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoder by tag: 20 in three states, and a tag that no decoder knows."""
    kind = F.col("o_orderkey") % 4
    raw = F.when(kind == 1, F.lit("ABCDEFGHIJKLMNOPQ")).when(kind == 2, F.lit("a#")).otherwise(F.col("o_orderkey").cast("string"))
    found = synth.table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), swift.decode(F.when(kind == 3, F.lit("77B")).otherwise(F.lit("20")), raw).alias("d"))
    good = lambda c: F.count_if(F.col(c) == F.col("o_orderkey").cast("string"))
    return found.groupBy("kind", F.col("d.error").alias("error"), F.col("d.kind").alias("semantic")).agg(F.count("*").alias("n"), good("d.reference").alias("references_"), good("d.raw").alias("raws"))


_CELLS = conf.MaskSpec.from_toml('interface = "cells"\n' + "".join(f'[[mask]]\nfield = {n}\nmask = "{m}"\n{x}\n' for n, m, x in ((2, "volatile", ""), (3, "crypto", ""), (4, "intended-delta", 'expect_hex = "62"'))))


@query("""
WITH c AS (SELECT unnest([1, 2, 3, 4]) AS field, o_orderkey % 4 AS cell FROM orders),
v AS (
  SELECT field, cell, CASE field WHEN 1 THEN 'stable' WHEN 2 THEN 'volatile' WHEN 3 THEN 'crypto' ELSE 'intended-delta' END AS mask,
    CASE WHEN field = 2 THEN 'volatile-normalized' WHEN field = 3 THEN 'crypto-excluded' WHEN field = 1 THEN CASE WHEN cell = 3 THEN 'equal' ELSE 'UNEXPLAINED' END
         WHEN cell IN (1, 3) THEN 'intended-delta' ELSE 'UNEXPLAINED' END AS verdict,
    CASE WHEN field = 1 AND cell IN (1, 2) THEN 'presence_mismatch' WHEN field = 1 AND cell = 0 THEN 'occurrence_count_diff' WHEN field = 4 AND cell = 2 THEN 'intended_delta_unmet' WHEN field = 4 AND cell = 0 THEN 'occurrence_count_diff' END AS reason
  FROM c)
SELECT field, cell, mask, verdict, reason, count(*) AS n FROM v GROUP BY ALL""")
def conformance_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mask with a field on the migrated side only (1), the legacy side only (2), both (3), and twice against once (0)."""
    lines = synth.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("cell"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("number"))
    keys = ["o_orderkey", "cell"]
    b, side = F.lit(bytearray(b"b")), lambda *cells: F.col("cell").isin(*cells)
    legacy = lines.where(side(0, 2, 3)).select(*keys, "number", F.explode(F.when(F.col("cell") == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("occurrence"), b.alias("value"))
    migrated = lines.where(side(0, 1, 3)).select(*keys, "number", F.lit(0).alias("occurrence"), b.alias("value"))
    rows = conf.diff_views(legacy, migrated, keys, _CELLS)
    return rows.groupBy("field", "cell", "mask", "verdict", "reason").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey % 3 AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'equal' ELSE 'UNEXPLAINED' END AS verdict, CASE o_orderkey % 3 WHEN 1 THEN 'value_diff' WHEN 2 THEN 'length_diff' END AS reason, count(*) AS n FROM orders GROUP BY ALL""")
def conformance_worst_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that occurs three times on either side: the first drift among the pairs counts."""
    kind = F.col("o_orderkey") % 3
    orders = synth.table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))
    text = lambda s: F.lit(bytearray(s.encode()))
    view = lambda third, second: orders.select("o_orderkey", "kind", F.lit(9).alias("number"), F.posexplode(F.array(text("a"), second, third)).alias("occurrence", "value"))
    other = F.when(F.col("kind") == 2, text("xyz")).otherwise(text("b"))
    rows = conf.diff_views(view(text("c"), text("b")), view(F.when(F.col("kind") == 0, text("c")).otherwise(text("d")), other), ["o_orderkey", "kind"], conf.MaskSpec())
    return rows.groupBy("kind", "verdict", "reason").agg(F.count("*").alias("n"))


@query(_ADDRESS + """, g AS (SELECT c_custkey, s, cc, bad, message_type AS t FROM a)
SELECT c_custkey, CASE WHEN NOT bad THEN s = 0 END AS all_compliant, CASE WHEN bad THEN NULL WHEN s = 0 THEN '' ELSE 'creditor' END AS failing, CASE WHEN bad THEN 'MalformedXml' END AS error,
  CASE WHEN NOT bad THEN '{"message_type":"' || t || '","compliant":' || (s = 0)::VARCHAR || ',"rows":[{"party":"debtor","verdict":"compliant","town_name":"Town ' || c_custkey || '","country":"' || cc || '","unstructured_lines":0,"remediation":null},{"party":"creditor","verdict":"'
    || CASE s WHEN 0 THEN 'compliant","town_name":"Town ' || c_custkey || '","country":"' || cc || '","unstructured_lines":0,"remediation":null'
              WHEN 1 THEN 'missing_structured","town_name":null,"country":null,"unstructured_lines":2,"remediation":"add TwnNm and Ctry; 2 unstructured line(s) present"'
              WHEN 2 THEN 'missing_structured","town_name":"Town ' || c_custkey || '","country":null,"unstructured_lines":0,"remediation":"add Ctry"'
              ELSE 'no_address","town_name":null,"country":null,"unstructured_lines":null,"remediation":"add a postal address with TwnNm and Ctry"' END || '}]}' END AS report
FROM g""")
def mx_address_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mx.check_addresses(synth.address_envelopes(spark, sf_dir), ["c_custkey"], "xml")
    return mx.address_reports(rows, ["c_custkey"]).select("c_custkey", "all_compliant", F.array_join("failing", ",").alias("failing"), "error", "report")


@query("""
SELECT c_custkey % 2 = 1 AS with_gaps, count(*) FILTER (c_custkey % 4 = 0) AS compliant, count(*) FILTER (c_custkey % 4 <> 0) AS non_compliant, 0::BIGINT AS errors, max((c_custkey % 4 <> 0)::INT)::INT AS gate
FROM customer WHERE c_custkey % 5 <> 4 AND (c_custkey % 4 = 0 OR c_custkey % 2 = 1) GROUP BY 1""")
def mx_address_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate 0 of a batch without gaps and gate 1 of one with them."""
    rows = mx.check_addresses(synth.address_envelopes(spark, sf_dir).where("c_custkey % 5 <> 4"), ["c_custkey"], "xml")
    gates = [mx.address_gate(rows.where(of), ["c_custkey"]).withColumn("with_gaps", F.lit(gaps)) for of, gaps in (("c_custkey % 4 = 0", False), ("c_custkey % 2 = 1", True))]
    return gates[0].unionByName(gates[1])


@query(_ADDRESS + "SELECT DISTINCT c_custkey, message_type, true AS same FROM a WHERE NOT bad")
def mx_xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type as the header names it, and XML and JSON of what was read, which are read back to the same value."""
    docs = synth.address_envelopes(spark, sf_dir).select("c_custkey", mx.parse(F.col("xml")).alias("d")).select("c_custkey", "d", mx.to_xml(F.col("d")).alias("x")).where("x is not null")
    again = mx.to_json(mx.parse(F.col("x"))) == mx.to_json(F.col("d"))
    return docs.select("c_custkey", mx.message_type(F.col("d")).alias("message_type"), again.alias("same"))


@query("""
WITH p AS (SELECT o_orderkey AS k, rtrim(repeat(c_name || ' ', (1 + o_orderkey % 9)::INT)) AS name FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (
  SELECT k, 'debtor_name' AS role, CASE WHEN length(name) > 140 THEN '{"role":"debtor_name","verdict":"truncated","lost_suffix":"' || name[141:] || '","lost_chars":' || (length(name) - 140) || '}' ELSE '{"role":"debtor_name","verdict":"equal"}' END AS payload FROM p
  UNION ALL SELECT k, 'creditor_name', CASE WHEN k % 7 = 0 THEN '{"role":"creditor_name","verdict":"mismatch","mt":"SOME CREDITOR","mx":"OTHER CREDITOR"}' ELSE '{"role":"creditor_name","verdict":"equal"}' END FROM p
  UNION ALL SELECT k, 'remittance_info', '{"role":"remittance_info","verdict":"' || CASE WHEN k % 12 = 0 THEN 'absent_both"}' WHEN k % 6 = 0 THEN 'added","mt":"ORDER ' || k || ' PAID"}'
    WHEN k % 4 = 0 THEN 'dropped","mx":"ORDER ' || k || CASE WHEN k % 5 = 0 THEN '  PAID"}' ELSE ' PAID"}' END WHEN k % 5 = 0 THEN 'reformatted","mt":"ORDER ' || k || ' PAID","mx":"ORDER ' || k || '  PAID"}' ELSE 'equal"}' END FROM p
  UNION ALL SELECT k, 'settlement_amount', '{"role":"settlement_amount","verdict":"equal"}' FROM p
  UNION ALL SELECT k, 'settlement_currency', '{"role":"settlement_currency","verdict":"equal"}' FROM p)
SELECT k AS o_orderkey, role, payload, NULL AS error FROM r WHERE k % 10 NOT IN (1, 2)
UNION ALL SELECT k, NULL, NULL, CASE k % 10 WHEN 1 THEN 'MissingMt' ELSE 'MissingMx' END FROM p WHERE k % 10 IN (1, 2)""")
def mtmx_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides from two tables, each of which lacks some; payloads as JSON."""
    both = synth.mt_mx(spark, sf_dir)
    pairs = mtmx.pair(both.where("o_orderkey % 10 <> 1"), both.where("o_orderkey % 10 <> 2"), ["o_orderkey"], "mt", "mx")
    return mtmx.payloads(mtmx.diff(pairs, ["o_orderkey"], "mt", "xml")).select("o_orderkey", "role", "payload", "error")


@query(f"""
WITH w AS (SELECT *, (o_orderkey % 4 = 0) AS short FROM orders)
SELECT o_orderkey, CASE WHEN short THEN '4XXXXX' ELSE left({_PAN}, 6) || 'XXXXXX' || right({_PAN}, 4) END AS pan, CASE WHEN short THEN 10000 ELSE 100000 END::BIGINT AS anonymity, false AS low,
  CASE WHEN short THEN 'sanitize_version = 1' || chr(10) || 'round_trip_verified = true' || chr(10) || 'byte_length = 20' || chr(10) ELSE 'sanitize_version = 1' || chr(10) || 'round_trip_verified = true' || chr(10) || 'byte_length = 30' || chr(10) END AS head,
  sha256(chr(48) || '210' || '@' || repeat(chr(0), 7) || CASE WHEN short THEN '064XXXXX' ELSE '16' || left({_PAN}, 6) || 'XXXXXX' || right({_PAN}, 4) END) AS sha256
FROM w""")
def redact_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a card number alone, long or of six digits, whose redacted bytes are plain text; the digest and the first lines of the meta text."""
    pan = F.when(F.col("o_orderkey") % 4 == 0, F.lit("412345")).otherwise(F.concat(F.lit("4"), F.lpad(F.col("o_custkey").cast("string"), 15, "0")))
    wires = synth.table(spark, sf_dir, "orders").select("o_orderkey", iso.build(F.lit("0210"), F.array(F.struct(F.lit(2).alias("number"), F.encode(pan, "US-ASCII").alias("value"))))["wire"].alias("wire"))
    done = redact.with_meta(redact.sanitize(wires, ["o_orderkey"], "wire")).withColumn("toml", redact.meta_toml())
    shown = F.decode(iso.field(iso.parse(F.col("wire"), "hybrid"), 2), "US-ASCII")
    return done.select("o_orderkey", shown.alias("pan"), "anonymity", F.col("low_anonymity").alias("low"), F.regexp_extract("toml", "(?s)^(.*)sha256_redacted", 1).alias("head"), "sha256")


@query("SELECT l_linenumber = 7 AS other, count(*) AS frames, count(*) FILTER (l_linenumber <> 7) AS matched, CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS gate FROM lineitem GROUP BY ALL UNION ALL SELECT NULL, 0, 0, 2")
def layout_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates 0 and 1, and 2 of no frames, under the layout as TOML has it."""
    text = 'name = "reply"\n' + "".join(f'[[field]]\nname = "{n}"\nlen = {size}\n' for n, size in LAYOUT.fields)
    same, frames = fixed.Layout.from_toml(text), _frames(spark, sf_dir)
    gates = [fixed.layout_gate(frames.where(of), "frame", same).withColumn("other", F.lit(other).cast("boolean")) for of, other in (("l_linenumber <> 7", False), ("l_linenumber = 7", True), ("false", None))]
    return gates[0].unionByName(gates[1]).unionByName(gates[2])


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'UNEXPLAINED' ELSE 'equal' END AS amount, 'equal' AS account, (CASE WHEN o_orderkey % 3 = 0 THEN 75 ELSE 100 END)::INT AS percent FROM orders""")
def layout_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides' fixed frames, diffed by field and rolled up; every third order has another amount."""
    text = F.concat(F.lit("0210OK"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0"), F.lpad(F.floor("o_totalprice").cast("string"), 12, "0"))
    frames = synth.table(spark, sf_dir, "orders").select("o_orderkey", F.encode(text, "US-ASCII").alias("frame"))
    other = frames.withColumn("frame", F.when(F.col("o_orderkey") % 3 == 0, F.expr("concat(substring(frame, 1, 26), encode('999999999999', 'US-ASCII'))")).otherwise(F.col("frame")))
    keys = ["o_orderkey"]
    rows = conf.diff_views(fixed.long_view(frames, "frame", keys, LAYOUT), fixed.long_view(other, "frame", keys, LAYOUT), keys, conf.MaskSpec())
    of = lambda n, name: F.max(F.when(F.col("field") == n, F.col("verdict"))).alias(name)
    return rows.groupBy(*keys).agg(of(3, "amount"), of(2, "account")).join(conf.coverage(rows, keys).select(*keys, "percent"), keys)


@query("""
WITH d AS (SELECT source AS path, doc_id, strlen(text) + 8 AS size FROM documents),
s AS (SELECT path, sum(size)::BIGINT AS size FROM d GROUP BY 1)
SELECT path, 8::BIGINT AS offset_, size + 8 + 13 AS bytes, count_ + 1 AS records, size + 8 AS last_offset FROM s JOIN (SELECT path, count(*) AS count_ FROM d GROUP BY 1) USING (path)""")
def log_append_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of every source's texts, each with one record more; then cut back to the mark, and the texts appended again.

    A source's logs are added up, so offsets are those of its first log where it has one only.
    """
    docs = synth.table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("o"), F.encode("text", "UTF-8").alias("payload"))
    files_ = log.log_files(docs, "path", "o", "payload").select(F.concat_ws("/", "path", "segment").alias("path"), "content")
    cut = log.truncated(files_, F.lit(0))
    dealt = docs.join(docs.groupBy("path").agg(F.ceil(F.sum(F.octet_length("payload") + 8) / (4 << 20)).alias("k")), "path").withColumn("path", F.concat_ws("/", "path", F.pmod(F.xxhash64("o", "payload"), F.col("k"))))
    first = log.appended(cut, dealt)
    ends = first.select("path", F.lit(2**40).alias("o"), F.lit(bytearray(b"close")).alias("payload"))
    last = ends.where(F.substring_index("path", "/", -1) == "0")
    second = log.appended(first.drop("offset"), last).withColumnRenamed("offset", "closed")
    read = log.explode_logs(second).groupBy("path").agg(F.count("payload").alias("records"))
    whole = second.join(first.select("path", "offset"), "path").join(read, "path").withColumn("path", F.substring_index("path", "/", 1))
    n = F.octet_length("content").cast("long")
    many = F.count("*") - 1  # a mark for each further log
    return whole.groupBy("path").agg(F.min("offset").alias("offset_"), (F.sum(n) - 8 * many).alias("bytes"), F.sum("records").alias("records"), (F.sum(n) - 8 * many - 13).alias("last_offset"))


_STORED = """SELECT source, count(*) AS records, sum(strlen(source) + 1 + strlen(text))::BIGINT AS bytes, min(md5(text)) AS least, max(md5(text)) AS most FROM documents GROUP BY source"""


def _documents_log(spark: SparkSession, sf_dir: str, where: str = "true", path: str | None = None) -> str:
    """A log of all texts, each behind its source's name, in small segments; the folder."""
    store.register(spark)
    path = path or new_folder(spark, "log")
    docs = synth.table(spark, sf_dir, "documents").where(where).select(F.encode(F.concat_ws("\n", "source", "text"), "UTF-8").alias("payload"))
    docs.write.format("paywire_log").option("segmentBytes", 8 << 20).mode("append").save(path)
    return path


def _sources_of(records: DataFrame) -> DataFrame:
    text = F.decode("payload", "UTF-8")
    end = F.expr("locate('\n', decode(payload, 'UTF-8'))")
    rows = records.where("payload is not null").select(F.left(text, end - 1).alias("source"), F.octet_length("payload").alias("n"), F.md5(F.substring(text, end + 1, F.length(text)).cast("binary")).alias("m"))
    return rows.groupBy("source").agg(F.count("*").alias("records"), F.sum("n").cast("long").alias("bytes"), F.min("m").alias("least"), F.max("m").alias("most"))


@query(_STORED)
def log_store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by many tasks and published at once, then read in pieces that the log's own marks allow."""
    path = _documents_log(spark, sf_dir)
    return _sources_of(spark.read.format("paywire_log").option("splitBytes", 1 << 20).load(path))


@query(_STORED)
def log_split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same segments as plain logs without marks, each read by several tasks."""
    return _sources_of(log.read_log_split(spark, f"{_documents_log(spark, sf_dir)}/*.log", 1 << 20))


@query(_STORED)
def log_tail_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream follows the log while it is appended to: half of the documents before its first run, half between two."""
    path, seen, state = (new_folder(spark, x) for x in ("log", "seen", "state"))
    for where in ("doc_id % 2 = 0", "doc_id % 2 <> 0 or doc_id is null"):
        _documents_log(spark, sf_dir, where, path)
        rows = spark.readStream.format("paywire_log_tail").load(path)
        rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(seen).awaitTermination()
    return _sources_of(spark.read.schema(log.RECORDS).parquet(seen))


@query("""
SELECT length(o_orderpriority)::INT AS length, count(*) AS frames, 0::BIGINT AS dropped FROM orders GROUP BY 1
UNION ALL SELECT -1, 0, count(*) FROM (SELECT DISTINCT o_custkey % 50, o_orderkey // 5000 FROM orders)""")
def trace_split_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces in a few files, read in parts of 64 KB: the frames of each length, and the dumps that were cut off."""
    store.register(spark)
    path = new_folder(spark, "traces")
    _trace_files(spark, sf_dir).select("content").write.text(path)
    dumps = spark.read.format("paywire_trace").option("suffix", ".txt").option("splitBytes", 64 << 10).load(path)
    return dumps.groupBy(F.coalesce(F.octet_length("frame"), F.lit(-1)).alias("length")).agg(F.count("frame").alias("frames"), F.count_if(F.col("frame").isNull()).alias("dropped"))


def _same_as(name: str):
    return query(ORACLE_SQL[name])


@_same_as("conformance_gate")
def conformance_gate_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of `conformance_gate` from counts that the write of all field rows takes along."""
    gate = Gate(conf.gate_of)
    diffs = conf.wire_diffs(synth.captures(spark, sf_dir), ["o_orderkey"], "request", "legacy", "migrated", SPEC)
    conf.field_rows(conf.watched(diffs, gate), ["o_orderkey"]).write.parquet(new_folder(spark, "fields"))
    return gate.row(spark)


@_same_as("mx_address_gate")
def mx_gate_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of `mx_address_gate` from counts that the write of all party rows takes along."""
    gate = Gate(mx.gate_of)
    mx.check_addresses(synth.address_envelopes(spark, sf_dir), ["c_custkey"], "xml", gate).write.parquet(new_folder(spark, "parties"))
    return gate.row(spark)


@_same_as("conformance_long_views")
def conformance_bucketed_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long views as tables in buckets of the capture: the diff itself moves no row."""
    view = lambda side: iso.long_view(synth.iso_wires(spark, sf_dir, side).select("o_orderkey", iso.parse(F.col("wire"), "hybrid").alias("m")), "m", ["o_orderkey"]).withColumn("occurrence", F.lit(0))
    folder = new_folder(spark, "views")
    tables = []
    for name, side in (("legacy", False), ("migrated", True)):
        label = "paywire_" + folder.rsplit("-", 1)[-1] + "_" + name
        tables.append(conf.bucketed_view(view(side), ["o_orderkey"], label, 8, f"{folder}/{name}"))
        spark.sql(f"DROP TABLE {label}")  # the name only
    return conf.diff_views(*tables, ["o_orderkey"], SPEC).groupBy("field", "mask", "verdict", "reason").agg(F.count("*").alias("n"))


_SPECS = [
    ("wide", True, 48, "ans", 3, 999, "note"), ("wide", True, 60, "n", 0, 3, "code"),
    ("own", False, 3, "n", 0, 6, "processing"), ("own", False, 11, "n", 0, 6, "trace"), ("own", False, 48, "ans", 2, 15, "note"), ("own", False, 60, "n", 2, 5, "code"),
    ("short", True, 48, "ans", 2, 5, "note"), ("short", True, 60, "n", 2, 3, "code"),
]


@query("""
SELECT o_orderkey, spec, error, CASE WHEN error IS NULL THEN o_orderpriority END AS note, CASE WHEN error IS NULL THEN '007' END AS code,
       CASE WHEN error IS NULL AND spec <> 'wide' THEN 'InsufficientBytes' END AS as_wide
FROM (SELECT *, CASE WHEN spec = 'other' THEN 'UnknownSpec' WHEN spec = 'short' AND length(o_orderpriority) > 5 THEN 'LengthExceedsMax' END AS error
  FROM (SELECT *, ['wide', 'own', 'short', 'other'][o_orderkey % 4 + 1] AS spec FROM orders))""")
def iso8583_specs_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages built and read under the spec that each row names; read under another one they are errors."""
    specs = SpecTable.of(spark.createDataFrame(_SPECS, "spec string, extends boolean, number int, type string, prefix int, size int, name string"))
    spec = F.element_at(F.array(*map(F.lit, ("wide", "own", "short", "other"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = lambda c: F.encode(c, "US-ASCII")
    values = ((3, F.lit("000000")), (11, F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0")), (48, F.col("o_orderpriority")), (60, F.lit("007")))
    fields = F.array(*(F.struct(F.lit(n).alias("number"), text(v).alias("value")) for n, v in values))
    made = synth.table(spark, sf_dir, "orders").select("o_orderkey", spec.alias("spec"), iso.build_by(F.lit("0200"), fields, spec, specs).alias("b"))
    wide = F.when(F.col("spec") != "wide", iso.sniff_by(F.col("b.wire"), F.lit("wide"), specs)["error"]["code"])
    read = made.select("o_orderkey", "spec", "b", wide.alias("as_wide"), iso.sniff_by(F.col("b.wire"), F.col("spec"), specs).alias("m"))
    value = lambda n: F.decode(iso.field(F.col("m"), n), "US-ASCII")
    return read.select("o_orderkey", "spec", F.coalesce("b.error.code", "m.error.code").alias("error"), value(48).alias("note"), value(60).alias("code"), F.when(F.col("b.wire").isNotNull(), F.col("as_wide")).alias("as_wide"))
