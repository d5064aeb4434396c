"""Line protocol as column expressions over text lines: no Python runs on the executors.

A line is `measurement[,tag=value...] field=value[,field=value...] timestamp`. A backslash escapes a space, comma, equals
sign, quote or backslash; strings are quoted. The timestamp's unit follows from its number of digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.tags import tags_json
from tideline.operators.aggregate import finite

_TOKEN = r"(?:\\.|[^\\ ,=])*"
_HEAD = rf"((?:\\.|[^\\ ,])+)((?:,{_TOKEN}={_TOKEN})*)"
_FIELD = rf'{_TOKEN}=(?:"(?:\\.|[^"\\])*"|(?:\\.|[^\\ ,"])*)'
_LINE = rf"^{_HEAD} +({_FIELD}(?:,{_FIELD})*) +(-?[0-9]+)\s*$"


#: Puts the four parts of a line apart; a line that holds it itself takes a slower way.
_APART = "\u0001"


def _backslash(text: Column) -> Column:
    return F.contains(text, F.lit("\\"))


def _unescaped(text: Column) -> Column:
    return F.when(_backslash(text), F.regexp_replace(text, r"\\(.)", "$1")).otherwise(text)


def timestamp_us(text: Column, legacy: bool = False) -> Column:
    """Microseconds: 19 digits are ns, 16 µs, 13 ms, 10 s, anything else µs. legacy keeps an old reading in which 16 and
    13 digits come out as seconds."""
    n, digits = text.try_cast("long"), F.length(F.ltrim(text, F.lit("-")))
    micro, milli = tuple((n.cast("decimal(20,0)") / k).cast("long") for k in (1_000_000, 1_000)) if legacy else (n, n * 1_000)
    return F.when(digits == 19, ((n - F.pmod(n, F.lit(1000))).cast("decimal(20,0)") / 1000).cast("long")).when(digits == 16, micro).when(digits == 13, milli).when(digits == 10, n * 1_000_000).otherwise(n).cast("long")


def _value(text: Column) -> Column:
    """A typed field value; type is null where the text is none. Whatever begins with a quote is quoted, as the line's form tells."""
    quoted, whole = text.startswith('"'), text.endswith("i")
    number = F.when(~quoted & ~whole & text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), finite(text.try_cast("double")))
    i64 = F.when(~quoted & whole & text.rlike(r"^[+-]?[0-9]+i$"), F.substring(text, F.lit(1), F.length(text) - 1).try_cast("long"))
    flag = F.when(text.isin("true", "false"), text == "true")
    string = F.when(quoted, _unescaped(F.substring(text, F.lit(2), F.length(text) - 2)))
    kind = F.when(quoted, "text").when(i64.isNotNull(), "i64").when(flag.isNotNull(), "bool").when(number.isNotNull(), "f64")
    return F.struct(kind.alias("type"), i64.alias("i64"), number.alias("f64"), flag.alias("b"), string.alias("s"))


def _pair(text: Column) -> tuple[Column, Column]:
    """Key and value around the first equals sign that is not escaped."""
    at = F.locate("=", text)
    key = F.when(_backslash(text), F.regexp_extract(text, rf"^({_TOKEN})=", 1)).otherwise(F.substring(text, F.lit(1), at - 1))
    value = F.when(_backslash(text), F.regexp_replace(text, rf"^{_TOKEN}=", "")).otherwise(F.substring(text, at + 1, F.length(text)))
    return _unescaped(key), value


def _parts(text: Column) -> Column:
    """Measurement, tags, fields and time of a line, as they stand, by one match; anything but four parts is no line."""
    slow = F.when(text.rlike(_LINE), F.array(*[F.regexp_extract(text, _LINE, i) for i in range(1, 5)]))
    return F.when(F.contains(text, F.lit(_APART)), slow).otherwise(F.split(F.regexp_replace(text, _LINE, _APART.join(f"${i}" for i in range(1, 5))), _APART))


def parse(lines: DataFrame, column: str = "value", legacy_ts: bool = False) -> DataFrame:
    """Points: the input's columns, measurement, tags, tags_json, fields, ts_us, and error (null for a good point).

    Blank lines and lines that start with # are left out. A bad line stays, with its error, so that callers can split
    good from rejected or fail (see `strict`).
    """

    def tag(t: Column) -> Column:
        k, v = _pair(t)
        return F.struct(k.alias("key"), _unescaped(v).alias("value"))

    def field(f: Column) -> Column:
        k, v = _pair(f)
        return F.struct(k.alias("key"), _value(v).alias("value"))

    text = F.trim(F.col(column))
    split = lines.where((text != "") & ~text.startswith("#")).select("*", _parts(text).alias("_p")).withColumn("_ok", F.coalesce(F.size("_p") == 4, F.lit(False)))
    part = lambda i: F.when(F.col("_ok"), F.get("_p", F.lit(i))).otherwise("")
    tags = F.when(part(1) != "", F.regexp_extract_all(part(1), F.lit(rf",({_TOKEN}={_TOKEN})"), 1)).otherwise(F.expr("cast(array() as array<string>)"))
    fields = F.regexp_extract_all(part(2), F.lit(f"({_FIELD})"), 1)
    out = split.select(
        *lines.columns, "_ok", _unescaped(part(0)).alias("measurement"), F.transform(tags, tag).alias("tags"),
        F.transform(F.filter(fields, lambda f: f != ""), field).alias("fields"), timestamp_us(part(3), legacy_ts).alias("ts_us"),
    )
    error = (
        F.when(~F.col("_ok"), "malformed line").when(F.trim("measurement") == "", "blank measurement").when(F.exists("tags", lambda t: t["key"] == ""), "empty tag key")
        .when(F.size("fields") == 0, "no field").when(F.exists("fields", lambda f: f["key"] == ""), "empty field key")
        .when(F.exists("fields", lambda f: f["value"]["type"].isNull()), "bad field value").when(F.col("ts_us").isNull(), "bad timestamp")
    )
    return out.withColumn("error", error).withColumn("tags_json", tags_json(F.col("tags"))).drop("_ok")


def strict(points: DataFrame) -> DataFrame:
    """Fails the job at the first bad line, whichever of the parsed columns it reads. (A filter would be pushed below the
    parsing and do all of it twice.)"""
    wrong = F.concat(F.lit("line protocol: "), F.col("error"))
    checked = {c: F.when(F.col("error").isNull(), F.col(c)).otherwise(F.raise_error(wrong).cast(points.schema[c].dataType)) for c in ("measurement", "tags_json", "tags", "fields", "ts_us", "error")}
    return points.select(*[checked[c].alias(c) if c in checked else F.col(c) for c in points.columns])


def samples(points: DataFrame, seq: Column | None = None, table: str | None = None) -> DataFrame:
    """Narrow samples of good points, one for each numeric field; other fields are left out. A metric is the measurement
    (`table`, where given, in its place), or measurement.field beyond the first field; `measurement` stands beside it."""
    named = points.select((F.col("measurement") if table is None else F.lit(table)).alias("measurement"), "tags_json", "ts_us", F.when(F.col("error").isNull(), F.col("fields")).alias("fields"), (F.lit(0).cast("long") if seq is None else seq).alias("seq"))
    each = named.select("measurement", "tags_json", "ts_us", F.posexplode("fields").alias("at", "f"), "seq")
    value = F.coalesce(F.col("f.value.f64"), F.col("f.value.i64").cast("double"))
    metric = F.when(F.col("at") == 0, F.col("measurement")).otherwise(F.concat_ws(".", "measurement", "f.key"))
    return each.where(value.isNotNull()).select(metric.alias("metric_name"), "tags_json", "ts_us", value.alias("value_real"), F.lit(0).alias("quality"), "seq", "measurement")


def first_field(points: DataFrame) -> DataFrame:
    """The first field of each point; null where there is none."""
    return points.withColumn("first_field", F.try_element_at("fields", F.lit(1)))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([ ,=\\])", r"\\$1")


def render(measurement: Column, tags: Column, fields: Column, ts_ns: Column) -> Column:
    """A line of a measurement, (key, value) tags and (key, text) fields whose text is already typed."""
    tag_text = F.array_join(F.transform(tags, lambda t: F.concat(F.lit(","), escaped(t["key"]), F.lit("="), escaped(t["value"]))), "")
    field_text = F.array_join(F.transform(fields, lambda f: F.concat(escaped(f["key"]), F.lit("="), f["value"])), ",")
    return F.concat(F.regexp_replace(measurement, r"([ ,\\])", r"\\$1"), tag_text, F.lit(" "), field_text, F.lit(" "), ts_ns.cast("string"))


def read(spark, path: str, **options) -> DataFrame:
    """Parse text files of lines."""
    return parse(spark.read.text(path), "value", **options)
